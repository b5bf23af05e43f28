"""Words, lines and shingles of Arrow text columns as numpy arrays.

A column is worked on in chunks of whole texts (about ``CHUNK`` bytes each), so memory follows the chunk and
the longest text, not the batch. Hashes are 64-bit polynomials over the bytes, finished by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = np.uint64(0xD6E8FEB86659FD93)


class Emptied(list):
    """A list that arrives empty wherever it is sent."""

    def __reduce__(self):
        return list, ()


_POWERS: list[np.ndarray] = Emptied()


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Lookup table that is True for the bytes in the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


#: Letters a-z, digits and everything beyond ASCII; texts are lower-cased (A-Z) first.
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Everything but space and the five control characters from tab to carriage return.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; equal inputs give equal outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i for i up to n, modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, CHUNK + (CHUNK >> 2)) if n <= CHUNK + (CHUNK >> 2) else n + 1
        made = []
        for base in (BASE, BASE_INVERSE):
            column = np.full(size, base, np.uint64)
            column[0] = 1
            made.append(np.cumprod(column, dtype=np.uint64))
        if n > CHUNK + (CHUNK >> 2):
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


@dataclass
class Texts:
    """Some whole texts of a column: their bytes one after the other, and where each begins (one entry more)."""

    first: int
    data: np.ndarray
    starts: np.ndarray

    @property
    def n(self) -> int:
        return len(self.starts) - 1

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[self.starts[1:]] - total[self.starts[:-1]]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Texts]:
    """Cut a string column into runs of whole texts. A null is a text of no bytes."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null may have bytes below it
        valid = np.asarray(column.is_valid())
        if (np.diff(offsets)[~valid] > 0).any():
            yield from chunks(column.fill_null(""), size)
            return
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, n)
        yield Texts(at, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
        at = to


class Hashes:
    """Hashes of any byte ranges of some texts, from one running sum."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin])


@dataclass
class Words:
    """Words of some texts: hash, text number, and per text the number of its first word (one entry more)."""

    hash: np.ndarray
    text: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def left(self) -> np.ndarray:
        """For each word, the number of words from it to the end of its text."""
        return self.first[1:][self.text] - np.arange(len(self.text))


def runs(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of marked bytes; no run goes on into the next text."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def words(texts: Texts, inside: np.ndarray = ALNUM, lower: bool = True, hashes: Hashes | None = None) -> Words:
    """Runs of the bytes marked in ``inside``; with ``lower`` A-Z count as a-z."""
    data = LOWER[texts.data] if lower else texts.data
    begin, end = runs(inside[data], texts.starts)
    hashes = hashes or Hashes(data)
    first = np.searchsorted(begin, texts.starts)
    return Words(hashes.of(begin, end), np.repeat(np.arange(texts.n), np.diff(first)), first, begin, end)


def shingles(found: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of ``size`` words; a text of fewer words, but some, is one shingle."""
    n = len(found.hash)
    full = np.flatnonzero(found.left() >= size)
    value = found.hash[full]
    for k in range(1, size):
        value = value * STEP + found.hash[full + k]
    counts = found.counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short) and n:
        at, long = found.first[short], counts[short]
        small = found.hash[at]
        for k in range(1, size - 1):
            more = long > k
            small = np.where(more, small * STEP + found.hash[np.minimum(at + k, n - 1)], small)
        small = small ^ (long.astype(np.uint64) << np.uint64(56))
        text = np.concatenate([found.text[full], short])
        value = np.concatenate([value, small])
        order = np.argsort(text, kind="stable")
        return mix(value[order]), text[order]
    return mix(value), found.text[full]


def within(key: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal keys of the same text."""
    return mix(key + text.astype(np.uint64) * STEP)


def repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the entries equal to an earlier one, and of those equal to any other."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, any_other = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    any_other[order[1:][same]] = True
    any_other[order[:-1][same]] = True
    return later, any_other


def distinct_pairs(key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, key), sorted by text and key."""
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    return key[keep], text[keep]


def covered(begin: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Marks of the places inside any [begin, begin + length)."""
    steps = np.bincount(begin, minlength=n + 1)[:n + 1] - np.bincount(begin + length, minlength=n + 1)[:n + 1]
    return np.cumsum(steps)[:n] > 0


def string_batches(column: pa.Array) -> pa.Array:
    """One array, whatever Spark hands over."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
