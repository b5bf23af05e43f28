"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built from a bounded sample of its labelled text. A text is parsed with each
automaton into phrases, always the longest match that the sample holds; the language that needs the fewest phrases,
normalised by the size of its sample (phrases * log2(sample bytes) / text bytes), wins. Many texts are parsed in
step with each other, one table lookup a byte and language. Long texts are parsed in pieces of ``PIECE`` bytes, all of them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from larkspur.llm.arrays import CHUNK, Texts, chunks, string_batches

#: Bounds of the learning sample: excerpts per language, and bytes of each excerpt.
EXCERPTS = 64
EXCERPT_BYTES = 384
#: Bytes of all samples together; with many languages each gets fewer excerpts. Bounds the table at about 150 MB.
SAMPLE_BYTES = 400_000
PIECE = 1024
UNKNOWN = "und"
ENDED = 1 << 29


class SuffixAutomaton:
    """All substrings of a sequence of small numbers: ``next[state]`` maps a number to a state; 0 is the start."""

    def __init__(self, sequence: np.ndarray):
        self.next: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for symbol in sequence.tolist():
            new = len(link)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and symbol not in self.next[at]:
                self.next[at][symbol] = new
                at = link[at]
            if at >= 0:
                old = self.next[at][symbol]
                if length[old] == length[at] + 1:
                    link[new] = old
                else:
                    copy = len(link)
                    self.next.append(dict(self.next[old]))
                    length.append(length[at] + 1)
                    link.append(link[old])
                    while at >= 0 and self.next[at].get(symbol) == old:
                        self.next[at][symbol] = copy
                        at = link[at]
                    link[old] = link[new] = copy
            last = new


class Parser:
    """Automata of all languages in one table, with a column for each byte class.

    An entry holds the row to go to, plus ENDED for each phrase that ends here. Where no match goes on, the phrase ends
    and a new one begins with this byte; a byte that the sample does not have is a phrase of its own.
    Byte classes: 0 for all ASCII that is no letter, one for each other byte value of the samples, one for the rest.
    """

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        self.classes = np.zeros(256, np.uint8)
        used = sorted({b for s in samples.values() for b in s if b >= 0x80 or chr(b).isalpha()})
        self.classes[0x61:0x7B] = len(used) + 1
        self.classes[0x80:] = len(used) + 1
        self.classes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 2
        built = [SuffixAutomaton(self.classes[np.frombuffer(samples[l], np.uint8)]).next for l in self.languages]
        self.roots = np.zeros(len(built), np.int32)
        parts, base = [], 0
        for i, states in enumerate(built):
            row = np.full(width, base * width + 2 * ENDED, np.int64)
            for symbol, to in states[0].items():
                row[symbol] = (base + to) * width + ENDED
            table = np.tile(row, (len(states), 1))
            table[0] -= ENDED  # no phrase is open at the start
            for at, out in enumerate(states):
                for symbol, to in out.items():
                    table[at, symbol] = (base + to) * width
            self.roots[i] = base * width
            parts.append(table.astype(np.int32).ravel())
            base += len(states)
        if base * width >= ENDED:
            raise ValueError("the samples of all languages together are too large for one table")
        self.table = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.weight = np.array([np.log2(max(2, len(samples[l]))) for l in self.languages])

    def phrases(self, part: Texts) -> np.ndarray:
        """Phrases of each text with each language: [text, language]."""
        codes = self.classes[part.data]
        sizes = np.diff(part.starts)
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(part.n), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = part.starts[owner] + number * PIECE
        size = np.minimum(PIECE, part.starts[owner + 1] - begin)
        order = np.argsort(-size, kind="stable")
        owner, begin, size = owner[order], begin[order], size[order]
        state = np.tile(self.roots, (len(owner), 1))
        count = np.zeros((len(owner), len(self.languages)), np.int32)
        active = np.searchsorted(-size, -np.arange(1, PIECE + 1), "right")
        for t in range(int(size[0]) if len(size) else 0):
            n = active[t]
            got = self.table[state[:n] + codes[begin[:n] + t][:, None]]
            count[:n] += got >> 29
            state[:n] = got & np.int32(ENDED - 1)
        count += state != self.roots  # the last phrase of each piece
        out = np.zeros((part.n, len(self.languages)))
        if len(owner):
            back = np.argsort(owner, kind="stable")
            heads = np.flatnonzero(pieces)
            out[heads] = np.add.reduceat(count[back], (np.cumsum(pieces) - pieces)[heads], axis=0)
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text. The score is how much fewer normalised phrases the winner needs than the
        second, as a share of the second's; 1 with a single language, 0 without one. Ties go to the first in order."""
        lower = pc.utf8_lower(texts)
        letters = pc.fill_null(pc.match_substring_regex(lower, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        names, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if not self.languages:
            return names.tolist(), score
        for part in chunks(lower, 4 * CHUNK):
            cost = self.phrases(part) * self.weight
            rows = np.flatnonzero(letters[part.first:part.first + part.n])
            cost = cost[rows]
            if not len(rows):
                continue
            best = cost.argmin(1)
            names[part.first + rows] = np.array(self.languages, object)[best]
            if len(self.languages) == 1:
                score[part.first + rows] = 1.0
            else:
                two = np.partition(cost, 1, axis=1)[:, :2]
                score[part.first + rows] = 1 - two[:, 0] / two[:, 1]
        return names.tolist(), score


def held_out(doc_id) -> F.Column:
    """Documents kept from learning: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, excerpts: int = EXCERPTS, excerpt_bytes: int = EXCERPT_BYTES) -> dict[str, bytes]:
    """Bounded sample of lower-cased labelled text of each language: one excerpt from each of about ``excerpts`` documents.

    Documents are picked by a hash of their id at a rate that follows from the language's count; an excerpt begins at a
    place picked by hash, anywhere in the text.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return {}
    excerpts = max(1, min(excerpts, SAMPLE_BYTES // (excerpt_bytes * len(counts))))
    rate = F.create_map(*[x for r in counts for x in (F.lit(r.lang), F.lit(min(1.0, 2.0 * excerpts / r.n)))])
    draw = F.pmod(F.xxhash64(F.lit("pick"), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    start = F.pmod(F.xxhash64(F.lit("at"), "doc_id"), F.greatest(F.lit(1), F.length("text") - excerpt_bytes)) + 1
    rows = known.where(draw < rate[F.col("lang")]).select(
        "lang", F.lower(F.substring("text", start.cast("int"), F.lit(excerpt_bytes))).alias("excerpt"), draw.alias("draw"), F.col("doc_id").cast("string").alias("id"))
    samples: dict[str, list[bytes]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r.lang, r.draw, r.id, r.excerpt)):
        part = samples.setdefault(r.lang, [])
        if len(part) < excerpts and any(c.isalpha() for c in r.excerpt):
            part.append(r.excerpt.encode("utf-8")[:2 * excerpt_bytes])
    return {lang: b" ".join(part) for lang, part in samples.items() if part}


def identify(docs: DataFrame, samples: dict[str, bytes], text: str = "text", column: str = "language") -> DataFrame:
    """Add a struct (lang_pred, score) from the whole text. A null or a text without a letter is ``und`` with score 0."""
    held: list[Parser] = []
    packed = {lang: zlib.compress(sample) for lang, sample in samples.items()}

    @F.arrow_udf("lang_pred string, score double")
    def look(batch: pa.Array) -> pa.Array:
        if not held:
            held.append(Parser({lang: zlib.decompress(sample) for lang, sample in packed.items()}))
        names, score = held[0].predict(string_batches(batch).cast(pa.large_string()))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score)], ["lang_pred", "score"])

    return docs.withColumn(column, look(F.col(text).cast("string")))


def language_id(docs: DataFrame, excerpts: int = EXCERPTS, excerpt_bytes: int = EXCERPT_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from documents that are not held out and have a language; neither lang nor source nor doc_id is an input of a
    prediction. Repeated rows get repeated results; without labelled rows all is ``und``; extra columns are not read.
    """
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    samples = learn(slim, excerpts, excerpt_bytes)
    return identify(slim, samples).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.*")
