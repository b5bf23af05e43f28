"""URL filters: rules on host and path first, then word segmentation with naive Bayes.

Names run together in a host are split into words by Viterbi over a unigram model; a multinomial naive Bayes model
scores the words of host and path. Word counts come from the titles of all pages and the seed words below; the naive
Bayes model is trained on the labelled seed texts. All counts stay in a written table: urls are put into blocks, a block
sends the distinct parts of its runs of letters and gets back the counts of those that are words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from larkspur.llm.arrays import string_batches
from larkspur.session import saved

# Words of both kinds of hosts; they say nothing about either.
COMMON = "example test sample demo en de fr es it nl pt index html htm page pages www m blog mobile static"
# Labelled seed words of the naive Bayes model, each once, by the topics that block and allow lists usually have; they
# are in the unigram model too.
SEEDS = {
    "block": (
        "casino win poker bet bets betting slots jackpot roulette lottery bingo gamble gambling odds wager spins blackjack baccarat sweepstakes",
        "adult sex porn xxx nude cams escort hot hookup erotic webcam fetish milf naked sexy dating singles affair",
        "cheap pills viagra cialis drugs meds tablets diet steroids weight loss miracle cure detox slim botox replica fake",
        "spam farm link clickbait clicks traffic backlinks bulk doorway cloaking autoblog scraper giveaway prize winner claim",
        "ads ad track tracker tracking pixel popup popunder adserver click affiliate banner redirect retarget syndication",
        "crack keygen warez torrent serial nulled hack cheat pirated leaked phishing malware exploit botnet ransom",
        "payday loan cash fast rich earn forex crypto pump investment scheme pyramid doubler profit guaranteed",
    ),
    "allow": (
        "news blog article post story daily times press journal magazine weekly report review interview column",
        "wiki docs documentation manual guide tutorial reference help faq support learn course lesson lecture",
        "school college university library science research paper study museum archive history book encyclopedia",
        "shop store product catalog garden home kitchen food recipe travel city map weather sport music film art",
        "forum community group team project data code open source software tech engineering developer",
        "about contact category tag author welcome privacy terms team careers events calendar gallery",
        "health care doctor clinic family bank finance law office company service public local council government",
    ),
}
#: Pseudo-count of every word in either class.
SMOOTHING = 0.1
#: Log odds of block before a word is seen; most hosts are no spam.
PRIOR = -1.0
#: A word that no model knows costs as much as this many factors of ten for each of its characters.
UNKNOWN_CHAR = 1.6
#: Longer runs of letters are split in pieces of this length, which bounds the time.
PIECE = 256
#: Bytes of all parts of the runs of a block's urls; a longer url is a block of its own. A task holds one block at a time.
BLOCK = 64 << 20
#: Bytes that a part of a run takes beside its letters, and a url beside its own.
PART, ROW = 60, 400
#: Pseudo-count of a seed word in the unigram model, per thousand counted words.
SEED_SHARE = 2.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://`` or for a null."""
    rest = F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def parse_rule(line: str) -> tuple[str, str, str, str]:
    """('allow example.com/en/') -> verdict, rule, host, path."""
    verdict, rule = line.split()
    if verdict not in SEEDS or "/" not in rule:
        raise ValueError(f"not a rule: {line}")
    host, slash, path = rule.partition("/")
    return verdict, rule, host.lower(), slash + path


def rule_of(host: Column, path: Column, rules: list[str]) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, else null; of equally long ones the first in the list."""
    known = sorted((parse_rule(r) for r in rules), key=lambda r: -len(r[1]))
    out = None
    for verdict, rule, name, start in known:
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        hit = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


class Segmenter:
    """Viterbi over a unigram model; unknown words pay for each character."""

    def __init__(self, counts: dict[str, float], total: float | None = None):
        """``total`` is the sum of all counts, if ``counts`` are only those of words that can occur."""
        total = total or sum(counts.values()) or 1.0
        self.cost = {w: -math.log10(c / total) for w, c in counts.items() if w and c > 0}
        self.unknown = math.log10(total) + 1

    def split(self, name: str) -> list[str]:
        """Words of a run of letters. Of equal costs the split whose last word is longer wins."""
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            options = []
            for start in range(end):
                cost = self.cost.get(name[start:end])
                if cost is None:
                    cost = self.unknown + UNKNOWN_CHAR * (end - start)
                options.append((best[start] + cost, start))
            cost, start = min(options)
            best.append(cost)
            back.append(start)
        out = []
        at = len(name)
        while at:
            out.append(name[back[at]:at])
            at = back[at]
        return out[::-1]


class NaiveBayes:
    """Multinomial model with smoothed counts, learned from the seed words."""

    def __init__(self, texts: dict[str, tuple[str, ...]] = SEEDS):
        self.classes = sorted(texts)
        words = {c: " ".join([COMMON, *texts[c]]).split() for c in self.classes}
        known = sorted({w for c in self.classes for w in words[c]})
        self.number = {w: i for i, w in enumerate(known)}
        counts = np.full((len(self.classes), len(known)), SMOOTHING)
        for i, c in enumerate(self.classes):
            for w in words[c]:
                counts[i, self.number[w]] += 1
        self.log = np.log(counts / counts.sum(1, keepdims=True))

    def block_odds(self, tokens: list[str]) -> float:
        """Log odds of block against allow; words that the seeds do not have say nothing."""
        rows = [self.number[t] for t in tokens if t in self.number]
        allow, block = (self.log[self.classes.index(c), rows].sum() for c in ("allow", "block"))
        return float(PRIOR + block - allow)


#: Labels under which hosts are registered say nothing about their owner.
SUFFIX = re.compile(r"(?:\.(?:com|net|org|edu|gov|info|biz|io|co|[a-z]{2}))+$")


def runs_of(text: str) -> list[str]:
    """Runs of letters in pieces."""
    return [run[at:at + PIECE] for run in re.findall(r"[^\W\d_]+", text.lower()) for at in range(0, len(run), PIECE)]


def runs_of_url(host: str, path: str) -> list[str]:
    return runs_of(SUFFIX.sub("", host)) + runs_of(path)


class Judge:
    """``counts`` are those of the title words that can occur, ``total`` is the number of all title words."""

    def __init__(self, counts: dict[str, float], total: float, bayes: NaiveBayes):
        seeds = " ".join([COMMON, *(t for texts in SEEDS.values() for t in texts)]).split()
        share = SEED_SHARE * max(1000.0, total) / 1000
        merged = dict(counts)
        for word in seeds:
            merged[word] = merged.get(word, 0.0) + share
        self.segmenter, self.bayes = Segmenter(merged, total + share * len(seeds)), bayes
        self.seen: dict[str, list[str]] = {}

    def judge(self, host: str, path: str) -> tuple[list[str], float]:
        tokens: list[str] = []
        for run in runs_of_url(host, path):
            if run not in self.seen:
                self.seen[run] = self.segmenter.split(run)
            tokens += self.seen[run]
        return tokens, self.bayes.block_odds(tokens)


def title_words(pages: DataFrame) -> DataFrame:
    """word, n: the counts of all words in the titles of all pages."""
    title = F.regexp_extract(F.col("html").cast("string"), "(?is)<title[^>]*>(.*?)</title", 1)
    plain = F.regexp_replace(F.lower(title), "&[#a-z0-9]+;?|<[^>]*>", " ")
    words = pages.select(F.explode(F.regexp_extract_all(plain, F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return saved(words.groupBy("word").agg(F.count("*").alias("n")), "title-words")


def into_blocks(urls: DataFrame, longest: int, limit: int) -> DataFrame:
    """``urls`` (host, path and others) with a block number, written to the shared folder so that the numbers are fixed."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            blocks = []
            for host, path in zip(*(string_batches(batch.column(c)).to_pylist() for c in ("host", "path"))):
                own = ROW + len(host) + len(path) + sum(len(run) * (k := min(len(run), longest)) * (PART + k / 2) for run in runs_of_url(host, path))
                if size and size + own > limit:
                    block, size = block + 1, 0
                size += own
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64())], [*batch.schema.names, "block"])

    schema = urls.withColumn("block", F.lit(0).cast("long")).schema
    return saved(urls.mapInArrow(number, schema), "url-blocks")


def sent_parts(blocks: DataFrame, longest: int) -> DataFrame:
    """block, word: the distinct parts, as long as a title word at most, of the runs of each block."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, seen = None, set(), set()

        def parts() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at] * len(held), pa.int64()), pa.array(list(held), pa.string())], ["block", "word"])

        for batch in batches:
            for host, path, block in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "block"))):
                if held and (block != at or len(held) > 500_000):
                    yield parts()
                    held = set()
                if block != at:
                    at, seen = block, set()
                for run in runs_of_url(host, path):
                    if run not in seen:
                        seen.add(run)
                        held.update(run[a:b] for a in range(len(run)) for b in range(a + 1, min(len(run), a + longest) + 1))
                        if len(held) > 1_000_000:
                            yield parts()
                            held = set()
        if held:
            yield parts()

    return blocks.select("host", "path", "block").mapInArrow(send, "block long, word string")


def url_verdicts(pages: DataFrame, rules: list[str], block: int = BLOCK) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, words (of host and path), block_odds.

    The rule's verdict holds where a rule fits, else block where the odds are above 0. Null urls and urls without ``://``
    have an empty host and path, no words, and are allowed. Repeated rows get repeated results. The html may be null. An empty
    table gives no rows; extra columns are not read. Runs of letters of more than 256 are split in pieces of that length.
    """
    counts = title_words(pages)
    total, longest = counts.agg(F.sum("n"), F.max(F.length("word"))).first()
    total, longest, bayes = float(total or 0), min(longest or 0, PIECE), NaiveBayes()
    host, path = host_and_path(F.col("url").cast("string"))
    ruled = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    ruled = ruled.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"))
    blocks = into_blocks(ruled, longest, block)
    # a block that is read in two tasks sends some parts twice
    known = sent_parts(blocks, longest).join(counts, "word").select("block", "word", "n")

    def look(urls: pa.Table, found: pa.Table) -> pa.Table:
        judge = Judge(dict(zip(found["word"].to_pylist(), map(float, found["n"].to_pylist()))), total, bayes)
        rows = [judge.judge(h, p) for h, p in zip(urls["host"].to_pylist(), urls["path"].to_pylist())]
        words, odds = pa.array([w for w, _ in rows], pa.list_(pa.string())), pa.array([o for _, o in rows], pa.float64())
        return urls.drop_columns(["block"]).append_column("words", words).append_column("block_odds", odds)

    schema = blocks.drop("block").selectExpr("*", "CAST(NULL AS array<string>) AS words", "CAST(NULL AS double) AS block_odds").schema
    judged = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(look, schema)
    verdict = F.coalesce("verdict", F.when(F.col("block_odds") > 0, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "words", "block_odds")
