"""Tokens of texts by a given byte-pair vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType

#: A published vocabulary as ranks; any file of that form will do. The driver reads it, tasks get its bytes.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Texts of a batch that are Python strings at a time.
AT_A_TIME = 64
# Fixed value: how that vocabulary cuts texts before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def texts(batch: pa.Array) -> Iterator[str | None]:
    """The texts of a batch, of which only a few are Python strings at a time."""
    for at in range(0, len(batch), AT_A_TIME):
        yield from batch.slice(at, AT_A_TIME).to_pylist()


def token_count(spark: SparkSession, text: str, path: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """Number of tokens of a text; null for a null. Names of special tokens in a text are plain text."""
    with open(path, "rb") as file:
        sent = spark.sparkContext.broadcast(file.read())
    held: list = []

    @F.arrow_udf(LongType())
    def count(batch: pa.Array) -> pa.Array:
        if not held:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
            held.append(tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
        return pa.array([None if x is None else len(held[0].encode_ordinary(x)) for x in texts(batch)], pa.int64())

    return count(F.col(text))


def ratio_by_group(df: DataFrame, group: str, base: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """Per group: texts, tokens, tokens a character, and that relative to the group ``base``. Null texts are left out."""
    counted = df.where(F.col(text).isNotNull()).select(group, F.length(text).alias("chars"), token_count(df.sparkSession, text, path).alias("tokens"))
    sums = counted.groupBy(group).agg(F.count("*").alias("texts"), F.sum("tokens").alias("tokens"), F.sum("chars").alias("chars"))
    rate = sums.select("*", F.try_divide("tokens", "chars").alias("rate"))
    of_base = rate.agg(F.max(F.when(F.col(group) == base, F.col("rate")))).scalar()
    return rate.select(group, "texts", "tokens", F.col("rate").alias("tokens_per_char"), F.try_divide("rate", of_base).alias("ratio"))
