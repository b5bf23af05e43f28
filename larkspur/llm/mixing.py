"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's mean repetition rate is its target share of the output over its share of the input. Every document's count of
copies is a Poisson variate with that mean, got by inverting the distribution at a uniform number hashed from seed and
doc_id, so it needs no state, repeats exactly, and treats each document alike on any cluster. Documents are exploded
by their counts and dealt to random places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.session import work_path

SEED = "mix-1"
#: Without given weights a source's weight is its row count to this power: below 1 small sources are repeated.
POWER = 0.5
#: Larger means are drawn as sums of Poisson variates with a mean of at most this, as exp(-mean) would vanish.
PART = 256
#: With more sources than this the rates are joined by a shuffle in place of a broadcast. A source's distribution has
#: fewer than 500 steps of 8 bytes, so 40 MB at most are sent.
BROADCAST_SOURCES = 10_000


def hashed_bits(*parts) -> Column:
    """52 bits of the md5 of the parts."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """A number strictly between 0 and 1 from a hash."""
    return (hashed_bits(*parts).cast("double") + 0.5) / F.lit(float(1 << 52))


def cumulative(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as far as 52 bits of a uniform number can tell."""
    steps = F.sequence(F.lit(1), F.ceil(rate + 10 * F.sqrt(rate) + 30).cast("int"))
    start = F.exp(-rate)
    return F.aggregate(
        steps, F.struct(start.alias("p"), F.array(start).alias("sums")),
        lambda s, k: F.struct((s["p"] * rate / k).alias("p"), F.concat(s["sums"], F.array(F.element_at(s["sums"], -1) + s["p"] * rate / k)).alias("sums")),
        lambda s: s["sums"])


def repetition_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = POWER, size: float = 1.0) -> DataFrame:
    """One row per source: source, rate, parts, sums. ``size`` is the expected output rows for each input row.

    ``weights`` may have any positive scale; a source that is missing there has weight 0, and so gets no rows.
    """
    counts = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(power)))
    else:
        weight = F.lit(0.0)
        for source, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(value))).otherwise(weight)
    counts = counts.withColumn("weight", weight)
    all_n, all_weight = counts.agg(F.sum("n"), F.sum("weight")).first()
    rate = F.lit(float(size) * all_n) * F.col("weight") / F.lit(float(all_weight)) / F.col("n") if all_weight else F.lit(0.0)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    return counts.select("source", rate.alias("rate")).withColumn("parts", parts).withColumn("sums", cumulative(F.col("rate") / F.col("parts")))


def copies(seed: str, parts: Column, sums: Column, digest: Column) -> Column:
    """The Poisson count of a row with doc_id and the digest of its text."""
    numbers = F.transform(F.sequence(F.lit(1), parts), lambda i: uniform(seed, i, F.col("doc_id"), digest))
    each = F.transform(numbers, lambda u: F.size(F.filter(sums, lambda c: c < u)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = POWER, size: float = 1.0, seed: str = SEED) -> DataFrame:
    """The documents repeated by their counts in random order, with two more columns: copy (from 1) and shuffle_key.

    A document with count 0 has no row. A null source is a source. Count and shuffle_key follow from seed, doc_id and text, so
    texts under one id, or under none, have counts of their own; only rows that repeat both get equal counts, and these are
    dealt to places by their numbers in the table, so that no task gets all of them. Texts may be null. Extra columns stay; those
    called copy or shuffle_key are replaced. An empty table stays empty.
    """
    spark = docs.sparkSession
    path = work_path(spark, "rates")
    repetition_rates(docs, weights, power, size).write.parquet(path)
    rates = spark.read.parquet(path)
    few = rates.count() <= BROADCAST_SOURCES
    taken = {c.lower() for c in docs.columns}
    names = [next(x for x in (stem + "_" * i for i in range(1, 99)) if x not in taken) for stem in ("s", "r", "d", "tie")]
    held = rates.select(F.col("source").alias(names[0]), F.struct("parts", "sums").alias(names[1]))
    rows = docs.join(F.broadcast(held) if few else held, docs["source"].cast("string").eqNullSafe(F.col(names[0])), "left")
    has_text = any(c.lower() == "text" for c in docs.columns)
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))) if has_text else F.lit(None).cast("string")
    n = copies(seed, F.col(names[1])["parts"], F.col(names[1])["sums"], F.col(names[2]))
    columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    told = rows.withColumn(names[2], digest).select(*columns, names[1], names[2])
    counted = told.select(*columns, names[2], n.alias(names[0])).where(F.col(names[0]) > 0)
    exploded = counted.select(*columns, names[2], F.explode(F.sequence(F.lit(1), F.col(names[0]))).alias("copy"))
    keyed = exploded.select(*columns, "copy", hashed_bits(seed + "-order", F.col("doc_id"), F.col("copy"), F.col(names[2])).alias("shuffle_key"), F.monotonically_increasing_id().alias(names[3]))
    return keyed.repartition("shuffle_key", names[3]).sortWithinPartitions("shuffle_key").drop(names[3])
