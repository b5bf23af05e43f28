"""Ranks, running sums, neighbours and quantiles that survive hot keys.

A window partitioned by a hot key puts that whole key in one task. Here every ordered group is first
cut into blocks; the window runs inside (key, block) and a small table with one row per (key, block)
carries the totals of the earlier blocks over. Keys are packed into a struct, so null keys are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from larkspur.functions.scalar import seeded_hash
from larkspur.session import saved


def _group(keys: Sequence[str]) -> Column:
    return F.struct(*keys) if keys else F.lit(1)


BLOCK = ["_k", "_g", "_b"]


def _in_blocks(df: DataFrame) -> DataFrame:
    """Add a hash of key and block as first sort column: Spark sorts by a long much faster than by the
    structs behind it, which only decide between equal hashes."""
    return df.withColumn("_k", F.xxhash64("_g", "_b"))


def order_key(order: Sequence[str]) -> Column:
    """What ``min_by`` and ``max_by`` compare: one plain column keeps the aggregation hash-based, a
    struct of several makes Spark sort each task's rows by group first. Prefer one unique column."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns so that filters on them do not compute them again. A filter is pushed below
    a projection together with copies of its expressions; it is not pushed below a generator."""
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def join_group_stats(
    rows: DataFrame, stats: DataFrame, keys: Sequence[str], n_rows: str, spread: Sequence[str],
    hot_fraction: int = 16384, slices: int = 16384,
) -> DataFrame:
    """Put per-group statistics on every row, with hot groups cut into slices.

    ``stats`` has one row per group, ``n_rows`` of it counts the group's rows. A group is hot when it
    holds more than 1/``hot_fraction`` of all rows; so there are fewer than ``hot_fraction`` hot
    groups, which bounds the broadcast that marks them. A hot group gets as many salts as it takes to
    make each slice about 1/``slices`` of all rows, so the copies of statistics stay below
    ``slices + hot_fraction`` rows. ``spread`` columns pick a row's salt.
    (Adaptive skew handling does not reach this case: an aggregate feeds the join directly.)"""
    total = stats.agg(F.sum(n_rows)).scalar()
    known = stats.withColumn("_g", _group(keys)).drop(*keys).withColumn("_total", total)
    salts = F.ceil(F.col(n_rows) * F.lit(slices) / F.col("_total")).cast("int")
    marked = known.withColumn(
        "_salts", F.when(F.col(n_rows) * hot_fraction > F.col("_total"), salts).otherwise(F.lit(1))
    ).drop("_total")
    hot = marked.where(F.col("_salts") > 1).select("_g", "_salts")
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts")), F.lit(0)).cast("int")
    left = (
        rows.withColumn("_g", _group(keys)).join(F.broadcast(hot), "_g", "left")
        .withColumn("_salt", salt).drop("_salts")
    )
    right = marked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    slice_hash = F.xxhash64("_g", "_salt")
    # the keys travel once, inside _g, and are taken out of it behind the join
    slim = left.withColumn("_k", slice_hash).drop(*keys)
    joined = slim.join(right.withColumn("_k", slice_hash), ["_k", "_g", "_salt"])
    own = [F.col("_g")[c].alias(c) if c in keys else F.col(c) for c in rows.columns]
    return joined.select(*own, *[c for c in stats.columns if c not in keys])


def semi_join(
    rows: DataFrame, wanted: DataFrame, key: str, spread: Sequence[str], max_broadcast_rows: int = 1_000_000, salts: int = 256,
) -> DataFrame:
    """Rows whose key is in ``wanted`` (one row per key). The size of ``wanted`` is counted: a small
    one is broadcast and ``rows`` are not shuffled; a larger one is copied to ``salts`` salts, so that
    the rows of a hot key spread over as many tasks."""
    if wanted.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        return rows.join(F.broadcast(wanted), key, "left_semi")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "_salt"], "left_semi").drop("_salt")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence, value: Column, out: str,
    block: Column, inclusive: bool = True, total: str | None = None,
) -> DataFrame:
    """Cumulative sum of ``value`` per key in ``order``, and on request the key's ``total``. ``block``
    must not decrease along ``order``; choose it so that one (key, block) fits a task."""
    rows = _in_blocks(df.withColumns({"_g": _group(keys), "_b": block, "_v": value}))
    totals = rows.groupBy(*BLOCK).agg(F.sum("_v").alias("_t"))
    by_key = Window.partitionBy("_g")
    earlier = by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_off")]
    if total:
        carried.append(F.sum("_t").over(by_key).alias(total))
    offsets = totals.select(*BLOCK, *carried)
    upto = Window.partitionBy(*BLOCK).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    return (
        rows.join(offsets, BLOCK)
        .withColumn(out, F.col("_off") + F.coalesce(F.sum("_v").over(upto), F.lit(0)))
        .drop(*BLOCK, "_v", "_off")
    )


def with_hot_block(df: DataFrame, keys: Sequence[str], block: Column, out: str, hot_fraction: int = 100_000) -> DataFrame:
    """Add ``block`` for hot keys only; other keys stay in one piece, which keeps block tables small. A
    key is hot above 1/``hot_fraction`` of all rows, so fewer than ``hot_fraction`` keys are broadcast."""
    sizes = df.groupBy(_group(keys).alias("_g")).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n")).scalar()
    hot = sizes.withColumn("_total", total).where(F.col("_n") * hot_fraction > F.col("_total"))
    marked = df.withColumn("_g", _group(keys)).join(
        F.broadcast(hot.select("_g", F.lit(True).alias("_hot"))), "_g", "left"
    )
    return marked.withColumn(out, F.struct(F.when(F.col("_hot"), block).alias("block"))).drop("_g", "_hot")


def next_values(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, outs: Sequence[str], block: Column,
    hot_fraction: int = 100_000,
) -> DataFrame:
    """The values 1, 2, ... rows later per key, one column of ``outs`` each, null past the end. Hot keys
    are cut by ``block``, which must not decrease along ``order``.

    The first rows of every block are kept in a block table; the last rows of the block before read
    them from there. Every block has a row, so as many blocks as columns are far enough."""
    k = len(outs)
    rows = _in_blocks(with_hot_block(df, keys, block, "_b", hot_fraction).withColumns(
        {"_g": _group(keys), "_v": F.struct(value.alias("v"))}
    ))
    inner = Window.partitionBy(*BLOCK).orderBy(*order)
    if k == 1:
        heads = rows.groupBy(*BLOCK).agg(F.array(F.min_by("_v", order_key(order))).alias("_h"))
    else:
        first = rows.withColumn("_i", F.row_number().over(inner)).where(F.col("_i") <= k)
        heads = first.groupBy(*BLOCK).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("_h")
        )
    after = Window.partitionBy("_g").orderBy("_b").rowsBetween(1, k)
    following = heads.select(*BLOCK, F.flatten(F.collect_list("_h").over(after)).alias("_n"))
    if k == 1:
        ahead = F.coalesce(F.lead("_v").over(inner), F.get("_n", F.lit(0)))
        return rows.join(following, BLOCK).withColumn(outs[0], ahead["v"]).drop(*BLOCK, "_v", "_n")
    whole = Window.partitionBy(*BLOCK)
    rest = F.count("*").over(whole) - F.row_number().over(inner)
    placed = rows.join(following, BLOCK).withColumn("_rest", rest.cast("int"))
    for i, out in enumerate(outs, start=1):
        ahead = F.when(F.col("_rest") >= i, F.lead("_v", i).over(inner)).otherwise(
            F.get("_n", F.lit(i - 1) - F.col("_rest"))
        )
        placed = placed.withColumn(out, ahead["v"])
    return placed.drop(*BLOCK, "_v", "_n", "_rest")


def range_block(df: DataFrame, column: str, blocks: int = 4096) -> Column:
    """Block number that never decreases with the column: equal parts of its range in ``df``, so that ids
    far apart do not get a block each."""
    ends = df.agg(F.struct(F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high")).alias("b")).scalar()
    share = (F.col(column).cast("double") - ends["low"]) / (ends["high"] - ends["low"] + 1.0)
    return F.least(F.floor(share * blocks), F.lit(blocks - 1))


def seeded_rank(
    df: DataFrame, id_col: str, seed: str, by: Sequence[str] = (), out: str = "rn", hex_digits: int = 4,
    total: str | None = None,
) -> DataFrame:
    """1-based position of each row in a reproducible shuffle, per class ``by``; on request also the
    class size as ``total``.

    Rows are shuffled by md5 of seed and id. The first hex digits are uniform, so they split even a
    single-class table into 16^hex_digits equal blocks."""
    keyed = df.withColumn("_h", seeded_hash(seed, id_col))
    return running_sum(
        keyed, by, ["_h", id_col], F.lit(1), out, F.substring("_h", 1, hex_digits), total=total
    ).drop("_h")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rn") -> DataFrame:
    """First k rows per key. Spark keeps k rows per key and task before the shuffle, so a hot key
    ships k rows per task and not all its rows. It does so up to k = 1000 (a setting); for more, take
    ``running_sum`` or ``seeded_rank`` where keys may be hot."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= k)


def first_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, spread: Sequence[str],
) -> DataFrame:
    """First value per key on every row: a combined aggregate joined back, no whole-key window."""
    heads = df.groupBy(*keys).agg(F.min_by(value, order_key(order)).alias(out), F.count("*").alias("_rows"))
    return join_group_stats(df, heads, keys, "_rows", spread).drop("_rows")


def value_block(x: Column, per_octave: int = 32) -> Column:
    """Block number that never decreases with x: ``per_octave`` blocks between any value and its
    double, the same for every group, so that no group's range must be looked up."""
    base = 1100 * per_octave
    size = F.lit(base) + F.floor(F.least(F.log2(F.abs(x)), F.lit(1100.0)) * per_octave)
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0)).cast("long")


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), per_octave: int = 32, parts: int = 4096, few: int = 65536,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per (by, prob). Nulls and NaN are left out.

    The values are never shuffled or sorted. The first pass counts them by blocks of their magnitude; each further one
    cuts those intervals that hold a wanted rank into ``parts`` equal parts, or into its values where it has ``few`` rows
    at most, and counts again, until every such interval holds one value only. Counts are combined before the shuffle, so a hot key or a narrow range is no burden. An
    interval's least and greatest value always part, and a pass leaves about 1/``parts`` of its width."""
    keys = list(by)
    x = F.col(value).cast("double") + F.lit(0.0)
    known = df.where(x.isNotNull() & ~F.isnan(x)).select(_group(keys).alias("_g"), x.alias("_x"))
    rows = known.withColumn("_b", value_block(F.col("_x"), per_octave))
    ends = [F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.count("*").alias("_n")]
    prob, at = F.explode(F.array(*[F.lit(float(p)) for p in probs])), F.col("prob") * (F.col("_all") - 1)

    group = Window.partitionBy("_g")
    before = F.sum("_n").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    first = rows.groupBy("_g", "_b").agg(*ends).withColumns({"_from": before, "_all": F.sum("_n").over(group)})
    wanted = F.explode(F.array_distinct(F.array(*[f(F.lit(float(p)) * (F.col("_all") - 1)) for p in probs for f in (F.floor, F.ceil)])))
    holds = "_from <= _rank AND _rank < _from + _n"
    columns = ["_g", "_b", "_all", "_rank", "_from", "_low", "_high", "_n"]
    spots = saved(first.withColumn("_rank", wanted).where(holds).select(*columns), "quantiles")
    while (most := (wide := spots.where("_low < _high")).agg(F.max("_n")).first()[0]) is not None:
        open_ = wide.select("_g", "_b", "_from", F.col("_low").alias("_l"), F.col("_high").alias("_h"), (F.col("_n") <= few).alias("_few")).distinct()
        part = F.least(F.floor((F.col("_x") - F.col("_l")) / (F.col("_h") - F.col("_l")) * parts), F.lit(parts - 1))
        part = F.when(F.col("_few"), F.col("_x")).otherwise(part)
        counts = rows.join(open_, ["_g", "_b"]).where("_l <= _x AND _x <= _h").groupBy("_g", "_b", "_l", "_from", part.alias("_p")).agg(*ends)
        upto = Window.partitionBy("_g", "_b", "_l").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        narrow = counts.withColumn("_from", F.col("_from") + F.sum("_n").over(upto) - F.col("_n"))
        ranks = wide.select("_g", "_b", "_all", "_rank", F.col("_low").alias("_l"))
        spots = spots.where("_low = _high").unionByName(narrow.join(ranks, ["_g", "_b", "_l"]).where(holds).select(*columns))
        if most <= few:  # this pass counts single values
            break
        spots = saved(spots, "quantiles")

    named = spots.select(*[F.col("_g")[k].alias(k) for k in keys], "_all", "_rank", "_low", prob.alias("prob"))
    below, above = F.col("_rank") == F.floor(at), F.col("_rank") == F.ceil(at)
    found = named.where(below | above).groupBy(*keys, "prob").agg(
        F.max(F.when(below, F.col("_low"))).alias("_a"), F.max(F.when(above, F.col("_low"))).alias("_z"), F.max(at - F.floor(at)).alias("_w"))
    between = F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_w")
    return found.select(*keys, "prob", F.when(F.col("_a") == F.col("_z"), F.col("_a")).otherwise(between).alias("quantile"))
