"""Filters, projections, joins, set operations and reshapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from larkspur.functions.scalar import seeded_hash


def round_floats(df: DataFrame, digits: int = 2) -> DataFrame:
    """Round every float column of the schema."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(c, digits) for c in floats})


def title_case_names(df: DataFrame) -> DataFrame:
    """``p_brand`` becomes ``P Brand``."""
    return df.toDF(*[c.replace("_", " ").title() for c in df.columns])


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(how="any", subset=list(columns) if columns else None)


def search_by_field(df: DataFrame, allowed: dict[str, str], field: str, value) -> DataFrame:
    """Rows whose ``field`` equals ``value``. ``allowed`` maps each searchable field to ``number`` or
    ``text``; numbers compare exactly, text ignores case. Unknown fields raise ``ValueError``."""
    if field not in allowed:
        raise ValueError(f"unknown field {field!r}; expected one of {sorted(allowed)}")
    if allowed[field] == "number":
        return df.where(F.col(field) == F.lit(int(value)))
    return df.where(F.lower(field) == F.lower(F.lit(str(value))))


def keyword_filter(df: DataFrame, text: str, lang: str, term: str, language: str = "en") -> DataFrame:
    return df.where((F.col(lang) == language) & F.contains(F.lower(text), F.lit(term.lower())))


def param_grid(spark: SparkSession, **lists: Sequence) -> DataFrame:
    """One row per combination of the given parameter lists."""
    grid = spark.range(1).select()
    for name, values in lists.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return grid


def all_pairs(
    competitors: DataFrame, name: str, attributes: Sequence[str], max_competitors: int = 2000,
) -> DataFrame:
    """Round robin: every unordered pair on every attribute, in both orders.

    The schedule itself has n(n-1) rows per attribute, so the number of competitors is checked. Each
    competitor lists the later positions it meets and finds their names by an equality join."""
    names = competitors.select(F.col(name).alias("competitor")).distinct()
    n = names.limit(max_competitors + 1).count()
    if n > max_competitors:
        raise ValueError(f"more than {max_competitors} competitors; a full round robin is not sensible")
    placed = names.withColumn("pos", F.row_number().over(Window.orderBy("competitor")))
    left = placed.where(F.col("pos") < n).select(
        F.col("competitor").alias("a"), F.explode(F.sequence(F.col("pos") + 1, F.lit(n))).alias("pos")
    )
    pairs = left.join(placed.withColumnRenamed("competitor", "b"), "pos")
    orders = F.array(
        F.struct(F.col("a").alias("competitor_1"), F.col("b").alias("competitor_2")),
        F.struct(F.col("b").alias("competitor_1"), F.col("a").alias("competitor_2")),
    )
    return pairs.select(
        F.explode(orders).alias("p"), F.array(*[F.lit(x) for x in attributes]).alias("all")
    ).select("p.competitor_1", "p.competitor_2", F.explode("all").alias("attribute"))


def not_done(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return work.join(done.select(key).distinct(), key, "left_anti")


def change_selected(df: DataFrame, selected: DataFrame, key: str, column: str, change: Column) -> DataFrame:
    """Apply ``change`` to ``column`` only on rows whose key is in ``selected``."""
    flags = selected.select(key).distinct().withColumn("_sel", F.lit(True))
    return (
        df.join(flags, key, "left")
        .withColumn(column, F.when(F.col("_sel").isNotNull(), change).otherwise(F.col(column)))
        .drop("_sel")
    )


def foreign_key_violations(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Missing parent keys with the number of child rows. Child rows are counted per key first, so a
    key that fills a third of the table is one row by the time it is joined."""
    keys = child.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("missing_key")).agg(F.count("*").alias("n_rows"))
    return keys.join(parent.select(F.col(parent_key).alias("missing_key")), "missing_key", "left_anti")


def redirect(df: DataFrame, url: str, redirects: DataFrame) -> DataFrame:
    """Replace ``url`` by its target in ``redirects(source, target)``; keep it when there is none."""
    return (
        df.join(redirects.select(F.col("source").alias(url), "target"), url, "left")
        .withColumn("final_url", F.coalesce("target", url))
        .drop("target")
    )


def distinct_on(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """One row per text, the one with the smallest id. Only hash and id are grouped; the kept rows
    come back by a semi join on the id."""
    keep = df.groupBy(F.sha2(text, 256)).agg(F.min(id_col).alias(id_col)).select(id_col)
    return df.join(keep, id_col, "left_semi")


def duplicate_report(df: DataFrame, text: str, id_col: str) -> DataFrame:
    return (
        df.groupBy(F.md5(text).alias("text_md5"))
        .agg(F.count("*").alias("copies"), F.min(id_col).alias("first_id"))
        .where(F.col("copies") > 1)
    )


def wide_to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def long_to_wide(df: DataFrame, index: str, columns: str, value: str, known: Sequence) -> DataFrame:
    """Pivot with one value per cell; two rows for one cell raise, and so does a value that is not among
    the ``known`` columns (the list saves the extra pass that would look for it)."""
    one = F.when(F.count("*") > 1, F.raise_error(F.lit("more than one row per cell"))).when(
        F.coalesce(F.first(columns).isin(list(known)), F.lit(False)), F.first(value)
    ).otherwise(F.raise_error(F.lit("a value is not among the known columns")))
    cells = df.groupBy(index, columns).agg(one.alias("_v"))
    return cells.groupBy(index).pivot(columns, list(known)).agg(F.first("_v"))


def top_n_with_ties(df: DataFrame, by: str, n: int) -> DataFrame:
    """Rows at least as large as the n-th largest value; ties at the edge are kept. The n-th value is
    a scalar subquery, so no single task ranks the table."""
    nth = df.select(by).where(F.col(by).isNotNull()).orderBy(F.desc(by)).limit(n).agg(F.min(by))
    return df.where(F.col(by) >= nth.scalar())


def sample_n(df: DataFrame, n: int, seed: str, *ids: str) -> DataFrame:
    """Exactly n rows in a reproducible random order: each task keeps its n smallest hashes."""
    return df.orderBy(seeded_hash(seed, *ids), *ids).limit(n)
