"""Data-quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def rule_violations(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule, one pass over the table. A rule is a condition good rows meet; a
    condition that is null counts as broken."""
    broken = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()]
    counts = df.agg(F.count("*").alias("n_rows"), *broken)
    return counts.unpivot(["n_rows"], list(rules), "rule", "violations").select(
        F.lit(table).alias("table_name"), "rule", "violations", "n_rows"
    )
