"""Grouped statistics, profiles, correlation, regression and price-series measures."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from larkspur.operators.ordering import exact_quantiles, next_values, order_key

TRADING_DAYS = 252


def week_start(ts: str | Column) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", ts)


def weekly_sum(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Sum per key and Monday-based week; a week with nulls only gives 0."""
    return df.groupBy(*keys, week_start(ts).alias("week")).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))


def growth(value: str, *order: str) -> Column:
    """Last over first known value, minus one, as an aggregate; null when the first is zero."""
    at = F.when(F.col(value).isNotNull(), order_key(order))
    return F.try_divide(F.max_by(value, at), F.min_by(value, at)) - 1


def with_log_return(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, block: Column, out: str = "log_return",
) -> DataFrame:
    """ln(p_t / p_t+1) per series; null on the last row and where a value is not positive."""
    ahead = next_values(df, keys, order, F.col(value), ["_next"], block)
    return ahead.withColumn(out, F.ln(F.try_divide(value, "_next"))).drop("_next")


def volatility(log_return: str = "log_return", periods: int = TRADING_DAYS) -> Column:
    """Population standard deviation of the log returns, scaled to a year, as an aggregate."""
    return F.stddev_pop(log_return) * F.sqrt(F.lit(float(periods)))


def ohlc(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, block: Column) -> DataFrame:
    """Per series: first and last known value, high, low, number of values, growth, volatility."""
    at = F.when(F.col(value).isNotNull(), order_key(order))
    return (
        with_log_return(df, keys, order, value, block)
        .groupBy(*keys)
        .agg(
            F.count(value).alias("trading_days"),
            F.min_by(value, at).alias("first"),
            F.max_by(value, at).alias("last"),
            F.max(value).alias("high"),
            F.min(value).alias("low"),
            growth(value, *order).alias("growth"),
            volatility().alias("volatility"),
        )
    )


def describe(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row per column: count, null count, mean, std, min, exact quantiles, max."""
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = wide.unpivot([], list(columns), "column", "value")
    basics = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.count_if(F.col("value").isNull()).alias("null_count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    names = {p: f"q{round(p * 100)}" for p in probs}
    quantiles = exact_quantiles(long, "value", probs, ["column"]).groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in names.items()]
    )
    return basics.join(quantiles, "column", "left")


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and null share per column, from one pass over the table."""
    columns = list(columns or df.columns)
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot(["_n"], columns, "column", "null_count").select(
        "column", "null_count", F.try_divide("null_count", "_n").alias("null_share")
    )


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Strict lower triangle of the Pearson matrix over complete rows, one row per pair."""
    pairs = list(combinations(columns, 2))
    one_row = df.select(*columns).na.drop().agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [
        F.struct(F.lit(b).alias("row"), F.lit(a).alias("column"), F.col(f"c{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)
    ]
    return one_row.select(F.inline(F.array(*cells)))


def simple_regression(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )


def student_p(t: Column, degrees: Column, steps: int = 4000) -> Column:
    """Two-sided p-value of a Student t statistic. With t = sqrt(degrees) * tan(a) the density of a is cos(a) to the
    power degrees - 1; Simpson's rule gives the share of its area beyond the statistic. Values above 40 count as 40
    where there are over 600 degrees of freedom."""
    top = F.least(F.lit(math.pi / 2), 40 / F.sqrt(degrees))
    start = F.least(F.atan(F.abs(t) / F.sqrt(degrees)), top)

    def area(low: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            weight = F.when((i == 0) | (i == steps), 1).when(i % 2 == 1, 4).otherwise(2)
            return total + weight * F.exp((degrees - 1) * F.ln(F.cos(low + (top - low) * i / steps)))

        return (top - low) * F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), add)

    return F.try_divide(area(start), area(F.lit(0.0)))


def student_limit(confidence: float, degrees: float) -> float:
    """The t within which ``confidence`` of the distribution lies, by the same substitution."""
    angle = np.linspace(0, min(math.pi / 2, 40 / math.sqrt(degrees)), 200_001)
    density = np.cos(angle) ** (degrees - 1)
    inside = np.append(0, np.cumsum(density[1:] + density[:-1]))
    return math.sqrt(degrees) * math.tan(np.interp(confidence, inside / inside[-1], angle))


def ols(df: DataFrame, y: str, predictors: Sequence[str], confidence: float = 0.95) -> DataFrame:
    """Least squares of y on the predictors (booleans count as 0/1): one row per term with
    coefficient, standard error, t, p, confidence limits, and n and R2 of the fit. The fit is one
    distributed pass; only the k x k summary reaches the driver."""
    numeric = df.select(*[F.col(c).cast("double").alias(c) for c in [y, *predictors]]).na.drop()
    data = VectorAssembler(inputCols=list(predictors), outputCol="_features").transform(numeric)
    fit = LinearRegression(featuresCol="_features", labelCol=y, solver="normal").fit(data)
    s = fit.summary
    n = int(s.numInstances)
    half = student_limit(confidence, s.degreesOfFreedom)
    terms = [*predictors, "intercept"]
    coefs = [*[float(c) for c in fit.coefficients], float(fit.intercept)]
    rows = [
        (term, c, float(se), float(tv), float(p), c - half * se, c + half * se, n, float(s.r2))
        for term, c, se, tv, p in zip(terms, coefs, s.coefficientStandardErrors, s.tValues, s.pValues)
    ]
    return df.sparkSession.createDataFrame(
        rows, "term STRING, coef DOUBLE, se DOUBLE, t DOUBLE, p DOUBLE, low DOUBLE, high DOUBLE, n LONG, r2 DOUBLE"
    )


def t_test(df: DataFrame, value: str, is_first_group: Column) -> DataFrame:
    """Two-sample t statistic with pooled variance, one row: sizes, means, t, degrees of freedom, two-sided p."""
    def side(flag: Column) -> Column:
        return F.when(flag, F.col(value))

    a, b = side(is_first_group), side(~is_first_group)
    s = df.agg(
        F.count(a).alias("n1"), F.avg(a).alias("mean1"), F.var_samp(a).alias("v1"),
        F.count(b).alias("n2"), F.avg(b).alias("mean2"), F.var_samp(b).alias("v2"),
    )
    dof = F.col("n1") + F.col("n2") - 2
    pooled = F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), dof)
    spread = F.sqrt(pooled * (F.try_divide(F.lit(1), "n1") + F.try_divide(F.lit(1), "n2")))
    t = F.try_divide(F.col("mean1") - F.col("mean2"), spread)
    return s.select("n1", "n2", "mean1", "mean2", t.alias("t"), dof.alias("df")).withColumn("p", student_p(F.col("t"), F.col("df")))


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Five-number summary per group, exact."""
    names = {0.0: "min", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "max"}
    return exact_quantiles(df, value, list(names), by).groupBy(*by).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in names.items()]
    )


def hist_2d(df: DataFrame, x: str, y: str, bins: int = 100) -> DataFrame:
    """Counts per cell of an equal-width grid over both ranges; the top edge belongs to the last bin."""
    rows = df.select(x, y).na.drop()
    bounds = rows.agg(F.struct(
        F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")
    ).alias("b")).scalar()

    def bin_of(c: str, lo: str, hi: str) -> Column:
        share = (F.col(c) - bounds[lo]) / F.nullif(bounds[hi] - bounds[lo], F.lit(0.0))
        return F.coalesce(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(0)).cast("int")

    return rows.groupBy(bin_of(x, "x0", "x1").alias("x_bin"), bin_of(y, "y0", "y1").alias("y_bin")).agg(
        F.count("*").alias("n")
    )


def distribution_shift(part: DataFrame, whole: DataFrame, column: str) -> DataFrame:
    """Share of each category (null is one) in ``part`` and in ``whole``, and the difference."""
    def side(df: DataFrame, in_part: int) -> DataFrame:
        return df.select(F.col(column).alias("category"), F.lit(in_part).alias("p"), F.lit(1 - in_part).alias("w"))

    def share(counted: str, df: DataFrame) -> Column:
        return F.coalesce(F.try_divide(F.sum(counted), df.agg(F.count("*")).scalar()), F.lit(0.0))

    both = side(part, 1).unionAll(side(whole, 0)).groupBy("category").agg(
        share("p", part).alias("part_share"), share("w", whole).alias("whole_share")
    )
    return both.withColumn("shift", F.col("part_share") - F.col("whole_share"))


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and two order-free sums of 60 bits of the row hashes: equal tables give equal
    fingerprints. Values go into a row's hash with their length before them, so that columns keep apart."""
    values = [F.col(c).cast("string") for c in columns]
    text = F.concat(*[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("null;")) for v in values])
    halves = [F.sum(F.conv(F.substring("_h", at, 15), 16, 10).cast("decimal(38,0)")).cast("string") for at in (1, 16)]
    return df.select(F.md5(text).alias("_h")).agg(F.count("*").alias("n_rows"), F.concat(halves[0], F.lit("-"), halves[1]).alias("fingerprint"))
