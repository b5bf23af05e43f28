"""Blocked windows, quantiles and salted joins against brute force in pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur.operators import ordering as O


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows on one key, some on a null key, several blocks per key."""
    rng = np.random.default_rng(3)
    n = 900
    key = np.where(rng.random(n) < 0.35, "hot", rng.choice(["a", "b", "c", "d"], n)).astype(object)
    key[::50] = None
    pdf = pd.DataFrame({"k": key, "t": rng.permutation(n), "v": np.round(rng.normal(size=n), 3)})
    return pdf, spark.createDataFrame(pdf, "k STRING, t LONG, v DOUBLE").cache()


def by_key(pdf):
    return pdf.sort_values("t").groupby("k", dropna=False)


@pytest.mark.parametrize("block_size", [1, 7, 10_000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_sum(hot, block_size, inclusive):
    pdf, df = hot
    out = O.running_sum(df, ["k"], ["t"], F.lit(2), "s", F.floor(F.col("t") / block_size), inclusive, total="all")
    got = out.toPandas().sort_values("t")
    rank = by_key(pdf).cumcount()
    want = (rank + (1 if inclusive else 0)) * 2
    assert got["s"].tolist() == want.loc[pdf.sort_values("t").index].tolist()
    sizes = by_key(pdf)["t"].transform("size") * 2
    assert got["all"].tolist() == sizes.loc[pdf.sort_values("t").index].tolist()


@pytest.mark.parametrize("block_size", [1, 7, 10_000])
@pytest.mark.parametrize("steps", [1, 3])
@pytest.mark.parametrize("hot_fraction", [1, 4, 100_000])
def test_next_values(hot, block_size, steps, hot_fraction):
    pdf, df = hot
    outs = [f"n{i}" for i in range(1, steps + 1)]
    got = O.next_values(df, ["k"], ["t"], F.col("v"), outs, F.floor(F.col("t") / block_size), hot_fraction).toPandas().sort_values("t")
    ordered = pdf.sort_values("t")
    for i, out in enumerate(outs, start=1):
        want = by_key(pdf)["v"].shift(-i).loc[ordered.index]
        np.testing.assert_array_equal(got[out].to_numpy(dtype=float), want.to_numpy())


def test_next_value_keeps_null_values(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (1, 3, 7.0)], "k INT, t INT, v DOUBLE")
    got = O.next_values(df, ["k"], ["t"], F.col("v"), ["n"], F.lit(0)).orderBy("t").collect()
    assert [r["n"] for r in got] == [None, 7.0, None]


@pytest.mark.parametrize("digits", [1, 4])
def test_seeded_rank_is_a_permutation_per_class(hot, digits):
    _, df = hot
    out = O.seeded_rank(df, "t", "s", ["k"], hex_digits=digits, total="n").toPandas()
    for _, group in out.groupby("k", dropna=False):
        assert sorted(group["rn"]) == list(range(1, len(group) + 1))
        assert set(group["n"]) == {len(group)}


def test_seeded_rank_without_classes_and_with_another_seed(hot):
    _, df = hot
    a = O.seeded_rank(df, "t", "s").toPandas().sort_values("t")["rn"].tolist()
    b = O.seeded_rank(df, "t", "other").toPandas().sort_values("t")["rn"].tolist()
    assert sorted(a) == sorted(b) == list(range(1, 901)) and a != b


def test_exact_quantiles(hot, spark):
    pdf, df = hot
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = O.exact_quantiles(df, "v", probs, ["k"], per_octave=8).toPandas()
    for key, group in pdf.groupby("k", dropna=False):
        mine = got[got["k"].isna()] if key is None or key is np.nan or pd.isna(key) else got[got["k"] == key]
        np.testing.assert_allclose(mine.sort_values("prob")["quantile"], np.quantile(group["v"], probs), rtol=1e-12, atol=1e-12)
    with_nulls = spark.createDataFrame([(None,), (float("nan"),), (3.0,), (0.0,), (-1.0,)], "v DOUBLE")
    assert O.exact_quantiles(with_nulls, "v", [0.5]).first()["quantile"] == 0.0
    same = O.exact_quantiles(df, "v", probs, ["k"], parts=5, few=0).toPandas()  # equal parts all the way
    columns = ["k", "prob"]
    pd.testing.assert_frame_equal(got.sort_values(columns, ignore_index=True), same.sort_values(columns, ignore_index=True))
    assert O.exact_quantiles(with_nulls.limit(1), "v", [0.5]).count() == 0


def test_quantiles_of_values_close_together_and_far_apart(spark):
    probs = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]
    df = spark.range(200_000).select((F.lit(1.7e9) + F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / (1 << 32)).alias("v"))
    got = [r["quantile"] for r in O.exact_quantiles(df, "v", probs, parts=64, few=100).orderBy("prob").collect()]
    np.testing.assert_array_equal(got, np.quantile(df.toPandas()["v"], probs))
    wide = np.concatenate([[5e-324, -1e308, 1e308, -0.0, 0.0, np.inf], np.repeat(7.25, 50), np.linspace(-1e-9, 1e9, 77)])
    df = spark.createDataFrame([(float(x),) for x in wide], "v DOUBLE")
    got = [r["quantile"] for r in O.exact_quantiles(df, "v", probs, parts=4, few=3).orderBy("prob").collect()]
    assert got[-1] == np.inf  # numpy's interpolation gives nan here
    np.testing.assert_allclose(got[:-1], np.quantile(wide, probs[:-1]), rtol=1e-12)


def test_value_block_never_decreases(spark):
    rng = np.random.default_rng(1)
    values = np.sort(np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), [0.0, 5e-324, -5e-324]]))
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(values)], "x DOUBLE, i INT")
    blocks = [r["b"] for r in df.select("i", O.value_block(F.col("x")).alias("b")).orderBy("i").collect()]
    assert blocks == sorted(blocks)


@pytest.mark.parametrize("hot_fraction", [2, 4, 1000])
def test_join_group_stats(hot, hot_fraction):
    pdf, df = hot
    stats = df.groupBy("k").agg(F.max("v").alias("top"), F.count("*").alias("n"))
    got = O.join_group_stats(df, stats, ["k"], "n", ["t"], hot_fraction, slices=8).toPandas().sort_values("t")
    assert len(got) == len(pdf)
    want = by_key(pdf)["v"].transform("max").loc[pdf.sort_values("t").index]
    np.testing.assert_array_equal(got["top"].to_numpy(), want.to_numpy())


@pytest.mark.parametrize("limit", [0, 1000])
def test_semi_join_small_and_large(hot, limit):
    pdf, df = hot
    wanted = df.sparkSession.createDataFrame([("hot",), ("b",), ("zz",)], "k STRING")
    got = O.semi_join(df, wanted, "k", ["t"], max_broadcast_rows=limit)
    assert got.count() == pdf["k"].isin(["hot", "b"]).sum()


def test_top_k(hot):
    pdf, df = hot
    got = O.top_k(df, ["k"], [F.desc("v"), F.col("t")], 2)
    assert got.count() == 2 * pdf["k"].nunique(dropna=False)
    assert O.top_k(df, ["k"], [F.col("t")], 5000).count() == len(pdf)  # any number of rows may be asked for


def test_first_value(hot):
    pdf, df = hot
    got = O.first_value(df, ["k"], ["t"], "v", "f", ["t"]).toPandas().sort_values("t")
    want = by_key(pdf)["v"].transform("first").loc[pdf.sort_values("t").index]
    np.testing.assert_array_equal(got["f"].to_numpy(), want.to_numpy())
