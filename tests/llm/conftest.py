import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, two texts under one id, clashing extra columns."""
    long = " ".join(f"word{i % 997} stone{i % 13}" for i in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 1),
        (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 1),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, " \n\t \n ", "de", "b", 5),
        (5, long, "en", "b", len(long)),
        (6, "un", "fr", "b", 2),
        (7, "!!! 123 ???", None, "c", 11),
        (None, "rows without an id are rows too and they are kept like all the others here", "en", "c", 70),
        (None, None, None, None, None),
        (8, "two texts under one id, this is the first of them and it has some words", "en", "a", 70),
        (8, "two texts under one id, this is the second of them and it has other words", "en", "a", 70),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for i, name in enumerate(["found_", "rule_", "k", "k1", "K2", "copy", "n_lines", "item_id", "row number"]):
        frame = frame.selectExpr("*", f"{i} AS `{name}`")
    return frame


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, None), (8, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def odd_benchmark(spark):
    rows = [(1, "quick brown fox jumps over"), (1, "quick brown fox jumps over"), (2, None), (None, "river bank"), (3, ""), (4, "?!"), (10, "un")]
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "0 AS doc_id")
