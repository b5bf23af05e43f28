"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import DATA, connect, difference

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect("0.001")


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    frame = QUERIES[key](spark, f"{DATA}/sf0.001")
    if key in SQL:
        problem = difference(frame, con, SQL[key])
        assert problem is None, problem
    else:
        assert frame.count() > 0


def test_flagship_in_sql_gives_the_same_rows(spark):
    folder = f"{DATA}/sf0.001"
    for name in ("lineitem", "orders", "customer", "nation"):
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
    by_sql = spark.sql("""
        WITH late AS (
            SELECT o_custkey, greatest(datediff(l_shipdate, o_orderdate), 0) AS delay
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey
            WHERE o_orderdate >= TIMESTAMP_NTZ '1997-01-01' AND o_orderdate < TIMESTAMP_NTZ '1997-02-01' AND l_shipdate IS NOT NULL)
        SELECT n_name, count(*) AS n, round(avg(delay), 4) AS mean_delay
        FROM late LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
        GROUP BY n_name ORDER BY mean_delay DESC, n_name""")
    assert by_sql.collect() == QUERIES["group_count_mean"](spark, folder).collect()


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
