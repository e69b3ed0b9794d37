"""Each registered query of the engine against its SQL."""

import glob
import os

import duckdb
import pytest

from tidelog.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def cells(rows, columns):
    return sorted(tuple(str(list(r[c]) if hasattr(r[c], "__len__") and not isinstance(r[c], str) else r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert cells([r.asDict() for r in got.collect()], columns) == cells(rows, columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 10 and abs(rows[0].distance) < 1e-6
    assert set(e.oracle_sql()) <= set(e.queries())


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_point_lookup_reaches_the_scan(spark):
    from pyspark.sql import functions as F

    from tidelog.operators import merge

    log = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.lit(1).alias("kind"), F.col("props").alias("value"))
    assert "EqualTo(event_type,view)" in plan(merge.get(log, F.lit("view"), ("kind", "value")))


def test_top_k_is_a_bounded_heap(spark):
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["vec_nearest_cosine"](spark, SF).drop("none"))
    assert "CartesianProduct" not in plan(catalog.QUERIES["vec_knn_join"](spark, SF))


@pytest.mark.parametrize("name", ["vec_knn_join_all", "vec_knn_join_l2sq_all", "vec_ivf_nearest"])
def test_searches_ask_with_every_fiftieth_row(spark, name):
    asked = {r.qid for r in catalog.QUERIES[name](spark, SF).select("qid").distinct().collect()}
    assert asked == set(range(0, 500, 50))


@pytest.mark.parametrize("n", [0, 1, 60_000])
def test_positions_of_many_rows(spark, monkeypatch, n):
    """The wide rows' partitions are merged otherwise than those of the keys alone."""
    monkeypatch.setattr(catalog, "RANGE_ROWS", 1_000, raising=False)
    small = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        rows = spark.range(0, n, 1, 7).selectExpr("concat('k', id * 7919 % 60000) as key", "sha2(cast(id as string), 512) as value")
        got = catalog.positions(rows).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r.key for r in sorted(got, key=lambda r: r.pos)] == sorted(f"k{i * 7919 % 60000}" for i in range(n))
    assert sorted(r.pos for r in got) == list(range(1, n + 1))
