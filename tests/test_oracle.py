"""Queries of the core beside their SQL in DuckDB, on the smallest tables."""

import math
import os

import pytest

from chronotier.plans import core_queries, data_queries

DATA = os.environ.get("CHRONOTIER_TESTDATA", "/root/testdata/sf0.001")
TABLES = ("lineitem", "orders", "events", "points", "series", "metric_specs", "rollup_buckets", "blocks", "manifest", "documents", "items")
SQL = core_queries.SQL | data_queries.SQL
Q = core_queries.Q | data_queries.Q

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(v):
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else repr(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = Q[name](spark, DATA)
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(names, want.fetchall())


def test_a_block_is_live_in_any_spelling(spark, duck):
    """The last number of a name identifies the file, whatever stands around it."""
    live = r"SELECT DISTINCT level, CAST(regexp_extract(filename, '(\d+)\D*$', 1) AS BIGINT) AS block_id FROM manifest WHERE regexp_matches(filename, '\d')"
    assert sorted(map(tuple, Q["manifest_live"](spark, DATA).collect())) == sorted(duck.execute(live).fetchall())
    held = duck.execute(f"""SELECT count(*) FROM (SELECT DISTINCT series_id, ts_ms, value FROM points
      WHERE block_id IN (SELECT block_id FROM ({live}) WHERE level = 0))""").fetchone()[0]
    assert Q["p2_consolidated"](spark, DATA).count() == held


@pytest.mark.parametrize("name", ["raw_range", "stitched_query", "label_intersect", "p5_found", "rollup_points_hour", "l0_block_scan", "manifest_orphans"])
def test_no_nested_loops(spark, name):
    plan = Q[name](spark, DATA)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_predicates_and_columns_reach_the_scan(spark):
    plan = Q["raw_range"](spark, DATA)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    scan = next(p for p in plan.split("\n\n") if "Scan parquet" in p and "points" in p)
    assert "GreaterThanOrEqual(ts_ms," in scan and "LessThan(ts_ms," in scan
    assert "ReadSchema: struct<series_id:bigint,ts_ms:bigint,value:double>" in scan


def test_rollups_aggregate_before_the_shuffle(spark):
    plan = Q["rollup_points_hour"](spark, DATA)._jdf.queryExecution().toString()
    assert "partial_percentile" in plan or "partial_percentiledisc" in plan.lower()
