import os

import pytest

from chronotier.llm import queries

DATA = os.environ.get("CHRONOTIER_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_percentiles_are_those_of_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("points", "series", "rollup_buckets"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.Q["p1_percentiles"](spark, DATA)
    want = con.execute(queries.SQL["p1_percentiles"])
    assert df.columns == [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want.fetchall()))


def test_every_document_once(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    for name in ("p6_ids", "p8_scores"):
        assert sorted(r["doc_id"] for r in queries.Q[name](spark, DATA).select("doc_id").collect()) == ids
    assert {r["doc_id"] for r in queries.Q["p7_containers"](spark, DATA).select("doc_id").collect()} == set(ids)
