import pytest
from pyspark.sql import functions as F

from chronotier.operators import blocks, index, router
from chronotier.schemas import BLOCKS, POINTS, ROLLUP, SERIES

SER = [(1, "kind=flow,pump=p7,zone=north"), (2, "kind=flow,pump=p4,zone=north"), (3, "kind=heat,pump=p7,zone=south"), (4, "kind=flow,pump=p9,zone=north")]


@pytest.fixture(scope="module")
def post(spark):
    return index.postings(spark.createDataFrame(SER, SERIES))


def ids(df):
    return sorted(r["series_id"] for r in df.collect())


def test_find_and_intersect(post):
    assert ids(index.find(post, "pump=p7")) == [1, 3]
    assert ids(index.intersect(post, ["kind=flow"])) == [1, 2, 4]
    assert ids(index.intersect(post, ["kind=flow", "zone=north"])) == [1, 2, 4]
    assert ids(index.intersect(post, ["kind=flow", "zone=north", "pump=p7"])) == [1]
    for none in (["kind=flow", "zone=south"], ["pump=none"], []):
        assert ids(index.intersect(post, none)) == []


def test_prefix_is_a_bag(spark):
    p = index.postings(spark.createDataFrame([(i + 1, f"kind=flow,pump={h},zone=north") for i, h in enumerate(["p7", "p70", "p700", "p4"])], SERIES))
    assert ids(index.prefix(p, "pump=p7")) == [1, 2, 3]
    assert ids(index.prefix(p, "pump=none")) == []
    assert len(ids(index.prefix(p, ""))) == 12
    assert [r["series_id"] for r in index.prefix_ordered(p, "pump=p7").collect()] == [1, 2, 3]
    assert index.prefix_ordered(p, "").count() == 12


def test_sorted_postings_push_predicates(spark, tmp_path):
    p = index.postings(spark.createDataFrame(SER, SERIES))
    index.write_sorted(p, str(tmp_path / "post"), 2)
    plan = index.prefix(spark.read.parquet(str(tmp_path / "post")), "pump=")._jdf.queryExecution().toString()
    assert "StringStartsWith(label,pump=)" in plan


def test_ids_are_stable_and_dense(spark, rows):
    seen = spark.createDataFrame([("b", 5), ("a", 7), ("c", 1), ("b", 2), (None, 0)], "labels string, first_seen long")
    known = spark.createDataFrame([(9, "c")], SERIES)
    assert rows(index.assign_series(known, seen)) == [(10, "b"), (11, "a")]
    none = spark.createDataFrame([], SERIES)
    assert rows(index.assign_series(none, seen)) == [(1, "c"), (2, "b"), (3, "a")]
    assert rows(index.assign_series(none, seen.limit(0))) == []


# Two blocks of points, two of hourly and one of daily buckets; closed times.
BLOCK_ROWS = [(0, 11, 1, 9, 0, 7_000, 7_900, 0), (0, 12, 1, 9, 0, 8_100, 9_000, 0), (1, 13, 1, 4, 0, 2_000, 3_000, 0), (1, 14, 1, 4, 0, 4_000, 5_000, 0), (2, 15, 1, 2, 0, -500, 1_000, 0)]


@pytest.mark.parametrize(
    ("start", "end", "want"),
    [
        (7_950, 8_050, [(0, 2), (0, 2), (0, 1)]),  # between two blocks
        (7_900, 8_100, [(1, 1), (0, 2), (0, 1)]),  # the last time of one, up to the first of the next
        (7_901, 8_101, [(1, 1), (0, 2), (0, 1)]),
        (3_000, 7_000, [(0, 2), (2, 0), (0, 1)]),
        (-9_000, 9_001, [(2, 0), (2, 0), (1, 0)]),
        (9_001, 99_000, [(0, 2), (0, 2), (0, 1)]),
    ],
)
def test_route_counters(spark, start, end, want):
    out = {r["level"]: (r["scanned"], r["skipped"]) for r in router.route_stats(spark.createDataFrame(BLOCK_ROWS, BLOCKS), start, end).collect()}
    assert [out[n] for n in (0, 1, 2)] == want and out[3] == (0, 0)


def test_stitch_keeps_levels_apart(spark, post, rows):
    points = spark.createDataFrame([(1, 7_000, 1.0), (1, 8_200, 2.0), (2, 7_000, 9.0)], POINTS)
    l1 = spark.createDataFrame([(1, 2_000, 1, 3.0, 3.0, 3.0, 3.0), (1, 4_000, 1, 4.0, 4.0, 4.0, 4.0)], ROLLUP)
    l2 = spark.createDataFrame([(1, -500, 50, 2.0, 8.0, 5.0, 7.5)], ROLLUP)
    q = lambda m, s, e: [(r["level"], r["ts_ms"]) for r in router.in_order(router.stitch(points, {1: l1, 2: l2}, post, m, s, e)).collect()]
    mine = ["pump=p7", "kind=flow"]
    assert q(mine, 6_900, 7_001) == [(0, 7_000)]
    assert q(mine, 4_000, 8_201) == [(0, 7_000), (0, 8_200), (1, 4_000)]
    assert q(mine, -499, 8_200) == [(0, 7_000), (1, 2_000), (1, 4_000)]
    assert q(mine, -500, 8_200)[-1] == (2, -500)
    assert q(mine, 2_001, 4_000) == []  # the bucket that straddles the start is left out
    assert q([], 0, 99_999) == []
    res = router.stitch(points, {1: l1, 2: l2}, post, ["kind=flow"], 6_000, 8_000)
    matched = index.intersect(post, ["kind=flow"])
    assert rows(router.with_all_matched(res, matched)) == [(1, 1, 0, 0, 0), (2, 1, 0, 0, 0), (4, 0, 0, 0, 0)]
    nest = {r["series_id"]: r for r in router.nested(res, matched).collect()}
    assert nest[4]["raw"] == [] and nest[1]["raw"][0]["value"] == 1.0


def test_block_numbers_and_unknown_levels(spark, rows):
    m = spark.createDataFrame([(0, "00000007.blk"), (0, "./L0/00000007.blk"), (0, "7.blk "), (1, "12.blk"), (0, "junk"), (None, "3.blk")], "level int, filename string")
    assert rows(blocks.live_blocks(m)) == [(0, 7), (1, 12)]
    blocks.check_levels(m)
    with pytest.raises(ValueError, match="9"):
        blocks.check_levels(m.unionByName(spark.createDataFrame([(9, "1.blk")], m.schema)))


def test_block_numbers_in_any_case(spark, rows):
    m = spark.createDataFrame([(0, "00000028.BLK"), (0, "28.blk"), (0, "./L0/0030.Blk "), (2, "00000196.BLK"), (0, "31.BLKX")], "level int, filename string")
    assert rows(blocks.live_blocks(m)) == [(0, 28), (0, 30), (2, 196)]


def test_eligibility_uses_file_age(spark):
    b = spark.createDataFrame([(0, 1, 1, 1, 0, 0, 0, 1000), (0, 2, 1, 1, 0, 0, 0, 5000), (0, 3, 1, 1, 0, 0, 0, 99_000)], BLOCKS)
    assert sorted(r["block_id"] for r in blocks.eligible(b, 0, 6000, 2).collect()) == [1]
    assert blocks.eligible(b, 0, 6000, 0).count() == 3  # an age is never negative


def test_summarise_leaves_out_rows_without_block(spark):
    p = spark.createDataFrame([(1, 5, 1.0, 1), (2, 9, 1.0, 1), (1, 7, 1.0, None)], "series_id long, ts_ms long, value double, block_id long")
    assert [tuple(r) for r in blocks.summarise(p, ["block_id"]).collect()] == [(1, 2, 2, 5, 9)]
    assert blocks.summarise(p.where(F.lit(False)), ["block_id"]).count() == 0
