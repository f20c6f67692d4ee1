import math
import random

import pytest
from pyspark.sql import functions as F

from chronotier.functions import bucket_start, canonical_labels, day_number, label_map, ordered_key, raw_bits
from chronotier.operators import rollup
from chronotier.schemas import POINTS, ROLLUP

BASE = 1_700_000_000_000


def test_downsample_fixture(spark, rows):
    pts = [(1, BASE + 200 * i, float(i + 1)) for i in range(5)] + [(1, BASE + 1000 + 100 * i, 10.0 * (i + 1)) for i in range(7)]
    pts += [(2, BASE + 9 * i, float(i + 1)) for i in range(100)]
    out = rollup.downsample(spark.createDataFrame(pts, POINTS), 1000)
    assert rows(out) == [(1, BASE, 5, 1, 5, 3, 5), (1, BASE + 1000, 7, 10, 70, 40, 70), (2, BASE, 100, 1, 100, 50.5, 99)]


def test_downsample_nulls_nan_negative_times(spark, rows):
    pts = [(1, -1, 1.0), (1, -1000, 2.0), (1, None, 5.0), (1, 5, None), (2, 5, float("nan")), (2, 6, 1.0), (None, 7, 3.0)]
    out = {r[:2]: r[2:] for r in rows(rollup.downsample(spark.createDataFrame(pts, POINTS), 1000))}
    assert out[(1, -1000)] == (2, 1.0, 2.0, 1.5, 2.0)
    assert (1, 0) not in out  # nulls only
    assert out[(None, 0)] == (1, 3.0, 3.0, 3.0, 3.0)
    n, lo, hi, _, p99 = out[(2, 0)]
    assert (n, lo) == (2, 1.0) and math.isnan(hi) and math.isnan(p99)


def test_downsample_empty_and_bad_width(spark):
    empty = spark.createDataFrame([], POINTS)
    assert rollup.downsample(empty, 10).count() == 0
    for width in (0, -5):
        with pytest.raises(ValueError):
            rollup.downsample(empty, width)


def test_merge_fixture(spark, rows):
    src = [(1, 0, 10, 1.0, 10.0, 5.5, 10.0), (1, 500, 20, 2.0, 8.0, 5.0, 8.0), (2, 2000, 5, 100.0, 200.0, 150.0, 195.0)]
    out = rows(rollup.merge_rollups(spark.createDataFrame(src, ROLLUP), 1000))
    assert out[0] == (1, 0, 30, 1.0, 10.0, 155 / 30, 260 / 30)
    assert out[1] == (2, 2000, 5, 100.0, 200.0, 150.0, 195.0)


def test_merge_skips_empty_buckets_and_null_statistics(spark, rows):
    src = [(1, 0, 0, None, None, None, None), (1, 10, 4, 1.0, 2.0, None, 2.0), (1, 20, 4, 0.0, 3.0, 1.0, 3.0), (1, None, 4, 0.0, 3.0, 1.0, 3.0)]
    assert rows(rollup.merge_rollups(spark.createDataFrame(src, ROLLUP), 1000)) == [(1, 0, 8, 0.0, 3.0, 1.0, 2.5)]


def test_p99_drift(spark):
    pts = [(1, BASE + 100 * i, 1000.0 if i in (2, 52) else 10.0) for i in range(100)]
    fine = rollup.downsample(spark.createDataFrame(pts, POINTS), 500)
    assert fine.count() == 20
    coarse = rollup.merge_rollups(fine, 10_000).first()
    assert coarse["avg"] == pytest.approx(29.8) and coarse["p99"] == pytest.approx(109.0)
    d = rollup.p99_divergence(spark.createDataFrame(pts, POINTS), 500, 10_000).first()
    assert d["true_p99"] == 1000.0 and d["divergence"] == pytest.approx(0.891)


def test_nearest_rank_for_every_n(spark):
    df = spark.range(1, 301).select(F.explode(F.sequence(F.lit(1), F.col("id"))).alias("v"), (F.col("id")).alias("series_id"))
    out = rollup.downsample(df.select("series_id", F.lit(0).cast("long").alias("ts_ms"), F.col("v").cast("double").alias("value")), 10)
    for r in out.collect():
        assert r["p99"] == min(max(math.ceil(round(0.99 * r["count"], 9)), 1), r["count"])


def test_last_write_wins(spark, rows):
    df = spark.createDataFrame([(1, 1, 5.0, 1), (1, 1, 6.0, 3), (1, 1, 7.0, 2), (1, 2, 1.0, None)], "series_id long, ts_ms long, value double, seq long")
    assert rows(rollup.last_write_wins(df, ["series_id", "ts_ms"], F.col("seq"))) == [(1, 1, 6.0), (1, 2, None)]


def test_labels(spark):
    df = spark.createDataFrame([({"b": "2", "a": "1"},), ({},), (None,)], "m map<string,string>")
    assert [r[0] for r in df.select(canonical_labels(F.col("m"))).collect()] == ["a=1,b=2", "", None]
    df = spark.createDataFrame([("a=1,b=x=y,,c",), (None,)], "l string")
    got = df.select(label_map(F.col("l"))).collect()
    assert got[0][0]["b"] == "x=y" and got[1][0] == {}


def test_bucket_floor_and_day(spark):
    df = spark.createDataFrame([(-1,), (0,), (86_399_999,), (-86_400_001,)], "t long")
    out = [tuple(r) for r in df.select(bucket_start(F.col("t"), 1000), day_number(F.col("t"))).collect()]
    assert out == [(-1000, -1), (0, 0), (86_399_000, 0), (-86_401_000, -2)]


def test_ordered_key_is_ieee_order(spark):
    import struct

    rnd = random.Random(4)
    vals = [0.0, -0.0, 1.0, -1.0, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, 4.0, 3.9999999999999996]
    vals += [struct.unpack("<d", struct.pack("<Q", rnd.getrandbits(64)))[0] for _ in range(2000)]
    vals = [v for v in vals if math.isfinite(v)]
    got = spark.createDataFrame([(v,) for v in vals], "v double").select("v", raw_bits(F.col("v")).alias("b")).select("v", ordered_key(F.col("b")).alias("k")).collect()
    for v, k in got:
        bits = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
        assert k == (bits if v > 0 else -bits)
