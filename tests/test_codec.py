import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronotier.functions import raw_bits
from chronotier.operators import codec
from chronotier.sources import generators

BASE = 1_700_000_000_000


def same(ts, values):
    ts, values = np.array(ts, dtype=np.int64), np.array(values, dtype=np.float64)
    data, wide = codec.encode(ts, values)
    t, v = codec.decode(data, len(ts), wide)
    assert (t == ts).all() and (v.view(np.uint64) == values.view(np.uint64)).all()
    return data, wide


def test_known_bits():
    assert codec.pack_bits(np.array([1, 0b101, 1, 0]), np.array([1, 3, 1, 5])) == bytes([0xD8, 0x00])


def test_fixtures():
    same([BASE + k for k in (0, 1000, 2000, 3000, 4000, 9000, 10000, 11000)], [45.0, 45.0, 45.1, 45.2, 45.2, 45.3, 12.5, 12.5])
    assert codec.encode(np.array([], np.int64), np.array([])) == (b"", False)
    assert len(same([42], [3.14159])[0]) == 16
    same([0, 1000, 50_000_000], [1.0, 2.0, 3.0])
    same([100, 90, 80], [-5.5, -5.5, 1000000.123456])
    same([0, 1, 66, 67, 323, 579, 2627], [0.0, -0.0, float("nan"), float("inf"), 1.0, 1.0, 5e-324])


def test_thirty_day_steps_come_back():
    data, wide = same([0, 2_592_000_000, 5_184_000_000], [1.0, 2.0, 3.0])
    assert wide


def test_time_costs():
    ts = np.array([1000, 2000, 3000, 4000, 5005])
    data, _ = codec.encode(ts, np.zeros(5))
    assert len(data) == -(-(64 + 64 + 16 + 1 + 1 + 9 + 4) // 8)


def test_truncated_stream_raises():
    data, _ = codec.encode(np.array([1, 2, 3]), np.array([1.0, 2.0, 3.0]))
    with pytest.raises(ValueError):
        codec.decode(data[:-2], 3)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**52), 2**52), st.floats(width=64)), max_size=40))
def test_round_trip(points):
    points.sort(key=lambda p: p[0])
    same([p[0] for p in points], [p[1] for p in points])


def test_size_model_is_the_real_size_and_the_published_one(spark):
    burst = generators.burst(spark, 100_000).selectExpr("series_id", "floor(seq / 20000) as block", "ts_ms", "value")
    by = ["series_id", "block"]
    model = {tuple(r[:2]): r["bytes"] for r in codec.stream_sizes(burst, by).collect()}
    real = {tuple(r[:2]): len(r["data"]) for r in codec.encode_points(burst, by).collect()}
    assert model == real
    rep = codec.compression_report(codec.stream_sizes(burst, by)).first()
    assert round(rep["bytes_per_point"], 2) == 3.74
    assert round(codec.compression_report(codec.stream_sizes(generators.drift(spark), ["series_id"])).first()["bytes_per_point"], 2) == 7.11
    empty = codec.compression_report(codec.stream_sizes(burst.limit(0), by)).first()
    assert empty["points"] == 0 and empty["bytes_per_point"] is None


def test_spark_round_trip_with_nulls(spark, rows):
    df = spark.createDataFrame([(1, 5, 1.5), (1, 5, 1.5), (1, 9, None), (1, None, 2.0), (None, 7, 2.5)], "series_id long, ts_ms long, value double")
    out = codec.decode_points(codec.encode_points(df, ["series_id"]), ["series_id"])
    assert [r[1:] for r in rows(out)] == [(5, 1.5), (5, 1.5), (7, 2.5)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(-(2**52), 2**52), st.floats(width=64)), min_size=1, max_size=12), min_size=1, max_size=6))
def test_streams_are_decoded_together(many):
    made = [codec.encode(np.array([p[0] for p in x]), np.array([p[1] for p in x])) for x in (sorted(x, key=lambda p: p[0]) for x in many)]
    n = np.array([len(x) for x in many])
    ts, values = codec.decode_many([d for d, _ in made], n, np.array([w for _, w in made]))
    one = [codec.decode(d, k, w) for (d, w), k in zip(made, n)]
    assert (ts == np.concatenate([t for t, _ in one])).all()
    assert (values.view(np.uint64) == np.concatenate([v for _, v in one]).view(np.uint64)).all()


def test_rollup_streams_come_back(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, 5, 1.0, 2.0, 1.5, 2.0), (1, 3_600_000, 0, None, None, None, None), (1, 7_200_000, 2**32 - 1, -0.0, inf, nan, None), (1, 7_200_000, 1, 0.1, 0.2, 0.3, 0.4),
            (2, -5_000_000_000_000, 7, 1.0, 1.0, 1.0, 1.0), (2, 9_000_000_000_000, 7, 1.0, 1.0, 1.0, 1.0), (None, 4, 1, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame([*rows, (3, None, 1, 1.0, 1.0, 1.0, 1.0), (3, 5, None, 1.0, 1.0, 1.0, 1.0)], "series_id long, bucket_start long, count long, min double, max double, avg double, p99 double")
    streams = codec.encode_rollups(df, ["series_id"])
    back = codec.decode_rollup_streams(streams, ["series_id"])
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, rows))
    sizes = {r["series_id"]: (r["buckets"], r["bytes"]) for r in codec.rollup_sizes(df.where("series_id = 1"), ["series_id"]).collect()}
    real = {r["series_id"]: (r["points"], len(r["data"])) for r in streams.where("series_id = 1").collect()}
    assert sizes == real
    with pytest.raises(ValueError):
        codec.encode_rollup(np.array([1]), np.array([2**32]), np.zeros((1, 4)), np.zeros((1, 4), bool))
    with pytest.raises(ValueError):
        codec.decode_rollups([b"short"], np.array([1]), np.array([False]))


def test_raw_bits(spark):
    values = [0.0, -0.0, 1.0, -1.0, 0.1, -123.456, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), float("nan"), None, 1023.9999999999999]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", raw_bits(F.col("v")).alias("bits"))
    for r in df.collect():
        want = None if r["v"] is None else int(np.array([r["v"]]).view(np.int64)[0])
        assert r["bits"] == want, r["v"]
