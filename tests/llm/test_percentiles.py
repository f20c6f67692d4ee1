import math
import random

import pytest
from pyspark.sql import functions as F

from chronotier.llm import percentiles as pct

V = "g string, day long, value double"


def nearest(values, p):
    s = sorted(values)
    return s[min(max(math.ceil(round(p * len(s), 6)), 1), len(s)) - 1]


def sample(rnd):
    rows = []
    for g, make in (("a", lambda: rnd.gauss(0, 1)), ("b", lambda: rnd.choice([1.0, 2.0, 2.5])), ("c", lambda: rnd.choice([-1, 1]) * 10 ** rnd.uniform(-300, 300)), (None, lambda: rnd.uniform(5, 6))):
        rows += [(g, rnd.randrange(5), make()) for _ in range(rnd.choice([1, 2, 99, 400]))]
    rows += [("a", 1, None), ("a", 1, float("nan")), ("a", 2, float("inf")), ("d", 1, None), ("e", 1, -0.0), ("e", 1, 0.0), ("f", 0, 1.7976931348623157e308), ("f", 0, -1.7976931348623157e308), ("f", 1, 5e-324)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_and_combined_against_sorting(spark, seed):
    rows = sample(random.Random(seed))
    df = spark.createDataFrame(rows, V)
    ps = (0.01, 0.5, 0.9, 0.99, 1.0)
    groups = {}
    for g, _, v in rows:
        if v is not None and math.isfinite(v):
            groups.setdefault(g, []).append(v)
    out = {(r["g"], r["p"]): r for r in pct.percentiles(pct.weighted(df, ["g"]), ["g"], ps).collect()}
    assert set(out) == {(g, p) for g in groups for p in ps}
    for (g, p), r in out.items():
        assert r["value"] == r["low"] == r["high"] == nearest(groups[g], p) and r["n"] == len(groups[g])
    days = pct.summarise(df, ["g"], ["day"])
    merged = {(r["g"], r["p"]): r for r in pct.from_summary(pct.combine(days, ["g"]), ["g"], ps).collect()}
    assert set(merged) == set(out)
    for k, r in merged.items():
        v = out[k]["value"]
        assert r["low"] <= v <= r["high"] and r["high"] - r["low"] <= max(abs(v) / 256, 1e-305)


def test_summaries_of_parts_add_up(spark):
    df = spark.createDataFrame(sample(random.Random(3)), V)
    whole = {tuple(r) for r in pct.combine(pct.summarise(df, ["g"], ["day"]), ["g"]).collect()}
    a, b = df.where("day < 2"), df.where("day >= 2")
    parts = pct.summarise(a, ["g"], ["day"]).unionByName(pct.summarise(b, ["g"], ["day"]))
    assert {tuple(r) for r in pct.combine(parts, ["g"]).collect()} == whole


def test_tolerance_bounds_the_error(spark):
    rnd = random.Random(9)
    vals = [rnd.uniform(1, 2) for _ in range(3000)]
    df = spark.createDataFrame([("a", 0, v) for v in vals], V)
    r = pct.percentiles(pct.weighted(df, ["g"]), ["g"], (0.5,), tolerance_bits=44).first()
    assert r["low"] <= nearest(vals, 0.5) <= r["high"] and r["high"] - r["low"] <= 2.0**-8


def test_nothing_and_bad_arguments(spark):
    df = spark.createDataFrame([], V)
    assert pct.percentiles(pct.weighted(df, ["g"]), ["g"]).count() == 0
    assert pct.from_summary(pct.combine(pct.summarise(df, ["g"], ["day"]), ["g"]), ["g"]).count() == 0
    with pytest.raises(ValueError):
        pct.percentiles(pct.weighted(df, ["g"]), ["g"], (0.0,))


def test_clashing_names(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "key string, value double")
    names = {}
    for name in ("key", "v", "w", "cell", "lo", "rank", "part", "s", "c"):
        d = df.withColumnRenamed("key", name)
        names[name] = sorted(tuple(r) for r in pct.percentiles(pct.weighted(d, [name]), [name], (0.5,)).select(name, "n", "value").collect())
        assert pct.from_summary(pct.summarise(d, [name], []), [name], (0.5,)).count() == 2
    assert set(map(tuple, names.values())) == {(("a", 2, 1.0), ("b", 1, 3.0))}
    with pytest.raises(ValueError):
        pct.percentiles(pct.weighted(df.withColumnRenamed("key", "n"), ["n"]), ["n"])


def test_one_reading_a_record(spark):
    rows = [(1, 10, 5.0, 1, 1), (1, 10, 5.0, 1, 2), (1, 11, 6.0, 2, 1), (1, 11, 6.0, 3, 1), (1, 12, 7.0, None, 1), (1, 12, 7.0, None, 2), (1, 13, float("nan"), 4, 1)]
    df = spark.createDataFrame(rows, "series_id long, ts_ms long, value double, seq long, block_id long")
    assert sorted(r["value"] for r in pct.readings(df).collect()) == [5.0, 6.0, 6.0, 7.0]


def test_a_pass_shuffles_counts_only(spark):
    # 20,000 rows of one group: what reaches a single task is the parts of its intervals.
    df = spark.range(20_000).select(F.lit("a").alias("g"), (F.col("id") % 5000).cast("double").alias("value"))
    r = {x["p"]: x["value"] for x in pct.percentiles(pct.weighted(df, ["g"]), ["g"], (0.5, 0.99)).collect()}
    assert r == {0.5: 2499.0, 0.99: 4949.0}
