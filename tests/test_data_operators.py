"""Consolidation, trailing totals, regular grids and implausible readings against brute force on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotier.operators import anomalies, consolidation, regrid, trailing

DAY = 86_400_000
PTS = "series_id long, ts_ms long, value double, seq long, block_id long, received_at timestamp"
SERIES = "series_id long, labels string, metric string, step_ms long"
BUCKETS = "series_id long, level int, bucket_start long, count long, min double, max double, avg double, p99 double, block_id long"
NAN = float("nan")


def pts(spark, rows):
    return spark.createDataFrame([(*r, None) if len(r) == 5 else r for r in rows], PTS)


# ---- consolidation


def brute_pairs(rows, live):
    held = {}
    key = lambda v: "nan" if v is not None and math.isnan(v) else v
    for s, t, v, _, b in rows:
        if b in live:
            held.setdefault(b, set()).add((s, t, key(v)))
    return sorted((a, b) for a in held for b in held if a < b and (held[a] <= held[b] or held[b] <= held[a]))


def manifest(spark, ids):
    return spark.createDataFrame([(0, f"{i:08d}.blk") for i in ids] + [(0, f"./L0/{ids[0]}.BLK "), (0, "00009999.BLK"), (1, "00000077.blk"), (0, None), (None, "00000078.blk"), (1, "junk")], "level int, filename string")


def test_consolidation_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 2, None]), rnd.randrange(6), rnd.choice([1.0, 2.0, None, NAN, 0.0, -0.0]), i, rnd.choice([1, 2, 3, 4, 5, 6, 7, None, 77])) for i in range(260)]
    rows += [(1, 1, 1.0, 900, 8), (1, 1, 1.0, 901, 9), (1, 1, 1.0, 902, 9), (7, 1, 1.0, 903, 10), (7, 1, 1.0, 904, 11), (7, 2, 1.0, 905, 11)]
    live = list(range(1, 12))
    done = consolidation.consolidate(pts(spark, rows), manifest(spark, live), rows_per_file=7)
    got = sorted((r[0], r[1]) for r in consolidation.contained_blocks(done).collect())
    assert got == brute_pairs(rows, set(live)) and (8, 9) in got and (10, 11) in got
    key = lambda v: "nan" if v is not None and math.isnan(v) else v
    want = {(s, t, key(v)) for s, t, v, _, b in rows if b in live}
    kept = [(r["series_id"], r["ts_ms"], key(r["value"])) for r in done.points.collect()]
    assert len(kept) == len(set(kept)) == len(want) and set(kept) == want
    files = done.files.collect()
    assert sum(f["rows"] for f in files) == len(kept)
    assert done.points.select("file").distinct().count() == len(files)
    assert max(f["rows"] for f in files) <= 2 * 7


def test_one_file_a_bin_and_verification(spark, tmp_path, monkeypatch):
    rows = [(1, i, float(i), i, i % 50) for i in range(1000)]
    m = manifest(spark, list(range(50)))
    done = consolidation.consolidate(pts(spark, rows), m, rows_per_file=200)
    sizes = [f["rows"] for f in done.files.collect()]
    assert sizes == [200] * 5
    per_file = done.points.withColumn("f", F.input_file_name()).groupBy("f").agg(F.countDistinct("file").alias("n")).collect()
    assert len(per_file) == 5 and all(r["n"] == 1 for r in per_file)
    with pytest.raises(FileNotFoundError):
        consolidation.committed(spark, str(tmp_path / "none"))
    kept = consolidation.consolidate(pts(spark, rows), m, rows_per_file=200, path=str(tmp_path / "kept"))
    assert consolidation.committed(spark, str(tmp_path / "kept"))[0].count() == 1000 == kept.points.count()
    assert [r[0] for r in kept.absent.collect()] == [9999] and kept.unreadable == 2
    monkeypatch.setattr(consolidation, "_content", lambda df, by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.floor(F.rand() * 1e9).cast("long").alias("checksum")))
    with pytest.raises(consolidation.VerificationError):
        consolidation.consolidate(pts(spark, rows), m, rows_per_file=200)


def test_copies_are_pairs_of_their_class(spark):
    rnd = random.Random(11)
    rows = [(1, t, 1.0, t, b) for b in range(1, 13) for t in range(4)]  # twelve copies
    rows += [(1, t, 1.0, 100 + t, b) for b in (20, 21) for t in range(6)]  # two larger blocks that hold them
    rows += [(1, 3, 1.0, 200, 30), (2, 9, None, 201, 31), (2, 9, None, 202, 32), (2, 9, NAN, 203, 33)]
    rows += [(3, rnd.randrange(4), 0.0, 300 + i, rnd.randrange(40, 60)) for i in range(80)]
    live = sorted({r[4] for r in rows})
    done = consolidation.consolidate(pts(spark, rows), manifest(spark, live))
    got = sorted(tuple(r) for r in consolidation.contained_blocks(done).collect())
    assert got == brute_pairs(rows, set(live))
    classes, pairs = consolidation.containment(done)
    rep = {r["block"]: r["rep"] for r in classes.collect()}
    assert [rep[b] for b in (1, 12, 20, 21, 32, 33)] == [1, 1, 20, 20, 31, 33]
    assert (1, 20) in {tuple(r) for r in pairs.collect()} and all(rep[a] == a and rep[b] == b for a, b in pairs.collect())


def test_consolidation_of_nothing(spark):
    empty = pts(spark, [])
    done = consolidation.consolidate(empty, manifest(spark, [1]))
    assert done.points.count() == 0 and consolidation.contained_blocks(done).count() == 0
    with pytest.raises(ValueError):
        consolidation.consolidate(empty, manifest(spark, [1]), rows_per_file=0)


def test_first_fit_decreasing():
    rnd = random.Random(5)
    for _ in range(50):
        sizes = np.array([rnd.randint(0, 130) for _ in range(rnd.randint(0, 60))])
        bins = consolidation.first_fit_decreasing(sizes, 100)
        room, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            s = min(sizes[i], 100)
            b = next((k for k, r in enumerate(room) if r >= s), None)
            if b is None:
                room.append(100)
                b = len(room) - 1
            room[b] -= s
            want[i] = b
        assert [want[i] for i in range(len(sizes))] == bins.tolist()


def test_sharded_packing_keeps_every_block(spark, monkeypatch):
    monkeypatch.setattr(consolidation, "SHARD", 20)
    sizes = spark.createDataFrame([(i, (i * 37) % 90 + 1) for i in range(200)], "block_id long, size long")
    out = consolidation.pack(sizes, 100)
    got = out.groupBy("bin").agg(F.sum("size").alias("s")).collect()
    assert out.count() == 200 and max(r["s"] for r in got) <= 100


# ---- trailing totals


def brute_trailing(rows):
    seen, daily = set(), {}
    for r in rows:
        s, level, start, n, *_ , avg, _, b = r
        k = repr(r)
        if level not in (1, 2) or s is None or start is None or k in seen:
            continue
        seen.add(k)
        d = daily.setdefault(s, {}).setdefault(start // DAY, [0, 0.0, 0])
        d[0] += n or 0
        if avg is not None and math.isfinite(avg):
            d[1] += avg * (n or 0)
            d[2] += n or 0
    out = {}
    for s, days in daily.items():
        for d in range(min(days), max(days) + 1):
            row = []
            for w in (7, 30):
                part = [days[x] for x in range(d - w + 1, d + 1) if x in days]
                weight = sum(p[2] for p in part)
                row += [sum(p[0] for p in part), sum(p[1] for p in part) / weight if weight else None]
            out[s, d] = row
    return out


def brute_silent(rows):
    active = {}
    for s, level, start, n, *_ in rows:
        if level in (1, 2) and s is not None and start is not None and (n or 0) > 0:
            active.setdefault(s, set()).add(start // DAY)
    out = []
    for s, days in active.items():
        for a, b in zip(sorted(days), sorted(days)[1:]):
            if b - a - 1 < 20:
                out += [(s, d) for d in range(a + 7, b)]
    return sorted(out)


def test_trailing_against_brute_force(spark):
    rnd = random.Random(8)
    rows = []
    for s in (1, 2, 3, None):
        day = rnd.randrange(-40, 300)
        for _ in range(25):
            day += rnd.choice([0, 1, 1, 2, 5, 8, 9, 19, 20, 21, 22, 75, 140])
            avg = rnd.choice([None, NAN, 1.5, 2.5, -3.0])
            rows.append((s, rnd.choice([1, 2, 2, 3]), day * DAY + rnd.randrange(DAY), rnd.choice([0, 1, 5, None]), 0.0, 1.0, avg, 1.0, 1))
    rows += [rows[0], rows[1], (1, 1, None, 3, 0.0, 1.0, 1.0, 1.0, 1)]
    out = trailing.trailing(spark.createDataFrame(rows, BUCKETS)).collect()
    want = brute_trailing(rows)
    assert {(r["series_id"], r["day"]) for r in out} == set(want) and len(out) == len(want)
    for r in out:
        c7, a7, c30, a30 = want[r["series_id"], r["day"]]
        assert (r["count_7"], r["count_30"]) == (c7, c30)
        for got, exp in ((r["avg_7"], a7), (r["avg_30"], a30)):
            assert got is None if exp is None else got == pytest.approx(exp)
    silent = trailing.silent_weeks(trailing.trailing(spark.createDataFrame(rows, BUCKETS))).collect()
    day = lambda text: int(np.datetime64(text, "D").astype(int))
    assert sorted((r["series_id"], day(r["day_utc"])) for r in silent) == brute_silent(rows)


def test_windows_name_their_columns(spark):
    rows = [(1, 2, d * DAY, 1, 0.0, 1.0, float(d), 1.0, 1) for d in range(10)]
    df = trailing.trailing(spark.createDataFrame(rows, BUCKETS), windows=(3, 14, 45))
    last = df.where("day = 9").first()
    assert (last["count_3"], last["count_14"], last["count_45"], last["avg_3"], last["active_days_14"]) == (3, 10, 10, 8.0, 10)
    assert "count_7" not in df.columns
    with pytest.raises(ValueError):
        trailing.trailing(spark.createDataFrame(rows, BUCKETS), windows=(0, 7))


def test_trailing_of_nothing(spark):
    assert trailing.trailing(spark.createDataFrame([], BUCKETS)).count() == 0


# ---- regular grid


def pchip(x, y, at):
    """Fritsch-Carlson with weighted harmonic means and three-point ends, written out plainly."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    for i in range(1, len(x) - 1):
        if d[i - 1] * d[i] > 0:
            a, b = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            m[i] = (a + b) / (a / d[i - 1] + b / d[i])

    def end(h0, h1, d0, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if s * d0 <= 0:
            return 0.0
        return 3 * d0 if d0 * d1 <= 0 and abs(s) > abs(3 * d0) else s

    if len(x) == 2:
        m[:] = d[0]
    else:
        m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    k = min(np.searchsorted(x, at, side="right") - 1, len(x) - 2)
    t = (at - x[k]) / h[k]
    return (2 * t**3 - 3 * t**2 + 1) * y[k] + (t**3 - 2 * t**2 + t) * h[k] * m[k] + (3 * t**2 - 2 * t**3) * y[k + 1] + (t**3 - t**2) * h[k] * m[k + 1]


@pytest.mark.parametrize("shard", [2, 5, 4096])
def test_grid_against_plain_interpolation(spark, monkeypatch, shard):
    monkeypatch.setattr(regrid, "SHARD", shard)
    rnd = random.Random(shard)
    step, rows, t = 1000, [], -50_000
    for i in range(120):
        t += rnd.choice([300, 900, 1000, 2500, 6000, 20_000, 90_000])
        rows.append((1, t, round(rnd.uniform(0, 9), 2), i, None))
    rows += [(1, rows[5][1], NAN, 500, 1), (1, rows[5][1] + 1, None, 501, 1), (1, rows[9][1], rows[9][2], 502, 1), (2, 5, 1.0, 503, 1), (3, 5, 1.0, 504, 1), (4, 5, float("inf"), 505, 1)]
    series = spark.createDataFrame([(1, "", "m", step), (2, "", "m", step), (4, "", "m", step), (None, "", "m", step)], SERIES)
    max_gap, max_fill = 60_000, 10_000
    got = {(r["series_id"], r["slot_ms"]): (r["status"], r["value"]) for r in regrid.regrid(pts(spark, rows), series, max_fill, max_gap).collect()}
    ok = sorted((t, q, v) for s, t, v, q, _ in rows if s == 1 and v is not None and math.isfinite(v))
    slots = {}
    for t, q, v in ok:
        slots.setdefault(t - t % step, []).append((t, q, v))
    knots = [(s, min(x)[0], *(max(x)[0], max(x)[2])) for s, x in sorted(slots.items())]
    want = {(2, 0): ("observed", 1.0)}
    segments, seg = [], [knots[0]]
    for a, b in zip(knots, knots[1:]):
        if b[1] - a[2] > max_gap:
            segments.append(seg)
            seg = []
        seg.append(b)
    segments.append(seg)
    for seg in segments:
        x, y = np.array([k[2] for k in seg], float), np.array([k[3] for k in seg])
        for a, b in zip(seg, [*seg[1:], None]):
            want[1, a[0]] = ("observed", a[3])
            if b:
                for s in range(a[0] + step, b[0], step):
                    want[1, s] = ("filled", pchip(x, y, s)) if b[1] - a[2] <= max_fill else ("missing", None)
    assert set(got) == set(want)
    for k, (status, value) in want.items():
        assert got[k][0] == status
        assert got[k][1] is None if value is None else got[k][1] == pytest.approx(value, abs=1e-6), k


def test_grid_of_nothing_and_series_without_step(spark):
    series = spark.createDataFrame([(1, "", "m", 0), (2, "", "m", None)], SERIES)
    assert regrid.regrid(pts(spark, []), series).count() == 0
    assert regrid.regrid(pts(spark, [(1, 5, 1.0, 1, 1), (2, 5, 1.0, 2, 1)]), series).count() == 0


# ---- implausible readings


def planted(rnd, n=1500):
    t = np.arange(n) * 60_000
    v = 50 + 4 * np.sin(t / 86_400_000 * 2 * np.pi) + rnd.normal(0, 0.5, n)
    bad = {"spike": [100, 400, 401, 402, 900], "stuck": list(range(600, 615)), "limit": [1200]}
    for i in (100, 900):
        v[i] += 15
    v[400:403] -= 12
    v[600:615] = v[600]
    v[1200] = 130.0
    v[1300:] += 20  # a lasting change of level
    return t, v, bad


def test_planted_cases_are_found_and_nothing_else(spark, monkeypatch):
    monkeypatch.setattr(anomalies, "SHARD_ROWS", 600)
    rnd = np.random.default_rng(1)
    rows, want, seq = [], set(), 0
    for s in (1, 2, 3):
        t, v, bad = planted(rnd)
        for i in range(len(t)):
            rows.append((s, int(t[i]), float(v[i]), seq, seq % 9))
            if any(i in b for b in bad.values()):
                want.add(seq)
            seq += 1
    first = rows[100]
    rows += [(first[0], first[1], first[2], seq, 3), (first[0], first[1], 50.0, seq + 1, 3)]  # sent again; corrected
    want.add(seq)
    rows += [(4, i * 60_000, 1.0, seq + 10 + i, 1) for i in range(60)]  # constant by nature
    rows += [(5, 1, float("inf"), seq + 100, 1), (5, 2, NAN, seq + 101, 1), (5, 3, None, seq + 102, 1), (6, 1, -4.0, seq + 103, None), (None, 1, 5.0, seq + 104, 1), (7, 1, 3.0, None, 1)]
    want |= {seq + 100, seq + 103}
    rows.append(rows[100])  # repeated in full
    series = spark.createDataFrame([(s, "", "cpu", 60_000) for s in range(1, 6)] + [(6, "", "rate", 60_000)], SERIES)
    specs = spark.createDataFrame([("cpu", "percent", 0.0, 100.0), ("rate", "per second", None, NAN)], "metric string, unit string, lower_limit double, upper_limit double")
    scored = anomalies.score_readings(pts(spark, rows), series, specs)
    got = [r["seq"] for r in anomalies.implausible_records(pts(spark, rows), scored).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert scored.count() == len({r[:3] for r in rows if r[0] is not None and r[2] is not None and r[2] == r[2]})


def test_scores_of_nothing(spark):
    series = spark.createDataFrame([], SERIES)
    specs = spark.createDataFrame([], "metric string, unit string, lower_limit double, upper_limit double")
    assert anomalies.score_readings(pts(spark, []), series, specs).count() == 0


def test_forest_sets_an_outlier_apart():
    rnd = np.random.default_rng(0)
    x = np.abs(rnd.normal(size=(500, 5)))
    x[7], x[8] = 9, 30  # the further out, the higher, also beyond all that is sampled
    n = np.array([498])
    plain, runs = anomalies.forest_scores(x, np.zeros(500, np.int64), np.delete(np.arange(500), [7, 8]), np.array([0]), n, anomalies.Rules())
    for score in (plain, runs):
        assert score.argmax() == 8 and score[8] > score[7] > 0.6 > 0.5 > np.median(score)


def saw(rnd, n=1200):
    """Discharge with recharges, and three spikes."""
    v = 100 - 0.2 * (np.arange(n) % 100) + rnd.normal(0, 0.05, n)
    at = np.array([150, 555, 1033])
    v[at] += [3.0, -3.0, 3.0]
    return np.arange(n) * 60_000, v, at


def far_out(v, rules):
    """The level alone: ``spike`` scatters beyond the medians of both sides."""
    k = rules.side
    sides = [(np.median(v[max(0, i - k) : i]), np.median(v[i + 1 : i + 1 + k])) for i in range(1, len(v) - 1)]
    sides = np.array([(sides[0][1], sides[0][1]), *sides, (sides[-1][0], sides[-1][0])])
    scatter = 1.4826 * np.median(np.abs(v - sides.mean(axis=1)))
    return np.flatnonzero(np.maximum(v - sides.max(axis=1), sides.min(axis=1) - v) > rules.spike * scatter)


def test_the_forest_decides(monkeypatch):
    rules = anomalies.Rules()
    t, v, at = saw(np.random.default_rng(2))
    plain = far_out(v, rules)
    assert set(at) <= set(plain) and len(at) / len(plain) < 0.3  # the level alone takes recharges for spikes
    _, spike, _ = anomalies.judge(np.zeros(len(t)), t, v, rules)
    assert np.flatnonzero(spike).tolist() == at.tolist()
    # Without trees every score is that of the probe, and one useless tree misses or adds readings.
    score = lambda x, owner, *rest: (np.full(len(x), 0.5), np.full(len(x), 0.5))
    monkeypatch.setattr(anomalies, "forest_scores", score)
    assert anomalies.judge(np.zeros(len(t)), t, v, rules)[1].all()


def test_a_burst_of_every_day_is_no_spike_of_its_hour():
    rnd = np.random.default_rng(4)
    t = np.arange(0, 4 * DAY, 1_200_000)
    v = rnd.normal(0, 1, len(t))
    v[36::72] += 12  # once a day, at noon
    odd = 36 + 72 + 20
    v[odd] += 12
    daily = np.zeros((1, 24))
    _, blind, _ = anomalies.judge(np.zeros(len(t)), t, v, anomalies.Rules())
    daily[0, 12] = 12.0
    # The forest sees the residual of the daily cycle: what recurs at its hour counts for less than what doesn't.
    score, spike, _ = anomalies.judge(np.zeros(len(t)), t, v, anomalies.Rules(), daily)
    assert blind[odd] and spike[odd] and score[odd] > score[36::72].max()


def test_readings_that_share_a_time_have_forest_scores_of_their_own():
    t, v, _ = planted(np.random.default_rng(3))
    alone, spikes, _ = anomalies.judge(np.zeros(len(t)), t, v, anomalies.Rules())
    # After the first reading of its time: a spike beside an ordinary reading, an ordinary one beside a spike, a copy in the run.
    at, extra = np.array([50, 100, 607]), np.array([v[50] + 15, 50.0, v[607]])
    first = np.delete(np.arange(len(t) + 3), at + 1 + np.arange(3))
    more = lambda a, b: np.insert(a, at + 1, b)
    score, spike, stuck = anomalies.judge(np.zeros(len(t) + 3), more(t, t[at]), more(v, extra), anomalies.Rules())
    own = np.setdiff1d(np.arange(len(score)), first)
    assert (score[first] == alone).all() and (spike[first] == spikes).all()  # the trees are the same
    assert alone[50] < score[own[0]] < 1 and score[own[1]] < alone[100] and score[own[2]] == alone[607]
    assert spike[own].tolist() == [True, False, False] and stuck[own].tolist() == [False, False, True]


def test_a_series_that_outruns_its_step_is_cut_finer(spark, monkeypatch):
    monkeypatch.setattr(anomalies, "SHARD_ROWS", 100)
    df = spark.range(3000).selectExpr("1L as series_id", "id * 7 as ts_ms", "0L as unit", "30000L as unit_ms")
    out, shards = anomalies.sharded(df)
    assert shards.count() == out.select("shard").distinct().count()
    sizes = [r["n"] for r in out.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert out.where("home").count() == 3000 and max(sizes) < 1200 and len(sizes) > 5
