"""Implausible readings: an isolation forest for each source decides, limits and the length of a stuck run are explicit.

A series is cut into shards of some thousand readings, whatever its rate, with the readings next to it as a halo; each
shard has its own statistics and its own forest, so that a reading is judged by what its series did at that time. The
forests of all shards in a batch are grown and asked at once, as arrays.

A forest is asked for the score of each reading and, beside them, of probes: made-up readings of that source that just
are what is looked for. A probe's score is the source's own threshold. The daily cycle is that of the whole series.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import finite
from ..session import broadcast_if_small, small, stage

# What a unit can't measure, where the limits were not recorded: fixed values, (lowest, highest).
UNIT_NATURE = {
    "percent": (0.0, 100.0), "megabyte": (0.0, None), "degree celsius": (-273.15, None), "volt": (0.0, None), "per second": (0.0, None),
    "millisecond": (0.0, None), "items": (0.0, None), "hectopascal": (0.0, None), "per minute": (0.0, None), "litre per minute": (0.0, None), "flag": (0.0, 1.0),
}


@dataclass(frozen=True)
class Rules:
    """``trees`` on ``sample`` of the ``inner`` share of readings each make a forest; the last ``run_trees`` of them know run lengths only, the
    others the other features. A reading is a spike if the forest isolates it no later than the probe of its source, a
    reading that stands ``spike`` units out on both sides (``side`` readings each) and half of that out of the daily
    cycle; next to a spike, a probe of ``shoulder`` of that is enough. A source's unit is its scatter and, where it often
    repeats a value (``repeats``), at least what brings ``spike`` units ``tail`` times beyond its 97 % tail. A stuck value
    is a run of ``run`` readings that the forest isolates no later than such a run of this source."""

    trees: int = 20
    run_trees: int = 6
    sample: int = 128
    inner: float = 0.97
    side: int = 7
    spike: float = 9.0
    shoulder: float = 0.6
    tail: float = 4.0
    run: int = 10
    repeats: float = 0.2
    seed: int = 20_260_105


#: Readings a shard, units (of this many slots) a shard is made of, rows in a batch of shards, about.
SHARD_ROWS, UNIT_SLOTS, BATCH_ROWS = 4_096, 512, 100_000
HALO_UNITS = 2
#: Days on which an hour must have readings for a usual value.
CYCLE_DAYS = 7


def limits(series: DataFrame, specs: DataFrame) -> DataFrame:
    """``series_id, step_ms, lower, upper`` of each series; recorded limits win over the nature of the unit.

    A limit that is neither recorded nor in the unit's nature is none; units without a known nature are warned of.
    """
    nature = series.sparkSession.createDataFrame([(k, *v) for k, v in UNIT_NATURE.items()], "unit string, low double, high double")
    ok = lambda c: F.when(~F.isnan(c), F.col(c))
    spec = specs.join(F.broadcast(nature), "unit", "left").groupBy("metric").agg(
        F.max(F.coalesce(ok("lower_limit"), F.col("low"))).alias("lower"), F.min(F.coalesce(ok("upper_limit"), F.col("high"))).alias("upper")
    )
    unknown = specs.where(F.col("unit").isNotNull() & (F.col("lower_limit").isNull() | F.col("upper_limit").isNull())).join(F.broadcast(nature), "unit", "left_anti")
    if names := [r["unit"] for r in unknown.select("unit").distinct().limit(20).collect()]:
        warnings.warn(f"nothing is known of what these units can't measure: {names}", stacklevel=2)
    one = series.where("series_id IS NOT NULL").groupBy("series_id").agg(F.min("metric").alias("metric"), F.min(F.when(F.col("step_ms") > 0, F.col("step_ms"))).alias("step_ms"))
    return one.join(spec, "metric", "left").select("series_id", F.coalesce("step_ms", F.lit(60_000)).alias("step_ms"), "lower", "upper")


# ---- the forest


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean length of an unsuccessful search among ``n`` readings."""
    n = np.asarray(n, dtype=np.float64)
    many = np.maximum(n, 3)
    return np.where(n > 2, 2 * (np.log(many - 1) + 0.5772156649) - 2 * (many - 1) / many, np.where(n == 2, 1.0, 0.0))


def forest_scores(x: np.ndarray, owner: np.ndarray, pool: np.ndarray, pool_start: np.ndarray, pool_size: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Isolation scores of each row of ``x`` in the forest of its segment ``owner``: by all features but the last, and by
    the last one, the run length.

    The trees of segment ``s`` are grown on samples of the rows ``pool[pool_start[s]:pool_start[s] + pool_size[s]]``. A
    row outside the range of a node's sample is taken as if it were in it: a cut falls between the two as often as the
    way there is long beside the range, and the expected depth counts. A row hence scores the more the further it lies
    out, also beyond everything that was sampled. Beside that way a range counts as ``spike`` units at least (1 of run
    length), lest a source whose readings are nearly all equal sets apart what is near to them.
    """
    rng = np.random.default_rng(rules.seed)
    segments, features, trees, sample = len(pool_start), x.shape[1], rules.trees, rules.sample
    depth = int(np.ceil(np.log2(sample)))
    roots = segments * trees
    pick = (rng.random((segments, trees, sample)) * pool_size[:, None, None]).astype(np.int64)
    rows = pool[np.minimum(pick, pool_size[:, None, None] - 1) + pool_start[:, None, None]].ravel()
    root = np.repeat(np.arange(roots), sample)
    data = x[rows].astype(np.float32)
    node = root.copy()  # place in the level: root * 2^level + position
    runs_only = np.tile(np.arange(trees) >= trees - rules.run_trees, segments)
    done = np.zeros(roots, dtype=bool)
    alive = np.arange(len(data))
    least = np.append(np.full(features - 1, rules.spike), 1.0)
    levels = []
    for level in range(depth + 1):
        width = roots << level
        f = np.where(runs_only, features - 1, rng.integers(0, features - 1, width)).astype(np.int64)
        n = np.bincount(node[alive], minlength=width)

        def span(f=f, width=width):
            v = data[alive, f[node[alive]]]
            low, high = np.full(width, np.inf, np.float32), np.full(width, -np.inf, np.float32)
            np.minimum.at(low, node[alive], v)
            np.maximum.at(high, node[alive], v)
            return v, low, high

        v, low, high = span()
        # A constant feature can't split; the next ones are tried before the node becomes a leaf.
        for _ in range(features - 2):
            flat_node = ~(high > low) & ~runs_only & (n > 1)
            if not flat_node.any():
                break
            f = np.where(flat_node, (f + 1) % (features - 1), f)
            v, low, high = span(f)
        leaf = done | ~(high > low) | (level == depth)
        with np.errstate(invalid="ignore"):
            range_ = np.where(high > low, high - low, 0)
            cut = np.where(leaf, np.inf, low + np.maximum(range_, 1) * (1 - rng.random(width, dtype=np.float32))).astype(np.float32)
            wide = np.maximum(range_, least[f]).astype(np.float32)
        rest = average_path(n + 1).astype(np.float32)
        levels.append((f, cut, np.where(n > 0, low, 0).astype(np.float32), np.where(n > 0, high, 0).astype(np.float32), wide, leaf, rest))
        keep = ~leaf[node[alive]]
        alive, v = alive[keep], v[keep]
        node[alive] = node[alive] * 2 + (v >= cut[node[alive]])
        done, runs_only = np.repeat(leaf, 2), np.repeat(runs_only, 2)
    xs = np.ascontiguousarray(x, dtype=np.float32)
    got = np.zeros((2, len(x)))
    for t in range(trees):
        at, rows_left, alone = owner * trees + t, np.arange(len(x)), np.ones(len(x), np.float32)
        path = got[int(t >= trees - rules.run_trees)]
        for f, cut, low, high, wide, leaf, rest in levels:
            v = xs[rows_left, f[at]]
            beyond = np.maximum(np.maximum(low[at] - v, v - high[at]), 0)
            stop = leaf[at]
            stay = wide[at] / (beyond + wide[at])
            path[rows_left] += alone * np.where(stop, stay * rest[at], 1)
            go = ~stop
            v, at, rows_left, alone = v[go], at[go], rows_left[go], (alone * stay)[go]
            at = at * 2 + (v >= cut[at])
    norm = float(average_path(np.array(sample)))
    plain = 2.0 ** (-got[0] / (trees - rules.run_trees) / norm)
    return plain, 2.0 ** (-got[1] / rules.run_trees / norm)


# ---- features and rules of a batch of shards


def _median_by(keys: np.ndarray, values: np.ndarray, groups: int) -> np.ndarray:
    """Median of the values of each group ``0 .. groups - 1``; NaN for an empty one."""
    order = np.lexsort((values, keys))
    n = np.bincount(keys, minlength=groups)
    first = np.cumsum(n) - n
    v = values[order]
    out = np.full(groups, np.nan)
    some = n > 0
    lo, hi = first + (n - 1) // 2, first + n // 2
    out[some] = (v[lo[some]] + v[hi[some]]) / 2
    return out


def _quantile_by(keys: np.ndarray, values: np.ndarray, groups: int, q: float) -> np.ndarray:
    order = np.lexsort((values, keys))
    n = np.bincount(keys, minlength=groups)
    first = np.cumsum(n) - n
    out = np.zeros(groups)
    some = n > 0
    out[some] = values[order][(first + np.minimum((n * q).astype(np.int64), n - 1))[some]]
    return out


def _side_median(v: np.ndarray, seg: np.ndarray, k: int, step: int) -> np.ndarray:
    """Median of up to ``k`` readings on one side of each reading in its segment; NaN where there is none."""
    n = len(v)
    m = np.full((n, k), np.inf)
    for i in range(1, k + 1):
        if step < 0:
            m[i:, i - 1] = np.where(seg[i:] == seg[: n - i], v[: n - i], np.inf)
        else:
            m[: n - i, i - 1] = np.where(seg[: n - i] == seg[i:], v[i:], np.inf)
    m.sort(axis=1)
    have = np.isfinite(m).sum(axis=1)
    rows = np.arange(n)
    with np.errstate(invalid="ignore"):
        out = (m[rows, np.maximum(have - 1, 0) // 2] + m[rows, np.minimum(have // 2, k - 1)]) / 2
    return np.where(have > 0, out, np.nan)


def _sides(v: np.ndarray, seg: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Medians of up to ``k`` readings on the left and on the right; a side without readings is as the other."""
    left, right = _side_median(v, seg, k, -1), _side_median(v, seg, k, 1)
    left, right = np.where(np.isnan(left), right, left), np.where(np.isnan(right), left, right)
    return np.where(np.isnan(left), v, left), np.where(np.isnan(right), v, right)


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run of each reading, and the first index and length of each run; ``new`` marks where one begins."""
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return run, first, np.diff(np.append(first, len(new)))


def _near_max(x: np.ndarray, seg: np.ndarray, before: int, after: int) -> np.ndarray:
    """Largest ``x`` from ``before`` places back to ``after`` places on, in the same segment."""
    out = x.copy()
    for k in range(1, max(before, after) + 1):
        same = seg[k:] == seg[:-k]
        if k <= before:
            out[k:] = np.where(same, np.maximum(out[k:], x[:-k]), out[k:])
        if k <= after:
            out[:-k] = np.where(same, np.maximum(out[:-k], x[k:]), out[:-k])
    return out


def judge(seg: np.ndarray, ts: np.ndarray, value: np.ndarray, rules: Rules, daily: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, spike and stuck of each reading; sorted by segment, time and order of arrival, values finite.

    The first reading of a time stands for it in the sequence; others of the same time are held against the same
    neighbours by their own value. ``daily[s, h]`` is the usual value of the series of the ``s``-th segment in hour ``h``.
    """
    lead = np.append(True, (seg[1:] != seg[:-1]) | (ts[1:] != ts[:-1]))
    at = np.cumsum(lead) - 1  # place of each reading in the sequence
    _, g = np.unique(seg[lead], return_inverse=True)
    v, groups = value[lead], int(g[-1]) + 1
    size = np.bincount(g, minlength=groups)
    head = np.append(True, g[1:] != g[:-1])
    step = np.where(head, 0.0, v - np.append(v[:1], v[:-1]))
    # Exact repeats come first: long ones say nothing about the usual scatter.
    run, first, length = _runs(head | (step != 0))
    free = length[run] < rules.run
    repeats = np.bincount(g, (~head & (step == 0) & free).astype(float), groups) / np.maximum(np.bincount(g, (~head & free).astype(float), groups), 1)
    changing = (repeats < rules.repeats) & (np.bincount(g, free.astype(float), groups) >= np.maximum(3, 0.15 * size))
    left, right = _sides(v, g, rules.side)
    some = np.where(np.isin(np.arange(groups), g[free]), True, False)
    basis = free | ~some[g]
    scatter = 1.4826 * _median_by(g[basis], np.abs(v - (left + right) / 2)[basis], groups)
    middle = _median_by(g, v, groups)
    wide = 1.4826 * _median_by(g, np.abs(v - middle[g]), groups)
    tail = _quantile_by(g, np.abs(v - middle[g]), groups, 0.97)
    # Near repeats: within a thousandth of the usual scatter.
    tolerance = np.maximum(scatter / 200, wide / 1000)
    run, first, length = _runs(head | (np.abs(step) > tolerance[g]))
    spread = np.maximum.reduceat(v, first) - np.minimum.reduceat(v, first)
    stuck_run = (length >= rules.run) & (spread <= 4 * tolerance[g[first]]) & changing[g[first]]
    # The unit of a source: its scatter, and its tail where it often repeats a value.
    often = np.maximum(np.maximum(scatter, rules.tail * tail / rules.spike), np.where((scatter == 0) | (tail == 0), 10 * np.maximum(np.abs(middle), 1) / rules.spike, 0))
    unit = np.where(repeats < rules.repeats, scatter, often)
    unit = np.where(unit > 0, unit, np.inf)
    high, low, gap = np.maximum(left, right)[at], np.minimum(left, right)[at], np.abs(left - right)[at]
    beyond = np.where(value > high, value - high, np.where(value < low, low - value, 0.0))
    # Readings that share a time have features of their own, as if each stood in that place.
    last = np.append(head[1:], True)
    back = np.where(head[at], np.inf, np.abs(value - np.append(v[:1], v[:-1])[at]))
    onward = np.where(last[at], np.inf, np.abs(np.append(v[1:], v[-1:])[at] - value))
    nearest = np.minimum(back, onward)
    # At the edge of two levels a spike has to outdo both; it is entered or left by a jump, as the top of a ramp is not.
    alone = beyond * (beyond / np.maximum(np.maximum(beyond, gap), 1e-300))
    jump = np.maximum(_near_max(np.abs(step), g, 3, 4)[at], np.where(np.isfinite(nearest), nearest, 0))
    jump = alone * (jump / np.maximum(np.maximum(jump, rules.shoulder * alone), 1e-300)) ** 3
    # What is left of that once the daily cycle of the series is taken off the reading and its neighbours.
    season = jump
    if daily is not None:
        cycle = daily[g, ((ts[lead] // 3_600_000) % 24).astype(np.int64)]
        cycle = np.where(np.isnan(cycle), middle[g], cycle)
        above, below = _sides(v - cycle, g, rules.side)
        above, below, own = np.maximum(above, below)[at], np.minimum(above, below)[at], value - cycle[at]
        season = np.minimum(np.maximum(np.maximum(own - above, below - own), 0.0), jump)
    # Readings of the run that ends just before a place, and of the one that begins just after it.
    place = np.arange(len(v))
    before = np.append(0, (place - first[run] + 1)[:-1])
    after = np.append(((first + length)[run] - place)[1:], 0)
    reach = 1 + np.where(back <= tolerance[g][at], before[at], 0) + np.where(onward <= tolerance[g][at], after[at], 0)
    reach = np.where(np.abs(value - v[at]) <= tolerance[g][at], np.maximum(reach, length[run][at]), reach)
    # Flatness grades readings outside runs too, so that a tree without a run in its sample still sets one apart.
    flat = 1 / (1 + nearest / np.maximum(scatter, 1e-12 + 1e-9 * np.abs(middle))[g][at])
    shape = np.minimum(np.stack([alone, jump, season], axis=1) / unit[g][at][:, None], 2 * rules.spike)
    x = np.column_stack([shape, np.log1p(reach) + flat])
    probe = np.array([1.0, 1.0, 0.5]) * rules.spike
    probes = np.stack([np.append(probe, np.log1p(rules.run / 2)), np.append(probe * rules.shoulder, 0.0)])
    # A run is one event: it enters the samples once, else a long one would hide itself. Trees grow on first readings only.
    # The outermost readings of a source stay out of the samples, lest a cluster of spikes hides itself.
    pool = np.flatnonzero(lead)[first]
    inner = beyond[pool] <= _quantile_by(g, beyond[lead], groups, rules.inner)[g[first]]
    pool, in_pool = pool[inner], np.bincount(g[first][inner], minlength=groups)
    owner = np.concatenate([g[at], np.repeat(np.arange(groups), 2)])
    plain, runs = forest_scores(np.vstack([x, np.tile(probes, (groups, 1))]), owner, pool, np.cumsum(in_pool) - in_pool, in_pool, rules)
    n = len(value)
    sure, beside, long_run = plain[n::2][g], plain[n + 1 :: 2][g], runs[n::2][g]
    plain, runs = plain[:n], runs[:n]
    spike = (plain >= sure[at]) & (size[g][at] >= rules.run)
    # Readings next to a spike, on its side, belong to it from a lower threshold on.
    part, side = np.zeros(len(v), dtype=bool), np.where(v > np.maximum(left, right), 1, np.where(v < np.minimum(left, right), -1, 0))
    part[at[spike & lead]] = True
    weak = (plain[lead] >= beside) & (side != 0)
    for _ in range(3):
        near = np.zeros(len(v), dtype=bool)
        close = (g[1:] == g[:-1]) & (side[1:] == side[:-1])
        near[1:] |= part[:-1] & close
        near[:-1] |= part[1:] & close
        part |= near & weak
    spike[lead] |= part
    stuck = stuck_run[run][at] & (np.abs(value - v[at]) <= tolerance[g][at]) & (runs >= long_run[at])
    return np.maximum(plain, runs), spike, stuck


def _even_units(readings: DataFrame) -> DataFrame:
    """Divides units that hold far more readings than a shard, as a series that outruns its step makes them, by time."""
    dense = readings.groupBy("series_id", "unit", "unit_ms").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * SHARD_ROWS)
    dense = stage(dense.select("series_id", "unit", F.ceil(F.col("n") / SHARD_ROWS).alias("parts")), "p4-dense")
    finer = F.lit(1 << 20)
    if not dense.take(1):
        return readings.withColumn("unit", F.col("unit") * finer)
    place = F.floor((F.col("ts_ms") - F.col("unit") * F.col("unit_ms")) / F.col("unit_ms") * F.least("parts", finer)).cast("long")
    rows = readings.join(broadcast_if_small(dense), ["series_id", "unit"], "left")
    return rows.withColumn("unit", F.col("unit") * finer + F.coalesce(place, F.lit(0))).drop("parts")


def sharded(readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds ``shard`` and ``home`` to ``series_id, ts_ms, unit, unit_ms, ...``: rows of the neighbouring units come as
    copies. The other result is the list of shards, ``series_id, shard``.

    Consecutive units make a shard once they hold ``SHARD_ROWS`` readings; what is left at the end joins the last one.
    """
    readings = _even_units(readings)
    counts = readings.groupBy("series_id", "unit").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("series_id")
    order = w.orderBy("unit")
    last = F.greatest(F.floor(F.col("total") / SHARD_ROWS) - 1, F.lit(0))
    units = counts.withColumns({"total": F.sum("n").over(w), "before": F.sum("n").over(order) - F.col("n")})
    units = units.withColumn("shard", F.least(F.floor(F.col("before") / SHARD_ROWS), last).cast("long"))
    near = [F.lag("shard", k).over(order) for k in range(1, HALO_UNITS + 1)] + [F.lead("shard", k).over(order) for k in range(1, HALO_UNITS + 1)]
    units = units.withColumn("shards", F.array_distinct(F.filter(F.array("shard", *near), lambda s: s.isNotNull())))
    units = stage(units.select("series_id", "unit", F.col("shard").alias("own"), "shards"), "p4-units")
    out = readings.join(broadcast_if_small(units), ["series_id", "unit"]).withColumn("shard", F.explode("shards"))
    return out.withColumn("home", F.col("shard") == F.col("own")).drop("own", "shards", "unit", "unit_ms"), units.select("series_id", F.col("own").alias("shard")).distinct()


def daily_cycle(readings: DataFrame) -> DataFrame:
    """``series_id, hour, usual``: the median over days of the median of each series in each hour of the UTC day.

    A day counts once, so that what happened in one hour of one day is not usual, and an hour with fewer than
    ``CYCLE_DAYS`` days has no usual value. Medians are within 1/100 of the ranks; their sketches are merged before and
    after the shuffle.
    """
    day, hour = F.floor(F.col("ts_ms") / 86_400_000), F.pmod(F.floor(F.col("ts_ms") / 3_600_000), F.lit(24)).cast("int")
    median = F.percentile_approx("value", 0.5, 100)
    per = readings.groupBy("series_id", day.alias("day"), hour.alias("hour")).agg(median.alias("value"))
    usual = per.groupBy("series_id", "hour").agg(median.alias("usual"), F.count(F.lit(1)).alias("days"))
    return usual.where(F.col("days") >= CYCLE_DAYS).drop("days")


def score_readings(points: DataFrame, series: DataFrame, specs: DataFrame, rules: Rules | None = None, flagged_only: bool = False) -> DataFrame:
    """Each distinct reading (``series_id, ts_ms, value``) with its forest score and ``spike``, ``stuck``, ``impossible``.

    Null and NaN are no readings and don't come out, nor do rows without series or time. Infinite values are impossible
    and stand outside the sequence: null score, neither spike nor stuck. Copies come out once; of several values at one
    time each is judged by itself. A series not in ``series`` has no limits. ``flagged_only`` leaves out what no rule
    flags, after scoring. Stages the distinct readings.
    """
    rules = rules or Rules()
    bounds = small(limits(series, specs), "p4-limits")
    rows = points.where("value IS NOT NULL AND NOT isnan(value) AND series_id IS NOT NULL AND ts_ms IS NOT NULL")
    rows = rows.groupBy("series_id", "ts_ms", "value").agg(F.coalesce(F.min("seq"), F.lit((1 << 63) - 1)).alias("seq"))
    rows = rows.join(bounds, "series_id", "left")
    bad = F.coalesce(F.col("value") < F.col("lower"), F.lit(False)) | F.coalesce(F.col("value") > F.col("upper"), F.lit(False)) | ~finite(F.col("value"))
    width = (F.coalesce("step_ms", F.lit(60_000)) * UNIT_SLOTS).cast("long")
    unit = F.floor(F.col("ts_ms") / width).cast("long")
    rows = stage(rows.select("series_id", "ts_ms", "value", "seq", unit.alias("unit"), width.alias("unit_ms"), bad.alias("impossible")), "p4-readings")
    sequence = rows.where(finite(F.col("value")))
    batches = max(1, sequence.count() // BATCH_ROWS)
    parts, shards = sharded(sequence)
    # The daily cycle goes to each shard of its series as 24 rows beside the readings.
    no = F.lit(False)
    cycle = shards.join(daily_cycle(sequence), "series_id").select(
        "series_id", F.col("hour").cast("long").alias("ts_ms"), F.col("usual").alias("value"), F.lit(-1).cast("long").alias("seq"), "shard", no.alias("home"), no.alias("impossible"), F.lit(True).alias("of_day")
    )
    parts = parts.withColumn("of_day", no).select(*cycle.columns).unionByName(cycle).withColumn("batch", F.pmod(F.xxhash64("series_id", "shard"), F.lit(batches)))

    def batch(pdf: pd.DataFrame) -> pd.DataFrame:
        of_day = pdf["of_day"].to_numpy()
        hours, pdf = pdf[of_day], pdf[~of_day]
        pdf = pdf.iloc[np.lexsort((pdf["seq"].to_numpy(), pdf["ts_ms"].to_numpy(), pdf["shard"].to_numpy(), pdf["series_id"].to_numpy()))]
        sid, shard = pdf["series_id"].to_numpy(), pdf["shard"].to_numpy()
        new = np.append(True, (sid[1:] != sid[:-1]) | (shard[1:] != shard[:-1]))
        seg = np.cumsum(new) - 1
        daily = np.full((int(seg[-1]) + 1, 24), np.nan)
        at = pd.MultiIndex.from_arrays([sid[new], shard[new]]).get_indexer(pd.MultiIndex.from_arrays([hours["series_id"], hours["shard"]]))
        daily[at, hours["ts_ms"].to_numpy()] = hours["value"].to_numpy()
        score, spike, stuck = judge(seg, pdf["ts_ms"].to_numpy(), pdf["value"].to_numpy(), rules, daily)
        out = pdf[["series_id", "ts_ms", "value", "impossible"]].assign(score=score, spike=spike, stuck=stuck)
        keep = pdf["home"].to_numpy() & ((not flagged_only) | spike | stuck | pdf["impossible"].to_numpy())
        return out[keep]

    schema = "series_id long, ts_ms long, value double, impossible boolean, score double, spike boolean, stuck boolean"
    judged = parts.groupBy("batch").applyInPandas(batch, schema)
    infinite = rows.where(~finite(F.col("value"))).select(
        "series_id", "ts_ms", "value", "impossible", F.lit(None).cast("double").alias("score"), F.lit(False).alias("spike"), F.lit(False).alias("stuck")
    )
    return judged.unionByName(infinite)


def implausible_records(points: DataFrame, scored: DataFrame) -> DataFrame:
    """``seq``, once each, of the records whose reading is flagged; records without ``seq`` can't be named."""
    flagged = stage(scored.where("spike OR stuck OR impossible").select("series_id", "ts_ms", "value"), "p4-flagged")
    return points.where("seq IS NOT NULL").join(broadcast_if_small(flagged), ["series_id", "ts_ms", "value"], "left_semi").select("seq").distinct()

