"""Percentiles for each group over any number of values: exact by bisection, or bounded from mergeable summaries.

Values are mapped to integers that order as they do (``ordered_key``), so that halving an interval of keys is halving
an interval of values on the scale of doubles. The first pass cuts the whole range at fixed keys, the cells of the
summaries made coarser, and counts rows between them; each later pass splits every open interval at ``2^BITS - 1``
midpoints, counts the rows below each of them, and keeps the part that holds the target rank, shrunk to the values that
occur in it. It ends when each interval holds a single value: after a few passes on measurements, after ``64 / BITS + 1``
at most. A pass aggregates before it shuffles and no group is ever in one task. All rows are read twice: by the first
pass, and to take along those inside open intervals, a small share of them, which is all that later passes read. Only if
the list of open intervals is too large for a broadcast, the second reading shuffles rows, once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import day_number, finite, ordered_key, raw_bits
from ..session import small, stage

BITS = 6
#: Bits of a key that the first pass drops: six bits of the mantissa stay, so that a group has some hundred parts.
FIRST_SHIFT = 46
#: Bits of a key that a summary drops: 52 - 43 = 9 bits of the mantissa stay, so bounds are within 1/512 of the value.
CELL_SHIFT = 43


def target_rank(p: Column, n: Column) -> Column:
    """Nearest rank, ``clamp(ceil(p * n), 1, n)``; the product is rounded, so that 0.9 * 10 is 9 and nothing above."""
    return F.least(F.greatest(F.ceil(F.round(p * n, 6)), F.lit(1)), n).cast("long")


def _checked(by: Sequence[str]) -> list[str]:
    """Group columns; those of the result and names that begin with two underscores are taken."""
    if bad := [c for c in by if c in ("p", "n", "value", "low", "high") or c.startswith("__")]:
        raise ValueError(f"group columns can't be named {bad}")
    return list(by)


def weighted(values: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Finite values of each group with a weight: ``by..., __v, __key, __w``. Nothing is shuffled.

    Null, NaN and infinite values are left out; -0.0 is 0.0. Groups may be null in any column.
    """
    v = F.col(value).cast("double") + 0.0
    rows = values.where(finite(F.col(value).cast("double"))).select(*by, v.alias("__v"), F.lit(1).cast("long").alias("__w"))
    rows = rows.select(*by, "__v", raw_bits(F.col("__v")).alias("__bits"), "__w")
    return rows.select(*by, "__v", ordered_key(F.col("__bits")).alias("__key"), "__w")


def _same(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & a[c].eqNullSafe(b[c])
    return out


def percentiles(rows: DataFrame, by: Sequence[str], ps: Sequence[float] = (0.5, 0.9, 0.99), tolerance_bits: int = 0, max_passes: int = 64) -> DataFrame:
    """``by..., p, n, value, low, high`` of weighted rows (``by..., __v, __key, __w``); runs a job for each pass.

    ``value`` is the nearest-rank percentile. With ``tolerance_bits`` above 0 an interval also counts as resolved once
    it spans less than ``2^tolerance_bits`` keys, that is a relative error of about ``2^(tolerance_bits - 52)``, and
    ``value`` is its lower end, which like ``high`` is a value of the group. Groups without a value give no row.
    """
    if any(not 0 < p <= 1 for p in ps):
        raise ValueError("percentiles must be in (0, 1]")
    by = _checked(by)
    stats = [F.sum("__w").alias("__c"), F.min("__key").alias("__k0"), F.max("__key").alias("__k1"), F.min("__v").alias("__v0"), F.max("__v").alias("__v1")]
    cells = stage(rows.groupBy(*by, F.shiftright("__key", FIRST_SHIFT).alias("__part")).agg(*stats), "p1-cells")
    whole = W.partitionBy(*by)
    each = F.explode(F.array(*[F.lit(float(p)) for p in ps])).alias("p")
    cells = cells.withColumns({"n": F.sum("__c").over(whole), "__upto": F.sum("__c").over(whole.orderBy("__part"))})  # a row a cell
    first = cells.select("*", each).withColumn("__rank", target_rank(F.col("p"), F.col("n")))
    first = first.where((F.col("__rank") <= F.col("__upto")) & (F.col("__rank") > F.col("__upto") - F.col("__c")))
    below = (F.col("__upto") - F.col("__c")).alias("__below")
    kept = [F.col("__k0").alias("__lo"), F.col("__k1").alias("__hi"), F.col("__v0").alias("low"), F.col("__v1").alias("high")]
    state = stage(first.select(*by, "n", *kept, "p", below, "__rank"), "p1-state")
    # The bits of the span, halved first so that it can't overflow, set how far keys are shifted to give 2^BITS parts.
    open_ = (F.col("__hi") > F.col("__lo")) & (F.shiftright("__hi", 1) - F.shiftright("__lo", 1) >= (1 << tolerance_bits) // 2)
    finished: list[DataFrame] = []
    cols = [*by, "p", "n", "low", "high"]
    span = F.shiftright("__hi", 1) - F.shiftright("__lo", 1)
    shift = F.greatest(F.length(F.bin(span)) + 1 - BITS, F.lit(0)).cast("int")
    for k in range(max_passes):
        finished.append(state.where(~open_).select(*cols))
        todo = state.where(open_)
        if not todo.take(1):
            break
        cuts = small(todo.select(*by, "__lo", "__hi").distinct().withColumn("__s", shift), "p1-cuts")
        hit = rows.join(cuts, _same(rows, cuts, by) & rows["__key"].between(cuts["__lo"], cuts["__hi"])).select(
            *[rows[c] for c in by], "__lo", "__hi", "__s", "__key", "__v", "__w"
        )
        if k == 0:  # from here on only what lies in open intervals is read; equal values are one row
            kept_rows = hit.groupBy(*by, "__lo", "__hi", "__s", "__key").agg(F.min("__v").alias("__v"), F.sum("__w").alias("__w"))
            hit = stage(kept_rows, "p1-open")
            rows = hit.select(*by, "__key", "__v", "__w")  # intervals of a group are disjoint, so no row came twice
        part = F.expr("shiftright(__key, __s) - shiftright(__lo, __s)").alias("__part")
        counts = hit.groupBy(*by, "__lo", "__hi", part).agg(*stats)
        # At most 2^BITS + 1 parts an interval.
        counts = counts.withColumn("__upto", F.sum("__c").over(W.partitionBy(*by, "__lo", "__hi").orderBy("__part")))
        at = todo["__rank"] - todo["__below"]
        pick = todo.join(counts, _same(todo, counts, [*by, "__lo", "__hi"]) & (at <= counts["__upto"]) & (at > counts["__upto"] - counts["__c"]))
        state = stage(pick.select(*[todo[c] for c in by], "n", *kept, "p", (F.col("__below") + F.col("__upto") - F.col("__c")).alias("__below"), "__rank"), "p1-state")
    else:
        raise RuntimeError("an interval is still open")
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out.select(*by, "p", "n", F.col("low").alias("value"), "low", "high")


def summarise(values: DataFrame, by: Sequence[str], part: Sequence[str], value: str = "value") -> DataFrame:
    """Counts of fixed value cells for each group and part (a day, a block): ``by..., part..., __cell, __w``.

    Summaries of different parts, also made at different times, are combined by ``combine``.
    """
    cells = weighted(values, [*by, *part], value).withColumn("__cell", F.shiftright("__key", CELL_SHIFT))
    return cells.groupBy(*by, *part, "__cell").agg(F.sum("__w").alias("__w"))


def combine(summaries: DataFrame, by: Sequence[str]) -> DataFrame:
    return summaries.groupBy(*by, "__cell").agg(F.sum("__w").alias("__w"))


def key_value(key: Column) -> Column:
    """The double whose ordered key this is; the largest finite one for keys beyond it."""
    a = F.least(F.abs(key), F.lit(0x7FEFFFFFFFFFFFFF))
    e = F.greatest(F.shiftright(a, 52), F.lit(1).cast("long"))
    v = (a - (e - 1) * F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52)) * F.pow(F.lit(2.0), (e - 1023).cast("double"))
    return F.when(key < 0, -v).otherwise(v)


def from_summary(combined: DataFrame, by: Sequence[str], ps: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """``by..., p, n, low, high``: the percentile lies in ``[low, high]``, which is one cell.

    A cell spans at most 1/512 of its values, or ``2^-1031`` next to zero. The cells of a group are at most some 2^21
    whatever its rows, and a few thousand for a measurement; the running sum over them is by group.
    """
    by = _checked(by)
    w = W.partitionBy(*by)
    run = combined.withColumn("n", F.sum("__w").over(w)).withColumn("__upto", F.sum("__w").over(w.orderBy("__cell")))
    each = run.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps]))).withColumn("__rank", target_rank(F.col("p"), F.col("n")))
    hit = each.where((F.col("__rank") <= F.col("__upto")) & (F.col("__rank") > F.col("__upto") - F.col("__w")))
    low = F.shiftleft("__cell", CELL_SHIFT)
    return hit.select(*by, "p", "n", key_value(low).alias("low"), key_value(low + F.lit((1 << CELL_SHIFT) - 1)).alias("high"))


def readings(points: DataFrame) -> DataFrame:
    """``series_id, ts_ms, value``: finite values, one reading for each ``seq`` of a series.

    The copies of a record agree; were they not to, the lowest value counts. Records without ``seq`` are told apart by
    time and value.
    """
    rows = points.where(finite(F.col("value")))
    alone = F.col("seq").isNull()
    keys = [F.col("series_id"), F.col("seq"), F.when(alone, F.col("ts_ms")).alias("t"), F.when(alone, F.col("value")).alias("u")]
    return rows.groupBy(*keys).agg(F.min("ts_ms").alias("ts_ms"), F.min("value").alias("value")).select("series_id", "ts_ms", "value")


BY = ["scope", "name", "level"]


def _named(df: DataFrame, scope: str, name: Column, level: Column, *rest: Column) -> DataFrame:
    return df.select(F.lit(scope).alias("scope"), name.cast("string").alias("name"), level.cast("int").alias("level"), *rest)


def metrics_of(series: DataFrame) -> DataFrame:
    """One metric for each series, the lowest if several rows name different ones."""
    return series.where("series_id IS NOT NULL").groupBy("series_id").agg(F.min("metric").alias("metric"))


def all_values(points: DataFrame, series: DataFrame, buckets: DataFrame) -> DataFrame:
    """Weighted values of every group asked for: by series and by metric of the readings, by series and level of the
    buckets' ``p99`` and ``count`` (rows repeated in full count once). Readings of a series without metric count under a
    null name. The readings are staged once and read under both their names."""
    none = F.lit(None)
    base = stage(weighted(readings(points), ["series_id"]), "p1-readings")
    named = base.join(small(metrics_of(series), "p1-metrics"), "series_id", "left")
    rows = buckets.distinct().select("series_id", "level", "p99", F.col("count").cast("double").alias("count"))
    rows = stage(rows, "p1-buckets")
    vkw = [F.col("__v"), F.col("__key"), F.col("__w")]
    out = _named(base, "series", F.col("series_id"), none, *vkw).unionByName(_named(named, "metric", F.col("metric"), none, *vkw))
    for c in ("p99", "count"):
        out = out.unionByName(_named(weighted(rows, ["series_id", "level"], c), f"rollup_{c}", F.col("series_id"), F.col("level"), *vkw))
    return out


def all_summaries(points: DataFrame, series: DataFrame, buckets: DataFrame) -> DataFrame:
    """Daily summaries of the same groups."""
    none = F.lit(None)
    r = readings(points).withColumn("day", day_number(F.col("ts_ms")))
    s = stage(summarise(r, ["series_id"], ["day"]), "p1-daily")
    m = s.join(small(metrics_of(series), "p1-metrics"), "series_id", "left").groupBy("metric", "day", "__cell").agg(F.sum("__w").alias("__w"))
    rest = [F.col("day"), F.col("__cell"), F.col("__w")]
    out = _named(s, "series", F.col("series_id"), none, *rest).unionByName(_named(m, "metric", F.col("metric"), none, *rest))
    b = stage(buckets.distinct().select("series_id", "level", day_number(F.col("bucket_start")).alias("day"), "p99", F.col("count").cast("double").alias("count")), "p1-buckets")
    for c in ("p99", "count"):
        out = out.unionByName(_named(summarise(b, ["series_id", "level"], ["day"], c), f"rollup_{c}", F.col("series_id"), F.col("level"), *rest))
    return out
