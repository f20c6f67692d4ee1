"""Irregular readings onto a regular grid, with shape-preserving (monotone) cubic interpolation.

A time shard is ``SHARD`` slots of a series. Its readings shrink to one knot a slot, so a shard is bounded however many
readings a hot series sends, and its neighbours send it their outermost knots as a halo. All of it is built-in
expressions; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import finite
from ..session import small

SHARD = 4096
#: A silence longer than this ends the series for then.
MAX_GAP_MS = 72 * 3_600_000


def knots(points: DataFrame, series: DataFrame) -> DataFrame:
    """One row for each slot that holds a reading: its first and last time and its latest value (by time, then ``seq``).

    A slot is a multiple of ``step_ms`` and holds ``slot_ms <= ts_ms < slot_ms + step_ms``. Null, NaN and infinite
    values are no readings; rows without a time, and of series without a positive ``step_ms``, are dropped. A series
    listed more than once has its smallest step.
    """
    steps = series.where("step_ms > 0 AND series_id IS NOT NULL").groupBy("series_id").agg(F.min("step_ms").alias("step_ms"))
    rows = points.where(finite(F.col("value")) & F.col("ts_ms").isNotNull()).select("series_id", "ts_ms", "value", "seq")
    slot = F.col("ts_ms") - F.pmod("ts_ms", "step_ms")
    return (
        rows.join(small(steps, "p5-steps"), "series_id")
        .groupBy("series_id", "step_ms", slot.alias("slot_ms"))
        .agg(F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("ts"), F.max_by("value", F.struct("ts_ms", "seq", "value")).alias("value"))
    )


def _slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """Slope at a knot between two intervals: 0 at a turn, else a weighted harmonic mean of both secants."""
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when((d0 * d1 <= 0) | d0.isNull() | d1.isNull(), 0.0).otherwise((w0 + w1) / (w0 / d0 + w1 / d1))


def _end_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """Slope at the end of a segment: three-point formula, limited so that the curve stays monotone."""
    s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return F.when(d1.isNull(), d0).when(s * d0 <= 0, 0.0).when((d0 * d1 <= 0) & (F.abs(s) > F.abs(3 * d0)), 3 * d0).otherwise(s)


def regrid(points: DataFrame, series: DataFrame, max_fill_ms: int = 6 * 3_600_000, max_gap_ms: int = MAX_GAP_MS) -> DataFrame:
    """``series_id, slot_ms, value, status`` for each slot from the first to the last reading of each segment.

    ``observed`` slots have the latest reading in them, as it was sent and whenever in the slot that was; the curve runs
    through these readings at their own times. A slot without a reading is ``filled`` with the curve's value at its start if the silence around it is at most ``max_fill_ms``, else ``missing`` with a null value. A silence of more
    than ``max_gap_ms`` ends the segment: its slots don't come out.
    """
    width = F.col("step_ms") * SHARD
    k = knots(points, series).withColumn("shard", F.floor(F.col("slot_ms") / width).cast("long"))
    place = W.partitionBy("series_id", "shard").orderBy("slot_ms")
    k = k.withColumn("rank", F.row_number().over(place)).withColumn("size", F.count(F.lit(1)).over(W.partitionBy("series_id", "shard")))
    # Two knots at either end go to each shard that a silence of the longest length could bridge.
    far = F.ceil(F.lit(max_gap_ms) / width).cast("long") + 1
    down = F.when(F.col("rank") <= 2, F.sequence(-far, F.lit(-1)))
    up = F.when(F.col("rank") > F.col("size") - 2, F.sequence(F.lit(1).cast("long"), far))
    none = F.array().cast("array<bigint>")
    moves = F.concat(F.array(F.lit(0).cast("long")), F.coalesce(down, none), F.coalesce(up, none))
    sent = k.withColumn("move", F.explode(moves)).withColumn("shard", F.col("shard") + F.col("move")).drop("rank", "size")
    w = W.partitionBy("series_id", "shard").orderBy("slot_ms")
    at = lambda c, n: F.lag(c, n).over(w) if n > 0 else F.lead(c, -n).over(w)
    t0, t1 = F.col("ts"), F.col("__t1")
    s = sent.withColumns({
        "__slot1": at("slot_ms", -1), "__first1": at("first_ts", -1), "__t1": at("ts", -1), "__v1": at("value", -1),
        "__first2": at("first_ts", -2), "__t2": at("ts", -2), "__v2": at("value", -2), "__tm": at("ts", 1), "__vm": at("value", 1),
    })
    # The first reading of the next slot decides whether the silence ends the segment.
    s = s.where("move = 0").withColumn("__gap", F.col("__first1") - t0)
    joined = F.coalesce(F.col("__gap") <= max_gap_ms, F.lit(False))
    # Beyond a silence that ends the segment there is no secant.
    before = F.when(F.col("first_ts") - F.col("__tm") <= max_gap_ms, t0 - F.col("__tm"))
    after = F.when(F.col("__first2") - t1 <= max_gap_ms, F.col("__t2") - t1)
    s = s.withColumns({"__h": (t1 - t0).cast("double"), "__hm": before.cast("double"), "__hp": after.cast("double")})
    h, hm, hp = F.col("__h"), F.col("__hm"), F.col("__hp")
    s = s.withColumns({"__d": (F.col("__v1") - F.col("value")) / h, "__dm": (F.col("value") - F.col("__vm")) / hm, "__dp": (F.col("__v2") - F.col("__v1")) / hp})
    d, dm, dp = F.col("__d"), F.col("__dm"), F.col("__dp")
    s = s.withColumns({
        "__m0": F.when(dm.isNull(), _end_slope(h, hp, d, dp)).otherwise(_slope(hm, h, dm, d)),
        "__m1": F.when(dp.isNull(), _end_slope(h, hm, d, dm)).otherwise(_slope(h, hp, d, dp)),
    })
    step = F.col("step_ms")
    bridged = joined & (F.col("__slot1") > F.col("slot_ms") + step)
    slots = F.when(bridged, F.sequence(F.col("slot_ms"), F.col("__slot1") - step, step)).otherwise(F.array("slot_ms"))
    rows = s.withColumn("slot", F.explode(slots))
    x = (F.col("slot") - t0) / h
    x2, x3 = x * x, x * x * x
    y = (2 * x3 - 3 * x2 + 1) * F.col("value") + (x3 - 2 * x2 + x) * h * F.col("__m0") + (3 * x2 - 2 * x3) * F.col("__v1") + (x3 - x2) * h * F.col("__m1")
    # Rounding may leave the interval of both ends by an ulp.
    y = F.greatest(F.least("value", "__v1"), F.least(F.greatest("value", "__v1"), y))
    own, short = F.col("slot") == F.col("slot_ms"), F.col("__gap") <= max_fill_ms
    return rows.select(
        "series_id", F.col("slot").alias("slot_ms"), F.when(own, F.col("value")).when(short, y).alias("value"),
        F.when(own, "observed").when(short, "filled").otherwise("missing").alias("status"),
    )


def missing_slots(grid: DataFrame) -> DataFrame:
    """Slots of the grid that hold no reading."""
    return grid.where(F.col("status") != "observed").select("series_id", "slot_ms")
