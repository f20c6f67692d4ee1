"""Totals and means over trailing periods for each series and day, silent days included.

Series by days are packed into dense blocks, which banded window operators multiply. A block is a tile of ``TILE`` days
of at most about ``SHARD`` series with the days before it (for the windows) and after it (for the length of a silence).
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import day_number
from ..session import stage

TILE, SHARD = 64, 512
#: A silence of so many days or more ends a series for then.
END_OF_SERIES = 20


def schema(windows: tuple[int, ...]) -> str:
    each = [f"count_{w} long, avg_{w} double, active_days_{w} long" for w in windows]
    return ", ".join(["series_id long, day long, day_utc string, active boolean", *each, "silence_days int"])


def daily(buckets: DataFrame) -> DataFrame:
    """``series_id, day, n, total, weight`` from levels 1 and 2.

    Rows repeated in full count once, the same bucket from two compaction runs counts twice. Rows without series or
    start are dropped; a null count is 0; an ``avg`` that is null or not finite stays out of the mean with its weight.
    """
    cols = ["series_id", "level", "bucket_start", "count", "min", "max", "avg", "p99", "block_id"]
    rows = buckets.where("level IN (1, 2) AND series_id IS NOT NULL AND bucket_start IS NOT NULL").select(*cols).distinct()
    n = F.coalesce("count", F.lit(0))
    usable = F.when(F.abs("avg") < float("inf"), n)
    return rows.groupBy("series_id", day_number(F.col("bucket_start")).alias("day")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.abs("avg") < float("inf"), F.col("avg") * n)).alias("total"), F.sum(usable).alias("weight")
    )


def banded(window: int, before: int, tile: int, after: int) -> np.ndarray:
    """The operator that sums the ``window`` days up to and with each day of a tile."""
    row, col = np.arange(before + tile + after)[:, None], np.arange(tile)[None, :] + before
    return ((row <= col) & (row > col - window)).astype(np.int64)


def silence_lengths(active: np.ndarray, cap: int) -> np.ndarray:
    """Length of the run of inactive days each cell lies in, 0 where active; ``cap`` where the run is as long or longer.

    A run that reaches the edge of the array counts as ``cap``.
    """
    width = active.shape[1]
    at = np.arange(width)[None, :]
    before = np.maximum.accumulate(np.where(active, at, -cap - 1), axis=1)
    after = np.minimum.accumulate(np.where(active, at, width + cap)[:, ::-1], axis=1)[:, ::-1]
    return np.where(active, 0, np.minimum(after - before - 1, cap))


def trailing(buckets: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Each day from the first to the last with a bucket, for each series: sums of ``count``, means of ``avg`` weighted
    by ``count``, and days with activity over each window, which ends with that day: ``count_7, avg_7, active_days_7, ...``.

    ``silence_days`` is the length of the inactive run that holds the day: 0 on an active day, 20 also for longer runs
    and for those before the first or after the last activity. A window without weight has a null mean. An empty table
    gives no rows. Stages the daily sums, which are far fewer than the buckets.
    """
    if not windows or min(windows) < 1 or len(set(windows)) < len(windows):
        raise ValueError("windows must be different numbers of days")
    before, after = max(max(windows) - 1, END_OF_SERIES), END_OF_SERIES
    days = stage(daily(buckets), "daily")
    shards = max(1, -(-days.agg(F.approx_count_distinct("series_id")).first()[0] // SHARD))
    tile = F.floor(F.col("day") / TILE).cast("long")
    place = F.col("day") - tile * TILE
    # A day goes to its own tile and, as a halo, to each tile whose surroundings reach it.
    reach = [(k, F.lit(True) if k == 0 else place >= k * TILE - before if k > 0 else place < (k + 1) * TILE + after) for k in range(-(-(-after // TILE)), -(-before // TILE) + 1)]
    targets = F.filter(F.array(*[F.when(cond, tile + k) for k, cond in reach]), lambda t: t.isNotNull())
    null = F.lit(None)
    halo = days.select("series_id", F.explode(targets).alias("tile"), "day", "n", "total", "weight", null.cast("long").alias("first"), null.cast("long").alias("last"))
    span = days.groupBy("series_id").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    edge = lambda c: F.floor(F.col(c) / TILE).cast("long")
    spine = span.select(
        "series_id", F.explode(F.sequence(edge("first"), edge("last"))).alias("tile"), null.cast("long").alias("day"), null.cast("long").alias("n"),
        null.cast("double").alias("total"), null.cast("long").alias("weight"), "first", "last",
    )
    ops = [(w, banded(w, before, TILE, after)) for w in windows]

    def block(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        start = int(key[1]) * TILE
        head = pdf[pdf["day"].isna()].sort_values("series_id")
        ids = head["series_id"].to_numpy()
        cells = pdf[pdf["day"].notna() & pdf["series_id"].isin(ids)]
        row = np.searchsorted(ids, cells["series_id"].to_numpy())
        col = cells["day"].to_numpy().astype(np.int64) - start + before
        shape = (len(ids), before + TILE + after)
        n, weight, total = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape)
        n[row, col] = cells["n"].fillna(0)
        weight[row, col] = cells["weight"].fillna(0)
        total[row, col] = cells["total"].fillna(0.0)
        active = n > 0
        day = np.arange(start, start + TILE)
        inside = (day >= head["first"].to_numpy()[:, None]) & (day <= head["last"].to_numpy()[:, None])
        r, c = np.nonzero(inside)
        out = {"series_id": ids[r], "day": day[c], "day_utc": day[c].astype("datetime64[D]").astype(str), "active": active[r, c + before]}
        for name, op in ops:
            w, t = (weight @ op)[r, c], (total @ op)[r, c]
            out[f"count_{name}"] = (n @ op)[r, c]
            out[f"avg_{name}"] = np.where(w > 0, t / np.maximum(w, 1), np.nan)
            out[f"active_days_{name}"] = (active.astype(np.int64) @ op)[r, c]
        out["silence_days"] = silence_lengths(active, END_OF_SERIES)[r, c + before]
        return pd.DataFrame(out)

    shard = F.pmod(F.xxhash64("series_id"), F.lit(shards)).alias("shard")
    out = halo.unionByName(spine).withColumn("shard", shard).groupBy("shard", "tile").applyInPandas(block, schema(windows))
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in (f"avg_{w}" for w in windows)})


def silent_weeks(totals: DataFrame) -> DataFrame:
    """Days whose last seven days are silent, inside a silence that ends within fewer than 20 days."""
    return totals.where((F.col("active_days_7") == 0) & (F.col("silence_days") < END_OF_SERIES)).select("series_id", "day_utc")
