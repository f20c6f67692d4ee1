"""Query routing: label matchers and a half-open time range over raw points and three rollup levels.

Rows keep the level they come from; levels are put side by side and never blended.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import RESULT
from . import index


def overlaps(start: int, end: int) -> Column:
    """Whether a block, which is closed at both ends, reaches into ``[start, end)``; a block without times does not."""
    return F.coalesce((F.col("min_ts") < F.lit(end)) & (F.col("max_ts") >= F.lit(start)), F.lit(False))


def route_stats(blocks: DataFrame, start: int, end: int, levels: Sequence[int] = (0, 1, 2, 3)) -> DataFrame:
    """Blocks to be read and blocks skipped for each level, from the block summaries alone."""
    spark = blocks.sparkSession
    every = spark.createDataFrame([(n,) for n in levels], "level int")
    seen = blocks.groupBy("level").agg(
        F.count_if(overlaps(start, end)).alias("scanned"), F.count_if(~overlaps(start, end)).alias("skipped")
    )
    return every.join(seen, "level", "left").select(
        "level", F.coalesce("scanned", F.lit(0)).alias("scanned"), F.coalesce("skipped", F.lit(0)).alias("skipped")
    )


def raw_range(points: DataFrame, ids: DataFrame, start: int, end: int) -> DataFrame:
    """Points of the given series with ``start <= ts_ms < end``; every copy of a point comes out."""
    return points.where((F.col("ts_ms") >= start) & (F.col("ts_ms") < end)).join(ids.select("series_id").distinct(), "series_id", "left_semi")


def rollup_range(rollup: DataFrame, ids: DataFrame, start: int, end: int, include_partial_ms: int | None = None) -> DataFrame:
    """Buckets of the given series by their start alone, so one that straddles ``start`` is left out.

    With ``include_partial_ms``, the width of a bucket, buckets that reach into the range come out too.
    """
    first = start if include_partial_ms is None else start - include_partial_ms + 1
    b = F.col("bucket_start")
    return rollup.where((b >= first) & (b < end)).join(ids.select("series_id").distinct(), "series_id", "left_semi")


def tag_points(points: DataFrame) -> DataFrame:
    null = F.lit(None).cast("double")
    return points.select(
        "series_id", F.lit(0).alias("level"), "ts_ms", "value", F.lit(None).cast("long").alias("count"),
        null.alias("min"), null.alias("max"), null.alias("avg"), null.alias("p99"),
    )


def tag_rollup(rollup: DataFrame, level: int) -> DataFrame:
    return rollup.select(
        "series_id", F.lit(level).alias("level"), F.col("bucket_start").alias("ts_ms"),
        F.lit(None).cast("double").alias("value"), "count", "min", "max", "avg", "p99",
    )


def stitch(
    points: DataFrame | None, rollups: Mapping[int, DataFrame], post: DataFrame, matchers: Sequence[str], start: int, end: int,
    include_partial_ms: Mapping[int, int] | None = None,
) -> DataFrame:
    """Raw rows and rollup rows of the matched series, tagged with their level. No matcher gives no rows."""
    ids = index.intersect(post, matchers)
    widths = include_partial_ms or {}
    parts = [tag_points(raw_range(points, ids, start, end))] if points is not None else []
    parts += [tag_rollup(rollup_range(r, ids, start, end, widths.get(n)), n) for n, r in sorted(rollups.items())]
    if not parts:
        return post.sparkSession.createDataFrame([], RESULT)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def in_order(result: DataFrame) -> DataFrame:
    """Rows by series and level; raw rows by time and value, buckets by start."""
    return result.orderBy("series_id", "level", "ts_ms", "value")


def with_all_matched(result: DataFrame, ids: DataFrame) -> DataFrame:
    """Every matched series with its number of raw and rollup rows, 0 where it has no data in the range."""
    per = result.groupBy("series_id").agg(
        *[F.count_if(F.col("level") == n).alias(name) for n, name in enumerate(("raw_rows", "l1_rows", "l2_rows", "l3_rows"))]
    )
    return ids.select("series_id").distinct().join(per, "series_id", "left").na.fill(0)


def nested(result: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each matched series with sorted arrays of its raw points and of its buckets by level.

    For presentation of a bounded range: the rows of a series end up in one row. Large results stay in long form.
    """
    point = F.when(F.col("level") == 0, F.struct("ts_ms", "value"))

    def bucket(n: int) -> Column:
        row = F.struct(F.col("ts_ms").alias("bucket_start"), "count", "min", "max", "avg", "p99")
        return F.array_sort(F.collect_list(F.when(F.col("level") == n, row))).alias(f"l{n}")

    per = result.groupBy("series_id").agg(F.array_sort(F.collect_list(point)).alias("raw"), *[bucket(n) for n in (1, 2, 3)])
    out = ids.select("series_id").distinct().join(per, "series_id", "left")
    kinds = dict(per.dtypes)
    return out.select("series_id", *[F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in ("raw", "l1", "l2", "l3")])
