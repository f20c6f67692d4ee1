"""Downsampling of points and merging of rollup buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bucket_start, nearest_rank


def last_write_wins(points: DataFrame, keys: list[str], seq: Column, value: str = "value") -> DataFrame:
    """One row for each key: the value of the highest ``seq``.

    It is a partial aggregation, so repeated writes of a hot key shrink before the shuffle. Nulls in the keys group
    together; rows whose ``seq`` is null lose against any other, and a key that has only such rows gives a null value.
    """
    return points.groupBy(*keys).agg(F.max_by(value, seq).alias(value))


def downsample(points: DataFrame, width_ms: int, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """``count, min, max, avg, p99`` for each series and bucket that holds a point.

    Rows without a time are dropped; a null value is counted nowhere and a bucket of nulls only is not emitted. NaN
    orders above every number, as everywhere in Spark. A point given twice counts twice.
    """
    p = points.where(F.col("ts_ms").isNotNull() & F.col("value").isNotNull())
    return p.groupBy(*by, bucket_start(F.col("ts_ms"), width_ms).alias("bucket_start")).agg(
        F.count("value").alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("avg"),
        nearest_rank("value", 0.99).alias("p99"),
    )


def merge_rollups(rollup: DataFrame, width_ms: int, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Coarser buckets out of finer ones.

    ``count`` is summed, the extremes are kept, ``avg`` and ``p99`` are means weighted by ``count``; the merged ``p99``
    is hence no percentile of the points. A source bucket falls where its start falls and is never split. Buckets with
    no start or no count are dropped, and so are those of count 0; a null ``avg`` or ``p99`` is left out of its mean,
    with its weight.
    """
    r = rollup.where(F.col("bucket_start").isNotNull() & (F.col("count") > 0))

    def mean(name: str) -> Column:
        weight = F.when(F.col(name).isNotNull(), F.col("count"))
        return (F.sum(F.col(name) * weight) / F.sum(weight)).alias(name)

    return r.groupBy(*by, bucket_start(F.col("bucket_start"), width_ms).alias("bucket_start")).agg(
        F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"), mean("avg"), mean("p99")
    )


def consolidate(rollup: DataFrame, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Merges rows that share a bucket, as late blocks and second compaction runs leave them (``p99`` becomes a mean)."""
    keyed = rollup.withColumn("__start", F.col("bucket_start"))
    return merge_rollups(keyed, 1, by).select(*by, "bucket_start", "count", "min", "max", "avg", "p99")


def p99_divergence(points: DataFrame, fine_ms: int, coarse_ms: int) -> DataFrame:
    """Merged against true ``p99`` for each series and coarse bucket, with the relative error of the merged one."""
    merged = merge_rollups(downsample(points, fine_ms), coarse_ms).select("series_id", "bucket_start", F.col("p99").alias("merged_p99"))
    true = downsample(points, coarse_ms).select("series_id", "bucket_start", F.col("p99").alias("true_p99"))
    error = F.abs(F.col("merged_p99") - F.col("true_p99")) / F.nullif(F.abs(F.col("true_p99")), F.lit(0.0))
    return merged.join(true, ["series_id", "bucket_start"]).withColumn("divergence", error)


def duplicate_buckets(rollup: DataFrame) -> DataFrame:
    """Buckets held by more than one row of a level."""
    return rollup.groupBy("series_id", "level", "bucket_start").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
