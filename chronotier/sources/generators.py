"""Synthetic workloads, made on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_MS = 1_700_000_000_000


def burst(spark: SparkSession, n: int, series: int = 5) -> DataFrame:
    """``n`` points, a millisecond apart, dealt to the series in turn, with a saw-tooth value."""
    i = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("host=h"), i % series, F.lit(",metric=cpu")).alias("labels"), (i % series + 1).alias("series_id"),
        (F.lit(BASE_MS) + i).alias("ts_ms"), ((i % 100) * 0.1).alias("value"), i.alias("seq"),
    )


def drift(spark: SparkSession, n: int = 2000, series: int = 4) -> DataFrame:
    """Smooth sines, one second apart."""
    s, i = F.floor(F.col("id") / n), F.col("id") % n
    return spark.range(n * series).select(
        (s + 1).alias("series_id"), (F.lit(BASE_MS) + i * 1000).alias("ts_ms"), (40.0 + s * 5.0 + F.sin(i / 50.0) * 3.0).alias("value"), F.col("id").alias("seq"),
    )


def days(spark: SparkSession, n_days: int = 100, hosts: int = 3, per_day: int = 288) -> DataFrame:
    """A sine for each host, five minutes apart; ``day`` numbers the days."""
    p, rest = F.col("id") % per_day, F.floor(F.col("id") / per_day)
    h, d = rest % hosts, F.floor(rest / hosts)
    return spark.range(n_days * hosts * per_day).select(
        (h + 1).alias("series_id"), d.alias("day"), (F.lit(BASE_MS) + d * 86_400_000 + p * 300_000).alias("ts_ms"),
        (40.0 + h * 5.0 + F.sin(p / 20.0) * 3.0).alias("value"), F.col("id").alias("seq"),
    )


def label_sets(spark: SparkSession, n: int) -> DataFrame:
    """``n`` different label sets of three keys."""
    i = F.col("id")
    return spark.range(n).select(
        (i + 1).alias("series_id"), F.concat(F.lit("host=h"), i, F.lit(",metric=m"), i % 20, F.lit(",region=r"), i % 7).alias("labels")
    )
