"""The driver's tables seen as labelled points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical_labels, to_millis
from ..operators import index
from ..session import table


def _labels(**pairs) -> F.Column:
    entries = [x for k, v in pairs.items() for x in (F.lit(k), v)]
    return canonical_labels(F.create_map(*entries))


def event_points(spark: SparkSession, d: str) -> DataFrame:
    """``labels, ts_ms, value, seq`` of the events."""
    return table(spark, d, "events").select(
        _labels(user_id=F.col("user_id").cast("string"), event_type=F.col("event_type")).alias("labels"),
        to_millis(F.col("ts")).alias("ts_ms"), "value", F.col("event_id").alias("seq"),
    )


def lineitem_points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        _labels(returnflag=F.col("l_returnflag"), linestatus=F.col("l_linestatus")).alias("labels"),
        to_millis(F.col("l_shipdate")).alias("ts_ms"), F.col("l_extendedprice").alias("value"),
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("seq"),
    )


def order_points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        _labels(status=F.col("o_orderstatus"), priority=F.col("o_orderpriority")).alias("labels"),
        to_millis(F.col("o_orderdate")).alias("ts_ms"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq"),
    )


def event_series(spark: SparkSession, d: str) -> DataFrame:
    """``series_id, labels``: ids count from 1 in the order of first appearance."""
    seen = event_points(spark, d).groupBy("labels").agg(F.min("seq").alias("first_seen"))
    return index.dense_ids(seen, ["first_seen", "labels"], "series_id").select("series_id", "labels")


def event_postings(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(event_series(spark, d))


def series_postings(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(table(spark, d, "series"))
