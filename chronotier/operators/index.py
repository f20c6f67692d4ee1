"""Series identity and the label index.

A posting is a row ``(label, series_id)`` with ``label`` = ``key=value``. Written sorted by label, Parquet's row group
statistics make it a sorted index: equality and prefix predicates reach the scan and skip what can't match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import label_tokens
from ..session import stage


def dense_ids(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """``df`` with a LONG column ``name`` that counts the rows from ``start`` in the given order, without one big task.

    A range partitioned sort is staged with each row's partition and place in it; the offsets of the partitions, as
    many rows as there are partitions, then turn these into ids. Runs a job. An empty table stays empty.
    """
    at = F.monotonically_increasing_id()
    placed = stage(df.sort(*order).withColumn("__at", at), "dense_ids")
    split = placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__row", F.col("__at").bitwiseAND((1 << 33) - 1))
    sizes = sorted((r["__part"], r["n"]) for r in split.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], start
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    spark = df.sparkSession
    at_part = spark.createDataFrame(offsets or [(-1, 0)], "__part long, __offset long")
    joined = split.join(F.broadcast(at_part), "__part")  # as many rows as the sort had partitions
    return joined.withColumn(name, F.col("__offset") + F.col("__row")).select(*df.columns, name)


def assign_series(known: DataFrame, labels: DataFrame, next_id: int | None = None) -> DataFrame:
    """Series rows for label strings not known yet; ids go on from the highest one, in the order of ``first_seen``.

    ``labels`` has ``labels`` and ``first_seen``; ties are broken by the label string, null label strings are dropped.
    The same label string keeps its id for ever.
    """
    new = (
        labels.where(F.col("labels").isNotNull())
        .groupBy("labels")
        .agg(F.min("first_seen").alias("first_seen"))
        .join(known.select("labels"), "labels", "left_anti")
    )
    if next_id is None:
        next_id = (known.agg(F.max("series_id")).first()[0] or 0) + 1
    return dense_ids(new, ["first_seen", "labels"], "series_id", next_id).select("series_id", "labels")


def postings(series: DataFrame) -> DataFrame:
    """One row for each label of each series; a token that a series holds twice stays twice."""
    return series.select(F.explode(label_tokens(F.col("labels"))).alias("label"), "series_id")


def write_sorted(post: DataFrame, path: str, partitions: int = 8) -> None:
    """Writes postings range partitioned and sorted by label."""
    post.repartitionByRange(partitions, "label").sortWithinPartitions("label", "series_id").write.mode("overwrite").parquet(path)


def find(post: DataFrame, label: str) -> DataFrame:
    """Ids of the series that hold the label, ascending."""
    return post.where(F.col("label") == label).select("series_id").orderBy("series_id")


def intersect(post: DataFrame, matchers: Sequence[str]) -> DataFrame:
    """Ids of the series that hold every matcher; no matcher gives no series, and so does an unknown one."""
    wanted = sorted(set(matchers))
    if not wanted:
        return post.select("series_id").limit(0)
    hits = post.where(F.col("label").isin(wanted))
    if len(wanted) == 1:
        return hits.select("series_id").distinct()
    return hits.groupBy("series_id").agg(F.countDistinct("label").alias("__k")).where(F.col("__k") == len(wanted)).select("series_id")


def prefix(post: DataFrame, start: str) -> DataFrame:
    """A series id for each label that begins so, as a bag; the empty prefix gives every posting."""
    return post.where(F.col("label").startswith(start)).select("series_id")


def prefix_ordered(post: DataFrame, start: str) -> DataFrame:
    """The same in the order of labels, as a range scan of the sorted layout gives it."""
    upper = _after(start)
    hit = (F.col("label") >= start) & (F.col("label") < upper) if upper else F.col("label") >= start
    return post.where(hit).orderBy("label", "series_id").select("label", "series_id")


def _after(start: str) -> str | None:
    """The least string above all strings that begin with ``start``; none if there is no such string."""
    while start:
        last = ord(start[-1]) + 1
        if last == 0xD800:
            last = 0xE000
        if last <= 0x10FFFF:
            return start[:-1] + chr(last)
        start = start[:-1]
    return None


def index_stats(post: DataFrame) -> DataFrame:
    """Distinct labels, postings, and the bytes that labels and ids take."""
    return post.agg(
        F.countDistinct("label").alias("distinct_labels"),
        F.count(F.lit(1)).alias("postings"),
        (F.coalesce(F.sum(F.octet_length("label")), F.lit(0)) + 8 * F.count(F.lit(1))).alias("bytes"),
    )
