"""Block summaries, manifest lines and what is computed from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summarise(rows: DataFrame, by: list[str], ts: str = "ts_ms") -> DataFrame:
    """``series_count, row_count, min_ts, max_ts`` of each block; rows that lie in no block (null) are left out."""
    inside = rows
    for c in by:
        inside = inside.where(F.col(c).isNotNull())
    return inside.groupBy(*by).agg(
        F.countDistinct("series_id").alias("series_count"), F.count(F.lit(1)).alias("row_count"),
        F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"),
    )


def block_number(filename: Column) -> Column:
    """The number in a block's file name, in whatever spelling of path, padding and case; null if there is none."""
    digits = F.regexp_extract(filename, r"(?i)(\d+)\.blk\s*$", 1)
    return F.when(digits != "", digits).try_cast("long")


def live_blocks(manifest: DataFrame, level: int | None = None) -> DataFrame:
    """``level, block_id`` of each live file once; lines without a level or a number are those of ``unreadable_lines``."""
    m = manifest if level is None else manifest.where(F.col("level") == level)
    return m.select("level", block_number(F.col("filename")).alias("block_id")).where("level IS NOT NULL AND block_id IS NOT NULL").distinct()


def unreadable_lines(manifest: DataFrame) -> DataFrame:
    """Lines that name no block: without a level, without a file name, or with one that holds no number."""
    return manifest.where(F.col("level").isNull() | block_number(F.col("filename")).isNull())


def check_levels(manifest: DataFrame) -> None:
    """Raises on a level the engine doesn't know; such a line is never dropped in silence. Runs a job."""
    bad = [r[0] for r in manifest.where(~F.col("level").isin(0, 1, 2, 3)).select("level").distinct().take(5)]
    if bad:
        raise ValueError(f"manifest lists unknown level(s) {bad}")


def eligible(blocks: DataFrame, level: int, now_ms: int, min_age_s: int) -> DataFrame:
    """Blocks of a level old enough to be compacted: by their file's age at ``now_ms``, not by their data's."""
    age = F.greatest(F.lit(0).cast("long"), F.lit(now_ms) - F.col("created_at"))
    return blocks.where((F.col("level") == level) & (age >= min_age_s * 1000))


def engine_stats(blocks: DataFrame, series: DataFrame) -> DataFrame:
    """Blocks and rows of each level and the number of series, in one row."""
    null = F.lit(None).cast("long")
    both = blocks.select("level", F.col("row_count").cast("long").alias("rows"), null.alias("series_id")).unionByName(
        series.select(F.lit(None).cast("int").alias("level"), null.alias("rows"), "series_id")
    )
    per = [
        (F.count_if(F.col("level") == n).alias(f"l{n}_blocks"), F.coalesce(F.sum(F.when(F.col("level") == n, F.col("rows"))), F.lit(0)).alias(f"l{n}_rows"))
        for n in range(4)
    ]
    return both.agg(*[c for pair in per for c in pair], F.countDistinct("series_id").alias("series"))
