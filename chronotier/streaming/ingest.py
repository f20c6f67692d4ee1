"""Continuous ingestion and windowed rollups with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..engine import Engine, with_retry
from ..functions import nearest_rank


def ingest(stream: DataFrame, engine: Engine, checkpoint: str, name: str = "ingest") -> DataStreamWriter:
    """Writes ``labels, ts_ms, value[, seq]`` to the engine, exactly once.

    A batch is named after its number, and the commit that accepts its points also records the name; a batch that is
    replayed after a crash is hence refused. Late points are never dropped: they lie in a newer block.
    """

    def accept(df: DataFrame, batch_id: int) -> None:
        with_retry(lambda: engine.write(df, batch=f"{name}-{batch_id}"))

    return stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(accept)


def windowed_rollup(stream: DataFrame, width: str, watermark: str, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Tumbling ``count, min, max, avg, p99`` over ``ts TIMESTAMP, value``.

    With a watermark, which the compaction path doesn't have: the window that is still open is withheld, and rows later
    than the watermark are dropped.
    """
    win = F.window("ts", width)
    return (
        stream.withWatermark("ts", watermark)
        .groupBy(*by, win)
        .agg(F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg"), nearest_rank("value", 0.99).alias("p99"))
        .select(*by, F.unix_millis("window.start").alias("bucket_start"), "count", "min", "max", "avg", "p99")
    )
