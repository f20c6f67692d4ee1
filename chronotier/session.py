"""Session helpers: a test session, and tables staged in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a broadcast side may take at most, in memory.
BROADCAST_BYTES = 16 << 20

_FALLBACK: str | None = None


def local_session(app: str = "chronotier", cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and all of Spark runs in
    this process. A cluster without the setting raises: executors would write to disks of their own."""
    global _FALLBACK
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _FALLBACK is None:
        _FALLBACK = tempfile.mkdtemp(prefix="chronotier-")
        atexit.register(shutil.rmtree, _FALLBACK, ignore_errors=True)
    return _FALLBACK


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cuts lineage: writes ``df`` as a Parquet table in the shared folder and reads it back.

    The rows are in files that outlive any executor, hence a lost executor costs only the tasks it was running.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def memory_bytes(df: DataFrame) -> int:
    """Bytes of the rows of ``df`` as Spark holds them, about: eight a field, and what strings and arrays contain.

    One aggregation; meant for staged tables, which it reads without computing them again.
    """
    size = F.lit(0).cast("long")
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            size = size + 16 + 8 * F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + 16 + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            raise TypeError(f"column {f.name} has no simple size")
        else:
            size = size + 8
    return int(df.agg(F.coalesce(F.sum(size + 16), F.lit(0)).alias("b")).first()["b"])


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a staged ``df`` for a broadcast if its rows take at most ``limit`` bytes; a larger one is left to a shuffled
    join, which adaptive execution splits where a key is hot."""
    return F.broadcast(df) if memory_bytes(df) <= limit else df


def small(df: DataFrame, name: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` staged, so that it is computed once, and marked for a broadcast if it is small."""
    return broadcast_if_small(stage(df, name), limit)


def drop_stages(spark: SparkSession) -> None:
    """Deletes every table this application staged; for long sessions, when no result is in use any more."""
    jvm, root = spark.sparkContext._jvm, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    path = jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
