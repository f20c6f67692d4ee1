from pyspark.sql import functions as F

from chronotier.engine import Engine
from chronotier.streaming.ingest import ingest, windowed_rollup


def source(spark, path, n):
    df = spark.range(n).select(F.concat(F.lit("host=h"), F.col("id") % 2).alias("labels"), (F.col("id") * 1000).alias("ts_ms"), F.col("id").cast("double").alias("value"), F.col("id").alias("seq"))
    df.repartition(3).write.mode("append").parquet(path)
    return df.schema


def test_stream_resumes_without_loss_or_repeat(spark, tmp_path):
    src, ck = str(tmp_path / "src"), str(tmp_path / "ck")
    schema = source(spark, src, 60)
    e = Engine(spark, str(tmp_path / "db"), flush_threshold=1 << 30)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        ingest(stream, e, ck, "s").trigger(availableNow=True).start().awaitTermination()

    run()
    assert e.memtable().count() == 60
    run()
    assert e.memtable().count() == 60
    e.flush()
    assert e.query(["host=h1"], 0, 1 << 60).count() == 30


def test_a_replayed_batch_is_refused(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = source(spark, src, 12)
    e = Engine(spark, str(tmp_path / "db"), flush_threshold=1 << 30)
    for ck in ("one", "two"):  # a lost checkpoint replays from the first batch
        stream = spark.readStream.schema(schema).parquet(src)
        ingest(stream, e, str(tmp_path / ck), "same").trigger(availableNow=True).start().awaitTermination()
    assert e.memtable().count() == 12


def test_watermark_withholds_the_open_window(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows = [("a", i * 1000, float(i)) for i in range(30)]
    spark.createDataFrame(rows, "labels string, ts_ms long, value double").withColumn("ts", F.timestamp_millis("ts_ms")).coalesce(1).write.parquet(src)
    stream = windowed_rollup(spark.readStream.schema("labels string, ts_ms long, value double, ts timestamp").parquet(src), "10 seconds", "1 second", ("labels",))
    w = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append")
    w.trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["bucket_start"], r["count"], r["p99"]) for r in spark.read.schema(stream.schema).parquet(out).collect())
    assert got == [(0, 10, 9.0), (10_000, 10, 19.0)]
