"""Command line: python -m chronotier.cli COMMAND DIR ... ; each command works on one engine directory.

write DIR N | recover DIR | compact DIR [WIDTH_MS [MIN_AGE_S]] | compact-rollup DIR LEVEL [WIDTH_MS [MIN_AGE_S]] |
consolidate DIR [ROWS] | vacuum DIR [AGE_S] | query DIR START END MATCHER... | bench DIR | cardbench DIR N... | indexbench DIR N | query-bench DIR | loadtest DIR N |
crashtest DIR FAILPOINT (kills its own process there)
"""

from __future__ import annotations

import os
import signal
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import DAY_MS, HOUR_MS, Engine
from .operators import blocks, codec, index, rollup, router
from .session import local_session
from .sources import generators


def _timed(action: Callable[[], object]) -> tuple[object, float]:
    began = time.time()
    return action(), time.time() - began


def _report(df: DataFrame) -> None:
    for row in df.collect():  # a few summary rows
        print("  ".join(f"{k}={v}" for k, v in row.asDict().items()))


def write(spark: SparkSession, root: str, n: int) -> None:
    e = Engine(spark, root, flush_threshold=20_000)
    count, took = _timed(lambda: e.write(generators.burst(spark, n).drop("series_id")))
    print(f"wrote {count} points in {took:.1f} s")
    _report(e.stats())


def recover(spark: SparkSession, root: str) -> None:
    e = Engine(spark, root)
    e.bootstrap()
    _report(e.stats())


def compact(spark: SparkSession, root: str, width: int = 60_000, min_age: int = 0) -> None:
    print(Engine(spark, root).compact(width, min_age))


def compact_rollup(spark: SparkSession, root: str, level: int, width: int = DAY_MS, min_age: int = 0) -> None:
    print(Engine(spark, root).compact_rollup(level, width, min_age))


def consolidate(spark: SparkSession, root: str, rows: int = 1_000_000) -> None:
    print(Engine(spark, root).consolidate(rows))


def vacuum(spark: SparkSession, root: str, age: int = 3600) -> None:
    print(f"deleted {len(Engine(spark, root).vacuum(age))} folders")


def query(spark: SparkSession, root: str, start: int, end: int, matchers: list[str]) -> None:
    e = Engine(spark, root)
    router.in_order(e.query(matchers, start, end)).show(100, truncate=False)
    _report(e.query_stats(matchers, start, end))


def bench(spark: SparkSession, root: str) -> None:
    """Compression of the live L0 blocks, by series and block."""
    e = Engine(spark, root)
    found = [e.scan(0, [b.block_id]).withColumn("block", F.lit(b.block_id)) for b in e.manifest.level(0)]
    if not found:
        print("no L0 blocks")
        return
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    _report(codec.compression_report(codec.stream_sizes(rows, ["series_id", "block"])))


def cardbench(spark: SparkSession, root: str, sizes: list[int]) -> None:
    """Lookup time on the sorted postings of so many label sets."""
    for n in sizes:
        path = f"{root}/postings-{n}"
        index.write_sorted(index.postings(generators.label_sets(spark, n)), path)
        post = spark.read.parquet(path)
        times = [_timed(lambda i=i: index.find(post, f"host=h{i * (n // 11) % n}").count())[1] for i in range(10)]
        print(f"{n} label sets: median lookup {sorted(times)[5] * 1000:.0f} ms")
        _report(index.index_stats(post))


def indexbench(spark: SparkSession, root: str, n: int) -> None:
    """Lookup, three-way intersection and prefix scan."""
    path = f"{root}/postings-{n}"
    index.write_sorted(index.postings(generators.label_sets(spark, n)), path)
    post = spark.read.parquet(path)
    for name, f in (
        ("lookup", lambda: index.find(post, "host=h7").count()),
        ("intersect", lambda: index.intersect(post, ["host=h7", "metric=m7", "region=r0"]).count()),
        ("prefix", lambda: index.prefix(post, "host=h1").count()),
    ):
        f()
        hits, took = _timed(f)
        print(f"{name}: {hits} hits in {took * 1000:.0f} ms")


def query_bench(spark: SparkSession, root: str) -> None:
    """100 days of three hosts, a block a day, the last two days not compacted: blocks scanned and skipped by range."""
    rows = generators.days(spark)
    raw = blocks.summarise(rows.where("day >= 98"), ["day"]).withColumn("level", F.lit(0))
    aged = blocks.summarise(rollup.downsample(rows.where("day < 98"), HOUR_MS, ("series_id", "day")), ["day"], "bucket_start").withColumn("level", F.lit(1))
    found, end = raw.unionByName(aged).cache(), generators.BASE_MS + 100 * DAY_MS
    for name, span in (("10 min", 600_000), ("3 days", 3 * DAY_MS), ("90 days", 90 * DAY_MS)):
        r, took = _timed(lambda span=span: router.route_stats(found, end - span, end).agg(F.sum("scanned"), F.sum("skipped")).first())
        print(f"{name}: scanned {r[0]}, skipped {r[1]} ({took * 1000:.0f} ms)")


def loadtest(spark: SparkSession, root: str, n: int) -> None:
    """Durable ingestion rate, one batch of ``n`` points at a time."""
    e = Engine(spark, root, flush_threshold=1 << 60)
    e.write(generators.burst(spark, 1000).drop("series_id"))
    for k in range(3):
        count, took = _timed(lambda: e.write(generators.burst(spark, n).drop("series_id")))
        print(f"batch {k}: {count / took:,.0f} points/s")


def crashtest(spark: SparkSession, root: str, point: str) -> None:
    """The process kills itself at the named failpoint, without any cleaning up; ``recover`` shows what is left."""

    def die(at: str) -> None:
        if at == point:
            os.kill(os.getpid(), signal.SIGKILL)

    e = Engine(spark, root, flush_threshold=1 << 60, failpoint=die)
    e.write(generators.burst(spark, 100).drop("series_id"))
    e.flush()
    e.compact(60_000)
    e.compact_rollup(1, HOUR_MS)


def main(argv: list[str]) -> None:
    if len(argv) < 2:
        sys.exit(__doc__)
    name, root, rest = argv[0], argv[1], argv[2:]
    commands = {
        "write": lambda s: write(s, root, int(rest[0])), "recover": lambda s: recover(s, root), "compact": lambda s: compact(s, root, *map(int, rest)),
        "consolidate": lambda s: consolidate(s, root, *map(int, rest)), "vacuum": lambda s: vacuum(s, root, *map(int, rest)),
        "compact-rollup": lambda s: compact_rollup(s, root, *map(int, rest)), "query": lambda s: query(s, root, int(rest[0]), int(rest[1]), rest[2:]),
        "bench": lambda s: bench(s, root), "cardbench": lambda s: cardbench(s, root, [int(x) for x in rest]), "indexbench": lambda s: indexbench(s, root, int(rest[0])),
        "query-bench": lambda s: query_bench(s, root), "loadtest": lambda s: loadtest(s, root, int(rest[0])), "crashtest": lambda s: crashtest(s, root, rest[0]),
    }
    if name not in commands:
        sys.exit(__doc__)
    commands[name](local_session("chronotier"))


if __name__ == "__main__":
    main(sys.argv[1:])
