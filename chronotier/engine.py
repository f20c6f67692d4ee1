"""The storage engine: durable ingestion, flush to blocks, compaction through the levels, routed queries.

Layout under the root: ``staging/<batch>`` holds accepted points that are in no block yet (what a log and a memory
table are elsewhere), ``L0 .. L3/<block>`` immutable Parquet blocks, ``series/<n>`` the label dictionary, and
``_manifest`` names what is live. What the manifest doesn't name does not exist for a reader. Commits delete nothing:
what they take off the lists is marked as retired and stays, for results that still read it, until ``vacuum`` finds it old
enough.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import canonical_labels
from .operators import blocks as block_ops
from .operators import index, rollup, router
from .operators.consolidation import VerificationError, first_fit_decreasing, point_hash
from .schemas import POINTS, RESULT, ROLLUP, SERIES, STAGED
from .sources.manifest import Block, CommitConflict, Manifest, ManifestStore

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
FOLDERS = ("L0", "L1", "L2", "L3", "staging", "series")
#: Points that a block of consolidated ones holds, about.
ROWS_PER_BLOCK = 1_000_000
#: Marks a folder that a commit has taken off the lists; Spark reads past names that begin so.
RETIRED = "_retired"


@dataclass(frozen=True)
class Compaction:
    ran: bool
    source_blocks: int = 0
    source_rows: int = 0
    target_rows: int = 0


@dataclass(frozen=True)
class Consolidated:
    ran: bool
    source_blocks: int = 0
    target_blocks: int = 0
    rows: int = 0


class Engine:
    """``clock`` gives unix milliseconds; ``failpoint`` is called with a name around each commit, for tests.

    ``flush_threshold`` counts distinct (series, time) keys, as they would come out of the flush. ``grace_s`` is how long
    retired files stay at least, which should exceed the longest job that reads or writes here.
    """

    def __init__(
        self, spark: SparkSession, root: str, flush_threshold: int = 50_000, clock: Callable[[], int] | None = None,
        failpoint: Callable[[str], None] | None = None, grace_s: int = 3600,
    ):
        self.spark, self.root, self.flush_threshold, self.grace_s = spark, root.rstrip("/"), flush_threshold, grace_s
        self.clock = clock or (lambda: int(time.time() * 1000))
        self.failpoint = failpoint or (lambda name: None)
        self.store = ManifestStore(spark, self.root)

    # ---- reading the state

    @property
    def manifest(self) -> Manifest:
        return self.store.load()

    def series(self, m: Manifest | None = None) -> DataFrame:
        files = (m or self.manifest).series_files
        return self.spark.read.schema(SERIES).parquet(*files) if files else self.spark.createDataFrame([], SERIES)

    def postings(self) -> DataFrame:
        return index.postings(self.series())

    def memtable(self, m: Manifest | None = None) -> DataFrame:
        """Points accepted but not flushed, the last write of each key only."""
        staged = (m or self.manifest).staged
        if not staged:
            return self.spark.createDataFrame([], POINTS)
        rows = self.spark.read.schema(STAGED).option("recursiveFileLookup", "true").parquet(*staged)
        batch = F.regexp_extract(F.input_file_name(), r"/staging/(\d+)-", 1).cast("long")
        newest = rollup.last_write_wins(rows.withColumn("__batch", batch), ["series_id", "ts_ms"], F.struct("__batch", "seq", "value"))
        return newest.select("series_id", "ts_ms", "value")

    def _read(self, found: Sequence[Block], level: int) -> DataFrame:
        schema = POINTS if level == 0 else ROLLUP
        if wrong := [b for b in found if b.level != level]:
            raise ValueError(f"block {wrong[0].block_id} is of level {wrong[0].level}, not {level}")
        return self.spark.read.schema(schema).parquet(*[b.path for b in found]) if found else self.spark.createDataFrame([], schema)

    def scan(self, level: int, block_ids: Sequence[int] | None = None) -> DataFrame:
        """Rows of the live blocks of a level, or of those named; a name that isn't live at this level raises."""
        live = {b.block_id: b for b in self.manifest.level(level)}
        ids = list(live) if block_ids is None else list(block_ids)
        if missing := [i for i in ids if i not in live]:
            raise ValueError(f"no block {missing[0]} at level {level}")
        return self._read([live[i] for i in ids], level)

    # ---- ingestion

    def write(self, points: DataFrame, batch: str | None = None) -> int:
        """Accepts points: ``labels`` (canonical string or map), ``ts_ms``, ``value``, and ``seq`` if the order counts.

        Durable and visible to queries once it returns. A batch name that was accepted before is not accepted again, so
        a replayed stream batch changes nothing. Rows without labels or time are dropped. Returns the points staged.
        """
        m = self.manifest
        if batch and _accepted(batch, m.batches):
            return 0
        labels = F.col("labels")
        if dict(points.dtypes)["labels"].startswith("map"):
            labels = canonical_labels(labels)
        seq = F.col("seq").cast("long") if "seq" in points.columns else F.monotonically_increasing_id()
        rows = points.select(labels.alias("labels"), F.col("ts_ms").cast("long").alias("ts_ms"), F.col("value").cast("double").alias("value"), seq.alias("seq")).where("labels IS NOT NULL AND ts_ms IS NOT NULL")
        series, known = None, self.series(m)
        new = index.assign_series(known, rows.select("labels", F.col("seq").alias("first_seen")), m.next_series)
        path = f"{self.root}/series/{m.version:012d}-{uuid.uuid4().hex[:8]}"
        new.write.parquet(path)
        added = self.spark.read.schema(SERIES).parquet(path)
        n_new = added.count()
        series = known.unionByName(added) if n_new else known
        if not n_new:
            self.store.files.delete(path)
        staged = f"{self.root}/staging/{m.version:012d}-{uuid.uuid4().hex[:8]}"
        rows.join(series, "labels").select("series_id", "ts_ms", "value", "seq").write.parquet(staged)
        self.failpoint("post_stage_pre_manifest")
        m = replace(
            m, next_series=m.next_series + n_new, series_files=m.series_files + ((path,) if n_new else ()),
            staged=m.staged + (staged,), batches=_with_batch(batch, m.batches) if batch else m.batches,
        )
        try:
            self.store.commit(m)
        except CommitConflict:  # the next attempt writes its own
            for p in (path, staged):
                self.store.files.delete(p)
            raise
        count = self.spark.read.schema(STAGED).parquet(staged).count()
        # Rows are counted from file footers; keys only once there are rows enough.
        waiting = self.spark.read.schema(STAGED).option("recursiveFileLookup", "true").parquet(*m.staged)
        if waiting.count() >= self.flush_threshold and self.memtable().count() >= self.flush_threshold:
            self.flush()
        return count

    def flush(self) -> Block | None:
        """Makes one L0 block of what is staged; nothing staged, nothing done.

        The same commit takes the block in and the staged batches out, so a crash on either side of it neither loses
        nor repeats a point.
        """
        m = self.manifest
        if not m.staged:
            return None
        block = self._write_block(self.memtable(m), 0, m.next_block)
        self.failpoint("post_l0_write_pre_manifest")
        self._commit(m, m.staged, m.swap([], [block] if block.row_count else []), "post_manifest_pre_wal_unlink", next_block=m.next_block + 1, staged=())
        return block

    def flush_blocks(self, rows_per_block: int) -> list[Block]:
        """As ``flush``, but makes blocks of about ``rows_per_block`` points, cut by time, however many are staged.

        Bounds come from a sample. All blocks are written by one job, a task each, and taken in by one commit.
        """
        if rows_per_block <= 0:
            raise ValueError("rows_per_block must be positive")
        m = self.manifest
        if not m.staged:
            return []
        # Rows are counted from file footers; keys written again make the blocks smaller.
        staged = self.spark.read.schema(STAGED).option("recursiveFileLookup", "true").parquet(*m.staged).count()
        n = max(1, -(-staged // rows_per_block))
        rows = self.memtable(m).repartitionByRange(n, "ts_ms", "series_id").withColumn("block_id", F.spark_partition_id().cast("long") + m.next_block)
        aside = self._write_aside(rows)
        written = self._contents(self._read_aside(aside))
        self.failpoint("post_l0_write_pre_manifest")
        new = self._take_in(aside, written, dict.fromkeys(written, self.clock()))
        self._commit(m, m.staged, m.swap([], new), "post_manifest_pre_wal_unlink", next_block=m.next_block + n, staged=())
        return new

    def _commit(self, m: Manifest, gone: Sequence[str], new: Manifest, failpoint: str, **other) -> None:
        """Commits ``new``, with what it leaves behind as retired since now, and marks that on disk for a bootstrap."""
        self.store.commit(replace(new, retired=m.retired + tuple((p, self.clock()) for p in gone), **other))
        self.failpoint(failpoint)
        for p in gone:
            self.store.files.touch(f"{p}/{RETIRED}")

    def _write_block(self, rows: DataFrame, level: int, block_id: int) -> Block:
        path = f"{self.root}/L{level}/{block_id:08d}-{uuid.uuid4().hex[:8]}"
        ts = "ts_ms" if level == 0 else "bucket_start"
        schema = POINTS if level == 0 else ROLLUP
        ordered = rows.select(*schema.names).repartitionByRange("series_id", ts).sortWithinPartitions("series_id", ts)
        ordered.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(schema).parquet(path)
        s = block_ops.summarise(back.withColumn("block_id", F.lit(block_id)), ["block_id"], ts).first()
        n_series, n, lo, hi = (s["series_count"], s["row_count"], s["min_ts"], s["max_ts"]) if s else (0, 0, None, None)
        return Block(level, block_id, path, n_series, n, self.store.files.size(path), lo, hi, self.clock())

    # ---- compaction

    def compact(self, width_ms: int = HOUR_MS, min_age_s: int = 0) -> Compaction:
        """L0 to L1: every block old enough goes into one block of buckets and leaves L0.

        A block is a folder of files, range partitioned by series and time, so that its size is no one task's."""
        return self._compact(0, width_ms, min_age_s, rollup.downsample, "l1", "l0")

    def compact_rollup(self, source_level: int, width_ms: int = DAY_MS, min_age_s: int = 0) -> Compaction:
        """L1 to L2, or L2 to L3, likewise."""
        if source_level not in (1, 2):
            raise ValueError(f"only levels 1 and 2 can be compacted further, not {source_level}")
        return self._compact(source_level, width_ms, min_age_s, rollup.merge_rollups, "rollup", "source")

    def _compact(self, level: int, width_ms: int, min_age_s: int, how, target_name: str, source_name: str) -> Compaction:
        if width_ms <= 0:
            raise ValueError(f"bucket width must be positive, got {width_ms}")
        m, now = self.manifest, self.clock()
        old = [b for b in m.level(level) if max(0, now - b.created_at) >= min_age_s * 1000]
        if not old:
            return Compaction(False)
        block = self._write_block(how(self._read(old, level), width_ms), level + 1, m.next_block)
        suffix = "" if level == 0 else f"_L{level + 1}"
        self.failpoint(f"post_{target_name}_write_pre_manifest_rename{suffix}")
        before_delete = "post_manifest_rename_pre_l0_delete" if level == 0 else f"post_rollup_manifest_rename_pre_source_delete{suffix}"
        self._commit(m, [b.path for b in old], m.swap(old, [block]), before_delete, next_block=m.next_block + 1)
        return Compaction(True, len(old), sum(b.row_count for b in old), block.row_count)

    def consolidate(self, rows_per_block: int = ROWS_PER_BLOCK, distinct: bool = False) -> Consolidated:
        """Puts the small L0 blocks into few blocks of about ``rows_per_block`` points and retires them in one commit.

        Blocks are bin-packed by their row counts, first fit in decreasing order; blocks that fill more than half a bin by
        themselves stay. All bins are written by one job and read back; if the rows or the checksum of one differ from its
        sources', nothing is committed. Queries give the same rows as before; with ``distinct``, points that these blocks
        hold several times are kept once. A new block is as old as the youngest block in it.
        """
        if rows_per_block <= 0:
            raise ValueError("rows_per_block must be positive")
        m = self.manifest
        old = [b for b in m.level(0) if 2 * b.row_count <= rows_per_block]
        bins = first_fit_decreasing(np.array([b.row_count for b in old], dtype=np.int64), rows_per_block)
        several = {int(k) for k, n in zip(*np.unique(bins, return_counts=True), strict=True) if n > 1}
        chosen = [(b, int(k)) for b, k in zip(old, bins, strict=True) if int(k) in several]
        if not chosen:
            return Consolidated(False)
        number = {k: m.next_block + i for i, k in enumerate(sorted(several))}
        # The last folder of a file's path is its block.
        plan = self.spark.createDataFrame([(b.path.rsplit("/", 1)[-1], number[k]) for b, k in chosen], "folder string, block_id long")
        rows = self._read([b for b, _ in chosen], 0).withColumn("folder", F.element_at(F.split(F.input_file_name(), "/"), -2))
        rows = rows.join(F.broadcast(plan), "folder").drop("folder")  # an entry for each block of the manifest, which the driver holds
        if distinct:
            rows = rows.groupBy("series_id", "ts_ms", "value").agg(F.min("block_id").alias("block_id"))
        aside = self._write_aside(rows.repartition(len(number), "block_id"))
        found = self._contents(rows)
        written = self._contents(self._read_aside(aside))
        self.failpoint("post_consolidate_write_pre_manifest")
        if {k: v[:2] for k, v in found.items()} != {k: v[:2] for k, v in written.items()}:
            self.store.files.delete(aside)
            raise VerificationError("the consolidated blocks differ from their sources")
        new = self._take_in(aside, written, {k: max(b.created_at for b, j in chosen if number[j] == k) for k in written})
        sources = [b for b, _ in chosen]
        self._commit(m, [b.path for b in sources], m.swap(sources, new), "post_consolidate_manifest_pre_retire", next_block=m.next_block + len(number))
        return Consolidated(True, len(sources), len(new), sum(b.row_count for b in new))

    def _write_aside(self, rows: DataFrame) -> str:
        """Writes points to a folder for each ``block_id``, in a folder that no reader sees."""
        aside = f"{self.root}/L0/_aside-{uuid.uuid4().hex[:8]}"
        rows.sortWithinPartitions("block_id", "series_id", "ts_ms").write.partitionBy("block_id").option("compression", "zstd").parquet(aside)
        return aside

    def _read_aside(self, aside: str) -> DataFrame:
        return self.spark.read.schema("series_id long, ts_ms long, value double, block_id long").parquet(aside)

    def _take_in(self, aside: str, written: dict[int, tuple[int, int, int, int, int]], created_at: dict[int, int]) -> list[Block]:
        """Moves what was written aside to where L0 blocks lie; they are to be committed next."""
        tag, new = uuid.uuid4().hex[:8], []
        for k, (n, _, series, lo, hi) in sorted(written.items()):
            path = f"{self.root}/L0/{k:08d}-{tag}"
            self.store.files.rename(f"{aside}/block_id={k}", path)
            new.append(Block(0, k, path, series, n, self.store.files.size(path), lo, hi, created_at[k]))
        self.store.files.delete(aside)
        return new

    @staticmethod
    def _contents(rows: DataFrame) -> dict[int, tuple[int, int, int, int, int]]:
        """Rows, checksum, series and times of each block; a line for each block to be written."""
        h = point_hash(F.col("series_id"), F.col("ts_ms"), F.col("value")).bitwiseAND(0xFFFFFFFF)
        per = rows.groupBy("block_id").agg(F.count(F.lit(1)), F.sum(h), F.countDistinct("series_id"), F.min("ts_ms"), F.max("ts_ms"))
        return {r[0]: tuple(r)[1:] for r in per.collect()}

    def vacuum(self, older_than_s: int | None = None) -> list[str]:
        """Deletes what was retired that long ago (``grace_s`` if not given), files of that age that no manifest names, as
        a crash leaves them, and old manifest versions. Returns the files, ``folder/name``."""
        grace = 1000 * (self.grace_s if older_than_s is None else older_than_s)
        m, now = self.manifest, self.clock()
        due = {p for p, at in m.retired if now - at >= grace}
        named = {p.rsplit("/", 1)[-1] for p in [*(b.path for b in m.blocks), *m.staged, *m.series_files, *(p for p, _ in m.retired if p not in due)]}
        files, wall = self.store.files, int(time.time() * 1000)
        due = {p.rsplit("/", 1)[-1] for p in due}
        gone = []
        for folder in FOLDERS:
            for name in files.names(f"{self.root}/{folder}"):
                path = f"{self.root}/{folder}/{name}"
                if name in due or name not in named and wall - files.written_at(path) >= grace:
                    files.delete(path)
                    gone.append(f"{folder}/{name}")
        left = tuple((p, at) for p, at in m.retired if p.rsplit("/", 1)[-1] not in due)
        if left != m.retired:
            self.store.commit(replace(m, retired=left))
        self.store.trim(wall - grace)
        return gone

    def bootstrap(self) -> Manifest:
        """Adopts what is on disk where no manifest exists; with a manifest, cleans up what it doesn't name.

        Blocks, staged batches and the dictionary are adopted, but for what is marked as retired. Of batches and of
        dictionary files that were written on the same version only the last was accepted. New ids go on after the
        highest in use, in the dictionary, the blocks or the batches. Names of accepted batches are lost with the manifest.
        """
        m = self.manifest
        if m.version:
            for p, _ in m.retired:  # a crash may have come between the commit and its marks
                if self.store.files.exists(p) and not self.store.files.exists(f"{p}/{RETIRED}"):
                    self.store.files.touch(f"{p}/{RETIRED}")
            self.vacuum()
            return self.manifest
        found, highest = [], 0
        for level in range(4):
            ts, schema = ("ts_ms", POINTS) if level == 0 else ("bucket_start", ROLLUP)
            for path in self._on_disk(f"L{level}"):
                rows = self.spark.read.schema(schema).parquet(path).withColumn("block_id", F.lit(0))
                s = block_ops.summarise(rows, ["block_id"], ts).first()
                if s:
                    block_id = int(path.rsplit("/", 1)[-1].split("-")[0])
                    found.append(Block(level, block_id, path, s["series_count"], s["row_count"], self.store.files.size(path), s["min_ts"], s["max_ts"], self.clock()))
                    highest = max(highest, rows.agg(F.max("series_id")).first()[0] or 0)
        series, staged = self._last_of_version("series"), self._last_of_version("staging")
        for paths, schema in ((series, SERIES), (staged, STAGED)):
            if paths:
                highest = max(highest, self.spark.read.schema(schema).parquet(*paths).agg(F.max("series_id")).first()[0] or 0)
        if not (found or series or staged):
            return m
        blocks = max((b.block_id for b in found), default=0) + 1
        return self.store.commit(replace(m, blocks=tuple(found), next_block=blocks, next_series=highest + 1, series_files=tuple(series), staged=tuple(staged)))

    def _on_disk(self, folder: str) -> list[str]:
        """Folders written completely and not retired."""
        files = self.store.files
        paths = [f"{self.root}/{folder}/{n}" for n in files.names(f"{self.root}/{folder}") if not n.startswith("_")]
        return [p for p in paths if not files.exists(f"{p}/{RETIRED}") and files.size(p)]

    def _last_of_version(self, folder: str) -> list[str]:
        last: dict[str, str] = {}
        for path in sorted(self._on_disk(folder), key=self.store.files.written_at):
            last[path.rsplit("/", 1)[-1].split("-")[0]] = path
        return sorted(last.values())

    # ---- queries

    def query_series(self, matchers: Sequence[str]) -> DataFrame:
        return index.intersect(self.postings(), matchers)

    def query(self, matchers: Sequence[str], start: int, end: int, include_partial: bool = False) -> DataFrame:
        """Rows of the matched series in ``[start, end)``, tagged by level; only overlapping blocks are opened."""
        m = self.manifest
        if not matchers:
            return self.spark.createDataFrame([], RESULT)
        hit = {n: [b for b in m.level(n) if b.min_ts is not None and b.min_ts < end and b.max_ts >= start] for n in range(4)}
        points = self._read(hit[0], 0).unionByName(self.memtable(m))
        rollups = {n: self._read(hit[n], n) for n in (1, 2, 3)}
        widths = {1: HOUR_MS, 2: DAY_MS, 3: 30 * DAY_MS} if include_partial else None
        return router.stitch(points, rollups, index.postings(self.series(m)), matchers, start, end, widths)

    def query_stats(self, matchers: Sequence[str], start: int, end: int) -> DataFrame:
        """Blocks scanned and skipped for each level; all 0 when no series matches. Staged points are never counted."""
        m = self.manifest
        some = bool(matchers) and bool(self.query_series(matchers).take(1))
        return router.route_stats(m.frame(self.spark) if some else m.frame(self.spark).limit(0), start, end)

    def stats(self) -> DataFrame:
        m = self.manifest
        waiting = self.memtable(m).count()
        return block_ops.engine_stats(m.frame(self.spark), self.series(m)).withColumn("memtable_rows", F.lit(waiting).cast("long"))


def _numbered(batch: str) -> tuple[str, int] | None:
    stream, _, number = batch.rpartition("-")
    return (stream, int(number)) if stream and number.isdecimal() else None


def _accepted(batch: str, batches: Sequence[str]) -> bool:
    """Whether a batch was taken in before; of a stream's numbered batches, also those before the last one."""
    mine = _numbered(batch)
    return batch in batches or mine is not None and any((b := _numbered(x)) and b[0] == mine[0] and b[1] >= mine[1] for x in batches)


def _with_batch(batch: str, batches: tuple[str, ...]) -> tuple[str, ...]:
    """The names to remember: of a stream, which numbers its batches in order, the last one only."""
    mine = _numbered(batch)
    kept = batches if mine is None else tuple(x for x in batches if not ((b := _numbered(x)) and b[0] == mine[0]))
    return (*kept, batch)


def with_retry(action: Callable[[], object], attempts: int = 5) -> object:
    """Runs a committing action again when another writer was first."""
    for k in range(attempts):
        try:
            return action()
        except CommitConflict:
            if k == attempts - 1:
                raise
    return None
