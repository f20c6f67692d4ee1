"""The versioned manifest: which blocks are live.

Each commit writes ``_manifest/<version>.json`` by an exclusive create, so that of two writers who start from the same
version only one succeeds; the other one reads again and retries. Readers take the highest version. The driver holds
one entry for each live block, never rows. Exclusive create is given by local disks and HDFS; object stores need a
conditional put behind the same file system interface.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..schemas import BLOCKS, LEVELS


class CommitConflict(RuntimeError):
    """Another writer has committed the version that this one was about to."""


@dataclass(frozen=True)
class Block:
    level: int
    block_id: int
    path: str
    series_count: int
    row_count: int
    bytes: int
    min_ts: int | None
    max_ts: int | None
    created_at: int


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    next_block: int = 1
    next_series: int = 1
    blocks: tuple[Block, ...] = ()
    series_files: tuple[str, ...] = ()
    staged: tuple[str, ...] = ()
    batches: tuple[str, ...] = field(default=())
    retired: tuple[tuple[str, int], ...] = ()  # what left the lists above, and when: path, unix milliseconds

    def level(self, n: int) -> list[Block]:
        return [b for b in self.blocks if b.level == n]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Manifest:
        raw = json.loads(text)
        blocks = tuple(Block(**b) for b in raw.pop("blocks"))
        if bad := sorted({b.level for b in blocks} - set(LEVELS)):
            raise ValueError(f"manifest lists unknown level(s) {bad}")
        retired = tuple((path, at) for path, at in raw.pop("retired", ()))
        return Manifest(blocks=blocks, retired=retired, **{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})

    def swap(self, remove: list[Block], add: list[Block], **other) -> Manifest:
        gone = {(b.level, b.block_id) for b in remove}
        kept = tuple(b for b in self.blocks if (b.level, b.block_id) not in gone)
        return replace(self, blocks=kept + tuple(add), **other)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(b.level, b.block_id, b.series_count, b.row_count, b.bytes, b.min_ts, b.max_ts, b.created_at) for b in self.blocks]
        return spark.createDataFrame(rows, BLOCKS)


class Files:
    """The few calls of the Hadoop file system that the engine needs, so that any store Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(root).getFileSystem(self._conf)

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def written_at(self, p: str) -> int:
        return self.fs.getFileStatus(self._path(p)).getModificationTime()

    def exists(self, p: str) -> bool:
        return self.fs.exists(self._path(p))

    def touch(self, p: str) -> None:
        self.fs.create(self._path(p), True).close()

    def size(self, folder: str) -> int:
        return sum(s.getLen() for s in self.fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet"))

    def delete(self, p: str) -> None:
        self.fs.delete(self._path(p), True)

    def read(self, p: str) -> str:
        stream = self.fs.open(self._path(p))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def rename(self, a: str, b: str) -> bool:
        return self.fs.rename(self._path(a), self._path(b))

    def create_exclusive(self, p: str, text: str) -> None:
        try:
            stream = self.fs.create(self._path(p), False)
        except Exception as e:  # Py4J wraps the file system's "already exists"
            raise CommitConflict(p) from e
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()


class ManifestStore:
    def __init__(self, spark: SparkSession, root: str):
        self.files, self.folder = Files(spark, root), f"{root}/_manifest"

    def load(self) -> Manifest:
        """The highest version; a file that was torn while being written doesn't end in JSON and is passed over."""
        for name in reversed([n for n in self.files.names(self.folder) if n.endswith(".json")]):
            try:
                return Manifest.from_json(self.files.read(f"{self.folder}/{name}"))
            except json.JSONDecodeError:
                continue
        return Manifest()

    def trim(self, older_than_ms: int) -> list[str]:
        """Deletes versions written before that time, save the one in force and those after it; they are of no use to
        readers, which hold files and not versions."""
        now = self.load().version
        gone = [n for n in self.files.names(self.folder) if n.endswith(".json") and int(n.split(".")[0]) < now and self.files.written_at(f"{self.folder}/{n}") < older_than_ms]
        for n in gone:
            self.files.delete(f"{self.folder}/{n}")
        return gone

    def commit(self, m: Manifest) -> Manifest:
        """Writes ``m`` as the version after the one it was made from."""
        taken = [int(n.split(".")[0]) for n in self.files.names(self.folder) if n.endswith(".json")]
        new = replace(m, version=m.version + 1)
        torn = max(taken, default=0) > m.version and self.load().version == m.version
        if torn:
            new = replace(m, version=max(taken) + 1)
        self.files.create_exclusive(f"{self.folder}/{new.version:012d}.json", new.to_json())
        return new
