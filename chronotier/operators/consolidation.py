"""Many small block files into few files of about equal size, each live point kept once.

Steps: freeze the list of live blocks; give every distinct point to the lowest live block that holds it; bin-pack the
blocks by what they own, first fit in decreasing order; write one file a bin; read it back and compare counts and
checksums with the plan; commit by writing the file list. Readers go by the list (``committed``): without it there is
nothing to read. ``Engine.consolidate`` does the same to an engine's own blocks, with its manifest as the list.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, new_path, small, stage
from ..sources.manifest import Files
from .blocks import live_blocks, unreadable_lines
from .index import dense_ids

POINTS_SCHEMA = "owner long, series_id long, ts_ms long, value double, seq long, received_at timestamp, held_by array<long>, file int"
FILES_SCHEMA = "file int, rows long, checksum long, blocks long"

#: Points a file, about; a row takes some 25 bytes in a file, with its provenance, and four times that in the shuffle.
ROWS_PER_FILE = 1_000_000
#: Blocks that one packing task sees at most, about.
SHARD = 50_000


class VerificationError(RuntimeError):
    """A rewritten file doesn't hold what its plan says; nothing has been committed."""


@dataclass(frozen=True)
class Consolidation:
    points: DataFrame  # committed rows: series_id, ts_ms, value, seq, received_at, owner, held_by, file
    files: DataFrame  # file, rows, checksum, blocks
    path: str
    absent: DataFrame  # block_id of the live blocks that hold no row
    unreadable: int  # lines of the manifest, at level 0 or none, that name no block


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item. Items above the capacity get a bin each. A tree over the bins' free room finds the first fit.

    ``sizes`` may come in any order; equal ones keep theirs.
    """
    n = len(sizes)
    out = np.empty(n, dtype=np.int64)
    if n == 0:
        return out
    leaves = 1 << max(0, (n - 1).bit_length())
    free = [capacity] * (2 * leaves)
    used = 0
    for i in np.argsort(-np.asarray(sizes), kind="stable"):
        size = min(int(sizes[i]), capacity)
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        out[i] = node - leaves
        used = max(used, int(out[i]) + 1)
        free[node] -= size
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
    return out


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """``block_id, size, bin`` of ``block_id, size``.

    Blocks are packed in shards of a bounded number, in parallel; each shard's bins that came out less than half full
    are packed again, as items, so that sharding costs no more than the last bin of each shard would. An item larger
    than a bin keeps one of its own and is split when written.
    """
    n = sizes.count()
    shards = max(1, -(-n // SHARD))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        bins = first_fit_decreasing(pdf["size"].to_numpy(), capacity)
        names = np.array([f"{pdf['shard'].iloc[0]}-{b}" for b in bins], dtype=object)
        return pdf[["block_id", "size"]].assign(bin=names)

    def tail(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bin": pdf["bin"], "into": [f"t-{b}" for b in first_fit_decreasing(pdf["size"].to_numpy(), capacity)]})

    shard = F.pmod(F.xxhash64("block_id"), F.lit(shards)).alias("shard")
    packed = sizes.select("block_id", "size", shard).orderBy("block_id").groupBy("shard").applyInPandas(one, "block_id long, size long, bin string")
    if shards == 1:
        return packed
    packed = stage(packed, "packed")
    loose = packed.groupBy("bin").agg(F.sum("size").alias("size")).where(F.col("size") * 2 < capacity)
    again = loose.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(tail, "bin string, into string")  # a few bins a shard
    return packed.join(again, "bin", "left").select("block_id", "size", F.coalesce("into", "bin").alias("bin"))


def point_hash(series: Column, ts: Column, value: Column) -> Column:
    """Hash of a point in which null equals null, NaN equals NaN and both zeros are one."""
    return F.xxhash64(series, ts, F.when(value == 0.0, F.lit(0.0)).otherwise(value), value.isNull(), ts.isNull())


def frozen_points(points: DataFrame, live: DataFrame) -> DataFrame:
    """Each distinct point of the live L0 blocks (``block_id``), with the block that owns it and all live blocks that
    hold it.

    Of a point's copies the one with the lowest ``seq`` (then the earliest ``received_at``) is kept. ``held_by`` is as
    long as the number of live blocks that hold the very same point. Group keys normalise both zeros and all NaNs, and
    null groups with null. Files that are listed but absent have no rows; rows in unlisted blocks or none are no concern.
    """
    rows = points.select("series_id", "ts_ms", "value", "seq", "received_at", "block_id").join(live, "block_id", "left_semi")
    return rows.groupBy("series_id", "ts_ms", "value").agg(
        F.min(F.struct("seq", "received_at")).alias("first"), F.sort_array(F.collect_set("block_id")).alias("held_by")
    ).select("series_id", "ts_ms", "value", "first.seq", "first.received_at", F.col("held_by")[0].alias("owner"), "held_by")


def _content(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows and an order-free checksum of each group; the sum of hashes is kept below 2^63 by using their low 32 bits."""
    h = point_hash(F.col("series_id"), F.col("ts_ms"), F.col("value"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("checksum"))


def consolidate(points: DataFrame, manifest: DataFrame, rows_per_file: int = ROWS_PER_FILE, path: str | None = None) -> Consolidation:
    """Rewrites the live L0 blocks into ``path``, by default a staged table. Runs jobs and returns the committed table.

    An empty manifest, or one whose blocks hold no row, gives an empty committed table. Raises ``VerificationError``
    before the commit if a file doesn't hold its plan's rows, or if something was committed at ``path`` before. Live
    blocks without a row and lines that name no block are reported, not passed over.
    """
    if rows_per_file <= 0:
        raise ValueError("rows_per_file must be positive")
    spark = points.sparkSession
    listed = stage(live_blocks(manifest, 0).select("block_id"), "p2-live")
    unreadable = unreadable_lines(manifest).where("level IS NULL OR level = 0").count()
    frozen = stage(frozen_points(points, broadcast_if_small(listed)), "p2-frozen")
    owned = stage(_content(frozen, ["owner"]).withColumnsRenamed({"owner": "block_id", "rows": "size"}), "p2-owned")
    bins = stage(pack(owned.select("block_id", "size"), rows_per_file), "p2-bins")
    # A bin that is larger than a file, which only a single block can be, is split by hash into equal parts.
    parts = F.greatest(F.lit(1).cast("long"), F.ceil(F.sum("size") / rows_per_file).cast("long"))
    split = bins.groupBy("bin").agg(parts.alias("parts"))
    numbered = dense_ids(split.select("bin", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")), ["bin", "part"], "file", 0)
    numbered = stage(numbered, "p2-numbered")
    plan = small(bins.select(F.col("block_id").alias("owner"), "bin").join(numbered.groupBy("bin", "parts").agg(F.min("file").alias("first_file")), "bin").drop("bin"), "p2-plan")
    h = point_hash(F.col("series_id"), F.col("ts_ms"), F.col("value"))
    rows = frozen.join(plan, "owner")
    rows = rows.withColumn("file", (F.col("first_file") + F.pmod(F.shiftright(h, 32), F.col("parts"))).cast("int")).drop("parts", "first_file")
    path = path or new_path(spark, "consolidated")
    # A partition is a file: the file's number is the partition's.
    laid = rows.repartitionById(max(1, numbered.count()), "file").sortWithinPartitions("series_id", "ts_ms")
    laid.write.option("compression", "zstd").parquet(f"{path}/data")
    # What was written is read once, by file and block: for the listing and for the comparison with the plan.
    written = stage(_content(spark.read.schema(laid.schema).parquet(f"{path}/data"), ["file", "owner"]), "p2-written")
    _verify(owned, written)
    files = written.groupBy("file").agg(F.sum("rows").alias("rows"), F.sum("checksum").alias("checksum"), F.count(F.lit(1)).alias("blocks"))
    _commit(files, path)
    done, files = committed(spark, path)
    absent = listed.join(done.select(F.explode("held_by").alias("block_id")).distinct(), "block_id", "left_anti")
    return Consolidation(done, files, path, absent, unreadable)


def _verify(owned: DataFrame, written: DataFrame) -> None:
    """Every block's rows and checksum must be the same in the frozen input and in the files."""
    after = written.groupBy("owner").agg(F.sum("rows").alias("r1"), F.sum("checksum").alias("c1"))
    both = owned.withColumnsRenamed({"block_id": "owner"}).join(after, "owner", "full")
    same = F.col("size").eqNullSafe(F.col("r1")) & F.col("checksum").eqNullSafe(F.col("c1"))
    if bad := both.where(~same).select("owner").take(3):
        raise VerificationError(f"blocks {[r[0] for r in bad]} differ between input and output")


def _commit(listing: DataFrame, path: str) -> None:
    """The commit is one rename: of the folder that lists the files, written aside, to its final name."""
    aside, final = f"{path}/_listing", f"{path}/listing"
    listing.coalesce(1).write.mode("overwrite").parquet(aside)
    files = Files(listing.sparkSession, path)
    if files.names(final) or not files.rename(aside, final):
        raise VerificationError(f"the listing {final} exists already")


def committed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Points and listing of a committed consolidation; raises where none was committed."""
    if not Files(spark, path).names(f"{path}/listing"):
        raise FileNotFoundError(f"no consolidation was committed at {path}")
    return spark.read.schema(POINTS_SCHEMA).parquet(f"{path}/data"), spark.read.schema(FILES_SCHEMA).parquet(f"{path}/listing")


def audit(points: DataFrame, manifest: DataFrame, blocks: DataFrame) -> DataFrame:
    """What the summaries say of each live L0 block beside what it holds: ``block_id, summary_rows, rows, absent``.

    Of repeated summaries the latest counts (by ``created_at``, then the larger); null where there is none or it has no
    number. A live file that is absent, or holds nothing, has 0 rows. Sizes for packing are hence counted, not believed.
    """
    live = live_blocks(manifest, 0).select("block_id")
    said = blocks.where("level = 0").groupBy("block_id").agg(F.max_by("row_count", F.struct("created_at", "row_count")).alias("summary_rows"))
    held = points.where("block_id IS NOT NULL").groupBy("block_id").agg(F.count(F.lit(1)).alias("rows"))
    out = live.join(said, "block_id", "left").join(held, "block_id", "left")
    return out.select("block_id", "summary_rows", F.coalesce("rows", F.lit(0)).alias("rows"), F.col("rows").isNull().alias("absent"))


def containment(done: Consolidation) -> tuple[DataFrame, DataFrame]:
    """Classes of live blocks with the same points, and which class holds every point of which: ``block, rep, n`` for each
    block that holds a point, and ``inner, outer`` of representatives (a class's lowest block).

    Blocks are the same if their counts and 128 bits of order-free hashes of their points agree. Among representatives, a
    block all of whose points some other block holds too is a candidate; its rarest point names the few blocks that could
    contain it, and a count of the shared points decides.
    """
    h = point_hash(F.col("series_id"), F.col("ts_ms"), F.col("value"))
    g = F.xxhash64(h, "value", "ts_ms", "series_id")
    # A point's rarity and identity in one number: the fewer its holders, the lower; 43 bits of hash tell points apart.
    held = done.points.select("held_by", F.size("held_by").cast("long").alias("k"), h.alias("h"), g.alias("g"))
    held = held.withColumn("mark", F.shiftleft(F.least("k", F.lit((1 << 20) - 1)), 43).bitwiseOR(F.shiftrightunsigned("h", 21)))
    low = lambda c: c.bitwiseAND(0xFFFFFFFF)
    per = held.select(F.explode("held_by").alias("block"), "k", "mark", "h", "g")
    sizes = stage(per.groupBy("block").agg(
        F.count(F.lit(1)).alias("n"), F.min("k").alias("least"), F.min("mark").alias("rare"), F.sum(low(F.col("h"))).alias("c0"),
        F.sum(F.shiftrightunsigned("h", 32)).alias("c1"), F.sum(low(F.col("g"))).alias("c2"), F.sum(F.shiftrightunsigned("g", 32)).alias("c3"),
    ), "p2-sizes")
    same = ["n", "c0", "c1", "c2", "c3"]
    classes = stage(sizes.join(sizes.groupBy(*same).agg(F.min("block").alias("rep")), same).select("block", "rep", "n", "least", "rare"), "p2-classes")
    reps = classes.where("block = rep")
    shared = held.where("k > 1").select("mark", "h", "held_by")
    copies = classes.where("block <> rep").select("block")
    if copies.take(1):  # of copies only the representative is looked at
        one = shared.withColumn("at", F.monotonically_increasing_id()).select("mark", "at", F.explode("held_by").alias("block"))
        one = one.join(small(copies, "p2-copies"), "block", "left_anti")
        shared = one.groupBy("mark", "at").agg(F.collect_list("block").alias("held_by"))
    shared = stage(shared.select("mark", "held_by").where(F.size("held_by") > 1), "p2-shared")
    candidates = reps.where("least > 1").select(F.col("block").alias("inner"), "n", F.col("rare").alias("mark"))
    # Representatives that hold the rarest point of a candidate, and more points.
    holders = shared.join(candidates, "mark").where(F.array_contains("held_by", F.col("inner")))
    maybe = holders.select("inner", "n", F.explode("held_by").alias("outer")).where(F.col("inner") != F.col("outer")).distinct()
    maybe = small(maybe.join(reps.select(F.col("block").alias("outer"), F.col("n").alias("n_outer")), "outer").where("n_outer > n").drop("n_outer"), "p2-maybe")
    hits = shared.select(F.explode("held_by").alias("inner"), "held_by").join(maybe, "inner").where(F.array_contains("held_by", F.col("outer")))
    pairs = hits.groupBy("inner", "outer", "n").agg(F.count(F.lit(1)).alias("common")).where("common = n").select("inner", "outer")
    return classes.select("block", "rep", "n"), stage(pairs, "p2-pairs")


def contained_blocks(done: Consolidation) -> DataFrame:
    """Pairs of live blocks, one of which holds every point of the other: ``block_a < block_b``.

    The pairs of ``containment`` with the members of both classes, and the pairs within a class. Blocks without a point
    are no case.
    """
    classes, pairs = containment(done)
    member = lambda name, rep: classes.select(F.col("rep").alias(rep), F.col("block").alias(name))
    across = pairs.join(member("a", "inner"), "inner").join(member("b", "outer"), "outer")
    several = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("rep")
    within = member("a", "rep").join(several, "rep").join(member("b", "rep"), "rep").where("a < b")
    return across.select(F.least("a", "b").alias("block_a"), F.greatest("a", "b").alias("block_b")).unionByName(within.select(F.col("a").alias("block_a"), F.col("b").alias("block_b")))
