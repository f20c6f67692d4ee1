import pytest
from pyspark.sql import functions as F

from chronotier.engine import Engine, with_retry
from chronotier.plans import core_queries
from chronotier.sources.manifest import Block, CommitConflict, Manifest, ManifestStore

BASE = 1_700_000_000_000
CPU = "host=h1,metric=cpu"


def points(spark, n, start=0, labels=CPU):
    return spark.range(n).select(F.lit(labels).alias("labels"), (F.lit(BASE + start) + F.col("id")).alias("ts_ms"), F.col("id").cast("double").alias("value"), F.col("id").alias("seq"))


class Crash(RuntimeError):
    pass


def crash_at(name):
    def fail(at):
        if at == name:
            raise Crash(at)

    return fail


def rows_of(engine, level):
    return engine.scan(level).count()


def test_write_query_flush(spark, tmp_path):
    e = Engine(spark, str(tmp_path), flush_threshold=1 << 30)
    assert e.write(points(spark, 10)) == 10
    assert e.query([CPU.split(",")[0]], BASE, BASE + 5).count() == 5  # not flushed yet, visible
    e.write(points(spark, 1).withColumn("value", F.lit(99.0)))  # the same key again: the last write wins
    assert e.memtable().count() == 10
    assert e.query(["metric=cpu"], BASE, BASE + 1).first()["value"] == 99.0
    block = e.flush()
    assert (block.row_count, block.min_ts, block.max_ts) == (10, BASE, BASE + 9)
    assert e.flush() is None
    assert e.query([], 0, 1 << 60).count() == 0
    e.write(points(spark, 1))  # across blocks copies are all returned
    assert e.query(["metric=cpu"], BASE, BASE + 1).count() == 2
    s = e.stats().first()
    assert (s["l0_blocks"], s["l0_rows"], s["series"], s["memtable_rows"]) == (1, 10, 1, 1)


def test_threshold_flushes(spark, tmp_path):
    e = Engine(spark, str(tmp_path), flush_threshold=10)
    e.write(points(spark, 9))
    assert not e.manifest.level(0)
    e.write(points(spark, 2, start=8))  # one key more: ten keys
    assert [b.row_count for b in e.manifest.level(0)] == [10]


def test_a_batch_is_accepted_once(spark, tmp_path):
    e = Engine(spark, str(tmp_path), flush_threshold=1 << 30)
    assert e.write(points(spark, 5), batch="b1") == 5
    assert e.write(points(spark, 5), batch="b1") == 0
    assert e.memtable().count() == 5


def test_numbered_batches_are_remembered_by_the_last():
    from chronotier.engine import _accepted, _with_batch

    names = ()
    for b in ("s-0", "s-1", "x", "t-5", "s-2"):
        assert not _accepted(b, names)
        names = _with_batch(b, names)
    assert names == ("x", "t-5", "s-2")
    assert all(_accepted(b, names) for b in ("s-0", "s-2", "x", "t-4")) and not _accepted("s-3", names)


def test_maps_nulls_and_clashing_columns(spark, tmp_path):
    e = Engine(spark, str(tmp_path), flush_threshold=1 << 30)
    df = spark.createDataFrame([({"b": "2", "a": "1"}, 5, 1.0, 7), (None, 5, 1.0, 8), ({"a": "1"}, None, 1.0, 9), ({"b": "2", "a": "1"}, 6, None, 10)], "labels map<string,string>, ts_ms long, value double, series_id long")
    assert e.write(df) == 2
    assert [r["labels"] for r in e.series().collect()] == ["a=1,b=2"]
    e.flush()
    assert rows_of(e, 0) == 2


def test_compaction_chain_and_stats(spark, tmp_path):
    now = [BASE]
    e = Engine(spark, str(tmp_path), flush_threshold=1 << 30, clock=lambda: now[0])
    for day in range(3):
        e.write(points(spark, 100, start=day * 86_400_000))
        e.flush()
    assert not e.compact(60_000, min_age_s=3600).ran
    now[0] += 3_600_000
    c = e.compact(60_000, min_age_s=3600)
    assert (c.ran, c.source_blocks, c.source_rows, c.target_rows) == (True, 3, 300, 3)
    assert not e.manifest.level(0) and len(e.manifest.level(1)) == 1
    assert not e.compact(60_000).ran
    assert e.compact_rollup(1, 86_400_000).target_rows == 3
    assert e.compact_rollup(2, 2_592_000_000).target_rows == 1
    r = e.scan(3).first()
    assert (r["count"], r["min"], r["max"], r["avg"]) == (300, 0.0, 99.0, 49.5)
    out = {x["level"]: (x["scanned"], x["skipped"]) for x in e.query_stats(["metric=cpu"], 0, 1 << 60).collect()}
    assert out == {0: (0, 0), 1: (0, 0), 2: (0, 0), 3: (1, 0)}
    assert all(x["scanned"] + x["skipped"] == 0 for x in e.query_stats(["metric=nope"], 0, 1 << 60).collect())
    for bad in (0, 3):
        with pytest.raises(ValueError):
            e.compact_rollup(bad)
    with pytest.raises(ValueError):
        e.compact(0)
    with pytest.raises(ValueError):
        e.scan(1, [e.manifest.level(3)[0].block_id])


@pytest.mark.parametrize(("point", "blocks"), [("post_l0_write_pre_manifest", 0), ("post_manifest_pre_wal_unlink", 1)])
def test_crash_in_flush_keeps_each_point_once(spark, tmp_path, point, blocks):
    e = Engine(spark, str(tmp_path), flush_threshold=1 << 30, failpoint=crash_at(point))
    e.write(points(spark, 100))
    with pytest.raises(Crash):
        e.flush()
    e = Engine(spark, str(tmp_path))
    e.bootstrap()
    assert len(e.manifest.level(0)) == blocks
    assert e.query(["metric=cpu"], 0, 1 << 60).count() == 100
    e.flush()
    assert e.query(["metric=cpu"], 0, 1 << 60).count() == 100


def test_crash_before_the_commit_of_a_write(spark, tmp_path):
    e = Engine(spark, str(tmp_path), flush_threshold=1 << 30, failpoint=crash_at("post_stage_pre_manifest"))
    with pytest.raises(Crash):
        e.write(points(spark, 100), batch="b")
    e = Engine(spark, str(tmp_path), flush_threshold=1 << 30)
    assert e.query(["metric=cpu"], 0, 1 << 60).count() == 0
    assert e.write(points(spark, 100), batch="b") == 100
    assert not e.vacuum()  # too young
    assert e.vacuum(older_than_s=0)  # what the crash left
    assert e.query(["metric=cpu"], 0, 1 << 60).count() == 100


@pytest.mark.parametrize(
    ("point", "l0", "l1", "l2"),
    [
        ("post_l1_write_pre_manifest_rename", 1, 0, 0), ("post_manifest_rename_pre_l0_delete", 0, 1, 0),
        ("post_rollup_write_pre_manifest_rename_L2", 0, 1, 0), ("post_rollup_manifest_rename_pre_source_delete_L2", 0, 0, 1),
    ],
)
def test_crash_in_compaction(spark, tmp_path, point, l0, l1, l2):
    e = Engine(spark, str(tmp_path), flush_threshold=1 << 30)
    e.write(points(spark, 50))
    e.flush()
    e.failpoint = crash_at(point)
    with pytest.raises(Crash):
        e.compact(60_000)
        e.compact_rollup(1, 3_600_000)
    e = Engine(spark, str(tmp_path))
    e.bootstrap()
    assert [len(e.manifest.level(n)) for n in (0, 1, 2)] == [l0, l1, l2]
    if l0:
        assert e.compact(60_000).ran
    assert e.query(["metric=cpu"], BASE - 3_600_000, 1 << 60).count() >= 1


def test_bootstrap_adopts_blocks(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "a"), flush_threshold=1 << 30)
    e.write(points(spark, 5))
    e.flush()
    e.store.files.delete(f"{e.root}/_manifest")
    m = Engine(spark, str(tmp_path / "a")).bootstrap()
    assert [b.row_count for b in m.level(0)] == [5] and m.next_block == 2
    assert Engine(spark, str(tmp_path / "none")).bootstrap() == Manifest()


MEM = "host=zz,metric=mem"


def test_a_lost_manifest_keeps_series_apart(spark, tmp_path):
    e = Engine(spark, str(tmp_path), flush_threshold=1 << 30)
    e.write(points(spark, 5))
    e.flush()
    e.write(points(spark, 3, start=100))  # staged only
    e.store.files.delete(f"{e.root}/_manifest")
    e = Engine(spark, str(tmp_path), flush_threshold=1 << 30)
    m = e.bootstrap()
    assert (m.next_series, len(m.series_files), len(m.staged)) == (2, 1, 1)
    assert e.query(["metric=cpu"], 0, 1 << 60).count() == 8
    e.write(points(spark, 2, labels=MEM))
    both = lambda: [e.query([f"metric={x}"], 0, 1 << 60).count() for x in ("cpu", "mem")]
    assert both() == [8, 2] and sorted(r["series_id"] for r in e.series().collect()) == [1, 2]
    e.vacuum(older_than_s=0)
    Engine(spark, str(tmp_path)).bootstrap()
    assert both() == [8, 2]


def test_a_lost_manifest_does_not_bring_back_what_was_retired(spark, tmp_path):
    e = Engine(spark, str(tmp_path), flush_threshold=1 << 30)
    for k in range(2):
        e.write(points(spark, 60, start=k * 60))
        e.flush()
    e.compact(60_000)
    e.store.files.delete(f"{e.root}/_manifest")
    e = Engine(spark, str(tmp_path))
    m = e.bootstrap()
    assert [len(m.level(n)) for n in range(4)] == [0, 1, 0, 0] and not m.staged and m.next_block == 4
    assert e.scan(1).agg({"count": "sum"}).first()[0] == 120


def test_results_outlive_commits_for_a_while(spark, tmp_path):
    now = [BASE]
    e = Engine(spark, str(tmp_path), flush_threshold=1 << 30, clock=lambda: now[0])
    e.write(points(spark, 10))
    staged = e.query(["metric=cpu"], 0, 1 << 60)
    e.flush()
    flushed = e.query(["metric=cpu"], 0, 1 << 60)
    e.compact(60_000)
    e.vacuum()
    assert staged.count() == flushed.count() == 10
    assert e.query(["metric=cpu"], 0, 1 << 60).count() == 1
    versions = len(e.store.files.names(f"{e.root}/_manifest"))
    now[0] += 3_600_000
    assert {n.split("/")[0] for n in e.vacuum()} == {"L0", "staging"}
    assert not e.manifest.retired
    e.vacuum(older_than_s=0)
    assert len(e.store.files.names(f"{e.root}/_manifest")) < versions
    assert e.query(["metric=cpu"], 0, 1 << 60).count() == 1


def test_unnamed_batches_leave_no_name(spark, tmp_path):
    e = Engine(spark, str(tmp_path), flush_threshold=1 << 30)
    e.write(points(spark, 1))
    e.write(points(spark, 1), batch="mine")
    assert e.manifest.batches == ("mine",)


@pytest.mark.parametrize("distinct", [False, True])
def test_small_blocks_become_few(spark, tmp_path, distinct):
    e = Engine(spark, str(tmp_path), flush_threshold=1 << 30)
    for k in range(5):
        e.write(points(spark, 10 if k < 4 else 60, start=8 * k))  # blocks share two points each
        e.flush()
    before = sorted(map(tuple, e.scan(0).collect()))
    old = e.query(["metric=cpu"], 0, 1 << 60)
    done = e.consolidate(rows_per_block=100, distinct=distinct)
    assert (done.ran, done.source_blocks, done.target_blocks) == (True, 4, 1)
    after = sorted(map(tuple, e.scan(0).collect()))
    assert after == before if not distinct else set(after) == set(before)
    assert [b.row_count for b in e.manifest.level(0)] == [60, 40]
    assert old.count() == len(before) and e.query(["metric=cpu"], BASE + 30, BASE + 31).count() == 1
    assert not e.consolidate(rows_per_block=100).ran
    e.vacuum(older_than_s=0)
    assert sorted(map(tuple, e.scan(0).collect())) == after
    with pytest.raises(ValueError):
        e.consolidate(0)


def test_crash_in_consolidation_changes_nothing(spark, tmp_path):
    e = Engine(spark, str(tmp_path), flush_threshold=1 << 30, failpoint=crash_at("post_consolidate_write_pre_manifest"))
    for k in range(3):
        e.write(points(spark, 5, start=5 * k))
        e.flush()
    with pytest.raises(Crash):
        e.consolidate(100)
    e = Engine(spark, str(tmp_path))
    e.bootstrap()
    assert len(e.manifest.level(0)) == 3 and rows_of(e, 0) == 15
    assert any("_aside" in n for n in e.vacuum(older_than_s=0)) and rows_of(e, 0) == 15
    assert e.consolidate(100).target_blocks == 1 and rows_of(e, 0) == 15


def test_a_flush_makes_blocks_of_bounded_size(spark, tmp_path):
    e = Engine(spark, str(tmp_path), flush_threshold=1 << 30)
    assert e.flush_blocks(100) == []
    for labels in (CPU, CPU.replace("h1", "h2")):
        e.write(points(spark, 1000, labels=labels))
    e.write(points(spark, 10).withColumn("value", F.lit(-1.0)))  # the last write of a key wins here too
    before = sorted(map(tuple, e.memtable().collect()))
    new = e.flush_blocks(500)
    m = e.manifest
    assert m.level(0) == new and not m.staged and 4 <= len(new) <= 5 and max(b.row_count for b in new) < 1000
    assert sorted(map(tuple, e.scan(0).collect())) == before and len(before) == sum(b.row_count for b in new) == 2000
    assert {b.series_count for b in new} <= {1, 2} and all(e.scan(0, [b.block_id]).count() == b.row_count for b in new)
    assert (min(b.min_ts for b in new), max(b.max_ts for b in new)) == (BASE, BASE + 999)
    assert all(x.max_ts <= y.min_ts for x, y in zip(new, new[1:]))
    e.write(points(spark, 5, start=5000))
    assert e.flush().block_id > new[-1].block_id
    e.vacuum(older_than_s=0)
    assert rows_of(e, 0) == 2005 and Engine(spark, str(tmp_path)).consolidate(10_000).rows == 2005
    e.write(points(spark, 1).where("false"))
    assert e.flush_blocks(500) == [] and not e.manifest.staged
    with pytest.raises(ValueError):
        e.flush_blocks(0)


@pytest.mark.parametrize("at", ["post_l0_write_pre_manifest", "post_manifest_pre_wal_unlink"])
def test_crash_in_a_flush_to_blocks_loses_and_repeats_nothing(spark, tmp_path, at):
    e = Engine(spark, str(tmp_path), flush_threshold=1 << 30, failpoint=crash_at(at))
    e.write(points(spark, 20))
    with pytest.raises(Crash):
        e.flush_blocks(5)
    e = Engine(spark, str(tmp_path))
    e.bootstrap()
    assert e.query(["metric=cpu"], 0, 1 << 60).count() == 20
    e.flush_blocks(5)
    assert rows_of(e, 0) == 20


@pytest.mark.parametrize("parts", [(2_000, 2_000, 600_000), (0, 0, 10), (0, 0, 0)])
def test_consolidating_query_at_any_size(spark, tmp_path, parts):
    """A part of more than half a block, and parts without points."""
    days = (1_704_400_000_000, 1_704_500_000_000, 1_705_200_000_000)
    events = None
    for k, (n, start) in enumerate(zip(parts, days, strict=True)):
        some = spark.range(n).select((F.col("id") + k * 1_000_000).alias("event_id"), F.timestamp_millis(F.col("id") + start).alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("click").alias("event_type"), F.col("id").cast("double").alias("value"))
        events = some if events is None else events.unionByName(some)
    events.write.parquet(str(tmp_path / "events.parquet"))
    want = spark.read.parquet(str(tmp_path / "events.parquet")).select(F.format_string("event_type=%s,user_id=%d", "event_type", "user_id").alias("labels"), F.unix_millis("ts").alias("ts_ms"), "value")
    got = core_queries.Q["engine_consolidate"](spark, str(tmp_path))
    assert got.count() == sum(parts) and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_manifest_round_trip_conflict_and_unknown_level(spark, tmp_path):
    store = ManifestStore(spark, str(tmp_path))
    assert store.load() == Manifest()
    b = Block(1, 7, "p", 1, 2, 3, 4, 5, 6)
    first = store.commit(Manifest(blocks=(b,), batches=("x",)))
    assert store.load() == first and first.version == 1
    with pytest.raises(CommitConflict):
        store.commit(Manifest())  # made from a version that isn't the last
    tries = []

    def act():
        tries.append(1)
        if len(tries) < 3:
            raise CommitConflict("x")
        return "done"

    assert with_retry(act) == "done"
    with pytest.raises(ValueError, match="9"):
        Manifest.from_json(Manifest(blocks=(Block(9, 1, "p", 1, 1, 1, 1, 1, 1),)).to_json())
    (tmp_path / "_manifest" / "000000000002.json").write_text('{"version": 2, "blo')  # torn
    assert store.load() == first
    assert store.commit(first).version == 3
