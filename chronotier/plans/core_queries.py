"""Queries for the engine's own operators, each with the SQL that must give the same rows.

Float aggregates are rounded to 6 places at the very end, since the order of summation differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import ROWS_PER_BLOCK, Engine
from ..functions import bucket_start
from ..operators import blocks, codec, index, rollup, router
from ..session import new_path, stage, table
from ..sources import generators
from . import model

HOUR, DAY, MONTH = 3_600_000, 86_400_000, 2_592_000_000
# A stretch of points in every test table, and a fixed "now" after it: fixed values.
START, END, NOW = 1_768_867_200_000, 1_769_731_200_000, 1_771_500_000_000
MATCHERS = ("metric=cpu_pct", "tier=plant")

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _nudged(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n) + 1e-9 for n in names})


PTS = """WITH pts AS (SELECT 'event_type=' || event_type || ',user_id=' || user_id AS labels, epoch_us(ts) // 1000 AS ts_ms,
  value, event_id FROM events)"""
SER = PTS + """, ser AS (SELECT labels, row_number() OVER (ORDER BY min(event_id), labels) AS series_id FROM pts GROUP BY labels),
  post AS (SELECT unnest(string_split(labels, ',')) AS label, series_id FROM ser)"""
FLOOR = "({t} - (({t} % {w}) + {w}) % {w})"


def _l1(source: str, width: int, by: str = "labels") -> str:
    return f"""SELECT {by}, {FLOOR.format(t='ts_ms', w=width)} AS bucket_start, count(*) AS count, min(value) AS min, max(value) AS max,
  avg(value) AS avg, quantile_disc(value, 0.99) AS p99 FROM {source} GROUP BY 1, 2"""


def _merge(source: str, width: int, by: str = "labels") -> str:
    return f"""SELECT {by}, {FLOOR.format(t='bucket_start', w=width)} AS bucket_start, CAST(sum(count) AS BIGINT) AS count, min(min) AS min,
  max(max) AS max, sum(avg * count) / sum(CASE WHEN avg IS NOT NULL THEN count END) AS avg,
  sum(p99 * count) / sum(CASE WHEN p99 IS NOT NULL THEN count END) AS p99 FROM {source} WHERE count > 0 GROUP BY 1, 2"""


# Means of values with few decimals can lie on a rounding boundary; a nudge keeps both engines on the same side of it.
_NUDGED = "SELECT {by}, bucket_start, count, min, max, round(avg + 1e-9, 6) AS avg, round(p99 + 1e-9, 6) AS p99 FROM {t}"
_ROUND = "SELECT {by}, bucket_start, count, min, max, round(avg, 6) AS avg, round(p99, 6) AS p99 FROM {t}"


# ---- labels, catalog, index

@query("SELECT DISTINCT 'event_type=' || event_type || ',user_id=' || user_id AS labels FROM events")
def canonical_labels(spark, d):
    return model.event_points(spark, d).select("labels").distinct()


@query("SELECT series_id, list_aggregate(list_sort(string_split(labels, ',')), 'string_agg', ',') AS labels FROM series")
def sorted_series_labels(spark, d):
    return table(spark, d, "series").select("series_id", F.array_join(F.array_sort(F.split("labels", ",")), ",").alias("labels"))


@query(SER + " SELECT labels, series_id FROM ser")
def series_catalog(spark, d):
    return model.event_series(spark, d).select("labels", "series_id")


@query(SER + ", half AS (SELECT * FROM ser WHERE series_id <= 50) SELECT series_id, labels FROM ser")
def series_catalog_grown(spark, d):
    """Ids handed out in two steps are those handed out in one."""
    points = model.event_points(spark, d).select("labels", F.col("seq").alias("first_seen"))
    everything = model.event_series(spark, d)
    known = everything.where("series_id <= 50")
    return known.unionByName(index.assign_series(known, points))


@query(SER + " SELECT label, series_id FROM post")
def postings(spark, d):
    return model.event_postings(spark, d)


@query(SER + " SELECT count(DISTINCT label) AS distinct_labels, count(*) AS postings, CAST(sum(strlen(label)) + 8 * count(*) AS BIGINT) AS bytes FROM post")
def index_stats(spark, d):
    return index.index_stats(model.event_postings(spark, d))


_SPOST = "WITH post AS (SELECT unnest(string_split(labels, ',')) AS label, series_id FROM series)"


@query(_SPOST + " SELECT series_id FROM post WHERE label = 'metric=cpu_pct' ORDER BY 1")
def label_find(spark, d):
    return index.find(model.series_postings(spark, d), "metric=cpu_pct")


@query(_SPOST + " SELECT series_id FROM post WHERE label IN ('metric=cpu_pct', 'tier=plant') GROUP BY 1 HAVING count(DISTINCT label) = 2")
def label_intersect(spark, d):
    return index.intersect(model.series_postings(spark, d), MATCHERS)


@query(_SPOST + " SELECT series_id FROM post WHERE label IN ('metric=cpu_pct', 'tier=plant', 'zone=nowhere') GROUP BY 1 HAVING count(DISTINCT label) = 3")
def label_intersect_unknown(spark, d):
    return index.intersect(model.series_postings(spark, d), [*MATCHERS, "zone=nowhere"])


@query("SELECT series_id FROM series WHERE false")
def label_intersect_empty(spark, d):
    return index.intersect(model.series_postings(spark, d), [])


@query(_SPOST + " SELECT series_id FROM post WHERE starts_with(label, 'host=h1')")
def label_prefix(spark, d):
    return index.prefix(model.series_postings(spark, d), "host=h1")


@query(_SPOST + " SELECT series_id FROM post")
def label_prefix_all(spark, d):
    return index.prefix(model.series_postings(spark, d), "")


@query(_SPOST + " SELECT label, series_id FROM post WHERE starts_with(label, 'host=h') ORDER BY 1, 2")
def label_prefix_ordered(spark, d):
    return index.prefix_ordered(model.series_postings(spark, d), "host=h")


# ---- ingestion

@query("""WITH p AS (SELECT 'linestatus=' || l_linestatus || ',returnflag=' || l_returnflag AS labels, epoch_us(l_shipdate) // 1000 AS ts_ms, *
  FROM lineitem) SELECT labels, ts_ms, l_extendedprice AS value FROM p QUALIFY row_number() OVER (PARTITION BY labels, ts_ms
  ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) = 1""")
def lww_points_lineitem(spark, d):
    return rollup.last_write_wins(model.lineitem_points(spark, d), ["labels", "ts_ms"], F.col("seq"))


@query("""SELECT 'priority=' || o_orderpriority || ',status=' || o_orderstatus AS labels, epoch_us(o_orderdate) // 1000 AS ts_ms,
  arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1, 2""")
def lww_points_orders(spark, d):
    return rollup.last_write_wins(model.order_points(spark, d), ["labels", "ts_ms"], F.col("seq"))


@query("""SELECT series_id, ts_ms, arg_max(value, (seq, coalesce(value, '-Infinity'::DOUBLE))) AS value FROM points
  WHERE value IS NOT NULL GROUP BY 1, 2""")
def lww_points(spark, d):
    p = table(spark, d, "points").where("value IS NOT NULL")
    return rollup.last_write_wins(p, ["series_id", "ts_ms"], F.struct("seq", "value"))


# ---- scans and routing

_IDS = _SPOST + ", ids AS (SELECT series_id FROM post WHERE label IN ('metric=cpu_pct', 'tier=plant') GROUP BY 1 HAVING count(DISTINCT label) = 2)"
_RANGE = f"{{t}} >= {START} AND {{t}} < {END} AND series_id IN (SELECT series_id FROM ids)"


def _ids(spark, d):
    return index.intersect(model.series_postings(spark, d), MATCHERS)


@query(_IDS + " SELECT series_id, ts_ms, value FROM points WHERE " + _RANGE.format(t="ts_ms"))
def raw_range(spark, d):
    return router.raw_range(table(spark, d, "points").select("series_id", "ts_ms", "value"), _ids(spark, d), START, END)


@query(_IDS + " SELECT series_id, 0 AS level, ts_ms, value FROM points WHERE " + _RANGE.format(t="ts_ms") + " ORDER BY 1, 3, 4")
def raw_range_sorted(spark, d):
    raw = router.raw_range(table(spark, d, "points"), _ids(spark, d), START, END)
    return router.in_order(router.tag_points(raw)).select("series_id", "level", "ts_ms", "value")


@query(_IDS + " SELECT series_id, bucket_start, count, min, max, avg, p99 FROM rollup_buckets WHERE level = 1 AND " + _RANGE.format(t="bucket_start"))
def rollup_range_l1(spark, d):
    r = table(spark, d, "rollup_buckets").where("level = 1").select("series_id", "bucket_start", "count", "min", "max", "avg", "p99")
    return router.rollup_range(r, _ids(spark, d), START, END)


_STITCH = (
    _IDS + ", hit AS (SELECT series_id, 0 AS level, ts_ms, value, NULL::BIGINT AS count, NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS avg, NULL::DOUBLE AS p99 FROM points WHERE "
    + f"ts_ms >= {START - 30 * DAY} AND ts_ms < {END} AND series_id IN (SELECT series_id FROM ids)"
    + " UNION ALL SELECT series_id, level, bucket_start, NULL, count, min, max, avg, p99 FROM rollup_buckets WHERE "
    + f"bucket_start >= {START - 30 * DAY} AND bucket_start < {END} AND series_id IN (SELECT series_id FROM ids))"
)


def _stitched(spark, d):
    r = table(spark, d, "rollup_buckets")
    return router.stitch(
        table(spark, d, "points"), {n: r.where(F.col("level") == n) for n in (1, 2, 3)}, model.series_postings(spark, d), MATCHERS, START - 30 * DAY, END
    )


@query(_STITCH + " SELECT * FROM hit")
def stitched_query(spark, d):
    return _stitched(spark, d)


@query(_STITCH + """ SELECT ids.series_id, count(*) FILTER (level = 0) AS raw_rows, count(*) FILTER (level = 1) AS l1_rows,
  count(*) FILTER (level = 2) AS l2_rows, count(*) FILTER (level = 3) AS l3_rows FROM ids LEFT JOIN hit USING (series_id) GROUP BY 1""")
def matched_series_outer(spark, d):
    return router.with_all_matched(_stitched(spark, d), _ids(spark, d))


@query(_STITCH + """ SELECT series_id, level, CAST(row_number() OVER (PARTITION BY series_id, level ORDER BY ts_ms, value NULLS FIRST, count NULLS FIRST,
  min NULLS FIRST, max NULLS FIRST, avg NULLS FIRST, p99 NULLS FIRST) - 1 AS INTEGER) AS pos, ts_ms, value, count, min, max, avg, p99 FROM hit
  UNION ALL SELECT series_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ids""")
def nested_result(spark, d):
    """The nested form taken apart again: every element of every array with its place, and a row for each series."""
    n = router.nested(_stitched(spark, d), _ids(spark, d))
    null = F.lit(None)
    out = n.select("series_id", *[null.cast(k).alias(c) for c, k in (("level", "int"), ("pos", "int"), ("ts_ms", "long"), ("value", "double"), ("count", "long"))], *[null.cast("double").alias(c) for c in ("min", "max", "avg", "p99")])
    raw = n.select("series_id", F.posexplode("raw").alias("pos", "e")).select("series_id", F.lit(0).alias("level"), "pos", "e.ts_ms", "e.value", null.cast("long").alias("count"), *[null.cast("double").alias(c) for c in ("min", "max", "avg", "p99")])
    out = out.unionByName(raw)
    for k in (1, 2, 3):
        e = n.select("series_id", F.posexplode(f"l{k}").alias("pos", "e"))
        out = out.unionByName(e.select("series_id", F.lit(k).alias("level"), "pos", F.col("e.bucket_start").alias("ts_ms"), null.cast("double").alias("value"), "e.count", "e.min", "e.max", "e.avg", "e.p99"))
    return out


def _stats_sql(start: int, end: int) -> str:
    hit = f"(min_ts < {end} AND max_ts >= {start})"
    return f"""SELECT l.level, count(*) FILTER (b.level IS NOT NULL AND coalesce({hit}, false)) AS scanned,
  count(*) FILTER (b.level IS NOT NULL AND NOT coalesce({hit}, false)) AS skipped
  FROM (SELECT unnest([0, 1, 2, 3])::INTEGER AS level) l LEFT JOIN blocks b USING (level) GROUP BY 1"""


def _stats(span: int):
    return lambda spark, d: router.route_stats(table(spark, d, "blocks"), END - span, END)


for _name, _span in (("route_stats_10min", 600_000), ("route_stats_3day", 3 * DAY), ("route_stats_90day", 90 * DAY)):
    Q[_name], SQL[_name] = _stats(_span), _stats_sql(END - _span, END)


def _day_blocks(spark):
    return stage(generators.days(spark), "days")


@query("""WITH r AS (SELECT d AS day, 1700000000000 + d * 86400000 + p * 300000 AS t FROM range(100) x(d), range(288) y(p)),
  b AS (SELECT day, min(t) AS lo, max(t) AS hi FROM r WHERE day >= 98 GROUP BY 1
  UNION ALL SELECT day, min(t - t % 3600000), max(t - t % 3600000) FROM r WHERE day < 98 GROUP BY 1),
  q AS (SELECT * FROM (VALUES ('10min', 600000), ('3day', 259200000), ('90day', 7776000000)) z(range, span)),
  e AS (SELECT range, lo < 1708640000000 AND hi >= 1708640000000 - span AS hit FROM b, q)
  SELECT range, count(*) FILTER (hit) AS scanned, count(*) FILTER (NOT hit) AS skipped FROM e GROUP BY 1""")
def route_100_days(spark, d):
    """A block a day for 100 days, the last two not compacted: blocks scanned and skipped by range (1/99, 3/97, 90/10)."""
    rows = _day_blocks(spark)
    raw = blocks.summarise(rows.where("day >= 98"), ["day"])
    l1 = rollup.downsample(rows.where("day < 98"), HOUR, ("series_id", "day"))
    aged = blocks.summarise(l1, ["day"], "bucket_start")
    b = raw.withColumn("level", F.lit(0)).unionByName(aged.withColumn("level", F.lit(1)))
    end = generators.BASE_MS + 100 * DAY
    out = None
    for name, span in (("10min", 600_000), ("3day", 3 * DAY), ("90day", 90 * DAY)):
        part = router.route_stats(b, end - span, end).agg(F.sum("scanned").alias("scanned"), F.sum("skipped").alias("skipped")).withColumn("range", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("range", "scanned", "skipped")


# ---- rollups

@query(PTS + ", l1 AS (" + _l1("pts", HOUR) + ") " + _ROUND.format(by="labels", t="l1"))
def rollup_l1_hour(spark, d):
    return _rounded(rollup.downsample(model.event_points(spark, d), HOUR, ("labels",)), "avg", "p99")


@query(PTS + ", l1 AS (" + _l1("pts", DAY) + ") " + _ROUND.format(by="labels", t="l1"))
def rollup_l1_day(spark, d):
    return _rounded(rollup.downsample(model.event_points(spark, d), DAY, ("labels",)), "avg", "p99")


_LPTS = """WITH pts AS (SELECT 'linestatus=' || l_linestatus || ',returnflag=' || l_returnflag AS labels, epoch_us(l_shipdate) // 1000 AS ts_ms,
  l_extendedprice AS value FROM lineitem)"""


@query(_LPTS + ", l1 AS (" + _l1("pts", MONTH) + ") " + _ROUND.format(by="labels", t="l1"))
def rollup_lineitem_30d(spark, d):
    return _rounded(rollup.downsample(model.lineitem_points(spark, d), MONTH, ("labels",)), "avg", "p99")


_FIN = "WITH pts AS (SELECT series_id, ts_ms, value FROM points WHERE isfinite(value))"


@query(_FIN + ", l1 AS (" + _l1("pts", HOUR, "series_id") + ") " + _ROUND.format(by="series_id", t="l1"))
def rollup_points_hour(spark, d):
    from ..functions import finite

    return _rounded(rollup.downsample(table(spark, d, "points").where(finite(F.col("value"))), HOUR), "avg", "p99")


@query(PTS + ", l1 AS (" + _l1("pts", HOUR) + "), l2 AS (" + _merge("l1", DAY) + ") " + _ROUND.format(by="labels", t="l2"))
def rollup_l2_day(spark, d):
    l1 = rollup.downsample(model.event_points(spark, d), HOUR, ("labels",))
    return _rounded(rollup.merge_rollups(l1, DAY, ("labels",)), "avg", "p99")


@query(PTS + ", l1 AS (" + _l1("pts", HOUR) + "), l2 AS (" + _merge("l1", DAY) + "), l3 AS (" + _merge("l2", MONTH) + ") " + _ROUND.format(by="labels", t="l3"))
def rollup_l3_30d(spark, d):
    l2 = rollup.merge_rollups(rollup.downsample(model.event_points(spark, d), HOUR, ("labels",)), DAY, ("labels",))
    return _rounded(rollup.merge_rollups(l2, MONTH, ("labels",)), "avg", "p99")


@query("WITH r AS (SELECT DISTINCT * FROM rollup_buckets WHERE level = 1), l2 AS (" + _merge("r", DAY, "series_id") + ") " + _NUDGED.format(by="series_id", t="l2"))
def merge_buckets_day(spark, d):
    r = table(spark, d, "rollup_buckets").where("level = 1").distinct()
    return _rounded(_nudged(rollup.merge_rollups(r, DAY), "avg", "p99"), "avg", "p99")


@query("WITH r AS (SELECT DISTINCT * FROM rollup_buckets), c AS (" + _merge("r", 1, "series_id, level").replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3") + ") " + _NUDGED.format(by="series_id, level", t="c"))
def consolidate_buckets(spark, d):
    """Buckets of two compaction runs, and late ones, as one row, at every level."""
    return _rounded(_nudged(rollup.consolidate(table(spark, d, "rollup_buckets").distinct(), ("series_id", "level")), "avg", "p99"), "avg", "p99")


@query(f"""WITH e AS (SELECT event_id, epoch_us(ts) // 1000 - 1704067200000 - event_id * 977 AS t FROM events)
  SELECT event_id, t, {FLOOR.format(t='t', w=HOUR)} AS bucket_start FROM e""")
def bucket_floor_negative(spark, d):
    e = model.event_points(spark, d).select(F.col("seq").alias("event_id"), (F.col("ts_ms") - 1704067200000 - F.col("seq") * 977).alias("t"))
    return e.select("event_id", "t", bucket_start(F.col("t"), HOUR).alias("bucket_start"))


@query(_FIN + ", l1 AS (" + _l1("pts", HOUR, "series_id") + "), l2 AS (" + _merge("l1", DAY, "series_id") + "), t AS (" + _l1("pts", DAY, "series_id")
       + """) SELECT series_id, bucket_start, round(l2.p99, 6) AS merged_p99, round(t.p99, 6) AS true_p99,
  round(abs(l2.p99 - t.p99) / nullif(abs(t.p99), 0), 6) AS divergence FROM l2 JOIN t USING (series_id, bucket_start)""")
def p99_divergence(spark, d):
    from ..functions import finite

    p = table(spark, d, "points").where(finite(F.col("value")))
    return _rounded(rollup.p99_divergence(p, HOUR, DAY), "merged_p99", "true_p99", "divergence")


@query("SELECT series_id, level, bucket_start, count(*) AS copies FROM rollup_buckets GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_buckets(spark, d):
    return rollup.duplicate_buckets(table(spark, d, "rollup_buckets"))


@query(f"""SELECT series_id, bucket_start, count FROM rollup_buckets WHERE level = 2 AND bucket_start > {START + HOUR - DAY}
  AND bucket_start < {START + HOUR}""")
def left_edge_loss(spark, d):
    """Daily buckets that straddle the start of a range: what the default rule leaves out and ``include_partial`` gives."""
    r = table(spark, d, "rollup_buckets").where("level = 2")
    start, end = START + HOUR, END
    ids = r.select("series_id")
    cols = ["series_id", "bucket_start", "count"]
    wide = router.rollup_range(r, ids, start, end, include_partial_ms=DAY).select(*cols)
    return wide.where(F.col("bucket_start") < start)


# ---- blocks

@query("""SELECT block_id, count(DISTINCT series_id) AS series_count, count(*) AS row_count, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts
  FROM points WHERE block_id IS NOT NULL GROUP BY 1""")
def block_summary(spark, d):
    return blocks.summarise(table(spark, d, "points"), ["block_id"])


@query("""SELECT level, block_id, count(DISTINCT series_id) AS series_count, count(*) AS row_count, min(bucket_start) AS min_ts,
  max(bucket_start) AS max_ts FROM rollup_buckets WHERE block_id IS NOT NULL GROUP BY 1, 2""")
def rollup_block_summary(spark, d):
    return blocks.summarise(table(spark, d, "rollup_buckets"), ["level", "block_id"], "bucket_start")


# A file in several spellings is one file: its number identifies it, in upper case too.
_LIVE = r"""SELECT DISTINCT level, CAST(regexp_extract(lower(trim(filename)), '(\d+)\.blk$', 1) AS BIGINT) AS block_id FROM manifest
  WHERE regexp_matches(lower(trim(filename)), '\d\.blk$')"""


@query(_LIVE)
def manifest_live(spark, d):
    return blocks.live_blocks(table(spark, d, "manifest"))


@query(r"SELECT level, filename FROM manifest WHERE level IS NULL OR filename IS NULL OR NOT regexp_matches(lower(trim(filename)), '\d\.blk$')")
def manifest_unreadable(spark, d):
    """Lines that name no block; what they meant is not taken for live."""
    return blocks.unreadable_lines(table(spark, d, "manifest")).select("level", "filename")


@query(f"WITH live AS ({_LIVE}) SELECT level, block_id FROM live ANTI JOIN (SELECT level, block_id FROM blocks) USING (level, block_id)")
def manifest_missing_files(spark, d):
    b = table(spark, d, "blocks").select("level", "block_id")
    return blocks.live_blocks(table(spark, d, "manifest")).join(b, ["level", "block_id"], "left_anti")


@query(f"WITH live AS ({_LIVE}) SELECT DISTINCT level, block_id FROM blocks ANTI JOIN live USING (level, block_id)")
def manifest_orphans(spark, d):
    live = blocks.live_blocks(table(spark, d, "manifest"))
    return table(spark, d, "blocks").select("level", "block_id").distinct().join(live, ["level", "block_id"], "left_anti")


@query(f"WITH live AS ({_LIVE}) SELECT series_id, ts_ms, value, block_id FROM points WHERE block_id IN (SELECT block_id FROM live WHERE level = 0)")
def l0_block_scan(spark, d):
    live = blocks.live_blocks(table(spark, d, "manifest"), 0).select("block_id")
    return table(spark, d, "points").select("series_id", "ts_ms", "value", "block_id").join(live, "block_id", "left_semi")


@query(f"""WITH live AS ({_LIVE}) SELECT series_id, level, bucket_start, count, min, max, avg, p99, block_id FROM rollup_buckets
  SEMI JOIN live USING (level, block_id)""")
def rollup_block_scan(spark, d):
    live = blocks.live_blocks(table(spark, d, "manifest"))
    return table(spark, d, "rollup_buckets").join(live, ["level", "block_id"], "left_semi")


@query("SELECT series_id, ts_ms, arg_max(value, (seq, value)) AS value FROM points WHERE block_id IS NULL AND value IS NOT NULL GROUP BY 1, 2")
def memtable_scan(spark, d):
    waiting = table(spark, d, "points").where("block_id IS NULL AND value IS NOT NULL")
    return rollup.last_write_wins(waiting, ["series_id", "ts_ms"], F.struct("seq", "value"))


@query("SELECT " + ", ".join(f"count(*) FILTER (level = {n}) AS l{n}_blocks, CAST(coalesce(sum(row_count) FILTER (level = {n}), 0) AS BIGINT) AS l{n}_rows" for n in range(4))
       + ", (SELECT count(DISTINCT series_id) FROM series) AS series FROM blocks")
def engine_stats(spark, d):
    return blocks.engine_stats(table(spark, d, "blocks"), table(spark, d, "series"))


@query(f"SELECT block_id, created_at FROM blocks WHERE level = 0 AND greatest(0, {NOW} - created_at) >= 1209600000")
def compaction_eligible(spark, d):
    return blocks.eligible(table(spark, d, "blocks"), 0, NOW, 14 * 86_400).select("block_id", "created_at")


@query(f"""WITH live AS ({_LIVE}), old AS (SELECT block_id FROM blocks WHERE level = 0 AND greatest(0, {NOW} - created_at) >= 1209600000
  AND block_id IN (SELECT block_id FROM live WHERE level = 0)), pts AS (SELECT series_id, ts_ms, value FROM points WHERE isfinite(value)
  AND block_id IN (SELECT block_id FROM old)), l1 AS ({_l1('pts', HOUR, 'series_id')}) {_ROUND.format(by='series_id', t='l1')}""")
def compaction_l0_l1(spark, d):
    """What a compaction of the live L0 blocks old enough would write."""
    from ..functions import finite

    old = blocks.eligible(table(spark, d, "blocks"), 0, NOW, 14 * 86_400).select("block_id")
    live = blocks.live_blocks(table(spark, d, "manifest"), 0).join(old, "block_id", "left_semi")
    rows = table(spark, d, "points").where(finite(F.col("value"))).join(live, "block_id", "left_semi")
    return _rounded(rollup.downsample(rows, HOUR), "avg", "p99")


# ---- codec

def _bits(points: str, by: str) -> str:
    return f"""{points}, o AS (SELECT {by}, ts_ms, value, row_number() OVER w AS n, ts_ms - lag(ts_ms) OVER w AS delta,
  xor(value::DOUBLE::BIT, lag(value) OVER w ::DOUBLE::BIT)::VARCHAR AS x FROM pts WINDOW w AS (PARTITION BY {by} ORDER BY ts_ms, value)),
  p AS (SELECT *, delta - coalesce(lag(delta) OVER (PARTITION BY {by} ORDER BY n), 0) AS dod,
  least(position('1' IN x) - 1, 31) AS lead, length(x) - length(rtrim(x, '0')) AS trail, x LIKE '%1%' AS changed FROM o),
  q AS (SELECT *, CASE WHEN changed THEN lead || ':' || (64 - lead - trail) END AS win FROM p),
  r AS (SELECT *, last_value(win IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM q),
  sized AS (SELECT {by}, ts_ms, value, dod, CASE WHEN n = 1 THEN 64 WHEN dod = 0 THEN 1 WHEN dod BETWEEN -63 AND 64 THEN 9
  WHEN dod BETWEEN -255 AND 256 THEN 12 WHEN dod BETWEEN -2047 AND 2048 THEN 16 ELSE 36 END AS ts_bits,
  CASE WHEN n = 1 THEN 64 WHEN NOT changed THEN 1 WHEN win = before THEN 2 + 64 - lead - trail ELSE 13 + 64 - lead - trail END AS value_bits FROM r)"""


_BITS = _bits(PTS, "labels")


@query(_BITS + " SELECT labels, ts_ms, dod, ts_bits FROM sized")
def codec_dod_bits(spark, d):
    return codec.point_sizes(model.event_points(spark, d), ["labels"]).select("labels", "ts_ms", "dod", "ts_bits")


@query(_BITS + " SELECT labels, count(*) AS points, CAST(ceil(sum(ts_bits + value_bits) / 8.0) AS BIGINT) AS bytes FROM sized GROUP BY 1")
def codec_stream_sizes(spark, d):
    return codec.stream_sizes(model.event_points(spark, d), ["labels"])


@query(_BITS + """, s AS (SELECT labels, count(*) AS points, CAST(ceil(sum(ts_bits + value_bits) / 8.0) AS BIGINT) AS bytes FROM sized GROUP BY 1)
  SELECT CAST(sum(points) AS BIGINT) AS points, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(bytes) / sum(points), 6) AS bytes_per_point,
  round(sum(points) * 16 / sum(bytes), 6) AS ratio FROM s""")
def codec_size_report(spark, d):
    return _rounded(codec.compression_report(codec.stream_sizes(model.event_points(spark, d), ["labels"])), "bytes_per_point", "ratio")


@query(_BITS + ", s AS (SELECT labels, count(*) AS points, CAST(ceil(sum(ts_bits + value_bits) / 8.0) AS BIGINT) AS bytes FROM sized GROUP BY 1) SELECT labels, points, bytes FROM s")
def codec_encode(spark, d):
    """Real streams have exactly the modelled size."""
    s = codec.encode_points(model.event_points(spark, d), ["labels"])
    return s.select("labels", "points", F.octet_length("data").cast("long").alias("bytes"))


@query(PTS + " SELECT labels, ts_ms, value FROM pts")
def codec_round_trip(spark, d):
    return codec.decode_points(codec.encode_points(model.event_points(spark, d), ["labels"]), ["labels"])


_DAYS = f"WITH pts AS (SELECT series_id, {FLOOR.format(t='ts_ms', w=DAY)} AS day_start, ts_ms, value FROM points WHERE value IS NOT NULL AND ts_ms IS NOT NULL)"


def _day_points(spark, d):
    return codec.by_time(table(spark, d, "points").where("ts_ms IS NOT NULL"), DAY, "day_start")


@query(_bits(_DAYS, "series_id, day_start") + """ SELECT series_id, day_start, count(*) AS points, CAST(ceil(sum(ts_bits + value_bits) / 8.0) AS BIGINT) AS bytes
  FROM sized GROUP BY 1, 2""")
def codec_points_encode(spark, d):
    """Real streams of the readings, cut by day so that a long series is no one task's, have the modelled size."""
    s = codec.encode_points(_day_points(spark, d), ["series_id", "day_start"])
    return s.select("series_id", "day_start", "points", F.octet_length("data").cast("long").alias("bytes"))


@query(_DAYS + " SELECT series_id, day_start, ts_ms, value FROM pts")
def codec_points_round_trip(spark, d):
    by = ["series_id", "day_start"]
    return codec.decode_points(codec.encode_points(_day_points(spark, d), by), by)


@query("SELECT series_id, level, bucket_start, count, min, max, avg, p99 FROM rollup_buckets WHERE bucket_start IS NOT NULL AND count IS NOT NULL")
def codec_rollup_round_trip(spark, d):
    """Rollup streams written and read, a stream for each series, level and 30 days."""
    by = ["series_id", "level", "month_start"]
    cut = codec.by_time(table(spark, d, "rollup_buckets").where("bucket_start IS NOT NULL"), MONTH, "month_start", "bucket_start")
    return codec.decode_rollup_streams(codec.encode_rollups(cut, by), by).drop("month_start")


@query(None)
def codec_crc32(spark, d):
    s = codec.encode_points(model.event_points(spark, d), ["labels"])
    return s.select("labels", F.crc32("data").alias("crc"))


@query("SELECT * FROM (VALUES ('123456789', 3421780262::BIGINT), ('', 0), ('stream', 3213292777)) t(text, crc)")
def codec_crc32_known(spark, d):
    """Checksums of a string whose checksum is published, of nothing, and of the stream of two points: fixed values."""
    two = spark.createDataFrame([(1, 1000, 1.0), (1, 2000, 1.0)], "k int, ts_ms long, value double")
    known = spark.createDataFrame([("123456789",), ("",)], "text string").select("text", F.crc32(F.col("text").cast("binary")).alias("crc"))
    return known.unionByName(codec.encode_points(two, ["k"]).select(F.lit("stream").alias("text"), F.crc32("data").alias("crc")))


@query("SELECT 0 AS k, 100000 AS points, 3.74::DOUBLE AS bytes_per_point, 4.28::DOUBLE AS ratio UNION ALL SELECT 1, 8000, 7.11, 2.25")
def codec_published(spark, d):
    """The two published workloads: bytes a point and ratio, as published."""
    burst = generators.burst(spark, 100_000).withColumn("block", F.floor(F.col("seq") / 20_000))
    out = None
    for k, (rows, by) in enumerate(((burst, ["series_id", "block"]), (generators.drift(spark), ["series_id"]))):
        rep = codec.compression_report(codec.stream_sizes(rows, by)).select(
            F.lit(k).alias("k"), F.col("points").cast("int").alias("points"), F.round("bytes_per_point", 2).alias("bytes_per_point"), F.round("ratio", 2).alias("ratio")
        )
        out = rep if out is None else out.unionByName(rep)
    return out


@query("""WITH o AS (SELECT series_id, level, bucket_start AS t, row_number() OVER w AS n, bucket_start - lag(bucket_start) OVER w AS delta
  FROM rollup_buckets WINDOW w AS (PARTITION BY series_id, level ORDER BY bucket_start)),
  p AS (SELECT *, delta - coalesce(lag(delta) OVER (PARTITION BY series_id, level ORDER BY n), 0) AS dod FROM o)
  SELECT series_id, level, count(*) AS buckets, CAST(ceil(sum(288 + CASE WHEN n = 1 THEN 64 WHEN dod = 0 THEN 1 WHEN dod BETWEEN -63 AND 64 THEN 9
  WHEN dod BETWEEN -255 AND 256 THEN 12 WHEN dod BETWEEN -2047 AND 2048 THEN 16 ELSE 36 END) / 8.0) AS BIGINT) AS bytes FROM p GROUP BY 1, 2""")
def codec_rollup_sizes(spark, d):
    return codec.rollup_sizes(table(spark, d, "rollup_buckets"), ["series_id", "level"])


# ---- the storage engine and streams, end to end

@query(PTS + " SELECT labels, ts_ms, value FROM pts")
def engine_ingest_query(spark, d):
    """Points written, flushed and read back through the engine."""
    e = Engine(spark, new_path(spark, "engine"), flush_threshold=1 << 40)
    e.write(model.event_points(spark, d))
    e.flush()
    return e.scan(0).join(e.series(), "series_id").select("labels", "ts_ms", "value")


@query(PTS + ", l1 AS (" + _l1("pts", HOUR) + "), l2 AS (" + _merge("l1", DAY) + "), l3 AS (" + _merge("l2", MONTH) + ") " + _ROUND.format(by="labels", t="l3"))
def engine_cascade(spark, d):
    """The same through flush and three compactions."""
    e = Engine(spark, new_path(spark, "engine"), flush_threshold=1 << 40)
    e.write(model.event_points(spark, d))
    e.flush()
    e.compact(HOUR)
    e.compact_rollup(1, DAY)
    e.compact_rollup(2, MONTH)
    return _rounded(e.scan(3).join(e.series(), "series_id").select("labels", "bucket_start", "count", "min", "max", "avg", "p99"), "avg", "p99")


# Two moments within the events: what is older than the first is compacted, what is younger than the second is not flushed.
AGED, FRESH = 1_704_499_200_000, 1_705_104_000_000


def _aged_engine(spark, d):
    e = Engine(spark, new_path(spark, "engine"), flush_threshold=1 << 40)
    points = model.event_points(spark, d)
    t = F.col("ts_ms")
    e.write(points.where(t < AGED))
    e.flush()
    e.compact(HOUR)
    e.write(points.where((t >= AGED) & (t < FRESH)))
    e.flush()
    e.write(points.where(t >= FRESH))
    return e


@query(PTS + ", mine AS (SELECT * FROM pts WHERE starts_with(labels, 'event_type=click,')), l1 AS (" + _l1(f"(SELECT * FROM mine WHERE ts_ms < {AGED})", HOUR) + f""")
  SELECT labels, 0 AS level, ts_ms, value, NULL::BIGINT AS count, NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS avg, NULL::DOUBLE AS p99 FROM mine
  WHERE ts_ms >= {AGED} AND ts_ms < {FRESH + 5 * DAY} UNION ALL SELECT labels, 1, bucket_start, NULL, count, min, max, round(avg, 6), round(p99, 6) FROM l1
  WHERE bucket_start >= {AGED - 3 * DAY}""")
def engine_routed_query(spark, d):
    """Matchers and a time range through the engine: buckets of what is aged, points of what is flushed or only staged."""
    e = _aged_engine(spark, d)
    r = e.query(["event_type=click"], AGED - 3 * DAY, FRESH + 5 * DAY).join(e.series(), "series_id")
    return _rounded(r.select("labels", "level", "ts_ms", "value", "count", "min", "max", "avg", "p99"), "avg", "p99")


@query(PTS + " SELECT labels, ts_ms, value FROM pts")
def engine_consolidate(spark, d):
    """Points flushed to small blocks, which are then put together: the same points from fewer blocks."""
    e = Engine(spark, new_path(spark, "engine"), flush_threshold=1 << 40)
    points, t = model.event_points(spark, d), F.col("ts_ms")
    for part in (t < AGED, (t >= AGED) & (t < FRESH), t >= FRESH):
        e.write(points.where(part))
        e.flush_blocks(ROWS_PER_BLOCK // 4)
    before = e.manifest.level(0)
    e.consolidate()
    after = e.manifest.level(0)
    least = sorted(b.row_count for b in after)[:2]
    if sum(b.row_count for b in before) != sum(b.row_count for b in after) or len(least) == 2 and sum(least) <= ROWS_PER_BLOCK:
        raise RuntimeError(f"{len(before)} blocks became {len(after)}, the smallest of {least} points")
    return e.scan(0).join(e.series(), "series_id").select("labels", "ts_ms", "value")


@query(PTS + " SELECT labels, ts_ms, value FROM pts")
def stream_ingest(spark, d):
    """Points that arrive as a stream, read back from the engine."""
    from ..streaming.ingest import ingest

    e = Engine(spark, new_path(spark, "stream-engine"), flush_threshold=1 << 40)
    source = new_path(spark, "stream-source")
    points = model.event_points(spark, d)
    points.repartition(2).write.parquet(source)
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(source)
    ingest(stream, e, new_path(spark, "stream-checkpoint"), "ingest").trigger(availableNow=True).start().awaitTermination()
    e.flush()
    return e.scan(0).join(e.series(), "series_id").select("labels", "ts_ms", "value")


@query(PTS + f", l1 AS (" + _l1("pts", DAY) + ") " + _ROUND.format(by="labels", t="l1")
       + f" WHERE bucket_start + {DAY} <= (SELECT max(ts_ms) FROM pts) - 3600000")
def stream_windowed_rollup(spark, d):
    """Daily rollups of a stream with a watermark of one hour: windows that the watermark has closed."""
    from ..streaming.ingest import windowed_rollup

    source, sink = new_path(spark, "window-source"), new_path(spark, "window-sink")
    points = model.event_points(spark, d).select("labels", F.timestamp_millis("ts_ms").alias("ts"), "value")
    points.coalesce(1).write.parquet(source)
    stream = windowed_rollup(spark.readStream.schema(points.schema).parquet(source), "1 day", "1 hour", ("labels",))
    w = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", new_path(spark, "window-checkpoint"))
    w.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return _rounded(spark.read.schema(stream.schema).parquet(sink), "avg", "p99")
