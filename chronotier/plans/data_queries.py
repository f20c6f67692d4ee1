"""Queries for the data pipeline operators of the core: p2 to p5."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anomalies, consolidation
from ..operators import regrid as grid_ops
from ..operators import trailing as trailing_ops
from ..session import table

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.strip()
        return f

    return add


# ---- 3: totals over trailing periods

_DAILY = """WITH r AS (SELECT DISTINCT * FROM rollup_buckets WHERE level IN (1, 2)), d AS (SELECT series_id, bucket_start // 86400000 AS day,
  sum(coalesce(count, 0)) AS n, sum(avg * count) FILTER (isfinite(avg)) AS total, sum(count) FILTER (isfinite(avg)) AS weight FROM r GROUP BY 1, 2),
  span AS (SELECT series_id, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1), spine AS (SELECT series_id, unnest(range(lo, hi + 1)) AS day FROM span)"""


def _over(n: int) -> str:
    return f"(PARTITION BY series_id ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query(_DAILY + f""" SELECT series_id, strftime(DATE '1970-01-01' + day::INTEGER, '%Y-%m-%d') AS day_utc,
  CAST(sum(coalesce(n, 0)) OVER {_over(7)} AS BIGINT) AS count_7, round(sum(total) OVER {_over(7)} / nullif(sum(weight) OVER {_over(7)}, 0) + 1e-9, 6) AS avg_7,
  CAST(sum(coalesce(n, 0)) OVER {_over(30)} AS BIGINT) AS count_30, round(sum(total) OVER {_over(30)} / nullif(sum(weight) OVER {_over(30)}, 0) + 1e-9, 6) AS avg_30
  FROM spine LEFT JOIN d USING (series_id, day)""")
def p3_trailing(spark, d):
    t = trailing_ops.trailing(table(spark, d, "rollup_buckets"))
    return t.select("series_id", "day_utc", "count_7", F.round(F.col("avg_7") + 1e-9, 6).alias("avg_7"), "count_30", F.round(F.col("avg_30") + 1e-9, 6).alias("avg_30"))


@query(_DAILY + """, a AS (SELECT series_id, day, lead(day) OVER (PARTITION BY series_id ORDER BY day) AS next FROM d WHERE n > 0)
  SELECT series_id, strftime(DATE '1970-01-01' + unnest(range(day + 7, next))::INTEGER, '%Y-%m-%d') AS day_utc FROM a
  WHERE next - day - 1 BETWEEN 7 AND 19""")
def p3_found(spark, d):
    return trailing_ops.silent_weeks(trailing_ops.trailing(table(spark, d, "rollup_buckets")))


# ---- 5: a regular grid

_SLOTS = """WITH k AS (SELECT DISTINCT series_id, step_ms, ts_ms, ts_ms - ts_ms % step_ms AS slot FROM points JOIN series USING (series_id) WHERE isfinite(value)),
  n AS (SELECT *, lead(ts_ms) OVER w AS next_ts, lead(slot) OVER w AS next_slot FROM k WINDOW w AS (PARTITION BY series_id ORDER BY ts_ms))"""


@query(_SLOTS + """, o AS (SELECT series_id, ts_ms - ts_ms % step_ms AS slot_ms, arg_max(value, (ts_ms, seq, value)) AS value FROM points
  JOIN series USING (series_id) WHERE isfinite(value) GROUP BY 1, 2) SELECT series_id, slot_ms, value, 'observed' AS status FROM o UNION ALL
  SELECT series_id, unnest(range(slot + step_ms, next_slot, step_ms)), NULL, CASE WHEN next_ts - ts_ms <= 21600000 THEN 'filled' ELSE 'missing' END
  FROM n WHERE next_ts - ts_ms <= 259200000""")
def p5_slots(spark, d):
    """All slots with their status, and the values that were observed (interpolated ones are tested against numpy)."""
    g = grid_ops.regrid(table(spark, d, "points"), table(spark, d, "series"))
    return g.withColumn("value", F.when(F.col("status") == "observed", F.col("value")))


# The slope at a knot is the harmonic mean of both secants weighted by the intervals, 0 at a turn; at the end of a segment it
# is that of the parabola through three knots, kept within what is monotone.
_INNER = "CASE WHEN {a} * {b} <= 0 THEN 0 ELSE (3 * {h} + 3 * {g}) / ((2 * {g} + {h}) / {a} + ({g} + 2 * {h}) / {b}) END"
_END = """CASE WHEN {b} IS NULL THEN {a} WHEN ((2 * {h} + {g}) * {a} - {h} * {b}) / ({h} + {g}) * {a} <= 0 THEN 0
  WHEN {a} * {b} <= 0 AND abs(((2 * {h} + {g}) * {a} - {h} * {b}) / ({h} + {g})) > abs(3 * {a}) THEN 3 * {a} ELSE ((2 * {h} + {g}) * {a} - {h} * {b}) / ({h} + {g}) END"""
_S0 = "CASE WHEN dm IS NULL THEN " + _END.format(a="d", b="dp", h="h", g="hp") + " ELSE " + _INNER.format(a="dm", b="d", h="hm", g="h") + " END"
_S1 = "CASE WHEN dp IS NULL THEN " + _END.format(a="d", b="dm", h="h", g="hm") + " ELSE " + _INNER.format(a="d", b="dp", h="h", g="hp") + " END"


@query("""WITH k AS (SELECT series_id, step_ms, ts_ms - ts_ms % step_ms AS slot, min(ts_ms) AS first_ts, max(ts_ms) AS ts, arg_max(value, (ts_ms, seq, value)) AS y
  FROM points JOIN series USING (series_id) WHERE isfinite(value) GROUP BY 1, 2, 3),
  w AS (SELECT *, lead(slot) OVER o AS slot1, lead(first_ts) OVER o AS first1, lead(ts) OVER o AS ts1, lead(y) OVER o AS y1, lead(first_ts, 2) OVER o AS first2,
  lead(ts, 2) OVER o AS ts2, lead(y, 2) OVER o AS y2, lag(ts) OVER o AS ts0, lag(y) OVER o AS y0 FROM k WINDOW o AS (PARTITION BY series_id ORDER BY slot)),
  i AS (SELECT *, first1 - ts AS gap, (ts1 - ts)::DOUBLE AS h, (y1 - y) / (ts1 - ts)::DOUBLE AS d,
  CASE WHEN first_ts - ts0 <= 259200000 THEN (ts - ts0)::DOUBLE END AS hm, CASE WHEN first_ts - ts0 <= 259200000 THEN (y - y0) / (ts - ts0)::DOUBLE END AS dm,
  CASE WHEN first2 - ts1 <= 259200000 THEN (ts2 - ts1)::DOUBLE END AS hp, CASE WHEN first2 - ts1 <= 259200000 THEN (y2 - y1) / (ts2 - ts1)::DOUBLE END AS dp FROM w),
  m AS (SELECT *, """ + _S0 + " AS s0, " + _S1 + """ AS s1 FROM i WHERE gap <= 259200000),
  f AS (SELECT *, unnest(range(slot + step_ms, slot1, step_ms)) AS place FROM m), x AS (SELECT *, (place - ts) / h AS x FROM f)
  SELECT series_id, slot AS slot_ms, round(y + 1e-9, 6) AS value, 'observed' AS status FROM k UNION ALL
  SELECT series_id, place, CASE WHEN gap <= 21600000 THEN round(greatest(least(y, y1), least(greatest(y, y1), (2 * x * x * x - 3 * x * x + 1) * y + (x * x * x - 2 * x * x + x) * h * s0
  + (3 * x * x - 2 * x * x * x) * y1 + (x * x * x - x * x) * h * s1)) + 1e-9, 6) END, CASE WHEN gap <= 21600000 THEN 'filled' ELSE 'missing' END FROM x""")
def p5_regular(spark, d):
    """The whole grid: observed values, those of the monotone cubic, and missing slots."""
    g = grid_ops.regrid(table(spark, d, "points"), table(spark, d, "series"))
    return g.withColumn("value", F.round(F.col("value") + 1e-9, 6))


@query(_SLOTS + """ SELECT series_id, unnest(range(slot + step_ms, next_slot, step_ms)) AS slot_ms FROM n WHERE next_ts - ts_ms <= 259200000""")
def p5_found(spark, d):
    return grid_ops.missing_slots(grid_ops.regrid(table(spark, d, "points"), table(spark, d, "series")))


# ---- 2: far too many small files

_LIVE_L0 = r"""live AS (SELECT DISTINCT CAST(regexp_extract(lower(trim(filename)), '(\d+)\.blk$', 1) AS BIGINT) AS block_id FROM manifest
  WHERE level = 0 AND regexp_matches(lower(trim(filename)), '\d\.blk$'))"""
_LIVE_POINTS = f"""WITH {_LIVE_L0}, p AS (SELECT DISTINCT series_id, ts_ms, value, block_id FROM points SEMI JOIN live USING (block_id))"""


@query(_LIVE_POINTS + """, m AS (SELECT block_id, series_id, ts_ms, coalesce(value, 1e308) AS value FROM p), n AS (SELECT block_id, count(*) AS n FROM m GROUP BY 1),
  c AS (SELECT a.block_id AS a, b.block_id AS b, count(*) AS k FROM m a JOIN m b USING (series_id, ts_ms, value) WHERE a.block_id < b.block_id GROUP BY 1, 2)
  SELECT a AS block_a, b AS block_b FROM c JOIN n x ON x.block_id = a JOIN n y ON y.block_id = b WHERE k = least(x.n, y.n)""")
def p2_found(spark, d):
    done = consolidation.consolidate(table(spark, d, "points"), table(spark, d, "manifest"))
    return consolidation.contained_blocks(done)


@query(_LIVE_POINTS + " SELECT series_id, ts_ms, value, min(block_id) AS owner FROM p GROUP BY 1, 2, 3")
def p2_consolidated(spark, d):
    done = consolidation.consolidate(table(spark, d, "points"), table(spark, d, "manifest"))
    return done.points.select("series_id", "ts_ms", "value", "owner")


@query(f"""WITH {_LIVE_L0}, said AS (SELECT block_id, row_count AS summary_rows FROM blocks WHERE level = 0
  QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY created_at DESC NULLS LAST, row_count DESC NULLS LAST) = 1),
  held AS (SELECT block_id, count(*) AS rows FROM points GROUP BY 1)
  SELECT block_id, summary_rows, coalesce(rows, 0) AS rows, rows IS NULL AS absent FROM live LEFT JOIN said USING (block_id) LEFT JOIN held USING (block_id)""")
def p2_audit(spark, d):
    """Live blocks as summarised and as found."""
    return consolidation.audit(table(spark, d, "points"), table(spark, d, "manifest"), table(spark, d, "blocks"))


@query()
def p2_files(spark, d):
    """The files written: rows, checksum and source blocks of each."""
    return consolidation.consolidate(table(spark, d, "points"), table(spark, d, "manifest")).files


# ---- 4: implausible readings

def _p4(spark, d, flagged_only):
    return anomalies.score_readings(table(spark, d, "points"), table(spark, d, "series"), table(spark, d, "metric_specs"), flagged_only=flagged_only)


@query()
def p4_found(spark, d):
    return anomalies.implausible_records(table(spark, d, "points"), _p4(spark, d, True))


@query()
def p4_scores(spark, d):
    """Every reading with its score and flags."""
    return _p4(spark, d, False)
