"""Queries for the operators of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import packing, stuffing, tokens
from . import percentiles as pct

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.strip()
        return f

    return add


# ---- 1: percentiles

_VALUES = """WITH r AS (SELECT series_id, seq, min(value) AS v, min(ts_ms) // 86400000 AS day FROM points WHERE isfinite(value) GROUP BY 1, 2), b AS (SELECT DISTINCT * FROM rollup_buckets),
  v AS (SELECT 'series' AS scope, series_id::VARCHAR AS name, NULL::INTEGER AS level, v, day FROM r
  UNION ALL SELECT 'metric', metric, NULL, v, day FROM r LEFT JOIN (SELECT series_id, min(metric) AS metric FROM series GROUP BY 1) USING (series_id)
  UNION ALL SELECT 'rollup_p99', series_id::VARCHAR, level, p99, bucket_start // 86400000 FROM b WHERE isfinite(p99)
  UNION ALL SELECT 'rollup_count', series_id::VARCHAR, level, count::DOUBLE, bucket_start // 86400000 FROM b WHERE count IS NOT NULL),
  k AS (SELECT *, row_number() OVER (PARTITION BY scope, name, level ORDER BY v) AS rn, count(*) OVER (PARTITION BY scope, name, level) AS n FROM v)"""


_EXACT = _VALUES + """, x AS (SELECT scope, name, level, p, n, v FROM k, (SELECT unnest([0.5, 0.9, 0.99])::DOUBLE AS p)
  WHERE rn = least(greatest(ceil(round(p * n, 6)), 1), n))"""
# The exponent of each value: the logarithm's floor, put right where rounding took it over a power of two.
_EXPONENT = "(SELECT *, abs(v) AS a, floor(log2(abs(nullif(v, 0)))) AS g FROM {t})"
_POWER = "CASE WHEN a / pow(2, g) < 1 THEN g - 1 WHEN a / pow(2, g) >= 2 THEN g + 1 ELSE g END"


@query(_EXACT + " SELECT scope, name, level, p, n, v AS value FROM x")
def p1_percentiles(spark, d):
    """Exact percentiles of readings by series and by metric, and of rollup statistics by series and level."""
    values = pct.all_values(table(spark, d, "points"), table(spark, d, "series"), table(spark, d, "rollup_buckets"))
    return pct.percentiles(values, pct.BY).select(*pct.BY, "p", "n", "value")


@query(_VALUES + f""", e AS (SELECT *, {_POWER} AS e FROM {_EXPONENT.format(t='v')}), q AS (SELECT *, (e + 1022) * 512 + a / pow(2, e) * 512 AS q FROM e)
  SELECT scope, name, level, day, CASE WHEN v = 0 THEN 0 WHEN v > 0 THEN floor(q)::BIGINT ELSE -ceil(q)::BIGINT END AS cell, count(*) AS rows FROM q
  GROUP BY 1, 2, 3, 4, 5""")
def p1_daily_summaries(spark, d):
    """The mergeable form: counts of value cells for each group and day. A cell is 1/512 of a power of two."""
    days = pct.all_summaries(table(spark, d, "points"), table(spark, d, "series"), table(spark, d, "rollup_buckets"))
    return days.withColumnsRenamed({"__cell": "cell", "__w": "rows"})


@query(_EXACT + f""", e AS (SELECT *, {_POWER} AS e FROM {_EXPONENT.format(t='x')}), s AS (SELECT *, pow(2, e - 9) AS step,
  CASE WHEN v < 0 AND a = pow(2, e) THEN pow(2, e - 10) ELSE pow(2, e - 9) END AS width FROM e)
  SELECT scope, name, level, p, n, CASE WHEN v = 0 THEN 0 WHEN v > 0 THEN floor(a / step) * step ELSE -(ceil(a / step) * step) END AS low,
  CASE WHEN v = 0 THEN 8796093022207 * 4.94065645841246544e-324 WHEN v > 0 THEN floor(a / step) * step + width * (1 - pow(2, -43))
  ELSE -(ceil(a / step) * step - width * (1 - pow(2, -43))) END AS high FROM s""")
def p1_combined(spark, d):
    """Bounds of the same percentiles from the daily summaries alone: the cell that the exact value lies in."""
    days = pct.all_summaries(table(spark, d, "points"), table(spark, d, "series"), table(spark, d, "rollup_buckets"))
    return pct.from_summary(pct.combine(days, pct.BY), pct.BY)


# ---- 6: encoding

@query()
def p6_ids(spark, d):
    return tokens.encode(table(spark, d, "documents"))


# ---- 7: containers

@query()
def p7_containers(spark, d):
    return packing.pack_documents(table(spark, d, "documents"))


@query()
def p7_report(spark, d):
    return packing.report(packing.pack_documents(table(spark, d, "documents")), 2048)


# ---- 8: stuffed pages

@query()
def p8_found(spark, d):
    return stuffing.score_pages(table(spark, d, "documents")).where("stuffed").select("doc_id")


@query()
def p8_scores(spark, d):
    return stuffing.score_pages(table(spark, d, "documents"))
