"""Explicit table schemas; nothing in the engine infers a schema from data."""

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}
    return T.StructType([T.StructField(n, kinds[k], True) for n, k in (p.split(":") for p in spec.split())])


POINTS = _struct("series_id:long ts_ms:long value:double")
STAGED = _struct("series_id:long ts_ms:long value:double seq:long")
SERIES = _struct("series_id:long labels:string")
POSTINGS = _struct("label:string series_id:long")
ROLLUP = _struct("series_id:long bucket_start:long count:long min:double max:double avg:double p99:double")
BLOCKS = _struct(
    "level:int block_id:long series_count:long row_count:long bytes:long min_ts:long max_ts:long created_at:long"
)
QUERY_STATS = _struct("level:int scanned:long skipped:long")

#: Result of a routed query: one long table, each row tagged with the level it comes from (0 = raw points).
RESULT = _struct(
    "series_id:long level:int ts_ms:long value:double count:long min:double max:double avg:double p99:double"
)

LEVELS = (0, 1, 2, 3)
