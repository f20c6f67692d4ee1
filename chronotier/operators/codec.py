"""Delta-of-delta and XOR compression of points, after the published Gorilla scheme, and its size as a plain plan.

A stream begins with the first time and the first value in 64 bits each. A later time takes a prefix and the change of
its delta, a later value its XOR with the value before. Bits go from the most significant end; the last byte is padded
with zeros.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bucket_start, raw_bits

# Fixed values of the format: prefix, prefix length, field length; a field reaches from -(2^(n-1) - 1) to 2^(n-1), the
# upper end being written as all zeros, since a change of 0 has a code of its own.
FIELDS = ((0b10, 2, 7), (0b110, 3, 9), (0b1110, 4, 12), (0b1111, 4, 32))
MAX_LEADING, LEADING_BITS, LENGTH_BITS = 31, 5, 6
RAW_BITS = 64


def pack_bits(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Joins unsigned fields of the given widths, most significant bit first."""
    widths = np.asarray(widths, dtype=np.int64)
    ends = np.cumsum(widths)
    if not len(ends) or ends[-1] == 0:
        return b""
    at = np.repeat(np.arange(len(widths)), widths)
    shift = (np.repeat(ends, widths) - 1 - np.arange(ends[-1])).astype(np.uint64)
    bits = (np.asarray(values, dtype=np.uint64)[at] >> shift) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    """Bits up to the highest one that is set, of unsigned 64-bit numbers."""
    out = np.zeros(len(x), dtype=np.int64)
    for part, base in ((x >> np.uint64(32), 32), (x & np.uint64(0xFFFFFFFF), 0)):
        n = np.frexp(part.astype(np.float64))[1]
        out = np.where((part > 0) & (out == 0), n + base, out)
    return out


def _time_fields(ts: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Two fields a point, prefix and time, with their widths (0 leaves a field out), and whether the largest is wide."""
    n = len(ts)
    val, wid = np.zeros((n, 2), dtype=np.uint64), np.zeros((n, 2), dtype=np.int64)
    val[0, 0], wid[0, 0] = ts[:1].view(np.uint64)[0], RAW_BITS
    change = np.diff(np.diff(ts), prepend=0) if n > 1 else np.empty(0, np.int64)
    wide = bool(((change > 1 << 31) | (change < -(1 << 31) + 1)).any())
    kind = np.select([change == 0] + [(change >= -(1 << (w - 1)) + 1) & (change <= 1 << (w - 1)) for _, _, w in FIELDS[:3]], [0, 1, 2, 3], 4)
    prefix = np.array([0, *[f[0] for f in FIELDS]], dtype=np.uint64)
    prefix_bits = np.array([1, *[f[1] for f in FIELDS]])
    width = np.array([0, *[f[2] for f in FIELDS[:3]], 64 if wide else 32])[kind]
    top = np.left_shift(np.int64(1), np.minimum(width, 63) - 1, where=width > 0, out=np.zeros(len(change), np.int64))
    field = np.where((width > 0) & (width < 64) & (change == top), 0, change).view(np.uint64)
    mask = np.where(width >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(width, 63).astype(np.uint64)) - np.uint64(1))
    val[1:, 0], wid[1:, 0], val[1:, 1], wid[1:, 1] = prefix[kind], prefix_bits[kind], field & mask, width
    return val, wid, wide


def encode(ts: np.ndarray, values: np.ndarray) -> tuple[bytes, bool]:
    """The stream of points in the given order, and whether its largest time field is wide.

    The format's catch-all field has 32 bits and can't hold a change of 25 days or more; a stream that has one writes
    that field with 64 bits and is marked as wide, so that it comes back as it was.
    """
    ts = np.asarray(ts, dtype=np.int64)
    bits = np.asarray(values, dtype=np.float64).view(np.uint64)
    n = len(ts)
    if n == 0:
        return b"", False
    t_val, t_wid, wide = _time_fields(ts)
    # Two fields a value: head and bits.
    val, wid = np.zeros((n, 2), dtype=np.uint64), np.zeros((n, 2), dtype=np.int64)
    val[0, 0], wid[0, 0] = bits[0], RAW_BITS
    if n > 1:
        xor = bits[1:] ^ bits[:-1]
        leading = np.minimum(64 - _bit_lengths(xor), MAX_LEADING)
        trailing = np.where(xor == 0, 0, _bit_lengths(xor & (~xor + np.uint64(1))) - 1)
        length = 64 - leading - trailing
        some = np.flatnonzero(xor)
        same = np.zeros(n - 1, dtype=bool)
        same[some[1:]] = (leading[some[1:]] == leading[some[:-1]]) & (length[some[1:]] == length[some[:-1]])
        head = (np.uint64(0b11) << np.uint64(LEADING_BITS + LENGTH_BITS)) | (leading.astype(np.uint64) << np.uint64(LENGTH_BITS)) | (length - 1).astype(np.uint64)
        zero = xor == 0
        val[1:, 0] = np.where(zero, 0, np.where(same, np.uint64(0b10), head))
        wid[1:, 0] = np.where(zero, 1, np.where(same, 2, 2 + LEADING_BITS + LENGTH_BITS))
        val[1:, 1], wid[1:, 1] = xor >> trailing.astype(np.uint64), np.where(zero, 0, length)
    return pack_bits(np.hstack([t_val, val]).ravel(), np.hstack([t_wid, wid]).ravel()), wide


class _Bits:
    """Many streams read in step: each call takes a field from every stream, of a width of its own."""

    def __init__(self, streams: list[bytes]):
        self.ends = np.array([8 * len(s) for s in streams], dtype=np.int64)
        words = [np.frombuffer(s + bytes(16 - len(s) % 8), dtype=">u8") for s in streams]  # one word to spare
        self.words = np.concatenate(words).astype(np.uint64)
        size = np.array([len(w) for w in words])
        self.first = np.cumsum(size) - size
        self.at = np.zeros(len(streams), dtype=np.int64)

    def take(self, width: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The next ``width`` bits of the streams ``of``; 0 where the width is 0. A stream that is too short raises."""
        at = self.at[of]
        if (at + width > self.ends[of]).any():
            raise ValueError("a stream ends before its last point")
        w, off = self.first[of] + (at >> 6), (at & 63).astype(np.uint64)
        high = self.words[w] << off
        low = np.where(off > 0, self.words[w + 1] >> ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        self.at[of] = at + width
        return np.where(width > 0, (high | low) >> (np.uint64(64) - np.maximum(width, 1).astype(np.uint64)), np.uint64(0))


class _Times:
    """The times of many streams, one point further at each call."""

    def __init__(self, bits: _Bits, wide: np.ndarray):
        self.bits, self.delta, self.last = bits, np.zeros(len(wide), np.int64), np.zeros(len(wide), np.int64)
        self.widths = np.stack([np.full(len(wide), f[2]) for f in FIELDS[:3]] + [np.where(wide, 64, FIELDS[3][2])], axis=1)

    def first(self, of: np.ndarray) -> np.ndarray:
        self.last[of] = self.bits.take(np.full(len(of), RAW_BITS), of).view(np.int64)
        return self.last[of]

    def next(self, of: np.ndarray) -> np.ndarray:
        one, ones, going = np.ones(len(of), np.int64), np.zeros(len(of), np.int64), np.arange(len(of))
        for _ in range(4):
            going = going[self.bits.take(one[going], of[going]) == 1]
            ones[going] += 1
            if not len(going):
                break
        width = np.where(ones > 0, self.widths[of, np.maximum(ones, 1) - 1], 0)
        code = self.bits.take(width, of).view(np.int64)
        half = np.int64(1) << (np.clip(width, 1, 63) - 1)
        signed = np.where((code == 0) & (width < 64), half, np.where((width < 64) & (code >= half), code - 2 * half, code))
        self.delta[of] += np.where(ones > 0, signed, 0)
        self.last[of] += self.delta[of]
        return self.last[of]


def decode_many(streams: list[bytes], points: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and values of all streams, one after the other; a stream too short for its points raises.

    The streams advance together, a point at a step, each step a few operations on arrays over all streams.
    """
    points = np.asarray(points, dtype=np.int64)
    start = np.cumsum(points) - points
    ts, out = np.zeros(points.sum(), dtype=np.int64), np.zeros(points.sum(), dtype=np.uint64)
    bits, n = _Bits(streams), len(streams)
    times = _Times(bits, np.asarray(wide, dtype=bool))
    lead, size, last = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.uint64)
    order = np.argsort(-points, kind="stable")
    left = np.searchsorted(-points[order], -np.arange(1, points.max(initial=0) + 1), side="right")  # streams with so many points
    for i, k in enumerate(left):
        of = order[:k]
        ts[start[of] + i] = times.next(of) if i else times.first(of)
        if not i:
            last[of] = bits.take(np.full(k, RAW_BITS), of)
        else:
            changed = of[bits.take(np.ones(k, np.int64), of) == 1]
            fresh = changed[bits.take(np.ones(len(changed), np.int64), changed) == 1]
            lead[fresh] = bits.take(np.full(len(fresh), LEADING_BITS), fresh).astype(np.int64)
            size[fresh] = bits.take(np.full(len(fresh), LENGTH_BITS), fresh).astype(np.int64) + 1
            field = bits.take(size[changed], changed)
            last[changed] ^= field << (64 - lead[changed] - size[changed]).astype(np.uint64)
        out[start[of] + i] = last[of]
    return ts, out.view(np.float64)


def decode(data: bytes, n: int, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Times and values of the ``n`` points of a stream; a stream too short for them raises."""
    return decode_many([data], np.array([n]), np.array([wide]))


#: The statistics of a rollup row after its time, in their order: 32 bits of count, 64 of each other.
STATISTICS = ("min", "max", "avg", "p99")
#: A statistic that is null is written as a NaN of its own.
NULL_BITS = np.uint64(0x7FF8_0000_0000_0001)


def encode_rollup(starts: np.ndarray, counts: np.ndarray, statistics: np.ndarray, null: np.ndarray) -> tuple[bytes, bool]:
    """The stream of rollup rows in the given order: the time as in a stream of points, the statistics as they are."""
    if not len(starts):
        return b"", False
    counts = np.asarray(counts, dtype=np.int64)
    if (counts < 0).any() or (counts >> 32).any():
        raise ValueError("a count must fit into 32 bits")
    val, wid, wide = _time_fields(np.asarray(starts, dtype=np.int64))
    raw = np.where(null, NULL_BITS, np.ascontiguousarray(statistics, dtype=np.float64).view(np.uint64))
    val = np.hstack([val, counts[:, None].astype(np.uint64), raw])
    wid = np.hstack([wid, np.full((len(starts), 1), 32), np.full(raw.shape, RAW_BITS)])
    return pack_bits(val.ravel(), wid.ravel()), wide


def decode_rollups(streams: list[bytes], rows: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, counts, statistics and which of these are null, of all streams, one after the other."""
    rows = np.asarray(rows, dtype=np.int64)
    start, total = np.cumsum(rows) - rows, int(rows.sum())
    ts, counts, raw = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros((total, len(STATISTICS)), np.uint64)
    bits = _Bits(streams)
    times = _Times(bits, np.asarray(wide, dtype=bool))
    order = np.argsort(-rows, kind="stable")
    for i, k in enumerate(np.searchsorted(-rows[order], -np.arange(1, rows.max(initial=0) + 1), side="right")):
        of = order[:k]
        ts[start[of] + i] = times.next(of) if i else times.first(of)
        counts[start[of] + i] = bits.take(np.full(k, 32), of).astype(np.int64)
        for j in range(len(STATISTICS)):
            raw[start[of] + i, j] = bits.take(np.full(k, RAW_BITS), of)
    return ts, counts, raw.view(np.float64), raw == NULL_BITS


STREAMS = "points long, wide boolean, data binary"


def encode_points(points: DataFrame, by: list[str]) -> DataFrame:
    """One compressed stream for each group of ``by``, in the order of time and value.

    A group is one task and must fit into it: for series of any length ``by`` should hold a block, or the bucket that
    ``by_time`` adds, which cuts a series into streams of their own. Points without a time or value are left out: the format
    has no null.
    """
    kinds = dict(points.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + [STREAMS])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts_ms", "value"], kind="stable")
        data, wide = encode(pdf["ts_ms"].to_numpy(), pdf["value"].to_numpy())
        return pdf[by].head(1).assign(points=len(pdf), wide=wide, data=data)

    kept = points.where("ts_ms IS NOT NULL AND value IS NOT NULL").select(*by, "ts_ms", "value")
    return kept.groupBy(*by).applyInPandas(one, schema)


def decode_points(streams: DataFrame, by: list[str]) -> DataFrame:
    kinds = dict(streams.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + ["ts_ms long, value double, __nan boolean"])

    def each(frames):
        for pdf in frames:
            if len(pdf):
                points = pdf["points"].to_numpy()
                ts, values = decode_many(list(pdf["data"]), points, pdf["wide"].to_numpy())
                out = pdf[by].loc[pdf.index.repeat(points)].reset_index(drop=True)
                yield out.assign(ts_ms=ts, value=values, __nan=np.isnan(values))

    out = streams.select(*by, "points", "wide", "data").mapInPandas(each, schema)
    # On the way back from Python a NaN becomes null.
    return out.select(*by, "ts_ms", F.when(F.col("__nan"), float("nan")).otherwise(F.col("value")).alias("value"))


def by_time(points: DataFrame, width_ms: int, name: str = "stream_start", ts: str = "ts_ms") -> DataFrame:
    """Adds the start of the time bucket, by which long series are cut into streams of bounded length."""
    return points.withColumn(name, bucket_start(F.col(ts), width_ms))


def encode_rollups(rollup: DataFrame, by: list[str]) -> DataFrame:
    """One stream for each group of ``by``, in the order of start and statistics: ``by..., points, wide, data``.

    Rows without a start or a count are left out; null statistics come back as null, other NaNs as NaN.
    """
    kinds = dict(rollup.dtypes)
    order = ["bucket_start", "count", *STATISTICS]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        null = pdf[[f"__{c}" for c in STATISTICS]].to_numpy(dtype=bool)
        data, wide = encode_rollup(pdf["bucket_start"].to_numpy(), pdf["count"].to_numpy(), pdf[list(STATISTICS)].to_numpy(dtype=np.float64), null)
        return pdf[by].head(1).assign(points=len(pdf), wide=wide, data=data)

    kept = rollup.where("bucket_start IS NOT NULL AND count IS NOT NULL").select(*by, *order, *[F.col(c).isNull().alias(f"__{c}") for c in STATISTICS])
    return kept.groupBy(*by).applyInPandas(one, ", ".join([f"`{c}` {kinds[c]}" for c in by] + [STREAMS]))


def decode_rollup_streams(streams: DataFrame, by: list[str]) -> DataFrame:
    """``by..., bucket_start, count, min, max, avg, p99`` of each row."""
    kinds = dict(streams.dtypes)
    columns = [f"`{c}` {kinds[c]}" for c in by] + ["bucket_start long, count long", *[f"{c} double, __{c} boolean, __nan_{c} boolean" for c in STATISTICS]]

    def each(frames):
        for pdf in frames:
            if len(pdf):
                rows = pdf["points"].to_numpy()
                ts, counts, values, null = decode_rollups(list(pdf["data"]), rows, pdf["wide"].to_numpy())
                out = pdf[by].loc[pdf.index.repeat(rows)].reset_index(drop=True).assign(bucket_start=ts, count=counts)
                yield out.assign(**{k: v for j, c in enumerate(STATISTICS) for k, v in ((c, values[:, j]), (f"__{c}", null[:, j]), (f"__nan_{c}", np.isnan(values[:, j])))})

    out = streams.select(*by, "points", "wide", "data").mapInPandas(each, ", ".join(columns))
    return out.select(*by, "bucket_start", "count", *[F.when(F.col(f"__{c}"), F.lit(None)).when(F.col(f"__nan_{c}"), float("nan")).otherwise(F.col(c)).alias(c) for c in STATISTICS])


def point_sizes(points: DataFrame, by: list[str]) -> DataFrame:
    """Each point with the bits that its time (``ts_bits``) and value (``value_bits``) take in the stream of its group.

    The window a value is compared with is that of the last value that changed, so all of it is lag and last-non-null;
    no bit is packed. Points without a time or value are left out.
    """
    w = W.partitionBy(*by).orderBy("ts_ms", "value")
    p = points.where("ts_ms IS NOT NULL AND value IS NOT NULL").select(*by, "ts_ms", "value", raw_bits(F.col("value")).alias("__bits"))
    p = p.withColumn("__n", F.row_number().over(w)).withColumn("__delta", F.col("ts_ms") - F.lag("ts_ms").over(w))
    p = p.withColumn("dod", F.col("__delta") - F.coalesce(F.lag("__delta").over(w), F.lit(0)))
    p = p.withColumn("__xor", F.col("__bits").bitwiseXOR(F.lag("__bits").over(w)))
    text = F.bin("__xor")
    lead = F.least(F.lit(64) - F.length(text), F.lit(MAX_LEADING))
    trail = F.length(text) - F.length(F.rtrim(text, F.lit("0")))
    changed = F.col("__xor") != 0
    p = p.withColumn("__window", F.when(changed, F.struct(lead.alias("lead"), (F.lit(64) - lead - trail).alias("size"))))
    before = F.last("__window", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    p = p.withColumn("__before", before)
    ts_bits = F.when(F.col("__n") == 1, RAW_BITS).when(F.col("dod") == 0, 1)
    for _, head, width in FIELDS[:3]:
        ts_bits = ts_bits.when(F.col("dod").between(-(1 << (width - 1)) + 1, 1 << (width - 1)), head + width)
    ts_bits = ts_bits.otherwise(FIELDS[3][1] + FIELDS[3][2])
    same = F.col("__window").eqNullSafe(F.col("__before"))
    value_bits = F.when(F.col("__n") == 1, RAW_BITS).when(~changed, 1).when(same, 2 + F.col("__window.size")).otherwise(
        2 + LEADING_BITS + LENGTH_BITS + F.col("__window.size")
    )
    return p.select(*by, "ts_ms", "value", "dod", ts_bits.alias("ts_bits"), value_bits.alias("value_bits"))


def stream_sizes(points: DataFrame, by: list[str]) -> DataFrame:
    """Points and bytes of each group's stream."""
    bits = F.sum(F.col("ts_bits") + F.col("value_bits"))
    return point_sizes(points, by).groupBy(*by).agg(F.count(F.lit(1)).alias("points"), F.ceil(bits / 8).cast("long").alias("bytes"))


def compression_report(sizes: DataFrame) -> DataFrame:
    """Points, bytes, bytes a point, and how many times smaller that is than 16 bytes a point."""
    n, b = F.coalesce(F.sum("points"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))
    return sizes.agg(n.alias("points"), b.alias("bytes"), (b / F.nullif(n, F.lit(0))).alias("bytes_per_point"), (n * 16 / F.nullif(b, F.lit(0))).alias("ratio"))


def rollup_sizes(rollup: DataFrame, by: list[str]) -> DataFrame:
    """Bytes of each group's rollup stream: times as above, the five statistics raw (32 bits of count, 64 of the rest)."""
    starts = rollup.select(*by, F.col("bucket_start").alias("ts_ms"), F.lit(0.0).alias("value"))
    bits = F.sum(F.col("ts_bits") + 32 + 4 * 64)
    return point_sizes(starts, by).groupBy(*by).agg(F.count(F.lit(1)).alias("buckets"), F.ceil(bits / 8).cast("long").alias("bytes"))
