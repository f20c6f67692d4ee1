"""Documents into containers of a fixed capacity, sized in tokens.

The plan is made from the histogram of lengths, which has at most ``capacity`` entries whatever the corpus. For each of a
series of windows, from a small one up to the capacity, all combinations of up to ``DEPTH`` lengths that fill the window
exactly are enumerated; non-negative least squares finds how often each is to be used so that the histogram is used up;
the counts are rounded, and what they would take too much of is given back. A filled window is an item of the next larger
one. What the last window leaves is packed greedily, largest first. Documents then find their place by their rank among
those of the same length, in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import small, stage
from . import tokens

DEPTH, ITERATIONS = 3, 300
_SPAN = 1 << 44  # ranks of one length stay below this


def combinations(lengths: np.ndarray, total: int) -> np.ndarray:
    """Rows of up to three of the given lengths, in descending order, that add up to ``total``; 0 fills unused places."""
    have = np.zeros(total + 1, dtype=bool)
    have[lengths[(lengths > 0) & (lengths <= total)]] = True
    values = np.flatnonzero(have)
    rows = [np.array([[total, 0, 0]])] if have[total] else []
    twos = values[(values * 2 >= total) & (values < total)]
    twos = twos[have[total - twos]]
    rows.append(np.stack([twos, total - twos, np.zeros_like(twos)], axis=1))
    for a in values[(values * 3 >= total) & (values < total - 1)]:
        rest = total - a
        b = values[(values * 2 >= rest) & (values <= a) & (values < rest)]
        b = b[have[rest - b]]
        rows.append(np.stack([np.full_like(b, a), b, rest - b], axis=1))
    return np.concatenate(rows) if rows else np.zeros((0, DEPTH), dtype=np.int64)


def nonnegative_least_squares(combos: np.ndarray, histogram: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Repeat counts ``x >= 0`` that bring ``A x`` close to the histogram; ``A`` counts the lengths in each combination.

    Projected gradient steps, scaled by the rows' and columns' sums and accelerated.
    """
    n = len(histogram)
    used = (combos > 0).astype(np.float64)
    flat = combos.ravel()
    rows = np.bincount(flat, weights=used.ravel(), minlength=n)
    r_scale = np.where(rows > 0, 1 / np.maximum(rows, 1), 0.0)
    r_scale[0] = 0.0
    c_scale = 1 / used.sum(axis=1)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(iterations):
        made = np.bincount(flat, weights=(used * y[:, None]).ravel(), minlength=n)
        step = (r_scale * (histogram - made))[combos].sum(axis=1) * c_scale
        new = np.maximum(y + step, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = np.maximum(new + (t - 1) / t_new * (new - x), 0)
        x, t = new, t_new
    return x


@dataclass
class Level:
    """Slots by length and rank: units of ``slot`` = (length, first rank) and the next ranks go to the parents from
    ``parent`` on; ``taken`` units of each length are placed, the others stay for the next level, which also gets
    ``made`` units of ``size``."""

    size: int
    slots: np.ndarray
    parents: np.ndarray
    taken: np.ndarray
    left: np.ndarray
    made: int


@dataclass
class Plan:
    capacity: int
    levels: list[Level] = field(default_factory=list)
    containers: int = 0


def _apply(size: int, patterns: list[tuple[tuple[int, ...], int]], histogram: np.ndarray) -> Level:
    taken = np.zeros_like(histogram)
    slots, parents, made = [], [], 0
    for parts, repeats in patterns:
        for p in parts:
            slots.append(p * _SPAN + taken[p])
            parents.append(made)
            taken[p] += repeats
        made += repeats
    order = np.argsort(np.array(slots, dtype=np.int64), kind="stable")
    return Level(size, np.array(slots, dtype=np.int64)[order], np.array(parents, dtype=np.int64)[order], taken, histogram - taken, made)


def _rounded(combos: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Rounded repeat counts, largest first, each cut to what the histogram still has."""
    rest, out = histogram.copy(), []
    for j in np.argsort(-x, kind="stable"):
        want = int(np.rint(x[j]))
        if want <= 0:
            break
        parts = [int(p) for p in combos[j] if p]
        can = min(want, *(int(rest[p]) // parts.count(p) for p in set(parts)))
        if can > 0:
            for p in parts:
                rest[p] -= can
            out.append((tuple(parts), can))
    return out


def _greedy(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Containers of what is left: the largest length, then always the largest that fits, repeated as long as it lasts."""
    rest, out = histogram.copy(), []
    rest[0] = 0
    have = np.flatnonzero(rest)
    while len(have):
        parts: dict[int, int] = {}
        room = capacity
        while room > 0:
            i = np.searchsorted(have, room, side="right") - 1
            while i >= 0 and rest[have[i]] - parts.get(int(have[i]), 0) <= 0:
                i -= 1
            if i < 0:
                break
            p = int(have[i])
            k = min(room // p, int(rest[p]) - parts.get(p, 0))
            parts[p] = parts.get(p, 0) + k
            room -= k * p
        repeats = min(int(rest[p]) // k for p, k in parts.items())
        for p, k in parts.items():
            rest[p] -= repeats * k
        out.append((tuple(p for p, k in parts.items() for _ in range(k)), repeats))
        have = np.flatnonzero(rest)
    return out


def make_plan(histogram: np.ndarray, capacity: int) -> Plan:
    """Plan for ``histogram[length]`` items, ``0 <= length <= capacity``; items of length 0 need no room."""
    plan = Plan(capacity)
    units = histogram.astype(np.int64).copy()
    units[0] = 0
    windows = [capacity]
    while windows[0] % 2 == 0 and windows[0] > 32:
        windows.insert(0, windows[0] // 2)
    for size in windows:
        combos = combinations(np.flatnonzero(units), size)
        # A unit that fills the window by itself is one already.
        combos = combos[combos[:, 1] > 0] if size < capacity else combos
        x = nonnegative_least_squares(combos, units.astype(np.float64)) if len(combos) else np.zeros(0)
        level = _apply(size, _rounded(combos, x, units), units)
        plan.levels.append(level)
        units = level.left.copy()
        if size < capacity:
            units[size] += level.made
    last = _apply(capacity, _greedy(units, capacity), units)
    last.parents = last.parents + plan.levels[-1].made
    plan.levels.append(last)
    plan.containers = plan.levels[-2].made + last.made
    return plan


def place(plan: Plan, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Container of each item, from its length and its rank (from 0) among the items of that length."""
    length, rank = length.astype(np.int64).copy(), rank.astype(np.int64).copy()
    out = np.full(len(length), -1, dtype=np.int64)
    empty = length == 0
    out[empty] = rank[empty] % max(plan.containers, 1)
    todo = np.flatnonzero(~empty)
    for i, level in enumerate(plan.levels):
        n, r = length[todo], rank[todo]
        placed = r < level.taken[n]
        hit = todo[placed]
        if len(hit):
            key = length[hit] * _SPAN + rank[hit]
            at = np.searchsorted(level.slots, key, side="right") - 1
            parent = level.parents[at] + (key - level.slots[at])
            if level.size == plan.capacity:
                out[hit] = parent
            else:
                length[hit], rank[hit] = level.size, level.left[level.size] + parent
        rest = todo[~placed]
        rank[rest] -= level.taken[length[rest]]
        todo = rest if level.size == plan.capacity else np.concatenate([hit, rest])
        if not len(todo):
            break
    return out


def pack(items: DataFrame, capacity: int, keep: tuple[str, ...] = ("doc_id",), size: str = "n_tokens") -> DataFrame:
    """``keep..., part, tokens, container_id``: each item whole in one container, unless it alone exceeds the capacity.

    Such an item becomes full containers of its own (parts from 0) and a rest, its last part, that is packed like any
    item. An item without tokens (or with a null size) takes no room and is dealt to the containers in turn; if there is
    nothing else, all of them lie in container 0. Repeated rows are items of their own. Runs jobs: the histogram and the
    counts behind the ranks.
    """
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    spark = items.sparkSession
    n = F.coalesce(F.greatest(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    names = [f"k{i}" for i in range(len(keep))]
    uid = F.monotonically_increasing_id()
    rows = items.select(*[F.col(c).alias(k) for c, k in zip(keep, names, strict=True)], n.alias("n")).withColumn("uid", uid)
    full = F.when(F.col("n") > capacity, F.floor((F.col("n") - 1) / capacity)).otherwise(0).cast("long")
    rows = stage(rows.withColumn("full", full).withColumn("length", (F.col("n") - F.col("full") * capacity).cast("int")), "p7-items")
    total = rows.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    buckets = max(8, total // 200_000)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    counts = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("c"), F.sum("full").alias("f"))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect():  # at most capacity + 1 rows
        histogram[r["length"]] = r["c"]
    plan = make_plan(histogram, capacity)
    # Offsets: of each bucket among those of its length, and of its full containers among all.
    before = F.coalesce(F.sum("c").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = small(counts.select("length", "bucket", before.alias("offset")), "p7-offsets")
    big = rows.where("full > 0").groupBy("bucket").agg(F.sum("full").alias("f"))
    big_before = F.coalesce(F.sum("f").over(W.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    big = small(big.select("bucket", big_before.alias("first_full")), "p7-full")  # a row for 200,000 items
    ranked = rows.join(offsets, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("offset") + F.row_number().over(W.partitionBy("length", "bucket").orderBy("uid")) - 1)
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in names] + ["part long, tokens long, container_id long"])

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            where = place(plan, pdf["length"].to_numpy(), pdf["rank"].to_numpy())
            yield pdf[names].assign(part=pdf["full"], tokens=pdf["length"], container_id=where)

    last = ranked.select(*names, "full", "length", "rank").mapInPandas(assign, schema)
    own = W.partitionBy("bucket").orderBy("uid").rowsBetween(W.unboundedPreceding, -1)
    split = rows.where("full > 0").join(big, "bucket")
    split = split.withColumn("first", F.col("first_full") + F.coalesce(F.sum("full").over(own), F.lit(0)))
    parts = split.select(*names, "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("part"))
    whole = parts.select(*names, "part", F.lit(capacity).cast("long").alias("tokens"), (F.lit(plan.containers) + F.col("first") + F.col("part")).alias("container_id"))
    out = last.unionByName(whole)
    return out.select(*[F.col(k).alias(c) for k, c in zip(names, keep, strict=True)], "part", "tokens", "container_id")


def pack_documents(documents: DataFrame, capacity: int = 2048, vocabulary: str = tokens.DEFAULT_VOCABULARY) -> DataFrame:
    """Containers for the texts of ``documents``, sized in tokens of the vocabulary."""
    sized = tokens.encode(documents, vocabulary=vocabulary).select("doc_id", F.size("ids").alias("n_tokens"))
    return pack(sized, capacity)


def report(packed: DataFrame, capacity: int) -> DataFrame:
    """Containers used, the least number that could do, tokens, and the share of room that is used."""
    used = packed.groupBy("container_id").agg(F.sum("tokens").alias("t"))
    total = F.coalesce(F.sum("t"), F.lit(0))
    return used.agg(
        F.count(F.lit(1)).alias("containers"), F.ceil(total / capacity).alias("least"), total.alias("tokens"),
        F.max("t").alias("fullest"), (total / F.nullif(F.count(F.lit(1)) * capacity, F.lit(0))).alias("fill"),
    )
