import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronotier.llm import packing


def placed(histogram, capacity):
    plan = packing.make_plan(np.array(histogram, dtype=np.int64), capacity)
    length = np.repeat(np.arange(capacity + 1), histogram)
    rank = np.concatenate([np.arange(n) for n in histogram]) if len(length) else np.zeros(0, np.int64)
    return plan, length, packing.place(plan, length, rank)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=300))
def test_every_item_has_a_place_and_no_container_overflows(items):
    histogram = np.bincount(items, minlength=65)[:65] if items else np.zeros(65, np.int64)
    plan, length, where = placed(histogram, 64)
    assert (where >= 0).all()
    fill = np.bincount(where, weights=length, minlength=1)
    assert fill.max(initial=0) <= 64
    assert plan.containers <= max(1, len(items))


def test_combinations_fill_the_window_exactly():
    got = {tuple(r) for r in packing.combinations(np.arange(1, 13), 12)}
    want = {(12, 0, 0)} | {(a, 12 - a, 0) for a in range(6, 12)} | {(a, b, 12 - a - b) for a in range(1, 11) for b in range(1, a + 1) if 1 <= 12 - a - b <= b}
    assert got == want


def test_least_squares_uses_the_histogram_up():
    combos = packing.combinations(np.arange(1, 33), 32)
    rnd = np.random.default_rng(0)
    truth = np.zeros(len(combos))
    truth[rnd.integers(0, len(combos), 20)] = rnd.integers(10, 90, 20)
    h = np.zeros(33)
    for c, x in zip(combos, truth):
        for p in c[c > 0]:
            h[p] += x
    x = packing.nonnegative_least_squares(combos, h, 2000)
    made = np.zeros(33)
    for c, k in zip(combos, x):
        for p in c[c > 0]:
            made[p] += k
    assert (x >= 0).all() and np.abs(made - h)[1:].sum() < 0.02 * h.sum()


def test_room_is_used(spark):
    rnd = random.Random(1)
    rows = [(i, min(5000, int(rnd.lognormvariate(4.2, 1.1)))) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    out = packing.pack(df, 2048)
    rep = packing.report(out, 2048).first()
    assert rep["fullest"] <= 2048 and rep["containers"] <= 1.02 * rep["least"] + 1
    assert rep["tokens"] == sum(n for _, n in rows)
    parts = Counter()
    for r in out.collect():
        parts[r["doc_id"]] += 1
    assert all(parts[i] == max(1, -(-n // 2048)) for i, n in rows)


@pytest.mark.parametrize(
    ("sizes", "containers"),
    [([], 0), ([0, 0, None], 1), ([10, 10, 10], 3), ([25], 3), ([20, 5, 5], 3), ([3, 3, 4, 10, 0], 2), ([30, 30], 6)],
)
def test_small_cases(spark, sizes, containers):
    df = spark.createDataFrame([(1, n, "x") for n in sizes], "doc_id long, n_tokens long, k0 string")  # repeated ids, a clashing name
    out = packing.pack(df, 10).collect()
    fill = Counter()
    for r in out:
        fill[r["container_id"]] += r["tokens"]
    assert len(fill) == containers and max(fill.values(), default=0) <= 10
    assert sum(fill.values()) == sum(n or 0 for n in sizes)
    assert len(out) == sum(max(1, -(-(n or 0) // 10)) for n in sizes)


def test_ranks_and_hot_length(spark):
    df = spark.createDataFrame([(i, 7) for i in range(3000)] + [(i, 3) for i in range(3000, 6000)], "doc_id long, n_tokens long")
    rep = packing.report(packing.pack(df, 10), 10).first()
    assert rep["containers"] == rep["least"] == 3000
    with pytest.raises(ValueError):
        packing.pack(df, 0)
