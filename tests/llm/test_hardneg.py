"""Hard negatives against brute force: clustered and random vectors, ties, windows of few rows, odd rows; the walk of the heap."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrospark.llm import hardneg as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=5, scale=256, k=5):
    seen = []
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        seen.append((i, [math.floor(scale * float(np.float32(x))) for x in v], lab))
    out = []
    for a, av, al in seen:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(av, bv)), b, bl) for b, bv, bl in seen]
        pos = sorted((s, b) for s, b, bl in scored if bl == al and b != a)[:k]
        for s, p in pos:
            neg = sorted((n, b) for n, b, bl in scored if bl != al and 80 * -s <= 100 * -n <= 100 * -s)[:k]
            out += [(a, p, r + 1, b, -s, -n) for r, (n, b) in enumerate(neg)]
    return sorted(out)


def mined(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "q", "anchor", "v", "pack", "score")})
    return sorted(tuple(r) for r in H.hard_negatives(docs, F.col("vec_id") % 5 == 0, **options).collect())


def clustered(rng, n, dim=8, groups=6):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    return [(i, [c + rng.gauss(0, 0.1) for c in centres[i % groups]], rng.randrange(3)) for i in range(n)]


def test_clusters(spark):
    rows = clustered(random.Random(1), 400)
    assert mined(spark, rows) == plain(rows)


def test_ties_hot_vectors_and_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.01, 0.0, 0.01, 0.02]) for _ in range(4)], rng.randrange(2)) for i in range(200)]
    rows += [(200 + i, [0.02, 0.02, 0.0, 0.0], i % 2) for i in range(150)]
    rows += [(5, [0.02, 0.0, 0.0, 0.0], 0), (None, [1.0] * 4, 0), (1000, None, 0), (1005, [1.0, None, 0.0, 0.0], 0), (1010, [math.nan] * 4, 1), (1015, [math.inf, 0.0, 0.0, 0.0], 1),
             (1020, [0.02] * 4, None), (1025, [], 0), (1030, [0.02, 0.01], 1), (1035, [-0.02, -0.02, 0.0, 0.0], 1)]
    assert mined(spark, rows, sample=64) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.5], 0)], [(5, [0.5, 0.5], 0)], [(5, [0.5], 0), (6, [0.4], 0), (7, [0.4], 1)], [(5, [-0.5], 0), (6, [0.4], 0), (7, [0.4], 1)]])
def test_small_tables(spark, rows):
    assert mined(spark, rows) == plain(rows)


def test_the_walk_is_best_first_and_whole():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (4, 7), (9, 3)):
        a, b = rng.integers(-5, 5, n).astype(float), rng.integers(-5, 5, m).astype(float)
        walk = list(H.multi_sequence(a, b))
        assert sorted((i, j) for _, i, j in walk) == [(i, j) for i in range(n) for j in range(m)]
        assert all(x[0] >= y[0] for x, y in zip(walk, walk[1:])) and all(s == a[i] + b[j] for s, i, j in walk)


def test_bounds_hold_and_cells_are_left_out(spark):
    """No row beats its cell's bound; anchors of clustered data are certain before they have seen most cells."""
    rows = clustered(random.Random(4), 3000, dim=16, groups=40)
    df = spark.createDataFrame(rows, SCHEMA)
    index = H.Index(df, F.col("vec_id") % 50 == 0, 256.0, 2000, "vec_id", "embedding", "label")
    known = H._Bounds(index)
    all_rows = [(r["id"], r["label"], r["c1"], r["c2"], np.frombuffer(r["q"], "<i4").astype(float)) for r in index.rows.collect()]
    needed = []
    for a, lab, _, _, q in [r for r in all_rows if r[0] % 50 == 0]:
        left, right = known.bounds(q)
        assert all(q @ r[4] <= left[r[2]] + right[r[3]] for r in all_rows)
        fifth = sorted((q @ r[4] for r in all_rows if r[1] == lab and r[0] != a), reverse=True)[4]
        needed.append(sum(bound >= fifth for bound, _, _ in H.multi_sequence(left, right)) / (len(left) * len(right)))
    assert np.mean(needed) < 0.75
