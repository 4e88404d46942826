"""Nested zones by places in depth-first order: what a zone meets does not grow with the zones above it."""

import math
import random

import pytest

from hydrospark.operators import nesting as N, terrain as T
from hydrospark.plans import delineation as D
from hydrospark.schema import Grid

GRID = Grid()


def zones(n=900, seed=3):
    """Parents of zones: chains of hundreds with small trees beside them."""
    rng = random.Random(seed)
    ids = sorted({rng.randrange(200) * T.ROW + rng.randrange(200) for _ in range(n)})
    rng.shuffle(ids)
    return ids, {z: None if i % 300 == 0 else ids[i - 1] if i % 3 and i < 600 else ids[rng.randrange(i)] for i, z in enumerate(ids)}, rng


def above(parent, z):
    while z is not None:
        yield z
        z = parent[z]


def test_farthest_cell_meets_few_hulls(spark):
    ids, parent, rng = zones()
    rim = [(z, z // T.ROW + rng.randrange(-4, 5), z % T.ROW + rng.randrange(-4, 5)) for z in ids for _ in range(rng.randrange(1, 9))]
    count, far = dict.fromkeys(ids, 0), dict.fromkeys(ids, 0.0)
    for z in ids:
        for a in above(parent, z):
            count[a] += 1
    for z, r, c in rim:
        for a in above(parent, z):
            far[a] = max(far[a], math.hypot((r - a // T.ROW) * GRID.dy, (c - a % T.ROW) * GRID.dx))
    tree = spark.createDataFrame(list(parent.items()), "child bigint, parent bigint")
    places = T.tree_places(tree, spark.createDataFrame(list(count.items()), "zone bigint, zones bigint"))
    at = {r.node: r for r in places.collect()}
    assert sorted(r.place for r in at.values()) == list(range(len(ids)))
    for z in ids:
        assert all(at[a].place <= at[z].place < at[a].place + count[a] for a in above(parent, z))
        assert at[z].level == len(list(above(parent, z))) - 1
    cells = spark.createDataFrame(rim, "label bigint, r int, c int")
    for known in (places, None):
        assert {r.zone: r.far for r in N.farthest_cell(cells, tree, known, GRID, "far").collect()} == pytest.approx(far)
    assert N._nodes_above(places).count() < 10 * len(ids) < sum(count.values())


def test_watersheds_of_a_chain_need_no_pairs_of_zones(spark, monkeypatch):
    def no_pairs(tree):
        raise AssertionError("pairs of zones")

    monkeypatch.setattr(T, "ancestor_closure", no_pairs)
    monkeypatch.setattr(N, "ancestor_closure", no_pairs, raising=False)
    cells = spark.createDataFrame([(r, c, 200.0 - r + abs(c - 2)) for r in range(45) for c in range(5)], "r int, c int, z double")
    flow = T.cut(T.d8_pointer(cells, "z", GRID))
    acc = T.cut(T.upstream(flow))
    pour = acc.where((T.cell_col(acc.cell) == 2) & (T.cell_row(acc.cell) % 3 == 1)).select("cell", T.cell_row(acc.cell).cast("bigint").alias("point_id"), "acc")
    out = D.nested_watersheds(cells, GRID, flow, acc, pour, "z")
    label = {r.cell: r.label for r in out["labels"].collect()}
    parent = {r.child: r.parent for r in out["tree"].collect()}
    far = {}
    for cell, z in label.items():
        for a in above(parent, z):
            far[a] = max(far.get(a, 0.0), math.hypot((cell // T.ROW - a // T.ROW) * GRID.dy, (cell % T.ROW - a % T.ROW) * GRID.dx))
    got = {r.cell: (r.ov_len_m, r.level) for r in out["watersheds"].collect()}
    assert {k: v[0] for k, v in got.items()} == pytest.approx(far) and len(got) == 15
    assert {k: v[1] for k, v in got.items()} == {z: len(list(above(parent, z))) - 1 for z in parent}


def test_lines_of_one_file_are_dealt_before_their_cells_are_made(spark, tmp_path):
    from hydrospark.operators import spatial as S
    roads = [(k, 0, 10.0 * k, 0.0, 10.0 * k + 35.0, 90.0) for k in range(40)]
    spark.createDataFrame(roads, "feature_id bigint, seq int, x1 double, y1 double, x2 double, y2 double").coalesce(1).write.parquet(str(tmp_path / "roads"))
    one = spark.read.parquet(str(tmp_path / "roads"))
    assert one.rdd.getNumPartitions() == 1
    got = S.touched_cells(one, GRID, 5.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.rfind("Generate explode") < plan.rfind("RoundRobin" if "RoundRobin" in plan else "Exchange hashpartitioning(feature_id")
