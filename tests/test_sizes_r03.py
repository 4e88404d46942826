"""Work that must not grow faster than its input: broadcasts, flow paths, searches."""

import math
import random

import pytest

from hydrospark.operators import nesting as N, spatial as S, terrain as T
from hydrospark.session import cut


def walks(flow):
    """{cell: (acc, longest)} and the paths, cell by cell."""
    acc, far = {c: 0 for c in flow}, {c: 0.0 for c in flow}
    for start in flow:
        c, d = start, 0.0
        while c in flow:
            acc[c] += 1
            far[c] = max(far[c], d)
            d += flow[c][1]
            c = flow[c][0]
    return {c: (acc[c], far[c]) for c in flow}


def grid_flow(seed, rows, cols):
    """Pointers to a neighbour below or beside; paths cross tiles many times, some end early."""
    rng, flow = random.Random(seed), {}
    for r in range(rows):
        for c in range(cols):
            to = (r + 1) * T.ROW + c + rng.choice((-1, 0, 1)) if rng.random() < 0.995 else None
            flow[r * T.ROW + c] = (to if to is not None and 0 <= to % T.ROW < cols and to // T.ROW < rows else None, 10.0)
    return flow


def table(spark, flow):
    return spark.createDataFrame([(k, d, s) for k, (d, s) in flow.items()], "cell bigint, down bigint, step_m double")


def rounds(monkeypatch):
    """Rows of each doubling round."""
    seen = []
    for name in ("_doubling", "_stops"):
        monkeypatch.setattr(T, name, lambda state, f=getattr(T, name): (seen.append(state.count()), f(state))[1])
    return seen


def test_flow_paths_double_over_entered_cells_only(spark, monkeypatch):
    flow = grid_flow(3, 700, 9)
    seen = rounds(monkeypatch)
    got = {r.cell: (r.acc, r.longest_m) for r in T.upstream(table(spark, flow)).collect()}
    assert got == walks(flow)
    targets = [c for c in flow if c // T.ROW % 97 == 40 and c % 4 == 1]
    found = {r.cell: r.target for r in T.first_downstream(table(spark, flow), spark.createDataFrame([(c,) for c in targets], "cell bigint")).collect()}
    for start in flow:
        c = start
        while c is not None and c not in targets:
            c = flow[c][0]
        assert found[start] == c
    assert seen and max(seen) <= 2 * 9


def test_weights_and_repeated_cells(spark):
    rows = [(1, 2, 10.0, 1.5), (2, 3, 10.0, 2.0), (3, None, None, 0.25), (4, 3, 5.0, 1.0)]
    one = spark.createDataFrame(rows, "cell bigint, down bigint, step_m double, w double")
    assert {r.cell: r.acc for r in T.upstream(one, "w").collect()} == {1: 1.5, 2: 3.5, 3: 4.75, 4: 1.0}
    twice = spark.createDataFrame([(1, 2, 10.0), (1, 2, 10.0), (2, None, None)], "cell bigint, down bigint, step_m double")
    assert sorted((r.cell, r.acc) for r in T.upstream(twice).collect()) == [(1, 1), (1, 1), (2, 3)]


def test_cycles_raise(spark):
    flow = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "cell bigint, down bigint, step_m double")
    with pytest.raises(RuntimeError):
        T.upstream(flow).count()
    with pytest.raises(RuntimeError):
        T.first_downstream(flow, flow.limit(0)).count()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_tables_are_not_broadcast(spark, tmp_path):
    """Pieces of lines and written tables look small in a file; the planner must not send them through the driver."""
    spark.range(40000).selectExpr("id AS point_id", "id * 7.0 AS x", "id % 3 * 1.0 AS y").write.parquet(str(tmp_path / "p"))
    points = spark.read.parquet(str(tmp_path / "p"))
    roads = points.selectExpr("point_id AS feature_id", "0 AS seq", "x AS x1", "y AS y1", "x + 100 AS x2", "y + 1 AS y2")
    assert "BroadcastHashJoin" not in plan(S.snap_to_lines(points, roads, 10.0))
    large = cut(spark.range(200000).selectExpr("id AS k", "1 AS v"))
    assert "BroadcastHashJoin" not in plan(large.join(cut(spark.range(150000).selectExpr("id AS k", "2 AS w")), "k"))


def test_far_points_meet_few_targets(spark, monkeypatch):
    """The nearest of many far targets, ties by id, without meeting them all."""
    rng = random.Random(5)
    targets = [(i, i % 60 * 90.0, i // 60 * 90.0) for i in range(3600)] + [(9000, 4000.0, 9e5), (9001, 4000.0, 9e5)]
    points = [(i, rng.uniform(-1e4, 2e4), rng.uniform(-2e4, 8e5)) for i in range(300)] + [(900, -500.0, 45.0), (901, 1000.0, -1e6), (902, None, 1.0)]
    sizes = []
    monkeypatch.setattr(S, "cut", lambda df: (out := cut(df), sizes.append(out.count()))[0])
    got = {r.point_id: (r.target_id, r.distance_m) for r in S.nearest_any(
        spark.createDataFrame(points, "point_id bigint, x double, y double"), spark.createDataFrame(targets, "target_id bigint, x double, y double"), 200.0).collect()}
    assert got.pop(902) == (None, None) and len(got) == 302
    for i, x, y in points[:-1]:
        d, k = min((math.hypot(x - tx, y - ty), k) for k, tx, ty in targets)
        assert got[i][1] == pytest.approx(d, rel=1e-12) and math.isclose(math.hypot(x - targets[min(got[i][0], 3600)][1], y - targets[min(got[i][0], 3600)][2]), d)
    assert got[900][0] == 0 and max(sizes) < 302 * 60


def test_nested_containment_needs_no_cell_pairs(spark):
    """A chain of zones: the same pairs from innermost zones and the nesting as from all cells of all zones."""
    depth = 40
    inner = [(z, z, c) for z in range(depth) for c in range(z % 3 + 1)]
    closure = [(n, a) for n in range(depth) for a in range(n, depth)]
    cells = spark.createDataFrame(inner, "zone_id bigint, r int, c int")
    up = spark.createDataFrame(closure, "node bigint, ancestor bigint")
    every = spark.createDataFrame([(a, r, c) for z, r, c in inner for a in range(z, depth)], "zone_id bigint, r int, c int")
    rows = lambda df: sorted(map(tuple, df.select("inner_zone", "outer_zone", "share", "outer_n").collect()))
    assert rows(N.containment(cells, closure=up)) == rows(N.containment(every))


def test_proximity_deals_steps_before_they_are_counted(spark):
    line = spark.createDataFrame([(i, 5) for i in range(50)] + [(7, 30)], "r int, c int")
    got = {(r.r, r.c): r.distance_m for r in T.proximity(line, S.Grid(), 120.0).collect()}
    cells = [(i, 5) for i in range(50)] + [(7, 30)]
    want = {(r, c): d for r in range(-15, 70) for c in range(-10, 50) if (d := min(math.hypot(r - a, c - b) for a, b in cells) * 10) <= 120}
    assert got == pytest.approx(want)
    assert plan(T.proximity(line, S.Grid(), 120.0)).count("Exchange") == 3
