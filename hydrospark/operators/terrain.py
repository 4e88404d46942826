"""Terrain-graph jobs on cell tables: pointers, accumulation, basins, streams, fill.

Flow paths are followed inside tiles first (one shuffle), then between tiles over the few cells that a
path enters. Each loop doubles the distance a pointer covers, so the rounds grow with the logarithm of the
longest flow path. Every round is cut by a written table. Cells whose pointer has reached its
end no longer take part in the pointer join, so an outlet that drains a third of the grid is not a
hot join key.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hydrospark.functions.paths import BITS, CYCLE, ENTRY, INTO, NONE, ODD, crossing, stopping
from hydrospark.operators.grid import with_neighbours
from hydrospark.schema import Grid
from hydrospark.session import BROADCAST_ROWS, cut, spread

MAX_ROUNDS = 64
# Row and column step and the usual pointer code of the eight directions.
DIRECTIONS = [
    ("ne", -1, 1, 1), ("e", 0, 1, 2), ("se", 1, 1, 4), ("s", 1, 0, 8),
    ("sw", 1, -1, 16), ("w", 0, -1, 32), ("nw", -1, -1, 64), ("n", -1, 0, 128),
]
ROW = 4294967296
CYCLIC = "flow paths did not end; the pointer table has a cycle"


def cell_id(r: Column | str, c: Column | str) -> Column:
    r = F.col(r) if isinstance(r, str) else r
    c = F.col(c) if isinstance(c, str) else c
    return r.cast("bigint") * ROW + c.cast("bigint")


def cell_row(cell: Column) -> Column:
    return F.floor(cell / ROW).cast("int")


def cell_col(cell: Column) -> Column:
    return F.pmod(cell, F.lit(ROW)).cast("int")


def _step_length(grid: Grid, dr: int, dc: int) -> float:
    return math.hypot(dr * grid.dy, dc * grid.dx)


def d8_pointer(cells: DataFrame, z: str, grid: Grid, flat: str | None = None) -> DataFrame:
    """(cell, down, code, step_m): steepest of the eight neighbours, first direction on a tie.

    With ``flat`` (steps to the outlet of a flat), equal neighbours with fewer steps also take flow.
    A cell without a lower neighbour is an end (``down`` null).
    """
    df = with_neighbours(cells, [z] + ([flat] if flat else []), diagonal=True)
    options = []
    for i, (k, dr, dc, code) in enumerate(DIRECTIONS):
        dist = _step_length(grid, dr, dc)
        fall = (F.col(z) - F.col(f"{z}_{k}")) / dist
        ok = fall > 0
        if flat:
            ok = ok | ((fall == 0) & (F.col(f"{flat}_{k}") < F.col(flat)))
        options.append(F.when(ok, F.struct(
            fall.alias("fall"), F.lit(-i).alias("o"), F.lit(code).alias("code"), F.lit(dist).alias("step_m"),
            cell_id(F.col("r") + dr, F.col("c") + dc).alias("down"),
        )))
    best = F.array_max(F.array_compact(F.array(*options)))
    return df.where(F.col(z).isNotNull()).select(
        "r", "c", cell_id("r", "c").alias("cell"), best.alias("_b")
    ).select("r", "c", "cell", "_b.down", "_b.code", "_b.step_m")


def _tiled(rows: DataFrame, at: str = "cell") -> DataFrame:
    return rows.withColumns({"_tr": F.shiftright(at, 32 + BITS), "_tc": F.shiftright(F.col(at).bitwiseAND(F.lit(ROW - 1)), BITS)})


def _entered(flow: DataFrame) -> DataFrame:
    """(cell): cells that a path enters from another tile; few of all."""
    ends = _tiled(_tiled(flow.where("down IS NOT NULL").select("cell", "down")).withColumnsRenamed({"_tr": "_fr", "_tc": "_fc"}), "down")
    return ends.where("_tr <> _fr OR _tc <> _fc").select(F.col("down").alias("cell")).distinct()


def _by_tile(rows: DataFrame, run, ddl: str) -> DataFrame:
    return _tiled(rows.withColumn("mark", F.col("mark").cast("int"))).groupBy("_tr", "_tc").applyInArrow(lambda t: run(t), ddl)


def _regular(tiles: DataFrame) -> bool:
    """Whether no tile holds a cell twice or one without a weight; a path that comes back within a tile raises."""
    kinds = {r[0] for r in tiles.where(F.col("kind") >= ODD).select("kind").distinct().collect()}
    if CYCLE in kinds:
        raise RuntimeError(CYCLIC)
    return not kinds


def upstream(flow: DataFrame, weight: str | None = None) -> DataFrame:
    """(cell, acc, longest_m): cells (or weight) draining through each cell, itself included, and the
    longest upslope path.

    Tiles are summed on their own; what passes between them goes along the few cells that paths enter, by
    pointer doubling; then each tile is summed once more with what enters it. So a cell is shuffled twice,
    however long the paths are. Tables with a cell twice or a null weight double pointers over all cells.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1).cast("bigint")
    base = cut(flow.select("cell", "down", F.coalesce("step_m", F.lit(0.0)).alias("len"), w.alias("acc")))
    kind = "double" if weight else "bigint"
    ddl = f"kind byte, cell bigint, nxt bigint, len double, acc {kind}, far double"
    cells = base.where("cell IS NOT NULL").select("cell", F.coalesce("down", F.lit(NONE)).alias("down"), "len", "acc", F.lit(0.0).alias("far"), F.lit(0).alias("mark"))

    def marked(rows: DataFrame) -> DataFrame:
        return cells.unionByName(rows.withColumns({"down": F.lit(NONE), "len": F.lit(0.0), "mark": F.lit(1)}))

    entered = _entered(base).select("cell", F.lit(0).cast(kind).alias("acc"), F.lit(0.0).alias("far"))
    tiles = cut(_by_tile(marked(entered), crossing(False), ddl))
    if not _regular(tiles):
        return _doubling(base.withColumnRenamed("down", "jump").withColumn("longest_m", F.lit(0.0)))
    into = tiles.where(F.col("kind") == INTO).groupBy("cell").agg(F.sum("acc").alias("acc"), F.max("far").alias("longest_m"))
    between = tiles.where(F.col("kind") == ENTRY).select("cell", F.col("nxt").alias("jump"), "len").join(into, "cell")
    enters = _doubling(cut(between)).withColumnRenamed("longest_m", "far")
    done = cut(_by_tile(marked(enters), crossing(True), ddl).select("cell", "acc", F.col("far").alias("longest_m")))
    return done.unionByName(base.where("cell IS NULL").select("cell", "acc", F.lit(0.0).alias("longest_m")))


def _doubling(state: DataFrame) -> DataFrame:
    """(cell, acc, longest_m) of (cell, jump, len, acc, longest_m): pointer doubling, two joins and one partial aggregate per round."""
    for _ in range(MAX_ROUNDS):
        active = state.where(F.col("jump").isNotNull())
        gain = active.groupBy(F.col("jump").alias("cell")).agg(
            F.sum("acc").alias("_add"), F.max(F.col("longest_m") + F.col("len")).alias("_far")
        )
        ahead = state.where(F.col("jump").isNotNull()).select(
            F.col("cell").alias("jump"), F.col("jump").alias("_j2"), F.col("len").alias("_l2")
        )
        moved = active.join(ahead, "jump", "left").select(
            "cell", F.col("_j2").alias("jump"), (F.col("len") + F.coalesce("_l2", F.lit(0.0))).alias("len"), "acc", "longest_m"
        )
        merged = moved.unionByName(state.where(F.col("jump").isNull()).select(*moved.columns))
        state = cut(merged.join(gain, "cell", "left").select(
            "cell", "jump", "len", (F.col("acc") + F.coalesce("_add", F.lit(0))).alias("acc"),
            F.greatest("longest_m", F.coalesce("_far", F.lit(0.0))).alias("longest_m"),
        ))
        if state.where(F.col("jump").isNotNull()).isEmpty():
            return state.select("cell", "acc", "longest_m")
    raise RuntimeError(CYCLIC)


def first_downstream(flow: DataFrame, targets: DataFrame) -> DataFrame:
    """(cell, target): first target cell on the way down, itself included; null if the path ends first.

    Paths are followed tile by tile, then along the cells entered from another tile, as in ``upstream``.
    """
    t = targets.select("cell").distinct()
    base = cut(flow.select("cell", "down"))
    cells = base.where("cell IS NOT NULL").select("cell", F.coalesce("down", F.lit(NONE)).alias("down"), F.lit(0).alias("mark"))
    for k, few in ((1, _entered(base)), (2, t.where("cell IS NOT NULL"))):
        cells = cells.unionByName(few.select("cell", F.lit(NONE).alias("down"), F.lit(k).alias("mark")))
    tiles = cut(_by_tile(cells, stopping, "kind byte, cell bigint, ptr bigint, done boolean"))
    if not _regular(tiles):
        start = base.join(t.withColumn("_t", F.lit(True)), "cell", "left")
        return _stops(cut(start.select(
            "cell", F.when(F.col("_t"), F.col("cell")).otherwise(F.col("down")).alias("ptr"),
            (F.coalesce("_t", F.lit(False)) | F.col("down").isNull()).alias("done"),
        )))
    own = tiles.where(F.col("kind") == INTO)
    beyond = _stops(tiles.where(F.col("kind") == ENTRY).select("cell", "ptr", "done")).withColumnRenamed("cell", "ptr")
    left = own.where(~F.col("done")).select("cell", "ptr").join(beyond, "ptr", "left").select("cell", "target")
    ended = own.where("done").select("cell", F.col("ptr").alias("target"))
    return ended.unionByName(left).unionByName(base.where("cell IS NULL").select("cell", F.col("down").alias("target")))


def _stops(state: DataFrame) -> DataFrame:
    """(cell, target) of (cell, ptr, done) by pointer doubling; a pointer to a cell that is not there ends null."""
    for _ in range(MAX_ROUNDS):
        active = state.where(~F.col("done"))
        if active.isEmpty():
            return state.select("cell", F.col("ptr").alias("target"))
        ahead = state.select(F.col("cell").alias("ptr"), F.col("ptr").alias("_p2"), F.col("done").alias("_d2"))
        moved = active.join(ahead, "ptr", "left").select(
            "cell", F.col("_p2").alias("ptr"), F.coalesce("_d2", F.lit(True)).alias("done")
        )
        state = cut(state.where("done").unionByName(moved))
    raise RuntimeError(CYCLIC)


def extract_streams(acc: DataFrame, threshold: float) -> DataFrame:
    return acc.where(F.col("acc") >= threshold)


def accum_at_points(points: DataFrame, acc: DataFrame) -> DataFrame:
    a = acc.select("cell", "acc")
    return points.withColumn("cell", cell_id("r", "c")).join(a, "cell", "left").drop("cell")


def _window_cells(points: DataFrame, key: str, k: int) -> DataFrame:
    span = F.sequence(F.lit(-k), F.lit(k))
    p = points.select(key, "r", "c", F.explode(span).alias("_dr")).select(key, "r", "c", "_dr", F.explode(span).alias("_dc"))
    return p.select(key, "_dr", "_dc", cell_id(F.col("r") + F.col("_dr"), F.col("c") + F.col("_dc")).alias("cell"))


def snap_to_max_accum(points: DataFrame, acc: DataFrame, k: int, key: str = "point_id") -> DataFrame:
    """Pour point moved to the largest accumulation within ``k`` cells; nearer, then lower cell id on a tie."""
    w = _window_cells(points, key, k)
    order = F.struct("acc", -(F.col("_dr") * F.col("_dr") + F.col("_dc") * F.col("_dc")), -F.col("cell"))
    best = w.join(acc.select("cell", "acc"), "cell").groupBy(key).agg(F.max_by(F.struct("cell", "acc"), order).alias("_b"))
    return best.select(key, cell_row(F.col("_b.cell")).alias("r"), cell_col(F.col("_b.cell")).alias("c"), F.col("_b.acc").alias("acc"))


def order_pour_points(points: DataFrame, acc: DataFrame, k: int, key: str = "point_id") -> DataFrame:
    """Largest accumulation near each point and its place in upstream-to-downstream order."""
    from hydrospark.operators.ordered import ranked
    m = _window_cells(points, key, k).join(acc.select("cell", "acc"), "cell").groupBy(key).agg(F.max("acc").alias("max_acc"))
    return ranked(cut(m), "max_acc", key, None, "place", "_n").drop("_n")


def basin_labels(flow: DataFrame, pours: DataFrame) -> DataFrame:
    """(cell, label): incremental basins, each cell with the first pour cell below it."""
    return first_downstream(flow, pours).where(F.col("target").isNotNull()).withColumnRenamed("target", "label")


def pour_tree(flow: DataFrame, pours: DataFrame, labels: DataFrame) -> DataFrame:
    """(child, parent): the next pour cell below each pour cell; parent null at the outlet."""
    below = pours.select(F.col("cell").alias("child")).join(
        flow.select(F.col("cell").alias("child"), F.col("down").alias("cell")), "child"
    )
    return below.join(labels, "cell", "left").select("child", F.col("label").alias("parent"))


def ancestor_closure(tree: DataFrame) -> DataFrame:
    """(node, ancestor, depth) with the node itself at depth 0; doubling, so rounds = log2(depth)."""
    own = tree.select(F.col("child").alias("node"), F.col("child").alias("ancestor"), F.lit(0).alias("depth"))
    step = tree.where(F.col("parent").isNotNull()).select(
        F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")
    )
    # a round writes its new pairs alone; all pairs are the rounds' tables together
    parts, rows, reach = [cut(own.unionByName(step))], 0, 1
    for _ in range(MAX_ROUNDS):
        rows += parts[-1].count()
        pairs = reduce(DataFrame.unionByName, parts)
        pairs = spread(pairs) if rows > BROADCAST_ROWS else pairs
        far = parts[-1].where(F.col("depth") == reach)
        more = cut(far.select("node", F.col("ancestor").alias("mid"), F.col("depth").alias("d1")).join(
            pairs.where("depth > 0").select(F.col("node").alias("mid"), "ancestor", F.col("depth").alias("d2")), "mid"
        ).select("node", "ancestor", (F.col("d1") + F.col("d2")).alias("depth")))
        if more.isEmpty():
            return pairs
        parts, reach = [*parts, more], reach * 2
    raise RuntimeError("nesting has a cycle")


def nested_membership(labels: DataFrame, closure: DataFrame) -> DataFrame:
    """(zone, cell): all cells above each pour cell. For sums and means roll up labels instead."""
    return labels.join(closure.select(F.col("node").alias("label"), F.col("ancestor").alias("zone")), "label").select("zone", "cell")


def _doubled(state: DataFrame, step) -> DataFrame:
    """Run ``step(state)`` until no ``up`` is left; ``up`` starts as the parent and doubles its reach each round."""
    most = state.count().bit_length() + 1
    for _ in range(most + 1):
        if state.where(F.col("up").isNotNull()).isEmpty():
            return state.drop("up")
        state = cut(step(state))
    raise RuntimeError("nesting has a cycle")


def rollup_nested(per_label: DataFrame, tree: DataFrame, sums: list[str]) -> DataFrame:
    """(zone, sums): additive totals of incremental basins summed over everything upstream; cells are never repeated.

    In round k a zone holds the sum of all zones fewer than 2 ** k steps above it, and adds what those 2 ** k
    steps above hold: one row per zone and round, however long the chains are, and as many rounds as the
    logarithm of the longest.
    """
    own = tree.select(F.col("child").alias("zone"), F.col("parent").alias("up")).join(per_label.select(F.col("label").alias("zone"), *sums), "zone", "left")

    def step(state: DataFrame) -> DataFrame:
        more = state.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("zone")).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
        above = state.select(F.col("zone").alias("up"), F.col("up").alias("_up"))
        return state.join(above, "up", "left").join(more, "zone", "left").select(
            "zone", F.col("_up").alias("up"), *[F.coalesce(F.col(c) + F.col(f"_{c}"), c, f"_{c}").alias(c) for c in sums])

    total = _doubled(cut(own), step)
    # a zone with nothing upstream has no total
    return total.where(F.coalesce(*[F.col(c).cast("double") for c in sums]).isNotNull())


def tree_levels(tree: DataFrame) -> DataFrame:
    """(node, level): steps to the root, by doubling as in ``rollup_nested``."""
    own = tree.select(F.col("child").alias("node"), F.col("parent").alias("up"), F.col("parent").isNotNull().cast("int").alias("level"))

    def step(state: DataFrame) -> DataFrame:
        above = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("level").alias("_level"))
        return state.join(above, "up", "left").select("node", F.col("_up").alias("up"), (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level"))

    return _doubled(cut(own), step)


def tree_places(tree: DataFrame, counts: DataFrame) -> DataFrame:
    """(node, level, place, zones): places in an order in which a node is followed by all nodes above it.

    ``counts`` has (zone, zones), the nodes above each, itself included; so the nodes above a node, with it, are the
    places from its own on, ``zones`` of them. Each child is in ``tree`` once. By doubling, as in ``rollup_nested``.
    """
    from hydrospark.operators.ordered import running_total
    sized = cut(tree.select(F.col("child").alias("node"), F.col("parent").alias("up")).join(counts.select(F.col("zone").alias("node"), "zones"), "node"))
    earlier = W.partitionBy("up").orderBy("node").rowsBetween(W.unboundedPreceding, -1)
    child = sized.where("up IS NOT NULL").select("*", (F.coalesce(F.sum("zones").over(earlier), F.lit(0)) + 1).alias("place"), F.lit(1).alias("level"))
    root = running_total(cut(sized.where("up IS NULL")), "node", "zones", "_end")
    root = root.select("node", "up", "zones", (F.col("_end").cast("bigint") - F.col("zones")).alias("place"), F.lit(0).alias("level"))

    def step(state: DataFrame) -> DataFrame:
        below = state.select(F.col("node").alias("up"), *[F.col(c).alias(f"_{c}") for c in ("up", "level", "place")])
        return state.join(below, "up", "left").select("node", F.col("_up").alias("up"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("level", "place")], "zones")

    return _doubled(cut(child.unionByName(root)), step)


def connected_parts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, part): connected components, part = smallest node id.

    Contraction: every node hooks to its smallest smaller neighbour, chains collapse by pointer
    doubling, edges are rewritten between the roots and deduplicated; the graph shrinks each round.
    """
    e = cut(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    maps: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        if e.isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("root")
        )
        hook = cut(hook)
        while True:
            up = hook.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("_r2"))
            nxt = cut(hook.join(up, "root", "left").select("node", F.coalesce("_r2", "root").alias("root"), F.col("_r2").isNotNull().alias("_m")))
            moved = not nxt.where("_m").isEmpty()
            hook = nxt.select("node", "root")
            if not moved:
                break
        maps.append(hook)
        ra = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        rb = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        e = cut(
            e.join(ra, "a").join(rb, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
    else:
        raise RuntimeError("components did not settle")
    final = None
    for m in reversed(maps):
        if final is None:
            final = m
        else:
            later = final.select(F.col("node").alias("root"), F.col("root").alias("_r2"))
            final = m.join(later, "root", "left").select("node", F.coalesce("_r2", "root").alias("root"))
        final = cut(final)
    n = nodes.select("node").distinct()
    if final is None:
        return n.withColumn("part", F.col("node"))
    return n.join(final, "node", "left").select("node", F.coalesce("root", "node").alias("part"))


def cell_parts(cells: DataFrame, group: str | None = None, diagonal: bool = False) -> DataFrame:
    """Connected parts of a cell set (within ``group`` when given): adds ``part`` (smallest cell id)."""
    g = cells.withColumn("_g", F.col(group) if group else F.lit(0))
    n = with_neighbours(g, ["_g"], diagonal)
    near = [(k, dr, dc) for k, dr, dc, _ in DIRECTIONS if diagonal or dr == 0 or dc == 0]
    hit = F.array_compact(F.array(*[
        F.when(F.col(f"_g_{k}") == F.col("_g"), cell_id(F.col("r") + dr, F.col("c") + dc)) for k, dr, dc in near
    ]))
    edges = n.select(cell_id("r", "c").alias("a"), F.explode(hit).alias("b")).where("a < b")
    own = cells.withColumn("node", cell_id("r", "c"))
    return own.join(connected_parts(edges, own), "node").drop("node")


def stream_links(flow: DataFrame, streams: DataFrame) -> DataFrame:
    """(cell, link): stream cells by link; a link starts at a source or below a junction and is named by its first cell."""
    s = streams.select("cell")
    on = flow.select("cell", "down").join(s, "cell", "left_semi")
    inflow = on.where(F.col("down").isNotNull()).groupBy(F.col("down").alias("cell")).agg(
        F.count(F.lit(1)).alias("n_in"), F.min("cell").alias("up")
    )
    ups = cut(on.join(inflow, "cell", "left"))
    heads = ups.where(F.coalesce("n_in", F.lit(0)) != 1)
    back = ups.select("cell", F.when(F.col("n_in") == 1, F.col("up")).alias("down"))
    return first_downstream(back, heads).select("cell", F.col("target").alias("link"))


def link_segments(flow: DataFrame, links: DataFrame, grid: Grid) -> DataFrame:
    """Stream cells as line pieces to the next cell below."""
    d = flow.select("cell", "down").join(links, "cell").where(F.col("down").isNotNull())
    return d.select(
        "link", "cell", grid.x(cell_col(F.col("cell"))).alias("x1"), grid.y(cell_row(F.col("cell"))).alias("y1"),
        grid.x(cell_col(F.col("down"))).alias("x2"), grid.y(cell_row(F.col("down"))).alias("y2"),
    )


def hillslopes(flow: DataFrame, streams: DataFrame, links: DataFrame) -> DataFrame:
    """(cell, link, side): land cells by the link they reach and the bank they come from.

    The side is the sign of the cross product of the channel direction and the entering step;
    cells that enter a channel source are its head. Channel cells keep side 'channel'.
    """
    s = streams.select("cell")
    n_in = flow.select("cell", "down").join(s, "cell", "left_semi").where(F.col("down").isNotNull()).groupBy(
        F.col("down").alias("cell")).agg(F.count(F.lit(1)).alias("n_in"))
    channel = links.join(flow.select("cell", "down"), "cell").join(n_in, "cell", "left").select(
        F.col("cell").alias("entry"), "link", F.col("down").alias("entry_down"), F.coalesce("n_in", F.lit(0)).alias("n_in")
    )
    land = flow.select("cell", "down").join(s, "cell", "left_anti")
    gates = cut(land.join(channel, F.col("down") == F.col("entry")).select("cell", "entry", "entry_down", "link", "n_in"))
    reach = first_downstream(land, gates).where(F.col("target").isNotNull())
    dr, dc = (lambda a, b: cell_row(F.col(a)) - cell_row(F.col(b))), (lambda a, b: cell_col(F.col(a)) - cell_col(F.col(b)))
    cross = dc("entry_down", "entry") * dr("cell", "entry") - dr("entry_down", "entry") * dc("cell", "entry")
    side = F.when(F.col("n_in") == 0, "head").when(cross > 0, "right").when(cross < 0, "left").otherwise("head")
    sides = gates.select(F.col("cell").alias("target"), "link", side.alias("side"))
    return reach.join(sides, "target").select("cell", "link", "side").unionByName(
        links.select("cell", "link", F.lit("channel").alias("side"))
    )


def proximity(line_cells: DataFrame, grid: Grid, limit_m: float) -> DataFrame:
    """(r, c, distance_m) within the limit of a line cell: exact, one pass along columns, one along rows."""
    kr, kc = int(limit_m // abs(grid.dy)), int(limit_m // abs(grid.dx))
    # dealt by stretches of a column and by rows, so that steps to one cell meet before they are shuffled
    up = line_cells.repartition("c", F.floor(F.col("r") / 1024)).select("c", F.col("r").alias("_r"), F.explode(F.sequence(F.lit(-kr), F.lit(kr))).alias("_d"))
    col = up.groupBy((F.col("_r") + F.col("_d")).alias("r"), "c").agg(F.min(F.abs("_d")).alias("_dy"))
    side = col.repartition("r").select("r", F.col("c").alias("_c"), "_dy", F.explode(F.sequence(F.lit(-kc), F.lit(kc))).alias("_d"))
    d2 = F.pow(F.col("_dy") * abs(grid.dy), F.lit(2)) + F.pow(F.col("_d") * abs(grid.dx), F.lit(2))
    near = side.groupBy("r", (F.col("_c") + F.col("_d")).alias("c")).agg(F.sqrt(F.min(d2)).alias("distance_m"))
    return near.where(F.col("distance_m") <= limit_m)


def fill_depressions(cells: DataFrame, z: str, grid: Grid, out: str = "z_fill") -> DataFrame:
    """Depressionless elevation: each cell rises to the lowest level from which it can spill to the border.

    Cells are grouped into the basins of their pits; border cells belong to the outside (-1). Basin
    pairs keep their lowest pass. In each round every inner basin group takes its lowest pass and
    merges along it; the level of a basin is the highest pass taken before it joins the outside.
    Rounds grow with the logarithm of the number of basins, not with the width of the grid.
    """
    flow = cut(d8_pointer(cells, z, grid))
    ring = with_neighbours(cells, [z], diagonal=True)
    names = [k for k, *_ in DIRECTIONS]
    inner = F.lit(True)
    for k in names:
        inner = inner & F.col(f"{z}_{k}").isNotNull()
    border = cut(ring.where(F.col(z).isNotNull() & ~inner).select(cell_id("r", "c").alias("cell")))
    pits = flow.where(F.col("down").isNull()).select("cell").unionByName(border).distinct()
    base = first_downstream(flow, pits).join(border.withColumn("_out", F.lit(True)).withColumnRenamed("cell", "target"), "target", "left")
    base = cut(base.select("cell", F.when(F.col("_out"), F.lit(-1)).otherwise(F.col("target")).cast("bigint").alias("basin")))
    lab = cells.withColumn("cell", cell_id("r", "c")).select("r", "c", z, "cell").join(base, "cell")
    around = with_neighbours(lab, [z, "basin"], diagonal=True)
    passes = F.array_compact(F.array(*[
        F.when(F.col(f"basin_{k}") != F.col("basin"), F.struct(
            F.least("basin", F.col(f"basin_{k}")).alias("a"), F.greatest("basin", F.col(f"basin_{k}")).alias("b"),
            F.greatest(F.col(z), F.col(f"{z}_{k}")).alias("h"),
        )) for k in names
    ]))
    e = cut(around.select(F.inline(passes)).groupBy("a", "b").agg(F.min("h").alias("h")))
    level = cut(base.where("basin >= 0").select("basin").distinct().select(
        "basin", F.col("basin").alias("comp"), F.lit(None).cast("double").alias("level")
    ))
    for _ in range(MAX_ROUNDS):
        if e.isEmpty() or level.where("comp >= 0").isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "h"))
        order = F.struct("h", F.least("a", "b"), F.greatest("a", "b"))
        pick = cut(both.where("a >= 0").groupBy("a").agg(F.min_by(F.struct("b", "h"), order).alias("_p")).select(
            F.col("a").alias("comp"), F.col("_p.b").alias("to"), F.col("_p.h").alias("h")
        ))
        back = pick.select(F.col("comp").alias("to"), F.col("to").alias("_back"))
        # of two groups that chose each other the smaller id becomes the root
        root = pick.join(back, "to", "left").select(
            "comp", F.when((F.col("_back") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("root")
        )
        root = cut(root)
        while True:
            up = root.where("comp <> root").select(F.col("comp").alias("root"), F.col("root").alias("_r2"))
            nxt = cut(root.join(up, "root", "left").select("comp", F.coalesce("_r2", "root").alias("root"), F.col("_r2").isNotNull().alias("_m")))
            moved = not nxt.where("_m").isEmpty()
            root = nxt.select("comp", "root")
            if not moved:
                break
        step = pick.select("comp", "h").join(root, "comp")
        level = cut(level.join(step, "comp", "left").select(
            "basin", F.coalesce("root", "comp").alias("comp"), F.greatest("level", "h").alias("level")
        ))
        ra = root.select(F.col("comp").alias("a"), F.col("root").alias("ra"))
        rb = root.select(F.col("comp").alias("b"), F.col("root").alias("rb"))
        e = cut(
            e.join(ra, "a", "left").join(rb, "b", "left")
            .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"), "h").where("a <> b")
            .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("h").alias("h"))
        )
    else:
        raise RuntimeError(f"basins not joined after {MAX_ROUNDS} rounds")
    lifted = base.join(level.select("basin", "level"), "basin", "left").select("cell", "level")
    return cells.withColumn("cell", cell_id("r", "c")).join(lifted, "cell", "left").withColumn(
        out, F.when(F.col(z).isNotNull(), F.greatest(F.col(z), F.col("level")))
    ).drop("cell", "level")


def flat_steps(cells: DataFrame, z: str, out: str = "flat_steps") -> DataFrame:
    """Steps from each cell of a flat to the nearest cell that drains; 0 where the cell drains or is at the border."""
    names = [(k, dr, dc) for k, dr, dc, _ in DIRECTIONS]
    n = with_neighbours(cells, [z], diagonal=True)
    drains, equal = F.lit(False), []
    for k, dr, dc in names:
        side = F.col(f"{z}_{k}")
        drains = drains | side.isNull() | (side < F.col(z))
        equal.append(F.when(side == F.col(z), cell_id(F.col("r") + dr, F.col("c") + dc)))
    state = cut(n.where(F.col(z).isNotNull()).select(
        cell_id("r", "c").alias("cell"), drains.alias("_ok"), F.array_compact(F.array(*equal)).alias("_eq")
    ))
    # only flats and the cells beside them take part in the rounds, and a round writes its front alone:
    # neighbours of a front lie in it, in the one before, or in the next
    links = cut(state.where(~F.col("_ok")).select("cell", F.explode("_eq").alias("near")))
    front = cut(state.where("_ok").select("cell").join(links.select(F.col("near").alias("cell")).distinct(), "cell", "left_semi"))
    before, k = front.limit(0), 0
    steps = state.where("_ok").select("cell", F.lit(0).alias(out))
    while True:
        reached = links.join(front.select(F.col("cell").alias("near")), "near", "left_semi").select("cell").distinct()
        front, before, k = cut(reached.join(front, "cell", "left_anti").join(before, "cell", "left_anti")), front, k + 1
        if front.isEmpty():
            break
        steps = steps.unionByName(front.select("cell", F.lit(k).alias(out)))
    return cells.withColumn("cell", cell_id("r", "c")).join(steps, "cell", "left").drop("cell")
