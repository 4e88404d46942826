"""Point, line and polygon joins on plain coordinate columns.

Every join runs on a bucket key. Lines are cut into short pieces first, so a long diagonal line
enters only the buckets it passes; points with equal coordinates are joined once; polygons become
row intervals by a scanline and never meet cells they do not touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hydrospark.schema import Grid
from hydrospark.session import cut, dealt, spread


def ring_edges(rings: DataFrame) -> DataFrame:
    """Vertices (zone_id, ring_id, seq, x, y) to closed edges (x1, y1, x2, y2)."""
    ring = W.partitionBy("zone_id", "ring_id").orderBy("seq")
    first = rings.groupBy("zone_id", "ring_id").agg(F.min_by(F.struct("x", "y"), "seq").alias("_f"))
    nxt = F.lead(F.struct("x", "y")).over(ring)
    e = rings.withColumn("_n", nxt).join(first, ["zone_id", "ring_id"])
    end = F.coalesce("_n", "_f")
    return e.select("zone_id", "ring_id", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), end["x"].alias("x2"), end["y"].alias("y2"))


def ring_area(rings: DataFrame) -> DataFrame:
    """Shoelace area in square metres per zone; holes wind the other way and are subtracted."""
    e = ring_edges(rings)
    return e.groupBy("zone_id").agg(F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("area_m2"))


def polygon_cells(rings: DataFrame, grid: Grid, all_touched: bool = False) -> DataFrame:
    """(zone_id, r, c): cells whose centre is inside; with ``all_touched`` also cells an edge passes."""
    edges = ring_edges(rings).where("y1 <> y2")
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    first = F.ceil((lo - grid.y0) / grid.dy - 0.5)
    last = F.ceil((hi - grid.y0) / grid.dy - 0.5) - 1
    rows = edges.withColumns({"_a": first, "_b": last}).where("_a <= _b").select("*", F.explode(F.sequence("_a", "_b")).alias("_r"))
    yc = grid.y0 + (F.col("_r") + 0.5) * grid.dy
    cross = rows.select(
        "zone_id", F.col("_r").cast("int").alias("r"),
        (F.col("x1") + (yc - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("x"),
    )
    line = W.partitionBy("zone_id", "r").orderBy("x")
    spans = cross.withColumns({"_i": F.row_number().over(line), "_x2": F.lead("x").over(line)}).where("_i % 2 = 1")
    a = F.ceil((F.col("x") - grid.x0) / grid.dx - 0.5)
    b = F.ceil((F.col("_x2") - grid.x0) / grid.dx - 0.5) - 1
    inside = spans.withColumns({"_a": a, "_b": b}).where("_a <= _b").select(
        "zone_id", "r", F.explode(F.sequence(F.col("_a").cast("int"), F.col("_b").cast("int"))).alias("c")
    )
    if not all_touched:
        return inside
    return inside.unionByName(line_cells(ring_edges(rings), grid, ["zone_id"])).distinct()


def line_cells(segments: DataFrame, grid: Grid, keep: list[str]) -> DataFrame:
    """Distinct cells a segment passes: per row the column range of the part inside that row."""
    s = segments.withColumns({
        "_ylo": F.least("y1", "y2"), "_yhi": F.greatest("y1", "y2"),
        "_flat": F.col("y1") == F.col("y2"),
    })
    s = s.select("*", F.explode(F.sequence(grid.row("_ylo"), grid.row("_yhi"))).alias("r"))
    top, bottom = grid.y0 + F.col("r") * grid.dy, grid.y0 + (F.col("r") + 1) * grid.dy
    ya, yb = F.greatest("_ylo", top), F.least("_yhi", bottom)

    def x_at(y: Column) -> Column:
        return F.col("x1") + (y - F.col("y1")) * F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))

    xa = F.when(F.col("_flat"), F.col("x1")).otherwise(x_at(ya))
    xb = F.when(F.col("_flat"), F.col("x2")).otherwise(x_at(yb))
    s = s.withColumns({"_xa": F.least(xa, xb), "_xb": F.greatest(xa, xb)})
    return s.select(*keep, "r", F.explode(F.sequence(grid.col("_xa"), grid.col("_xb"))).alias("c")).distinct()


def rasterize_attribute(rings: DataFrame, attributes: DataFrame, grid: Grid, attr: str, order: str, all_touched: bool = False) -> DataFrame:
    """(r, c, attr): where polygons overlap the later feature (higher ``order``) wins."""
    cells = spread(polygon_cells(rings, grid, all_touched)).join(attributes.select("zone_id", attr, order), "zone_id")
    return cells.groupBy("r", "c").agg(F.max_by(attr, F.struct(order, "zone_id")).alias(attr))


def points_in_polygons(points: DataFrame, rings: DataFrame, tile: Grid, key: str = "point_id") -> DataFrame:
    """(key, zone_id) for points inside polygons.

    Tiles fully inside a polygon answer by an equi-join alone. Points in tiles that an edge passes
    count crossings with that polygon's edges of their own tile row only.
    """
    edges = ring_edges(rings)
    pts = points.select(key, "x", "y").withColumns({"tr": tile.row("y"), "tc": tile.col("x")})
    border = spread(line_cells(edges, tile, ["zone_id"])).select("zone_id", F.col("r").alias("tr"), F.col("c").alias("tc"))
    inner = spread(polygon_cells(rings, tile)).select("zone_id", F.col("r").alias("tr"), F.col("c").alias("tc")).join(border, ["zone_id", "tr", "tc"], "left_anti")
    sure = pts.join(inner, ["tr", "tc"]).select(key, "zone_id")
    near = pts.join(border, ["tr", "tc"]).select(key, "zone_id", "tr", "x", "y")
    strips = edges.where("y1 <> y2").select(
        "zone_id", "x1", "y1", "x2", "y2",
        F.explode(F.sequence(tile.row(F.least("y1", "y2")), tile.row(F.greatest("y1", "y2")))).alias("tr"),
    )
    hit = near.join(spread(strips), ["zone_id", "tr"]).where(
        ((F.col("y1") <= F.col("y")) != (F.col("y2") <= F.col("y")))
        & (F.col("x") < F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    )
    odd = hit.groupBy(key, "zone_id").agg((F.count(F.lit(1)) % 2).alias("_o")).where("_o = 1").select(key, "zone_id")
    return sure.unionByName(odd)


def zones_within(inner_cells: DataFrame, outer_cells: DataFrame) -> DataFrame:
    """(inner_zone, outer_zone): zones whose every cell lies in the other zone."""
    i = inner_cells.select(F.col("zone_id").alias("inner_zone"), "r", "c").distinct()
    o = outer_cells.select(F.col("zone_id").alias("outer_zone"), "r", "c").distinct()
    n = i.groupBy("inner_zone").agg(F.count(F.lit(1)).alias("_n"))
    hit = i.join(o, ["r", "c"]).groupBy("inner_zone", "outer_zone").agg(F.count(F.lit(1)).alias("_hit"))
    return hit.join(n, "inner_zone").where("_hit = _n").select("inner_zone", "outer_zone")


def zones_crossed(a_cells: DataFrame, b_cells: DataFrame) -> DataFrame:
    """(a_zone, b_zone, n): zones that share cells and how many."""
    a = a_cells.select(F.col("zone_id").alias("a_zone"), "r", "c").distinct()
    b = b_cells.select(F.col("zone_id").alias("b_zone"), "r", "c").distinct()
    return a.join(b, ["r", "c"]).groupBy("a_zone", "b_zone").agg(F.count(F.lit(1)).alias("n"))


def pieces(segments: DataFrame, length: float) -> DataFrame:
    """Segments cut into pieces no longer than ``length``; pieces keep the ends of their segment as sx1 .. sy2."""
    n = F.greatest(F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / length), F.lit(1)).cast("int")
    s = segments.withColumn("_n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_k"))
    def at(a, b, k):
        return F.col(a) + (F.col(b) - F.col(a)) * (k / F.col("_n"))
    return s.select(
        *[c for c in segments.columns if c not in ("x1", "y1", "x2", "y2")],
        F.col("x1").alias("sx1"), F.col("y1").alias("sy1"), F.col("x2").alias("sx2"), F.col("y2").alias("sy2"),
        at("x1", "x2", F.col("_k")).alias("px1"), at("y1", "y2", F.col("_k")).alias("py1"),
        at("x1", "x2", F.col("_k") + 1).alias("px2"), at("y1", "y2", F.col("_k") + 1).alias("py2"),
    )


def _foot(x: Column, y: Column) -> tuple[Column, Column]:
    dx, dy = F.col("sx2") - F.col("sx1"), F.col("sy2") - F.col("sy1")
    t = F.try_divide((x - F.col("sx1")) * dx + (y - F.col("sy1")) * dy, dx * dx + dy * dy)
    t = F.least(F.greatest(F.coalesce(t, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.col("sx1") + t * dx, F.col("sy1") + t * dy


def snap_to_lines(points: DataFrame, segments: DataFrame, distance: float, key: str = "point_id") -> DataFrame:
    """Points moved to the nearest line within the true distance; others keep their place.

    Adds snap_x, snap_y, line_id, snap_m (null when no line is near).
    """
    g = Grid(0.0, 0.0, distance, distance)
    place = points.select("x", "y").distinct().withColumns({"br": g.row("y"), "bc": g.col("x")})
    p = pieces(segments, 4 * distance)
    rows = F.sequence(g.row(F.least("py1", "py2")) - 1, g.row(F.greatest("py1", "py2")) + 1)
    cols = F.sequence(g.col(F.least("px1", "px2")) - 1, g.col(F.greatest("px1", "px2")) + 1)
    b = p.select("feature_id", "seq", "sx1", "sy1", "sx2", "sy2", F.explode(rows).alias("br"), cols.alias("_c"))
    b = b.select("feature_id", "seq", "sx1", "sy1", "sx2", "sy2", "br", F.explode("_c").alias("bc")).distinct()
    fx, fy = _foot(F.col("x"), F.col("y"))
    cand = place.join(spread(b), ["br", "bc"]).withColumns({"_fx": fx, "_fy": fy})
    cand = cand.withColumn("_d", F.hypot(F.col("x") - F.col("_fx"), F.col("y") - F.col("_fy"))).where(F.col("_d") <= distance)
    best = cand.groupBy("x", "y").agg(F.min_by(
        F.struct("_fx", "_fy", "feature_id", "_d", "sx1", "sy1", "sx2", "sy2"), F.struct("_d", "feature_id", "seq")
    ).alias("_b"))
    return points.join(spread(best), ["x", "y"], "left").select(
        *points.columns, F.coalesce("_b._fx", "x").alias("snap_x"), F.coalesce("_b._fy", "y").alias("snap_y"),
        F.col("_b.feature_id").alias("line_id"), F.col("_b._d").alias("snap_m"),
        F.struct("_b.sx1", "_b.sy1", "_b.sx2", "_b.sy2").alias("line"),
    )


def nearest_within(points: DataFrame, targets: DataFrame, distance: float, key: str = "point_id", target_key: str = "target_id") -> DataFrame:
    """(key, target_key, tx, ty, distance_m): nearest target point within the distance; others are dropped."""
    g = Grid(0.0, 0.0, distance, distance)
    place = points.select("x", "y").distinct().withColumns({"br": g.row("y"), "bc": g.col("x")})
    around = F.sequence(F.lit(-1), F.lit(1))
    t = targets.groupBy(F.col("x").alias("tx"), F.col("y").alias("ty")).agg(F.min(target_key).alias(target_key))
    t = t.select("*", F.explode(around).alias("_i")).select("*", F.explode(around).alias("_j"))
    t = t.select(target_key, "tx", "ty", (g.row("ty") + F.col("_i")).alias("br"), (g.col("tx") + F.col("_j")).alias("bc"))
    d = F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))
    cand = place.join(spread(t), ["br", "bc"]).withColumn("_d", d).where(F.col("_d") <= distance)
    best = cand.groupBy("x", "y").agg(F.min_by(F.struct(target_key, "tx", "ty", "_d"), F.struct("_d", target_key)).alias("_b"))
    return points.join(spread(best), ["x", "y"]).select(key, f"_b.{target_key}", "_b.tx", "_b.ty", F.col("_b._d").alias("distance_m"))


def nearest_any(points: DataFrame, targets: DataFrame, start: float, key: str = "point_id", target_key: str = "target_id", max_rounds: int = 60) -> DataFrame:
    """Nearest target at any distance, one row per point: first within ``start``, then for the points left down a tree of boxes.
    Distances beyond ``max_rounds`` - 1 doublings of ``start`` raise.

    Without any target with a place, and for points without a place, the target is null.
    """
    t = targets.where("x IS NOT NULL AND y IS NOT NULL")
    empty = [F.lit(None).cast(f.dataType).alias(n) for n, f in ((target_key, targets.schema[target_key]), ("tx", targets.schema["x"]), ("ty", targets.schema["y"]))]
    lost = lambda rows: rows.select(key, *empty, F.lit(None).cast("double").alias("distance_m"))
    if t.isEmpty():
        return lost(points)
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    here = cut(points.where(placed).select(key, "x", "y"))
    hit = cut(nearest_within(here, t, start, key, target_key))
    left = cut(here.join(spread(hit.select(key)), key, "left_anti"))
    out = lost(points.where(~placed)).unionByName(hit)
    if left.isEmpty():
        return out
    far = cut(_nearest_far(left, t, start, key, target_key))
    if not far.where(F.col("distance_m") > start * 2.0 ** (max_rounds - 1)).isEmpty():
        raise RuntimeError(f"points without a nearest target after {max_rounds} doublings of {start}")
    return out.unionByName(far)


def _nearest_far(points: DataFrame, targets: DataFrame, size: float, key: str, target_key: str, few: int = 64) -> DataFrame:
    """As ``nearest_within`` at any distance. Boxes of ``size`` are gathered 4 by 4 until at most ``few`` are left.

    From there each place goes down again with the boxes that can hold its nearest target: those not farther than
    the nearest distance within which some box is sure to have one (a box touches a target with each of its sides).
    """
    box = {"x0": F.min("x0"), "x1": F.max("x1"), "y0": F.min("y0"), "y1": F.max("y1")}
    agg = [v.alias(k) for k, v in box.items()]
    t = targets.groupBy(F.col("x").alias("tx"), F.col("y").alias("ty")).agg(F.min(target_key).alias(target_key))
    t = cut(t.withColumns({"br": F.floor(F.col("ty") / size), "bc": F.floor(F.col("tx") / size)}))
    one = t.select("br", "bc", *[F.col(f"t{a}").alias(f"{a}{i}") for a in "xy" for i in "01"])
    levels = [cut(one.groupBy("br", "bc").agg(*agg))]
    while levels[-1].count() > few:
        levels.append(cut(levels[-1].groupBy(F.shiftright("br", 2).alias("br"), F.shiftright("bc", 2).alias("bc")).agg(*agg)))

    def near(cand: DataFrame) -> DataFrame:
        out = [F.greatest(F.col(f"{a}0") - F.col(a), F.col(a) - F.col(f"{a}1"), F.lit(0.0)) for a in "xy"]
        a, b = [F.abs(F.col(c) - F.col(f"{c}0")) for c in "xy"], [F.abs(F.col(c) - F.col(f"{c}1")) for c in "xy"]
        sure = F.least(F.hypot(F.least(a[0], b[0]), F.greatest(a[1], b[1])), F.hypot(F.greatest(a[0], b[0]), F.least(a[1], b[1])))
        # rounding must not lose an equal distance
        kept = cand.withColumns({"_lo": F.hypot(*out), "_up": F.min(sure).over(W.partitionBy("x", "y")) * (1 + 1e-9)}).where("_lo <= _up")
        return cut(kept.select("x", "y", "br", "bc"))

    cand = near(points.select("x", "y").distinct().join(F.broadcast(levels[-1]), how="cross"))
    for level in reversed(levels[:-1]):
        below = level.withColumns({"_r": F.shiftright("br", 2), "_c": F.shiftright("bc", 2)})
        cand = near(cand.withColumnsRenamed({"br": "_r", "bc": "_c"}).join(spread(below), ["_r", "_c"]))
    d = F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))
    pairs = cand.join(spread(t), ["br", "bc"]).withColumn("_d", d)
    best = pairs.groupBy("x", "y").agg(F.min_by(F.struct(target_key, "tx", "ty", "_d"), F.struct("_d", target_key)).alias("_b"))
    return points.join(spread(best), ["x", "y"]).select(key, f"_b.{target_key}", "_b.tx", "_b.ty", F.col("_b._d").alias("distance_m"))


def replace_from_nearest(crossings: DataFrame, gauges: DataFrame, distance: float, attributes: list[str], key: str = "gauge_id") -> DataFrame:
    """All crossings; the one nearest to a gauge within the distance takes the gauge's place and attributes.

    Adds the gauge's ``key`` (null elsewhere). Of several gauges nearest to one crossing the closest counts,
    then the lowest key. Attributes the gauge does not have a value for are taken over as they are: null.
    """
    near = nearest_within(gauges, crossings, distance, key, "point_id").select(key, "point_id", "distance_m")
    one = near.groupBy("point_id").agg(F.min_by(key, F.struct("distance_m", key)).alias(key))
    src = gauges.select(key, F.col("x").alias("_gx"), F.col("y").alias("_gy"), *[F.col(a).alias(f"_g_{a}") for a in attributes])
    j = crossings.drop(key).join(one, "point_id", "left").join(src, key, "left")
    has = F.col(key).isNotNull()
    new = {a: F.when(has, F.col(f"_g_{a}")).otherwise(F.col(a)) if a in crossings.columns else F.col(f"_g_{a}") for a in attributes}
    return j.withColumns({**new, "x": F.coalesce("_gx", "x"), "y": F.coalesce("_gy", "y")}).drop("_gx", "_gy", *[f"_g_{a}" for a in attributes])


def line_crossings(roads: DataFrame, streams: DataFrame, tile: float = 100.0, digits: int = 3) -> DataFrame:
    """(point_no, x, y, road_id, stream_id): points where lines cross, numbered by place.

    Pieces meet only in the tiles they pass; a pair found in several tiles gives one point.
    """
    g = Grid(0.0, 0.0, tile, tile)

    def tiles(s: DataFrame, tag: str) -> DataFrame:
        p = pieces(s, tile)
        box = F.sequence(g.row(F.least("py1", "py2")), g.row(F.greatest("py1", "py2")))
        p = p.select("*", F.explode(box).alias("tr"), F.sequence(g.col(F.least("px1", "px2")), g.col(F.greatest("px1", "px2"))).alias("_c"))
        return p.select(
            F.col("feature_id").alias(f"{tag}_id"), *[F.col(f"s{n}").alias(f"{tag}{n}") for n in ("x1", "y1", "x2", "y2")],
            "tr", F.explode("_c").alias("tc"),
        ).distinct()

    j = spread(tiles(roads, "a")).join(spread(tiles(streams, "b")), ["tr", "tc"])
    ax, ay = F.col("ax2") - F.col("ax1"), F.col("ay2") - F.col("ay1")
    bx, by = F.col("bx2") - F.col("bx1"), F.col("by2") - F.col("by1")
    det = ax * by - ay * bx
    ox, oy = F.col("bx1") - F.col("ax1"), F.col("by1") - F.col("ay1")
    t, u = F.try_divide(ox * by - oy * bx, det), F.try_divide(ox * ay - oy * ax, det)
    hit = j.withColumns({"_t": t, "_u": u}).where("_t BETWEEN 0 AND 1 AND _u BETWEEN 0 AND 1")
    at = hit.select(
        F.round(F.col("ax1") + F.col("_t") * (F.col("ax2") - F.col("ax1")), digits).alias("x"),
        F.round(F.col("ay1") + F.col("_t") * (F.col("ay2") - F.col("ay1")), digits).alias("y"), "a_id", "b_id",
    ).groupBy("x", "y").agg(F.min("a_id").alias("road_id"), F.min("b_id").alias("stream_id"))
    from hydrospark.operators.ordered import ranked
    return ranked(cut(at), "x", "y", None, "point_no", "_n").drop("_n")


def near_line_cells(segments: DataFrame, grid: Grid, distance: float) -> DataFrame:
    """(r, c, distance_m): cells whose centre is within the distance of a line."""
    p = pieces(segments, max(4 * distance, 2 * abs(grid.dx)))
    rows = F.sequence(grid.row(F.least("py1", "py2") - distance), grid.row(F.greatest("py1", "py2") + distance))
    cols = F.sequence(grid.col(F.least("px1", "px2") - distance), grid.col(F.greatest("px1", "px2") + distance))
    c = p.select("sx1", "sy1", "sx2", "sy2", F.explode(rows).alias("r"), cols.alias("_c"))
    c = c.select("sx1", "sy1", "sx2", "sy2", "r", F.explode("_c").alias("c"))
    fx, fy = _foot(grid.x("c"), grid.y("r"))
    d = F.hypot(grid.x("c") - fx, grid.y("r") - fy)
    return c.withColumn("_d", d).where(F.col("_d") <= distance).groupBy("r", "c").agg(F.min("_d").alias("distance_m"))


def touched_cells(segments: DataFrame, grid: Grid, distance: float) -> DataFrame:
    """(r, c): cells that the buffer of a line touches anywhere, so that a diagonal band has no gaps.

    A cell is touched if the line passes through it, or one of its corners is within the distance of the
    line, or an end of the line within the distance of the cell.
    """
    p = pieces(dealt(segments), max(4 * distance, 2 * abs(grid.dx)))
    rows = F.sequence(grid.row(F.least("py1", "py2") - distance), grid.row(F.greatest("py1", "py2") + distance))
    cols = F.sequence(grid.col(F.least("px1", "px2") - distance), grid.col(F.greatest("px1", "px2") + distance))
    c = p.select("sx1", "sy1", "sx2", "sy2", F.explode(rows).alias("r"), cols.alias("_c"))
    c = c.select("sx1", "sy1", "sx2", "sy2", "r", F.explode("_c").alias("c"))
    x, y, hx, hy = grid.x("c"), grid.y("r"), abs(grid.dx) / 2, abs(grid.dy) / 2
    near = []
    for kx in (-hx, hx):
        for ky in (-hy, hy):
            fx, fy = _foot(x + kx, y + ky)
            near.append(F.hypot(x + kx - fx, y + ky - fy))
    for e in ("1", "2"):
        near.append(F.hypot(F.greatest(F.abs(F.col(f"sx{e}") - x) - hx, F.lit(0.0)), F.greatest(F.abs(F.col(f"sy{e}") - y) - hy, F.lit(0.0))))
    sx, sy = F.col("sx2") - F.col("sx1"), F.col("sy2") - F.col("sy1")
    through = F.lit(False)
    for k in (1, -1):  # a line that passes a rectangle without ending in it cuts a diagonal
        ax, ay, bx, by = x - hx, y - k * hy, x + hx, y + k * hy
        side = lambda qx, qy: sx * (qy - F.col("sy1")) - sy * (qx - F.col("sx1"))
        of = lambda qx, qy: (bx - ax) * (qy - ay) - (by - ay) * (qx - ax)
        through = through | ((side(ax, ay) * side(bx, by) <= 0) & (of(F.col("sx1"), F.col("sy1")) * of(F.col("sx2"), F.col("sy2")) <= 0))
    return c.where(through | (F.least(*near) <= distance)).select("r", "c").distinct()


def adjust_along_lines(cells: DataFrame, segments: DataFrame, grid: Grid, z: str, dy: float, buffer: float) -> DataFrame:
    """Elevation changed by ``dy`` in all cells that the buffer of the lines touches; nodata stays."""
    near = spread(touched_cells(segments, grid, buffer)).withColumn("_near", F.lit(True))
    return cells.join(near, ["r", "c"], "left").withColumn(z, F.col(z) + F.when(F.col("_near"), F.lit(dy)).otherwise(0.0)).drop("_near")


def breaklines(points: DataFrame, roads: DataFrame, distance: float, width: str = "road_width_m", offset: float = 2.0, key: str = "point_id") -> DataFrame:
    """Segment across the road at each crossing: through the snapped place, as long as the road is wide plus the offset."""
    s = snap_to_lines(points, roads, distance, key).where(F.col("snap_m").isNotNull())
    dx, dy = F.col("line.sx2") - F.col("line.sx1"), F.col("line.sy2") - F.col("line.sy1")
    length = F.hypot(dx, dy)
    half = (F.coalesce(F.col(width), F.lit(0.0)) + offset) / 2
    ux, uy = F.try_divide(-dy, length) * half, F.try_divide(dx, length) * half
    return s.select(
        key, "line_id", (F.col("snap_x") - ux).alias("x1"), (F.col("snap_y") - uy).alias("y1"),
        (F.col("snap_x") + ux).alias("x2"), (F.col("snap_y") + uy).alias("y2"),
    )


def overland_length(points: DataFrame, rings: DataFrame) -> DataFrame:
    """(zone_id, ov_len_m): farthest boundary vertex from the zone's pour point, over all its parts."""
    d = F.hypot(F.col("vx") - F.col("x"), F.col("vy") - F.col("y"))
    v = rings.select("zone_id", F.col("x").alias("vx"), F.col("y").alias("vy"))
    return points.select("zone_id", "x", "y").join(v, "zone_id").groupBy("zone_id").agg(F.max(d).alias("ov_len_m"))


def utm_zone(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """Zone number, hemisphere letter and projected system code."""
    zone = (F.floor((lon + 180) / 6) + 1).cast("int")
    north = lat >= 0
    return zone, F.when(north, "N").otherwise("S"), (F.when(north, 32600).otherwise(32700) + zone).cast("int")


def grid_spacing(area_km2: Column) -> Column:
    return F.when(area_km2 > 1000, 0.03).when(area_km2 > 100, 0.02).otherwise(0.01)


def lattice_points(rings: DataFrame, spacing: float) -> DataFrame:
    """(zone_id, x, y): lattice points inside each polygon from its lower-left corner, plus its vertex centroid."""
    box = rings.groupBy("zone_id").agg(F.min("x").alias("x0"), F.max("x").alias("x9"), F.min("y").alias("y0"), F.max("y").alias("y9"))
    n = lambda a, b: F.sequence(F.lit(0), F.ceil((F.col(b) - F.col(a)) / spacing).cast("int"))
    p = box.select("zone_id", "x0", "y0", F.explode(n("x0", "x9")).alias("i"), n("y0", "y9").alias("_j")).select("zone_id", "x0", "y0", "i", F.explode("_j").alias("j"))
    p = p.select(F.struct("zone_id", "i", "j").alias("point_id"), (F.col("x0") + F.col("i") * spacing).alias("x"), (F.col("y0") + F.col("j") * spacing).alias("y"))
    tile = Grid(0.0, 0.0, 8 * spacing, 8 * spacing)
    inside = points_in_polygons(spread(p), rings, tile).where("point_id.zone_id = zone_id")
    own = spread(p).join(spread(inside.select("point_id")), "point_id").select(F.col("point_id.zone_id").alias("zone_id"), "x", "y")
    return own.unionByName(rings.groupBy("zone_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y")))


# cell-set algebra ------------------------------------------------------------------------------

def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(spread(b.select("r", "c").distinct()), ["r", "c"], "left_anti")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(spread(b.select("r", "c").distinct()), ["r", "c"], "left_semi")


def union_cells(parts: DataFrame, key: str = "zone_id") -> DataFrame:
    return parts.select(key, "r", "c").distinct()


def split_by_lines(zone_cells: DataFrame, road_cells: DataFrame) -> DataFrame:
    """Zones without the road cells; the parts left over get their own ids (zone, smallest cell)."""
    from hydrospark.operators.terrain import cell_parts
    return cell_parts(difference(zone_cells, road_cells), "zone_id")


def overlap_or_nearest(overlap: DataFrame, nearest: DataFrame, key: str, other: str) -> DataFrame:
    """Largest overlap (lowest id on a tie), else the nearest candidate."""
    best = overlap.groupBy(key).agg(F.max_by(other, F.struct("n", -F.col(other))).alias("_o"))
    return nearest.select(key, F.col(other).alias("_n")).join(best, key, "full").select(key, F.coalesce("_o", "_n").alias(other))


def channel_of_hillslope(touch: DataFrame, nearest: DataFrame, lengths: DataFrame) -> DataFrame:
    """(hillslope_id, channel_id): the longest channel that touches the hillslope, else the nearest one."""
    t = touch.join(lengths, "channel_id").groupBy("hillslope_id").agg(
        F.max_by("channel_id", F.struct("length_m", -F.col("channel_id"))).alias("_t")
    )
    n = nearest.select("hillslope_id", F.col("channel_id").alias("_n"))
    return n.join(t, "hillslope_id", "full").select("hillslope_id", F.coalesce("_t", "_n").alias("channel_id"))
