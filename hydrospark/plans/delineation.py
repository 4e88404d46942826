"""Nested watershed delineation from elevation, roads, and given, found or gauged points."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hydrospark.functions import peakflow as P
from hydrospark.operators import nesting as N, spatial as S, terrain as T
from hydrospark.operators.grid import slope_gradient, with_neighbours
from hydrospark.schema import Grid
from hydrospark.session import cut


def drainage(cells: DataFrame, grid: Grid, z: str = "z") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(filled cells, pointer table, accumulation table)."""
    filled = cut(T.fill_depressions(cells, z, grid, "z_fill"))
    stepped = cut(T.flat_steps(filled, "z_fill"))
    flow = cut(T.d8_pointer(stepped, "z_fill", grid, "flat_steps"))
    return filled, flow, cut(T.upstream(flow))


def stream_lines(flow: DataFrame, acc: DataFrame, grid: Grid, threshold: float) -> DataFrame:
    """Stream cells as line pieces (feature_id = link, seq = 0 .. by cell)."""
    links = T.stream_links(flow, T.extract_streams(acc, threshold))
    seg = T.link_segments(flow, links, grid)
    return seg.select(F.col("link").alias("feature_id"), F.col("cell").alias("seq"), "x1", "y1", "x2", "y2")


def enforce(cells: DataFrame, grid: Grid, roads: DataFrame, crossings: DataFrame, z: str, raise_m: float, burn_m: float, half_road_m: float) -> DataFrame:
    """Roads raised, then cut open along a breakline at each crossing."""
    up = S.adjust_along_lines(cells, roads, grid, z, raise_m, half_road_m)
    lines = S.breaklines(crossings, roads, max(2 * half_road_m, abs(grid.dx)))
    cut_lines = lines.select(F.col("line_id").alias("feature_id"), F.col("point_id").alias("seq"), "x1", "y1", "x2", "y2")
    return S.adjust_along_lines(up, cut_lines, grid, z, -burn_m, abs(grid.dx) / 2)


def as_points(crossings: DataFrame) -> DataFrame:
    return crossings.select(F.col("point_no").cast("bigint").alias("point_id"), "x", "y")


def delineate(cells: DataFrame, grid: Grid, roads: DataFrame, points: DataFrame | None = None, gauges: DataFrame | None = None,
              hydro_enforce: bool = True, threshold: float = 100.0, snap_m: float = 30.0, raise_m: float = 5.0, burn_m: float = 10.0,
              half_road_m: float = 6.0, min_area_ha: float = 2.0, boundary_cells: DataFrame | None = None, z: str = "z") -> dict[str, DataFrame]:
    """Tables 'points', 'watersheds' (kept), 'flagged', 'labels', 'closure', 'flow'.

    ``points`` given: snapped to roads, then to road-stream crossings. None given: the crossings are
    the points, found on the plain terrain and used on the enforced one. ``gauges``: the crossing
    nearest to a station takes its place; all other crossings stay points.
    """
    road_cells = cells.select("r", "c", z)
    width = F.lit(2 * half_road_m).alias("road_width_m")
    if points is not None:
        on_road = S.snap_to_lines(points, roads, snap_m).select("point_id", F.col("snap_x").alias("x"), F.col("snap_y").alias("y"))
        marks = cut(on_road.withColumn("road_width_m", width))
    elif not hydro_enforce:
        marks = on_road = None
    else:
        _, flow0, acc0 = drainage(road_cells, grid, z)
        marks = cut(as_points(S.line_crossings(roads, stream_lines(flow0, acc0, grid, threshold), 16 * abs(grid.dx))).withColumn("road_width_m", width))
        on_road = marks
    terrain = cut(enforce(road_cells, grid, roads, marks, z, raise_m, burn_m, half_road_m)) if hydro_enforce else road_cells
    _, flow, acc = drainage(terrain, grid, z)
    crossings = cut(as_points(S.line_crossings(roads, stream_lines(flow, acc, grid, threshold), 16 * abs(grid.dx))))
    if gauges is not None:
        pts = S.replace_from_nearest(crossings, gauges, snap_m, [], "gauge_id")
    elif points is not None:
        near = S.nearest_within(on_road, crossings.withColumnRenamed("point_id", "target_id"), snap_m)
        pts = near.select("point_id", F.col("tx").alias("x"), F.col("ty").alias("y"))
    else:
        pts = crossings
    on_grid = cut(pts.select("point_id", grid.row("y").alias("r"), grid.col("x").alias("c")))
    k = max(1, int(snap_m // abs(grid.dx)))
    snapped = cut(T.snap_to_max_accum(on_grid, acc, k).withColumn("cell", T.cell_id("r", "c")).select("point_id", "cell", "acc"))
    # points that drain through one cell share its watershed; each has a row of its own in the end
    pour = cut(snapped.groupBy("cell").agg(F.min("point_id").alias("point_id"), F.first("acc").alias("acc")))
    out = nested_watersheds(terrain, grid, flow, acc, pour, z)
    per_point = out["watersheds"].drop("point_id").join(snapped.select("point_id", "cell"), "cell").select(*out["watersheds"].columns)
    watersheds = per_point.where(F.col("area_ha") >= min_area_ha)
    if boundary_cells is not None:
        flagged = outside(out["labels"], out["tree"], boundary_cells, grid)
        out["flagged"] = watersheds.join(flagged, "cell", "left_semi")
        watersheds = watersheds.join(flagged, "cell", "left_anti")
    out["watersheds"] = watersheds
    points_kept = snapped.join(watersheds.select("cell").distinct(), "cell", "left_semi")
    if gauges is not None:
        points_kept = points_kept.join(pts.select("point_id", "gauge_id"), "point_id", "left")
    out["points"] = points_kept
    out["flow"] = flow
    return out


def nested_watersheds(cells: DataFrame, grid: Grid, flow: DataFrame, acc: DataFrame, pour: DataFrame, z: str) -> dict[str, DataFrame]:
    """One row per pour cell with areas, nesting, slope, lengths and time of concentration.

    Sums are taken per incremental basin and rolled up through the nesting, so a cell is read once
    however many watersheds hold it.
    """
    labels = cut(T.basin_labels(flow, pour))
    tree = cut(T.pour_tree(flow, pour, labels))
    slope = slope_gradient(cells.select("r", "c", z), z, grid).select(T.cell_id("r", "c").alias("cell"), "slope_pct")
    own = labels.join(slope, "cell").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("slope_pct").alias("s"), F.count("slope_pct").alias("sn")
    )
    own = cut(own.withColumn("zones", F.lit(1).cast("bigint")))
    total = T.rollup_nested(own, tree, ["n", "s", "sn", "zones"])
    # where cells come twice, a pour cell may have several rows and parents, and no place of its own
    once = tree.count() == own.count() == tree.select("child").distinct().count()
    places = T.tree_places(tree, total) if once else None
    edge = with_neighbours(labels.select(T.cell_row(F.col("cell")).alias("r"), T.cell_col(F.col("cell")).alias("c"), "label"), ["label"])
    inner = F.lit(True)
    for side in "ewns":
        inner = inner & F.coalesce(F.col(f"label_{side}") == F.col("label"), F.lit(False))
    # the farthest cell from any place is a corner of the hull, so it lies on the rim
    over = N.farthest_cell(edge.where(~inner).select("label", "r", "c"), tree, places, grid, "ov_len_m")
    levels = N.nesting_levels(tree, places.select("node", "level") if once else None)
    m2 = grid.cell_area
    w = (
        total.join(levels, "zone").join(own.select(F.col("label").alias("zone"), F.col("n").alias("inc_n")), "zone")
        .join(over, "zone").join(acc.select(F.col("cell").alias("zone"), F.col("longest_m").alias("ch_len_m")), "zone")
        .join(pour.select(F.col("cell").alias("zone"), "point_id"), "zone")
    )
    w = w.select(
        "point_id", F.col("zone").alias("cell"), (F.col("n") * m2 / 10_000).alias("area_ha"), (F.col("n") * m2 / 1e6).alias("total_area_km2"),
        (F.col("inc_n") * m2 / 1e6).alias("incremental_area_km2"), (F.col("inc_n") * 100.0 / F.col("n")).alias("incremental_area_pct"),
        "parent", "level", "child_count", "child_ids", "is_nested",
        F.coalesce(F.try_divide("s", "sn"), F.lit(1.0)).alias("avg_sl"), "ch_len_m", "ov_len_m",
    )
    tov, tch, tc = P.time_of_concentration(F.col("ov_len_m"), F.col("ch_len_m"), F.col("avg_sl"))
    return {"watersheds": cut(w.withColumns({"tov_min": tov, "tch_min": tch, "tc_min": tc})), "labels": labels, "tree": tree}


def outside(labels: DataFrame, tree: DataFrame, boundary_cells: DataFrame, grid: Grid, limit_ha: float = 0.5) -> DataFrame:
    """Pour cells whose watershed has more than the limit outside the boundary; counted per label, then rolled up."""
    b = boundary_cells.select(T.cell_id("r", "c").alias("cell"))
    n = labels.join(b, "cell", "left_anti").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    up = T.rollup_nested(n, tree, ["n"])
    return up.where(F.col("n") * grid.cell_area / 10_000 > limit_ha).select(F.col("zone").alias("cell"))
