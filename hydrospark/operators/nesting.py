"""Which zones lie within which: containment, parents, levels, incremental areas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from hydrospark.functions import hulls as H
from hydrospark.operators.terrain import ancestor_closure, cell_col, cell_row, rollup_nested, tree_levels
from hydrospark.schema import Grid
from hydrospark.session import cut, dealt, spread


def containment(zone_cells: DataFrame, min_share: float = 0.95, closure: DataFrame | None = None) -> DataFrame:
    """(inner_zone, outer_zone, share, outer_n): smaller zones with more than ``min_share`` of their cells in a larger one.

    Cells are first reduced to the distinct sets of zones that cover them; pairs come from those
    few sets with their cell counts, not from every cell. With ``closure`` (node, ancestor), zones are nested and each cell
    has only its innermost zone: a zone then shares all its cells with each zone above it and none with others.
    """
    if closure is not None:
        return _nested_containment(zone_cells, min_share, closure)
    sets = zone_cells.groupBy("r", "c").agg(F.array_sort(F.collect_set("zone_id")).alias("zones"))
    sets = sets.groupBy("zones").agg(F.count(F.lit(1)).alias("n"))
    size = sets.select(F.explode("zones").alias("zone"), "n").groupBy("zone").agg(F.sum("n").alias("size"))
    many = sets.where(F.size("zones") > 1)
    pair = many.select("zones", "n", F.explode("zones").alias("inner_zone")).select(
        "n", "inner_zone", F.explode("zones").alias("outer_zone")
    ).where("inner_zone <> outer_zone")
    shared = pair.groupBy("inner_zone", "outer_zone").agg(F.sum("n").alias("shared"))
    a = size.select(F.col("zone").alias("inner_zone"), F.col("size").alias("inner_n"))
    b = size.select(F.col("zone").alias("outer_zone"), F.col("size").alias("outer_n"))
    out = shared.join(a, "inner_zone").join(b, "outer_zone").where("inner_n < outer_n")
    return out.withColumn("share", F.col("shared") / F.col("inner_n")).where(F.col("share") > min_share).drop("shared", "inner_n")


def _nested_containment(zone_cells: DataFrame, min_share: float, closure: DataFrame) -> DataFrame:
    own = zone_cells.select("r", "c", "zone_id").distinct().groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"))
    above = spread(closure.select("node", "ancestor").distinct())
    size = cut(above.join(own, F.col("node") == F.col("zone_id")).groupBy(F.col("ancestor").alias("zone")).agg(F.sum("n").alias("size")))
    a = size.select(F.col("zone").alias("inner_zone"), F.col("size").alias("inner_n"))
    b = size.select(F.col("zone").alias("outer_zone"), F.col("size").alias("outer_n"))
    pair = above.select(F.col("node").alias("inner_zone"), F.col("ancestor").alias("outer_zone")).where("inner_zone <> outer_zone")
    out = pair.join(a, "inner_zone").join(b, "outer_zone").where("inner_n < outer_n")
    return out.withColumn("share", F.col("inner_n") / F.col("inner_n")).where(F.col("share") > min_share).drop("inner_n")


def parents(zones: DataFrame, contained: DataFrame) -> DataFrame:
    """(child, parent): the smallest zone that contains each zone."""
    p = contained.groupBy(F.col("inner_zone").alias("child")).agg(F.min_by("outer_zone", F.struct("outer_n", "outer_zone")).alias("parent"))
    return zones.select(F.col("zone_id").alias("child")).distinct().join(p, "child", "left")


def nesting_levels(tree: DataFrame, level: DataFrame | None = None) -> DataFrame:
    """Parent, direct children, and level below the root (root 0) of each zone; ``level`` (node, level) where it is known."""
    level = tree_levels(tree) if level is None else level
    kids = tree.where("parent IS NOT NULL").groupBy("parent").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("child")).alias("ids")
    )
    return (
        tree.join(kids.withColumnRenamed("parent", "_p"), F.col("child") == F.col("_p"), "left")
        .join(level.withColumnRenamed("node", "_z"), F.col("child") == F.col("_z"))
        .select(
            F.col("child").alias("zone"), "parent", F.coalesce("n", F.lit(0)).alias("child_count"),
            F.coalesce("ids", F.array().cast("array<bigint>")).alias("child_ids"), "level",
            F.col("parent").isNotNull().alias("is_nested"),
        )
    )


def farthest_cell(rim: DataFrame, tree: DataFrame, places: DataFrame | None, grid: Grid, out: str) -> DataFrame:
    """(zone, out): distance from each pour cell to the farthest cell of all basins above it, its own included.

    ``rim`` (label, r, c) has at least the corners of each basin's hull. The basins above a zone lie at places that follow
    one another (``terrain.tree_places``), which are a few nodes of a tree over all places: a zone meets the hulls of those
    nodes, some four a level, never all basins above it. Without ``places`` (a child that is twice in the tree) it meets them all.
    """
    band = F.floor(F.col("r") / 1024)
    few = rim.repartition("label", band).sortWithinPartitions("label", "r", "c").mapInArrow(H.corners, "label bigint, r int, c int")
    if places is None:
        up = ancestor_closure(tree.distinct()).select(F.col("node").alias("label"), F.col("ancestor").alias("zone"))
        met = few.join(up, "label")
    else:
        met = _nodes_above(places).join(spread(_node_hulls(few, places)), ["level", "node"]).select("zone", F.inline("cells"))
    far = F.hypot((F.col("r") - cell_row(F.col("zone"))) * grid.dy, (F.col("c") - cell_col(F.col("zone"))) * grid.dx)
    return met.groupBy("zone").agg(F.max(far).alias(out))


def _node_hulls(rim: DataFrame, places: DataFrame) -> DataFrame:
    """(level, node, cells): corners of the hull of all cells in a node; node n of a level holds the nodes 4 n .. 4 n + 3 of the level below, places are level 0."""
    step, last = 2 ** (H.BITS * H.LEVELS), places.count()
    cells = rim.join(places.select(F.col("node").alias("label"), "place"), "label").select(F.col("place").alias("node"), "r", "c")
    parts, base = [], 0
    while True:
        made = cut(cells.groupBy(F.floor(F.col("node") / step).alias("_b")).applyInArrow(H.block(base), "level int, node bigint, cells array<struct<r:int,c:int>>"))
        base, last = base + H.LEVELS, last // step
        parts.append(made.where(F.col("level") < base) if last else made)
        if not last:
            return reduce(DataFrame.unionByName, parts)
        cells = made.where(F.col("level") == base).select("node", F.inline("cells"))


def _nodes_above(places: DataFrame) -> DataFrame:
    """(zone, level, node): the largest nodes that together hold the places from each zone's own to the last one above it."""
    top = places.count().bit_length() // H.BITS + 1
    p = dealt(places, "node").select(F.col("node").alias("zone"), "place", (F.col("place") + F.col("zones")).alias("end"), F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level"))
    # whole nodes of this level from a to b, of the level above from a1 to b1
    p = p.select("*", *[F.expr(f"shiftright({x}, {H.BITS} * (level + {k}))").alias(n) for n, x, k in (
        ("a", f"place + shiftleft(1L, {H.BITS} * level) - 1", 0), ("b", "end", 0), ("a1", f"place + shiftleft(1L, {H.BITS} * (level + 1)) - 1", 1), ("b1", "end", 1))])
    inner, many = F.col("a1") < F.col("b1"), 2 ** H.BITS
    p = p.where("a < b").withColumns({"_l": F.when(inner, F.col("a1") * many).otherwise(F.col("b")), "_r": F.when(inner, F.col("b1") * many).otherwise(F.col("b"))})
    span = lambda x, y: F.when(F.col(x) < F.col(y), F.sequence(F.col(x), F.col(y) - 1)).otherwise(F.array().cast("array<bigint>"))
    return p.select("zone", "level", F.explode(F.concat(span("a", "_l"), span("_r", "b"))).alias("node"))


def incremental_from_labels(labels: DataFrame, tree: DataFrame, cell_area_m2: float) -> DataFrame:
    """Areas of nested watersheds from the incremental basin of each cell: no cell is repeated per watershed above it."""
    own = labels.groupBy("label").agg(F.count(F.lit(1)).alias("_i"))
    total = rollup_nested(own.withColumnRenamed("_i", "_n"), tree, ["_n"])
    km2 = cell_area_m2 / 1_000_000.0
    return total.join(own.withColumnRenamed("label", "zone"), "zone").select(
        "zone", (F.col("_n") * km2).alias("total_km2"), (F.col("_i") * km2).alias("incremental_km2"), (F.col("_i") * 100.0 / F.col("_n")).alias("incremental_pct"),
    )


def incremental_area(zone_cells: DataFrame, tree: DataFrame, cell_area_m2: float) -> DataFrame:
    """Area of each zone without its direct children. ``zone_cells`` is (zone, cell).

    Children may overlap, so their cells are united first: a cell of a zone counts once when any
    child covers it.
    """
    child = tree.where("parent IS NOT NULL").select(F.col("child").alias("zone"), "parent")
    covered = zone_cells.join(child, "zone").select(F.col("parent").alias("zone"), "cell").distinct()
    total = zone_cells.groupBy("zone").agg(F.count(F.lit(1)).alias("_n"))
    left = zone_cells.join(covered, ["zone", "cell"], "left_anti").groupBy("zone").agg(F.count(F.lit(1)).alias("_i"))
    km2 = cell_area_m2 / 1_000_000.0
    return total.join(left, "zone", "left").select(
        "zone", (F.col("_n") * km2).alias("total_km2"), (F.coalesce("_i", F.lit(0)) * km2).alias("incremental_km2"),
        (F.coalesce("_i", F.lit(0)) * 100.0 / F.col("_n")).alias("incremental_pct"),
    )
