"""Cell tables: tiles, neighbours, slopes, alignment, mosaics and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hydrospark.schema import Grid

TILE = 128


def with_neighbours(cells: DataFrame, values: list[str], diagonal: bool = False, tile: int = TILE) -> DataFrame:
    """Each cell with the values of its four (or eight) neighbours.

    Cells go to their tile, border cells also to the tiles beside it, so one shuffle on the tile
    serves every window below; a window covers one row or column of one tile. Adds ``<v>_e`` etc.
    and ``has_e`` etc.: a missing row is outside the grid, a null value is nodata.
    """
    own_r, own_c = F.floor(F.col("r") / tile), F.floor(F.col("c") / tile)
    dr = F.array_compact(F.array(
        F.lit(0), F.when(F.pmod("r", F.lit(tile)) == 0, -1), F.when(F.pmod("r", F.lit(tile)) == tile - 1, 1)
    ))
    dc = F.array_compact(F.array(
        F.lit(0), F.when(F.pmod("c", F.lit(tile)) == 0, -1), F.when(F.pmod("c", F.lit(tile)) == tile - 1, 1)
    ))
    df = cells.select("*", F.explode(dr).alias("_dr")).select("*", F.explode(dc).alias("_dc"))
    df = df.withColumns({"_tr": own_r + F.col("_dr"), "_tc": own_c + F.col("_dc")}).repartition("_tr", "_tc")
    row = W.partitionBy("_tr", "_tc", "r").orderBy("c")
    col = W.partitionBy("_tr", "_tc", "c").orderBy("r")
    here = F.struct(*values)

    def step(side: Column, ok: Column) -> Column:
        return F.when(ok, side)

    df = df.withColumns({
        "_h": here,
        "_w": step(F.lag(here).over(row), F.lag("c").over(row) == F.col("c") - 1),
        "_e": step(F.lead(here).over(row), F.lead("c").over(row) == F.col("c") + 1),
    })
    up, down = F.lag("r").over(col) == F.col("r") - 1, F.lead("r").over(col) == F.col("r") + 1
    around = {"_n": step(F.lag("_h").over(col), up), "_s": step(F.lead("_h").over(col), down)}
    if diagonal:
        around |= {
            "_nw": step(F.lag("_w").over(col), up), "_ne": step(F.lag("_e").over(col), up),
            "_sw": step(F.lead("_w").over(col), down), "_se": step(F.lead("_e").over(col), down),
        }
    df = df.withColumns(around)
    names = ["e", "w", "n", "s"] + (["nw", "ne", "sw", "se"] if diagonal else [])
    out = {f"has_{k}": F.col(f"_{k}").isNotNull() for k in names}
    for v in values:
        out |= {f"{v}_{k}": F.col(f"_{k}.{v}") for k in names}
    return df.where((F.col("_dr") == 0) & (F.col("_dc") == 0)).withColumns(out).drop(
        "_dr", "_dc", "_tr", "_tc", "_h", *[f"_{k}" for k in names]
    )


def _one_sided(z: Column, plus: Column, minus: Column, d: float) -> Column:
    return F.coalesce((plus - minus) / (2 * d), (plus - z) / d, (z - minus) / d)


def slope_gradient(cells: DataFrame, z: str, grid: Grid, out: str = "slope_pct") -> DataFrame:
    """Percent slope: central differences, one-sided where a neighbour is missing."""
    n = with_neighbours(cells, [z])
    v = F.col(z)
    gx = _one_sided(v, F.col(f"{z}_e"), F.col(f"{z}_w"), abs(grid.dx))
    gy = _one_sided(v, F.col(f"{z}_s"), F.col(f"{z}_n"), abs(grid.dy))
    return _tidy(n.withColumn(out, F.sqrt(gx * gx + gy * gy) * 100), [z])


def slope_central(cells: DataFrame, z: str, grid: Grid, out: str = "slope") -> DataFrame:
    """Rise over run from interior central differences; null at the border of the grid."""
    n = with_neighbours(cells, [z])
    gx = (F.col(f"{z}_e") - F.col(f"{z}_w")) / (2 * abs(grid.dx))
    gy = (F.col(f"{z}_s") - F.col(f"{z}_n")) / (2 * abs(grid.dy))
    return _tidy(n.withColumn(out, F.sqrt(gx * gx + gy * gy)), [z])


def slope_percent_zt(cells: DataFrame, z: str, grid: Grid, out: str = "slope_pct") -> DataFrame:
    """Zevenbergen-Thorne percent slope with edges: outside the grid the value is extrapolated, nodata takes the centre."""
    n = with_neighbours(cells, [z])
    v = F.col(z)

    def known(side: str, opposite: str) -> Column:
        value = lambda k: F.coalesce(F.col(f"{z}_{k}"), v)
        return F.when(F.col(f"has_{side}"), value(side)).otherwise(2 * v - value(opposite))

    gx = (known("e", "w") - known("w", "e")) / (2 * abs(grid.dx))
    gy = (known("n", "s") - known("s", "n")) / (2 * abs(grid.dy))
    return _tidy(n.withColumn(out, F.sqrt(gx * gx + gy * gy) * 100), [z])


def _tidy(df: DataFrame, values: list[str]) -> DataFrame:
    ks = ["e", "w", "n", "s", "nw", "ne", "sw", "se"]
    return df.drop(*[f"has_{k}" for k in ks], *[f"{v}_{k}" for v in values for k in ks])


def align_nearest(target: DataFrame, target_grid: Grid, source: DataFrame, source_grid: Grid, value: str) -> DataFrame:
    """Source value at the centre of each target cell; one equi-join on the source index."""
    t = target.withColumns({
        "_sr": source_grid.row(target_grid.y("r")), "_sc": source_grid.col(target_grid.x("c")),
    })
    s = source.select(F.col("r").alias("_sr"), F.col("c").alias("_sc"), F.col(value))
    return t.join(s, ["_sr", "_sc"], "left").drop("_sr", "_sc")


def align_bilinear(target: DataFrame, target_grid: Grid, source: DataFrame, source_grid: Grid, value: str) -> DataFrame:
    """Bilinear value at the centre of each target cell; weights of missing corners are shared out."""
    fx = (target_grid.x("c") - source_grid.x0) / source_grid.dx - 0.5
    fy = (target_grid.y("r") - source_grid.y0) / source_grid.dy - 0.5
    keys = target.select("r", "c").withColumns({"_fx": fx, "_fy": fy})
    keys = keys.withColumns({"_c0": F.floor("_fx"), "_r0": F.floor("_fy")})
    wx, wy = F.col("_fx") - F.col("_c0"), F.col("_fy") - F.col("_r0")
    corner = F.inline(F.array(*[
        F.struct(
            (F.col("_r0") + i).cast("int").alias("_sr"), (F.col("_c0") + j).cast("int").alias("_sc"),
            ((wy if i else 1 - wy) * (wx if j else 1 - wx)).alias("_wt"),
        ) for i in (0, 1) for j in (0, 1)
    ]))
    s = source.where(F.col(value).isNotNull()).select(F.col("r").alias("_sr"), F.col("c").alias("_sc"), F.col(value).alias("_v"))
    hit = keys.select("r", "c", corner).where("_wt > 0").join(s, ["_sr", "_sc"])
    v = hit.groupBy("r", "c").agg(F.try_divide(F.sum(F.col("_wt") * F.col("_v")), F.sum("_wt")).alias(value))
    return target.join(v, ["r", "c"], "left")


def mosaic(grids: DataFrame, order: str = "src") -> DataFrame:
    """Overlapping grids merged cell by cell; the first source with a value wins."""
    return grids.where(F.col("v").isNotNull()).groupBy("r", "c").agg(F.min_by("v", order).alias("v"))


def mask_nodata(cells: DataFrame, columns: list[str], codes: list[float] = (250, 255, -9999)) -> DataFrame:
    return cells.withColumns({c: F.when(~F.col(c).isin(*codes), F.col(c)) for c in columns})


def mask_water(cells: DataFrame, column: str, water: int = 11) -> DataFrame:
    return cells.withColumn(column, F.when(F.col(column) != water, F.col(column)))


def on_template(template: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """Every layer on the template's cells; a layer without data is null there. All joins share the (r, c) key."""
    out = template.select("r", "c").distinct()
    for name, cells in layers.items():
        out = out.join(cells.select("r", "c", F.col("v").alias(name)), ["r", "c"], "left")
    return out


def grid_stats(cells: DataFrame, value: str) -> DataFrame:
    return cells.agg(
        F.min(value).alias("z_min"), F.max(value).alias("z_max"), F.avg(value).alias("z_mean"),
        F.count(F.lit(1)).alias("n_cells"), F.count(value).alias("n_valid"),
    )


def coverage_ratio(boundary_cells: DataFrame, cells: DataFrame, value: str, limit: float = 0.8) -> DataFrame:
    j = boundary_cells.select("r", "c").distinct().join(cells.select("r", "c", value), ["r", "c"], "left")
    ratio = F.count(value) / F.count(F.lit(1))
    return j.agg(ratio.alias("coverage")).withColumn("passes", F.col("coverage") >= limit)


def pick_resolution(available: DataFrame, key: str = "boundary_id") -> DataFrame:
    """First source (lowest priority number) that covers the boundary."""
    return available.where("passes").groupBy(key).agg(F.min_by("source", "priority").alias("source"))
