"""Soil loss: factor layers, their product per cell, totals, scores and categories per watershed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hydrospark.functions import classes as K, erosion as E
from hydrospark.operators.binning import rank_score
from hydrospark.operators.grid import slope_central
from hydrospark.operators.zonal import zonal_erosion
from hydrospark.schema import Grid


def factor_layers(cells: DataFrame, grid: Grid) -> DataFrame:
    """R, K, LS and C per cell from one wide cell table (pi30_milli_in, kffact, z, acc, ndvi_i).

    The layers live in one row per cell, so the product needs no join; only the slope looks at
    neighbours, through one shuffle by tile.
    """
    s = slope_central(cells, "z", grid, "slope")
    return s.withColumns({
        "r_factor": E.r_factor(F.col("pi30_milli_in")), "k_factor": F.col("kffact"),
        "ls_factor": E.ls_factor(F.col("slope"), F.col("acc"), abs(grid.dx)),
        "c_factor": E.c_factor(E.ndvi_scale(F.col("ndvi_i"))),
    })


def join_layers(layers: dict[str, DataFrame], tile: int = 128) -> DataFrame:
    """Layers kept as separate cell tables (r, c, v), brought together on (r, c) in one aggregate.

    One shuffle for all layers instead of one join per layer.
    """
    one = None
    for name, df in layers.items():
        part = df.select("r", "c", F.lit(name).alias("layer"), F.col("v").cast("double").alias("v"))
        one = part if one is None else one.unionByName(part)
    return one.groupBy("r", "c").agg(*[F.max(F.when(F.col("layer") == n, F.col("v"))).alias(n) for n in layers])


def soil_loss_cells(factors: DataFrame, p: float = 1.0) -> DataFrame:
    return factors.withColumn("soil_loss", E.soil_loss(*[F.col(f"{k}_factor") for k in ("r", "k", "ls", "c")], p))


def soil_loss_watersheds(loss: DataFrame, zone_cells: DataFrame, zones: DataFrame, grid: Grid) -> DataFrame:
    e = zonal_erosion(zone_cells, loss, zones, grid.cell_area, "soil_loss").select("zone_id", "erosion")
    return rank_score(e, "erosion", "zone_id").withColumn("category", K.score_category(F.col("score")))
