"""Watershed characteristics: attributes of the pour point, terrain, rain, soil, curve number, wetland."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hydrospark.operators import zonal as Z
from hydrospark.operators.lookups import join_curve_number
from hydrospark.schema import Grid


def name_gauged(watersheds: DataFrame, stations: DataFrame) -> DataFrame:
    """Gauged watersheds (flag 1) carry the name of their station."""
    j = watersheds.join(stations, "station_key", "left")
    return j.withColumn("gws_id", F.when(F.col("flag_gst") == 1, F.col("station_name")).otherwise(F.col("gws_id"))).drop("station_name")


def keep_original_attributes(result: DataFrame, original: DataFrame, key: str) -> DataFrame:
    """Original columns that do not clash with the result; ``fid`` becomes ``orig_fid``."""
    take = [c for c in original.columns if c != key and (c not in result.columns or c == "fid")]
    cols = [F.col(c).alias("orig_fid" if c == "fid" else c) for c in take]
    return result.join(original.select(key, *cols), key, "left")


def results_onto(base: DataFrame, results: DataFrame, key: str, suffix: str = "_r") -> DataFrame:
    """Left join of results; a clashing column gets the suffix."""
    cols = [F.col(c).alias(c + suffix if c in base.columns else c) for c in results.columns if c != key]
    return base.join(results.select(key, *cols), key, "left")


def watershed_characteristics(watersheds: DataFrame, zone_cells: DataFrame, cells: DataFrame, rain: DataFrame,
                              soil_cells: DataFrame, cn_table: DataFrame, wet_cells: DataFrame, grid: Grid) -> DataFrame:
    """One row per watershed. Every zonal table has one row per zone, so all joins share that key.

    ``zone_cells`` is (zone_id, r, c); ``cells`` has z, acc and nlcd; ``rain`` has v on the same grid;
    ``soil_cells`` has piece_id and hsg (letters).
    """
    from hydrospark.functions.classes import soil_group_code
    soil_n = soil_cells.groupBy("r", "c").agg(F.min_by("hsg", "piece_id").alias("hsg")).withColumn("hsg", soil_group_code(F.col("hsg")))
    cn = join_curve_number(cells.select("r", "c", "nlcd").join(soil_n, ["r", "c"], "left"), cn_table)
    tables = [
        Z.zonal_terrain(zone_cells, cells, grid), Z.zonal_mean(zone_cells, rain.select("r", "c", "v"), "v", "n30p_rin"),
        Z.dominant_soil(zone_cells, soil_cells), Z.zonal_distinct_cn(zone_cells, cn),
        Z.wetland_area(zone_cells, wet_cells, grid.cell_area), Z.zone_area(zone_cells, grid.cell_area).select("zone_id", "area_ha"),
    ]
    out = watersheds
    for t in tables:
        out = out.join(t, "zone_id", "left")
    return out
