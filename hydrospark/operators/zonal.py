"""Zonal statistics: one equi-join on (r, c), one partial aggregate per zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hydrospark.functions import classes as K
from hydrospark.operators.grid import slope_gradient
from hydrospark.operators.ordered import quantiles
from hydrospark.schema import Grid


def zone_values(zone_cells: DataFrame, cells: DataFrame) -> DataFrame:
    return zone_cells.join(cells, ["r", "c"])


def zonal_mean(zone_cells: DataFrame, cells: DataFrame, value: str, out: str) -> DataFrame:
    return zone_values(zone_cells, cells).groupBy("zone_id").agg(F.avg(value).alias(out))


def zonal_sum(zone_cells: DataFrame, cells: DataFrame, value: str, out: str) -> DataFrame:
    return zone_values(zone_cells, cells).groupBy("zone_id").agg(F.sum(value).alias(out))


def wetness_index(acc, slope_rise):
    return F.ln((acc + 1e-6) / (slope_rise + 1e-6))


def zonal_terrain(zone_cells: DataFrame, cells: DataFrame, grid: Grid, z: str = "z", acc: str = "acc") -> DataFrame:
    """Mean elevation and mean topographic wetness per zone."""
    s = slope_gradient(cells, z, grid).withColumn("twi", wetness_index(F.col(acc), F.col("slope_pct") / 100))
    return zone_values(zone_cells, s.select("r", "c", z, "twi")).groupBy("zone_id").agg(
        F.avg(z).alias("avg_elev_m"), F.avg("twi").alias("avg_twi")
    )


def zonal_slope(zone_cells: DataFrame, cells: DataFrame, grid: Grid, z: str = "z", fallback: float = 1.0) -> DataFrame:
    """Mean percent slope; a zone without a valid cell gets the fallback."""
    s = slope_gradient(cells, z, grid).select("r", "c", "slope_pct")
    return zone_cells.join(s, ["r", "c"], "left").groupBy("zone_id").agg(
        F.coalesce(F.avg("slope_pct"), F.lit(fallback)).alias("avg_slope_pct")
    )


def zonal_erosion(zone_cells: DataFrame, rate: DataFrame, zones: DataFrame | None, cell_area_m2: float,
                  value: str = "soil_loss") -> DataFrame:
    """Mean rate times the area attribute where given, else the zone's cell area in hectares."""
    mean = zone_cells.join(rate.select("r", "c", value), ["r", "c"], "left").groupBy("zone_id").agg(
        F.avg(value).alias("rate"), (F.count(F.lit(1)) * cell_area_m2 / 10_000.0).alias("cell_ha")
    )
    if zones is None:
        return mean.withColumn("erosion", F.col("rate") * F.col("cell_ha"))
    return zones.select("zone_id", "area_ha").join(mean, "zone_id", "left").withColumn(
        "erosion", F.col("rate") * F.coalesce("area_ha", "cell_ha")
    )


def zonal_distinct_cn(zone_cells: DataFrame, cells: DataFrame, cn: str = "cn") -> DataFrame:
    """Mean of the distinct curve numbers of a zone, rounded up."""
    pairs = zone_values(zone_cells, cells.where(F.col(cn).isNotNull()).select("r", "c", cn)).groupBy("zone_id", cn).agg(F.lit(1))
    return pairs.groupBy("zone_id").agg(F.ceil(F.avg(cn)).cast("bigint").alias("cn_val"))


def zonal_mode(zone_cells: DataFrame, cells: DataFrame, value: str, out: str, default: int | None = None) -> DataFrame:
    """Most frequent class, lowest class on a tie; counts per (zone, class) first."""
    n = zone_cells.join(cells.select("r", "c", value), ["r", "c"], "left").groupBy("zone_id", value).agg(F.count(F.lit(1)).alias("_n"))
    top = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct("_n", -F.col(value))))
    return n.groupBy("zone_id").agg((F.coalesce(top, F.lit(default)) if default is not None else top).alias(out))


def dominant_soil(zone_cells: DataFrame, soil_cells: DataFrame, by: str = "piece") -> DataFrame:
    """Soil group of the largest single piece in the zone, or of the largest total with ``by='total'``."""
    s = soil_cells.withColumn("hsg_n", K.soil_group_code(F.col("hsg")))
    j = zone_values(zone_cells, s)
    if by == "total":
        n = j.where("hsg_n IS NOT NULL").groupBy("zone_id", "hsg_n").agg(F.count(F.lit(1)).alias("_n"))
        pick = F.max_by("hsg_n", F.struct("_n", -F.col("hsg_n")))
    else:
        n = j.groupBy("zone_id", "piece_id").agg(F.count(F.lit(1)).alias("_n"), F.first("hsg_n").alias("hsg_n"))
        pick = F.max_by("hsg_n", F.struct("_n", -F.col("piece_id")))
    return n.groupBy("zone_id").agg(pick.cast("bigint").alias("hsg_n"))


def wetland_area(zone_cells: DataFrame, wet_cells: DataFrame, cell_area_m2: float, keep_overlaps: bool = False) -> DataFrame:
    """Hectares of wetland per zone, zero where none; overlapping wetlands count once unless kept."""
    w = wet_cells.select("r", "c") if keep_overlaps else wet_cells.select("r", "c").distinct()
    hit = zone_values(zone_cells, w).groupBy("zone_id").agg((F.count(F.lit(1)) * cell_area_m2 / 10_000.0).alias("_ha"))
    return zone_cells.select("zone_id").distinct().join(hit, "zone_id", "left").select(
        "zone_id", F.coalesce("_ha", F.lit(0.0)).alias("wet_a_ha")
    )


def zone_area(zone_cells: DataFrame, cell_area_m2: float) -> DataFrame:
    return zone_cells.groupBy("zone_id").agg((F.count(F.lit(1)) * cell_area_m2).alias("area_m2")).withColumns({
        "area_ha": F.col("area_m2") / 10_000.0, "area_km2": F.col("area_m2") / 1_000_000.0,
    })


def dissolve(parts: DataFrame, key: str, order: str, attributes: list[str]) -> DataFrame:
    """One row per id with the attributes of its first part."""
    return parts.groupBy(key).agg(*[F.min_by(a, order).alias(a) for a in attributes])


def erosion_profile(rate: DataFrame, value: str = "soil_loss", tolerance: float = 5.0) -> DataFrame:
    """Exact profile of a layer; the median is selected by rank over ranges, not collected."""
    v = F.col(value)
    stats = rate.agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"),
        (F.avg(F.when(v.isNotNull(), F.when(v > tolerance, 1.0).otherwise(0.0))) * 100).alias("pct_over"),
        (F.count(v) * 100.0 / F.count(F.lit(1))).alias("pct_valid"),
    )
    cell = rate.select(value, (F.col("r").cast("bigint") * 4_000_000_000 + F.col("c")).alias("_cell"))
    median = quantiles(cell, value, "_cell", {"median": 0.5})
    return stats.withColumn("median", median.scalar())
