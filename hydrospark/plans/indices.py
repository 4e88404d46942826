"""Weighted vulnerability indices over cell layers: streambank erosion and debris flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hydrospark.functions import classes as K
from hydrospark.operators.binning import rank_score
from hydrospark.operators.zonal import zonal_sum

# Layer names of the two indices.
STREAMBANK_LAYERS = [
    "24hr100yrPI", "30yrPrecipNorm", "30yrTempNorm", "30yrSolarNorm", "AWSrtzn", "RunoffClass", "DrainageClass",
    "HydroSoilGrp", "Slope", "LandCover",
]
DEBRIS_LAYERS = [
    "AWS0150WTA", "DrainageClass", "KFactor", "KsatHigh", "RunoffClass", "SoilSlipPotential", "SoilBottomDepth",
    "SoilTaxonomicOrder", "TFactor", "GeologyRockType1", "NDVI", "PI", "Slope", "RoadBuffer", "StreamBuffer",
]


def soil_layers(template: DataFrame, soil: DataFrame, variables: list[str]) -> DataFrame:
    """Classed soil variables on the template cells from one scan of the long soil grid.

    States overlap at their borders; the first state with a value wins. A variable without a grid
    stays null.
    """
    wanted = soil.where(F.col("variable").isin(variables) & F.col("v").isNotNull())
    one = wanted.groupBy("r", "c", "variable").agg(F.min_by("v", "state").alias("v"))
    wide = one.groupBy("r", "c").agg(*[
        K.soil_class(v, F.max(F.when(F.col("variable") == v, F.col("v")))).alias(v) for v in variables
    ])
    return template.select("r", "c").distinct().join(wide, ["r", "c"], "left")


def weighted_overlay(layers: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Sum of weight x value over the layers a cell has.

    ``layers`` is wide, (r, c, one column per layer), and summed in a projection; layers that arrive
    apart may be long, (layer, r, c, v), and cost a shuffle.
    """
    if any(w < 0 for w in weights.values()):
        raise ValueError("layer weights must not be negative")
    if "layer" not in layers.columns:
        used = [F.col(f"`{n}`").cast("double") for n in weights if n in layers.columns]
        parts = [F.coalesce(c * float(weights[n]), F.lit(0.0)) for c, n in zip(used, [n for n in weights if n in layers.columns])]
        return layers.where(F.coalesce(*used).isNotNull()).select("r", "c", sum(parts[1:], parts[0]).alias("score_sum"))
    from hydrospark.functions.hydraulics import lookup
    w = lookup(F.col("layer"), {k: float(v) for k, v in weights.items()})
    return layers.where(F.col("layer").isin(list(weights)) & F.col("v").isNotNull()).groupBy("r", "c").agg(
        F.sum(F.col("v") * w).alias("score_sum")
    )


def zone_index(overlay: DataFrame, zone_cells: DataFrame, zones: DataFrame, equal_is_middle: bool) -> DataFrame:
    """Zone sums, rank scores 0 .. 5 and categories; a zone without a cell has no data."""
    total = zonal_sum(zone_cells, overlay, "score_sum", "total")
    # sums of the same parts in another order differ in the last bits; equal totals must tie
    all_zones = zones.select("zone_id").join(total, "zone_id", "left").withColumn("total", F.round("total", 6))
    return rank_score(all_zones, "total", "zone_id", "score", equal_is_middle).withColumn(
        "category", K.score_category(F.col("score"))
    )


def streambank_index(layers: DataFrame, weights: dict[str, float], buffer_cells: DataFrame, zone_cells: DataFrame,
                     zones: DataFrame) -> DataFrame:
    """Ten weighted layers within the stream buffer, summed per watershed."""
    near = layers.join(buffer_cells.select("r", "c").distinct(), ["r", "c"], "left_semi")
    return zone_index(weighted_overlay(near, weights), zone_cells, zones, True)


def debris_flow_index(layers: DataFrame, weights: dict[str, float], zone_cells: DataFrame, zones: DataFrame) -> DataFrame:
    """Fifteen weighted layers over the whole region, summed per watershed."""
    return zone_index(weighted_overlay(layers, weights), zone_cells, zones, False)
