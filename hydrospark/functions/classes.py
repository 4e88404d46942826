"""Classing of cell values and scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hydrospark.functions.hydraulics import lookup

# Class schemes of the erosion models.
SLOPE_PCT = [5, 10, 20, 45]
NDVI = [-0.6, -0.2, 0.2, 0.6]
DISTANCE_M = [30, 60, 90, 120]
SOIL_RANGES = {
    "rootznaws": [50, 100, 150, 200], "kwfact": [0.13, 0.26, 0.39, 0.52], "ksat_h": [1, 5, 20, 50],
    "resdepb_r": [25, 50, 100, 150], "tfact": [1, 2, 3, 4],
}
SOIL_INVERSE = ["ksat_h", "resdepb_r"]
SOIL_CLASSES = {
    "drainagecl": {1: 1, 2: 2, 3: 2, 4: 3, 5: 3, 6: 4, 7: 5},
    "runoff": {0: 1, 1: 1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5},
    "soilslippot": {1: 1, 2: 2, 3: 3, 4: 4, 5: 5},
    "taxorder": {1: 1, 2: 5, 3: 4, 4: 4, 5: 2, 6: 3, 7: 2, 8: 2, 9: 3, 10: 1, 11: 2, 12: 3},
}
ROCK_CLASSES = {
    "metasedimentary rock": 4, "schist": 3, "granitic gneiss": 2, "gneiss": 3, "ultramafic intrusive rock": 1,
    "biotite gneiss": 3, "quartzite": 4, "mica schist": 3, "slate": 4, "limestone": 5, "shale": 5,
    "dolostone (dolomite)": 4, "conglomerate": 3, "phyllite": 3, "sandstone": 5, "amphibolite": 3, "water": 5,
    "biotite schist": 4, "chert": 1, "marble": 2, "granite": 1, "amphibole schist": 3, "mylonite": 4,
    "felsic metavolcanic rock": 1, "metavolcanic rock": 1, "gabbro": 1, "mafic metavolcanic rock": 1, "sand": 5,
    "mafic gneiss": 3, "alluvium": 4, "clay or mud": 4, "hornfels": 3, "charnockite": 4, "dune sand": 5,
    "unconsolidated deposit": 5, "beach sand": 5,
}
MANAGEMENT = {
    11: "fallow", 12: "fallow", 21: "urban_open", 22: "urban_low", 23: "urban_medium", 24: "urban_high", 31: "fallow",
    41: "forest_evergreen", 42: "forest_deciduous", 43: "forest_mixed", 52: "shrubland", 71: "grassland",
    81: "pasture", 82: "cropland", 90: "forest_wetland", 95: "wetland",
}
SUSCEPTIBILITY = {
    "Very Low": 1, "Low": 2, "Low-Medium": 3, "Medium": 4, "Medium-High": 5, "High": 6, "Very High": 7,
}
SOIL_GROUPS = {"A": 1, "B": 2, "C": 3, "D": 4}


def range_class(v: Column, thresholds: list[float]) -> Column:
    """Right-closed classes 1 .. n+1."""
    out = F.when(v <= thresholds[0], 1)
    for i, t in enumerate(thresholds[1:], start=2):
        out = out.when(v <= t, i)
    return out.when(v > thresholds[-1], len(thresholds) + 1)


def distance_class(d: Column) -> Column:
    """5 within 30 m down to 2 within 120 m; 1 beyond or unknown."""
    out = F.when(d <= DISTANCE_M[0], 5)
    for i, t in enumerate(DISTANCE_M[1:], start=1):
        out = out.when(d <= t, 5 - i)
    return out.otherwise(1)


def inverse_class(v: Column) -> Column:
    return 6 - v


def score_category(score: Column) -> Column:
    return (
        F.when(score.isNull() | F.isnan(score), "No Data").when(score < 1, "Very Low").when(score < 2, "Low")
        .when(score < 3, "Moderate").when(score < 4, "High").otherwise("Very High")
    )


def soil_group_code(group: Column) -> Column:
    """A-D to 1-4; a dual group such as B/D counts as D."""
    return lookup(F.when(group.contains("/"), F.lit("D")).otherwise(group), SOIL_GROUPS)


def rock_class(name: Column) -> Column:
    return lookup(F.lower(F.trim(name)), ROCK_CLASSES)


def management_name(nlcd: Column) -> Column:
    return lookup(nlcd.cast("int"), MANAGEMENT, "forest_mixed")


def management_group(name: Column) -> Column:
    return (
        F.when(name.contains("forest"), "forest").when(name.contains("crop"), "crop")
        .when(name.contains("grass") | name.contains("pasture"), "grass").otherwise("default")
    )


def soil_class(variable: str, v: Column) -> Column:
    if variable in SOIL_RANGES:
        c = range_class(v, SOIL_RANGES[variable])
        return inverse_class(c) if variable in SOIL_INVERSE else c
    return lookup(v.cast("int"), SOIL_CLASSES[variable])


def slope_category(pct: Column) -> Column:
    return F.when(pct < 2, "0_2").when(pct < 6, "2_6").when(pct >= 6, "6")
