"""Culvert capacity and hydrologic vulnerability."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hydrospark.functions import hydraulics as H
from hydrospark.operators.cleaning import clean_na, fill_culvert_defaults, standardise_shape
from hydrospark.schema import has_column, require_columns
from hydrospark.session import dealt, spread

REQUIRED = ["point_id", "width_ft"]


def prepare_crossings(crossings: DataFrame, ref_compat: bool = False, **override: float) -> DataFrame:
    require_columns(crossings, REQUIRED)
    df = clean_na(crossings)
    if not has_column(df, "height_ft"):
        df = df.withColumn("height_ft", F.lit(None).cast("double"))
    return fill_culvert_defaults(standardise_shape(df, ref_compat=ref_compat), **override)


def geometry(df: DataFrame) -> DataFrame:
    """Flow area, hydraulic radius and characteristic depth where the dimensions are known."""
    shape, w, h = F.col("pour_sha"), F.col("width_ft"), F.col("height_ft")
    ok = H.valid_dimensions(shape, w, h)
    return df.withColumns({
        "area_ft2": F.when(ok, H.culvert_area(shape, w, h)),
        "radius_ft": F.when(ok, H.hydraulic_radius(shape, w, h)),
        "depth_ft": F.when(ok, H.characteristic_depth(shape, w, h)),
    })


def capacity_cfs(df: DataFrame, method: str):
    c = F.col
    hw = c("hw_ft") if has_column(df, "hw_ft") else None
    tw = c("tw_ft") if has_column(df, "tw_ft") else None
    if method == "orifice_flow":
        return H.q_orifice(c("cd_orifice"), c("area_ft2"), c("grp_size"), c("depth_ft"), hw)
    if method == "inlet_control":
        return H.q_inlet(c("area_ft2"), c("grp_size"), c("depth_ft"), c("y"), c("ks"), c("c"), c("culvert_sl"), hw)
    if method == "outlet_control":
        return H.q_outlet(c("area_ft2"), c("grp_size"), c("depth_ft"), c("radius_ft"), c("ke"), c("n_manning"),
                          c("culvert_sl"), c("l_m"), hw, tw)
    if method == "manning_uniform":
        return H.q_manning(c("area_ft2"), c("grp_size"), c("radius_ft"), c("n_manning"), c("culvert_sl"))
    raise ValueError(f"unknown capacity method {method!r}; one of {H.METHODS}")


def discharge_capacity(crossings: DataFrame, method: str = "manning_uniform", ref_compat: bool = False,
                       **override: float) -> DataFrame:
    """Crossings with capacity ``qc_cms`` (m3/s); null where dimensions are missing."""
    df = geometry(prepare_crossings(crossings, ref_compat, **override))
    return df.withColumn("qc_cms", H.cfs_to_cms(capacity_cfs(df, method)))


def peaks_to_long(peaks: DataFrame, method: str, key: str = "point_id") -> DataFrame:
    """Estimate columns of one method to (key, return_period, q_cms). An event column wins if present."""
    prefix = {"RationalMethod": "RM", "RegionalFrequency": "RF", "GPDM": "GP"}[method]
    event = f"{prefix}event"
    cols = [event] if event in peaks.columns and method != "RegionalFrequency" else [
        c for c in peaks.columns if c.startswith(prefix) and c.endswith("E")
    ]
    long = peaks.unpivot([key], cols, "_name", "q_cms")
    rp = F.when(F.col("_name").endswith("event"), F.lit("event")).otherwise(
        F.regexp_extract("_name", f"^{prefix}(.+)E$", 1)
    )
    return long.select(key, rp.alias("return_period"), F.col("q_cms").cast("double").alias("q_cms"))


def vulnerability_flags(capacity: DataFrame, peaks: DataFrame) -> DataFrame:
    """Capacity against peak per crossing and return period; the crossing key is the only shuffle key."""
    keep = [c for c in ("point_id", "pour_sha", "qc_cms", "x_m", "y_m") if c in capacity.columns]
    return dealt(capacity.select(*keep), "point_id").join(spread(peaks), "point_id").withColumn(
        "vuln", H.vulnerability(F.col("qc_cms"), F.col("q_cms"))
    )


def flags_wide(flags: DataFrame, periods: list) -> DataFrame:
    """Output form: one column per return period."""
    named = F.concat(F.col("return_period").cast("string"), F.lit("Vuln"))
    return (
        flags.withColumn("_p", named).groupBy("point_id", "qc_cms")
        .pivot("_p", [f"{p}Vuln" for p in periods]).agg(F.first("vuln"))
    )


def capacity_vulnerability(crossings: DataFrame, peaks: DataFrame, method: str = "manning_uniform",
                           qp_method: str = "RationalMethod", ref_compat: bool = False, **override: float) -> DataFrame:
    """Wide peaks in, long flags out, with every peak row kept."""
    long = peaks_to_long(dealt(peaks, "point_id"), qp_method)
    cap = discharge_capacity(crossings, method, ref_compat, **override).select("point_id", "pour_sha", "qc_cms")
    return long.join(spread(cap), "point_id", "left").select(
        "*", H.vulnerability(F.col("qc_cms"), F.col("q_cms")).alias("vuln"),
        F.lit(method).alias("qc_method"), F.lit(qp_method).alias("qp_method"),
    )
