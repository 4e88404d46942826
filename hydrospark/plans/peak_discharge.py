"""Peak discharge by the rational and the graphical method."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hydrospark.functions import peakflow as P
from hydrospark.operators.gauge import donor_runoff_c, station_runoff_c
from hydrospark.operators.intensity import intensity_for
from hydrospark.schema import require_columns
from hydrospark.session import dealt


def with_time_of_concentration(watersheds: DataFrame) -> DataFrame:
    tov, tch, tc = P.time_of_concentration(F.col("ov_len_m"), F.col("ch_len_m"), F.col("avg_sl"))
    return watersheds.withColumns({"tov_min": tov, "tch_min": tch, "tc_min": tc})


def rational_from_stations(watersheds: DataFrame, pidf: DataFrame, rps: list[float], ref_compat: bool = False) -> DataFrame:
    """Point intensities of the station, reduced to the area; (point, period, bound) rows.

    ``ref_compat`` applies the factor of the last period to all periods.
    """
    require_columns(watersheds, ["point_id", "area_ha", "c_runoff", "tc_min", "station"])
    rows = intensity_for(watersheds, pidf, rps)
    arf = P.area_reduction(F.col("dur_min") / 60, F.col("area_ha"))
    factor = P.period_factor(F.lit(float(rps[-1])) if ref_compat else F.col("rp"))
    return rows.withColumn("areal_in_hr", F.col("v") * arf).select(
        "point_id", F.col("rp").alias("return_period"), "bound", "dur_min",
        (F.col("areal_in_hr") * 2.54).alias("pi_cm_hr"),
        P.q_rational(factor, F.col("c_runoff"), F.col("areal_in_hr"), F.col("area_ha")).alias("q_cms"),
    )


def rational_event(watersheds: DataFrame, intensity_in_hr: float) -> DataFrame:
    """One event intensity everywhere; no period factor."""
    require_columns(watersheds, ["point_id", "area_ha", "c_runoff", "tc_min"])
    areal = F.lit(float(intensity_in_hr)) * P.area_reduction(P.nearest_duration(F.col("tc_min")) / 60, F.col("area_ha"))
    return watersheds.withColumn("_i", areal).select(
        "point_id", F.lit("event").alias("return_period"), (F.col("_i") * 2.54).alias("pi_cm_hr"),
        P.q_rational(F.lit(1.0), F.col("c_runoff"), F.col("_i"), F.col("area_ha")).alias("q_cms"),
    )


def rational_from_series(watersheds: DataFrame, intensities: DataFrame) -> DataFrame:
    """Intensities (cm/hr) estimated from the project's own rain series, one per period and bound."""
    require_columns(watersheds, ["point_id", "area_ha", "c_runoff"])
    return watersheds.select("point_id", "area_ha", "c_runoff").join(intensities, "point_id").select(
        "point_id", "return_period", "bound",
        P.q_rational_series(F.col("c_runoff"), F.col("pi_cm_hr"), F.col("area_ha")).alias("q_cms"),
    )


def rational_from_gauges(watersheds: DataFrame, series: DataFrame, roi: DataFrame, intensities: DataFrame, **names) -> DataFrame:
    """Runoff coefficient from observed storms, passed on to ungauged watersheds, then as above."""
    station = station_runoff_c(series, **names)
    return rational_from_series(donor_runoff_c(watersheds.drop("c_runoff"), station, roi), intensities)


def graphical(watersheds: DataFrame, pidf_24h: DataFrame, rps: list[float], ref_compat: bool = False) -> DataFrame:
    """Curve-number peak discharge from 24-hour depths (inches) per station, period and bound."""
    rows = intensity_for(watersheds, pidf_24h, rps, duration=F.lit(1440.0))
    return _graphical(rows, F.col("v"), P.rain_type_or_default(F.col("rain_type")), F.col("rp"), F.col("bound"), ref_compat)


def graphical_event(watersheds: DataFrame, depth_in: float, ref_compat: bool = False) -> DataFrame:
    """One event depth everywhere, type II distribution."""
    return _graphical(dealt(watersheds), F.lit(float(depth_in)), F.lit("II"), F.lit("event"), F.lit("E"), ref_compat)


def _graphical(rows: DataFrame, depth, kind, period, bound, ref_compat: bool) -> DataFrame:
    twice = 2.54 * 2.54 if ref_compat and "v" not in rows.columns else 2.54
    # staged columns: the bracket expressions repeat their input many times, so it must be a plain column
    base = rows.withColumns({
        "_p": depth, "_kind": kind, "_tc": F.col("tc_min") / 60, "_ia": P.initial_abstraction(F.col("cn_val")),
        "_share": P.wetland_share(F.col("wet_a_ha"), F.col("area_ha")), "_period": period, "_bound": bound,
    })
    base = base.withColumns({
        "_ratio": F.try_divide("_ia", "_p"), "_error": P.unit_peak_error(F.col("_ia"), F.col("_p"), F.col("_tc"), F.col("_kind")),
        "_fp": P.wetland_factor(F.col("_share")), "_runoff": P.runoff_depth(F.col("_p"), F.col("cn_val"), ref_compat),
    })
    ok = F.col("_error").isNull()
    base = base.withColumns({f"_c{i}": P.unit_coefficient(F.col("_kind"), F.col("_ratio"), i) for i in range(3)}).withColumn(
        "_t", F.log10(F.when(ok, F.col("_tc"))))
    unit = P.unit_peak_from(ok, F.col("_t"), F.col("_c0"), F.col("_c1"), F.col("_c2"))
    return base.select(
        "point_id", F.col("_period").alias("return_period"), F.col("_bound").alias("bound"), (F.col("_p") * twice).alias("p_cm"),
        P.q_graphical(unit, F.col("_runoff"), F.col("area_ha"), F.col("_fp")).alias("q_cms"), F.col("_error").alias("error"),
    )


def bounds_wide(q: DataFrame, prefix: str, rps: list[int]) -> DataFrame:
    """Output form: one column per period and bound (L, E, U)."""
    name = F.concat(F.lit(prefix), F.col("return_period").cast("int").cast("string"), F.lit("yr"), F.col("bound"))
    return q.withColumn("_n", name).groupBy("point_id").pivot(
        "_n", [f"{prefix}{p}yr{b}" for p in rps for b in "LEU"]
    ).agg(F.first("q_cms"))
