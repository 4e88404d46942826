"""Hillslope model inputs and roll-ups: soils, climate, hillslopes, channels, watersheds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hydrospark.functions import erosion as E


def exact_sum(c: Column) -> Column:
    """Sum that does not depend on the order of rows: added up as decimals of nine digits."""
    return F.sum(c.cast("decimal(28,9)")).cast("double")


def horizon_kffact(horizon: DataFrame) -> DataFrame:
    """Erodibility where absent, from silt and clay shares."""
    return horizon.withColumn("kffact", F.coalesce("kffact", (F.col("silt") * 0.3 + F.col("clay") * 0.2) / 100))


def join_soil_tables(horizon: DataFrame, component: DataFrame, texture: DataFrame) -> DataFrame:
    """Horizon x component (inner) with the texture of the horizon where known."""
    return horizon.join(component, "cokey").join(texture, "chkey", "left")


def soil_by_mapunit(joined: DataFrame) -> DataFrame:
    """Component-share weighted means and the most common texture (first in order on a tie, default loam)."""
    w = F.col("comppct")

    def mean(v: str):
        return F.try_divide(exact_sum(F.col(v) * w), exact_sum(F.when(F.col(v).isNotNull(), w))).alias(v)

    stats = joined.groupBy("mukey").agg(mean("kffact"), mean("clay"), mean("sand"))
    n = joined.where("texdesc IS NOT NULL").groupBy("mukey", "texdesc").agg(F.count(F.lit(1)).alias("n"))
    mode = n.groupBy("mukey").agg(F.max("n").alias("n")).join(n, ["mukey", "n"]).groupBy("mukey").agg(F.min("texdesc").alias("texdesc"))
    return stats.join(mode, "mukey", "left").withColumn("texdesc", F.coalesce("texdesc", F.lit("loam")))


def soil_polygons(mapunits: DataFrame, soil: DataFrame) -> DataFrame:
    return mapunits.join(soil, "mukey")


def with_soil_params(soil: DataFrame) -> DataFrame:
    return soil.withColumns(E.soil_params(F.col("kffact"), F.col("clay")))


def with_dates(climate: DataFrame) -> DataFrame:
    """Calendar date from year and day of year."""
    return climate.withColumn("d", F.date_add(F.make_date("year", F.lit(1), F.lit(1)), F.col("yday") - 1))


def monthly_climate(climate: DataFrame, point: str = "point") -> DataFrame:
    """Monthly rain moments, wet-day shares and mean temperatures and radiation per point.

    Rain enters as whole millionths, so its power sums are exact and the moments do not depend on the
    order of the rows. Standard deviation and skew are those of a sample; too few days give 0.1 and 0.
    """
    p = F.col("prcp")
    x = F.round(p * 1e6).cast("decimal(12,0)")
    mean = lambda c: F.try_divide(exact_sum(F.col(c)), F.count(c))
    m = climate.groupBy(point, F.month("d").alias("month")).agg(
        mean("prcp").alias("prcp_mean"), F.count(p).alias("_n"), F.sum(x).alias("_s1"), F.sum(x * x).alias("_s2"), F.sum((x * x * x).cast("decimal(38,0)")).alias("_s3"),
        F.coalesce(F.avg(F.when(p > 0, 1.0).otherwise(0.0)), F.lit(0.1)).alias("p_wet_dry"),
        mean("tmax").alias("tmax_mean"), mean("tmin").alias("tmin_mean"), (mean("srad") * 2.064).alias("sol_rad"),
    )
    n, s1, s2, s3 = (F.col(c).cast("double") for c in ("_n", "_s1", "_s2", "_s3"))
    spread = n * s2 - s1 * s1
    # third central sum over n, and the correction of a sample
    third = s3 - 3 * s1 * s2 / n + 2 * s1 * s1 * s1 / (n * n)
    skew = F.when((n > 2) & (spread > 0), third / n / F.pow(spread / (n * n), F.lit(1.5)) * F.sqrt(n * (n - 1)) / (n - 2))
    return m.withColumns({
        "prcp_sd": F.coalesce(F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n * (n - 1))) / 1e6), F.lit(0.1)),
        "prcp_skew": F.coalesce(skew, F.lit(0.0)), "p_wet_wet": F.least(F.lit(1.0), F.col("p_wet_dry") * 1.5),
    }).drop("_n", "_s1", "_s2", "_s3")


def hillslope_slope(hillslope_cells: DataFrame, lengths: DataFrame, z: str = "z") -> DataFrame:
    """Slope fraction in [0.001, 1] and aspect (degrees) of the plane fitted to the cells (more than 10 needed).

    The plane comes from sums about the means, in one aggregate joined to per-hillslope means.
    """
    c = hillslope_cells.where(F.col(z).isNotNull())
    mean = c.groupBy("hillslope_id").agg(
        F.avg("c").alias("_mx"), F.avg("r").alias("_my"), F.avg(z).alias("_mz"), F.max(z).alias("z_max"),
        F.min(z).alias("z_min"), F.count(F.lit(1)).alias("_n"),
    )
    x, y, v = F.col("c") - F.col("_mx"), F.col("r") - F.col("_my"), F.col(z) - F.col("_mz")
    s = c.join(mean.select("hillslope_id", "_mx", "_my", "_mz"), "hillslope_id").groupBy("hillslope_id").agg(
        F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"), F.sum(x * v).alias("sxz"), F.sum(y * v).alias("syz")
    )
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    bx = F.try_divide(F.col("sxz") * F.col("syy") - F.col("syz") * F.col("sxy"), det)
    by = F.try_divide(F.col("syz") * F.col("sxx") - F.col("sxz") * F.col("sxy"), det)
    turned = F.degrees(F.atan2(by, bx))
    aspect = F.when((F.col("_n") > 10) & bx.isNotNull(), F.when(turned < 0, turned + 360).otherwise(turned)).otherwise(0.0)
    slope = F.least(F.greatest(F.try_divide(F.col("z_max") - F.col("z_min"), F.col("length_m")), F.lit(0.001)), F.lit(1.0))
    return mean.join(s, "hillslope_id").join(lengths, "hillslope_id").select(
        "hillslope_id", F.when(F.col("length_m") >= 1, slope).alias("slope"), aspect.alias("aspect_deg")
    )


def hillslope_rollup(hillslopes: DataFrame) -> DataFrame:
    return hillslopes.where("watershed_id IS NOT NULL").groupBy("watershed_id").agg(
        F.avg("runoff_mm").alias("runoff_mm"), F.avg("precipitation_mm").alias("precipitation_mm"),
        F.avg("soil_loss_kg_m2").alias("soil_loss_kg_m2"), F.sum("sediment_yield_kg").alias("sediment_yield_kg"),
        F.count(F.lit(1)).alias("hillslope_count"),
    )


def channel_accumulate(hillslopes: DataFrame) -> DataFrame:
    """Runoff and sediment that reach each channel, and its approximate peak flow."""
    h = hillslopes.fillna(0.0, ["runoff_mm", "sediment_yield_kg"])
    return h.groupBy("channel_id").agg(
        (F.sum("runoff_mm") * 0.9).alias("channel_runoff_mm"), (F.sum("sediment_yield_kg") * 0.8).alias("channel_sediment_kg"),
        (F.max("runoff_mm") * 0.05).alias("peak_flow_m3s"),
    )


def channel_network(channels: DataFrame) -> DataFrame:
    return channels.agg(
        F.count(F.lit(1)).alias("channels"), F.avg("channel_runoff_mm").alias("avg_runoff_mm"),
        F.sum("channel_sediment_kg").alias("total_sediment_kg"), F.max("peak_flow_m3s").alias("max_peak_flow_m3s"),
    )


def watershed_budget(hillslopes: DataFrame, channels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area-weighted rain and runoff, soil loss, delivery ratio and sediment yield with the channels' share."""
    by = by or []
    h = hillslopes.fillna(0.0, ["precipitation_mm", "runoff_mm", "soil_loss_kg_m2", "sediment_yield_kg"])
    a = F.col("area_ha")
    b = h.groupBy(*by).agg(
        F.sum(a).alias("total_area_ha"), F.try_divide(F.sum(F.col("precipitation_mm") * a), F.sum(a)).alias("avg_precipitation_mm"),
        F.try_divide(F.sum(F.col("runoff_mm") * a), F.sum(a)).alias("avg_runoff_mm"),
        F.sum(F.col("soil_loss_kg_m2") * a * 10_000).alias("total_soil_loss_kg"),
        F.sum("sediment_yield_kg").alias("total_hillslope_sediment_kg"),
    )
    total = channels.groupBy(*by).agg(F.sum("channel_sediment_kg").alias("total_channel_sediment_kg"))
    if by:
        j = b.join(total, by, "left")
    else:
        j = b.withColumn("total_channel_sediment_kg", total.select("total_channel_sediment_kg").scalar())
    j = j.fillna(0.0, ["total_channel_sediment_kg"])
    return j.withColumns({
        "watershed_sediment_yield_kg": F.col("total_hillslope_sediment_kg") + F.col("total_channel_sediment_kg"),
        "avg_soil_loss_kg_m2": F.coalesce(F.try_divide("total_soil_loss_kg", F.col("total_area_ha") * 10_000), F.lit(0.0)),
        "sediment_delivery_ratio": F.coalesce(F.try_divide("total_hillslope_sediment_kg", "total_soil_loss_kg"), F.lit(0.0)),
    })


def watershed_peak(hillslopes: DataFrame, channels: DataFrame) -> DataFrame:
    """Peak flow of a watershed: the largest of its channels."""
    own = hillslopes.select("watershed_id", "channel_id").distinct()
    return own.join(channels, "channel_id").groupBy("watershed_id").agg(F.max("peak_flow_m3s").alias("peak_flow_m3s"))
