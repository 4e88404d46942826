"""At-site and regional flood frequency, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hydrospark.operators import cleaning as C, frequency as Q, gauge as G, regions as R
from hydrospark.session import cut

BEST = {0: "Stationary", 1: "Non-Stationary in location", 2: "Non-Stationary in location and scale"}


def annual_series(series: DataFrame, value: str = "flow", site: str = "site", year: str = "yr", tie: str = "obs_id", per_area: bool = False,
                  outliers: str = "Zscore", z: float = 3.0, ties: bool = False) -> DataFrame:
    am = G.annual_max(series, value, site, year, tie, ties, per_area)
    return C.remove_outliers(am, value, outliers, z, site)


def at_site(annual: DataFrame, value: str = "flow", site: str = "site", year: str = "yr", covar: str | None = None, non_stationary: bool = False,
            dist: str = "GEV", sig: float = 0.05, rps: list[float] = (25, 50, 100)) -> dict[str, DataFrame]:
    """Site statistics (trend, tests, best model, parameters, index) and return levels with bounds."""
    trend = Q.mann_kendall(annual, value, site, year)
    idx = Q.index_flood(annual, value, site)
    scaled = Q.minmax_covariate(annual, covar, site, year) if non_stationary else annual.withColumn("cov", F.lit(0.0))
    arrays = Q.site_arrays(scaled, value, site, year)
    models = ["m0", "m1", "m2"] if non_stationary else ["m0"]
    fits = cut(Q.gev_fits(arrays.repartition(4 * annual.sparkSession.sparkContext.defaultParallelism, site), models, dist))
    stats = fits.join(trend.drop("n"), site).join(idx, site)
    k0 = 3 if dist == "GEV" else 2
    if non_stationary:
        nll = stats.withColumns({f"nll{i}": F.col(f"m{i}.nll") for i in range(3)})
        chosen = Q.aic_select(Q.lr_tests(nll), k0)
        trending = F.coalesce(F.col("p_value") <= sig, F.lit(False))
        for c in ("p01", "p02", "p12", "aic1", "aic2"):
            chosen = chosen.withColumn(c, F.when(trending, F.col(c)))
        chosen = chosen.withColumn("best", F.when(trending, F.col("best")).otherwise(0))
    else:
        none = F.lit(None).cast("double")
        chosen = stats.withColumns({
            "aic0": 2.0 * k0 + 2 * F.col("m0.nll"), "aic1": none, "aic2": none, "p01": none, "p02": none, "p12": none, "best": F.lit(0),
        })
    pick = F.col("m0")
    for i in (1, 2):
        if non_stationary:
            pick = F.when(F.col("best") == i, F.col(f"m{i}")).otherwise(pick)
    chosen = chosen.withColumn("fit", pick)
    span = F.transform("c", lambda c: F.struct((F.col("fit.loc0") + F.col("fit.loc1") * c).alias("loc"), (-c).alias("nc")))
    top = F.array_max(span)
    name = F.element_at(F.create_map(*[F.lit(v) for kv in BEST.items() for v in kv]), F.col("best"))
    chosen = cut(chosen.withColumns({
        "loc": top["loc"], "scale": F.exp(F.col("fit.lsc0") - F.col("fit.lsc1") * top["nc"]), "shape": F.col("fit.shape"),
        "n": F.col("n_years"), "best_model": name,
    }))
    table = chosen.select(
        site, "n", "tau", "p_value", "p01", "p02", "p12", "aic0", "aic1", "aic2", "best_model", "loc", "scale", "shape", "index_value"
    )
    return {"stats": table, "levels": Q.return_levels_ci(chosen, "fit", rps, sig, site)}


def pooled(stats: DataFrame, watersheds: DataFrame, rps: list[float], n_boot: int = 501, sig: float = 0.05) -> DataFrame:
    """One station, or several without regions: one growth curve for all watersheds."""
    params = Q.weighted_params(stats, []).withColumn("region", F.lit("pool"))
    curve = Q.growth_curve(params, rps, "region", n_boot, sig=sig)
    sites = watersheds.select("point_id", "area_ha").withColumns({"region": F.lit("pool"), "index_value": Q.index_pooled(stats)})
    # one region: as many rows as return periods
    return Q.growth_scale(sites, F.broadcast(curve))


def rain_curve(stats: DataFrame, watersheds: DataFrame, rps: list[float], n_boot: int = 501, sig: float = 0.05) -> DataFrame:
    """Rain intensities: the pooled curve itself, the same for every watershed."""
    curve = Q.growth_curve(Q.weighted_params(stats, []).withColumn("region", F.lit("pool")), rps, "region", n_boot, sig=sig)
    return watersheds.select("point_id").withColumn("region", F.lit("pool")).join(F.broadcast(curve), "region").drop("region")


def regional(stats: DataFrame, annual: DataFrame, sites: DataFrame, descriptors: list[str], rps: list[float], value: str = "flow",
             n_boot: int = 501, sig: float = 0.05, limit: float = 0.95, test: str = "AD") -> dict[str, DataFrame]:
    """Regional estimates for gauged and ungauged watersheds.

    ``sites``: point_id, gws_id, area_ha and the descriptors. Gauged watersheds use their own index
    value and the pool around them; ungauged ones the index of their first donor.
    """
    gauged, ungauged = R.split_gauged(sites, stats.select("site"))
    gauged, ungauged = cut(gauged), cut(ungauged)
    own = gauged.select(F.col("gws_id").alias("site"), F.col("point_id").alias("donor"))
    donor_stats = cut(stats.join(own, "site"))
    scaled = annual.select("site", F.col(value).cast("double").alias("x")).join(donor_stats.select("site", "donor", "index_value"), "site").select(
        "donor", (F.col("x") / F.col("index_value")).alias("x"))
    pools = cut(R.homogeneous_pools(sites.select("point_id", *descriptors), gauged, descriptors, scaled, limit, test=test))
    regions, members = R.shared_sets(pools)
    regions = cut(regions)
    params = cut(Q.weighted_params(members.join(donor_stats, "donor"), ["region"]))
    curves = cut(Q.growth_curve(params, rps, "region", n_boot, sig=sig))
    first = pools.where("rank = 1").select(F.col("site").alias("point_id"), "donor")
    index = donor_stats.select("donor", "index_value")
    own_index = donor_stats.select(F.col("donor").alias("point_id"), F.col("index_value").alias("_own"))
    target = (
        sites.select("point_id", "area_ha").join(regions.select(F.col("site").alias("point_id"), "region"), "point_id")
        .join(first, "point_id").join(index, "donor", "left").join(own_index, "point_id", "left")
        .withColumn("index_value", F.coalesce("_own", "index_value"))
    )
    return {"pools": pools, "regions": regions, "curves": curves, "estimates": Q.growth_scale(target, curves)}
