"""At-site and regional flood-frequency statistics over annual series (one row per site and year).

A site's rows number its years, so a window or an array per site is bounded by the calendar.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hydrospark.functions import stats as S
from hydrospark.session import spread

RETURN_PERIODS = [2, 10, 25, 50, 100]


def index_flood(annual: DataFrame, value: str, site: str = "site") -> DataFrame:
    return annual.groupBy(site).agg(F.avg(value).alias("index_value"), F.count(F.lit(1)).alias("n_years"))


def minmax_covariate(annual: DataFrame, covar: str | None, site: str = "site", year: str = "yr") -> DataFrame:
    """``cov`` in [-1, 1]: a given covariate is scaled only when its size passes 100; none means the row index."""
    if covar is None:
        k = F.row_number().over(W.partitionBy(site).orderBy(year))
        n = annual.groupBy(site).agg(F.count(F.lit(1)).alias("_n"))
        scaled = F.coalesce(F.try_divide(2.0 * (F.col("_k") - 1), F.col("_n") - 1) - 1, F.lit(0.0))
        return annual.withColumn("_k", k).join(n, site).withColumn("cov", scaled).drop("_k", "_n")
    c = F.col(covar)
    s = annual.groupBy(site).agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"), F.max(F.abs(c)).alias("_abs"))
    scaled = F.coalesce(F.try_divide(2.0 * (c - F.col("_lo")), F.col("_hi") - F.col("_lo")) - 1, F.lit(0.0))
    return annual.join(s, site).withColumn("cov", F.when(F.col("_abs") > 100, scaled).otherwise(c)).drop("_lo", "_hi", "_abs")


def mann_kendall(annual: DataFrame, value: str, site: str = "site", year: str = "yr") -> DataFrame:
    """Kendall's tau and two-sided p of the trend per site.

    The pair sum is counted without forming pairs: ranks are compared bit by bit, and two years are
    split at exactly one bit (where their ranks first differ), so each row meets one running count
    per bit: n log n rows instead of n squared.
    """
    by_value = W.partitionBy(site).orderBy(value)
    r = annual.select(site, year, value, (F.dense_rank().over(by_value) - 1).alias("rk"))
    bits = F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("_n") + F.lit(1.0))).cast("int"))).alias("bit")
    n = annual.groupBy(site).agg(F.count(F.lit(1)).alias("_n"))
    levels = r.join(n, site).select(site, year, "rk", bits)
    levels = levels.withColumns({"one": F.expr("shiftright(rk, bit) & 1"), "prefix": F.expr("shiftright(rk, bit + 1)")})
    past = W.partitionBy(site, "bit", "prefix").orderBy(year).rowsBetween(W.unboundedPreceding, -1)
    ones = F.coalesce(F.sum("one").over(past), F.lit(0))
    rows = F.coalesce(F.count(F.lit(1)).over(past), F.lit(0))
    gain = F.when(F.col("one") == 1, F.col("_rows") - F.col("_ones")).otherwise(-F.col("_ones"))
    s = levels.withColumns({"_ones": ones, "_rows": rows}).groupBy(site).agg(F.sum(gain).alias("s"))
    t = F.col("t")
    ties = annual.groupBy(site, value).agg(F.count(F.lit(1)).alias("t")).groupBy(site).agg(
        F.sum(t).alias("n"), F.sum(t * (t - 1) / 2).alias("tied"), F.sum(t * (t - 1) * (2 * t + 5)).alias("tie_var")
    )
    nn = F.col("n")
    pairs = nn * (nn - 1) / 2.0
    var = (nn * (nn - 1) * (2 * nn + 5) - F.col("tie_var")) / 18.0
    z = F.try_divide(F.col("s") - F.signum(F.col("s").cast("double")), F.sqrt(var))
    return s.join(ties, site).select(
        site, F.col("n").cast("bigint").alias("n"), F.col("s").cast("bigint").alias("s"),
        F.try_divide(F.col("s"), F.sqrt(pairs - F.col("tied")) * F.sqrt(pairs)).alias("tau"),
        S.two_sided_p(z).alias("p_value"),
    )


def gev_lmoments(annual: DataFrame, value: str, site: str = "site", tie: str = "yr") -> DataFrame:
    """GEV parameters per site by L-moments: ranks within the site, three weighted sums, closed form."""
    rank = F.row_number().over(W.partitionBy(site).orderBy(value, tie))
    n = annual.groupBy(site).agg(F.count(F.lit(1)).alias("n"))
    r = annual.select(site, value, (rank - 1).alias("_i")).join(n, site)
    x, i, m = F.col(value), F.col("_i"), F.col("n")
    b = r.groupBy(site, "n").agg(
        F.avg(x).alias("b0"), F.avg(x * F.try_divide(i, m - 1)).alias("b1"),
        F.avg(x * F.try_divide(i * (i - 1), (m - 1) * (m - 2))).alias("b2"),
    )
    b0, b1, b2 = F.col("b0"), F.col("b1"), F.col("b2")
    lm = b.withColumns({"l1": b0, "l2": 2 * b1 - b0, "l3": 6 * b2 - 6 * b1 + b0})
    c = 2 / (3 + F.try_divide(F.col("l3"), F.col("l2"))) - math.log(2) / math.log(3)
    k = F.col("k")
    gam = S.gamma(1 + k)
    near = F.abs(k) < 1e-6
    scale = F.when(near, F.col("l2") / math.log(2)).otherwise(F.col("l2") * k / ((1 - F.pow(F.lit(2.0), -k)) * gam))
    loc = F.when(near, F.col("l1") - S.EULER * F.col("scale")).otherwise(F.col("l1") - F.col("scale") * (1 - gam) / k)
    return (
        lm.withColumn("k", 7.8590 * c + 2.9554 * c * c).withColumn("scale", scale).withColumn("loc", loc)
        .select(site, "n", "loc", "scale", (-k).alias("shape"))
    )


def site_arrays(annual: DataFrame, value: str, site: str = "site", year: str = "yr") -> DataFrame:
    """One row per site: values and covariate in year order (arrays as long as the record in years)."""
    cov = F.col("cov") if "cov" in annual.columns else F.lit(0.0)
    rows = F.array_sort(F.collect_list(F.struct(F.col(year).alias("y"), F.col(value).cast("double").alias("x"), cov.cast("double").alias("c"))))
    return annual.where(F.col(value).isNotNull()).groupBy(site).agg(rows.alias("_r")).select(
        site, F.transform("_r", lambda s: s["x"]).alias("x"), F.transform("_r", lambda s: s["c"]).alias("c")
    )


def gev_fits(arrays: DataFrame, models: list[str] = ("m0",), dist: str = "GEV") -> DataFrame:
    """Adds one struct column per model with parameters, likelihood and covariance."""
    from hydrospark.functions.gev import fit_udf
    out = arrays
    for m in models:
        out = out.withColumn(m, fit_udf(m, dist)("x", "c"))
    return out


def lr_tests(nll: DataFrame, n0: str = "nll0", n1: str = "nll1", n2: str = "nll2") -> DataFrame:
    """Likelihood-ratio p values of the nested models (one, two and one more parameters)."""
    a, b, c = F.col(n0), F.col(n1), F.col(n2)
    return nll.withColumns({
        "p01": S.chi2_sf(2 * (a - b), 1), "p02": S.chi2_sf(2 * (a - c), 2), "p12": S.chi2_sf(2 * (b - c), 1),
    })


def aic_select(nll: DataFrame, k0: int = 3, n0: str = "nll0", n1: str = "nll1", n2: str = "nll2") -> DataFrame:
    """AIC of each model and the index of the first smallest."""
    aic = [2.0 * (k0 + i) + 2 * F.col(c) for i, c in enumerate((n0, n1, n2))]
    best = F.array_min(F.array(*[F.struct(a.alias("a"), F.lit(i).alias("i")) for i, a in enumerate(aic)]))["i"]
    return nll.withColumns({"aic0": aic[0], "aic1": aic[1], "aic2": aic[2], "best": best})


def effective_params(params: DataFrame, series: DataFrame, site: str = "site") -> DataFrame:
    """Location at its largest over the covariate, and the scale of that same row.

    ``params`` has loc0, loc1, lsc0, lsc1, shape per site; ``series`` has the covariate per row.
    """
    j = series.select(site, "cov").join(params, site)
    loc = F.col("loc0") + F.col("loc1") * F.col("cov")
    scale = F.exp(F.col("lsc0") + F.col("lsc1") * F.col("cov"))
    top = j.groupBy(site).agg(
        F.max_by(F.struct(loc.alias("loc"), scale.alias("scale"), "shape"), F.struct(loc, -F.col("cov"))).alias("_e")
    )
    return top.select(site, "_e.loc", "_e.scale", "_e.shape")


def return_levels(params: DataFrame, rps: list[float], site: str = "site") -> DataFrame:
    """(site, rp, level) at probability 1 - 1/rp."""
    rp = F.explode(F.array(*[F.lit(float(r)) for r in rps]))
    return params.select(site, "loc", "scale", "shape", rp.alias("rp")).select(
        site, "rp", S.gev_quantile(1 - 1 / F.col("rp"), F.col("loc"), F.col("scale"), F.col("shape")).alias("level")
    )


def return_levels_ci(fits: DataFrame, model: str, rps: list[float], sig: float = 0.05, site: str = "site") -> DataFrame:
    """Return levels with normal-approximation bounds from the covariance of the fit.

    Non-stationary models are evaluated at the covariate of the last year.
    """
    q = NormalDist().inv_cdf(1 - sig / 2)
    m = lambda f: F.col(f"{model}.{f}")
    last = F.coalesce(F.element_at("c", -1), F.lit(0.0))
    p = fits.select(site, model, last.alias("_c"), F.explode(F.array(*[F.lit(float(r)) for r in rps])).alias("rp"))
    loc, sc, xi = m("loc0") + m("loc1") * F.col("_c"), F.exp(m("lsc0") + m("lsc1") * F.col("_c")), m("shape")
    y = -F.ln(1 - 1 / F.col("rp"))
    flat = F.abs(xi) < 1e-6
    safe = F.when(flat, F.lit(1.0)).otherwise(xi)
    grow = F.when(flat, -F.ln(y)).otherwise((F.pow(y, -xi) - 1) / safe)
    d_xi = F.when(flat, sc * F.ln(y) * F.ln(y) / 2).otherwise(-sc * (F.pow(y, -xi) - 1) / (safe * safe) - sc / safe * F.pow(y, -xi) * F.ln(y))
    grad = [F.lit(1.0), F.col("_c"), sc * grow, sc * grow * F.col("_c"), d_xi]
    var = F.lit(0.0)
    for i in range(5):
        for j in range(5):
            var = var + grad[i] * grad[j] * F.get(m("cov"), F.lit(5 * i + j))
    half = q * F.sqrt(F.greatest(var, F.lit(0.0)))
    level = loc + sc * grow
    return p.select(site, "rp", (level - half).alias("lower"), level.alias("level"), (level + half).alias("upper"))


def weighted_params(params: DataFrame, by: list[str]) -> DataFrame:
    """Record-length weighted location, scale and shape of a region; a shape of zero does not count."""
    n = F.col("n").cast("double")
    shaped = F.when(F.col("shape") != 0, n)
    mean = lambda c: F.try_divide(F.sum(F.col(c) * n), F.sum(n)).alias(c)
    shape = F.try_divide(F.sum(F.col("shape") * shaped), F.sum(shaped)).alias("shape")
    aggs = [mean("loc"), mean("scale"), shape, F.sum("n").alias("n")]
    return params.groupBy(*by).agg(*aggs) if by else params.agg(*aggs)


def growth_bounds(replicates: DataFrame, by: list[str], value: str = "q", sig: float = 0.05) -> DataFrame:
    """Bounds over the replicates of one region and period (a fixed number of replicates per group)."""
    return replicates.groupBy(*by).agg(
        F.percentile(value, F.lit(sig / 2)).alias("lower"), F.percentile(value, F.lit(1 - sig / 2)).alias("upper")
    )


def growth_curve(params: DataFrame, rps: list[float], region: str = "region", n_boot: int = 501, draws: int = 100,
                 sig: float = 0.05, dist: str = "GEV", seed: int = 123) -> DataFrame:
    """(region, rp, lower, level, upper): quantile of the regional law and bootstrap bounds.

    Uniforms come from a hash of (seed, region, replicate, draw), so results do not depend on
    partitioning. A region's replicates are ``n_boot`` by ``draws`` numbers, bounded by the call; they are drawn,
    fitted and reduced to their bounds where the region's row lies, so only bounds leave the task.
    """
    from hydrospark.functions.gev import bounds_of
    level = return_levels(params, rps, region)
    kind = params.schema[region].dataType.simpleString()
    rows = params.select(region, F.xxhash64(F.lit(seed), F.col(region)).alias("key"), *[F.col(c).cast("double").alias(c) for c in ("loc", "scale", "shape")])
    # small rows, heavy work: a fixed number of tasks keeps all cores busy where sizes alone would merge them
    rows = rows.repartition(4 * params.sparkSession.sparkContext.defaultParallelism, region)
    bounds = rows.mapInArrow(bounds_of([float(r) for r in rps], n_boot, draws, sig, dist), f"`{region}` {kind}, rp double, lower double, upper double")
    # as many rows as regions and periods: they do not pass through the driver
    return level.join(spread(bounds), [region, "rp"], "left").select(region, "rp", "lower", "level", "upper")


def growth_scale(sites: DataFrame, curves: DataFrame, region: str = "region") -> DataFrame:
    """Growth quantile x index value x area (km2)."""
    j = sites.select("point_id", region, "index_value", "area_ha").join(curves, region)
    f = F.col("index_value") * F.col("area_ha") / 100
    return j.select("point_id", "rp", *[(F.col(c) * f).alias(c) for c in ("lower", "level", "upper")])


def index_pooled(stats: DataFrame) -> Column:
    """Index value of a pool without regions: one site's own, else weighted by record length."""
    return stats.agg(F.try_divide(F.sum(F.col("index_value") * F.col("n")), F.sum("n"))).scalar()
