"""Flood-frequency statistics, regions of influence, at-site and regional pipelines."""

from pyspark.sql import functions as F

from hydrospark.catalog.base import query, r6
from hydrospark.catalog.q_gauges import ANNUAL
from hydrospark.operators import frequency as Q, gauge as G, regions as R
from hydrospark.plans import frequency as P

DESC = ["d1", "d2", "d3", "d4", "d5", "d6"]
RPS = [2, 10, 50, 100]
N_BOOT = 501

ERFC = "((((({a5} * t + {a4}) * t + {a3}) * t + {a2}) * t + {a1}) * t)".format(
    a1="0.254829592e0", a2="-0.284496736e0", a3="1.421413741e0", a4="-1.453152027e0", a5="1.061405429e0")


def erfc(x):
    return f"(SELECT {ERFC} * exp(-({x}) * ({x})) FROM (SELECT 1 / (1 + 0.3275911e0 * abs({x})) AS t))"


MK = f"""{ANNUAL}, pr AS (SELECT a.site, sum(sign(b.flow - a.flow)) AS s FROM am a JOIN am b ON a.site = b.site AND a.yr < b.yr GROUP BY 1),
ti AS (SELECT site, sum(t) AS n, sum(t * (t - 1) / 2.0e0) AS tied, sum(t * (t - 1) * (2 * t + 5)) AS tv FROM (SELECT site, flow, count(*) AS t FROM am GROUP BY 1, 2) GROUP BY 1),
mk AS (SELECT p.site, n, s, n * (n - 1) / 2.0e0 AS pairs, tied, (s - sign(s)) / sqrt((n * (n - 1) * (2 * n + 5) - tv) / 18.0e0) / sqrt(2.0e0) AS z FROM pr p JOIN ti ON ti.site = p.site),
mk2 AS (SELECT *, 1 / (1 + 0.3275911e0 * abs(z)) AS t FROM mk)"""
LMOM = f"""{ANNUAL}, rk AS (SELECT site, flow AS x, row_number() OVER (PARTITION BY site ORDER BY flow, yr) - 1 AS i, count(*) OVER (PARTITION BY site) AS n FROM am),
b AS (SELECT site, n, avg(x) AS b0, avg(x * i / (n - 1)::DOUBLE) AS b1, avg(x * i * (i - 1) / ((n - 1) * (n - 2))::DOUBLE) AS b2 FROM rk GROUP BY 1, 2),
l AS (SELECT site, n, b0 AS l1, 2 * b1 - b0 AS l2, 6 * b2 - 6 * b1 + b0 AS l3 FROM b), c AS (SELECT *, 2 / (3 + l3 / l2) - ln(2e0) / ln(3e0) AS c FROM l),
k AS (SELECT *, 7.8590e0 * c + 2.9554e0 * c * c AS k FROM c), g AS (SELECT *, gamma(1 + k) AS gm FROM k), s AS (SELECT *, l2 * k / ((1 - pow(2e0, -k)) * gm) AS scale FROM g),
gev AS (SELECT site, n, l1 - scale * (1 - gm) / k AS loc, scale, -k AS shape FROM s)"""


def annual(q):
    return G.annual_max(q.series)


@query("mann_kendall", "series", f"{MK} SELECT site, n::BIGINT AS n, s::BIGINT AS s, round(s / (sqrt(pairs - tied) * sqrt(pairs)), 6) AS tau, round({ERFC} * exp(-z * z), 6) AS p_value FROM mk2")
def mann_kendall(q):
    return Q.mann_kendall(annual(q), "flow").select("site", "n", "s", r6("tau"), r6("p_value"))


@query("gev_lmoments", "series", f"{LMOM} SELECT site, n, round(loc, 5) AS loc, round(scale, 5) AS scale, round(shape, 5) AS shape FROM gev")
def gev_lmoments(q):
    return Q.gev_lmoments(annual(q), "flow").select("site", "n", r6("loc", digits=5), r6("scale", digits=5), r6("shape", digits=5))


@query("gev_mle")
def gev_mle(q):
    f = Q.gev_fits(Q.site_arrays(annual(q), "flow"), ["m0"])
    g = Q.gev_fits(Q.site_arrays(annual(q), "flow"), ["m0"], "Gumbel").select("site", F.col("m0.nll").alias("gumbel_nll"))
    return f.join(g, "site").select("site", r6("m0.loc0", "loc", 3), r6(F.exp("m0.lsc0"), "scale", 3), r6("m0.shape", "shape", 3), r6("m0.nll", "nll", 3), r6("gumbel_nll", digits=3))


@query("gev_nonstationary")
def gev_nonstationary(q):
    arrays = Q.site_arrays(Q.minmax_covariate(annual(q), None), "flow")
    f = Q.gev_fits(arrays, ["m0", "m1", "m2"])
    return f.select("site", *[r6(f"{m}.nll", f"nll_{m}", 3) for m in ("m0", "m1", "m2")], r6("m1.loc1", "m1_slope", 2))


NLL = f"""{ANNUAL}, nl AS (SELECT site, count(*) * ln(stddev_samp(flow)) AS n0, (site % 7) * 0.6e0 AS d1, (site % 5) * 0.9e0 AS d2 FROM am GROUP BY 1), nn AS (SELECT site, n0 AS nll0, n0 - d1 AS nll1, n0 - d1 - d2 AS nll2, d1, d2 FROM nl)"""


def nll(q):
    s = annual(q).groupBy("site").agg((F.count(F.lit(1)) * F.ln(F.stddev_samp("flow"))).alias("nll0"))
    s = s.withColumn("nll1", F.col("nll0") - (F.col("site") % 7) * 0.6)
    return s.withColumn("nll2", F.col("nll1") - (F.col("site") % 5) * 0.9)


@query("lr_tests", "series", f"{NLL}, e AS (SELECT site, sqrt(d1) AS a, d1 + d2 AS b, sqrt(d2) AS c FROM nn), u AS (SELECT *, 1 / (1 + 0.3275911e0 * a) AS ta, 1 / (1 + 0.3275911e0 * c) AS tc FROM e) SELECT site, round({ERFC.replace(' t', ' ta').replace('t)', 'ta)')} * exp(-a * a), 5) AS p01, round(exp(-b), 5) AS p02, round({ERFC.replace(' t', ' tc').replace('t)', 'tc)')} * exp(-c * c), 5) AS p12 FROM u")
def lr_tests(q):
    return Q.lr_tests(nll(q)).select("site", r6("p01", digits=5), r6("p02", digits=5), r6("p12", digits=5))


@query("aic_select", "series", f"{NLL} SELECT site, round(6 + 2 * nll0, 5) AS aic0, round(8 + 2 * nll1, 5) AS aic1, round(10 + 2 * nll2, 5) AS aic2, CASE WHEN d1 <= 1 AND d1 + d2 <= 2 THEN 0 WHEN d2 <= 1 THEN 1 ELSE 2 END AS best FROM nn")
def aic_select(q):
    return Q.aic_select(nll(q)).select("site", r6("aic0", digits=5), r6("aic1", digits=5), r6("aic2", digits=5), "best")


EFF = f"""{ANNUAL}, pa AS (SELECT site, avg(flow) AS loc0, (site % 5 - 2) * 1.5e0 AS loc1, ln(stddev_samp(flow)) AS lsc0, (site % 3 - 1) * 0.1e0 AS lsc1, min(yr) AS y0, max(yr) AS y1 FROM am GROUP BY 1),
mx AS (SELECT *, CASE WHEN loc1 > 0 THEN 1e0 ELSE -1e0 END AS cv FROM pa)"""


@query("effective_params", "series", f"{EFF} SELECT site, round(loc0 + loc1 * cv, 5) AS loc, round(exp(lsc0 + lsc1 * cv), 5) AS scale, 0.1e0 AS shape FROM mx")
def effective(q):
    a = annual(q).withColumn("covar", F.col("yr").cast("double"))
    p = a.groupBy("site").agg(F.avg("flow").alias("loc0"), F.ln(F.stddev_samp("flow")).alias("lsc0")).withColumns({
        "loc1": (F.col("site") % 5 - 2) * 1.5, "lsc1": (F.col("site") % 3 - 1) * 0.1, "shape": F.lit(0.1)})
    return Q.effective_params(p, Q.minmax_covariate(a, "covar")).select("site", r6("loc", digits=5), r6("scale", digits=5), "shape")


@query("return_levels", "series", f"{LMOM}, rp AS (SELECT unnest([2, 10, 50, 100]) AS rp) SELECT site, rp::DOUBLE AS rp, round(loc + scale * (pow(-ln(1 - 1e0 / rp), -shape) - 1) / shape, 4) AS level FROM gev, rp")
def levels(q):
    return Q.return_levels(Q.gev_lmoments(annual(q), "flow"), RPS).select("site", "rp", r6("level", digits=4))


@query("return_levels_ci")
def levels_ci(q):
    return Q.return_levels_ci(Q.gev_fits(Q.site_arrays(annual(q), "flow"), ["m0"]), "m0", RPS).select("site", "rp", *[r6(c, digits=2) for c in ("lower", "level", "upper")])


@query("growth_ci", "series", "SELECT site AS region, yr % 3 AS rp, round(quantile_cont(flow, 0.025), 8) AS lower, round(quantile_cont(flow, 0.975), 8) AS upper FROM fx_series GROUP BY 1, 2")
def growth_ci(q):
    s = q.series.select(F.col("site").alias("region"), (F.col("yr") % 3).alias("rp"), F.col("flow").alias("q"))
    return Q.growth_bounds(s, ["region", "rp"]).select("region", "rp", r6("lower", digits=8), r6("upper", digits=8))


@query("weighted_params", "series", f"{LMOM} SELECT site % 6 AS region, sum(n)::BIGINT AS n, round(sum(loc * n) / sum(n), 5) AS loc, round(sum(scale * n) / sum(n), 5) AS scale, round(sum(CASE WHEN site % 4 <> 0 THEN shape * n END) / sum(CASE WHEN site % 4 <> 0 THEN n END), 5) AS shape FROM gev GROUP BY 1")
def weighted(q):
    p = Q.gev_lmoments(annual(q), "flow").withColumns({"region": F.col("site") % 6, "shape": F.when(F.col("site") % 4 != 0, F.col("shape")).otherwise(0.0)})
    return Q.weighted_params(p, ["region"]).select("region", "n", r6("loc", digits=5), r6("scale", digits=5), r6("shape", digits=5))


@query("growth_curve")
def growth(q):
    p = Q.weighted_params(Q.gev_lmoments(annual(q), "flow").withColumn("region", F.col("site") % 6), ["region"])
    return Q.growth_curve(p, RPS, n_boot=N_BOOT).select("region", "rp", *[r6(c, digits=2) for c in ("lower", "level", "upper")])


@query("growth_scale", "series watersheds", f"{LMOM}, ix AS (SELECT site, avg(flow) AS ix FROM am GROUP BY 1), rp AS (SELECT unnest([2, 10, 50, 100]) AS rp), w AS (SELECT point_id, area_ha, point_id % 16 AS site FROM fx_watersheds) SELECT w.point_id, rp::DOUBLE AS rp, round((loc + scale * (pow(-ln(1 - 1e0 / rp), -shape) - 1) / shape) * ix * area_ha / 100, 3) AS level FROM w JOIN gev ON gev.site = w.site JOIN ix ON ix.site = w.site, rp")
def growth_scale(q):
    lv = Q.return_levels(Q.gev_lmoments(annual(q), "flow"), RPS).withColumnRenamed("site", "region").withColumns({"lower": F.col("level"), "upper": F.col("level")})
    ix = Q.index_flood(annual(q), "flow").select(F.col("site").alias("region"), "index_value")
    s = q.watersheds.select("point_id", "area_ha", (F.col("point_id") % 16).alias("region")).join(ix, "region")
    return Q.growth_scale(s, lv).select("point_id", "rp", r6("level", digits=3))


SD = "sd AS (SELECT " + ", ".join(f"stddev_samp({d}) AS s{i}" for i, d in enumerate(DESC)) + " FROM fx_descriptors)"
ROI = f"""{SD}, gg AS (SELECT * FROM fx_descriptors WHERE gws_id IN (SELECT site FROM fx_series)),
dd AS (SELECT u.point_id AS site, g.point_id AS donor, round(sqrt({' + '.join(f'pow((u.{d} - g.{d}) / s{i}, 2)' for i, d in enumerate(DESC))}), 9) AS distance FROM fx_descriptors u, gg g, sd WHERE u.point_id NOT IN (SELECT point_id FROM gg))"""


@query("roi_distance", "descriptors series", f"{ROI} SELECT site, row_number() OVER (PARTITION BY site ORDER BY distance, donor)::INTEGER AS rank, donor FROM dd QUALIFY rank <= 20")
def roi(q):
    gauged, ungauged = R.split_gauged(q.descriptors, q.series.select("site"))
    return R.roi_distance(ungauged, gauged, DESC, 20).select("site", "rank", "donor")


@query("region_pattern", "descriptors", """p AS (SELECT point_id, point_id % 3 AS a, 10 + point_id % 5 AS b FROM fx_descriptors), t AS (SELECT point_id, a || '-' || b AS pattern FROM p), f AS (SELECT pattern, row_number() OVER (ORDER BY min(point_id)) AS k FROM t GROUP BY 1)
SELECT point_id AS site, t.pattern, 'hom_reg' || k AS region FROM t JOIN f ON f.pattern = t.pattern""")
def pattern(q):
    d = q.descriptors.select(F.col("point_id").alias("site"), F.explode(F.array(10 + F.col("point_id") % 5, F.col("point_id") % 3)).alias("donor"))
    return R.region_pattern(d)


def regional(q):
    stats = P.cut(Q.gev_lmoments(annual(q), "flow").join(Q.index_flood(annual(q), "flow").select("site", "index_value"), "site"))
    sites = q.descriptors.withColumn("area_ha", F.col("d1"))
    return P.regional(stats, annual(q), sites, DESC, RPS, n_boot=N_BOOT)


def pools(q, test):
    gauged, _ = R.split_gauged(q.descriptors, q.series.select("site"))
    idx = Q.index_flood(annual(q), "flow")
    own = gauged.select(F.col("gws_id").alias("site"), F.col("point_id").alias("donor"))
    s = annual(q).join(idx, "site").join(own, "site").select("donor", (F.col("flow") / F.col("index_value")).alias("x"))
    return R.homogeneous_pools(q.descriptors, gauged, DESC, s, test=test)


@query("roi_homogeneous")
def homogeneous(q):
    return pools(q, "AD")


@query("roi_homogeneous_hw")
def homogeneous_hw(q):
    """Pools by the heterogeneity of L-moment ratios in place of the Anderson-Darling test."""
    return pools(q, "HW")


@query("regional_flood")
def regional_flood(q):
    return regional(q)["estimates"].select("point_id", "rp", *[r6(c, digits=2) for c in ("lower", "level", "upper")])


@query("site_stats_table")
def site_stats(q):
    return P.at_site(P.annual_series(q.series), non_stationary=True)["stats"].select(
        "site", "n", *[r6(c, digits=4) for c in ("tau", "p_value", "aic0", "aic1", "aic2")], "best_model", *[r6(c, digits=3) for c in ("loc", "scale", "shape", "index_value")])


@query("c5")
def c5(q):
    return P.at_site(P.annual_series(q.series, per_area=True), rps=RPS)["levels"].select("site", "rp", *[r6(c, digits=3) for c in ("lower", "level", "upper")])


@query("c6")
def c6(q):
    """Pooled stream case and rain case beside the regional one."""
    stats = P.at_site(P.annual_series(q.series, per_area=True))["stats"]
    one = P.pooled(stats, q.watersheds, RPS, N_BOOT).select(F.lit("pooled").alias("case"), "point_id", "rp", *[r6(c, digits=2) for c in ("lower", "level", "upper")])
    rain = P.rain_curve(stats, q.watersheds, RPS, N_BOOT).select(F.lit("rain").alias("case"), "point_id", "rp", *[r6(c, digits=2) for c in ("lower", "level", "upper")])
    reg = regional_flood(q).select(F.lit("regional").alias("case"), "*")
    return reg.unionByName(one).unionByName(rain)
