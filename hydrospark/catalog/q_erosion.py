"""Soil loss, weighted indices and hillslope roll-ups."""

from pyspark.sql import functions as F

from hydrospark.catalog.base import query, r6
from hydrospark.catalog.q_grid import GRID, NB, zone_cells
from hydrospark.catalog.q_spatial import SEGC, small_roads
from hydrospark.functions import erosion as E
from hydrospark.operators import binning as B, rollup as U, spatial as S
from hydrospark.plans import indices as I, soil_loss as L
from hydrospark.session import cut

# accumulation stand-in: cells above in the same column
RF = "(CASE WHEN pi30_milli_in * 0.0508e0 <= 76 THEN 0.119e0 + 0.0873e0 * log10(pi30_milli_in * 0.0508e0) ELSE 0.283e0 END * (pi30_milli_in * 0.0508e0))"
FAC = f"""{NB}, sc AS (SELECT *, sqrt(((ze - zw) / 20e0) * ((ze - zw) / 20e0) + ((zs - zn) / 20e0) * ((zs - zn) / 20e0)) AS slope, r % 40 AS acc FROM nb),
fa AS (SELECT *, {RF} AS rf, CASE WHEN slope IS NULL THEN NULL ELSE (CASE WHEN acc > 0 THEN pow(acc * 10 / 22.13e0, CASE WHEN slope * 100 < 1 THEN 0.2e0 WHEN slope * 100 < 3 THEN 0.3e0 WHEN slope * 100 < 5 THEN 0.4e0 ELSE 0.5e0 END) ELSE 1e0 END)
  * (65.41e0 * sin(atan(slope)) * sin(atan(slope)) + 4.56e0 * sin(atan(slope)) + 0.065e0) END AS lsf,
  CASE WHEN ndvi_i / 10000.0e0 >= 1 THEN 0.01e0 ELSE least(greatest(exp(-2e0 * (ndvi_i / 10000.0e0) / (1 - ndvi_i / 10000.0e0)), 0e0), 1e0) END AS cf FROM sc),
lo AS (SELECT *, rf * (kffact * 0.1317e0) * lsf * cf AS a FROM fa)"""
SCORED = """tz AS (SELECT zone_id, v, count(v) OVER () AS n, CASE WHEN v IS NOT NULL THEN row_number() OVER (ORDER BY v NULLS LAST, zone_id) END AS k FROM zz),
sz AS (SELECT zone_id, v, 5.0e0 * (k - 1) / (n - 1) AS score FROM tz)"""
CAT = "CASE WHEN score IS NULL THEN 'No Data' WHEN score < 1 THEN 'Very Low' WHEN score < 2 THEN 'Low' WHEN score < 3 THEN 'Moderate' WHEN score < 4 THEN 'High' ELSE 'Very High' END"


def factors(q):
    return L.factor_layers(q.cells.withColumn("acc", F.col("r") % 40), GRID)


@query("r_factor", "cells", f"SELECT r, c, round({RF}, 6) AS r_factor FROM fx_cells")
def r_factor(q):
    return q.cells.select("r", "c", r6(E.r_factor(F.col("pi30_milli_in")), "r_factor"))


@query("ls_factor", "cells", f"{FAC} SELECT r, c, round(lsf, 6) AS ls_factor FROM fa")
def ls_factor(q):
    return factors(q).select("r", "c", r6("ls_factor"))


@query("ndvi_scale", "cells", "SELECT r, c, round(ndvi_i / 10000.0e0, 6) AS ndvi FROM fx_cells")
def ndvi(q):
    return q.cells.select("r", "c", r6(E.ndvi_scale(F.col("ndvi_i")), "ndvi"))


@query("c_factor", "cells", f"{FAC} SELECT r, c, round(cf, 6) AS c_factor FROM fa")
def c_factor(q):
    return q.cells.select("r", "c", r6(E.c_factor(E.ndvi_scale(F.col("ndvi_i"))), "c_factor"))


@query("soil_loss", "cells", f"{FAC} SELECT r, c, round(a, 6) AS soil_loss FROM lo")
def soil_loss(q):
    f = cut(factors(q))
    layers = {f"{k}_factor": f.select("r", "c", F.col(f"{k}_factor").alias("v")) for k in ("r", "k", "ls", "c")}
    return L.soil_loss_cells(L.join_layers(layers)).select("r", "c", r6("soil_loss"))


@query("c8", "cells", f"{FAC}, zz AS (SELECT ws_id AS zone_id, avg(a) * count(*) * 0.01e0 AS v FROM lo GROUP BY 1), {SCORED} SELECT zone_id, round(v, 5) AS erosion, round(score, 6) AS score, {CAT} AS category FROM sz")
def c8(q):
    zones = q.cells.select(F.col("ws_id").alias("zone_id")).distinct().withColumn("area_ha", F.lit(None).cast("double"))
    out = L.soil_loss_watersheds(L.soil_loss_cells(factors(q)), zone_cells(q), zones, GRID)
    return out.select("zone_id", r6("erosion", digits=5), r6("score"), "category")


# ten and fifteen layers from the cell table, named in order, with gaps
def layer_exprs(n):
    return [f"CASE WHEN (r + c * {i + 2}) % {i + 7} = 0 THEN NULL ELSE 1 + (r * {i + 1} + c * {i + 3}) % 5 END" for i in range(n)]


def weights(names):
    return {n: round(0.02 + 0.01 * i, 2) for i, n in enumerate(names)}


def overlay_sql(names):
    w = weights(names)
    return ("ov0 AS (SELECT r, c, ws_id, " + ", ".join(f"{e} AS l{i}" for i, e in enumerate(layer_exprs(len(names)))) + " FROM fx_cells), ov AS (SELECT r, c, ws_id, "
            + " + ".join(f"coalesce(l{i} * {w[n]}e0, 0)" for i, n in enumerate(names)) + " AS s, " + " OR ".join(f"l{i} IS NOT NULL" for i in range(len(names))) + " AS ok FROM ov0)")


def layers(q, names):
    wide = q.cells.select("r", "c", *[F.expr(e).alias(n) for n, e in zip(names, layer_exprs(len(names)))])
    return wide


@query("weighted_overlay_10", "cells roads", f"{overlay_sql(I.STREAMBANK_LAYERS)}, {SEGC} SELECT ov.r, ov.c, round(s, 6) AS score_sum FROM ov JOIN nc ON nc.r = ov.r AND nc.c = ov.c AND nc.d <= 20 WHERE ok")
def overlay10(q):
    near = S.near_line_cells(small_roads(q), GRID, 20.0)
    return I.weighted_overlay(layers(q, I.STREAMBANK_LAYERS).join(near.select("r", "c"), ["r", "c"], "left_semi"), weights(I.STREAMBANK_LAYERS)).select("r", "c", r6("score_sum"))


@query("weighted_overlay_15", "cells", f"{overlay_sql(I.DEBRIS_LAYERS)} SELECT r, c, round(s, 6) AS score_sum FROM ov WHERE ok")
def overlay15(q):
    return I.weighted_overlay(layers(q, I.DEBRIS_LAYERS), weights(I.DEBRIS_LAYERS)).select("r", "c", r6("score_sum"))


def zones(q):
    return q.cells.select(F.col("ws_id").alias("zone_id")).distinct()


@query("c9", "cells roads", f"{overlay_sql(I.STREAMBANK_LAYERS)}, {SEGC}, zv AS (SELECT ws_id, round(sum(s), 6) AS v FROM ov JOIN nc ON nc.r = ov.r AND nc.c = ov.c AND nc.d <= 20 WHERE ok GROUP BY 1), zz AS (SELECT z.ws_id AS zone_id, v FROM (SELECT DISTINCT ws_id FROM fx_cells) z LEFT JOIN zv ON zv.ws_id = z.ws_id), {SCORED} SELECT zone_id, round(v, 4) AS total, round(score, 6) AS score, {CAT} AS category FROM sz")
def c9(q):
    near = S.near_line_cells(small_roads(q), GRID, 20.0)
    out = I.streambank_index(layers(q, I.STREAMBANK_LAYERS), weights(I.STREAMBANK_LAYERS), near, zone_cells(q), zones(q))
    return out.select("zone_id", r6("total", digits=4), r6("score"), "category")


@query("c10", "cells", f"{overlay_sql(I.DEBRIS_LAYERS)}, zz AS (SELECT ws_id AS zone_id, round(sum(s), 6) AS v FROM ov WHERE ok GROUP BY 1), {SCORED} SELECT zone_id, round(v, 4) AS total, round(score, 6) AS score, {CAT} AS category FROM sz")
def c10(q):
    out = I.debris_flow_index(layers(q, I.DEBRIS_LAYERS), weights(I.DEBRIS_LAYERS), zone_cells(q), zones(q))
    return out.select("zone_id", r6("total", digits=4), r6("score"), "category")


SOILJ = "sj AS (SELECT h.cokey, h.chkey, coalesce(h.kffact, (h.silt * 0.3e0 + h.clay * 0.2e0) / 100) AS k, h.clay, h.sand, c.mukey, c.comppct, t.texdesc FROM fx_horizon h JOIN fx_component c ON c.cokey = h.cokey LEFT JOIN fx_texture t ON t.chkey = h.chkey)"
SOILM = f"""{SOILJ}, sm AS (SELECT mukey, sum((k * comppct)::DECIMAL(28,9))::DOUBLE / sum((CASE WHEN k IS NOT NULL THEN comppct END)::DECIMAL(28,9))::DOUBLE + 1e-9 AS kffact, sum((clay * comppct)::DECIMAL(28,9))::DOUBLE / sum((CASE WHEN clay IS NOT NULL THEN comppct END)::DECIMAL(28,9))::DOUBLE + 1e-9 AS clay, sum((sand * comppct)::DECIMAL(28,9))::DOUBLE / sum((CASE WHEN sand IS NOT NULL THEN comppct END)::DECIMAL(28,9))::DOUBLE + 1e-9 AS sand FROM sj GROUP BY 1),
tn AS (SELECT mukey, texdesc, count(*) AS n FROM sj WHERE texdesc IS NOT NULL GROUP BY 1, 2), tm AS (SELECT mukey, texdesc FROM (SELECT *, row_number() OVER (PARTITION BY mukey ORDER BY n DESC, texdesc) AS k FROM tn) WHERE k = 1)"""


def soil_joined(q):
    return U.join_soil_tables(U.horizon_kffact(q.horizon), q.component, q.texture)


@query("j10", "horizon component texture mapunit", f"{SOILJ} SELECT mukey, count(*) AS n, round(sum(k), 4) AS k, count(texdesc) AS n_tex FROM sj GROUP BY 1")
def j10(q):
    return soil_joined(q).groupBy("mukey").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("kffact"), "k", 4), F.count("texdesc").alias("n_tex"))


@query("soil_by_mapunit", "horizon component texture mapunit", f"{SOILM} SELECT m.poly_id, m.mukey, round(kffact, 6) AS kffact, round(clay, 6) AS clay, round(sand, 6) AS sand, coalesce(texdesc, 'loam') AS texdesc FROM fx_mapunit m JOIN sm ON sm.mukey = m.mukey LEFT JOIN tm ON tm.mukey = m.mukey")
def soil_by_mapunit(q):
    return U.soil_polygons(q.mapunit, U.soil_by_mapunit(soil_joined(q))).select("poly_id", "mukey", *[r6(F.col(c) + 1e-9, c) for c in ("kffact", "clay", "sand")], "texdesc")


SP = "s AS (SELECT cokey, chkey, coalesce(kffact, 0.20e0) AS k, clay AS cl FROM fx_horizon)"


@query("soil_params", "horizon", f"{SP} SELECT chkey, round(k * 2728000, 4) AS ki, round(0.00197e0 + 0.00030e0 * 15 + 0.03863e0 * exp(-3.68e0), 6) AS kr, round(2.67e0 + 0.065e0 * 20 - 0.058e0 * 15, 6) AS critical_shear, round(CASE WHEN cl <= 40 THEN -0.265e0 + 0.0086e0 * pow(15e0, 1.8e0) + 11.46e0 * pow(10e0, -0.75e0) ELSE 0.0066e0 * exp(244e0 / cl) END, 6) AS conductivity FROM s")
def soil_params(q):
    return U.with_soil_params(q.horizon).select("chkey", r6("ki", digits=4), r6("kr"), r6("critical_shear"), r6("conductivity"))


@query("scan_climate", "climate", "SELECT point, year, yday, strftime(make_date(year, 1, 1) + (yday - 1) * INTERVAL 1 DAY, '%Y-%m-%d') AS d, month(make_date(year, 1, 1) + (yday - 1) * INTERVAL 1 DAY) AS month, prcp FROM fx_climate")
def scan_climate(q):
    return U.with_dates(q.climate).select("point", "year", "yday", F.date_format("d", "yyyy-MM-dd").alias("d"), F.month("d").cast("bigint").alias("month"), "prcp")


def half_up(total: str, n: str, digits: int) -> str:
    """Mean of a positive total in billionths, rounded half up in whole numbers as the other engine rounds."""
    unit = 10 ** (9 - digits)
    return f"((2 * ({total}) + ({n}) * {unit}) // (2 * ({n}) * {unit}))::DOUBLE / 1e{digits}"


MONTHS = f"""m AS (SELECT point, month(make_date(year, 1, 1) + (yday - 1) * INTERVAL 1 DAY)::INTEGER AS month, prcp, tmax, tmin, srad, round(prcp * 1e6)::HUGEINT AS x FROM fx_climate),
w AS (SELECT point, month, count(prcp)::DOUBLE AS n, sum(x)::DOUBLE AS s1, sum(x * x)::DOUBLE AS s2, sum(x * x * x)::DOUBLE AS s3, {half_up('sum((prcp * 1e9)::HUGEINT)', 'count(prcp)', 5)} AS pm,
  avg(CASE WHEN prcp > 0 THEN 1e0 ELSE 0e0 END) AS wet, {half_up('sum((tmax * 1e9)::HUGEINT)', 'count(tmax)', 6)} AS tx, {half_up('sum((tmin * 1e9)::HUGEINT)', 'count(tmin)', 6)} AS tn,
  {half_up('sum((srad * 1e9)::HUGEINT) * 2064', 'count(srad) * 1000', 6)} AS sr FROM m GROUP BY 1, 2),
v AS (SELECT *, n * s2 - s1 * s1 AS d, s3 - 3 * s1 * s2 / n + 2 * s1 * s1 * s1 / (n * n) AS t FROM w)
SELECT point, month, pm AS prcp_mean, round(CASE WHEN n > 1 THEN sqrt(greatest(d, 0e0) / (n * (n - 1))) / 1e6 ELSE 0.1e0 END, 6) AS prcp_sd,
  round(CASE WHEN n > 2 AND d > 0 THEN t / n / pow(d / (n * n), 1.5e0) * sqrt(n * (n - 1)) / (n - 2) ELSE 0e0 END, 5) AS prcp_skew, round(wet, 6) AS p_wet_dry,
  round(least(1e0, wet * 1.5e0), 6) AS p_wet_wet, tx AS tmax_mean, tn AS tmin_mean, sr AS sol_rad FROM v"""


@query("monthly_climate", "climate", MONTHS)
def monthly(q):
    m = U.monthly_climate(U.with_dates(q.climate))
    return m.select("point", "month", r6("prcp_mean", digits=5), r6("prcp_sd"), r6("prcp_skew", digits=5), r6("p_wet_dry"), r6("p_wet_wet"), *[r6(c) for c in ("tmax_mean", "tmin_mean", "sol_rad")])


@query("hillslope_slope", "cells", """m AS (SELECT ws_id, avg(c) AS mx, avg(r) AS my, avg(z) AS mz, max(z) AS zx, min(z) AS zn FROM fx_cells GROUP BY 1),
s AS (SELECT x.ws_id, sum((c - mx) * (c - mx)) AS sxx, sum((r - my) * (r - my)) AS syy, sum((c - mx) * (r - my)) AS sxy, sum((c - mx) * (z - mz)) AS sxz, sum((r - my) * (z - mz)) AS syz FROM fx_cells x JOIN m ON m.ws_id = x.ws_id GROUP BY 1),
b AS (SELECT m.ws_id, zx, zn, (sxz * syy - syz * sxy) / (sxx * syy - sxy * sxy) AS bx, (syz * sxx - sxz * sxy) / (sxx * syy - sxy * sxy) AS by_ FROM m JOIN s ON s.ws_id = m.ws_id)
SELECT ws_id AS hillslope_id, round(least(greatest((zx - zn) / (100.0e0 + ws_id), 0.001e0), 1e0), 6) AS slope, round(CASE WHEN degrees(atan2(by_, bx)) < 0 THEN degrees(atan2(by_, bx)) + 360 ELSE degrees(atan2(by_, bx)) END, 5) AS aspect_deg FROM b""")
def hillslope_slope(q):
    cells = q.cells.select(F.col("ws_id").alias("hillslope_id"), "r", "c", "z")
    lengths = cells.select("hillslope_id").distinct().withColumn("length_m", 100.0 + F.col("hillslope_id"))
    return U.hillslope_slope(cells, lengths).select("hillslope_id", r6("slope"), r6("aspect_deg", digits=5))


@query("hillslope_rollup", "hillslope", "SELECT watershed_id, round(avg(runoff_mm), 6) AS runoff_mm, round(avg(precipitation_mm), 6) AS precipitation_mm, round(avg(soil_loss_kg_m2), 6) AS soil_loss_kg_m2, round(sum(sediment_yield_kg), 4) AS sediment_yield_kg, count(*) AS hillslope_count FROM fx_hillslope GROUP BY 1")
def rollup(q):
    return U.hillslope_rollup(q.hillslope).select("watershed_id", r6("runoff_mm"), r6("precipitation_mm"), r6("soil_loss_kg_m2"), r6("sediment_yield_kg", digits=4), "hillslope_count")


CH = "ch AS (SELECT channel_id, sum(runoff_mm) * 0.9e0 AS ro, sum(coalesce(sediment_yield_kg, 0)) * 0.8e0 AS sed, max(runoff_mm) * 0.05e0 AS pk FROM fx_hillslope GROUP BY 1)"


@query("channel_accumulate", "hillslope", f"{CH} SELECT channel_id, round(ro, 6) AS channel_runoff_mm, round(sed, 6) AS channel_sediment_kg, round(pk, 6) AS peak_flow_m3s FROM ch")
def channels(q):
    return U.channel_accumulate(q.hillslope).select("channel_id", r6("channel_runoff_mm"), r6("channel_sediment_kg"), r6("peak_flow_m3s"))


@query("channel_network", "hillslope", f"{CH} SELECT count(*) AS channels, round(avg(ro), 6) AS avg_runoff_mm, round(sum(sed), 4) AS total_sediment_kg, round(max(pk), 6) AS max_peak_flow_m3s FROM ch")
def network(q):
    return U.channel_network(U.channel_accumulate(q.hillslope)).select("channels", r6("avg_runoff_mm"), r6("total_sediment_kg", digits=4), r6("max_peak_flow_m3s"))


BUD = """h AS (SELECT area_ha AS a, precipitation_mm AS p, runoff_mm AS ro, soil_loss_kg_m2 AS sl, coalesce(sediment_yield_kg, 0) AS sy FROM fx_hillslope), b AS (SELECT sum(a) AS ta, sum(p * a) / sum(a) AS ap, sum(ro * a) / sum(a) AS ar, sum(sl * a * 10000) AS tl, sum(sy) AS ts FROM h)"""


@query("watershed_budget", "hillslope", f"{CH}, {BUD}, t AS (SELECT sum(sed) AS cs FROM ch) SELECT round(ta, 4) AS total_area_ha, round(ap, 6) AS avg_precipitation_mm, round(ar, 6) AS avg_runoff_mm, round(tl, 2) AS total_soil_loss_kg, round(ts, 2) AS total_hillslope_sediment_kg, round(cs, 2) AS total_channel_sediment_kg, round(ts + cs, 2) AS watershed_sediment_yield_kg, round(tl / (ta * 10000), 6) AS avg_soil_loss_kg_m2, round(ts / tl, 6) AS sediment_delivery_ratio FROM b, t")
def budget(q):
    b = U.watershed_budget(q.hillslope, U.channel_accumulate(q.hillslope))
    return b.select(r6("total_area_ha", digits=4), r6("avg_precipitation_mm"), r6("avg_runoff_mm"), r6("total_soil_loss_kg", digits=2), r6("total_hillslope_sediment_kg", digits=2),
                    r6("total_channel_sediment_kg", digits=2), r6("watershed_sediment_yield_kg", digits=2), r6("avg_soil_loss_kg_m2"), r6("sediment_delivery_ratio"))


@query("c11", "hillslope", f"""{CH}, ro AS (SELECT watershed_id, avg(runoff_mm) AS ro, avg(precipitation_mm) AS p, avg(soil_loss_kg_m2) AS sl, sum(sediment_yield_kg) AS sy, count(*) AS n FROM fx_hillslope GROUP BY 1),
pk AS (SELECT h.watershed_id, max(ch.pk) AS pk FROM fx_hillslope h JOIN ch ON ch.channel_id = h.channel_id GROUP BY 1)
SELECT ro.watershed_id, round(ro, 6) AS runoff_mm, round(p, 6) AS precipitation_mm, round(sl, 6) AS soil_loss_kg_m2, round(sy, 4) AS sediment_yield_kg, n AS hillslope_count, round(pk, 6) AS peak_flow_m3s FROM ro JOIN pk ON pk.watershed_id = ro.watershed_id""")
def c11(q):
    from hydrospark.plans.hillslopes import hillslope_budget
    out = hillslope_budget(q.hillslope)["watersheds"]
    return out.select("watershed_id", r6("runoff_mm"), r6("precipitation_mm"), r6("soil_loss_kg_m2"), r6("sediment_yield_kg", digits=4), "hillslope_count", r6("peak_flow_m3s"))
