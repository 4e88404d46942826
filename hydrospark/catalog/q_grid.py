"""Cell tables: classes, bins, slopes, alignment, lookups and zonal statistics."""

from pyspark.sql import functions as F

from hydrospark.catalog.base import query, r6
from hydrospark.functions import classes as K, erosion as E
from hydrospark.operators import binning as B, grid as G, lookups as L, zonal as Z
from hydrospark.schema import Grid

GRID = Grid(0.0, 0.0, 10.0, 10.0)
COARSE = Grid(5.0, 5.0, 40.0, 40.0)

NB = """nb AS (SELECT a.*, e.z AS ze, w.z AS zw, n.z AS zn, s.z AS zs FROM fx_cells a LEFT JOIN fx_cells e ON e.r = a.r AND e.c = a.c + 1
  LEFT JOIN fx_cells w ON w.r = a.r AND w.c = a.c - 1 LEFT JOIN fx_cells n ON n.r = a.r - 1 AND n.c = a.c LEFT JOIN fx_cells s ON s.r = a.r + 1 AND s.c = a.c)"""
GRAD = f"""{NB}, gr AS (SELECT *, coalesce((ze - zw) / 20e0, (ze - z) / 10e0, (z - zw) / 10e0) AS gx, coalesce((zs - zn) / 20e0, (zs - z) / 10e0, (z - zn) / 10e0) AS gy FROM nb),
sl AS (SELECT *, sqrt(gx * gx + gy * gy) * 100 AS slope_pct FROM gr)"""
NLCD = "CASE WHEN nlcd <> 250 THEN nlcd END"
CN = "cnw AS (SELECT DISTINCT nlcd, 30 + nlcd % 40 AS base FROM fx_cells WHERE nlcd NOT IN (250, 71)), cnl AS (SELECT nlcd, unnest([1, 2, 3, 4]) AS hsg, base FROM cnw), cnt AS (SELECT nlcd, hsg, base + hsg * 8 AS cn FROM cnl)"


def zone_cells(q):
    return q.cells.select(F.col("ws_id").alias("zone_id"), "r", "c")


def cn_wide(q):
    base = q.cells.select("nlcd").distinct().where(~F.col("nlcd").isin(250, 71)).withColumn("b", 30 + F.col("nlcd") % 40)
    return base.select(F.col("nlcd").cast("string").alias("classes"), *[(F.col("b") + 8 * i).alias(n) for i, n in enumerate("ABCD", start=1)])


@query("load_lookup", "watersheds", """w AS (SELECT point_id, unnest([point_id * 2, point_id * 2 + 1]) AS class, cn_val FROM fx_watersheds)
SELECT class::INTEGER AS class, 'A' AS "column", cn_val::INTEGER AS value FROM w UNION ALL SELECT class::INTEGER, 'B', (cn_val + 8)::INTEGER FROM w WHERE point_id % 5 <> 0""")
def load_lookup(q):
    wide = q.watersheds.select(
        F.concat_ws(", ", F.col("point_id") * 2, F.col("point_id") * 2 + 1).alias("classes"),
        F.col("cn_val").cast("int").alias("A"), F.when(F.col("point_id") % 5 != 0, F.col("cn_val") + 8).cast("int").alias("B"),
    )
    return L.load_lookup(wide, "classes", ["A", "B"])


@query("mask_nodata", "cells", f"SELECT r, c, {NLCD} AS nlcd FROM fx_cells")
def mask_nodata(q):
    return G.mask_nodata(q.cells, ["nlcd"]).select("r", "c", "nlcd")


@query("mask_water", "cells", "SELECT r, c, CASE WHEN nlcd <> 11 THEN nlcd END AS nlcd FROM fx_cells")
def mask_water(q):
    return G.mask_water(q.cells, "nlcd").select("r", "c", "nlcd")


@query("slope_gradient", "cells", f"{GRAD} SELECT r, c, round(slope_pct, 6) AS slope_pct FROM sl")
def slope_gradient(q):
    return G.slope_gradient(q.cells, "z", GRID).select("r", "c", r6("slope_pct"))


@query("slope_central", "cells", f"{NB} SELECT r, c, round(sqrt(((ze - zw) / 20e0) * ((ze - zw) / 20e0) + ((zs - zn) / 20e0) * ((zs - zn) / 20e0)), 6) AS slope FROM nb")
def slope_central(q):
    return G.slope_central(q.cells, "z", GRID).select("r", "c", r6("slope"))


@query("slope_percent_zt", "cells", f"""{NB}, x AS (SELECT *, coalesce(ze, 2 * z - zw) - coalesce(zw, 2 * z - ze) AS dx, coalesce(zn, 2 * z - zs) - coalesce(zs, 2 * z - zn) AS dy FROM nb)
SELECT r, c, round(100 * sqrt((dx / 20e0) * (dx / 20e0) + (dy / 20e0) * (dy / 20e0)), 6) AS slope_pct FROM x""")
def slope_zt(q):
    return G.slope_percent_zt(q.cells, "z", GRID).select("r", "c", r6("slope_pct"))


@query("linear_scale", "cells", "SELECT r, c, round(1 + (z - (SELECT min(z) FROM fx_cells)) / ((SELECT max(z) FROM fx_cells) - (SELECT min(z) FROM fx_cells)) * 4, 6) AS score FROM fx_cells")
def linear_scale(q):
    return B.linear_scale(q.cells, "z", "score").select("r", "c", r6("score"))


@query("softmax_bins", "cells", """d AS (SELECT DISTINCT z FROM fx_cells), g AS (SELECT min(z) AS lo, max(z) AS hi FROM d),
e AS (SELECT z, exp((z - lo) / (hi - lo + 1e-10)) AS e FROM d, g), s AS (SELECT z, sum(e) OVER (ORDER BY z) / sum(e) OVER () AS share FROM e),
t AS (SELECT min(CASE WHEN share >= 0.2e0 THEN z END) AS t1, min(CASE WHEN share >= 0.4e0 THEN z END) AS t2, min(CASE WHEN share >= 0.6e0 THEN z END) AS t3, min(CASE WHEN share >= 0.8e0 THEN z END) AS t4 FROM s)
SELECT r, c, CASE WHEN z <= t1 THEN 1 WHEN z <= t2 THEN 2 WHEN z <= t3 THEN 3 WHEN z <= t4 THEN 4 ELSE 5 END AS class FROM fx_cells, t""")
def softmax_bins(q):
    return B.softmax_bins(q.cells.select("r", "c", "z"), "z", "class").select("r", "c", "class")


MM = "mm AS (SELECT min(z) AS lo, max(z) AS hi FROM fx_cells)"


@query("equal_interval_bins", "cells", f"{MM} SELECT r, c, 1 + " + " + ".join(f"CASE WHEN z >= lo + {k} * ((hi - lo) / 5) THEN 1 ELSE 0 END" for k in range(1, 5)) + " AS class FROM fx_cells, mm")
def equal_bins(q):
    return B.equal_interval_bins(q.cells, "z", "class").select("r", "c", "class")


@query("right_closed_bins", "cells", f"{MM} SELECT r, c, 0 + " + " + ".join(f"CASE WHEN z > lo + {k} * ((hi - lo) / 4) THEN 1 ELSE 0 END" for k in range(0, 4)) + " AS class FROM fx_cells, mm")
def closed_bins(q):
    return B.right_closed_bins(q.cells, "z", "class").select("r", "c", "class")


RC = "CASE WHEN {v} <= {a} THEN 1 WHEN {v} <= {b} THEN 2 WHEN {v} <= {c} THEN 3 WHEN {v} <= {d} THEN 4 WHEN {v} > {d} THEN 5 END"


@query("range_class", "cells", f"SELECT r, c, {RC.format(v='(ndvi_i / 10000.0e0)', a='-0.6e0', b='-0.2e0', c='0.2e0', d='0.6e0')} AS ndvi_class, {RC.format(v='kffact', a='0.13e0', b='0.26e0', c='0.39e0', d='0.52e0')} AS k_class FROM fx_cells")
def range_class(q):
    return q.cells.select("r", "c", K.range_class(E.ndvi_scale(F.col("ndvi_i")), K.NDVI).alias("ndvi_class"), K.soil_class("kwfact", F.col("kffact")).alias("k_class"))


@query("inverse_class", "cells", f"SELECT r, c, 6 - {RC.format(v='(ndvi_i / 100.0e0)', a='1', b='5', c='20', d='50')} AS ksat_class FROM fx_cells")
def inverse_class(q):
    return q.cells.select("r", "c", K.soil_class("ksat_h", F.col("ndvi_i") / 100.0).alias("ksat_class"))


@query("distance_class", "cells", "SELECT r, c, CASE WHEN d <= 30 THEN 5 WHEN d <= 60 THEN 4 WHEN d <= 90 THEN 3 WHEN d <= 120 THEN 2 ELSE 1 END AS class FROM (SELECT r, c, abs(c - 50) * 10 AS d FROM fx_cells)")
def distance_class(q):
    return q.cells.select("r", "c", K.distance_class(F.abs(F.col("c") - 50) * 10).alias("class"))


@query("j8", "cells", f"""{GRAD}, k AS (SELECT r, c, {NLCD} AS nlcd, hsg, CASE WHEN slope_pct < 2 THEN '0_2' WHEN slope_pct < 6 THEN '2_6' ELSE '6' END AS slope_cat FROM sl)
SELECT r, c, slope_cat, CASE WHEN nlcd IS NULL OR nlcd = 71 OR hsg IS NULL THEN NULL ELSE round((nlcd * 10 + hsg * 3 + CASE slope_cat WHEN '0_2' THEN 0 WHEN '2_6' THEN 1 ELSE 2 END) / 1000.0e0, 6) END AS c_runoff FROM k""")
def j8(q):
    return runoff_cells(q).select("r", "c", "slope_cat", r6("c_runoff"))


def runoff_cells(q):
    names = ["0_2", "2_6", "6"]
    base = q.cells.select("nlcd").distinct().where(~F.col("nlcd").isin(250, 71))
    wide = base.select(F.col("nlcd").cast("string").alias("classes"), *[
        ((F.col("nlcd") * 10 + g * 3 + i) / 1000.0).alias(f"c{g}_{n}") for g in range(1, 5) for i, n in enumerate(names)
    ])
    cells = G.mask_nodata(G.slope_gradient(q.cells, "z", GRID), ["nlcd"])
    return L.join_runoff_coefficient(cells, L.runoff_table(wide, "classes"))


@query("slope_class_c", "cells", f"{GRAD} SELECT r, c, CASE WHEN slope_pct < 2 THEN '0_2' WHEN slope_pct < 6 THEN '2_6' ELSE '6' END AS slope_cat FROM sl")
def slope_cat(q):
    return G.slope_gradient(q.cells, "z", GRID).select("r", "c", K.slope_category(F.col("slope_pct")).alias("slope_cat"))


@query("j9", "cells", f"{CN} SELECT x.r, x.c, cnt.cn FROM fx_cells x LEFT JOIN cnt ON x.nlcd = cnt.nlcd AND x.hsg = cnt.hsg")
def j9(q):
    return cn_cells(q).select("r", "c", F.col("cn").cast("bigint").alias("cn"))


def cn_cells(q):
    return L.join_curve_number(q.cells, L.curve_number_table(cn_wide(q), "classes"))


@query("j24", "cells", """co AS (SELECT r, c, round(100 - r * 0.5e0 + c, 4) AS v FROM fx_cells WHERE (r * 7 + c) % 11 <> 0),
t AS (SELECT r, c, ((c + 0.5e0) * 10 - 5) / 40 - 0.5e0 AS fx, ((r + 0.5e0) * 10 - 5) / 40 - 0.5e0 AS fy FROM fx_cells),
k AS (SELECT *, floor(fx) AS c0, floor(fy) AS r0 FROM t), o AS (SELECT 0 AS i, 0 AS j UNION ALL SELECT 0, 1 UNION ALL SELECT 1, 0 UNION ALL SELECT 1, 1),
w AS (SELECT k.r, k.c, (CASE WHEN i = 1 THEN fy - r0 ELSE 1 - (fy - r0) END) * (CASE WHEN j = 1 THEN fx - c0 ELSE 1 - (fx - c0) END) AS wt, co.v FROM k, o JOIN co ON co.r = r0 + i AND co.c = c0 + j),
b AS (SELECT r, c, sum(wt * v) / sum(wt) AS v FROM w WHERE wt > 0 GROUP BY 1, 2)
SELECT t.r, t.c, co.v AS nearest, round(b.v, 6) AS bilinear FROM t LEFT JOIN co ON co.r = floor(((t.r + 0.5e0) * 10 - 5) / 40) AND co.c = floor(((t.c + 0.5e0) * 10 - 5) / 40) LEFT JOIN b ON b.r = t.r AND b.c = t.c""")
def j24(q):
    src = q.cells.where("(r * 7 + c) % 11 <> 0").select("r", "c", F.round(100 - F.col("r") * 0.5 + F.col("c"), 4).alias("v"))
    t = q.cells.select("r", "c")
    near = G.align_nearest(t, GRID, src, COARSE, "v").withColumnRenamed("v", "nearest")
    return G.align_bilinear(near, GRID, src, COARSE, "v").select("r", "c", "nearest", r6("v", "bilinear"))


@query("dedupe_mosaic", "cells", """a AS (SELECT r, c, 1 AS src, z AS v FROM fx_cells WHERE c < 60 UNION ALL SELECT r, c, 2, z + 1 FROM fx_cells WHERE c > 40)
SELECT r, c, v FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY src) AS n FROM a) WHERE n = 1""")
def mosaic(q):
    a = q.cells.where("c < 60").select("r", "c", F.lit(1).alias("src"), F.col("z").alias("v"))
    b = q.cells.where("c > 40").select("r", "c", F.lit(2).alias("src"), (F.col("z") + 1).alias("v"))
    return G.mosaic(a.unionByName(b))


@query("soil_layers", "cells", f"""s AS (SELECT r, c, kffact AS k, ndvi_i / 100.0e0 AS ks, r % 8 AS dr, c % 13 AS tx FROM fx_cells WHERE nlcd <> 250)
SELECT x.r, x.c, {RC.format(v='s.k', a='0.13e0', b='0.26e0', c='0.39e0', d='0.52e0')} AS kwfact, 6 - {RC.format(v='s.ks', a='1', b='5', c='20', d='50')} AS ksat_h,
  CASE s.dr WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 3 WHEN 6 THEN 4 WHEN 7 THEN 5 END AS drainagecl,
  CASE s.tx WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 4 WHEN 4 THEN 4 WHEN 5 THEN 2 WHEN 6 THEN 3 WHEN 7 THEN 2 WHEN 8 THEN 2 WHEN 9 THEN 3 WHEN 10 THEN 1 WHEN 11 THEN 2 WHEN 12 THEN 3 END AS taxorder,
  NULL::INTEGER AS tfact FROM fx_cells x LEFT JOIN s ON s.r = x.r AND s.c = x.c""")
def soil_layers(q):
    from hydrospark.plans.indices import soil_layers as run
    return run(q.cells, soil_table(q), ["kwfact", "ksat_h", "drainagecl", "taxorder", "tfact"])


def soil_table(q):
    """Long soil grid (state, variable, r, c, v), two states that overlap; no grid for tfact."""
    s = q.cells.where("nlcd <> 250")
    vals = F.inline(F.array(*[
        F.struct(F.lit(n).alias("variable"), F.col(e).cast("double").alias("v") if e in s.columns else F.expr(e).cast("double").alias("v"))
        for n, e in (("kwfact", "kffact"), ("ksat_h", "ndvi_i / 100.0"), ("drainagecl", "r % 8"), ("taxorder", "c % 13"))
    ]))
    west = s.where("c < 60").select(F.lit("S1").alias("state"), "r", "c", vals)
    east = s.where("c >= 40").select(F.lit("S2").alias("state"), "r", "c", vals)
    return west.unionByName(east)


@query("template_grid", "cells", """b AS (SELECT r, c FROM fx_cells WHERE c BETWEEN 10 AND 70) SELECT b.r, b.c, x.kffact AS k, NULL::DOUBLE AS absent FROM b LEFT JOIN (SELECT * FROM fx_cells WHERE nlcd <> 250) x ON x.r = b.r AND x.c = b.c""")
def template(q):
    layer = q.cells.where("nlcd <> 250").select("r", "c", F.col("kffact").alias("v"))
    none = q.cells.where(F.lit(False)).select("r", "c", F.col("kffact").alias("v"))
    return G.on_template(q.cells.where("c BETWEEN 10 AND 70"), {"k": layer, "absent": none})


ROCK = "CASE c % 7 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 3 WHEN 4 THEN 2 WHEN 5 THEN 5 WHEN 6 THEN 1 END"
MGMT = "CASE nlcd WHEN 11 THEN 'fallow' WHEN 21 THEN 'urban_open' WHEN 24 THEN 'urban_high' WHEN 41 THEN 'forest_evergreen' WHEN 42 THEN 'forest_deciduous' WHEN 71 THEN 'grassland' WHEN 82 THEN 'cropland' ELSE 'forest_mixed' END"


@query("j27", "cells", f"""SELECT r, c, {ROCK} AS rock_class, {MGMT} AS management, CASE WHEN nlcd IN (41, 42, 250) THEN 'forest' WHEN nlcd = 82 THEN 'crop' WHEN nlcd = 71 THEN 'grass' ELSE 'default' END AS mgmt_group,
  CASE r % 8 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 3 WHEN 6 THEN 4 WHEN 7 THEN 5 END AS drainage,
  CASE c % 13 WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 4 WHEN 4 THEN 4 WHEN 5 THEN 2 WHEN 6 THEN 3 WHEN 7 THEN 2 WHEN 8 THEN 2 WHEN 9 THEN 3 WHEN 10 THEN 1 WHEN 11 THEN 2 WHEN 12 THEN 3 END AS taxorder FROM fx_cells""")
def j27(q):
    names = F.array(*map(F.lit, ["Granite", " SHALE", "Mica Schist", "unknown rock", "Marble", "sand", "chert"]))
    rock = F.element_at(names, (F.col("c") % 7) + 1)
    m = K.management_name(F.when(F.col("nlcd") != 250, F.col("nlcd")))
    return q.cells.select("r", "c", K.rock_class(rock).alias("rock_class"), m.alias("management"), K.management_group(m).alias("mgmt_group"),
                          K.soil_class("drainagecl", F.col("r") % 8).alias("drainage"), K.soil_class("taxorder", F.col("c") % 13).alias("taxorder"))


@query("susceptibility_code", "cells", "SELECT r, c, CASE c % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 6 WHEN 6 THEN 7 ELSE 0 END AS code FROM fx_cells")
def susceptibility(q):
    names = F.array(*map(F.lit, [*K.SUSCEPTIBILITY, "odd"]))
    return q.cells.select("r", "c", L.susceptibility_code(F.element_at(names, F.col("c") % 8 + 1)).alias("code"))


@query("grid_stats", "cells", "SELECT round(min(z), 6) AS z_min, round(max(z), 6) AS z_max, round(avg(z), 6) AS z_mean, count(*) AS n_cells, count(z) AS n_valid FROM fx_cells")
def grid_stats(q):
    return G.grid_stats(q.cells, "z").select(r6("z_min"), r6("z_max"), r6("z_mean"), "n_cells", "n_valid")


@query("coverage_ratio", "cells", "SELECT round(avg(CASE WHEN hsg IS NOT NULL AND c < 95 THEN 1e0 ELSE 0e0 END), 6) AS coverage, avg(CASE WHEN hsg IS NOT NULL AND c < 95 THEN 1e0 ELSE 0e0 END) >= 0.8 AS passes FROM fx_cells")
def coverage(q):
    return G.coverage_ratio(q.cells, q.cells.where("c < 95"), "hsg").select(r6("coverage"), "passes")


@query("pick_resolution", "cells", """a AS (SELECT ws_id AS boundary_id, res, count(CASE WHEN (c * 7 + r) % res <> 0 AND hsg IS NOT NULL THEN 1 END) * 1.0e0 / count(*) >= 0.8 AS ok FROM fx_cells, (SELECT 5 AS res UNION ALL SELECT 13 UNION ALL SELECT 60) GROUP BY 1, 2)
SELECT boundary_id, min(res) AS source FROM a WHERE ok GROUP BY 1""")
def pick_resolution(q):
    cells = q.cells.select(F.col("ws_id").alias("boundary_id"), "r", "c", "hsg", F.explode(F.array(*map(F.lit, (5, 13, 60)))).alias("source"))
    share = F.count_if(((F.col("c") * 7 + F.col("r")) % F.col("source") != 0) & F.col("hsg").isNotNull()) * 1.0 / F.count(F.lit(1))
    avail = cells.groupBy("boundary_id", "source").agg((share >= 0.8).alias("passes")).withColumn("priority", F.col("source"))
    return G.pick_resolution(avail)


# zonal -----------------------------------------------------------------------------------------

@query("zonal_mean", "cells", "SELECT ws_id AS zone_id, round(avg(pi30_milli_in), 6) AS n30p FROM fx_cells GROUP BY 1")
def zonal_mean(q):
    return Z.zonal_mean(zone_cells(q), q.cells.select("r", "c", "pi30_milli_in"), "pi30_milli_in", "n30p").select("zone_id", r6("n30p"))


@query("zonal_terrain", "cells", f"{GRAD} SELECT ws_id AS zone_id, round(avg(z), 6) AS avg_elev_m, round(avg(ln((r + 1 + 1e-6) / (slope_pct / 100 + 1e-6))), 6) AS avg_twi FROM sl GROUP BY 1")
def zonal_terrain(q):
    return Z.zonal_terrain(zone_cells(q), q.cells.withColumn("acc", F.col("r") + 1), GRID).select("zone_id", r6("avg_elev_m"), r6("avg_twi"))


@query("zonal_slope", "cells", f"{GRAD} SELECT ws_id AS zone_id, round(avg(slope_pct), 6) AS avg_slope_pct FROM sl GROUP BY 1")
def zonal_slope(q):
    return Z.zonal_slope(zone_cells(q), q.cells, GRID).select("zone_id", r6("avg_slope_pct"))


@query("zonal_sum", "cells", "SELECT ws_id AS zone_id, round(sum(kffact), 6) AS total FROM fx_cells GROUP BY 1")
def zonal_sum(q):
    return Z.zonal_sum(zone_cells(q), q.cells.select("r", "c", "kffact"), "kffact", "total").select("zone_id", r6("total"))


@query("zonal_erosion", "cells", "SELECT ws_id AS zone_id, round(avg(kffact) * CASE WHEN ws_id % 2 = 0 THEN 7.5e0 ELSE count(*) * 100 / 10000.0e0 END, 6) AS erosion FROM fx_cells GROUP BY ws_id")
def zonal_erosion(q):
    zones = q.cells.select(F.col("ws_id").alias("zone_id")).distinct().withColumn("area_ha", F.when(F.col("zone_id") % 2 == 0, 7.5))
    return Z.zonal_erosion(zone_cells(q), q.cells, zones, GRID.cell_area, "kffact").select("zone_id", r6("erosion"))


@query("zonal_runoff_c", "cells", f"""{GRAD}, k AS (SELECT ws_id, CASE WHEN nlcd IN (250, 71) OR hsg IS NULL THEN NULL ELSE (nlcd * 10 + hsg * 3 + CASE WHEN slope_pct < 2 THEN 0 WHEN slope_pct < 6 THEN 1 ELSE 2 END) / 1000.0e0 END AS cr FROM sl)
SELECT ws_id AS zone_id, round(avg(cr), 6) AS c_runoff FROM k GROUP BY 1""")
def zonal_runoff_c(q):
    return Z.zonal_mean(zone_cells(q), runoff_cells(q).select("r", "c", "c_runoff"), "c_runoff", "c_runoff").select("zone_id", r6("c_runoff"))


@query("zonal_cn", "cells", f"{CN}, j AS (SELECT DISTINCT ws_id, cn FROM fx_cells x JOIN cnt ON x.nlcd = cnt.nlcd AND x.hsg = cnt.hsg) SELECT ws_id AS zone_id, ceil(avg(cn))::BIGINT AS cn_val FROM j GROUP BY 1")
def zonal_cn(q):
    return Z.zonal_distinct_cn(zone_cells(q), cn_cells(q))


@query("zonal_mode", "cells", """n AS (SELECT ws_id, nlcd, count(*) AS k FROM fx_cells WHERE nlcd <> 250 GROUP BY 1, 2)
SELECT ws_id AS zone_id, nlcd AS nlcd_mode FROM (SELECT *, row_number() OVER (PARTITION BY ws_id ORDER BY k DESC, nlcd) AS rn FROM n) WHERE rn = 1""")
def zonal_mode(q):
    cells = q.cells.where("nlcd <> 250")
    return Z.zonal_mode(zone_cells(q), cells, "nlcd", "nlcd_mode", 43)


SOIL = "so AS (SELECT ws_id AS zone_id, CAST(floor(r / 9.0e0) AS INT) * 12 + CAST(floor(c / 9.0e0) AS INT) AS piece_id FROM fx_cells), sn AS (SELECT zone_id, piece_id, CASE piece_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 4 END AS h, count(*) AS n FROM so GROUP BY 1, 2)"


@query("dominant_soil", "cells", f"""{SOIL}, a AS (SELECT zone_id, max_by(h, n * 100000 - piece_id) AS hsg_n FROM sn GROUP BY 1), t AS (SELECT zone_id, h, sum(n) AS n FROM sn GROUP BY 1, 2), b AS (SELECT zone_id, max_by(h, n * 100 - h) AS hsg_total FROM t GROUP BY 1)
SELECT a.zone_id, a.hsg_n::BIGINT AS hsg_n, b.hsg_total::BIGINT AS hsg_total FROM a JOIN b ON a.zone_id = b.zone_id""")
def dominant_soil(q):
    piece = F.floor(F.col("r") / 9).cast("int") * 12 + F.floor(F.col("c") / 9).cast("int")
    soil = q.cells.select("r", "c", piece.alias("piece_id")).withColumn("hsg", F.element_at(F.array(*map(F.lit, ("A", "B", "C", "D", "B/D"))), F.col("piece_id") % 5 + 1))
    total = Z.dominant_soil(zone_cells(q), soil, "total").withColumnRenamed("hsg_n", "hsg_total")
    return Z.dominant_soil(zone_cells(q), soil).join(total, "zone_id")


@query("wetland_area", "cells", "SELECT ws_id AS zone_id, round(count(CASE WHEN nlcd = 11 AND c < 50 THEN 1 END) * 0.01e0, 6) AS wet_a_ha FROM fx_cells GROUP BY 1")
def wetland_area(q):
    wet = q.cells.where("nlcd = 11 AND c < 50")
    return Z.wetland_area(zone_cells(q), wet.unionByName(wet.where("r % 2 = 0")), GRID.cell_area).select("zone_id", r6("wet_a_ha"))


@query("area_from_cells", "cells", "SELECT ws_id AS zone_id, count(*) * 100.0e0 AS area_m2, round(count(*) * 0.01e0, 6) AS area_ha, round(count(*) * 0.0001e0, 6) AS area_km2 FROM fx_cells GROUP BY 1")
def zone_area(q):
    return Z.zone_area(zone_cells(q), GRID.cell_area).select("zone_id", "area_m2", r6("area_ha"), r6("area_km2"))


@query("dissolve", "hillslope", "SELECT watershed_id, min_by(hillslope_id, hillslope_id) AS hillslope_id, min_by(area_ha, hillslope_id) AS area_ha FROM fx_hillslope GROUP BY 1")
def dissolve(q):
    return Z.dissolve(q.hillslope, "watershed_id", "hillslope_id", ["hillslope_id", "area_ha"])


@query("erosion_profile", "cells", """SELECT round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(median(v), 6) AS median,
  round(count(CASE WHEN v > 5 THEN 1 END) * 100.0e0 / count(v), 6) AS pct_over, round(count(v) * 100.0e0 / count(*), 6) AS pct_valid FROM (SELECT CASE WHEN hsg IS NOT NULL THEN kffact * 12 END AS v FROM fx_cells)""")
def erosion_profile(q):
    rate = q.cells.select("r", "c", F.when(F.col("hsg").isNotNull(), F.col("kffact") * 12).alias("soil_loss"))
    return Z.erosion_profile(rate).select(*[r6(c) for c in ("min", "max", "mean", "sd", "median", "pct_over", "pct_valid")])


SCORE = "rk AS (SELECT point_id, area_ha, row_number() OVER (ORDER BY area_ha, point_id) AS k, count(*) OVER () AS n FROM fx_watersheds), sc AS (SELECT point_id, 5.0e0 * (k - 1) / (n - 1) AS score FROM rk)"


@query("rank_score", "watersheds", f"{SCORE} SELECT point_id, round(score, 6) AS score FROM sc")
def rank_score(q):
    return B.rank_score(q.watersheds.select("point_id", "area_ha"), "area_ha", "point_id").select("point_id", r6("score"))


@query("score_category", "watersheds", f"{SCORE} SELECT point_id, CASE WHEN score < 1 THEN 'Very Low' WHEN score < 2 THEN 'Low' WHEN score < 3 THEN 'Moderate' WHEN score < 4 THEN 'High' ELSE 'Very High' END AS category FROM sc")
def score_category(q):
    return B.rank_score(q.watersheds.select("point_id", "area_ha"), "area_ha", "point_id").select("point_id", K.score_category(F.col("score")).alias("category"))
