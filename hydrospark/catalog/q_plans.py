"""Delineation and watershed characteristics, end to end."""

from pyspark.sql import functions as F

from hydrospark.catalog.base import query, r6
from hydrospark.catalog.q_grid import CN, GRAD, GRID, SOIL, cn_wide, zone_cells
from hydrospark.catalog.q_spatial import small_roads
from hydrospark.operators import lookups as L
from hydrospark.plans import characteristics as C, delineation as D

COLS = ["point_id", "level", "child_count", "is_nested"]
NUM = ["area_ha", "incremental_area_km2", "incremental_area_pct", "avg_sl", "ch_len_m", "ov_len_m", "tov_min", "tch_min", "tc_min"]


def small(df, *keep):
    return df.select(*keep, (F.col("x") * 0.2).alias("x"), (F.col("y") * 0.2).alias("y"))


def run(q, **kw):
    out = D.delineate(q.cells.select("r", "c", "z"), GRID, small_roads(q), threshold=10.0, min_area_ha=0.05, raise_m=0.3, burn_m=1.0,
                      boundary_cells=q.cells.where("c BETWEEN 3 AND 97"), **kw)
    kept = out["watersheds"].withColumn("flagged", F.lit(False)).unionByName(out["flagged"].withColumn("flagged", F.lit(True)))
    return kept.select(*COLS, "flagged", *[r6(c, digits=4) for c in NUM])


@query("c1")
def c1(q):
    return run(q, points=small(q.points, "point_id"))


@query("c1_found_points")
def c1_found(q):
    return run(q)


@query("c1_gauges")
def c1_gauges(q):
    return run(q, gauges=small(q.gauges, "gauge_id"), hydro_enforce=False, snap_m=60.0)


HS = "CASE piece_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 4 END"


@query("c2", "cells", f"""{GRAD}, {SOIL}, {CN}, te AS (SELECT ws_id AS zone_id, avg(z) AS el, avg(ln((r + 1 + 1e-6) / (slope_pct / 100 + 1e-6))) AS twi, avg(pi30_milli_in) AS rain, count(*) AS n,
  count(CASE WHEN nlcd = 11 AND c < 50 THEN 1 END) AS wet FROM sl GROUP BY 1),
a AS (SELECT zone_id, max_by(h, n * 100000 - piece_id) AS hsg_n FROM sn GROUP BY 1),
x AS (SELECT ws_id, nlcd, {HS} AS hs FROM (SELECT ws_id, nlcd, CAST(floor(r / 9.0e0) AS INT) * 12 + CAST(floor(c / 9.0e0) AS INT) AS piece_id FROM fx_cells)),
cn AS (SELECT ws_id AS zone_id, ceil(avg(cn))::BIGINT AS cn_val FROM (SELECT DISTINCT x.ws_id, t.cn FROM x JOIN cnt t ON t.nlcd = x.nlcd AND t.hsg = x.hs) GROUP BY 1)
SELECT te.zone_id, 'ST' || te.zone_id AS gws_id, round(el, 6) AS avg_elev_m, round(twi, 6) AS avg_twi, round(rain, 6) AS n30p_rin, a.hsg_n::BIGINT AS hsg_n, cn.cn_val, round(wet * 0.01e0, 6) AS wet_a_ha, round(te.n * 0.01e0, 6) AS area_ha
FROM te JOIN a ON a.zone_id = te.zone_id JOIN cn ON cn.zone_id = te.zone_id""")
def c2(q):
    piece = F.floor(F.col("r") / 9).cast("int") * 12 + F.floor(F.col("c") / 9).cast("int")
    soil = q.cells.select("r", "c", piece.alias("piece_id")).withColumn("hsg", F.element_at(F.array(*map(F.lit, ("A", "B", "C", "D", "B/D"))), F.col("piece_id") % 5 + 1))
    zones = q.cells.select(F.col("ws_id").alias("zone_id")).distinct()
    named = C.name_gauged(zones.withColumns({"station_key": F.col("zone_id"), "flag_gst": F.lit(1), "gws_id": F.lit(None).cast("string")}),
                          zones.select(F.col("zone_id").alias("station_key"), F.concat(F.lit("ST"), F.col("zone_id")).alias("station_name")))
    out = C.watershed_characteristics(named.select("zone_id", "gws_id"), zone_cells(q), q.cells.select("r", "c", "z", "nlcd").withColumn("acc", F.col("r") + 1),
                                      q.cells.select("r", "c", F.col("pi30_milli_in").alias("v")), soil, L.curve_number_table(cn_wide(q), "classes"), q.cells.where("nlcd = 11 AND c < 50"), GRID)
    return out.select("zone_id", "gws_id", r6("avg_elev_m"), r6("avg_twi"), r6("n30p_rin"), "hsg_n", "cn_val", r6("wet_a_ha"), r6("area_ha"))
