"""Stand-in inputs as projections of the driver's tables; one SQL text for both engines.

``{name}`` marks a source table. Literals carry ``e0`` so both engines read doubles.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "fx_culverts": """
SELECT p_partkey AS point_id,
  CASE p_partkey % 7 WHEN 0 THEN 'Circular' WHEN 1 THEN 'Box' WHEN 2 THEN 'pipe_arch' WHEN 3 THEN 'Oval' WHEN 4 THEN 'Arch' WHEN 5 THEN 'NA' ELSE 'trapezoid' END AS pour_sha,
  CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE 1 + p_size / 10.0e0 END AS width_ft,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 1 + (p_size % 7) * 0.5e0 END AS height_ft,
  CASE p_partkey % 5 WHEN 0 THEN 'Concrete' WHEN 1 THEN 'Steel' WHEN 2 THEN 'HDPE' WHEN 3 THEN 'CMP' ELSE 'NA' END AS material,
  CASE p_partkey % 4 WHEN 0 THEN 'Good' WHEN 1 THEN 'Fair' WHEN 2 THEN 'Poor' ELSE NULL END AS cond,
  CASE p_partkey % 6 WHEN 0 THEN 'Square_Edge' WHEN 1 THEN 'Grooved_End' WHEN 2 THEN 'Beveled' WHEN 3 THEN 'Projecting' WHEN 4 THEN 'Mitered' ELSE NULL END AS inlet_type,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 1 + p_partkey % 3 END AS grp_size,
  (1 + p_size % 20) / 1000.0e0 AS culvert_sl,
  CAST(p_partkey % 50 AS DOUBLE) * 100 AS x_m, CAST(floor(p_partkey / 50.0e0) AS DOUBLE) * 100 AS y_m
FROM {part}""",
    "fx_watersheds": """
SELECT p_partkey AS point_id, 2 + (p_size * p_size) % 900 + p_partkey % 10 * 0.37e0 AS area_ha,
  0.5e0 + p_size % 25 AS avg_sl, 100.0e0 + p_partkey % 4000 AS ch_len_m, 50.0e0 + p_partkey % 900 AS ov_len_m,
  55 + p_size % 40 AS cn_val, (p_size % 9) * 0.3e0 AS wet_a_ha, 0.1e0 + (p_size % 8) * 0.1e0 AS c_runoff,
  CASE p_partkey % 5 WHEN 0 THEN 'I' WHEN 1 THEN 'IA' WHEN 2 THEN 'II' WHEN 3 THEN 'III' ELSE NULL END AS rain_type
FROM {part}""",
    "fx_series": """
SELECT o_custkey % 40 AS site, 1950 + o_orderkey % 60 AS yr, o_orderkey AS obs_id,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 0.0e0 ELSE o_totalprice / 1000.0e0 END AS flow,
  5.0e0 + o_custkey % 40 AS area_km2 FROM {orders}""",
    "fx_gauge": """
SELECT user_id % 10 AS site, date_trunc('hour', ts) AS hr, round(sum(value), 4) AS flow,
  round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) / 50.0e0, 6) AS pi_cm_hr, 2.0e0 + user_id % 10 AS area_km2
FROM {events} GROUP BY user_id % 10, date_trunc('hour', ts)""",
    "fx_cells": """
SELECT CAST(floor(o_orderkey / 100.0e0) AS INT) AS r, CAST(o_orderkey % 100 AS INT) AS c,
  round(200 - 0.6e0 * floor(o_orderkey / 100.0e0) + 0.25e0 * abs(o_orderkey % 100 - 50) + (o_custkey % 7) * 0.02e0, 4) AS z,
  round(200 - 0.6e0 * floor(o_orderkey / 100.0e0) + 0.25e0 * abs(o_orderkey % 100 - 50) + (o_custkey % 7) * 0.02e0 - CASE WHEN (o_orderkey * 7) % 29 = 0 THEN 1e0 ELSE 0e0 END, 4) AS z_pit,
  CASE o_custkey % 8 WHEN 0 THEN 11 WHEN 1 THEN 21 WHEN 2 THEN 24 WHEN 3 THEN 41 WHEN 4 THEN 42 WHEN 5 THEN 71 WHEN 6 THEN 82 ELSE 250 END AS nlcd,
  CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE 1 + o_custkey % 4 END AS hsg,
  (o_orderkey * 37) % 20000 - 10000 AS ndvi_i, 500 + (o_orderkey * 13) % 3000 AS pi30_milli_in,
  round(0.05e0 + (o_custkey % 50) * 0.01e0, 4) AS kffact,
  CAST(floor(o_orderkey / 2500.0e0) * 4 + floor((o_orderkey % 100) / 25.0e0) AS INT) AS ws_id FROM {orders}""",
    # one polygon per supplier, six vertices, in metres of a 10 m grid
    "fx_rings": """
SELECT s.s_suppkey AS zone_id, 0 AS ring_id, v.k AS seq,
  ((s.s_suppkey * 17) % 90 + 5) * 10.0e0 + 0.3e0 + (3 + s.s_suppkey % 7) * v.fx AS x,
  ((s.s_suppkey * 29) % 12 + 1) * 10.0e0 + floor(s.s_suppkey / 12.0e0) * 100.0e0 + 0.7e0 + (3 + s.s_suppkey % 7) * v.fy AS y
FROM {supplier} s JOIN (SELECT 0 AS k, 10.0e0 AS fx, 0.0e0 AS fy UNION ALL SELECT 1, 5.0e0, 8.0e0 UNION ALL SELECT 2, -5.0e0, 8.0e0
  UNION ALL SELECT 3, -10.0e0, 0.0e0 UNION ALL SELECT 4, -5.0e0, -8.0e0 UNION ALL SELECT 5, 5.0e0, -8.0e0) v ON v.k >= 0""",
    # roads run along rows of fifty crossings, streams across them
    "fx_roads": """
SELECT CAST(floor(p_partkey / 50.0e0) AS BIGINT) AS feature_id, CAST(p_partkey % 50 AS INT) AS seq,
  (p_partkey % 50) * 100.0e0 AS x1, floor(p_partkey / 50.0e0) * 100.0e0 + ((p_partkey * 7) % 5) * 6.0e0 AS y1,
  (p_partkey % 50) * 100.0e0 + 100.0e0 AS x2, floor(p_partkey / 50.0e0) * 100.0e0 + (((p_partkey + 1) * 7) % 5) * 6.0e0 AS y2
FROM {part}""",
    "fx_streams": """
SELECT c_custkey % 50 AS feature_id, CAST(floor(c_custkey / 50.0e0) AS INT) AS seq,
  (c_custkey % 50) * 100.0e0 + 37.0e0 + ((c_custkey * 3) % 4) * 5.0e0 AS x1, floor(c_custkey / 50.0e0) * 100.0e0 + 51.0e0 AS y1,
  (c_custkey % 50) * 100.0e0 + 37.0e0 + (((c_custkey + 50) * 3) % 4) * 5.0e0 AS x2, floor(c_custkey / 50.0e0) * 100.0e0 + 151.0e0 AS y2
FROM {customer}""",
    "fx_points": """
SELECT p_partkey AS point_id, (p_partkey % 50) * 100.0e0 + (p_partkey % 13) * 1.7e0 AS x,
  floor(p_partkey / 50.0e0) * 100.0e0 + (p_partkey % 11) * 3.3e0 AS y FROM {part}""",
    "fx_gauges": """
SELECT s_suppkey AS gauge_id, (s_suppkey % 50) * 100.0e0 + (s_suppkey % 9) * 4.0e0 AS x,
  floor(s_suppkey / 50.0e0) * 100.0e0 + (s_suppkey % 7) * 5.0e0 AS y, round(s_acctbal, 2) AS gauge_value FROM {supplier}""",
    "fx_climate": """
SELECT o_custkey % 25 AS point, CAST(2000 + floor((o_orderkey % 730) / 365.0e0) AS INT) AS year, CAST(1 + (o_orderkey % 730) % 365 AS INT) AS yday,
  round(avg(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 10000.0e0 ELSE 0.0e0 END), 9) AS prcp,
  round(avg(15.0e0 + o_orderkey % 17), 9) AS tmax, round(avg(3.0e0 + o_orderkey % 11), 9) AS tmin, round(avg(120.0e0 + o_custkey % 90), 9) AS srad
FROM {orders} GROUP BY o_custkey % 25, o_orderkey % 730""",
    "fx_horizon": """
SELECT l_partkey AS cokey, l_orderkey * 10 + l_linenumber AS chkey, CASE WHEN l_orderkey % 19 = 0 THEN NULL ELSE round(0.05e0 + l_discount * 4, 6) END AS kffact,
  5.0e0 + l_quantity AS clay, 10.0e0 + (l_partkey % 60) AS sand, 20.0e0 + l_linenumber * 4 AS silt FROM {lineitem}""",
    "fx_component": "SELECT p_partkey AS cokey, p_partkey % 200 AS mukey, 5 + p_size AS comppct FROM {part}",
    "fx_texture": """
SELECT l_orderkey * 10 + l_linenumber AS chkey,
  CASE WHEN l_suppkey % 6 = 0 THEN NULL WHEN l_suppkey % 6 = 1 THEN 'clay' WHEN l_suppkey % 6 = 2 THEN 'sand' WHEN l_suppkey % 6 = 3 THEN 'silt loam' ELSE 'sandy loam' END AS texdesc
FROM {lineitem}""",
    "fx_mapunit": "SELECT c_custkey AS poly_id, c_custkey % 230 AS mukey FROM {customer}",
    "fx_hillslope": """
SELECT p_partkey AS hillslope_id, p_partkey % 40 AS watershed_id, p_partkey % 90 AS channel_id, 1 + p_size * 0.5e0 AS area_ha,
  700.0e0 + p_size * 10 AS precipitation_mm, 20.0e0 + p_partkey % 130 AS runoff_mm, (p_size % 11) * 0.013e0 AS soil_loss_kg_m2,
  CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE (p_size % 17) * 12.5e0 END AS sediment_yield_kg FROM {part}""",
    "fx_descriptors": """
SELECT p_partkey AS point_id, CASE WHEN p_partkey % 40 = 0 THEN CAST(floor(p_partkey / 40.0e0) AS BIGINT) ELSE NULL END AS gws_id,
  2 + (p_size * p_size) % 900 + p_partkey % 10 * 0.37e0 AS d1, 0.5e0 + p_size % 25 + (p_partkey % 7) * 0.11e0 AS d2, 100.0e0 + (p_partkey * 13) % 4000 AS d3,
  50.0e0 + (p_partkey * 7) % 900 AS d4, (p_partkey % 50) * 1.0e0 AS d5, floor(p_partkey / 50.0e0) AS d6 FROM {part}""",
}

# Five durations by seven return periods per nation; written with explode so neither engine needs a cross join.
PIDF_SPARK = """
SELECT station, dur_min, rp, round((0.4e0 + station * 0.02e0) * ln(rp + 1.0e0) * 60.0e0 / (dur_min + 10.0e0), 4) AS est
FROM (SELECT n_nationkey AS station, explode(array(5, 15, 60, 360, 1440)) AS dur_min FROM {nation})
LATERAL VIEW explode(array(2, 5, 10, 25, 50, 100, 1000)) t AS rp"""
PIDF_SQL = """
SELECT station, dur_min, rp, round((0.4e0 + station * 0.02e0) * ln(rp + 1.0e0) * 60.0e0 / (dur_min + 10.0e0), 4) AS est
FROM (SELECT station, dur_min, unnest([2, 5, 10, 25, 50, 100, 1000]) AS rp
      FROM (SELECT n_nationkey AS station, unnest([5, 15, 60, 360, 1440]) AS dur_min FROM nation))"""

RINGS_SPARK = """
SELECT s_suppkey AS zone_id, 0 AS ring_id, v.k AS seq,
  ((s_suppkey * 17) % 90 + 5) * 10.0e0 + 0.3e0 + (3 + s_suppkey % 7) * v.fx AS x,
  ((s_suppkey * 29) % 12 + 1) * 10.0e0 + floor(s_suppkey / 12.0e0) * 100.0e0 + 0.7e0 + (3 + s_suppkey % 7) * v.fy AS y
FROM {supplier} LATERAL VIEW explode(array(
  named_struct('k', 0, 'fx', 10.0e0, 'fy', 0.0e0), named_struct('k', 1, 'fx', 5.0e0, 'fy', 8.0e0),
  named_struct('k', 2, 'fx', -5.0e0, 'fy', 8.0e0), named_struct('k', 3, 'fx', -10.0e0, 'fy', 0.0e0),
  named_struct('k', 4, 'fx', -5.0e0, 'fy', -8.0e0), named_struct('k', 5, 'fx', 5.0e0, 'fy', -8.0e0))) t AS v"""

SPARK_TEXT = {"fx_pidf": PIDF_SPARK, "fx_rings": RINGS_SPARK}
DUCK_TEXT = {"fx_pidf": PIDF_SQL}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = SPARK_TEXT.get(name) or SQL[name]
    sources = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in sources})


def with_fixtures(names: list[str], body: str) -> str:
    """Oracle text: the named fixtures as common table expressions in front of ``body``.

    ``body`` starts with further ``name AS (...)`` expressions or with SELECT.
    """
    ctes = [f"{n} AS ({re.sub(r'[{}]', '', DUCK_TEXT.get(n) or SQL[n])})" for n in names]
    body = body.strip()
    joiner = "\n" if body.upper().startswith("SELECT") else ",\n"
    return "WITH RECURSIVE " + ",\n".join(ctes) + joiner + body
