"""Sources and sinks: tables are written to a run folder of the shared directory and read back."""

import uuid

from pyspark.sql import functions as F

from hydrospark.catalog.base import query, r6
from hydrospark.functions.peakflow import RETURN_PERIODS
from hydrospark.session import shared_dir
from hydrospark.sources import readers as R, sinks as W, text_ingest as X


def run_dir(q):
    return f"{shared_dir(q.spark)}/run-{uuid.uuid4().hex}"


@query("scan_features", "points", "SELECT point_id, x, y FROM fx_points WHERE x BETWEEN 500 AND 2500 AND y BETWEEN 200 AND 90000")
def scan_features(q):
    path = run_dir(q)
    q.points.repartitionByRange("x").write.parquet(path)
    return R.scan_features(q.spark, path, "point_id BIGINT, x DOUBLE, y DOUBLE", (500.0, 200.0, 2500.0, 90000.0))


@query("scan_grid", "cells", "SELECT r, c, z AS v FROM fx_cells WHERE r BETWEEN 20 AND 900 AND c BETWEEN 30 AND 80")
def scan_grid(q):
    path = run_dir(q)
    W.write_grid(q.cells.select("r", "c", F.col("z").alias("v")), path, 64)
    return R.scan_grid(q.spark, path, (20, 30, 900, 80), 64).select("r", "c", "v")


@query("scan_series", "series", "SELECT 'full' AS series_type, 'stream' AS var, 'S' || site AS site, yr::BIGINT AS year, count(*) AS n, count(flow) AS n_flow, round(sum(flow), 6) AS flow FROM fx_series GROUP BY site, yr")
def scan_series(q):
    path = run_dir(q)
    s = q.series.select(
        F.concat(F.lit("full_stream_series_S"), F.col("site")).alias("name"), F.col("yr").alias("Year"), F.lit(1).alias("Month"), F.lit(1).alias("Day"),
        F.lit(0).alias("Hr"), F.lit(0).alias("Min"), F.col("flow").alias("Flow"), F.lit(None).cast("double").alias("PI"), F.col("area_km2").alias("Area_km2"), F.lit(None).cast("double").alias("Covar"),
    )
    W.write_per_site(s.fillna({"Flow": float("nan")}).withColumn("Flow", F.when(~F.isnan("Flow"), F.col("Flow"))), path, "name")
    df = R.scan_series(q.spark, path)
    return df.groupBy("series_type", "var", "site", F.col("Year").cast("bigint").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.count("Flow").alias("n_flow"), r6(F.sum("Flow"), "flow"))


# Duration names in table order, minutes beside them.
DURATIONS = [("5-min", 5), ("10-min", 10), ("15-min", 15), ("30-min", 30), ("60-min", 60), ("2-hr", 120), ("3-hr", 180), ("6-hr", 360), ("12-hr", 720), ("24-hr", 1440),
             ("2-day", 2880), ("3-day", 4320), ("4-day", 5760), ("7-day", 10080), ("10-day", 14400), ("20-day", 28800), ("30-day", 43200), ("45-day", 64800), ("60-day", 86400)]


def pidf_lines(q):
    """Frequency text of 77 lines per supplier, values a function of supplier, block, duration and period."""
    rows = [(14, None, "by duration for AEP:, " + ",".join(f"1/{p}" for p in RETURN_PERIODS))]
    for f, (_, a, _) in zip((1.0, 1.2, 0.8), X.BLOCKS):
        rows += [(a + i, f * m, f"{d}:") for i, (d, m) in enumerate(DURATIONS)]
    rows += [(n, None, "Precipitation frequency text") for n in (*range(1, 14), 34, 35, 36, 56, 57, 58)]
    lines = F.inline(F.array(*[F.struct(F.lit(n).cast("bigint").alias("line_no"), F.lit(m).cast("double").alias("m"), F.lit(t).alias("t")) for n, m, t in rows]))
    s = q.spark.read.parquet(f"{q.sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("file"), "s_suppkey", lines)
    vals = F.concat_ws(",", *[F.round(F.col("m") / 100 + F.col("s_suppkey") + i, 4).cast("string") for i in range(len(RETURN_PERIODS))])
    return s.select("file", "line_no", F.when(F.col("m").isNotNull(), F.concat(F.col("t"), F.lit(", ,"), vals)).otherwise(F.col("t")).alias("line"))


@query("ingest_pidf_text", "gauges", "dd AS (SELECT unnest([" + ", ".join(f"{{'n': '{n}', 'm': {m}}}" for n, m in DURATIONS) + "]) AS d), pp AS (SELECT unnest([" + ", ".join(f"{{'i': {i}, 'rp': {p}}}" for i, p in enumerate(RETURN_PERIODS)) + """]) AS ps),
bb AS (SELECT unnest([{'b': 'E', 'f': 1.0e0}, {'b': 'U', 'f': 1.2e0}, {'b': 'L', 'f': 0.8e0}]) AS bs) SELECT gauge_id::VARCHAR AS file, bs.b AS bound, d.n AS duration, d.m::DOUBLE AS dur_min, ps.rp AS rp, round(bs.f * d.m / 100 + gauge_id + ps.i, 4) AS v FROM fx_gauges, dd, pp, bb""")
def pidf_text(q):
    lines = pidf_lines(q).withColumn("line", F.regexp_replace("line", ", ,", ","))
    return X.frequency_tables(lines).withColumn("v", r6("v", digits=4))


@query("ingest_ascii_grid", "cells", """w AS (SELECT ws_id, r, c, CASE WHEN hsg IS NOT NULL THEN z END AS v, floor(r / 25.0e0) AS br, floor(c / 25.0e0) AS bc FROM fx_cells),
f AS (SELECT ws_id, (max(r) + 1) * 10.0e0 AS top FROM fx_cells GROUP BY 1)
SELECT w.ws_id::VARCHAR AS file, (c + 0.5e0) * 10 AS x, (r + 0.5e0) * 10 AS y, v FROM w JOIN f ON f.ws_id = w.ws_id WHERE bc * 250 <= 100 + 50""")
def ascii_grid(q):
    cells = q.cells.select("ws_id", "r", "c", F.when(F.col("hsg").isNotNull(), F.col("z")).otherwise(-9999.0).alias("v"))
    rows = cells.groupBy("ws_id", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda s: s["v"].cast("string")), " ").alias("line"))
    box = cells.groupBy("ws_id").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"))
    head = box.select("ws_id", F.posexplode(F.array(
        F.lit("ncols 25"), F.concat(F.lit("nrows "), F.col("r1") - F.col("r0") + 1), F.concat(F.lit("xllcorner "), F.col("c0") * 10.0),
        F.concat(F.lit("yllcorner "), F.col("r0") * 10.0), F.lit("cellsize 10"), F.lit("NODATA_value -9999"),
    )).alias("line_no", "line"))
    body = rows.join(box, "ws_id").select("ws_id", (6 + F.col("r1") - F.col("r")).alias("line_no"), "line")
    path = run_dir(q)
    W.write_text(head.unionByName(body).withColumnRenamed("ws_id", "name"), path)
    lines = R.read_lines(q.spark, path).withColumn("file", F.regexp_extract("file", r"name=(\d+)", 1))
    return X.ascii_grids(lines, (0.0, 0.0, 100.0, 1e9), 50.0).select("file", r6("x"), r6("y"), "v")


def summary_lines(q):
    """Simulator summary text per hillslope."""
    h = q.hillslope.select(
        F.col("hillslope_id").cast("string").alias("file"), "hillslope_id", "precipitation_mm", "runoff_mm", "soil_loss_kg_m2",
        F.coalesce("sediment_yield_kg", F.lit(0.0)).alias("sy"),
    )
    year = lambda y, f: F.concat_ws("  ", F.lit(str(y)), (F.col("precipitation_mm") * f).cast("string"), (F.col("runoff_mm") * f).cast("string"), F.col("soil_loss_kg_m2").cast("string"))
    text = F.array(
        F.lit("SUMMARY"), F.lit("PRECIPITATION : 1.0 not yet"), F.lit("ANNUAL SUMMARY"), F.lit("YEAR P R S"), year(2001, 0.5), year(2002, 2.0), F.lit("3 too short"),
        F.lit("AVERAGE ANNUAL TOTALS"), F.concat(F.lit("PRECIPITATION : "), F.col("precipitation_mm"), F.lit(" mm")), F.concat(F.lit("RUNOFF: "), F.col("runoff_mm"), F.lit(" mm")),
        F.concat(F.lit("SOIL LOSS :"), F.col("soil_loss_kg_m2"), F.lit(" kg/m2")), F.concat(F.lit("SEDIMENT YIELD: "), F.col("sy") / 1000, F.lit(" t")),
    )
    return h.select("file", F.posexplode(text).alias("k", "line")).select("file", (F.col("k") + 1).cast("bigint").alias("line_no"), "line")


@query("ingest_sim_summary", "hillslope", "SELECT hillslope_id::VARCHAR AS file, round(precipitation_mm, 4) AS precipitation_mm, round(runoff_mm, 4) AS runoff_mm, round(soil_loss_kg_m2, 6) AS soil_loss_kg_m2, round(coalesce(sediment_yield_kg, 0), 4) AS sediment_yield_kg FROM fx_hillslope")
def sim_summary(q):
    return X.simulator_averages(summary_lines(q)).select("file", r6("precipitation_mm", digits=4), r6("runoff_mm", digits=4), r6("soil_loss_kg_m2"), r6("sediment_yield_kg", digits=4))


@query("ingest_sim_years", "hillslope", "SELECT hillslope_id::VARCHAR AS file, y.y AS year, round(precipitation_mm * y.f, 4) AS precipitation_mm, round(runoff_mm * y.f, 4) AS runoff_mm, round(soil_loss_kg_m2, 6) AS soil_loss_kg_m2 FROM fx_hillslope, (SELECT unnest([{'y': 2001, 'f': 0.5e0}, {'y': 2002, 'f': 2.0e0}]) AS y)")
def sim_years(q):
    return X.simulator_years(summary_lines(q)).select("file", "year", r6("precipitation_mm", digits=4), r6("runoff_mm", digits=4), r6("soil_loss_kg_m2"))


@query("write_tables", "watersheds points", "SELECT 'watersheds' AS name, count(*) AS n FROM fx_watersheds UNION ALL SELECT 'points', count(*) FROM fx_points")
def write_tables(q):
    path = run_dir(q)
    W.write_tables({"watersheds": q.watersheds, "points": q.points.withColumn("band", (F.col("point_id") % 4).cast("int"))}, path, partition_by={"points": ["band"]})
    n = lambda t: q.spark.read.parquet(f"{path}/{t}").agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n"))
    return n("watersheds").unionByName(n("points"))


@query("write_per_site", "series", "SELECT site::INTEGER AS site, count(*) AS n, round(sum(area_km2), 3) AS area FROM fx_series GROUP BY 1")
def write_per_site(q):
    path = run_dir(q)
    W.write_per_site(q.series, path)
    df = q.spark.read.option("header", True).schema("yr BIGINT, obs_id BIGINT, flow DOUBLE, area_km2 DOUBLE, site INT").csv(path)
    return df.groupBy("site").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("area_km2"), "area", 3))
