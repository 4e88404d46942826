"""Gauge series: cleaning, storm onsets, runoff coefficients, annual maxima."""

from pyspark.sql import functions as F

from hydrospark.catalog.base import query, r6
from hydrospark.operators import cleaning as C, gauge as G
from hydrospark.operators.frequency import minmax_covariate

RUNS = """d AS (SELECT site, hr, flow, pi_cm_hr, area_km2, coalesce(pi_cm_hr, 0) = 0 AS is_dry FROM fx_gauge),
l AS (SELECT *, CASE WHEN lag(is_dry) OVER w IS DISTINCT FROM is_dry THEN 1 ELSE 0 END AS starts FROM d WINDOW w AS (PARTITION BY site ORDER BY hr)),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY site ORDER BY hr) AS run_id, date_diff('day', DATE '1970-01-01', hr::DATE) * 24 + hour(hr) AS hour_no FROM l),
len AS (SELECT site, run_id + 1 AS run_id, count(*) AS dry_rows FROM runs WHERE is_dry GROUP BY site, run_id),
ons AS (SELECT r.*, len.dry_rows FROM runs r JOIN len ON r.site = len.site AND r.run_id = len.run_id WHERE NOT is_dry AND starts = 1 AND dry_rows >= 7)"""
TOP = """kk AS (SELECT site, CASE WHEN count(*) < {n} THEN floor(0.3 * count(*)) ELSE {n} END AS k FROM fx_gauge GROUP BY site),
ranked AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY flow DESC, hr) AS event_rank FROM ons WHERE flow IS NOT NULL),
top AS (SELECT ranked.*, flow / area_km2 * 0.143e0 / (pi_cm_hr / 2.54e0) AS c_event FROM ranked JOIN kk ON ranked.site = kk.site WHERE event_rank <= k)"""
ANNUAL = """am AS (SELECT site, yr, obs_id, flow, area_km2 FROM (SELECT *, row_number() OVER (PARTITION BY site, yr ORDER BY flow DESC, obs_id) AS rn FROM fx_series WHERE flow IS NOT NULL) WHERE rn = 1 AND flow <> 0)"""


def series(q):
    return q.gauge.select("site", F.col("hr").alias("ts"), "flow", F.col("pi_cm_hr").alias("pi"), "area_km2")


def hour_no(c="ts"):
    return (G.clock_seconds(c) / 3600).cast("bigint").alias("hour_no")


def split_series(q):
    """The hourly table as separate flow and rain tables with calendar keys."""
    keys = [F.year("hr").alias("Year"), F.month("hr").alias("Month"), F.dayofmonth("hr").alias("Day"),
            F.when(F.hour("hr") > 0, F.hour("hr")).alias("Hr"), F.lit(None).cast("int").alias("Min")]
    flow = q.gauge.select("site", *keys, F.col("flow").alias("Flow"))
    rain = q.gauge.where(F.col("pi_cm_hr") > 0).select("site", *keys, F.col("pi_cm_hr").alias("PI"))
    return flow, rain


@query("j3", "gauge", "SELECT site, year(hr) AS \"Year\", month(hr) AS \"Month\", day(hr) AS \"Day\", hour(hr) AS \"Hr\", 0::BIGINT AS \"Min\", round(flow, 4) AS \"Flow\", CASE WHEN pi_cm_hr > 0 THEN round(pi_cm_hr, 4) END AS \"PI\" FROM fx_gauge")
def j3(q):
    flow, rain = split_series(q)
    out = G.join_flow_rain(flow, rain)
    keys = [F.col(c).cast("bigint").alias(c) for c in G.TIME_KEYS]
    return out.select("site", *keys, r6("Flow", digits=4), r6("PI", digits=4))


@query("wet_dry_runs", "gauge", f"{RUNS} SELECT site, hour_no, is_dry, run_id::BIGINT AS run_id FROM runs")
def wet_dry_runs(q):
    return G.wet_dry_runs(series(q)).select("site", hour_no(), "is_dry", "run_id")


@query("storm_onset", "gauge", f"{RUNS} SELECT site, hour_no, dry_rows, round(flow, 4) AS flow FROM ons")
def storm_onset(q):
    return G.storm_onsets(G.wet_dry_runs(series(q))).select("site", hour_no(), "dry_rows", r6("flow", digits=4))


def top(q, n):
    rows = series(q).groupBy("site").agg(F.count(F.lit(1)).alias("n_rows"))
    return G.event_coefficients(G.top_events(G.storm_onsets(G.wet_dry_runs(series(q))), rows, top_n=n, ref_compat=True))


@query("top_events", "gauge", f"{RUNS}, {TOP.format(n=5)} SELECT site, hour_no, event_rank, round(flow, 4) AS flow FROM top")
def top_events(q):
    return top(q, 5).select("site", hour_no(), F.col("event_rank").cast("bigint").alias("event_rank"), r6("flow", digits=4))


@query("event_c", "gauge", f"{RUNS}, {TOP.format(n=10000)} SELECT site, hour_no, round(c_event, 5) AS c_event FROM top")
def event_c(q):
    return top(q, 10_000).select("site", hour_no(), r6("c_event", digits=5))


@query("runoff_c_mean", "gauge", f"{RUNS}, {TOP.format(n=10000)} SELECT round(avg(c_event), 5) AS c_runoff FROM top")
def runoff_c_mean(q):
    return G.mean_runoff_c(top(q, 10_000)).select(r6("c_runoff", digits=5))


@query("station_runoff_c", "gauge", f"{RUNS}, {TOP.format(n=10000)}, s AS (SELECT DISTINCT site FROM fx_gauge) SELECT s.site, round(avg(c_event), 5) AS c_runoff FROM s LEFT JOIN top ON s.site = top.site GROUP BY s.site")
def station_runoff_c(q):
    return G.station_runoff_c(series(q), top_n=10_000, ref_compat=True).select("site", r6("c_runoff", digits=5))


@query("j26", "gauge descriptors", f"""{RUNS}, {TOP.format(n=10000)}, st AS (SELECT site, avg(c_event) AS c FROM top GROUP BY site),
own AS (SELECT d.point_id, st.c FROM fx_descriptors d LEFT JOIN st ON d.gws_id = st.site)
SELECT o.point_id, round(coalesce(o.c, dn.c), 5) AS c_runoff FROM own o LEFT JOIN own dn ON dn.point_id = (o.point_id % 10) * 40""")
def j26(q):
    roi = q.descriptors.select(F.col("point_id").alias("site"), F.lit(1).alias("rank"), ((F.col("point_id") % 10) * 40).alias("donor"))
    return G.donor_runoff_c(q.descriptors, G.station_runoff_c(series(q), top_n=10_000, ref_compat=True), roi).select("point_id", r6("c_runoff", digits=5))


@query("annual_max", "series", f"{ANNUAL} SELECT site, yr, obs_id, round(flow, 6) AS flow, round(flow / area_km2, 9) AS flow_per_area FROM am")
def annual_max(q):
    return G.annual_max(q.series).select("site", "yr", "obs_id", r6("flow"), r6(F.col("flow") / F.col("area_km2"), "flow_per_area", 9))


@query("annual_max_ties", "series", """s AS (SELECT site, yr, obs_id, floor(flow / 50) AS flow FROM fx_series WHERE flow IS NOT NULL),
m AS (SELECT site, yr, max(flow) AS top FROM s GROUP BY 1, 2) SELECT s.site, s.yr, s.obs_id, round(s.flow, 6) AS flow FROM s JOIN m ON s.site = m.site AND s.yr = m.yr WHERE s.flow = m.top AND s.flow <> 0""")
def annual_max_ties(q):
    s = q.series.withColumn("flow", F.floor(F.col("flow") / 50).cast("double"))
    return G.annual_max(s, ties=True).select("site", "yr", "obs_id", r6("flow"))


@query("filter_zero_null", "series", "SELECT site, yr, obs_id, flow FROM fx_series WHERE flow IS NOT NULL AND flow <> 0")
def filter_zero_null(q):
    return C.filter_zero_null(q.series, "flow").select("site", "yr", "obs_id", "flow")


@query("drop_all_null_columns", "series", "SELECT site, yr, obs_id, flow, area_km2 FROM fx_series WHERE flow IS NOT NULL")
def drop_all_null(q):
    return C.drop_all_null_columns(q.series.withColumn("covar", F.lit(None).cast("double")))


@query("remove_outliers", "series", f"""{ANNUAL}, s AS (SELECT site, avg(flow) AS m, stddev_samp(flow) AS sd, quantile_cont(flow, 0.25) AS q1, quantile_cont(flow, 0.75) AS q3 FROM am GROUP BY site)
SELECT 'z' AS method, a.site, a.yr, a.obs_id FROM am a JOIN s ON a.site = s.site WHERE abs(flow - m) <= 2.0e0 * sd
UNION ALL SELECT 'iqr', a.site, a.yr, a.obs_id FROM am a JOIN s ON a.site = s.site WHERE flow BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1)""")
def remove_outliers(q):
    am = G.annual_max(q.series)
    z = C.remove_outliers(am, "flow", "Zscore", 2.0).select(F.lit("z").alias("method"), "site", "yr", "obs_id")
    return z.unionByName(C.remove_outliers(am, "flow", "IQR").select(F.lit("iqr").alias("method"), "site", "yr", "obs_id"))


@query("minmax_covariate", "series", f"""{ANNUAL}, s AS (SELECT site, min(yr) AS a, max(yr) AS b FROM am GROUP BY site),
i AS (SELECT site, yr, row_number() OVER (PARTITION BY site ORDER BY yr) AS k, count(*) OVER (PARTITION BY site) AS n FROM am)
SELECT i.site, i.yr, round(2.0e0 * (i.yr - a) / (b - a) - 1, 6) AS cov_given, round(2.0e0 * (k - 1) / (n - 1) - 1, 6) AS cov_index FROM i JOIN s ON i.site = s.site""")
def covariate(q):
    am = G.annual_max(q.series).withColumn("covar", F.col("yr").cast("double"))
    given = minmax_covariate(am, "covar").select("site", "yr", r6("cov", "cov_given"))
    return given.join(minmax_covariate(am.drop("covar"), None).select("site", "yr", r6("cov", "cov_index")), ["site", "yr"])


@query("index_flood", "series", f"{ANNUAL} SELECT site, round(avg(flow), 6) AS index_value, count(*) AS n_years FROM am GROUP BY site")
def index_flood(q):
    from hydrospark.operators.frequency import index_flood as run
    return run(G.annual_max(q.series), "flow").select("site", r6("index_value"), "n_years")


@query("default_columns", "culverts", "SELECT point_id, CASE WHEN material = 'NA' THEN NULL ELSE material END AS material, NULL::VARCHAR AS rte_no, CAST(coalesce(grp_size, 1) AS BIGINT) AS grp_size FROM fx_culverts")
def default_columns(q):
    return C.default_columns(q.culverts, {"material": None, "rte_no": None, "grp_size": 1}).select("point_id", "material", "rte_no", F.col("grp_size").cast("bigint").alias("grp_size"))


@query("infer_road_width", "roads", """h AS (SELECT feature_id, seq, CASE seq % 5 WHEN 0 THEN 'motorway' WHEN 1 THEN 'residential' WHEN 2 THEN 'primary' WHEN 3 THEN 'unclassified' ELSE 'track' END AS h FROM fx_roads)
SELECT feature_id, seq, CASE h WHEN 'motorway' THEN 25 WHEN 'residential' THEN 6 WHEN 'primary' THEN 12 WHEN 'unclassified' THEN 5 END AS road_width_m FROM h""")
def road_width(q):
    names = F.array(*map(F.lit, ("['motorway', 'trunk']", "residential", "['primary']", "unclassified", "track")))
    return C.infer_road_width(q.roads.withColumn("highway", F.element_at(names, F.col("seq") % 5 + 1))).select("feature_id", "seq", "road_width_m")
