"""Crossings: cleaning, capacity, vulnerability flags and report counts."""

from pyspark.sql import functions as F

from hydrospark.catalog.base import query, r6
from hydrospark.functions import hydraulics as H
from hydrospark.operators import cleaning as C
from hydrospark.plans import capacity as K, summary as S
from hydrospark.session import dealt, spread

# Oracle pieces: cleaned and defaulted crossings, then geometry.
SHAPE = """CASE pour_sha WHEN 'Box' THEN 'Box' WHEN 'pipe_arch' THEN 'Pipe arch' WHEN 'Oval' THEN 'Elliptical'
  WHEN 'Arch' THEN 'Arch' ELSE 'Circular' END"""
PREP = f"""prep AS (SELECT point_id, {SHAPE} AS shape, width_ft AS w, height_ft AS h, coalesce(grp_size, 1)::DOUBLE AS n, culvert_sl AS s,
  (CASE material WHEN 'Steel' THEN 0.024e0 WHEN 'CMP' THEN 0.024e0 WHEN 'HDPE' THEN 0.009e0 ELSE 0.012e0 END)
  * (CASE cond WHEN 'Fair' THEN 1.1e0 WHEN 'Poor' THEN 1.3e0 ELSE 1.0e0 END) AS mn,
  CASE inlet_type WHEN 'Grooved_End' THEN 0.2e0 WHEN 'Beveled' THEN 0.2e0 WHEN 'Projecting' THEN 0.9e0 WHEN 'Mitered' THEN 0.7e0 ELSE 0.5e0 END AS ke
  FROM fx_culverts),
geo0 AS (SELECT *, CASE WHEN shape = 'Circular' THEN w IS NOT NULL ELSE w IS NOT NULL AND h IS NOT NULL END AS ok FROM prep),
geo AS (SELECT *, CASE WHEN NOT ok THEN NULL WHEN shape = 'Circular' THEN pi() * (w/2) * (w/2) WHEN shape = 'Box' THEN w * h
    WHEN shape = 'Arch' THEN 2.0e0/3 * w * h ELSE pi() * w * h / 4 END AS a,
  CASE WHEN NOT ok THEN NULL WHEN shape = 'Circular' THEN w ELSE h END AS d,
  CASE WHEN NOT ok THEN NULL WHEN shape = 'Circular' THEN w / 4 WHEN shape = 'Box' THEN w * h / (2 * (w + h))
    ELSE (CASE WHEN shape = 'Arch' THEN 2.0e0/3 * w * h ELSE pi() * w * h / 4 END)
      / (pi() * (3 * (w/2 + h/2) - sqrt((3 * w/2 + h/2) * (w/2 + 3 * h/2)))) END AS rh FROM geo0)"""
OUTLET = "2 * 32.2e0 * (1.5e0 * d - greatest(0.5e0 * d, d) + s * (30.0e0 / 0.3048e0)) / (1 + ke + 29.2e0 * mn * mn * (30.0e0 / 0.3048e0) / pow(rh, 4.0e0/3))"
CFS = {
    "orifice_flow": "0.62e0 * a * n * sqrt(2 * 32.2e0 * 1.2e0 * d)",
    "inlet_control": "a * sqrt(d) * sqrt((1.5e0 - 0.6e0) / 0.038e0) * n",
    "outlet_control": f"CASE WHEN {OUTLET} >= 0 THEN a * sqrt({OUTLET}) * n END",
    "manning_uniform": "1.49e0 / mn * a * pow(rh, 2.0e0/3) * sqrt(s) * n",
}
PEAK = """peak AS (SELECT point_id, rp, c_runoff * area_ha * 0.02e0 * ln(rp * 1.0e0) AS q_cms
  FROM (SELECT point_id, c_runoff, area_ha, unnest([25, 50, 100]) AS rp FROM fx_watersheds))"""
FLAGS = f"{PREP}, {PEAK}, flags AS (" + " UNION ALL ".join(
    f"""SELECT '{m}' AS qc_method, g.point_id, g.shape, p.rp, {e} * 0.0283168e0 AS qc, p.q_cms,
  CASE WHEN {e} IS NULL OR p.q_cms IS NULL THEN NULL WHEN {e} * 0.0283168e0 >= p.q_cms THEN 'Not Vulnerable' ELSE 'Vulnerable' END AS vuln
  FROM geo g JOIN peak p ON g.point_id = p.point_id""" for m, e in CFS.items()) + ")"


def peak_q(q):
    w = dealt(q.watersheds.select("point_id", "c_runoff", "area_ha"), "point_id").select("*", F.explode(F.array(*map(F.lit, (25, 50, 100)))).alias("return_period"))
    return w.select("point_id", "return_period", (F.col("c_runoff") * F.col("area_ha") * 0.02 * F.ln(F.col("return_period") * 1.0)).alias("q_cms"))


def all_flags(q):
    """Every capacity method at once: one pass over the crossings, methods exploded, one join on the key."""
    df = K.geometry(K.prepare_crossings(dealt(q.culverts, "point_id")))
    per_method = F.array(*[
        F.struct(F.lit(m).alias("qc_method"), H.cfs_to_cms(K.capacity_cfs(df, m)).alias("qc_cms")) for m in H.METHODS
    ])
    cap = df.select("point_id", "pour_sha", F.inline(per_method))
    return cap.join(spread(peak_q(q)), "point_id").withColumn("vuln", H.vulnerability(F.col("qc_cms"), F.col("q_cms")))


@query("clean_na", "culverts", """SELECT point_id, width_ft, height_ft, CAST(grp_size AS DOUBLE) AS grp_size,
  CASE WHEN pour_sha = 'NA' THEN NULL ELSE pour_sha END AS pour_sha, CASE WHEN material = 'NA' THEN NULL ELSE material END AS material FROM fx_culverts""")
def clean_na(q):
    dirty = q.culverts.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("NaN")) for c in ("width_ft", "height_ft", "grp_size")})
    return C.clean_na(dirty, text=["pour_sha", "material"]).select("point_id", "width_ft", "height_ft", "grp_size", "pour_sha", "material")


@query("standardise_shape", "culverts", f"SELECT point_id, {SHAPE} AS pour_sha FROM fx_culverts")
def standardise_shape(q):
    return C.standardise_shape(q.culverts).select("point_id", "pour_sha")


@query("fill_culvert_defaults", "culverts", f"""{PREP} SELECT point_id, n AS grp_size, 30.0e0 AS l_m, s AS culvert_sl, round(mn, 6) AS n_manning, ke,
  0.6e0 AS y, -0.5e0 AS ks, 0.038e0 AS c, 0.62e0 AS cd_orifice, 3.0e0 AS cw_weir, 0.0098e0 AS k_inlet, 2.0e0 AS m_inlet, 0.0398e0 AS c_inlet, 0.67e0 AS y_inlet FROM prep""")
def fill_defaults(q):
    df = K.prepare_crossings(q.culverts)
    return df.select("point_id", "grp_size", "l_m", "culvert_sl", r6("n_manning"), "ke", *H.HYDRAULIC_DEFAULTS)


@query("require_columns", "culverts", "SELECT point_id, width_ft FROM fx_culverts")
def required(q):
    from hydrospark.schema import require_columns
    return require_columns(q.culverts, ["point_id", "width_ft"]).select("point_id", "width_ft")


@query("culvert_area", "culverts", f"{PREP} SELECT point_id, round(a, 6) AS area_ft2 FROM geo")
def culvert_area(q):
    return K.geometry(K.prepare_crossings(q.culverts)).select("point_id", r6("area_ft2"))


@query("hydraulic_radius", "culverts", f"{PREP} SELECT point_id, round(rh, 6) AS radius_ft, d AS depth_ft FROM geo")
def hydraulic_radius(q):
    return K.geometry(K.prepare_crossings(q.culverts)).select("point_id", r6("radius_ft"), "depth_ft")


def _capacity(name, method):
    @query(name, "culverts", f"{PREP} SELECT point_id, round({CFS[method]}, 6) AS q_cfs FROM geo")
    def run(q):
        df = K.geometry(K.prepare_crossings(q.culverts))
        return df.select("point_id", r6(K.capacity_cfs(df, method), "q_cfs"))


for _n, _m in (("q_orifice", "orifice_flow"), ("q_inlet", "inlet_control"), ("q_outlet", "outlet_control"), ("q_manning", "manning_uniform")):
    _capacity(_n, _m)


@query("cfs_to_cms", "culverts", f"{PREP} SELECT point_id, round({CFS['manning_uniform']} * 0.0283168e0, 6) AS qc_cms FROM geo")
def cfs_to_cms(q):
    return K.discharge_capacity(q.culverts).select("point_id", r6("qc_cms"))


@query("vulnerability", "culverts watersheds", f"{FLAGS} SELECT qc_method, point_id, rp AS return_period, round(qc, 6) AS qc_cms, round(q_cms, 6) AS q_cms, vuln FROM flags")
def vulnerability(q):
    return all_flags(q).select("qc_method", "point_id", "return_period", r6("qc_cms"), r6("q_cms"), "vuln")


@query("pick_q_columns", "watersheds", """w AS (SELECT point_id, area_ha * 1.0e0 AS a FROM fx_watersheds)
SELECT point_id, '25' AS return_period, round(a, 6) AS q_cms FROM w UNION ALL SELECT point_id, '50', round(a * 2, 6) FROM w UNION ALL SELECT point_id, '100', round(a * 3, 6) FROM w""")
def pick_q_columns(q):
    a = F.col("area_ha")
    wide = q.watersheds.select("point_id", a.alias("RM25E"), (a * 2).alias("RM50E"), (a * 3).alias("RM100E"), (a * 9).alias("RM25L"), (a * 9).alias("RF25E"))
    return K.peaks_to_long(wide, "RationalMethod").select("point_id", "return_period", r6("q_cms"))


@query("j4", "culverts watersheds", f"{FLAGS} SELECT point_id, rp AS return_period, shape AS pour_sha, round(qc, 6) AS qc_cms, round(q_cms, 6) AS q_cms FROM flags WHERE qc_method = 'manning_uniform'")
def j4(q):
    cap = K.discharge_capacity(q.culverts)
    return K.vulnerability_flags(cap, peak_q(q)).select("point_id", "return_period", "pour_sha", r6("qc_cms"), r6("q_cms"))


@query("category_counts", "culverts watersheds", f"""{FLAGS}, c AS (SELECT coalesce(vuln, 'No Data') AS category, count(*) AS n FROM flags GROUP BY 1)
SELECT category, n, round(n * 100.0e0 / sum(n) OVER (), 6) AS pct FROM c""")
def category_counts(q):
    flags = all_flags(q).select(F.coalesce("vuln", F.lit("No Data")).alias("category"))
    return S.category_counts(flags).select("category", "n", r6("pct"))


@query("crossing_counts", "culverts", """b AS (SELECT point_id, point_id % 19 = 0 AS bridge FROM fx_culverts)
SELECT count(DISTINCT point_id) AS crossings, count_if(bridge)::BIGINT AS bridges, (count(DISTINCT point_id) - count_if(bridge))::BIGINT AS culverts FROM b""")
def crossing_counts(q):
    df = q.culverts.withColumn("pour_sha", F.when(F.col("point_id") % 19 == 0, F.lit("Bridge")).otherwise(F.col("pour_sha")))
    return S.crossing_counts(df)


@query("vulnerable_share", "culverts watersheds", f"""{FLAGS}, t AS (SELECT * FROM flags WHERE rp = (SELECT max(rp) FROM flags))
SELECT qc_method, rp AS return_period, count(DISTINCT point_id) AS culverts, count_if(vuln = 'Vulnerable')::BIGINT AS vulnerable,
  round(count_if(vuln = 'Vulnerable') * 100.0e0 / count(DISTINCT point_id), 6) AS vulnerable_pct FROM t GROUP BY 1, 2""")
def vulnerable_share(q):
    return S.vulnerable_share(all_flags(q), ["qc_method"]).select("qc_method", "return_period", "culverts", "vulnerable", r6("vulnerable_pct"))


@query("c7", "culverts watersheds", f"""{FLAGS} SELECT point_id, round(qc, 6) AS qc_cms, max(CASE WHEN rp = 25 THEN vuln END) AS "25Vuln",
  max(CASE WHEN rp = 50 THEN vuln END) AS "50Vuln", max(CASE WHEN rp = 100 THEN vuln END) AS "100Vuln" FROM flags WHERE qc_method = 'outlet_control' GROUP BY 1, 2""")
def c7(q):
    peaks = peak_q(q)
    wide = peaks.groupBy("point_id").pivot("return_period", [25, 50, 100]).agg(F.first("q_cms"))
    wide = wide.select("point_id", *[F.col(str(p)).alias(f"RM{p}E") for p in (25, 50, 100)])
    flags = K.capacity_vulnerability(q.culverts, wide, "outlet_control")
    return K.flags_wide(flags, [25, 50, 100]).withColumn("qc_cms", r6("qc_cms"))


@query("c12", "culverts watersheds", f"""{FLAGS}, inv AS (SELECT point_id, point_id % 19 = 0 AS bridge FROM fx_culverts), own AS (SELECT point_id FROM inv WHERE NOT bridge),
t AS (SELECT * FROM flags WHERE rp = 100 AND point_id IN (SELECT point_id FROM own)),
sc AS (SELECT CASE WHEN area_ha < 100 THEN 'Low' WHEN area_ha < 400 THEN 'High' ELSE 'Very High' END AS category FROM fx_watersheds)
SELECT 'inventory' AS section, 'crossings' AS item, count(DISTINCT point_id) AS value, NULL::DOUBLE AS pct FROM fx_culverts
UNION ALL SELECT 'inventory', 'culverts', count(*), NULL FROM own UNION ALL SELECT 'inventory', 'bridges', count(*), NULL FROM inv WHERE bridge
UNION ALL SELECT 'hydrologic', qc_method, count_if(vuln = 'Vulnerable')::BIGINT, round(count_if(vuln = 'Vulnerable') * 100.0e0 / (SELECT count(*) FROM own), 6) FROM t GROUP BY qc_method
UNION ALL SELECT 'erosion', 'soil loss', count_if(category <> 'Low')::BIGINT, round(count_if(category <> 'Low') * 100.0e0 / count(*), 6) FROM sc""")
def c12(q):
    a = F.col("area_ha")
    zones = q.watersheds.select(F.when(a < 100, "Low").when(a < 400, "High").otherwise("Very High").alias("category"))
    wide = peak_q(q).groupBy("point_id").pivot("return_period", [25, 50, 100]).agg(F.first("q_cms"))
    wide = wide.select("point_id", *[F.col(str(p)).alias(f"RM{p}yrE") for p in (25, 50, 100)])
    flags = None
    for m in H.METHODS:
        one = K.capacity_vulnerability(q.culverts, wide, m)
        flags = one if flags is None else flags.unionByName(one)
    # every 19th crossing is a bridge; every 23rd has no shape on record
    own = F.when(F.col("point_id") % 19 == 0, F.lit("Bridge")).when(F.col("point_id") % 23 != 0, F.col("pour_sha"))
    return S.vulnerability_summary(flags, q.culverts.withColumn("pour_sha", own), {"soil loss": zones}, ["qc_method"]).withColumn("pct", r6("pct"))
