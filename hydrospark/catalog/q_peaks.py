"""Peak discharge: scalar formulas, return-period and coefficient brackets, both methods end to end."""

from pyspark.sql import functions as F

from hydrospark.catalog.base import query, r6
from hydrospark.functions import peakflow as P
from hydrospark.operators import intensity as I
from hydrospark.plans import peak_discharge as D

RPS = [2, 10, 25, 50, 75, 100, 1000]
DUR = "[5e0,10e0,15e0,30e0,60e0,120e0,180e0,360e0,720e0,1440e0,2880e0,4320e0,5760e0,10080e0,14400e0,28800e0,43200e0,64800e0,86400e0]"
TOV = "1.44e0 * pow(ov_len_m * 0.8e0, 0.467e0) * pow(avg_sl / 100, -0.235e0)"
TCH = "0.0195e0 * pow(ch_len_m, 0.770e0) * pow(avg_sl / 100, -0.385e0)"
WS = f"ws AS (SELECT *, point_id % 25 AS station, round({TOV} + {TCH}, 2) AS tc_min FROM fx_watersheds)"
NEAR = f"""dur AS (SELECT unnest({DUR}) AS dur_min),
near AS (SELECT w.point_id, min_by(d.dur_min, abs(d.dur_min - w.tc_min) * 1000000 + d.dur_min / 1000) AS dur_min FROM ws w, dur d GROUP BY 1)"""
# bounds: estimate, 20 % either side
PIDF = """pb AS (SELECT station, dur_min::DOUBLE AS dur_min, rp, b.bound, est * b.f AS v FROM fx_pidf, (SELECT 'L' AS bound, 0.8e0 AS f UNION ALL SELECT 'E', 1e0 UNION ALL SELECT 'U', 1.2e0) b)"""
ASK = """br AS (SELECT *, lead(rp) OVER w AS rp2, lead(v) OVER w AS v2, row_number() OVER w AS i FROM pb WINDOW w AS (PARTITION BY station, dur_min, bound ORDER BY rp)),
ask AS (SELECT unnest([2, 10, 25, 50, 75, 100, 1000]) AS a),
lev AS (SELECT station, dur_min, bound, a AS rp, CASE WHEN a < br.rp THEN v WHEN rp2 IS NULL THEN v ELSE v + (v2 - v) * ((a - br.rp) / (rp2 - br.rp)::DOUBLE) END AS v
  FROM br, ask WHERE (a >= br.rp AND (rp2 IS NULL OR a < rp2)) OR (i = 1 AND a < br.rp))"""
SMM = "(1 / 0.0394e0 * (1000.0e0 / cn_val - 10))"
IA = f"(0.2e0 * {SMM} * 0.0393701e0)"


def R(p):
    return f"CASE WHEN {p} * 25.400013716e0 <= 0.2e0 * {SMM} THEN 0e0 ELSE pow({p} * 25.400013716e0 - 0.2e0 * {SMM}, 2) / ({p} * 25.400013716e0 + 0.8e0 * {SMM}) * 0.1e0 END"


def line(x, knots):
    s = f"CASE WHEN {x} <= {knots[0][0]}e0 THEN {knots[0][1]}e0"
    for (a, ya), (b, yb) in zip(knots, knots[1:]):
        s += f" WHEN {x} <= {b}e0 THEN {ya}e0 + ({x} - {a}e0) / ({b}e0 - {a}e0) * ({yb}e0 - ({ya}e0))"
    return s + f" WHEN {x} > {knots[-1][0]}e0 THEN {knots[-1][1]}e0 END"


def coef(k, x, i):
    return "CASE " + " ".join(f"WHEN {k} = '{n}' THEN ({line(x, [(r[0], r[i + 1]) for r in rows])})" for n, rows in P.UNIT_PEAK.items()) + " END"


SHARE = "least(greatest(wet_a_ha / area_ha * 100, 0e0), 5e0)"
QU = "pow(10e0, c0 + c1 * log10(tc) + c2 * log10(tc) * log10(tc) - 2.366e0)"


def ws(q):
    df = D.with_time_of_concentration(q.watersheds)
    return df.withColumn("station", (F.col("point_id") % 25).cast("int"))


def bounds(q):
    b = F.inline(F.array(*[F.struct(F.lit(n).alias("bound"), F.lit(f).alias("f")) for n, f in (("L", 0.8), ("E", 1.0), ("U", 1.2))]))
    p = q.pidf.select("station", F.col("dur_min").cast("double").alias("dur_min"), "rp", "est", b)
    return p.select("station", "dur_min", "rp", "bound", (F.col("est") * F.col("f")).alias("v"))


@query("validate_return_periods", "pidf", "SELECT DISTINCT rp::DOUBLE AS rp FROM fx_pidf")
def rps(q):
    P.validate_return_periods([2, 5, 10, 25, 50, 100, 1000])
    return q.pidf.select(F.col("rp").cast("double").alias("rp")).distinct()


@query("time_of_concentration", "watersheds", f"SELECT point_id, round({TOV}, 2) AS tov_min, round({TCH}, 2) AS tch_min, round({TOV} + {TCH}, 2) AS tc_min FROM fx_watersheds")
def tc(q):
    return ws(q).select("point_id", "tov_min", "tch_min", "tc_min")


@query("j19", "watersheds", f"{WS}, {NEAR} SELECT point_id, dur_min FROM near")
def j19(q):
    return ws(q).select("point_id", P.nearest_duration(F.col("tc_min")).alias("dur_min"))


@query("j20", "pidf watersheds", f"{WS}, {NEAR}, {PIDF}, {ASK} SELECT w.point_id, l.dur_min, l.bound, l.rp::DOUBLE AS rp, round(l.v, 6) AS v FROM ws w JOIN near n ON w.point_id = n.point_id JOIN lev l ON w.station = l.station AND l.dur_min = n.dur_min")
def j20(q):
    return I.intensity_for(ws(q), bounds(q), RPS).select("point_id", "dur_min", "bound", "rp", r6("v"))


@query("j21", "watersheds", f"""w AS (SELECT point_id, rain_type AS k, {IA} / (1e0 + point_id % 6) AS x FROM fx_watersheds)
SELECT point_id, round({coef('k', 'x', 0)}, 6) AS c0, round({coef('k', 'x', 1)}, 6) AS c1, round({coef('k', 'x', 2)}, 6) AS c2 FROM w""")
def j21(q):
    w = q.watersheds.withColumn("x", P.initial_abstraction(F.col("cn_val")) / (1.0 + F.col("point_id") % 6))
    return w.select("point_id", *[r6(P.unit_coefficient(F.col("rain_type"), F.col("x"), i), f"c{i}") for i in range(3)])


@query("j22", "watersheds", f"s AS (SELECT point_id, {SHARE} AS s FROM fx_watersheds) SELECT point_id, round({line('s', P.WET_KNOTS)}, 6) AS fp FROM s")
def j22(q):
    return q.watersheds.select("point_id", r6(P.wetland_factor(P.wetland_share(F.col("wet_a_ha"), F.col("area_ha"))), "fp"))


@query("clip_wetland_share", "watersheds", f"SELECT point_id, round({SHARE}, 6) AS wet_pct FROM fx_watersheds")
def share(q):
    return q.watersheds.select("point_id", r6(P.wetland_share(F.col("wet_a_ha"), F.col("area_ha")), "wet_pct"))


@query("initial_abstraction", "watersheds", f"SELECT point_id, round({IA}, 6) AS ia_in FROM fx_watersheds")
def ia(q):
    return q.watersheds.select("point_id", r6(P.initial_abstraction(F.col("cn_val")), "ia_in"))


@query("runoff_depth", "watersheds", f"w AS (SELECT *, 0.5e0 + point_id % 9 AS p FROM fx_watersheds) SELECT point_id, round({R('p')}, 6) AS runoff_cm FROM w")
def runoff(q):
    return q.watersheds.select("point_id", r6(P.runoff_depth(0.5 + F.col("point_id") % 9, F.col("cn_val")), "runoff_cm"))


@query("unit_peak", "watersheds", f"""{WS}, w AS (SELECT point_id, rain_type AS k, {IA} AS ia, (point_id % 9)::DOUBLE AS p, tc_min / 60 AS tc FROM ws),
c AS (SELECT *, {coef('k', '(ia / p)', 0)} AS c0, {coef('k', '(ia / p)', 1)} AS c1, {coef('k', '(ia / p)', 2)} AS c2 FROM w)
SELECT point_id, CASE WHEN p > 0 AND k IS NOT NULL THEN round({QU}, 6) END AS qu, CASE WHEN p <= 0 THEN 'p' WHEN k IS NULL THEN 'type' END AS error FROM c""")
def unit_peak(q):
    a, p, t, k = P.initial_abstraction(F.col("cn_val")), (F.col("point_id") % 9).cast("double"), F.col("tc_min") / 60, F.col("rain_type")
    return ws(q).select("point_id", r6(P.unit_peak(a, p, t, k), "qu"), P.unit_peak_error(a, p, t, k).alias("error"))


GPDM = f"""{WS}, {PIDF}, {ASK}, g AS (SELECT w.point_id, w.area_ha, w.cn_val, w.wet_a_ha, coalesce(w.rain_type, 'II') AS k, tc_min / 60 AS tc, l.rp, l.bound, l.v * 3 AS p
  FROM ws w JOIN lev l ON w.station = l.station AND l.dur_min = 1440),
c AS (SELECT *, {SHARE} AS s, {coef('k', f'({IA} / p)', 0)} AS c0, {coef('k', f'({IA} / p)', 1)} AS c1, {coef('k', f'({IA} / p)', 2)} AS c2 FROM g)
SELECT point_id, rp::DOUBLE AS return_period, bound, round(p * 2.54e0, 6) AS p_cm, round({QU} * ({R('p')}) * area_ha * 0.01e0 * ({line('s', P.WET_KNOTS)}), 2) AS q_cms, NULL::VARCHAR AS error FROM c"""


def gpdm(q):
    depth = bounds(q).withColumn("v", F.col("v") * 3)
    return D.graphical(ws(q), depth, RPS).withColumn("p_cm", r6("p_cm"))


query("q_gpdm", "watersheds pidf", GPDM)(gpdm)


@query("c4", "watersheds pidf", GPDM + f"""
UNION ALL SELECT point_id, NULL, 'event', round(4.5e0 * 2.54e0, 6), round(pow(10e0, e0 + e1 * log10(tc) + e2 * log10(tc) * log10(tc) - 2.366e0) * ({R('4.5e0')}) * area_ha * 0.01e0 * ({line('s', P.WET_KNOTS)}), 2), NULL
FROM (SELECT *, {SHARE} AS s, tc_min / 60 AS tc, {coef("'II'", f'({IA} / 4.5e0)', 0)} AS e0, {coef("'II'", f'({IA} / 4.5e0)', 1)} AS e1, {coef("'II'", f'({IA} / 4.5e0)', 2)} AS e2 FROM ws)""")
def c4(q):
    event = D.graphical_event(ws(q), 4.5).select("point_id", F.lit(None).cast("double").alias("return_period"), F.lit("event").alias("bound"), r6("p_cm"), "q_cms", "error")
    return gpdm(q).unionByName(event)


@query("area_reduction", "watersheds", f"{WS}, {NEAR} SELECT w.point_id, round(1 - exp(-1.1e0 * pow(n.dur_min / 60, 0.25e0)) + exp(-1.1e0 * pow(n.dur_min / 60, 0.25e0) - 0.0259e0 * area_ha * 0.01e0), 6) AS arf FROM ws w JOIN near n ON w.point_id = n.point_id")
def arf(q):
    return ws(q).select("point_id", r6(P.area_reduction(P.nearest_duration(F.col("tc_min")) / 60, F.col("area_ha")), "arf"))


ARF = "(1 - exp(-1.1e0 * pow(dur_min / 60, 0.25e0)) + exp(-1.1e0 * pow(dur_min / 60, 0.25e0) - 0.0259e0 * area_ha * 0.01e0))"
RAT = f"""{WS}, {NEAR}, {PIDF}, {ASK}, j AS (SELECT w.*, n.dur_min, l.rp, l.bound, l.v FROM ws w JOIN near n ON w.point_id = n.point_id JOIN lev l ON l.station = w.station AND l.dur_min = n.dur_min)
SELECT point_id, rp::DOUBLE AS return_period, bound, dur_min, round(v * {ARF} * 2.54e0, 6) AS pi_cm_hr,
  round((CASE rp WHEN 25 THEN 1.1e0 WHEN 50 THEN 1.2e0 WHEN 100 THEN 1.25e0 ELSE 1e0 END) * c_runoff * (v * {ARF}) * (area_ha * 2.47105e0) * 0.02831683199881e0, 2) AS q_cms FROM j"""


@query("q_rational_point", "watersheds pidf", RAT)
def rational(q):
    return D.rational_from_stations(ws(q), bounds(q), RPS).withColumn("pi_cm_hr", r6("pi_cm_hr"))


SERQ = """s AS (SELECT point_id, area_ha, c_runoff, unnest([25, 50, 100]) AS rp FROM fx_watersheds)
SELECT point_id, rp AS return_period, 'E' AS bound, round((rp / 10.0e0) * c_runoff * area_ha * (0.393701e0 * 2.47105e0 * 0.0283168e0), 6) AS q_cms FROM s"""


@query("q_rational_series", "watersheds", SERQ)
def rational_series(q):
    i = q.watersheds.select("point_id", F.lit("E").alias("bound"), F.explode(F.array(*map(F.lit, (25, 50, 100)))).alias("return_period"))
    i = i.withColumn("pi_cm_hr", F.col("return_period") / 10.0)
    return D.rational_from_series(q.watersheds, i).withColumn("q_cms", r6("q_cms"))


@query("c3", "watersheds pidf", f"""{RAT} UNION ALL SELECT point_id, NULL, 'event', dur_min, round(1.7e0 * {ARF} * 2.54e0, 6), round(c_runoff * (1.7e0 * {ARF}) * (area_ha * 2.47105e0) * 0.02831683199881e0, 2)
FROM (SELECT w.*, n.dur_min FROM ws w JOIN near n ON w.point_id = n.point_id)""")
def c3(q):
    event = D.rational_event(ws(q), 1.7).select("point_id", F.lit(None).cast("double").alias("return_period"), F.lit("event").alias("bound"), r6("pi_cm_hr"), "q_cms")
    near = ws(q).select("point_id", P.nearest_duration(F.col("tc_min")).alias("dur_min"))
    return rational(q).unionByName(event.join(near, "point_id"))
