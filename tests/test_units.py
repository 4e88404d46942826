"""Hand values, brute-force comparisons on small tables, and edge cases."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrospark import schema as SC
from hydrospark.functions import classes as K, erosion as E, hydraulics as H, peakflow as P
from hydrospark.functions.gev import ad_statistic, fit_rows
from hydrospark.operators import binning as B, cleaning as C, frequency as Q, gauge as G, spatial as S, terrain as T
from hydrospark.operators.ordered import chunk_previous, chunk_running_sum, quantiles, ranked, running_total
from hydrospark.plans import capacity as CAP
from hydrospark.schema import Grid
from hydrospark.sources import readers as R, sinks as W, text_ingest as X


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def lit(x):
    return F.lit(x)


def test_hydraulics_by_hand(spark):
    area = one(spark, H.culvert_area(lit("Circular"), lit(4.0), lit(None).cast("double")))
    assert area == pytest.approx(math.pi * 4, abs=1e-9)
    assert one(spark, H.culvert_area(lit("Arch"), lit(3.0), lit(2.0))) == pytest.approx(4.0)
    q = one(spark, H.q_manning(lit(math.pi * 4), lit(1.0), lit(1.0), lit(0.012), lit(0.01)))
    assert q == pytest.approx(1.49 / 0.012 * math.pi * 4 * 0.1, abs=1e-9)
    assert one(spark, H.q_outlet(lit(1.0), lit(1.0), lit(2.0), lit(0.5), lit(0.5), lit(0.012), lit(0.0), lit(30.0), lit(1.0))) is None
    assert one(spark, H.vulnerability(lit(None).cast("double"), lit(1.0))) is None
    assert one(spark, H.vulnerability(lit(2.0), lit(2.0))) == "Not Vulnerable"


def test_shapes_and_tokens(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([" pipe_arch ", "Pipe arch", "OVAL", "NA", None, "blob", "square"])], "point_id int, pour_sha string")
    got = [r.pour_sha for r in C.standardise_shape(df).orderBy("point_id").collect()]
    assert got == ["Pipe arch", "Pipe arch", "Elliptical", "Circular", "Circular", "Circular", "Box"]
    compat = [r.pour_sha for r in C.standardise_shape(df, ref_compat=True).orderBy("point_id").collect()]
    assert compat[1] == "Circular" and compat[0] == "Pipe arch"
    n = spark.createDataFrame([("1.5",), ("NaN",), ("x",), ("",)], "width_ft string")
    assert [r.width_ft for r in C.clean_na(n).collect()] == [1.5, None, None, None]


def test_required_columns_and_periods(spark):
    with pytest.raises(ValueError):
        SC.require_columns(spark.range(1), ["missing"])
    with pytest.raises(ValueError):
        P.validate_return_periods([1])
    with pytest.raises(ValueError):
        P.validate_return_periods(list(range(2, 14)))
    with pytest.raises(ValueError):
        CAP.capacity_cfs(spark.range(1), "other")


def test_peak_formulas(spark):
    assert one(spark, P.nearest_duration(lit(7.5))) == 5.0
    assert one(spark, P.runoff_depth(lit(0.1), lit(60.0))) == 0.0
    assert one(spark, P.runoff_depth(lit(0.1), lit(60.0), True)) > 0
    assert one(spark, P.interpolate(lit(0.6), P.WET_KNOTS)) == pytest.approx(0.92)
    assert one(spark, P.unit_peak(lit(0.1), lit(0.0), lit(1.0), lit("II"))) is None
    assert one(spark, P.unit_peak_error(lit(0.1), lit(1.0), lit(1.0), lit("V"))) == "type"
    assert one(spark, P.time_of_concentration(lit(10.0), lit(10.0), lit(0.0))[2]) is None


def test_erosion_formulas(spark):
    assert one(spark, E.r_factor(lit(0.0))) == 0.0
    assert one(spark, E.r_factor(lit(2000.0))) == pytest.approx(0.283 * 101.6)
    assert one(spark, E.c_factor(lit(1.0))) == 0.01
    assert one(spark, E.c_factor(lit(-0.5))) == 1.0
    assert one(spark, K.score_category(lit(float("nan")))) == "No Data"
    assert one(spark, K.score_category(lit(4.0))) == "Very High"


def skewed(n=4000, seed=3):
    rng = random.Random(seed)
    return [(i, rng.choice([1.0, 1.0, 1.0, rng.random() * 5])) for i in range(n)]


def test_ranked_with_heavy_ties(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "id long, v double")
    got = {r["id"]: (r["rk"], r["n"]) for r in ranked(df, "v", "id", None, "rk", "n", n_chunks=8).collect()}
    want = {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda t: (t[1], t[0])), start=1)}
    assert got == {i: (k, len(rows)) for i, k in want.items()}


def test_ranked_in_groups(spark):
    rows = [(i % 3 and 1, i, float((i * 7) % 11)) for i in range(500)]
    df = spark.createDataFrame(rows, "g long, id long, v double")
    got = {r["id"]: r["rk"] for r in ranked(df, "v", "id", ["g"], "rk", "n", descending=True, n_chunks=4).collect()}
    for g in (0, 1):
        order = sorted([t for t in rows if t[0] == g], key=lambda t: (-t[2], t[1]))
        assert [got[t[1]] for t in order] == list(range(1, len(order) + 1))


def test_quantiles_and_running_total(spark):
    rows = skewed(1001)
    df = spark.createDataFrame(rows, "id long, v double")
    q = quantiles(df, "v", "id", {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    assert [q.a, q.b, q.c] == pytest.approx(list(np.quantile([v for _, v in rows], [0.25, 0.5, 0.9])))
    d = spark.range(300).select(F.col("id").cast("double").alias("v"), F.lit(1.0).alias("w"))
    assert all(r.cum == r.v + 1 for r in running_total(d, "v", "w", "cum", 7).collect())


def test_chunked_windows(spark):
    rows = [(s, t, t // 10, (t * 5) % 7) for s in (1, 2) for t in range(95) if t % 13]
    df = spark.createDataFrame(rows, "s int, t int, ch int, v int")
    prev = {(r.s, r.t): r.p for r in chunk_previous(df, ["s"], "ch", ["t"], {"p": "v"}).collect()}
    tot = {(r.s, r.t): r.c for r in chunk_running_sum(df, ["s"], "ch", ["t"], "v", "c").collect()}
    for s in (1, 2):
        last, c = None, 0
        for r in sorted(x for x in rows if x[0] == s):
            c += r[3]
            assert prev[(s, r[1])] == last and tot[(s, r[1])] == c
            last = r[3]


def test_rank_score_edges(spark):
    same = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None)], "zone_id int, v double")
    assert {r.zone_id: r.score for r in B.rank_score(same, "v", "zone_id").collect()} == {1: 2.5, 2: 2.5, 3: None}
    assert {r.zone_id: r.score for r in B.rank_score(same, "v", "zone_id", equal_is_middle=False).collect()} == {1: 0.0, 2: 5.0, 3: None}


def brute_fill(z):
    h, w = z.shape
    out, seen, heap = z.copy(), np.zeros_like(z, bool), []
    for r in range(h):
        for c in range(w):
            if r in (0, h - 1) or c in (0, w - 1):
                heapq.heappush(heap, (z[r, c], r, c))
                seen[r, c] = True
    while heap:
        v, r, c = heapq.heappop(heap)
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                a, b = r + dr, c + dc
                if 0 <= a < h and 0 <= b < w and not seen[a, b]:
                    seen[a, b] = True
                    out[a, b] = max(z[a, b], v)
                    heapq.heappush(heap, (out[a, b], a, b))
    return out


def test_fill_and_drainage_against_brute_force(spark):
    rng = np.random.default_rng(5)
    z = np.round(rng.random((14, 17)) * 10, 1)
    g = Grid(0, 0, 10, 10)
    cells = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(14) for c in range(17)], "r int, c int, z double")
    filled = T.cut(T.fill_depressions(cells, "z", g))
    got = np.zeros_like(z)
    for row in filled.collect():
        got[row.r, row.c] = row.z_fill
    assert np.allclose(got, brute_fill(z))
    flow = T.cut(T.d8_pointer(T.flat_steps(filled, "z_fill"), "z_fill", g, "flat_steps"))
    ends = flow.where("down IS NULL").collect()
    assert all(e.r in (0, 13) or e.c in (0, 16) for e in ends)
    acc = T.upstream(flow)
    total = acc.join(flow.where("down IS NULL").select("cell"), "cell").agg(F.sum("acc")).first()[0]
    assert total == 14 * 17


def test_nearest_within_brute_force(spark):
    rng = random.Random(2)
    a = [(i, rng.random() * 100, rng.random() * 100) for i in range(60)] + [(99, 5.0, 5.0), (98, 5.0, 5.0)]
    b = [(i, rng.random() * 100, rng.random() * 100) for i in range(80)]
    got = {r.point_id: r.target_id for r in S.nearest_within(
        spark.createDataFrame(a, "point_id int, x double, y double"), spark.createDataFrame(b, "target_id int, x double, y double"), 8.0).collect()}
    want = {}
    for i, x, y in a:
        d, j = min((math.hypot(x - u, y - v), k) for k, u, v in b)
        if d <= 8.0:
            want[i] = j
    assert got == want


def test_lines_of_split_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.txt").write_text("\n".join(f"{k}:{i}" for i in range(1, 400)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        rows = R.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 3 * 399 and all(int(r.line.split(":")[1]) == r.line_no for r in rows)


def test_mann_kendall_brute_force(spark):
    rng = random.Random(4)
    x = [float(rng.randint(0, 9)) for _ in range(37)]
    df = spark.createDataFrame([(1, 1900 + i, v) for i, v in enumerate(x)], "site int, yr int, flow double")
    got = Q.mann_kendall(df, "flow").first()
    want = sum((b > a) - (b < a) for i, a in enumerate(x) for b in x[i + 1:])
    assert got.s == want and got.n == 37


def test_gev_fit_recovers_parameters():
    rng = np.random.default_rng(1)
    u = rng.uniform(size=(200, 100))
    for xi in (-0.2, 0.15):
        x = 50 + 9 * ((-np.log(u)) ** (-xi) - 1) / xi
        th, nll, cov, ok = fit_rows(x, np.zeros_like(x), np.ones_like(x, bool), [0, 2, 4])
        assert ok.mean() > 0.98
        assert abs(np.median(th[:, 0]) - 50) < 0.5 and abs(np.exp(np.median(th[:, 2])) - 9) < 0.4 and abs(np.median(th[:, 4]) - xi) < 0.04


def test_homogeneity_statistic():
    rng = np.random.default_rng(3)
    same = [rng.normal(size=60) for _ in range(4)]
    assert ad_statistic(same) < 2
    assert ad_statistic([same[0], same[1] + 2]) > 5


def test_annual_max_ties(spark):
    df = spark.createDataFrame([(1, 2000, 5, 3.0), (1, 2000, 4, 3.0), (1, 2001, 1, 0.0), (1, 2002, 9, None)], "site int, yr int, obs_id int, flow double")
    df = df.withColumn("area_km2", F.lit(2.0))
    assert [(r.yr, r.obs_id) for r in G.annual_max(df).collect()] == [(2000, 4)]
    assert len(G.annual_max(df, ties=True).collect()) == 2
    assert G.annual_max(df, per_area=True).first().flow == 1.5


def test_ascii_grid_layout(spark):
    text = ["ncols 3", "nrows 2", "xllcorner 100", "yllcorner 200", "cellsize 10", "NODATA_value -9999", "1 2 3", "4 -9999 6"]
    lines = spark.createDataFrame([("a", i, t) for i, t in enumerate(text, start=1)], "file string, line_no long, line string")
    got = {(r.r, r.c): (r.x, r.y, r.v) for r in X.ascii_grids(lines).collect()}
    assert got[(0, 0)] == (105.0, 215.0, 1.0) and got[(1, 2)] == (125.0, 205.0, 6.0) and got[(1, 1)][2] is None
    assert X.ascii_grids(lines, (5000.0, 5000.0, 6000.0, 6000.0)).count() == 0


def test_write_per_site(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "site int, v double")
    W.write_per_site(df, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("site=*")) == ["site=1", "site=2"]
