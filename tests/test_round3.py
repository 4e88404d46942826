"""Fits, bootstrap, pool tests and rain moments of the third round against plain numpy."""

import datetime

import numpy as np
import pytest

from hydrospark.functions import gev as G
from hydrospark.operators import nesting as N, regions as R, rollup as U, terrain as T


def test_closed_form_derivatives():
    rng = np.random.default_rng(1)
    x, c, mask = rng.gumbel(size=(4, 40)), rng.uniform(-1, 1, (4, 40)), np.ones((4, 40), bool)
    mask[1, 30:] = False
    theta = np.array([[0.1, 0.05, 0.1, -0.02, 0.1], [0, 0, 0, 0, 0.02], [0.2, 0, 0.1, 0.03, -0.12], [0.0, 0.1, 0, 0, 0.3]])
    _, g, h = G._derivatives(theta, x, c, mask)
    for k in range(5):
        step = np.zeros_like(theta)
        step[:, k] = 1e-6
        up, down = G._derivatives(theta + step, x, c, mask), G._derivatives(theta - step, x, c, mask)
        assert np.allclose((up[0] - down[0]) / 2e-6, g[:, k], atol=1e-5) and np.allclose((up[1] - down[1]) / 2e-6, h[:, k], atol=1e-4)


def test_bootstrap_is_the_fit_of_each_replicate():
    """Bounds from fits that start at the law equal bounds from fits of the scaled draws that start anywhere."""
    for shape in (-0.2, 0.0, 0.25):
        got = G.bootstrap_bounds(77, 40.0, 6.0, shape, [2, 50, 100], 60, 100, 0.05, "GEV")
        x = G.quantile(G.uniforms(77, 60, 100), 40.0, 6.0, shape)
        theta, _, _, ok = G.fit_rows(x, np.zeros_like(x), np.ones_like(x, bool), [0, 2, 4])
        assert ok.all()
        q = np.stack([G.quantile(1 - 1 / rp, theta[:, 0], np.exp(theta[:, 2]), theta[:, 4]) for rp in (2, 50, 100)])
        assert np.allclose(got, np.quantile(q, [0.025, 0.975], axis=1).T, rtol=1e-5)


def samples(rng, n=9):
    """Records of different lengths, some rounded so that values tie within and between them."""
    return {f"g{i}": np.round(rng.gumbel(size=int(rng.integers(5, 50))) * 3 + 10 + (i > 6) * 4, 1 if i % 2 else 6) for i in range(n)}


def rows(spark, s):
    return spark.createDataFrame([(k, float(x)) for k, v in s.items() for x in v], "donor string, x double")


def test_pool_statistic_without_pools(spark):
    s = samples(np.random.default_rng(2))
    names = list(s)
    members = spark.createDataFrame([(k, d) for k in range(2, 9) for d in names[:k]], "a long, donor string")
    got = {r["a"]: (r["k"], r["stat"]) for r in R.ad_statistics(members, rows(spark, s), ["a"]).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: k for k in range(2, 9)}
    assert all(np.isclose(got[k][1], G.ad_statistic([s[d] for d in names[:k]]), atol=1e-8) for k in got)
    assert [abs(spark.range(1).select(R.harmonic(R.F.lit(n))).first()[0] - sum(1 / i for i in range(1, n + 1))) < 1e-12 for n in (0, 1, 31, 32, 500)] == [True] * 5


@pytest.mark.parametrize("first", [2, 3, 8])
def test_pools_grow_until_the_first_failure(spark, first):
    rng = np.random.default_rng(5)
    s = samples(rng, 12)
    places = {d: rng.normal(size=2) for d in s} | {f"u{i}": rng.normal(size=2) for i in range(25)}
    targets = spark.createDataFrame([(d, float(p[0]), float(p[1])) for d, p in places.items()], "point_id string, d1 double, d2 double")
    gauged = targets.where("point_id like 'g%'")
    pools = R.homogeneous_pools(targets, gauged, ["d1", "d2"], rows(spark, s), first=first)
    got = {}
    for r in pools.orderBy("site", "rank").collect():
        got.setdefault(r["site"], []).append(r["donor"])
    sd = np.std([p for p in places.values()], axis=0, ddof=1)
    b0, b1, b2 = G.AD_CRITICAL[0.95]
    for site, p in places.items():
        near = sorted(s, key=lambda d: (round(float(np.sqrt((((places[d] - p) / sd) ** 2).sum())), 9), d))
        k = 1
        while k < len(near) and G.ad_statistic([s[d] for d in near[:k + 1]]) <= b0 + b1 / np.sqrt(k) + b2 / k:
            k += 1
        assert got[site] == near[:k]
    regions, members = R.shared_sets(pools)
    sets = {}
    for r in members.collect():
        sets.setdefault(r["region"], set()).add(r["donor"])
    assert {r["site"]: sets[r["region"]] for r in regions.collect()} == {k: set(v) for k, v in got.items()}
    assert len(sets) == len({frozenset(v) for v in got.values()})


def test_kappa_law_has_the_ratios_it_was_fitted_to():
    for k, h in ((0.1, 0.2), (-0.15, 0.001), (0.2, -0.5), (-0.1, -0.9), (0.3, 1.0)):
        _, _, t3, t4 = G.kappa_ratios(k, h)
        loc, scale, k2, h2 = G.kappa_fit(0.3, t3, t4)
        assert np.isclose([k2, h2], [k, h], atol=1e-5).all()
        x = G.kappa_quantile((np.arange(1, 400_001) - 0.5) / 4e5, loc, scale, k2, h2)
        i, n = np.arange(len(x)), len(x)
        b = [x.mean(), (x * i / (n - 1)).mean(), (x * i * (i - 1) / ((n - 1) * (n - 2.0))).mean()]
        l2 = 2 * b[1] - b[0]
        assert np.allclose([b[0], l2, (6 * b[2] - 6 * b[1] + b[0]) / l2], [1, 0.3, t3], atol=1e-3)
    # published ratios: normal law (0, 0.1226), uniform (0, 0), Gumbel (0.1699, 0.1504), exponential (1/3, 1/6)
    assert np.allclose(G.kappa_ratios(1e-5, 0.0)[2:], (0.1699, 0.1504), atol=1e-4)
    assert np.allclose(G.kappa_ratios(1e-5, 1.0)[2:], (1 / 3, 1 / 6), atol=1e-4)
    assert np.allclose(G.kappa_ratios(1.0, 1.0)[2:], (0, 0), atol=1e-9)
    # no kappa law has this L-kurtosis: the generalised logistic takes its place
    assert G.kappa_fit(0.3, 0.2, 0.5)[2:] == (-0.2, -1.0)


def test_heterogeneity_tells_mixed_regions(spark):
    rng = np.random.default_rng(8)
    data, members = [], []
    for g in range(12):
        for d in range(8):
            cv = 0.2 if g < 8 or d % 2 else 0.6
            x = 1 + cv * (rng.gumbel(size=40) - 0.5772)
            data += [(f"{g}-{d}", float(v / x.mean())) for v in x]
            members.append((g, f"{g}-{d}"))
    got = {r["g"]: r["stat"] for r in R.hw_statistics(spark.createDataFrame(members, "g long, donor string"), spark.createDataFrame(data, "donor string, x double"), ["g"]).collect()}
    assert abs(np.mean([got[g] for g in range(8)])) < 1.0 and min(got[g] for g in range(8, 12)) > 3.0
    pools = R.homogeneous_pools(*(2 * [spark.createDataFrame([(f"8-{d}", float(d)) for d in range(8)], "point_id string, d1 double")]), ["d1"], spark.createDataFrame(data, "donor string, x double"), test="HW")
    assert pools.where("site = '8-0'").count() < 8


def test_rain_moments_do_not_depend_on_the_order(spark):
    rng = np.random.default_rng(3)
    values = [0.0, 0.0, 0.0, 12.374453, *rng.gamma(0.4, 20, 400).round(6)]
    out = []
    for seed in (1, 2):
        order = np.random.default_rng(seed).permutation(len(values))
        df = spark.createDataFrame([(1, datetime.date(2001, 5, 1 + int(i) % 30), float(values[i]), 1.0, 1.0, 1.0) for i in order], "point int, d date, prcp double, tmax double, tmin double, srad double")
        out.append(U.monthly_climate(df.repartition(7)).select("prcp_mean", "prcp_sd", "prcp_skew").first())
    x, n = np.array(values), len(values)
    m2, m3 = ((x - x.mean()) ** 2).mean(), ((x - x.mean()) ** 3).mean()
    assert out[0] == out[1] and np.allclose(out[0], (x.mean(), x.std(ddof=1), np.sqrt(n * (n - 1)) / (n - 2) * m3 / m2**1.5), rtol=1e-9)


def test_nested_totals_of_a_long_chain(spark):
    """A chain of 5,000 zones with side branches: one row per zone and round, no pairs of zones."""
    rng = np.random.default_rng(4)
    parent = {0: None} | {i: i - 1 for i in range(1, 5000)} | {5000 + i: int(rng.integers(0, 5000 + i)) for i in range(800)} | {9000: None}
    own = {i: int(rng.integers(1, 9)) for i in parent if i % 10}
    total, level = {}, {}
    for i in sorted(parent):
        level[i] = 0 if parent[i] is None else level[parent[i]] + 1
    for i in sorted(parent, key=level.get, reverse=True):
        total[i] = total.get(i, 0) + own.get(i, 0)
        if parent[i] is not None:
            total[parent[i]] = total.get(parent[i], 0) + total[i]
    tree = spark.createDataFrame(list(parent.items()), "child long, parent long")
    labels = spark.createDataFrame(list(own.items()), "label long, n long")
    got = {r["zone"]: r["n"] for r in T.rollup_nested(labels, tree, ["n"]).collect()}
    assert got == {i: t for i, t in total.items() if t}
    assert {r["zone"]: r["level"] for r in N.nesting_levels(tree).select("zone", "level").collect()} == level
    with pytest.raises(RuntimeError):
        T.tree_levels(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "child long, parent long"))
