"""Work done per row of a result: powers of a simulated law, pairs written by a closure."""

import numpy as np

from hydrospark.functions import gev as G
from hydrospark.operators import frequency as Q, terrain as T


def plain(key, lengths, t, t3, t4, v, sims):
    """The heterogeneity with every quantile from the law's formula."""
    law, total, s1, s2 = G.kappa_fit(t, t3, t4), sum(lengths), 0.0, 0.0
    for i, n in enumerate(lengths):
        x = np.sort(G.kappa_quantile(G.uniforms((key + (i + 1) * 0x632BE59BD9B4E019) % 2**64, sims, n), *law), axis=1)
        cv = 2 * (x * (np.arange(n) / (n - 1))).mean(1) / x.mean(1) - 1
        s1, s2 = s1 + n * cv, s2 + n * cv * cv
    spread = np.sqrt(np.maximum(s2 / total - (s1 / total) ** 2, 0.0))
    return (v - spread.mean()) / spread.std(ddof=1)


def test_simulated_regions_need_few_powers(monkeypatch):
    lengths, seen = [4, 5, 33] + [60] * 7, []
    monkeypatch.setattr(G, "kappa_quantile", lambda p, *law, f=G.kappa_quantile: (seen.append(p.size), f(p, *law))[1])
    # heavy and light tails, bounded laws, the logistic that stands in, and laws near the Gumbel line
    for key, (t, t3, t4) in enumerate([(0.2, 0.15, 0.15), (0.3, 0.5, 0.3), (0.1, -0.2, 0.05), (0.2, 0.17, 0.4), (0.05, 0.0, 0.0), (0.2, 0.1699, 0.1504)]):
        seen.clear()
        got = G.heterogeneity(key * 977, lengths, t, t3, t4, 0.05, 200)
        assert sum(seen) < 0.1 * 200 * sum(lengths)
        assert abs(got - plain(key * 977, lengths, t, t3, t4, 0.05, 200)) < 1e-9 * max(1, abs(got))


def test_simulation_travels_without_the_package():
    # executors have numpy, not this package: what is sent may not name its modules as imports
    import pickletools

    from pyspark import cloudpickle
    for f in (G.heterogeneity_of(["k"], 5), G.bounds_of([2.0], 5, 5, 0.05, "GEV")):
        names = [str(arg) for op, arg, _ in pickletools.genops(cloudpickle.dumps(f, protocol=0)) if op.name == "GLOBAL"]
        assert names and not [n for n in names if n.startswith("hydrospark")]


def test_tabled_quantiles_hold_at_every_place():
    rng = np.random.default_rng(5)
    for t3, t4 in [(0.15, 0.15), (0.5, 0.3), (-0.3, 0.1), (0.0, 0.0), (0.3, 0.5)]:
        law = G.kappa_fit(0.2, t3, t4)
        p = np.sort(np.concatenate([rng.random(4000), np.arange(1, G.PIECES) / G.PIECES, [1e-12, 1 - 1e-12]]))[None]
        want = G.kappa_quantile(p, *law)
        got = G.kappa_sorted(p.copy(), law, G.kappa_pieces(*law), np.empty((2, *p.shape)))
        assert np.abs(got - want).max() <= 1e-11 * np.abs(want).max()


def test_closure_writes_each_pair_once(spark, monkeypatch):
    # a chain of 70, a tree beside it, and a child named twice
    tree = [(k, k + 1 if k < 69 else None) for k in range(70)] + [(k, 100 + (k - 100) // 3 if k > 102 else None) for k in range(101, 160)] + [(5, 6)]
    written = []
    monkeypatch.setattr(T, "cut", lambda df, f=T.cut: (written.append(out := f(df)), out)[1])
    got = T.ancestor_closure(spark.createDataFrame(tree, "child bigint, parent bigint"))
    rows = sorted(tuple(r) for r in got.select("node", "ancestor", "depth").collect())
    up = {}
    for c, p in tree:
        up.setdefault(c, []).append(p)
    want = []
    for c, p in tree:
        want.append((c, c, 0))
        at, d = ([p] if p is not None else []), 1
        while at:
            want += [(c, a, d) for a in at]
            at, d = [b for a in at for b in up.get(a, []) if b is not None], d + 1
    assert rows == sorted(want)
    assert sum(w.count() for w in written) == len(rows)


def test_bounds_of_regions_do_not_pass_through_the_driver(spark):
    params = spark.createDataFrame([(f"r{k}", 10.0 + k, 3.0, 0.02 * k) for k in range(12)], "region string, loc double, scale double, shape double")
    curve = Q.growth_curve(params, [2, 50], n_boot=20, draws=30)
    assert "Broadcast" not in curve._jdf.queryExecution().executedPlan().toString()
    rows = curve.collect()
    assert len(rows) == 24 and all(r.lower < r.upper for r in rows)
