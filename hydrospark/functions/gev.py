"""Likelihood fits of the generalised extreme value law for many short series at once.

The only Python on the data path: Spark forms one array per site (or bootstrap replicate) and
spreads the rows; the function below fits a batch of them together with numpy.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

# functions of this module travel with the job, so executors need numpy and pandas but not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIT = ("loc0 double, loc1 double, lsc0 double, lsc1 double, shape double, nll double, n int, k int, "
       "cov array<double>, converged boolean")
# columns of the parameter vector: location, location slope, log scale, log-scale slope, shape
MODELS = {"m0": [0, 2, 4], "m1": [0, 1, 2, 4], "m2": [0, 1, 2, 3, 4]}

# below -1 the likelihood has no maximum: the search stays on the regular side
SHAPE_MIN, SHAPE_MAX = -0.99, 5.0


def _derivatives(theta, x, c, mask):
    """Negative log likelihood per row, its gradient and its Hessian in all five parameters, in closed form."""
    plain, whole = not (theta[:, 1].any() or theta[:, 3].any() or c.any()), mask.all()
    if plain:
        scale = np.exp(-theta[:, 2, None])
        z = (x - theta[:, 0, None]) * scale
    else:
        scale = np.exp(-(theta[:, 2, None] + theta[:, 3, None] * c))
        z = (x - theta[:, 0, None] - theta[:, 1, None] * c) * scale
    xi = theta[:, 4, None]
    t = 1.0 + xi * z
    bad = (t <= 0) & mask
    t = np.where(t > 0, t, 1.0)
    small = np.abs(xi) < 1e-5
    safe = np.where(small, 1.0, xi)
    y = np.log(t) / safe
    zt = z / t
    a = (zt - y) / safe
    b = -(zt * zt + 2 * a) / safe
    if small.any():
        zz = z * z
        y, a, b = np.where(small, z - xi * zz / 2, y), np.where(small, -zz / 2 + 2 * xi * zz * z / 3, a), np.where(small, 2 * zz * z / 3, b)
    e = np.exp(np.clip(-y, -700, 700))
    slope = 1.0 + xi - e
    p = slope / t                                   # by z
    pz = (1.0 + xi) * (e - xi) / (t * t)            # by z twice
    px = (1.0 + e * a - z * p) / t                  # by z and shape
    if plain and whole:
        return _sums(theta, x.shape[1], scale[:, 0], xi[:, 0], z, y, e, a, b, slope, p, pz, px, bad)
    f = np.where(mask, (1.0 + xi) * y + e + theta[:, 2, None] + theta[:, 3, None] * c, 0.0).sum(1)
    f = np.where(bad.any(1) | ~np.isfinite(f), np.inf, f)
    held = lambda v: v if whole else np.where(mask, v, 0.0)
    # location, log scale, shape; a slope parameter adds a factor c
    first = [held(-scale * p), held(1.0 - z * p), held(y + slope * a)]
    second = {(0, 0): held(scale * scale * pz), (0, 1): held(scale * (p + z * pz)), (1, 1): held(z * p + z * z * pz),
              (0, 2): held(-scale * px), (1, 2): held(-z * px), (2, 2): held(2 * a + e * a * a + slope * b)}
    of, with_c = [0, 0, 1, 1, 2], [0, 1, 0, 1, 0]
    sums = {}

    def total(v, power, key):
        if plain and power:
            return 0.0
        if (key, power) not in sums:
            sums[key, power] = (v * c**power if power else v).sum(1)
        return sums[key, power]

    g = np.zeros((len(x), 5))
    h = np.zeros((len(x), 5, 5))
    for i in range(5):
        g[:, i] = total(first[of[i]], with_c[i], of[i])
        for j in range(i, 5):
            key = (min(of[i], of[j]), max(of[i], of[j]))
            h[:, i, j] = h[:, j, i] = total(second[key], with_c[i] + with_c[j], key)
    return f, g, h


def _sums(theta, n, scale, xi, z, y, e, a, b, slope, p, pz, px, bad):
    """What ``_derivatives`` returns where rows are full and nothing varies along them: scales leave the sums."""
    dot = lambda v, w: np.einsum("ij,ij->i", v, w)
    f = (1.0 + xi) * y.sum(1) + e.sum(1) + n * theta[:, 2]
    f = np.where(bad.any(1) | ~np.isfinite(f), np.inf, f)
    zp, zpz, sp = dot(z, p), z * pz, p.sum(1)
    zz = dot(z, zpz)
    g, h = np.zeros((len(z), 5)), np.zeros((len(z), 5, 5))
    g[:, 0], g[:, 2], g[:, 4] = -scale * sp, n - zp, y.sum(1) + dot(slope, a)
    h[:, 0, 0], h[:, 2, 2], h[:, 4, 4] = scale * scale * pz.sum(1), zp + zz, 2 * a.sum(1) + dot(e * a, a) + dot(slope, b)
    h[:, 0, 2] = h[:, 2, 0] = scale * (sp + zpz.sum(1))
    h[:, 0, 4] = h[:, 4, 0] = -scale * px.sum(1)
    h[:, 2, 4] = h[:, 4, 2] = -dot(z, px)
    return f, g, h


def fit_rows(x, c, mask, use, rounds=60, start=None, with_cov=True):
    """Damped Newton on standardised rows; returns parameters, nll and covariance in the units of x.

    ``start`` gives the parameters to begin at, for rows that are standardised already (by the law they
    were drawn from); their values are fitted as they are.
    """
    n = mask.sum(1)
    if start is None:
        mean = np.where(mask, x, 0).sum(1) / n
        sd = np.sqrt(np.where(mask, (x - mean[:, None]) ** 2, 0).sum(1) / np.maximum(n - 1, 1))
        sd = np.where(sd > 0, sd, 1.0)
        u = np.where(mask, (x - mean[:, None]) / sd[:, None], 0.0)
        theta = np.zeros((len(x), 5))
        theta[:, 2] = np.log(np.sqrt(6) / np.pi)
        theta[:, 0] = -0.5772156649 * np.exp(theta[:, 2])
        if 4 in use:
            theta[:, 4] = 0.05
    else:
        mean, sd, u, theta = np.zeros(len(x)), np.ones(len(x)), x, start.copy()
    f, g, hess = _derivatives(theta, u, c, mask)
    damp = np.full(len(x), 1e-2 if start is None else 1e-4)
    eye = np.eye(len(use))
    live = np.arange(len(x))
    for _ in range(rounds):
        gu, hu = g[live][:, use], hess[live][:, use][:, :, use]
        if 4 in use:
            # a shape held at its limit by the gradient stays there while the others move
            held = (theta[live, 4] <= SHAPE_MIN) & (gu[:, -1] > 0)
            gu[held, -1] = 0.0
            hu[held, -1, :], hu[held, :, -1], hu[held, -1, -1] = 0.0, 0.0, 1.0
        open_rows = (np.abs(gu).max(1) > 1e-7 * n[live]) & (damp[live] < 1e5)
        if not open_rows.any():
            break
        live, gu, hu = live[open_rows], gu[open_rows], hu[open_rows]
        # damped by each parameter's own curvature: near a law's end one of them may dwarf the others
        size = np.maximum(np.abs(hu[:, range(len(use)), range(len(use))]), 1e-8)
        try:
            step = np.linalg.solve(hu + (damp[live][:, None] * size)[:, :, None] * eye, -gu[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:
            damp[live] *= 10
            continue
        trial = theta[live]
        trial[:, use] += np.clip(step, -0.5, 0.5)
        trial[:, 4] = np.clip(trial[:, 4], SHAPE_MIN, SHAPE_MAX)
        f2, g2, h2 = _derivatives(trial, u[live], c if len(c) == 1 else c[live], mask[live])
        # at the optimum a step changes the likelihood by less than its rounding
        better = f2 <= f[live] + 1e-12 * np.abs(f[live])
        damp[live] = np.clip(np.where(better, damp[live] / 10, damp[live] * 8), 1e-14, 1e6)
        up = live[better]
        theta[up], f[up], g[up], hess[up] = trial[better], f2[better], g2[better], h2[better]
    held = (theta[:, 4] <= SHAPE_MIN) & (g[:, 4] > 0)
    ok = np.abs(np.where(held[:, None] & (np.arange(5) == 4), 0.0, g)[:, use]).max(1) < 1e-3 * n
    cov = None
    if with_cov:
        scale = np.ones((len(x), 5))
        scale[:, 0] = scale[:, 1] = sd
        unit = scale[:, use]
        cov = np.linalg.pinv(hess[:, use][:, :, use]) * unit[:, :, None] * unit[:, None, :]
    theta[:, 0] = theta[:, 0] * sd + mean
    theta[:, 1] *= sd
    theta[:, 2] += np.log(sd)
    return theta, f + n * np.log(sd), cov, ok


def uniforms(key: np.uint64, reps: int, draws: int) -> np.ndarray:
    """Uniforms in (0, 1) by place: a mix of the key, the replicate and the draw, so that nothing depends on partitions."""
    with np.errstate(over="ignore"):
        v = np.arange(1, reps * draws + 1, dtype=np.uint64)
        v *= np.uint64(0x9E3779B97F4A7C15)
        v += np.uint64(key)
        w = np.empty_like(v)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            v ^= np.right_shift(v, np.uint64(shift), out=w)
            v *= np.uint64(factor)
        v ^= np.right_shift(v, np.uint64(31), out=w)
    u = np.right_shift(v, np.uint64(12), out=w).astype(float).reshape(reps, draws)
    u += 0.5
    u *= 2.0**-52
    return u


def quantile(p, loc, scale, shape):
    y = -np.log(p)
    flat = np.abs(shape) < 1e-6
    return loc + scale * np.where(flat, -np.log(y), (y**-shape - 1) / np.where(flat, 1.0, shape))


def bootstrap_bounds(key: int, loc: float, scale: float, shape: float, rps: list[float], reps: int, draws: int, sig: float, dist: str) -> np.ndarray:
    """Lower and upper bound of each return period's quantile over parametric replicates of one law.

    Draws are of the law with location 0 and scale 1, which every fit starts from: fits move with
    location and scale, so the quantiles are brought to the law's units at the end.
    """
    use = [0, 2, 4] if dist == "GEV" else [0, 2]
    x = quantile(uniforms(key, reps, draws), 0.0, 1.0, shape)
    start = np.zeros((reps, 5))
    start[:, 4] = np.clip(shape, SHAPE_MIN, SHAPE_MAX) if dist == "GEV" else 0.0
    theta, _, _, _ = fit_rows(x, np.zeros((1, 1)), np.ones_like(x, bool), use, start=start, with_cov=False)
    fitted = theta[:, 4] if dist == "GEV" else np.full(reps, 1e-8)
    q = np.stack([quantile(1 - 1 / rp, theta[:, 0], np.exp(theta[:, 2]), fitted) for rp in rps])
    return loc + scale * np.quantile(q, [sig / 2, 1 - sig / 2], axis=1).T


def bounds_of(rps: list[float], reps: int, draws: int, sig: float, dist: str):
    """Function for ``mapInArrow``: rows (region, key, loc, scale, shape) to rows (region, rp, lower, upper)."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                key, loc, scale, shape = (b.column(c)[r].as_py() for c in ("key", "loc", "scale", "shape"))
                if None in (loc, scale, shape):
                    continue
                got = bootstrap_bounds(key % 2**64, loc, scale, shape, rps, reps, draws, sig, dist)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([r] * len(rps))), pa.array([float(p) for p in rps]), pa.array(got[:, 0]), pa.array(got[:, 1])],
                    names=[b.schema.names[0], "rp", "lower", "upper"])

    return run


def fit_udf(model: str = "m0", dist: str = "GEV") -> Callable[[Column, Column], Column]:
    """Vectorised fit of (values, covariate) arrays; covariates are ignored by m0, Gumbel has no shape."""
    use = [k for k in MODELS[model] if dist == "GEV" or k != 4]

    @F.pandas_udf(FIT)
    def fit(values: pd.Series, covariates: pd.Series) -> pd.DataFrame:
        parts = []
        for a in range(0, len(values), 512):
            rows = [np.asarray(v, dtype=float) for v in values.iloc[a:a + 512]]
            covs = [np.asarray(v, dtype=float) for v in covariates.iloc[a:a + 512]]
            width = max((len(r) for r in rows), default=0)
            x, c = np.zeros((len(rows), width)), np.zeros((len(rows), width))
            mask = np.zeros((len(rows), width), dtype=bool)
            for i, (r, cv) in enumerate(zip(rows, covs)):
                x[i, :len(r)], mask[i, :len(r)] = r, True
                c[i, :len(cv)] = cv
            enough = mask.sum(1) > len(use)
            mask_fit = np.where(enough[:, None], mask, False)
            mask_fit[~enough, 0] = True
            theta, nll, cov, ok = fit_rows(x, c, mask_fit, use)
            ok = ok & enough
            out = pd.DataFrame(theta, columns=["loc0", "loc1", "lsc0", "lsc1", "shape"])
            if dist != "GEV":
                out["shape"] = 1e-8
            out["nll"], out["n"], out["k"] = nll, mask.sum(1).astype("int32"), np.int32(len(use))
            full = np.zeros((len(rows), 5, 5))
            full[np.ix_(range(len(rows)), use, use)] = cov
            out["cov"] = list(full.reshape(len(rows), 25))
            out.loc[~enough, ["loc0", "loc1", "lsc0", "lsc1", "shape", "nll"]] = np.nan
            out["converged"] = ok
            parts.append(out)
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()

    return fit


# Scholz and Stephens (1987), critical point of the k-sample Anderson-Darling test
# as b0 + b1 / sqrt(k - 1) + b2 / (k - 1), by confidence.
AD_CRITICAL = {
    0.75: (0.675, -0.245, -0.105), 0.90: (1.281, 0.25, -0.305), 0.95: (1.645, 0.678, -0.362),
    0.975: (1.960, 1.149, -0.391), 0.99: (2.326, 1.822, -0.396),
}


def ad_statistic(samples: list[np.ndarray]) -> float:
    """Standardised k-sample Anderson-Darling statistic."""
    n = np.array([len(s) for s in samples], dtype=float)
    big = int(n.sum())
    pooled = np.sort(np.concatenate(samples))
    j = np.arange(1, big)
    a2 = 0.0
    for s, m in zip(samples, n):
        below = np.searchsorted(np.sort(s), pooled[:-1], side="right")
        a2 += ((big * below - j * m) ** 2 / (j * (big - j))).sum() / m
    a2 /= big
    k = len(samples)
    inv = 1.0 / np.arange(1, big)
    h, hs = inv.sum(), (1.0 / n).sum()
    g = ((h - inv.cumsum()[:big - 2]) / (big - np.arange(1, big - 1))).sum()
    a = (4 * g - 6) * (k - 1) + (10 - 6 * g) * hs
    b = (2 * g - 4) * k**2 + 8 * h * k + (2 * g - 14 * h - 4) * hs - 8 * h + 4 * g - 6
    c = (6 * h + 2 * g - 2) * k**2 + (4 * h - 4 * g + 6) * k + (2 * h - 6) * hs + 4 * h
    d = (2 * h + 6) * k**2 - 4 * h * k
    var = (a * big**3 + b * big**2 + c * big + d) / ((big - 1.0) * (big - 2) * (big - 3))
    return (a2 - (k - 1)) / np.sqrt(var)



# ---- heterogeneity of L-moment ratios (Hosking and Wallis 1997, chapter 4.3)


def kappa_ratios(k: float, h: float) -> tuple[float, float, float, float] | None:
    """(g1 - 1) / k and (g1 - g2) / k for scale 1 and location 0, and L-skewness and L-kurtosis of the kappa law; None outside its domain."""
    if k <= -1 or (h < 0 and k * h >= 1) or (h < 0 and -k - 4 / h <= 0):
        return None
    g = []
    for r in range(1, 5):
        if abs(h) < 1e-6:
            g.append(math.exp(math.lgamma(1 + k) - k * math.log(r)))
        elif h > 0:
            g.append(math.exp(math.log(r) + math.lgamma(1 + k) + math.lgamma(r / h) - (1 + k) * math.log(h) - math.lgamma(1 + k + r / h)))
        else:
            g.append(math.exp(math.log(r) + math.lgamma(1 + k) + math.lgamma(-k - r / h) - (1 + k) * math.log(-h) - math.lgamma(1 - r / h)))
    d = g[0] - g[1]
    if abs(k) < 1e-9 or d == 0:
        return None
    return (1 - g[0]) / k, d / k, (-g[0] + 3 * g[1] - 2 * g[2]) / d, (g[0] - 6 * g[1] + 10 * g[2] - 5 * g[3]) / d


def kappa_fit(t: float, t3: float, t4: float) -> tuple[float, float, float, float]:
    """Location, scale and both shapes of the kappa law with mean 1 and these L-moment ratios, by Newton's method.

    Where no such law exists (L-kurtosis above the generalised logistic's, or no convergence) the generalised logistic
    with this L-skewness takes its place, as its authors advise.
    """
    def logistic():
        k, h = (-t3 if abs(t3) > 1e-6 else 1e-6), -1.0
        return k, h

    k, h = logistic()
    if t4 < (5 * t3 * t3 + 1) / 6:
        k, h = (1 - 3 * t3) / (1 + t3), 1.001
        k = k if abs(k) > 1e-6 else 1e-6
        for _ in range(60):
            now = kappa_ratios(k, h)
            if now is None:
                break
            e = np.array([now[2] - t3, now[3] - t4])
            if np.abs(e).max() < 1e-9:
                break
            d = 1e-6
            right, up = kappa_ratios(k + d, h), kappa_ratios(k, h + d)
            if right is None or up is None:
                now = None
                break
            jac = np.array([[right[2] - now[2], up[2] - now[2]], [right[3] - now[3], up[3] - now[3]]]) / d
            try:
                step = np.linalg.solve(jac, -e)
            except np.linalg.LinAlgError:
                now = None
                break
            size = 1.0
            # half steps until the law exists and fits better
            while size > 1e-4:
                trial = kappa_ratios(k + size * step[0], h + size * step[1])
                if trial is not None and max(abs(trial[2] - t3), abs(trial[3] - t4)) < np.abs(e).max():
                    break
                size /= 2
            else:
                now = None
                break
            k, h = k + size * step[0], h + size * step[1]
        now = kappa_ratios(k, h)
        if now is None or max(abs(now[2] - t3), abs(now[3] - t4)) > 1e-6:
            k, h = logistic()
    mean, l2, _, _ = kappa_ratios(k, h)
    scale = t / l2
    return 1 - scale * mean, scale, k, h


def kappa_quantile(p: np.ndarray, loc: float, scale: float, k: float, h: float) -> np.ndarray:
    y = -np.log(p) if abs(h) < 1e-6 else (1 - p**h) / h
    return loc + scale * (1 - y**k) / k


#: Pieces of a tabled quantile function, and how many of them at each end are left to the function itself.
PIECES, ENDS = 8192, 256


def kappa_pieces(loc: float, scale: float, k: float, h: float) -> np.ndarray:
    """Cubics of the law's quantile function over ``PIECES`` equal pieces of (0, 1), by values and slopes at their ends.

    The error falls with the fourth power of the distance from an end: beyond ``ENDS`` pieces it is some 1e-12 of the value.
    """
    p = np.arange(ENDS, PIECES - ENDS + 1) / PIECES
    a = np.log(p)
    ph = np.exp(h * a)
    y = -a if abs(h) < 1e-6 else (1 - ph) / h
    yk = np.exp(k * np.log(y))
    x, d = loc + scale * (1 - yk) / k, scale * yk / y * (1.0 if abs(h) < 1e-6 else ph) / p / PIECES
    rise = np.diff(x)
    out = np.zeros((4, PIECES))
    out[:, ENDS:PIECES - ENDS] = x[:-1], d[:-1], 3 * rise - 2 * d[:-1] - d[1:], d[:-1] + d[1:] - 2 * rise
    return out


def kappa_sorted(p: np.ndarray, law: tuple[float, float, float, float], pieces: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Quantiles of sorted rows of uniforms, from the law's cubics but for the outer ones; ``spare`` holds two arrays like ``p``."""
    x, term = spare
    at = np.multiply(p, PIECES, out=p)
    piece = at.astype(np.intp)
    outer = np.flatnonzero((piece < ENDS) | (piece >= PIECES - ENDS))
    ends = kappa_quantile(at.ravel()[outer] / PIECES, *law)
    at -= piece
    np.take(pieces[3], piece, out=x, mode="clip")
    for c in pieces[2::-1]:
        x *= at
        x += np.take(c, piece, out=term, mode="clip")
    x.ravel()[outer] = ends
    return x


def heterogeneity(key: int, lengths: list[int], t: float, t3: float, t4: float, v: float, sims: int) -> float:
    """H: how far the spread ``v`` of the sites' L-CV lies above that of simulated homogeneous regions, in their standard deviations.

    Sites are simulated one after the other, so what is held is ``sims`` records of one site. Quantiles rise with
    their uniforms, so these are sorted; all but the outer ones come from the law's cubics, as powers take most of the time.
    """
    law = kappa_fit(t, t3, t4)
    # laws at the rim of the domain have terms that cancel: they keep the plain formula
    pieces = kappa_pieces(*law) if abs(law[1]) < 100 else None
    total, s1, s2, spare = float(sum(lengths)), np.zeros(sims), np.zeros(sims), np.empty((2, 0, 0))
    for i, n in enumerate(lengths):
        p = uniforms((key + (i + 1) * 0x632BE59BD9B4E019) % 2**64, sims, n)
        if pieces is None:
            x = np.sort(kappa_quantile(p, *law), axis=1)
        else:
            p.sort(axis=1)
            spare = spare if spare.shape[1:] == p.shape else np.empty((2, *p.shape))
            x = kappa_sorted(p, law, pieces, spare)
        b0 = x.mean(1)
        b1 = (x * (np.arange(n) / (n - 1))).mean(1) if pieces is None else np.einsum("ij,j->i", x, np.arange(n) / (n * (n - 1.0)))
        cv = (2 * b1 - b0) / b0
        s1 += n * cv
        s2 += n * cv * cv
    spread = np.sqrt(np.maximum(s2 / total - (s1 / total) ** 2, 0.0))
    sd = spread.std(ddof=1)
    return float((v - spread.mean()) / sd) if sd > 0 else math.inf


def heterogeneity_of(names: list[str], sims: int):
    """Function for ``mapInArrow``: rows (names, key, lengths, t, t3, t4, v) to rows (names, stat)."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = b.select(["key", "lengths", "t", "t3", "t4", "v"]).to_pylist()
            stat = [heterogeneity(r["key"] % 2**64, r["lengths"], r["t"], r["t3"], r["t4"], r["v"], sims) for r in rows]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(stat, pa.float64())], names=[*names, "stat"])

    return run
