"""Distribution functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Abramowitz and Stegun 7.1.26.
ERF_P = 0.3275911
ERF_A = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
# Lanczos coefficients, g = 7.
LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]
EULER = 0.5772156649015329


def erfc_abs(x: Column) -> Column:
    """erfc(|x|), absolute error below 1.5e-7."""
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return poly * F.exp(-x * x)


def two_sided_p(z: Column) -> Column:
    return erfc_abs(z / math.sqrt(2))


def chi2_sf(x: Column, df: int) -> Column:
    """Upper tail for one or two degrees of freedom."""
    x = F.greatest(x, F.lit(0.0))
    return erfc_abs(F.sqrt(x / 2)) if df == 1 else F.exp(-x / 2)


def gamma(z: Column) -> Column:
    """Gamma function for z > 0.5 (Lanczos)."""
    x = z - 1
    s = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        s = s + F.lit(c) / (x + i)
    t = x + 7.5
    return math.sqrt(2 * math.pi) * F.pow(t, x + 0.5) * F.exp(-t) * s


def gev_quantile(p: Column, loc: Column, scale: Column, shape: Column) -> Column:
    """Quantile of the generalised extreme value law (shape > 0 is the heavy tail); Gumbel near zero."""
    y = -F.ln(p)
    return F.when(F.abs(shape) < 1e-7, loc - scale * F.ln(y)).otherwise(
        loc + scale * (F.pow(y, -shape) - 1) / F.when(F.abs(shape) < 1e-7, F.lit(1.0)).otherwise(shape)
    )
