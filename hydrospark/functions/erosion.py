"""Soil-loss factors and soil parameters as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

K_TO_SI = 0.1317


def r_factor(pi30_milli_in: Column) -> Column:
    """Rain erosivity from the 100-year 30-minute rain (inch x 1000)."""
    i = pi30_milli_in * 0.0508
    energy = F.when(i <= 0, 0.0).when(i <= 76, 0.119 + 0.0873 * F.log10(F.greatest(i, F.lit(1e-300)))).when(i > 76, 0.283)
    return energy * i


def slope_exponent(slope_pct: Column) -> Column:
    return F.when(slope_pct < 1, 0.2).when(slope_pct < 3, 0.3).when(slope_pct < 5, 0.4).when(slope_pct >= 5, 0.5)


def ls_factor(slope: Column, acc: Column, cell_m: float) -> Column:
    """Length-steepness factor from rise over run and accumulation in cells."""
    run = acc * cell_m
    length = F.when(run > 0, F.pow(run / 22.13, slope_exponent(slope * 100))).otherwise(1.0)
    sine = F.sin(F.atan(slope))
    return length * (65.41 * sine * sine + 4.56 * sine + 0.065)


def ndvi_scale(v: Column) -> Column:
    return v / 10_000.0


def c_factor(ndvi: Column, alpha: float = 2.0, beta: float = 1.0) -> Column:
    raw = F.when(ndvi >= beta, 0.01).otherwise(F.exp(F.try_divide(-alpha * ndvi, beta - ndvi)))
    return F.when(ndvi.isNotNull(), F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


def soil_loss(r: Column, k: Column, ls: Column, c: Column, p: float = 1.0) -> Column:
    """t/ha/yr where every factor is known."""
    return r * (k * K_TO_SI) * ls * c * p


def soil_params(kffact: Column, clay: Column) -> dict[str, Column]:
    """Interrill and rill erodibility, critical shear and conductivity, with the usual defaults."""
    k, cl = F.coalesce(kffact, F.lit(0.20)), F.coalesce(clay, F.lit(20.0))
    return {
        "ki": k * 2_728_000,
        "kr": F.lit(0.00197 + 0.00030 * 15) + 0.03863 * F.exp(F.lit(-1.84 * 2.0)),
        "critical_shear": F.lit(2.67 + 0.065 * 20 - 0.058 * 15),
        "conductivity": F.when(cl <= 40, F.lit(-0.265) + 0.0086 * F.pow(F.lit(15.0), F.lit(1.8)) + 11.46 * F.pow(F.lit(10.0), F.lit(-0.75)))
        .otherwise(0.0066 * F.exp(F.try_divide(F.lit(244.0), cl))),
    }
