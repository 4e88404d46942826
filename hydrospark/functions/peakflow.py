"""Peak-discharge formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The 19 storm durations of the frequency tables, in minutes.
DURATIONS_MIN = [
    5.0, 10.0, 15.0, 30.0, 60.0, 120.0, 180.0, 360.0, 720.0, 1440.0,
    2880.0, 4320.0, 5760.0, 10080.0, 14400.0, 28800.0, 43200.0, 64800.0, 86400.0,
]
RETURN_PERIODS = [2, 5, 10, 25, 50, 100, 200, 500, 1000]
# Published unit-peak coefficients (Ia/P, C0, C1, C2) by rainfall distribution type.
UNIT_PEAK = {
    "I": [
        (0.10, 2.30550, -0.51429, -0.11750), (0.20, 2.23537, -0.50387, -0.08929),
        (0.25, 2.18219, -0.48488, -0.06589), (0.30, 2.10624, -0.45695, -0.02835),
        (0.35, 2.00303, -0.40769, 0.01983), (0.40, 1.87733, -0.32274, 0.05754),
        (0.45, 1.76312, -0.15644, 0.00453), (0.50, 1.67889, -0.06930, 0.0),
    ],
    "IA": [
        (0.10, 2.03250, -0.31583, -0.13748), (0.20, 1.91978, -0.28215, -0.07020),
        (0.25, 1.83842, -0.25543, -0.02597), (0.30, 1.72657, -0.19826, 0.02633),
        (0.50, 1.63417, -0.09100, 0.0),
    ],
    "II": [
        (0.10, 2.55323, -0.61512, -0.16403), (0.30, 2.46532, -0.62257, -0.11657),
        (0.35, 2.41896, -0.61594, -0.08820), (0.40, 2.36409, -0.59857, -0.05621),
        (0.45, 2.29238, -0.57005, -0.02281), (0.50, 2.20282, -0.51599, -0.01259),
    ],
    "III": [
        (0.10, 2.47317, -0.51848, -0.17083), (0.30, 2.39628, -0.51202, -0.13245),
        (0.35, 2.35477, -0.49735, -0.11985), (0.45, 2.24876, -0.41314, -0.11508),
        (0.50, 2.17772, -0.36803, -0.09525),
    ],
}
WET_KNOTS = [(0.0, 1.00), (0.2, 0.97), (1.0, 0.87), (3.0, 0.75), (5.0, 0.72)]
PERIOD_FACTOR = {25: 1.1, 50: 1.2, 100: 1.25}
IN_TO_MM_DEPTH = 25.400013716
MM_TO_IN = 0.0393701
HA_TO_ACRE = 2.47105
FT3_TO_M3 = 0.02831683199881
SERIES_FACTOR = 0.393701 * 2.47105 * 0.0283168


def nearest_duration(tc_min: Column) -> Column:
    """Closest of the fixed durations; a tie goes to the shorter one."""
    gaps = [F.struct(F.abs(tc_min - d).alias("gap"), F.lit(d).alias("dur")) for d in DURATIONS_MIN]
    return F.when(tc_min.isNotNull(), F.array_min(F.array(*gaps))["dur"])


def interpolate(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise-linear through fixed knots, clamped at both ends."""
    out = F.when(x <= knots[0][0], F.lit(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(x <= x1, F.lit(y0) + (x - x0) / (x1 - x0) * (y1 - y0))
    return out.when(x > knots[-1][0], F.lit(knots[-1][1]))


def wetland_share(wet_ha: Column, area_ha: Column) -> Column:
    """Wetland percent of the area held within 0 and 5."""
    share = F.try_divide(wet_ha, area_ha) * 100
    return F.when(share.isNotNull(), F.least(F.greatest(share, F.lit(0.0)), F.lit(5.0)))


def wetland_factor(share_pct: Column) -> Column:
    return interpolate(share_pct, WET_KNOTS)


def retention_mm(cn: Column) -> Column:
    return (1 / 0.0394) * (F.try_divide(F.lit(1000.0), cn) - 10)


def initial_abstraction(cn: Column) -> Column:
    """Inches."""
    return 0.2 * retention_mm(cn) * MM_TO_IN


def runoff_depth(p_in: Column, cn: Column, ref_compat: bool = False) -> Column:
    """Runoff in cm from rain in inches; zero when rain does not exceed the initial abstraction."""
    s = retention_mm(cn)
    p = p_in * IN_TO_MM_DEPTH
    r = F.try_divide((p - 0.2 * s) * (p - 0.2 * s), p + 0.8 * s) * 0.1
    return r if ref_compat else F.when(p <= 0.2 * s, F.lit(0.0)).otherwise(r)


def unit_coefficient(kind: Column, ratio: Column, index: int) -> Column:
    """C0, C1 or C2 (index 0..2) interpolated in Ia/P for the rainfall type."""
    out = None
    for name, rows in UNIT_PEAK.items():
        curve = interpolate(ratio, [(r[0], r[index + 1]) for r in rows])
        out = F.when(kind == name, curve) if out is None else out.when(kind == name, curve)
    return out


def rain_type_or_default(kind: Column) -> Column:
    return F.when(kind.isin(*UNIT_PEAK), kind).otherwise(F.lit("II"))


def unit_peak(ia_in: Column, p_in: Column, tc_hr: Column, kind: Column) -> Column:
    """Unit peak discharge (m3/s per cm per km2); null for input that has no meaning."""
    ok = unit_peak_error(ia_in, p_in, tc_hr, kind).isNull()
    ratio = F.try_divide(ia_in, p_in)
    c0, c1, c2 = (unit_coefficient(kind, ratio, i) for i in range(3))
    return unit_peak_from(ok, F.log10(F.when(ok, tc_hr)), c0, c1, c2)


def unit_peak_from(ok: Column, log_tc: Column, c0: Column, c1: Column, c2: Column) -> Column:
    return F.when(ok, F.pow(F.lit(10.0), c0 + c1 * log_tc + c2 * log_tc * log_tc - 2.366))


def unit_peak_error(ia_in: Column, p_in: Column, tc_hr: Column, kind: Column) -> Column:
    return (
        F.when(tc_hr.isNull() | (tc_hr <= 0), F.lit("tc"))
        .when(p_in.isNull() | (p_in <= 0), F.lit("p"))
        .when(ia_in.isNull() | (ia_in < 0), F.lit("ia"))
        .when(kind.isNull() | ~kind.isin(*UNIT_PEAK), F.lit("type"))
    )


def q_graphical(unit: Column, runoff_cm: Column, area_ha: Column, wet_factor: Column) -> Column:
    return F.round(unit * runoff_cm * area_ha * 0.01 * wet_factor, 2)


def area_reduction(duration_hr: Column, area_ha: Column) -> Column:
    e = -1.1 * F.pow(duration_hr, F.lit(0.25))
    return 1 - F.exp(e) + F.exp(e - 2.59e-2 * area_ha * 0.01)


def period_factor(rp: Column) -> Column:
    out = F.lit(1.0)
    for p, f in PERIOD_FACTOR.items():
        out = F.when(rp == p, F.lit(f)).otherwise(out)
    return out


def q_rational(factor: Column, c: Column, intensity_in_hr: Column, area_ha: Column) -> Column:
    """m3/s, two decimals, from an areal intensity in inches per hour."""
    return F.round(factor * c * intensity_in_hr * (area_ha * HA_TO_ACRE) * FT3_TO_M3, 2)


def q_rational_series(c: Column, intensity_cm_hr: Column, area_ha: Column) -> Column:
    return intensity_cm_hr * c * area_ha * SERIES_FACTOR


def event_runoff_c(flow: Column, area_km2: Column, pi_cm_hr: Column) -> Column:
    return F.try_divide(F.try_divide(flow, area_km2) * 0.143, pi_cm_hr / 2.54)


def time_of_concentration(overland_m: Column, channel_m: Column, slope_pct: Column) -> tuple[Column, Column, Column]:
    """Overland, channel and total minutes (two decimals); null when the slope is zero."""
    s = F.when(slope_pct > 0, slope_pct / 100)
    tov = 1.44 * F.pow(overland_m * 0.8, F.lit(0.467)) * F.pow(s, F.lit(-0.235))
    tch = 0.0195 * F.pow(channel_m, F.lit(0.770)) * F.pow(s, F.lit(-0.385))
    return F.round(tov, 2), F.round(tch, 2), F.round(tov + tch, 2)


def validate_return_periods(rps: list[float]) -> list[float]:
    if len(rps) > 10:
        raise ValueError("at most 10 return periods")
    bad = [r for r in rps if r <= 1 or r > 1000]
    if bad:
        raise ValueError(f"return periods must be in (1, 1000]: {bad}")
    return list(rps)
