"""Culvert geometry and capacity formulas as column expressions (ft, cfs unless said otherwise)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Must equal the published HDS-5 style defaults for right results.
NA_TOKENS = ["na", "NA", "NaN", '"NA"', "null", "NULL", "", " ", "None", "NONE"]
NUMERIC_COLUMNS = [
    "width_ft", "height_ft", "grp_size", "l_ft", "culvert_sl", "hw_ft", "tw_ft", "n_manning", "ke",
    "y", "ks", "c", "cd_orifice", "cw_weir", "k_inlet", "m_inlet", "c_inlet", "y_inlet",
]
SHAPES = ["Circular", "Box", "Pipe arch", "Elliptical", "Arch"]
SHAPE_SYNONYMS = {
    "Circle": "Circular", "Round": "Circular", "Pipe": "Circular",
    "Rectangle": "Box", "Rectangular": "Box", "Square": "Box",
    "Pipearch": "Pipe arch", "Pipe_Arch": "Pipe arch", "Pipetoarch": "Pipe arch",
    "Oval": "Elliptical", "Ellipse": "Elliptical",
}
MATERIAL_N = {
    "Concrete": 0.012, "Steel": 0.024, "HDPE": 0.009, "Aluminum": 0.024, "Plastic": 0.009, "CMP": 0.024,
}
INLET_KE = {"Square_Edge": 0.5, "Grooved_End": 0.2, "Beveled": 0.2, "Projecting": 0.9, "Mitered": 0.7}
CONDITION_FACTOR = {"Good": 1.0, "Fair": 1.1, "Poor": 1.3}
HYDRAULIC_DEFAULTS = {
    "y": 0.6, "ks": -0.5, "c": 0.038, "cd_orifice": 0.62, "cw_weir": 3.0,
    "k_inlet": 0.0098, "m_inlet": 2.0, "c_inlet": 0.0398, "y_inlet": 0.67,
}
G_FT = 32.2
CFS_TO_CMS = 0.0283168
FT_TO_M = 0.3048
METHODS = ["orifice_flow", "inlet_control", "outlet_control", "manning_uniform"]


def lookup(key: Column, table: dict, default=None) -> Column:
    """Fixed small table as a map literal: no join, stays in code generation."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def clean_text(c: Column) -> Column:
    return F.when(~c.isin(NA_TOKENS), c)


def clean_number(c: Column) -> Column:
    """NA tokens and anything that is not a number become null; NaN is never kept."""
    v = clean_text(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(v), v)


def standard_shape(c: Column, ref_compat: bool = False) -> Column:
    """Title-case, synonyms, unknown to Circular. 'Pipe Arch' is accepted unless ``ref_compat``."""
    titled = F.initcap(F.regexp_replace(F.trim(clean_text(c)), "_", "_ "))
    titled = F.regexp_replace(titled, "_ ", "_")
    synonyms = dict(SHAPE_SYNONYMS)
    if not ref_compat:
        synonyms["Pipe Arch"] = "Pipe arch"
    mapped = F.coalesce(lookup(titled, synonyms), titled)
    return F.when(mapped.isin(SHAPES), mapped).otherwise(F.lit("Circular"))


def valid_dimensions(shape: Column, w: Column, h: Column) -> Column:
    return F.when(shape == "Circular", w.isNotNull()).otherwise(w.isNotNull() & h.isNotNull())


def characteristic_depth(shape: Column, w: Column, h: Column) -> Column:
    return F.when(shape == "Circular", w).otherwise(F.when(w.isNotNull(), h))


def culvert_area(shape: Column, w: Column, h: Column) -> Column:
    return (
        F.when(shape == "Circular", F.pi() * (w / 2) * (w / 2))
        .when(shape == "Box", w * h)
        .when(shape.isin("Pipe arch", "Elliptical"), F.pi() * w * h / 4)
        .when(shape == "Arch", F.lit(2.0 / 3.0) * w * h)
    )


def hydraulic_radius(shape: Column, w: Column, h: Column) -> Column:
    a, b = w / 2, h / 2
    perimeter = F.pi() * (3 * (a + b) - F.sqrt((3 * a + b) * (a + 3 * b)))
    return (
        F.when(shape == "Circular", w / 4)
        .when(shape == "Box", F.try_divide(w * h, 2 * (w + h)))
        .otherwise(F.try_divide(culvert_area(shape, w, h), perimeter))
    )


def root_or_null(x: Column) -> Column:
    """Square root; a negative argument has no capacity and gives null, not NaN."""
    return F.when(x >= 0, F.sqrt(F.greatest(x, F.lit(0.0))))


def q_orifice(cd: Column, area: Column, n: Column, depth: Column, hw: Column | None = None) -> Column:
    head = 1.2 * depth if hw is None else F.coalesce(hw, 1.2 * depth)
    return cd * area * n * root_or_null(2 * G_FT * head)


def q_inlet(area: Column, n: Column, depth: Column, y: Column, ks: Column, c: Column, slope: Column,
            hw: Column | None = None) -> Column:
    head = 1.5 * depth if hw is None else F.coalesce(hw, 1.5 * depth)
    ratio = F.try_divide(head, depth)
    rise = F.when(ratio <= 1.2, ratio - y + ks * slope).otherwise(ratio - y)
    return area * F.sqrt(depth) * root_or_null(F.try_divide(rise, c)) * n


def q_outlet(area: Column, n: Column, depth: Column, radius: Column, ke: Column, manning: Column,
             slope: Column, length_m: Column, hw: Column | None = None, tw: Column | None = None) -> Column:
    head = 1.5 * depth if hw is None else F.coalesce(hw, 1.5 * depth)
    tail = 0.5 * depth if tw is None else F.coalesce(tw, 0.5 * depth)
    length = length_m / FT_TO_M
    available = head - F.greatest(tail, depth) + slope * length
    loss = 1 + ke + F.try_divide(29.2 * manning * manning * length, F.pow(radius, F.lit(4.0 / 3.0)))
    return area * root_or_null(F.try_divide(2 * G_FT * available, loss)) * n


def q_manning(area: Column, n: Column, radius: Column, manning: Column, slope: Column) -> Column:
    return F.try_divide(F.lit(1.49), manning) * area * F.pow(radius, F.lit(2.0 / 3.0)) * root_or_null(slope) * n


def cfs_to_cms(q: Column) -> Column:
    return q * CFS_TO_CMS


def vulnerability(capacity: Column, peak: Column) -> Column:
    return F.when(
        capacity.isNotNull() & peak.isNotNull(),
        F.when(capacity >= peak, F.lit("Not Vulnerable")).otherwise(F.lit("Vulnerable")),
    )
