"""Cleaning of crossings and gauge series, and the filters that keep or drop whole features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from hydrospark.functions import hydraulics as H
from hydrospark.schema import has_column


def clean_na(df: DataFrame, numeric: list[str] | None = None, text: list[str] | None = None) -> DataFrame:
    """NA tokens to null; numeric columns that do not parse become null. One projection."""
    numeric = [c for c in (numeric or H.NUMERIC_COLUMNS) if has_column(df, c)]
    kinds = dict(df.dtypes)

    def number(c: str):
        """Columns that are numbers already only lose NaN; text is checked for tokens and parsed."""
        if kinds[c] in ("double", "float"):
            return F.nanvl(F.col(c), F.lit(None).cast("double"))
        return H.clean_number(F.col(c)) if kinds[c] == "string" else F.col(c).cast("double")

    new = {c: number(c) for c in numeric}
    new |= {c: H.clean_text(F.col(c)) for c in (text or []) if has_column(df, c)}
    return df.withColumns(new) if new else df


def standardise_shape(df: DataFrame, shape: str = "pour_sha", ref_compat: bool = False) -> DataFrame:
    if not has_column(df, shape):
        return df.withColumn(shape, F.lit("Circular"))
    return df.withColumn(shape, H.standard_shape(F.col(shape), ref_compat))


def fill_culvert_defaults(df: DataFrame, **override: float) -> DataFrame:
    """Defaults for group size, length, slope, roughness, entrance loss and hydraulic constants."""
    def given(name: str, default):
        return F.coalesce(F.col(name), F.lit(default)) if has_column(df, name) else F.lit(override.get(name, default))

    n_by_material = H.lookup(H.clean_text(F.col("material")), H.MATERIAL_N, 0.012) if has_column(df, "material") \
        else F.lit(override.get("n_manning", 0.012))
    ke_by_inlet = H.lookup(H.clean_text(F.col("inlet_type")), H.INLET_KE, 0.5) if has_column(df, "inlet_type") \
        else F.lit(override.get("ke", 0.5))
    n = F.coalesce(F.col("n_manning"), n_by_material) if has_column(df, "n_manning") else n_by_material
    ke = F.coalesce(F.col("ke"), ke_by_inlet) if has_column(df, "ke") else ke_by_inlet
    factor = H.lookup(H.clean_text(F.col("cond")), H.CONDITION_FACTOR, 1.0) if has_column(df, "cond") else F.lit(1.0)
    length = F.coalesce(F.col("l_ft") * H.FT_TO_M, F.lit(30.0)) if has_column(df, "l_ft") \
        else F.lit(override.get("l_m", 30.0))
    new = {
        "grp_size": given("grp_size", 1).cast("double"),
        "l_m": length,
        "culvert_sl": given("culvert_sl", 0.01),
        "n_manning": n * factor,
        "ke": ke,
    }
    new |= {k: given(k, v) for k, v in H.HYDRAULIC_DEFAULTS.items()}
    return df.withColumns(new)


def drop_all_null_columns(df: DataFrame, keep: list[str] | None = None, drop_rows: bool = True) -> DataFrame:
    """Remove columns without a value, then (optionally) rows with a null. One counting pass."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    cols = [c for c in df.columns if counts[c] > 0 or c in (keep or [])]
    out = df.select(*cols)
    return out.dropna() if drop_rows else out


def filter_zero_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) != 0))


def remove_outliers(df: DataFrame, column: str, method: str = "Zscore", z: float = 3.0,
                    site: str = "site") -> DataFrame:
    """Per site: |z-score| <= z (sample sd) or within 1.5 IQR (type-7 quantiles), else unchanged.

    The input is an annual series (one row per site and year), so a site's values number its years;
    the moments and quantiles are partial aggregates joined back, not a window over the site.
    """
    df = df.where(F.col(column).isNotNull())
    v = F.col(column)
    if method in ("Zscore", "Z-score", "z-score"):
        s = df.groupBy(site).agg(F.avg(v).alias("_m"), F.stddev_samp(v).alias("_s"))
        ok = F.col("_s").isNull() | (F.col("_s") == 0) | (F.abs(v - F.col("_m")) <= z * F.col("_s"))
        return df.join(s, site).where(ok).drop("_m", "_s")
    if method == "IQR":
        s = df.groupBy(site).agg(F.percentile(v, F.lit(0.25)).alias("_q1"), F.percentile(v, F.lit(0.75)).alias("_q3"))
        width = 1.5 * (F.col("_q3") - F.col("_q1"))
        return df.join(s, site).where(v.between(F.col("_q1") - width, F.col("_q3") + width)).drop("_q1", "_q3")
    return df


def filter_area(watersheds: DataFrame, points: DataFrame, min_area_ha: float = 2.0,
                key: str = "point_id") -> tuple[DataFrame, DataFrame]:
    """Watersheds of at least the given area, and the pour points that belong to them."""
    kept = watersheds.where(F.col("area_ha") >= min_area_ha)
    return kept, points.join(kept.select(key).distinct(), key, "left_semi")


def flag_outside_boundary(zone_cells: DataFrame, boundary_cells: DataFrame, cell_area_m2: float,
                          limit_ha: float = 0.5) -> DataFrame:
    """Zones whose area outside the (already buffered) boundary exceeds the limit."""
    outside = zone_cells.select("zone_id", "r", "c").distinct().join(boundary_cells.select("r", "c"), ["r", "c"], "left_anti")
    return (
        outside.groupBy("zone_id")
        .agg((F.count(F.lit(1)) * cell_area_m2 / 10_000.0).alias("outside_ha"))
        .where(F.col("outside_ha") > limit_ha)
    )


def split_flagged(zones: DataFrame, flagged: DataFrame, key: str = "zone_id") -> tuple[DataFrame, DataFrame]:
    ids = flagged.select(key)
    return zones.join(ids, key, "left_semi"), zones.join(ids, key, "left_anti")


def default_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add columns that are missing (null by default) and fill nulls of those present."""
    new = {}
    for c, v in defaults.items():
        if has_column(df, c):
            new[c] = F.coalesce(F.col(c), F.lit(v)) if v is not None else H.clean_text(F.col(c).cast("string"))
        else:
            new[c] = F.lit(v).cast("string") if v is None else F.lit(v)
    return df.withColumns(new)


CROSSING_ATTRIBUTES = [
    "point_name", "flag_gst", "grp_id", "grp_size", "rte_no", "milepost", "purpose", "gws_id",
    "pour_sha", "width_ft", "height_ft", "material", "cond",
]

# Road width in metres by highway class; other classes have none.
ROAD_WIDTH_M = {
    "motorway": 25, "trunk": 15, "primary": 12, "secondary": 10, "tertiary": 8, "residential": 6, "unclassified": 5,
}


def infer_road_width(df: DataFrame, highway: str = "highway", table: dict[str, int] | None = None) -> DataFrame:
    """Width from the first of a comma list of highway classes."""
    first = F.trim(F.element_at(F.split(F.regexp_replace(F.col(highway), r"[\[\]']", ""), ","), 1))
    return df.withColumn("road_width_m", H.lookup(first, table or ROAD_WIDTH_M))


def bbox(df: DataFrame, margin: float, x: str = "x", y: str = "y") -> DataFrame:
    """One-row bounding box with a margin."""
    return df.agg(
        (F.min(x) - margin).alias("min_x"), (F.max(x) + margin).alias("max_x"),
        (F.min(y) - margin).alias("min_y"), (F.max(y) + margin).alias("max_y"),
    )


def first_per_id(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per id by a stated order, as a partial aggregate rather than a window over the id."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])
