"""Lookup tables of a project: loading to long form and joining onto cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hydrospark.functions import classes as K, hydraulics as H


def load_lookup(wide: DataFrame, class_col: str, value_cols: list[str], key_name: str = "column", value_name: str = "value",
                class_name: str = "class") -> DataFrame:
    """Wide table with comma lists of classes to (class, column, value); empty values are dropped."""
    long = wide.unpivot([class_col], value_cols, key_name, value_name).where(F.col(value_name).isNotNull())
    one = F.explode(F.split(F.col(class_col).cast("string"), ","))
    return long.select(one.alias("_c"), key_name, value_name).select(
        F.trim("_c").cast("int").alias(class_name), key_name, value_name
    )


def curve_number_table(wide: DataFrame, class_col: str) -> DataFrame:
    long = load_lookup(wide, class_col, ["A", "B", "C", "D"], "hsg_name", "cn", "nlcd")
    return long.select("nlcd", H.lookup(F.col("hsg_name"), K.SOIL_GROUPS).alias("hsg"), "cn")


def runoff_table(wide: DataFrame, class_col: str) -> DataFrame:
    """Columns c<group>_<slope class> to (nlcd, hsg, slope_cat, c)."""
    cols = [c for c in wide.columns if c != class_col]
    long = load_lookup(wide, class_col, cols, "name", "c", "nlcd")
    return long.select(
        "nlcd", F.regexp_extract("name", r"^c(\d)_", 1).cast("int").alias("hsg"),
        F.regexp_extract("name", r"^c\d_(.+)$", 1).alias("slope_cat"), "c",
    )


def join_curve_number(cells: DataFrame, table: DataFrame) -> DataFrame:
    return cells.join(table, ["nlcd", "hsg"], "left")


def join_runoff_coefficient(cells: DataFrame, table: DataFrame, slope_pct: str = "slope_pct") -> DataFrame:
    lut = table.select("nlcd", "hsg", "slope_cat", F.col("c").alias("c_runoff"))
    return cells.withColumn("slope_cat", K.slope_category(F.col(slope_pct))).join(lut, ["nlcd", "hsg", "slope_cat"], "left")


def susceptibility_code(text: Column) -> Column:
    return H.lookup(text, K.SUSCEPTIBILITY, 0)
