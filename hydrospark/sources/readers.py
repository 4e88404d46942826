"""Readers of feature, grid, series, climate and text inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from hydrospark import schema as SC

STORE_TILE = 4096
SERIES_NAME = r"(full|ams)_(stream|precip)_series_([^/.=]+)"


def scan_features(spark: SparkSession, path: str, schema: str | None = None, bbox: tuple[float, float, float, float] | None = None,
                  x: str = "x", y: str = "y") -> DataFrame:
    """Feature table; the box (min x, min y, max x, max y) becomes a pushed filter."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    if bbox:
        df = df.where(F.col(x).between(bbox[0], bbox[2]) & F.col(y).between(bbox[1], bbox[3]))
    return df


def scan_grid(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, store_tile: int = STORE_TILE) -> DataFrame:
    """Cell table stored by tile; the window (r0, c0, r1, c1) prunes tile folders and then rows."""
    df = spark.read.parquet(path)
    if window:
        r0, c0, r1, c1 = window
        df = df.where(
            F.col("tile_r").between(r0 // store_tile, r1 // store_tile) & F.col("tile_c").between(c0 // store_tile, c1 // store_tile)
            & F.col("r").between(r0, r1) & F.col("c").between(c0, c1)
        )
    return df.drop("tile_r", "tile_c")


def scan_series(spark: SparkSession, folder: str) -> DataFrame:
    """All station files of a folder in one scan; type, variable and site come from the file name."""
    df = spark.read.schema(SC.SERIES).option("header", True).option("nullValue", "NA").option("recursiveFileLookup", True).csv(folder)
    name = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(name, SERIES_NAME, i)
    return df.select(part(1).alias("series_type"), part(2).alias("var"), part(3).alias("site"), "*").where("site <> ''")


def read_lines(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """(file, line_no, line) from 1, for text files of any size.

    Files are read split by split. The order of lines within a split and the start of the split in
    the file give the number, so no file passes whole through one task.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", suffix).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"),
    )
    return number_lines(raw, "_start", "_id")


def number_lines(raw: DataFrame, start: str, order: str) -> DataFrame:
    counts = raw.groupBy("file", start).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("file").orderBy(start).rowsBetween(W.unboundedPreceding, -1)
    offset = counts.select("file", start, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy("file", start).orderBy(order)
    return raw.join(offset, ["file", start]).select(
        "file", (F.col("_off") + F.row_number().over(inside)).cast("bigint").alias("line_no"), "line"
    )
