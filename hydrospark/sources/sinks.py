"""Writers. Tables go out partitioned; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hydrospark.sources.readers import STORE_TILE


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet", partition_by: dict[str, list[str]] | None = None) -> None:
    for name, df in tables.items():
        w = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            w = w.option("header", True)
        keys = (partition_by or {}).get(name)
        (w.partitionBy(*keys) if keys else w).save(f"{folder}/{name}")


def write_grid(cells: DataFrame, path: str, store_tile: int = STORE_TILE) -> None:
    """Cell table in tile folders, sorted inside, so a window read opens few files."""
    t = cells.withColumns({"tile_r": F.floor(F.col("r") / store_tile).cast("int"), "tile_c": F.floor(F.col("c") / store_tile).cast("int")})
    t.repartition("tile_r", "tile_c").sortWithinPartitions("tile_r", "tile_c", "r", "c").write.mode("overwrite").partitionBy("tile_r", "tile_c").parquet(path)


def write_per_site(df: DataFrame, path: str, site: str = "site", max_records: int = 5_000_000) -> None:
    """One folder per site. Rows of a site stay spread over the tasks that hold them; long files are cut."""
    df.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", max_records).partitionBy(site).csv(path)


def write_text(lines: DataFrame, path: str, name: str = "name", order: str = "line_no") -> None:
    """Numbered lines to one text file per name, in order."""
    lines.repartition(name).sortWithinPartitions(name, order).select(name, "line").write.mode("overwrite").partitionBy(name).text(path)
