"""Bulk parsing of fixed-layout text: frequency tables, ascii grids, simulator summaries.

Each parser takes numbered lines (file, line_no, line) and stays in built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Layout of the frequency text (1-based lines).
HEADER_LINE = 14
BLOCKS = [("E", 15, 33), ("U", 37, 55), ("L", 59, 77)]
UNIT_MIN = {"min": 1.0, "hr": 60.0, "day": 1440.0}


def duration_minutes(text: Column) -> Column:
    """'5-min', '2-hr', '10-day' to minutes."""
    n = F.regexp_extract(text, r"(\d+)-", 1).try_cast("double")
    unit = F.regexp_extract(text, r"-(min|hr|day)", 1)
    out = F.when(unit == "min", n)
    for u in ("hr", "day"):
        out = out.when(unit == u, n * UNIT_MIN[u])
    return out


def frequency_tables(lines: DataFrame) -> DataFrame:
    """(file, bound, duration, dur_min, rp, v) from the three blocks of each file."""
    used = lines.where((F.col("line_no") == HEADER_LINE) | F.col("line_no").between(BLOCKS[0][1], BLOCKS[-1][2]))
    head = used.where(F.col("line_no") == HEADER_LINE).select(
        "file", F.posexplode(F.regexp_extract_all("line", F.lit(r"1/(\d+)"), 1)).alias("k", "rp")
    )
    bound = None
    for name, a, b in BLOCKS:
        hit = F.col("line_no").between(a, b)
        bound = F.when(hit, name) if bound is None else bound.when(hit, name)
    parts = F.split(F.col("line"), ":", 2)
    body = used.withColumn("bound", bound).where("bound IS NOT NULL").withColumn("_values", F.split(F.trim(parts[1]), ",")).select(
        "file", "bound", F.trim(parts[0]).alias("duration"),
        F.posexplode(F.expr("slice(_values, 2, size(_values))")).alias("k", "_v"),
    )
    v = F.trim("_v").try_cast("double")
    return body.join(head, ["file", "k"]).select(
        "file", "bound", "duration", duration_minutes(F.col("duration")).alias("dur_min"), F.col("rp").cast("int").alias("rp"), v.alias("v")
    ).where("v IS NOT NULL")


def ascii_grids(lines: DataFrame, bounds: tuple[float, float, float, float] | None = None, margin: float = 500.0) -> DataFrame:
    """(file, r, c, x, y, v) of the grids whose extent meets the bounds widened by the margin.

    r counts from the top of the file; x, y are cell centres; nodata becomes null.
    """
    key = F.lower(F.regexp_extract("line", r"^\s*([A-Za-z_]+)\s", 1))
    val = F.regexp_extract("line", r"^\s*[A-Za-z_]+\s+(\S+)", 1).try_cast("double")
    named = lines.where(F.col("line").rlike(r"^\s*[A-Za-z_]")).select("file", key.alias("k"), val.alias("x"))
    get = lambda k: F.max(F.when(F.col("k") == k, F.col("x")))
    head = named.groupBy("file").agg(
        get("ncols").alias("ncols"), get("nrows").alias("nrows"), get("xllcorner").alias("xll"), get("yllcorner").alias("yll"),
        get("cellsize").alias("size"), F.coalesce(get("nodata_value"), F.lit(-9999.0)).alias("nodata"), F.count(F.lit(1)).alias("n_head"),
    )
    if bounds:
        x0, y0, x1, y1 = bounds
        head = head.where(
            (F.col("xll") <= x1 + margin) & (F.col("xll") + F.col("ncols") * F.col("size") >= x0 - margin)
            & (F.col("yll") <= y1 + margin) & (F.col("yll") + F.col("nrows") * F.col("size") >= y0 - margin)
        )
    body = lines.where(~F.col("line").rlike(r"^\s*[A-Za-z_]")).join(head, "file")
    r = (F.col("line_no") - F.col("n_head") - 1).cast("int")
    cells = body.select("file", "xll", "yll", "nrows", "size", "nodata", r.alias("r"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("c", "_v"))
    v = F.col("_v").try_cast("double")
    return cells.select(
        "file", "r", "c", (F.col("xll") + (F.col("c") + 0.5) * F.col("size")).alias("x"),
        (F.col("yll") + (F.col("nrows") - F.col("r") - 0.5) * F.col("size")).alias("y"), F.when(v != F.col("nodata"), v).alias("v"),
    )


# Labels of the simulator summary, and the unit factor of each.
SUMMARY = [
    ("precipitation_mm", "PRECIPITATION", 1.0), ("runoff_mm", "RUNOFF", 1.0), ("soil_loss_kg_m2", "SOIL LOSS", 1.0),
    ("sediment_yield_kg", "SEDIMENT YIELD", 1000.0),
]


def simulator_averages(lines: DataFrame) -> DataFrame:
    """One row per file with the averages below the totals heading; a missing value counts as zero."""
    start = lines.where(F.col("line").contains("AVERAGE ANNUAL TOTALS")).groupBy("file").agg(F.min("line_no").alias("_from"))
    after = lines.join(start, "file").where(F.col("line_no") > F.col("_from"))
    after = after.where(~F.col("line").contains("AVERAGE ANNUAL TOTALS"))
    number = F.regexp_extract("line", r":\s*(\S+)", 1).try_cast("double")
    metric = None
    for name, label, _ in SUMMARY:
        hit = F.col("line").contains(label)
        metric = F.when(hit, name) if metric is None else metric.when(hit, name)
    found = after.withColumns({"_m": metric, "_x": number}).where("_m IS NOT NULL AND _x IS NOT NULL")
    out = found.groupBy("file").agg(*[
        (F.max_by(F.when(F.col("_m") == n, F.col("_x")), F.when(F.col("_m") == n, F.col("line_no"))) * f).alias(n) for n, _, f in SUMMARY
    ])
    return lines.select("file").distinct().join(out, "file", "left").fillna(0.0, [n for n, _, _ in SUMMARY])


def simulator_years(lines: DataFrame) -> DataFrame:
    """(file, year, precipitation_mm, runoff_mm, soil_loss_kg_m2) below the yearly heading."""
    start = lines.where(F.col("line").contains("ANNUAL SUMMARY")).groupBy("file").agg(F.min("line_no").alias("_from"))
    rows = lines.join(start, "file").where((F.col("line_no") > F.col("_from")) & F.col("line").rlike(r"^\d"))
    p = F.split(F.trim("line"), r"\s+")
    return rows.where(F.size(p) >= 4).select(
        "file", F.get(p, F.lit(0)).try_cast("int").alias("year"),
        *[F.get(p, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("precipitation_mm", "runoff_mm", "soil_loss_kg_m2"), start=1)],
    ).dropna()
