"""Counts behind the vulnerability report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def category_counts(zones: DataFrame, category: str = "category") -> DataFrame:
    """Rows per category and percent of all rows; the window runs over the few category rows."""
    n = zones.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()))


def high_share(zones: DataFrame, category: str = "category") -> DataFrame:
    high = F.count_if(F.coalesce(F.col(category).isin("High", "Very High"), F.lit(False)))
    return zones.agg(F.count(F.lit(1)).alias("n"), high.alias("n_high")).withColumn(
        "high_pct", F.try_divide(F.col("n_high") * 100.0, F.col("n"))
    )


def crossing_counts(crossings: DataFrame) -> DataFrame:
    bridge = F.coalesce(F.col("pour_sha") == "Bridge", F.lit(False))
    return crossings.agg(
        F.countDistinct("point_id").alias("crossings"), F.count_if(bridge).alias("bridges")
    ).withColumn("culverts", F.col("crossings") - F.col("bridges"))


def period_years(period: str = "return_period") -> Column:
    """The number in a return period such as 100, '100' or '100yr'; null for an event."""
    return F.regexp_extract(F.col(period).cast("string"), r"^([0-9]+)", 1).try_cast("int")


def vulnerable_share(flags: DataFrame, by: list[str], crossings: DataFrame | None = None) -> DataFrame:
    """Vulnerable culverts and percent per method at the largest return period; bridges are left out.

    With ``crossings``, the inventory: its rows tell which points are bridges, and all its other points
    are what the percentage refers to; else the points of ``flags`` are. Points without a shape count as
    culverts. Estimates of an event are used where a method has no return period.
    """
    if crossings is None:
        rows, size = flags.where(~F.coalesce(F.col("pour_sha") == "Bridge", F.lit(False))), None
    else:
        own = crossings.where(~F.coalesce(F.col("pour_sha") == "Bridge", F.lit(False))).select("point_id").distinct()
        rows, size = flags.join(own, "point_id", "left_semi"), own.agg(F.count(F.lit(1)).alias("_inventory"))
    per = rows.groupBy(*by, "return_period").agg(
        F.countDistinct("point_id").alias("culverts"),
        F.count_if(F.coalesce(F.col("vuln") == "Vulnerable", F.lit(False))).alias("vulnerable"),
    ).withColumn("_years", period_years())
    # one row per method and period from here on
    top = per.withColumn("_top", F.max("_years").over(W.partitionBy())).where(F.col("_top").isNull() | (F.col("_years") == F.col("_top"))).drop("_years", "_top")
    if size is not None:
        top = top.join(F.broadcast(size)).withColumn("culverts", F.col("_inventory")).drop("_inventory")
    return top.withColumn("vulnerable_pct", F.try_divide(F.col("vulnerable") * 100.0, F.col("culverts")))


def vulnerability_summary(flags: DataFrame, crossings: DataFrame, scores: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """One long table of report figures: (section, item, value, pct)."""
    c = crossing_counts(crossings).select(
        F.explode(F.create_map(
            F.lit("crossings"), F.col("crossings"), F.lit("culverts"), F.col("culverts"), F.lit("bridges"), F.col("bridges")
        )).alias("item", "value")
    ).select(F.lit("inventory").alias("section"), "item", "value", F.lit(None).cast("double").alias("pct"))
    v = vulnerable_share(flags, by, crossings).select(
        F.lit("hydrologic").alias("section"), F.concat_ws("/", *by).alias("item"),
        F.col("vulnerable").alias("value"), F.col("vulnerable_pct").alias("pct"),
    )
    out = c.unionByName(v)
    for name, zones in scores.items():
        h = high_share(zones).select(
            F.lit("erosion").alias("section"), F.lit(name).alias("item"), F.col("n_high").alias("value"),
            F.col("high_pct").alias("pct"),
        )
        out = out.unionByName(h)
    return out
