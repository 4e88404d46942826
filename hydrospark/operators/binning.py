"""Scaling and binning of a whole layer; layer totals enter as scalar subqueries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hydrospark.operators.ordered import ranked, running_total
from hydrospark.session import cut


def value_range(cells: DataFrame, value: str) -> Column:
    """Struct (lo, hi) of the whole layer as a scalar subquery."""
    return cells.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("_range")).scalar()


def linear_scale(cells: DataFrame, value: str, out: str, lo: float = 1.0, hi: float = 5.0) -> DataFrame:
    g = value_range(cells, value)
    v = F.col(value)
    mid = F.when(v.isNotNull(), F.lit((lo + hi) / 2))
    return cells.withColumn("_g", g).withColumn(
        out, F.coalesce(lo + F.try_divide(v - F.col("_g.lo"), F.col("_g.hi") - F.col("_g.lo")) * (hi - lo), mid)
    ).drop("_g")


def _count_passed(v: Column, edges: list[Column], closed: bool) -> Column:
    out = F.lit(0)
    for e in edges:
        out = out + F.when(v >= e if closed else v > e, 1).otherwise(0)
    return out


def equal_interval_bins(cells: DataFrame, value: str, out: str, n: int = 5) -> DataFrame:
    """Left-closed equal-width classes 1 .. n; the maximum falls in class n."""
    v, lo, hi = F.col(value), F.col("_g.lo"), F.col("_g.hi")
    edges = [lo + k * ((hi - lo) / n) for k in range(1, n)]
    return cells.withColumn("_g", value_range(cells, value)).withColumn(
        out, F.when(v.isNotNull(), 1 + _count_passed(v, edges, True))
    ).drop("_g")


def right_closed_bins(cells: DataFrame, value: str, out: str, n: int = 4) -> DataFrame:
    """Right-closed equal-width classes 0 .. n; only the minimum has class 0."""
    v, lo, hi = F.col(value), F.col("_g.lo"), F.col("_g.hi")
    edges = [lo + k * ((hi - lo) / n) for k in range(0, n)]
    return cells.withColumn("_g", value_range(cells, value)).withColumn(
        out, F.when(v.isNotNull(), _count_passed(v, edges, False))
    ).drop("_g")


def softmax_bins(cells: DataFrame, value: str, out: str, n: int = 5) -> DataFrame:
    """Classes 1 .. n cut where the cumulative softmax of the distinct values passes k/n."""
    v = F.col(value)
    d = cut(cells.where(v.isNotNull()).select(value).distinct())
    g = value_range(d, value)
    norm = (v - F.col("_g.lo")) / (F.col("_g.hi") - F.col("_g.lo") + 1e-10)
    weighted = d.withColumn("_g", g).withColumn("_e", F.exp(norm)).select(value, "_e")
    cum = running_total(weighted, value, "_e", "_cum")
    total = weighted.agg(F.sum("_e")).scalar()
    share = cum.withColumn("_total", total).withColumn("_share", F.col("_cum") / F.col("_total"))
    cuts = share.agg(F.struct(
        F.count(F.lit(1)).alias("m"),
        *[F.coalesce(F.min(F.when(F.col("_share") >= k / n, v)), F.max(v)).alias(f"t{k}") for k in range(1, n)],
    ).alias("_cuts")).scalar()
    cls = F.when(F.col("_c.m") <= 1, F.lit((n + 1) // 2))
    for k in range(1, n):
        cls = cls.when(v <= F.col(f"_c.t{k}"), F.lit(k))
    return cells.withColumn("_c", cuts).withColumn(out, F.when(v.isNotNull(), cls.otherwise(F.lit(n)))).drop("_c")


def rank_score(zones: DataFrame, value: str, tie: str, out: str = "score", equal_is_middle: bool = True) -> DataFrame:
    """Scores 0 .. 5 spread evenly by rank; null stays null. One row, or all equal values, score 2.5."""
    # ranking reads its input several times; the zone table is small beside the cells it comes from
    zones = cut(zones)
    r = ranked(zones, value, tie, None, "_rk", "_n")
    g = value_range(zones, value)
    even = F.try_divide(5.0 * (F.col("_rk") - 1), F.col("_n") - 1)
    flat = (F.col("_n") == 1) | ((F.col("_g.lo") == F.col("_g.hi")) if equal_is_middle else F.lit(False))
    scored = r.withColumn("_g", g).select(tie, F.when(flat, F.lit(2.5)).otherwise(even).alias(out))
    return zones.join(scored, tie, "left")
