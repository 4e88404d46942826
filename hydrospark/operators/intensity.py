"""Rain intensity by station, duration and return period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hydrospark.functions import peakflow as P
from hydrospark.session import dealt


def brackets(pidf: DataFrame, keys: list[str]) -> DataFrame:
    """Each table point with the next one: (rp, v) to (rp_next, v_next). A key has a few periods only."""
    w = W.partitionBy(*keys).orderBy("rp")
    return pidf.withColumns({
        "rp_next": F.lead("rp").over(w), "v_next": F.lead("v").over(w), "first_point": F.lag("rp").over(w).isNull(),
    })


def at_return_periods(pidf: DataFrame, rps: list[float], keys: list[str]) -> DataFrame:
    """Exact value, linear between neighbours, or the end value outside the table; one row per key and period."""
    asked = F.explode(F.array(*[F.lit(float(r)) for r in P.validate_return_periods(rps)]))
    b = brackets(pidf, keys).withColumn("ask", asked)
    inside = (F.col("ask") >= F.col("rp")) & (F.col("rp_next").isNull() | (F.col("ask") < F.col("rp_next")))
    below = F.col("first_point") & (F.col("ask") < F.col("rp"))
    t = F.try_divide(F.col("ask") - F.col("rp"), (F.col("rp_next") - F.col("rp")).cast("double"))
    line = F.col("v") + (F.col("v_next") - F.col("v")) * t
    return b.where(inside | below).select(
        *keys, F.col("ask").alias("rp_asked"),
        F.when(below, F.col("v")).otherwise(F.coalesce(line, F.col("v"))).alias("v"),
    )


def intensity_for(watersheds: DataFrame, pidf: DataFrame, rps: list[float], duration: Column | None = None) -> DataFrame:
    """Watersheds x bound x return period with the intensity of their station and nearest duration.

    The station table is reduced to the asked periods first, so what is joined is unique per
    (station, duration) after nesting; a station with very many watersheds is left to the adaptive skew join.
    Watersheds are dealt first: each becomes many rows, and what follows is long arithmetic on each.
    """
    table = at_return_periods(pidf, rps, ["station", "bound", "dur_min"])
    nested = table.groupBy("station", "dur_min").agg(
        F.collect_list(F.struct("bound", F.col("rp_asked").alias("rp"), "v")).alias("levels")
    )
    dur = P.nearest_duration(F.col("tc_min")) if duration is None else duration
    joined = dealt(watersheds).withColumn("dur_min", dur.cast("double")).join(nested, ["station", "dur_min"])
    return joined.select("*", F.explode("levels").alias("_l")).select(
        *[c for c in joined.columns if c != "levels"], "_l.bound", "_l.rp", "_l.v"
    )
