"""Gauge series: storm onsets, event runoff coefficients, annual maxima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hydrospark.functions import peakflow as P
from hydrospark.session import cut
from hydrospark.operators.ordered import chunk_previous, chunk_running_sum, ranked

TIME_KEYS = ["Year", "Month", "Day", "Hr", "Min"]


def join_flow_rain(flow: DataFrame, rain: DataFrame, site: str = "site") -> DataFrame:
    """Flow with the rain of the same site and time; missing hour and minute count as zero."""
    keys = [site, *TIME_KEYS]
    f = flow.fillna(0, ["Hr", "Min"])
    r = rain.fillna(0, ["Hr", "Min"]).select(*keys, "PI")
    return f.drop("PI").join(r, keys, "left")


def month_chunk(ts: str) -> Column:
    return F.year(ts) * 12 + F.month(ts)


def clock_seconds(ts: str) -> Column:
    """Seconds on the stored clock; no session time zone enters for zone-less timestamps."""
    day = F.date_diff(F.to_date(ts), F.lit("1970-01-01")).cast("bigint")
    return day * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts)


def wet_dry_runs(series: DataFrame, site: str = "site", ts: str = "ts", pi: str = "pi") -> DataFrame:
    """Run number of consecutive dry or wet rows per site in time order.

    Calendar months are the chunks, so a site's whole record is never one window partition.
    """
    df = series.withColumn("is_dry", F.coalesce(F.col(pi), F.lit(0.0)) == 0).withColumn("_month", month_chunk(ts))
    df = chunk_previous(df, [site], "_month", [ts], {"_prev": "is_dry"})
    df = df.withColumn("starts", F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col("is_dry")), 1).otherwise(0))
    return chunk_running_sum(df, [site], "_month", [ts], "starts", "run_id").drop("_prev", "_month")


def storm_onsets(runs: DataFrame, site: str = "site", min_dry_rows: int = 7) -> DataFrame:
    """First wet row after a dry run of at least ``min_dry_rows`` rows."""
    dry = (
        runs.where("is_dry").groupBy(site, "run_id").agg(F.count(F.lit(1)).alias("dry_rows"))
        .select(site, (F.col("run_id") + 1).alias("run_id"), "dry_rows")
    )
    first_wet = runs.where((~F.col("is_dry")) & (F.col("starts") == 1))
    return first_wet.join(dry, [site, "run_id"]).where(F.col("dry_rows") >= min_dry_rows)


def top_events(onsets: DataFrame, site_rows: DataFrame, site: str = "site", ts: str = "ts", flow: str = "flow",
               top_n: int | None = None, top_share: float | None = None, ref_compat: bool = False) -> DataFrame:
    """Onset events by size per site: all of them, the ``top_n`` largest, or ``top_share`` of the record's rows.

    ``ref_compat``: a record with fewer rows than ``top_n`` keeps 30 % of its row count, others ``top_n``.
    """
    everything = F.lit((1 << 63) - 1)
    n = F.lit(top_n).cast("bigint") if top_n is not None else everything
    share = F.floor(top_share * F.col("n_rows")).cast("bigint") if top_share is not None else everything
    limit = F.when(F.col("n_rows") < n, F.floor(0.3 * F.col("n_rows"))).otherwise(n) if ref_compat else F.least(n, share)
    k = site_rows.select(site, limit.alias("_k"))
    # onsets are few beside the record they come from: written once, then ranked without rereading the record
    src = cut(onsets.where(F.col(flow).isNotNull()).withColumn("_sec", clock_seconds(ts)))
    r = ranked(src, flow, "_sec", [site], "event_rank", "_n", descending=True)
    return r.join(k, site).where(F.col("event_rank") <= F.col("_k")).drop("_k", "_n", "_sec")


def event_coefficients(events: DataFrame, flow: str = "flow", area: str = "area_km2", pi: str = "pi") -> DataFrame:
    return events.withColumn("c_event", P.event_runoff_c(F.col(flow), F.col(area), F.col(pi)))


def mean_runoff_c(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean event coefficient; values that are not finite are left out."""
    c = F.col("c_event")
    finite = F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)
    mean = F.avg(finite).alias("c_runoff")
    return events.groupBy(*by).agg(mean) if by else events.agg(mean)


def station_runoff_c(series: DataFrame, site: str = "site", ts: str = "ts", pi: str = "pi", flow: str = "flow",
                     area: str = "area_km2", top_n: int | None = None, top_share: float | None = None, ref_compat: bool = False) -> DataFrame:
    """Coefficient of every station in one job, from the events that ``top_events`` selects; a station without a usable one gets null."""
    rows = series.groupBy(site).agg(F.count(F.lit(1)).alias("n_rows"))
    runs = wet_dry_runs(series, site, ts, pi)
    top = top_events(storm_onsets(runs, site), rows, site, ts, flow, top_n, top_share, ref_compat)
    per_site = mean_runoff_c(event_coefficients(top, flow, area, pi), [site])
    return rows.select(site).join(per_site, site, "left")


def annual_max(series: DataFrame, value: str = "flow", site: str = "site", year: str = "yr", tie: str = "obs_id",
               ties: bool = False, per_area: bool = False, area: str = "area_km2") -> DataFrame:
    """Annual maxima: one row per site and year (lowest ``tie`` wins) or, with ``ties``, all equal rows.

    A partial aggregate, so a hot site-year never sits in one window. Zero maxima are dropped.
    """
    df = series.where(F.col(value).isNotNull() & F.col(year).isNotNull())
    rest = [c for c in df.columns if c not in (site, year)]
    if ties:
        top = df.groupBy(site, year).agg(F.max(value).alias("_top"))
        out = df.join(top, [site, year]).where(F.col(value) == F.col("_top")).drop("_top")
    else:
        best = F.max_by(F.struct(*rest), F.struct(F.col(value), -F.col(tie)))
        out = df.groupBy(site, year).agg(best.alias("_m")).select(site, year, "_m.*")
    out = out.where(F.col(value) != 0)
    return out.withColumn(value, F.try_divide(F.col(value), F.col(area))) if per_area else out


def donor_runoff_c(watersheds: DataFrame, station_c: DataFrame, roi: DataFrame) -> DataFrame:
    """Own station's coefficient, else that of the first donor in the region of influence."""
    own = watersheds.join(station_c.select(F.col("site").alias("gws_id"), F.col("c_runoff").alias("_own")), "gws_id", "left")
    known = own.where(F.col("_own").isNotNull()).groupBy("point_id").agg(F.first("_own").alias("_donor_c"))
    first = roi.where(F.col("rank") == 1).select(F.col("site").alias("point_id"), "donor")
    return (
        own.join(first, "point_id", "left")
        .join(known.withColumnRenamed("point_id", "donor"), "donor", "left")
        .withColumn("c_runoff", F.coalesce("_own", "_donor_c"))
        .drop("_own", "_donor_c")
    )
