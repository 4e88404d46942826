"""Order-dependent operators that never put one key's rows into one task.

A plain window over a hot site or over the whole table sends all its rows to a single task. Here
rows are first put into ordered chunks (calendar chunks for series, the ranges of a sort for ranks). Chunk
totals are small and carry what crosses a chunk border; the row-level window runs within a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hydrospark.session import cut


def placed(df: DataFrame, order: list[Column], n_chunks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows sorted over all partitions, with ``_pid`` and ``_idx``, and per partition ``_off``: the rows before it.

    One range repartition, written once, so that later reads agree on the places; into ``n_chunks`` ranges,
    or as many as the session shuffles into. The second table has one row per partition.
    """
    src = (df.repartitionByRange(n_chunks, *order) if n_chunks else df.repartitionByRange(*order)).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = cut(src).withColumns({"_pid": F.shiftright("_id", 33), "_idx": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")
    counts = rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    return rows, cut(counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))


def ranked(df: DataFrame, value: str, tie: str, group: list[str] | None = None, out: str = "rank",
           out_n: str = "group_rows", descending: bool = False, n_chunks: int | None = None) -> DataFrame:
    """Exact 1-based row number by (value, tie) per ``group`` (whole table when None) and group size.

    Null values are dropped. Values and ties are compared as they are: any type that has an order will
    do. The rows lie in ranges of (group, value, tie), so neither a hot group nor a hot value fills a task.
    """
    group = group or []
    v = F.col(value)
    rows, parts = placed(df.where(v.isNotNull()), [*[F.col(g) for g in group], v.desc() if descending else v.asc(), F.col(tie).asc()], n_chunks)
    # one row per partition of the sort
    rows = rows.join(F.broadcast(parts), "_pid").withColumn("_g", F.col("_off") + F.col("_idx")).drop("_pid", "_off", "_idx")
    if not group:
        total = rows.agg(F.count(F.lit(1)).alias(out_n))
        return rows.withColumn(out, F.col("_g") + 1).drop("_g").join(F.broadcast(total))
    starts = cut(rows.groupBy(*group).agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias(out_n)))
    return rows.join(starts, group).withColumn(out, F.col("_g") - F.col("_first") + 1).drop("_g", "_first")


def running_total(df: DataFrame, value: str, weight: str, out: str, n_chunks: int | None = None) -> DataFrame:
    """Running sum of ``weight`` in the order of distinct ``value`` over the whole table, two-pass."""
    rows, _ = placed(df, [F.col(value)], n_chunks)
    totals = rows.groupBy("_pid").agg(F.sum(weight).alias("_w"))
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = F.broadcast(totals.select("_pid", F.coalesce(F.sum("_w").over(before), F.lit(0.0)).alias("_off")))
    inside = W.partitionBy("_pid").orderBy("_idx").rowsBetween(W.unboundedPreceding, 0)
    return rows.join(offsets, "_pid").withColumn(out, F.col("_off") + F.sum(weight).over(inside)).drop("_pid", "_idx", "_off")


def chunk_previous(df: DataFrame, group: list[str], chunk: str, order: list[str], columns: dict[str, str]) -> DataFrame:
    """``lag(1)`` of columns (new name -> column) per group, computed within chunks.

    ``chunk`` must rise with ``order`` (for example a month number). The last row of the chunk
    before supplies the value for a chunk's first row.
    """
    last = df.groupBy(*group, chunk).agg(
        F.max_by(F.struct(*[F.col(c).alias(n) for n, c in columns.items()]), F.struct(*order)).alias("_last")
    )
    across = W.partitionBy(*group).orderBy(chunk)
    carry = last.select(*group, chunk, F.lag("_last").over(across).alias("_carry"))
    inside = W.partitionBy(*group, chunk).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(inside))
        .withColumns({f"_p_{n}": F.lag(c).over(inside) for n, c in columns.items()})
        .join(carry, [*group, chunk], "left")
        .withColumns({
            n: F.when(F.col("_rn") == 1, F.col(f"_carry.{n}")).otherwise(F.col(f"_p_{n}")) for n in columns
        })
        .drop("_rn", "_carry", *[f"_p_{n}" for n in columns])
    )


def chunk_running_sum(df: DataFrame, group: list[str], chunk: str, order: list[str], value: str, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` per group, computed within chunks plus chunk offsets."""
    totals = df.groupBy(*group, chunk).agg(F.sum(value).alias("_w"))
    before = W.partitionBy(*group).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*group, chunk, F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy(*group, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.join(offsets, [*group, chunk]).withColumn(out, F.col("_off") + F.sum(value).over(inside)).drop("_off")


def quantiles(df: DataFrame, value: str, tie: str, probs: dict[str, float], group: list[str] | None = None) -> DataFrame:
    """Exact interpolated (type 7) quantiles per group by rank selection; no group is collected."""
    group = group or []
    r = ranked(df.select(*group, value, tie), value, tie, group, "_rk", "_n")
    pos = {n: F.lit(p) * (F.col("_n") - 1) + 1 for n, p in probs.items()}
    wanted = None
    aggs = []
    for n, p in pos.items():
        lo, hi = F.floor(p), F.ceil(p)
        hit = (F.col("_rk") == lo) | (F.col("_rk") == hi)
        wanted = hit if wanted is None else wanted | hit
        at_lo = F.max(F.when(F.col("_rk") == lo, F.col(value)))
        at_hi = F.max(F.when(F.col("_rk") == hi, F.col(value)))
        frac = F.max(p - lo)
        aggs.append((at_lo + (at_hi - at_lo) * frac).alias(n))
    picked = r.where(wanted)
    return picked.groupBy(*group).agg(*aggs) if group else picked.agg(*aggs)
