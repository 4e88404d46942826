"""Line deduplication: suffix ranks of line sequences by prefix doubling, repeated runs, later copies deleted."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hydrospark.llm.common import bounded_broadcast, cut, free_name

#: Second line hash; the two together stand for a line's text.
SALT = "line"


def lines_of(text: Column) -> Column:
    """The lines of a text that hold more than blanks."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.trim(x)) > 0)


def words_of(line: Column) -> Column:
    """Pieces between blanks."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1


def suffix_ranks(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Replace the pair (a, b) by ``r``, its place in the order of all pairs that occur more than once; other rows go.

    The distinct pairs are range-partitioned and sorted, so the row number with the partition as its high
    bits is an order-preserving rank. Only distinct pairs are sorted: a hot pair is one row of it.
    """
    pairs = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(a, b)
    ranks = cut(pairs.repartitionByRange(F.col(a), F.col(b)).sortWithinPartitions(a, b).withColumn("r", F.monotonically_increasing_id()))
    return rows.join(ranks, [a, b]).drop(a, b)


def repeated_windows(lines: DataFrame, least_words: int) -> DataFrame:
    """Windows of lines that occur before: (rid, s, len) of every later copy.

    ``lines``: rid, id, s, w, h1, h2 of the lines of each text. A window is a shortest stretch of lines
    from its first line on, or up to its last line, that has ``least_words`` words; a repeated run of at
    least as many words is the union of such windows in it.
    """
    # a line that occurs once ends every run, so only the others are ranked
    # written first: over a plain table the join can split a line that stands everywhere
    often = cut(lines.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1"))
    rows = lines.join(often, "h1")
    # stretches of repeated lines; one with too few words can hold no window
    doc = W.partitionBy("rid").orderBy("s")
    rows = rows.withColumn("w", F.least("w", F.lit(least_words))).withColumn("stretch", F.col("s") - F.row_number().over(doc))
    part = W.partitionBy("rid", "stretch")
    rows = rows.withColumn("all", F.sum("w").over(part)).filter(F.col("all") >= least_words).drop("all", "stretch")
    level = cut(suffix_ranks(cut(rows), "h1", "h2"))

    # the rank of a pair needs all its lines, so stretches are taken anew
    rows = level.withColumn("stretch", F.col("s") - F.row_number().over(doc))
    inner = part.orderBy("s")
    rows = rows.withColumn("c", F.sum("w").over(inner)).withColumn("cb", F.col("c") - F.col("w")).withColumn("end", F.max("s").over(part)) \
        .withColumn("start", F.min("s").over(part)).withColumn("all", F.sum("w").over(part))
    # words are capped at the least number, so the border of a shortest stretch lies within twice as many words
    after = F.min("s").over(part.orderBy("cb").rangeBetween(least_words, 2 * least_words))
    before = F.max("s").over(part.orderBy("c").rangeBetween(-2 * least_words, -least_words))
    last = F.when(after.isNotNull(), after - 1).when(F.col("all") - F.col("cb") >= least_words, F.col("end"))
    first = F.when(before.isNotNull(), before + 1).when(F.col("c") >= least_words, F.col("start"))
    shapes = rows.select("rid", "id", "s", last.alias("last"), first.alias("first"))
    windows = shapes.filter("last IS NOT NULL").select("rid", "id", "s", (F.col("last") - F.col("s") + 1).alias("len")).unionByName(
        shapes.filter("first IS NOT NULL").select("rid", "id", F.col("first").alias("s"), (F.col("s") - F.col("first") + 1).alias("len"))).distinct()
    windows = cut(windows.withColumn("k", F.floor(F.log2(F.col("len").cast("double")) + 1e-9).cast("int")))

    # prefix doubling: the rank of 2^(k+1) lines is that of the pair of ranks of its halves
    levels = [level.select("rid", "s", "r", F.lit(0).alias("k"))]
    for k in range(int(math.log2(least_words))):
        step = 1 << k
        other = F.max("r").over(doc.rangeBetween(step, step))
        pairs = cut(levels[-1].select("rid", "s", F.col("r").alias("a"), other.alias("b")).filter("b IS NOT NULL"))
        levels.append(cut(suffix_ranks(pairs, "a", "b")).select("rid", "s", "r", F.lit(k + 1).alias("k")))
    ranks = levels[0]
    for more in levels[1:]:
        ranks = ranks.unionByName(more)

    # two overlapping blocks of 2^k lines name a window; equal names with equal lengths are equal lines
    second = F.col("s") + F.col("len") - F.pow(F.lit(2.0), F.col("k")).cast("bigint")
    keyed = windows.withColumn("s2", second).join(ranks.withColumnRenamed("r", "ra"), ["rid", "s", "k"]) \
        .join(ranks.select("rid", F.col("s").alias("s2"), "k", F.col("r").alias("rb")), ["rid", "s2", "k"])
    keyed = cut(keyed.select("rid", "s", "len", "ra", "rb", F.struct(F.col("id").isNull().alias("last"), "id", "rid", "s").alias("place")))
    firsts = cut(keyed.groupBy("len", "ra", "rb").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    return keyed.join(firsts, ["len", "ra", "rb"]).filter("place != first").select("rid", "s", "len")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_words: int = 20) -> DataFrame:
    """``docs`` with later copies of repeated line runs taken out of ``text``, plus ``n_lines`` and ``n_deleted``.

    A run is a stretch of consecutive lines with ``least_words`` words or more in all; it is repeated if
    the same lines occur earlier, in the order of ids (nulls last, equal ids by their place in the input)
    and lines. A line goes if it lies in a repeated run; overlapping runs (a line that repeats on and on)
    leave their first line. Lines are compared as they are; blank lines are not part of runs, and a text
    that loses lines loses its blank lines too. A text of which every line goes becomes empty. Null text
    stays null with no lines; other columns pass through, but for two named like the new ones.

    The input must give the same rows in the same partitions when it is read again (a file scan does).
    """
    docs = docs.drop(*{"n_lines", "n_deleted"} - {id_col, text})
    rid, gone = free_name(docs, "_rid"), free_name(docs, "_gone")
    numbered = docs.withColumn(rid, F.monotonically_increasing_id())
    listed = numbered.select(F.col(rid).alias("rid"), F.col(id_col).alias("id"), F.posexplode(lines_of(F.col(text))).alias("s", "line"))
    lines = listed.select("rid", "id", F.col("s").cast("bigint").alias("s"), words_of(F.col("line")).cast("bigint").alias("w"),
                          F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(SALT)).alias("h2"))
    later = repeated_windows(lines, least_words)
    lost = later.select("rid", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("len") - 1)).alias("s")).distinct()
    lost = cut(lost.groupBy(F.col("rid").alias(rid)).agg(F.collect_list(F.col("s").cast("int")).alias(gone)))
    out = numbered.join(bounded_broadcast(lost, 100_000), rid, "left")
    kept = lines_of(F.col(text))
    mark = F.map_from_arrays(F.col(gone), F.array_repeat(F.lit(True), F.size(gone)))
    kept = F.array_join(F.filter(F.transform(kept, lambda x, i: F.when(~F.map_contains_key(mark, i), x)), lambda x: x.isNotNull()), "\n")
    return out.withColumns({
        "n_lines": F.size(lines_of(F.col(text))).cast("bigint"),
        "n_deleted": F.coalesce(F.size(gone), F.lit(0)).cast("bigint"),
        text: F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept),
    }).drop(rid, gone)


#: The same result by its definition: all windows by their text.
SQL = """
WITH l AS (
  SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(trim(x)) > 0) AS ls FROM documents
), n AS (
  SELECT doc_id, ls, list_transform(ls, lambda x: least({w}, length(x) - length(replace(x, ' ', '')) + 1)) AS ws FROM l
), p AS (
  SELECT doc_id, ls, ws, unnest(range(1, len(ls) + 1)) AS s FROM n
), q AS (
  SELECT doc_id, ls, ws, s, unnest(range(s, least(len(ls), s + {w} - 1) + 1)) AS e FROM p
), v AS (
  SELECT doc_id, s, e, array_to_string(ls[s:e], chr(10)) AS body, e - s + 1 AS len,
         row_number() OVER (PARTITION BY array_to_string(ls[s:e], chr(10)) ORDER BY doc_id, s) AS copy
  FROM q
  WHERE list_sum(ws[s:e]) >= {w}
    AND (coalesce(list_sum(ws[s:e - 1]), 0) < {w} OR coalesce(list_sum(ws[s + 1:e]), 0) < {w})
), g AS (
  SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS s FROM v WHERE copy > 1
), k AS (
  SELECT doc_id, list(s) AS gone FROM g GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(n.ls) AS BIGINT) AS n_lines, CAST(coalesce(len(k.gone), 0) AS BIGINT) AS n_deleted,
       CASE WHEN k.gone IS NULL THEN d.text
            ELSE array_to_string(list_transform(list_filter(range(1, len(n.ls) + 1), lambda i: NOT list_contains(k.gone, i)), lambda i: n.ls[i]), chr(10)) END AS text
FROM documents d JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
