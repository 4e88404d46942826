"""Benchmark decontamination: typed templates, hash-joined template windows, slot consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hydrospark.llm.common import bounded_broadcast, cut, free_name

# Words that count as units after a number.
UNITS = ["percent", "mm", "cm", "m", "km", "inch", "inches", "ft", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "oz", "lb", "lbs",
         "pound", "pounds", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "s", "sec", "second", "seconds", "min", "minute", "minutes",
         "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros",
         "degree", "degrees", "mph", "kmh"]

# Control characters of the canonical text: a placeholder, the start and the end of its value.
HOLD, OPEN, CLOSE = "\x01", "\x02", "\x03"
NAME_MARK, QUANTITY_MARK, NUMBER_MARK = f"{HOLD}n", f"{HOLD}q", f"{HOLD}d"

# Repeated groups are possessive: Java's engine would else go one call deeper per repetition.
_NAME = r"\p{Lu}(?<![\p{L}\p{N}]\p{Lu})[\p{Ll}\p{Lm}\p{Lo}\p{N}]++(?![\p{L}\p{N}])"
NAMES = rf"({_NAME}(?:[ \t]++{_NAME}){{2,}}+)|({_NAME}(?:[ \t]++{_NAME})?+)"
# One match takes a number whole, with its unit if it has one, so that no place is tried twice.
NUMBERS = (r"([0-9](?<![\p{L}\p{N}][0-9])[0-9]*+(?:[.,][0-9]++)*+" rf"(?: ?((?i:{'|'.join(UNITS)}))(?![\p{{L}}\p{{N}}]))?+)")
WORD = r"\x01?[\p{L}\p{N}]+"
WORD_OR_SLOT = r"\x01[nqd]\x02[^\x03]*+\x03|\x01?[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Template tokens of a text: lower-cased words, and marks in place of names, quantities and numbers.

    A name is one capitalised word or two with blanks between, wherever it stands; a longer run of them is a
    heading, kept word by word with a mark behind. A quantity is a number with a unit after it.
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x01-\x03]", " ")
    held = F.regexp_replace(F.regexp_replace(bare, NAMES, f"$1{NAME_MARK}"), NUMBERS, f"{NUMBER_MARK}$2 ")
    held = F.regexp_replace(held, rf"{NUMBER_MARK}\p{{L}}++", QUANTITY_MARK)
    return F.regexp_extract_all(F.lower(held), F.lit(WORD), F.lit(0))


def slots(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The same tokens with the values of their slots: keys, ``at``, ``template``, ``value``."""
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x01-\x03]", " ")
    held = F.regexp_replace(bare, NAMES, f"$1{NAME_MARK}{OPEN}$2{CLOSE}")
    held = F.regexp_replace(held, NUMBERS, f"{NUMBER_MARK}$2{OPEN}$1{CLOSE} ")
    held = F.regexp_replace(held, rf"{NUMBER_MARK}\p{{L}}++(?={OPEN})", QUANTITY_MARK)
    listed = rows.select(*keys, F.posexplode(F.regexp_extract_all(F.lower(held), F.lit(WORD_OR_SLOT), F.lit(0))).alias("at", "token"))
    slot = F.col("token").startswith(HOLD)
    return listed.select(*keys, "at", F.when(slot, F.substring("token", 1, 2)).otherwise(F.col("token")).alias("template"),
                         F.when(slot, F.regexp_replace("token", r"^\x01.\x02|\x03$", "")).otherwise(F.col("token")).alias("value"))


def windows(rows: DataFrame, keys: list[str], text: str, window: int) -> DataFrame:
    """One row per template window: keys, its place ``at`` in the text's tokens, and its hash ``h``."""
    coded = rows.select(*keys, F.transform(tokens(F.col(text)), lambda x: F.xxhash64(x)).alias("codes"))
    # several references to ``codes`` keep it a column of its own, computed once
    spans = F.when(F.size("codes") >= window, F.transform(F.sequence(F.lit(0), F.size("codes") - window),
                                                         lambda i: F.xxhash64(*[F.get("codes", i + k) for k in range(window)])))
    return coded.select(*keys, F.posexplode(spans).alias("at", "h"))


def seeds(items: DataFrame, window: int) -> DataFrame:
    """The windows of items that may find a document: those with a literal word among their tokens."""
    marks = F.array(*[F.lit(m) for m in (NAME_MARK, QUANTITY_MARK, NUMBER_MARK)])
    said = items.select("item", tokens(F.col("text")).alias("t"))
    spans = F.when(F.size("t") >= window, F.transform(F.sequence(F.lit(0), F.size("t") - window), lambda i: F.struct(
        i.alias("iat"), F.xxhash64(*[F.xxhash64(F.get("t", i + k)) for k in range(window)]).alias("h"),
        F.size(F.array_except(F.array(*[F.get("t", i + k) for k in range(window)]), marks)).alias("literals"))))
    return said.select("item", F.inline(spans)).filter("literals > 0").drop("literals")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text",
          window: int = 6, coverage: float = 0.5, reach: float = 0.25) -> DataFrame:
    """One row per document and benchmark item that it gives away.

    Text and items become templates: names, quantities and numbers are placeholders, other words are
    lower-cased. Windows of ``window`` template tokens that hold a word are joined by hash; each hit aligns a document
    with an item. Windows of placeholders alone find nothing, or a table of numbers would meet every other.
    Along an alignment all tokens count that lie in runs of at least ``window`` equal templates, such windows included.

    Slots are judged one by one: a slot that breaks the one-to-one map of values from the item to the
    document is not counted, all other tokens are. A slot fits the map if its value is unchanged, or if its
    values are each other's most frequent partner in the alignment (of equals the smallest).

    Alignments of a pair whose shifts differ by at most ``reach`` of the item's tokens are judged as one: an
    added or dropped word starts a new shift but does not part the text. Of tokens that meet several times at
    most as many count as the document has. Windows further apart in a long text do not add up. A pair is a leak if
    one such group of alignments covers at least ``coverage`` of the item's tokens. The fullest is told,
    of equals the one with fewest changes, then the first.

    Columns: id, item, ``n_tokens`` of the item covered, ``coverage``, ``n_slots`` compared,
    ``n_changed`` slots with another value. Items shorter than ``window`` tokens, items without a word beside
    their placeholders and null texts match nothing. Repeated rows of either side are one; a document is named
    by its id, so alignments of rows with equal ids add up. Ids may be null; other columns are left out.
    """
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text).alias("text"))
    bench = cut(items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).distinct())
    sought = cut(seeds(bench, window))
    ours = cut(slots(bench, ["item"], "text").select("item", F.col("at").alias("iat"), F.col("template").alias("u"), F.col("value").alias("w")).distinct())
    sizes = cut(ours.groupBy(F.col("item").alias("sitem")).agg((F.max("iat") + 1).alias("size")))
    # the distinct windows alone meet the corpus; their number is counted before they are broadcast
    wanted = cut(sought.select("h").distinct())
    hits = cut(windows(docs, ["doc"], "text", window).join(bounded_broadcast(wanted, 500_000), "h").distinct())
    seen = cut(hits.join(bounded_broadcast(sought, 500_000), "h").select("doc", "item", (F.col("at") - F.col("iat")).alias("shift"), "iat").distinct())
    aligned = cut(able(seen, ours, sizes, window, coverage))

    ids = cut(aligned.select(F.col("doc").alias("wanted")).distinct())
    texts = docs.join(bounded_broadcast(ids, 200_000), F.col("doc").eqNullSafe(F.col("wanted")), "left_semi").distinct()
    theirs = slots(texts, ["doc"], "text").select(F.col("doc").alias("tdoc"), F.col("at").alias("tat"), F.col("template").alias("t"), F.col("value").alias("v"))
    both = aligned.join(bounded_broadcast(ours.withColumnRenamed("item", "oitem"), 500_000), F.col("item").eqNullSafe(F.col("oitem"))).drop("oitem")
    both = both.join(theirs, F.col("doc").eqNullSafe(F.col("tdoc")) & (F.col("iat") + F.col("shift") == F.col("tat"))).filter("t = u")
    # runs of equal templates; a group is one alignment, at most the item's tokens
    line = Window.partitionBy("doc", "item", "shift")
    both = both.withColumn("run", F.col("iat") - F.dense_rank().over(line.orderBy("iat")))
    both = both.withColumn("long", F.max("iat").over(line.partitionBy("doc", "item", "shift", "run")) - F.min("iat").over(line.partitionBy("doc", "item", "shift", "run")) + 1)
    matched = cut(both.filter(F.col("long") >= window).select("doc", "item", "shift", "iat", "u", "w", "v"))
    slot = F.col("u").startswith(HOLD)
    both = fitting(lanes(matched, sizes, reach), slot)
    # of a lane's tokens that meet several times only one counts, and an unchanged one before a changed one
    n_slots = F.count_distinct(F.when(slot, F.col("iat")))
    n_same = F.count_distinct(F.when(slot & (F.col("v") == F.col("w")), F.col("iat")))
    n_tokens = F.least(F.count_distinct("iat"), F.count_distinct(F.col("iat") + F.col("shift")))
    judged = both.groupBy("doc", "item", "lane").agg(n_slots.alias("n_slots"), (n_slots - n_same).alias("n_changed"), n_tokens.alias("n_tokens"))
    best = judged.groupBy("doc", "item").agg(F.max(F.struct("n_tokens", (-F.col("n_changed")).alias("col2"), (-F.col("lane")).alias("col3"), "n_slots")).alias("b"))
    best = best.select("doc", "item", F.col("b.n_tokens").alias("n_tokens"), F.col("b.n_slots").alias("n_slots"), (-F.col("b.col2")).alias("n_changed"))
    out = best.join(bounded_broadcast(sizes, 200_000), F.col("item").eqNullSafe(F.col("sitem"))).withColumn("coverage", F.col("n_tokens") / F.col("size")).filter(F.col("coverage") >= coverage)
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_tokens", F.round("coverage", 6).alias("coverage"), "n_slots", "n_changed")


def able(seen: DataFrame, ours: DataFrame, sizes: DataFrame, window: int, coverage: float) -> DataFrame:
    """(doc, item, shift): alignments of pairs that can reach the coverage with all their alignments together.

    What a pair can cover is the tokens under its hits and the item's placeholders beside them.
    """
    marks = cut(ours.filter(F.col("u").startswith(HOLD)).groupBy(F.col("item").alias("mitem")).agg(F.count_distinct("iat").alias("marks")))
    covered = seen.withColumn("at", F.explode(F.sequence("iat", F.col("iat") + window - 1))).groupBy("doc", "item").agg(F.count_distinct("at").alias("n"))
    covered = covered.join(bounded_broadcast(sizes, 200_000), F.col("item").eqNullSafe(F.col("sitem"))).join(
        bounded_broadcast(marks, 200_000), F.col("item").eqNullSafe(F.col("mitem")), "left")
    can = cut(covered.filter((F.col("n") + F.coalesce("marks", F.lit(0))) / F.col("size") >= coverage).select(F.col("doc").alias("p_doc"), F.col("item").alias("p_item")))
    pair = F.col("doc").eqNullSafe(F.col("p_doc")) & F.col("item").eqNullSafe(F.col("p_item"))
    return seen.select("doc", "item", "shift").distinct().join(bounded_broadcast(can, 200_000), pair, "left_semi")


def lanes(matched: DataFrame, sizes: DataFrame, reach: float) -> DataFrame:
    """``matched`` with its ``lane``: from each shift of a pair on, all rows up to ``reach`` of the item's tokens further.

    A row takes part in as many lanes as there are shifts within reach before it, fewer than the item has tokens.
    """
    far = bounded_broadcast(sizes, 200_000).select(F.col("sitem"), F.floor(F.col("size") * reach).alias("far"))
    rows = cut(matched.join(far, F.col("item").eqNullSafe(F.col("sitem"))).drop("sitem"))
    # stretches of far + 1 shifts: a lane that holds a row starts in the row's stretch or in the one before
    stretch = F.floor(F.col("shift") / (F.col("far") + 1))
    starts = cut(rows.select(F.col("doc").alias("l_doc"), F.col("item").alias("l_item"), F.col("shift").alias("lane"), stretch.alias("l_in")).distinct())
    rows = rows.withColumn("in", F.explode(F.array(stretch, stretch - 1)))
    rows = rows.join(starts, [F.col("doc").eqNullSafe(F.col("l_doc")), F.col("item").eqNullSafe(F.col("l_item")), F.col("in") == F.col("l_in"),
                              F.col("shift") >= F.col("lane"), F.col("shift") <= F.col("lane") + F.col("far")])
    return rows.select("doc", "item", "shift", "iat", "lane", "u", "w", "v")


def fitting(both: DataFrame, slot: Column) -> DataFrame:
    """The rows of ``both`` without the slots that do not fit the most frequent one-to-one map of their lane."""
    both = cut(both)
    lane = ["doc", "item", "lane"]
    seen = both.filter(slot).groupBy(*lane, "w", "v").agg(F.count_distinct("iat").alias("n"))
    # a group holds the values of one lane, at most one a token of the item
    rank = lambda a, b: F.row_number().over(Window.partitionBy(*lane, a).orderBy(F.desc("n"), b))
    ranked = seen.withColumn("i", rank("w", "v")).withColumn("j", rank("v", "w"))
    bad = cut(ranked.filter("v != w AND (i > 1 OR j > 1)").select(*[F.col(c).alias(f"b_{c}") for c in (*lane, "w", "v")]))
    on = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in (*lane, "w", "v")]
    return both.join(bounded_broadcast(bad, 200_000), [slot, *on], "left_anti")


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that give away an item. Rows are judged one by one, whatever their ids."""
    row = free_name(docs, "_row")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    bad = cut(leaks(rows, items, row, text, **options).select(F.col(row).alias("gone")).distinct())
    return rows.join(bounded_broadcast(bad.withColumnRenamed("gone", f"{row}_gone"), 200_000), F.col(row) == F.col(f"{row}_gone"), "left_anti").drop(row)


#: The same by definition: words and gaps one by one, whole templates in place of hashes.
SQL = r"""
WITH src AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), raw AS (
  SELECT side, id, unnest(x) AS x, generate_subscripts(x, 1) AS k FROM (
    SELECT side, id, regexp_extract_all(regexp_replace(coalesce(text, ''), '[\x01-\x03]', ' ', 'g'), '[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS x FROM src)
), kind AS (
  SELECT *, regexp_full_match(x, '[0-9]+(?:[.,][0-9]+)*') AS num, regexp_full_match(x, '[^\p{L}\p{N}]+') AS gap,
    lag(x) OVER s AS x1, lag(x, 2) OVER s AS x2, lead(x) OVER s AS y1, lead(x, 2) OVER s AS y2, regexp_full_match(x, '\p{Lu}[\p{Ll}\p{Lm}\p{Lo}\p{N}]+') AS cap
  FROM raw WINDOW s AS (PARTITION BY side, id ORDER BY k)
), named AS (
  SELECT *, cap AND coalesce(regexp_full_match(x1, '[^\p{L}\p{N}]+'), true) AS nm FROM kind
), runs AS (
  SELECT *, sum(CASE WHEN nm AND coalesce(nm2 AND regexp_full_match(x1, '[ \t]+'), false) THEN 0 ELSE 1 END) OVER (PARTITION BY side, id ORDER BY k) AS run
  FROM (SELECT *, lag(nm, 2) OVER (PARTITION BY side, id ORDER BY k) AS nm2 FROM named) WHERE NOT gap
), sized AS (
  SELECT *, CASE WHEN nm THEN count(*) OVER r ELSE 0 END AS size, min(k) OVER r AS k0, max(k) OVER r AS k1 FROM runs
  WINDOW r AS (PARTITION BY side, id, run)
), units AS (
  SELECT *, size NOT IN (1, 2) AND lower(x) IN ({units}) AS unit FROM sized
), near AS (
  SELECT *, CASE WHEN y1 = ' ' THEN y2 WHEN NOT regexp_full_match(coalesce(y1, ' '), '[^\p{L}\p{N}]+') THEN y1 END AS nx,
    lead(unit) OVER s AS unit1, lag(num) OVER s AS num1, (x1 = ' ' OR NOT regexp_full_match(x1, '[^\p{L}\p{N}]+')) AS close
  FROM units WINDOW s AS (PARTITION BY side, id ORDER BY k)
), listed AS (
  SELECT side, id, k, unnest(CASE
      WHEN num AND nx IS NOT NULL AND unit1 THEN [{'t': chr(1) || 'q', 'v': x || CASE WHEN y1 = ' ' THEN ' ' ELSE '' END || lower(nx)}]
      WHEN num THEN [{'t': chr(1) || 'd', 'v': x}]
      WHEN size = 1 THEN [{'t': chr(1) || 'n', 'v': lower(x)}]
      WHEN size = 2 THEN CASE WHEN k = k0 THEN [{'t': chr(1) || 'n', 'v': lower(x || y1 || y2)}] ELSE [] END
      ELSE list_concat(CASE WHEN unit AND num1 AND close THEN [] ELSE [{'t': lower(x), 'v': lower(x)}] END,
                       CASE WHEN size > 2 AND k = k1 THEN [{'t': chr(1) || 'n', 'v': ''}] ELSE [] END) END, recursive := true),
    generate_subscripts([1, 2], 1) AS z FROM near
), tpl AS (
  SELECT side, id, t, v, row_number() OVER (PARTITION BY side, id ORDER BY k, z) - 1 AS pos FROM listed WHERE t IS NOT NULL
), win AS (
  SELECT side, id, pos, string_agg(t, ' ') OVER w AS h, count(*) OVER w AS n, count(CASE WHEN t[1] <> chr(1) THEN 1 END) OVER w AS words FROM tpl
  WINDOW w AS (PARTITION BY side, id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {last} FOLLOWING)
), aligned AS (
  SELECT DISTINCT d.id AS doc, b.id AS item, d.pos - b.pos AS shift
  FROM win d JOIN win b ON d.h = b.h AND d.n = {last} + 1 AND b.n = {last} + 1 AND d.side = 'd' AND b.side = 'b' AND b.words > 0
), met AS (
  SELECT doc, item, shift, b.pos AS ipos, b.t, b.v AS w, d.v, b.pos - row_number() OVER (PARTITION BY doc, item, shift ORDER BY b.pos) AS run
  FROM aligned JOIN tpl b ON b.side = 'b' AND b.id = item JOIN tpl d ON d.side = 'd' AND d.id = doc AND d.pos = b.pos + shift AND d.t = b.t
), sizes AS (SELECT id AS item, count(*) AS size FROM tpl WHERE side = 'b' GROUP BY ALL), kept AS (
  SELECT * FROM met QUALIFY count(*) OVER (PARTITION BY doc, item, shift, run) > {last}
), laned AS (
  SELECT m.*, l.lane FROM kept m JOIN sizes USING (item)
  JOIN (SELECT DISTINCT doc, item, shift AS lane FROM kept) l ON l.doc = m.doc AND l.item = m.item AND m.shift BETWEEN lane AND lane + floor(size * {reach})
), pairs AS (
  SELECT doc, item, lane, w, v, count(DISTINCT ipos) AS n FROM laned WHERE t[1] = chr(1) GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc, item, lane, w ORDER BY n DESC, v) AS i, row_number() OVER (PARTITION BY doc, item, lane, v ORDER BY n DESC, w) AS j FROM pairs
), judged AS (
  SELECT m.doc, m.item, m.lane, count(DISTINCT CASE WHEN t[1] = chr(1) THEN ipos END) AS n_slots,
    count(DISTINCT CASE WHEN t[1] = chr(1) AND m.v = m.w THEN ipos END) AS n_same, least(count(DISTINCT ipos), count(DISTINCT ipos + shift)) AS n_tokens
  FROM laned m LEFT JOIN ranked r ON t[1] = chr(1) AND r.doc = m.doc AND r.item = m.item AND r.lane = m.lane AND r.w = m.w AND r.v = m.v
  WHERE r.i IS NULL OR m.v = m.w OR (r.i = 1 AND r.j = 1) GROUP BY ALL
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc, item ORDER BY n_tokens DESC, n_slots - n_same, lane) AS k FROM judged
)
SELECT doc AS doc_id, item AS item_id, n_tokens, round(n_tokens / size, 6) AS coverage, n_slots, n_slots - n_same AS n_changed
FROM best JOIN sizes USING (item) WHERE k = 1 AND n_tokens / size >= {coverage}
"""


def sql(window: int = 6, coverage: float = 0.5, reach: float = 0.25) -> str:
    filled = SQL.replace("{units}", ", ".join(f"'{u}'" for u in UNITS)).replace("{reach}", str(reach))
    return filled.replace("{last}", str(window - 1)).replace("{coverage}", str(coverage))
