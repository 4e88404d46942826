"""Temperature mixing: source shares raised to a found exponent, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hydrospark.llm.common import bounded_broadcast, cut

#: The exponent is sought in steps of one millionth: three rounds of a hundred probes.
STEPS = 1_000_000
ROUNDS = (10_000, 100, 1)


def n_tokens(text: Column) -> Column:
    """Pieces of a text between blanks and line feeds."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.length(text) - F.length(F.translate(text, " \n", "")) + 1).cast("bigint")


def keyed(*parts: Column | str) -> Column:
    """52 bits of a hash of the parts that every engine computes alike."""
    text = F.concat_ws("|", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def probe(shares: DataFrame, steps: list[int], budget_over_total: float) -> list:
    """For each exponent: entropy of the normalised weights and the most passes over any source.

    ``shares`` has one row per source; one aggregation answers all probes, and one row per probe returns.
    """
    rows = shares.select("p", F.explode(F.array(*[F.lit(s) for s in steps])).alias("step")).withColumn("a", F.col("step") / float(STEPS))
    power = F.pow("p", "a")
    sums = rows.groupBy("step").agg(F.sum(power).alias("z"), F.sum(power * F.ln("p")).alias("s"), F.max(power / F.col("p")).alias("m"), F.first("a").alias("a"))
    return sums.select("step", (F.ln("z") - F.col("a") * F.col("s") / F.col("z")).alias("entropy"), (F.col("m") / F.col("z") * budget_over_total).alias("passes")).collect()


def exponent(shares: DataFrame, target: float, most_passes: float, budget_over_total: float) -> int:
    """Exponent in steps: the largest whose entropy reaches the target, or the smallest that keeps the repetition limit if that is larger.

    Entropy and repetition both fall as the exponent grows, so each border is found by narrowing an
    interval a hundredfold per round.
    """
    even, again = 0, 0  # the last step known to reach the target; the last known to break the limit (or 0)
    for width in ROUNDS:
        steps = sorted({min(b + i * width, STEPS) for b in (even, again) for i in range(101)})
        seen = {r["step"]: r for r in probe(shares, steps, budget_over_total)}
        even = max((s for s in steps if seen[s]["entropy"] >= target - 1e-12), default=0)
        broken = [s for s in steps if seen[s]["passes"] > most_passes + 1e-12]
        again = max(broken, default=0)
    limit = again + 1 if broken else 0
    return min(max(even, limit), STEPS)


def running_before(rows: DataFrame, keys: list[str], order: list[str], value: str, bits: int, size: int = 1000) -> DataFrame:
    """``rows`` plus ``before``: the sum of ``value`` over the earlier rows of its group.

    ``order`` starts with an evenly spread number of ``bits`` bits. Its range is cut into stretches of
    about ``size`` rows; the stretches' totals are summed up first, so no task sees a whole group.
    """
    counts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("bigint").alias("_cuts"))
    cutted = rows.join(bounded_broadcast(cut(counts), 100_000), keys).withColumn("_cut", F.floor(F.col(order[0]) / float(1 << bits) * F.col("_cuts")).cast("bigint"))
    totals = cutted.groupBy(*keys, "_cut").agg(F.sum(value).alias("_t"))
    earlier = F.coalesce(F.sum("_t").over(W.partitionBy(*keys).orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*keys, "_cut", earlier.alias("_base"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy(*keys, "_cut").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cutted.withColumn("before", inside).join(totals, [*keys, "_cut"]).withColumn("before", F.col("before") + F.col("_base")).drop("_cut", "_cuts", "_base")


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", entropy_share: float = 0.97, most_passes: float = 4.0,
        budget_share: float = 1.0, block_docs: int = 1000, seed: int = 17) -> DataFrame:
    """One row per document and pass of the mixed stream: id, source, ``n_tokens``, ``pass``, ``block``, ``place``.

    Sources are weighted by their token share to the power of an exponent in [0, 1]: the largest one at
    which the weights' entropy reaches ``entropy_share`` of the even mix's, but no smaller than the one at
    which no source is read more than ``most_passes`` times. The budget is ``budget_share`` of all tokens
    (at most ``most_passes`` of them); each source's quota is its weight of it, rounded down.

    A source's documents are dealt by hash into blocks of about ``block_docs``. Each pass takes the blocks
    in another order; whole passes come first, and the last one stops at the quota, inside its last block
    at the last document that fits. ``place`` in [0, 1) is where a block begins in the source's quota:
    ordering all rows by it gives a stream that has the target weights throughout.

    Null sources are a source of their own. Null or empty texts have no tokens and are not part of the
    mix. Repeated rows count each. An empty table gives an empty mix. Other columns are left out.
    """
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), n_tokens(F.col(text)).alias("n"))
               .filter("n > 0").withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))).withColumn("deal", keyed(F.lit(seed), "id")))
    sizes = cut(rows.groupBy("name").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("d")))
    whole = sizes.agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("k")).head()
    total, k = whole["t"] or 0, whole["k"]
    budget = math.floor(min(budget_share, most_passes) * total)
    shares = cut(sizes.withColumn("p", F.col("t") / float(max(total, 1))))
    alpha = exponent(shares, entropy_share * math.log(max(k, 1)), most_passes, budget / max(total, 1)) / STEPS if k else 1.0
    power = F.pow("p", F.lit(alpha))
    z = shares.agg(F.sum(power).alias("z")).head()["z"] or 1.0
    quota = F.floor(F.round(power / F.lit(z), 12) * F.lit(budget)).cast("bigint")
    plan = shares.withColumn("quota", quota).filter("quota > 0").select(
        "name", "t", "quota", F.expr("quota div t").alias("full"), F.expr("quota % t").alias("rest"), F.ceil(F.col("d") / block_docs).cast("bigint").alias("blocks"))
    plan = cut(plan)
    dealt = cut(rows.join(bounded_broadcast(plan.select("name", "blocks"), 100_000), "name").withColumn("block", F.pmod("deal", "blocks"))
                .select("id", "source", "name", "n", "block"))
    blocks = dealt.groupBy("name", "block").agg(F.sum("n").alias("bt")).join(bounded_broadcast(plan, 100_000), "name")
    blocks = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), "full"))).filter("pass < full OR rest > 0")
    blocks = cut(running_before(blocks.withColumn("o", keyed(F.lit(seed), "pass", "name", "block")), ["name", "pass"], ["o", "block"], "bt", 52))
    place = F.round((F.col("pass") * F.col("t") + F.col("before")) / F.col("quota"), 9)
    used = blocks.filter("pass < full OR before < rest").select(
        "name", "block", "pass", place.alias("place"), F.when((F.col("pass") == F.col("full")) & (F.col("before") + F.col("bt") > F.col("rest")),
                                                             F.col("rest") - F.col("before")).alias("room"))
    taken = dealt.join(used, ["name", "block"])
    cols = [F.col("id").alias(id_col), F.col("source").alias(source), F.col("n").alias("n_tokens"), "pass", "block", "place"]
    inside = W.partitionBy("name", "pass", "block").orderBy(keyed(F.lit(seed), "pass", "id"), "id", "n").rowsBetween(W.unboundedPreceding, 0)
    last = taken.filter("room IS NOT NULL").withColumn("sum", F.sum("n").over(inside)).filter("sum <= room")
    return taken.filter("room IS NULL").select(*cols).unionByName(last.select(*cols))


#: The same by definition.
SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS name,
         CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE length(text) - length(translate(text, ' ' || chr(10), '')) + 1 END AS n FROM documents
), r AS (SELECT * FROM d WHERE n > 0),
s AS (SELECT name, sum(n)::BIGINT AS t, count(*) AS d FROM r GROUP BY name),
g AS (SELECT sum(t)::BIGINT AS total, count(*) AS k, floor(least({share}, {most}) * sum(t))::BIGINT AS budget FROM s),
p AS (SELECT s.*, t / total::DOUBLE AS p, total, k, budget FROM s, g),
e1 AS (SELECT max(step) AS b FROM (SELECT step, ln(sum(p ** (step / 1e6))) - step / 1e6 * sum(p ** (step / 1e6) * ln(p)) / sum(p ** (step / 1e6)) AS h, max(k) AS k
        FROM p, (SELECT unnest(range(0, 1000001, 10000)) AS step) GROUP BY step) WHERE h >= {entropy} * ln(k) - 1e-12),
e2 AS (SELECT max(step) AS b FROM (SELECT step, ln(sum(p ** (step / 1e6))) - step / 1e6 * sum(p ** (step / 1e6) * ln(p)) / sum(p ** (step / 1e6)) AS h, max(k) AS k
        FROM p, (SELECT unnest(range(b, least(b + 10001, 1000001), 100)) AS step FROM e1) GROUP BY step) WHERE h >= {entropy} * ln(k) - 1e-12),
e3 AS (SELECT max(step) AS b FROM (SELECT step, ln(sum(p ** (step / 1e6))) - step / 1e6 * sum(p ** (step / 1e6) * ln(p)) / sum(p ** (step / 1e6)) AS h, max(k) AS k
        FROM p, (SELECT unnest(range(b, least(b + 101, 1000001), 1)) AS step FROM e2) GROUP BY step) WHERE h >= {entropy} * ln(k) - 1e-12),
m1 AS (SELECT coalesce(max(step), -1) AS b FROM (SELECT step, max(p ** (step / 1e6) / p) / sum(p ** (step / 1e6)) * max(budget) / max(total) AS r
        FROM p, (SELECT unnest(range(0, 1000001, 10000)) AS step) GROUP BY step) WHERE r > {most} + 1e-12),
m2 AS (SELECT coalesce(max(step), -1) AS b FROM (SELECT step, max(p ** (step / 1e6) / p) / sum(p ** (step / 1e6)) * max(budget) / max(total) AS r
        FROM p, (SELECT unnest(range(greatest(b, 0), least(b + 10001, 1000001), 100)) AS step FROM m1) GROUP BY step) WHERE r > {most} + 1e-12),
m3 AS (SELECT coalesce(max(step), -1) AS b FROM (SELECT step, max(p ** (step / 1e6) / p) / sum(p ** (step / 1e6)) * max(budget) / max(total) AS r
        FROM p, (SELECT unnest(range(greatest(b, 0), least(b + 101, 1000001), 1)) AS step FROM m2) GROUP BY step) WHERE r > {most} + 1e-12),
a AS (SELECT least(greatest(e3.b, m3.b + 1), 1000000) / 1e6 AS a FROM e3, m3),
z AS (SELECT sum(p ** a) AS z FROM p, a),
q AS (SELECT name, t, ceil(d / {docs}.0)::BIGINT AS blocks, floor(round(p ** a / z, 12) * budget)::BIGINT AS quota FROM p, a, z),
w AS (SELECT *, quota // t AS f, quota % t AS rest FROM q WHERE quota > 0),
h AS (SELECT r.*, ('0x' || substr(md5('{seed}|' || doc_id), 1, 13))::BIGINT % blocks AS block FROM r JOIN w USING (name)),
b AS (SELECT name, block, sum(n)::BIGINT AS bt FROM h GROUP BY ALL),
x AS (SELECT b.*, t, quota, f, rest, pass FROM b JOIN (SELECT *, unnest(range(0, f + 1)) AS pass FROM w) USING (name) WHERE pass < f OR rest > 0),
y AS (SELECT *, coalesce(sum(bt) OVER (PARTITION BY name, pass ORDER BY ('0x' || substr(md5('{seed}|' || pass || '|' || name || '|' || block), 1, 13))::BIGINT, block
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x),
v AS (SELECT h.doc_id, h.source, h.n, y.pass, h.block, y.before, y.bt, y.rest, y.f, round((pass * t + before) / quota, 9) AS place,
        sum(h.n) OVER (PARTITION BY name, pass, block ORDER BY ('0x' || substr(md5('{seed}|' || pass || '|' || doc_id), 1, 13))::BIGINT, doc_id, h.n) AS upto
      FROM h JOIN y USING (name, block) WHERE pass < f OR before < rest)
SELECT doc_id, source, n AS n_tokens, pass, block, place FROM v WHERE pass < f OR before + upto <= rest
"""


def sql(entropy_share: float = 0.97, most_passes: float = 4.0, budget_share: float = 1.0, block_docs: int = 1000, seed: int = 17) -> str:
    return SQL.format(entropy=entropy_share, most=most_passes, share=budget_share, docs=block_docs, seed=seed)
