"""Regions of influence: donors by descriptor distance, homogeneous pools, shared regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hydrospark.functions.gev import AD_CRITICAL
from hydrospark.operators.ordered import ranked
from hydrospark.session import cut, dealt

BLOCK = 256


def split_gauged(sites: DataFrame, stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sites whose station has a series, and all others (an unknown station counts as none)."""
    known = stations.select(F.col("site").alias("gws_id")).distinct()
    gauged = sites.join(known, "gws_id", "left_semi")
    return gauged, sites.join(gauged.select("point_id"), "point_id", "left_anti")


def descriptor_scale(targets: DataFrame, gauged: DataFrame, descriptors: list[str]) -> dict[str, float | None]:
    """Standard deviation of each descriptor over all sites."""
    both = targets.select("point_id", *descriptors).unionByName(gauged.select("point_id", *descriptors)).dropDuplicates(["point_id"])
    return both.agg(*[F.stddev_samp(d).alias(d) for d in descriptors]).first().asDict()


def roi_distance(targets: DataFrame, gauged: DataFrame, descriptors: list[str], k: int, salts: int = 16, sd: dict[str, float | None] | None = None) -> DataFrame:
    """(site, rank, donor, distance): donors by Euclidean distance over standardised descriptors.

    Descriptors are scaled by ``sd``, by default their standard deviation over the sites given. Gauged sites travel as
    blocks of about a few hundred in one array; each target meets a block once, keeps its nearest
    ``k`` of the block inside the array, and the kept donors are ranked per target: at most ``k`` rows
    each. Targets are dealt over ``salts`` copies of every block, so few blocks still fill many tasks.
    """
    sd = sd or descriptor_scale(targets, gauged, descriptors)
    use = [d for d in descriptors if sd[d]]
    vec = F.array(*[F.col(d).cast("double") / float(sd[d]) for d in use])
    n_blocks = max(1, -(-gauged.count() // BLOCK))
    block = F.pmod(F.xxhash64("point_id"), F.lit(n_blocks)).cast("int")
    blocks = gauged.select(F.col("point_id").alias("donor"), vec.alias("dv"), block.alias("block")).groupBy("block").agg(
        F.collect_list(F.struct("donor", "dv")).alias("donors")
    ).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64("point_id"), F.lit(salts)).cast("int")
    # a target becomes k rows a block: they stay where the target was dealt to
    t = dealt(targets, "point_id").select(F.col("point_id").alias("site"), vec.alias("tv"), salt.alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    def dist(s):
        return F.sqrt(F.aggregate(
            F.zip_with(F.col("tv"), s["dv"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v
        ))
    near = F.array_sort(F.transform("donors", lambda s: F.struct(F.round(dist(s), 9).alias("distance"), s["donor"].alias("donor"))))
    rows = t.join(blocks, ["block", "salt"]).select("site", F.inline(F.slice(near, 1, k)))
    order = W.partitionBy("site").orderBy("distance", "donor")
    out = rows.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= k).select("site", "rank", "donor", "distance")


#: Harmonic numbers up to this one are listed, larger ones come from the asymptotic series.
_LISTED = 32


def harmonic(n: Column) -> Column:
    """Sum of 1 / i for i = 1 to n, to the last digits of a double."""
    listed = [0.0]
    for i in range(1, _LISTED):
        listed.append(listed[-1] + 1.0 / i)
    x = n.cast("double")
    far = F.ln(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4))) - 1 / (252 * F.pow(x, F.lit(6)))
    return F.when(n < _LISTED, F.get(F.array(*[F.lit(v) for v in listed]), n.cast("int"))).otherwise(far)


def ad_statistics(members: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, k, stat): the standardised k-sample Anderson-Darling statistic of each set of donors.

    ``members`` is (keys, donor), ``series`` (donor, x). The sum over all places of the pooled order turns into
    one over the values: each value moves its sample's count from its place on, so it adds a difference of
    two prefix sums that have closed forms. One window gives the place in the pool, one aggregation the rest;
    equal values share the first place of theirs. Sets too small for a variance get null.
    """
    within = W.partitionBy("donor").orderBy("x")
    # a donor's rows number its years
    own = series.select("donor", "x", F.row_number().over(within).alias("m"), F.count(F.lit(1)).over(W.partitionBy("donor")).alias("n"))
    pool = W.partitionBy(*keys)
    # a set lies in one task from here on: small rows become many by the join, and windows by set need no further shuffle
    rows = dealt(members, *keys).join(own, "donor").withColumns({"place": F.rank().over(pool.orderBy("x")), "pooled": F.count(F.lit(1)).over(pool)})
    big, n, before = F.col("pooled"), F.col("n"), F.col("place") - 1
    last, rest = harmonic(big - 1), harmonic(big - F.col("place"))
    # sums of 1 / (j (N - j)) and of 1 / (N - j) from the value's place to the end
    t = rest
    s = (2 * last - harmonic(before) - last + rest) / big
    term = big / n * (2 * F.col("m") - 1) * s - 2 * t
    sets = rows.groupBy(*keys).agg(F.max("pooled").alias("pooled"), F.sum(term).alias("a2"), F.count_distinct("donor").alias("k"), F.sum(1 / (n * n)).alias("hs"))
    sets = sets.withColumn("h", harmonic(big - 1))
    # sum of (h - H(i)) / (N - i) for i = 1 to N - 2
    step = lambda acc, i: F.struct((acc["h"] - 1 / i).alias("h"), (acc["g"] + (acc["h"] - 1 / i) / (F.col("pooled") - i)).alias("g"))
    g = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(big - 2, F.lit(1))), F.struct(F.col("h").alias("h"), F.lit(0.0).alias("g")), step, lambda acc: acc["g"])
    # a table of its own: the formula below names each of its columns many times
    sets = cut(sets.withColumns({"g": g, "k": F.col("k").cast("double"), "n": big.cast("double")}))
    n, k, h, g, hs = (F.col(c) for c in ("n", "k", "h", "g", "hs"))
    a = (4 * g - 6) * (k - 1) + (10 - 6 * g) * hs
    b = (2 * g - 4) * k * k + 8 * h * k + (2 * g - 14 * h - 4) * hs - 8 * h + 4 * g - 6
    c = (6 * h + 2 * g - 2) * k * k + (4 * h - 4 * g + 6) * k + (2 * h - 6) * hs + 4 * h
    d = (2 * h + 6) * k * k - 4 * h * k
    var = F.try_divide(a * n * n * n + b * n * n + c * n + d, (n - 1) * (n - 2) * (n - 3))
    a2 = F.col("a2") + n * h - (n - 1)
    return sets.select(*keys, k.cast("bigint").alias("k"), F.try_divide(a2 - (k - 1), F.sqrt(F.when(var > 0, var))).alias("stat"))


def hw_statistics(members: DataFrame, series: DataFrame, keys: list[str], sims: int = 500, seed: int = 123) -> DataFrame:
    """(keys, k, stat): Hosking and Wallis' heterogeneity H1 of each set of donors.

    L-moment ratios come from the ranks within each donor, a region's ratios are their means by record
    length, and its spread is that of the donors' L-CV. The spread is held against ``sims`` simulated regions of
    the same record lengths under the kappa law with the region's ratios; uniforms come from a hash of the set.
    Only record lengths and ratios leave the aggregation. Donors with fewer than four years take no part.
    """
    from hydrospark.functions.gev import heterogeneity_of
    by_value = W.partitionBy("donor").orderBy("x")
    own = series.select("donor", "x", (F.row_number().over(by_value) - 1).cast("double").alias("i"), F.count(F.lit(1)).over(W.partitionBy("donor")).alias("n"))
    x, i, n = F.col("x"), F.col("i"), F.col("n").cast("double")
    b = own.where("n >= 4").groupBy("donor", "n").agg(
        F.avg(x).alias("b0"), F.avg(x * i / (n - 1)).alias("b1"), F.avg(x * i * (i - 1) / ((n - 1) * (n - 2))).alias("b2"),
        F.avg(x * i * (i - 1) * (i - 2) / ((n - 1) * (n - 2) * (n - 3))).alias("b3"))
    l2 = 2 * F.col("b1") - F.col("b0")
    site = cut(b.select("donor", "n", F.try_divide(l2, F.col("b0")).alias("cv"), F.try_divide(6 * F.col("b2") - 6 * F.col("b1") + F.col("b0"), l2).alias("s3"),
                        F.try_divide(20 * F.col("b3") - 30 * F.col("b2") + 12 * F.col("b1") - F.col("b0"), l2).alias("s4")).where("cv IS NOT NULL AND s3 IS NOT NULL"))
    rows = members.join(site, "donor")
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    # a set's record lengths, one small number a donor
    sets = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.sort_array(F.collect_list(F.col("n").cast("int"))).alias("lengths"), mean("cv").alias("t"), mean("s3").alias("t3"), mean("s4").alias("t4"),
        F.sqrt(F.greatest(F.sum(F.col("cv") * F.col("cv") * F.col("n")) / F.sum("n") - mean("cv") * mean("cv"), F.lit(0.0))).alias("v"))
    sets = cut(sets.withColumn("key", F.xxhash64(F.lit(seed), *keys)))
    kinds = {f.name: f.dataType.simpleString() for f in sets.schema.fields}
    spread = sets.repartition(4 * members.sparkSession.sparkContext.defaultParallelism, *keys)
    return spread.mapInArrow(heterogeneity_of([*keys, "k"], sims), ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "k")) + ", stat double")


def homogeneous_pools(targets: DataFrame, gauged: DataFrame, descriptors: list[str], series: DataFrame, limit: float = 0.95,
                      first: int = 8, test: str = "AD", hw_limit: float = 2.0) -> DataFrame:
    """(site, rank, donor): for each target the longest run of nearest donors that is homogeneous.

    ``series`` is (donor, x), one row per year, scaled by the donor's mean; donors without a row take no part.
    ``test`` is "AD" (k-sample Anderson-Darling at confidence ``limit``) or "HW" (heterogeneity below ``hw_limit``).
    Donors are added one rank at a time and every pool on the way must pass; a target whose first two donors
    already differ gets its nearest donor alone. Ranks are tried in doubling blocks: only targets whose
    whole block passes go on. The test looks at a set of donors, not at a target, so targets that share a
    set share its test; a set is named by two sums of hashes, and its members are the leading donors of one
    of its targets, so neither series nor donors are ever gathered into an array.
    """
    if test not in ("AD", "HW"):
        raise ValueError(f"test {test!r} is neither 'AD' nor 'HW'")
    known = cut(gauged.join(series.select(F.col("donor").alias("point_id")).distinct(), "point_id", "left_semi"))
    series = cut(series.select("donor", F.col("x").cast("double").alias("x")).where(F.col("x").isNotNull()))
    total = known.count()
    # one scale for all rounds: the targets still open have another spread
    sd = descriptor_scale(targets, gauged, descriptors)
    b0, b1, b2 = AD_CRITICAL[limit]
    open_sites, done, size, parts = targets, 1, min(first, total), []
    along = W.partitionBy("site").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    name = lambda salt: F.sum(F.pmod(F.xxhash64("donor", F.lit(salt)), F.lit(2**40))).over(along)
    while True:
        roi = cut(roi_distance(open_sites, known, descriptors, size, sd=sd).select("site", "rank", "donor"))
        runs = cut(roi.select("site", F.col("rank").alias("k"), name(1).alias("h1"), name(2).alias("h2")).where(F.col("k") > done))
        sets = runs.groupBy("k", "h1", "h2").agg(F.min("site").alias("site"))
        members = sets.join(roi, "site").where(F.col("rank") <= F.col("k")).select("k", "h1", "h2", "donor").withColumnRenamed("k", "ranks")
        wide = F.col("k") - 1
        if test == "AD":
            stats, most = ad_statistics(members, series, ["ranks", "h1", "h2"]), b0 + b1 / F.sqrt(wide) + b2 / wide
        else:
            stats, most = hw_statistics(members, series, ["ranks", "h1", "h2"]), F.lit(hw_limit)
        failed = cut(stats.where(~F.coalesce(F.col("stat") <= most, F.lit(False))).select(F.col("ranks").alias("k"), "h1", "h2"))
        ended = cut(runs.join(failed, ["k", "h1", "h2"]).groupBy("site").agg((F.min("k") - 1).alias("last")))
        if size >= total:
            parts.append(roi.join(ended, "site", "left").where(F.col("rank") <= F.coalesce("last", F.lit(size))).select("site", "rank", "donor"))
            break
        parts.append(roi.join(ended, "site").where(F.col("rank") <= F.col("last")).select("site", "rank", "donor"))
        open_sites = cut(open_sites.join(ended.select(F.col("site").alias("point_id")), "point_id", "left_anti"))
        if open_sites.isEmpty():
            break
        done, size = size, min(2 * size, total)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shared_sets(pools: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(site, region) and (region, donor): targets with the same donor set share a region, numbered by first appearance.

    A set is named by its size and two sums of hashes of its donors, of whatever type their ids are.
    """
    name = lambda salt: F.sum(F.pmod(F.xxhash64("donor", F.lit(salt)), F.lit(2**40))).alias(f"h{salt}")
    sets = cut(pools.select("site", "donor").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("n"), name(1), name(2)))
    first = cut(sets.groupBy("n", "h1", "h2").agg(F.min("site").alias("first_site")))
    numbered = cut(ranked(first, "first_site", "first_site", None, "no", "_n").select("n", "h1", "h2", "first_site", F.concat(F.lit("hom_reg"), F.col("no").cast("string")).alias("region")))
    members = pools.select("site", "donor").distinct().join(numbered.select(F.col("first_site").alias("site"), "region"), "site").select("region", "donor")
    return sets.join(numbered, ["n", "h1", "h2"]).select("site", "region"), members


def region_pattern(pools: DataFrame) -> DataFrame:
    """(site, region): targets with the same donor set share a region, numbered by first appearance."""
    sets = pools.groupBy("site").agg(F.concat_ws("-", F.transform(F.array_sort(F.collect_set("donor")), lambda d: d.cast("string"))).alias("pattern"))
    first = cut(sets.groupBy("pattern").agg(F.min("site").alias("first_site")))
    numbered = ranked(first, "first_site", "first_site", None, "no", "_n")
    return sets.join(numbered.select("pattern", "no"), "pattern").select("site", "pattern", F.concat(F.lit("hom_reg"), F.col("no").cast("string")).alias("region"))
