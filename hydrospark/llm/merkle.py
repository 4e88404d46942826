"""Merkle manifest of a dataset: leaves ranked per language, trees built in aligned blocks, tampering as versions.

The tree of a group (a language) stands over its leaves in id order: two neighbours become one parent, a
last single node becomes the parent of itself, until one node, the subroot, is left. The subroots in the order
of their groups are the leaves of one more such tree; its last node is the root of the dataset.

Work goes by aligned blocks of 1,024 neighbours: a block's parents depend on nothing outside it, so each
level of blocks is one grouped pass, and the table shrinks by that much a pass. The tree is persistent: a
changed leaf makes a *version* that owns its copied ancestors and shares every other node with the base tree.
A version's copies inside the block come from the block's own pass; its copies above are continued row by row
along the path of the block, which is one row a block.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hydrospark.llm.common import bounded_broadcast, cut
from hydrospark.operators.ordered import placed

#: Levels of an aligned block; its 2 ** HEIGHT leaves are all that one task holds of a tree at once.
HEIGHT = 10

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_hash(columns: dict[str, Column]) -> Column:
    """SHA-256 over ``-`` for a null, else the UTF-8 byte count, ``:`` and the value, column after column."""
    coded = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns.values()]
    return F.sha2(F.concat(*coded), 256)


def levels_of(leaves: list[str], height: int) -> list[list[str]]:
    """Nodes level by level, ``height`` levels above the leaves."""
    out = [leaves]
    for _ in range(height):
        last = out[-1]
        out.append([digest(*last[i:i + 2]) for i in range(0, len(last), 2)])
    return out


def siblings(levels: list[list[str]], at: int) -> list[str | None]:
    """The other child's node at each level below the top on the way up from leaf ``at``; None where there is none."""
    out = []
    for nodes in levels[:-1]:
        other = at ^ 1
        out.append(nodes[other] if other < len(nodes) else None)
        at >>= 1
    return out


def ancestors(node: str, at: int, path: list[str | None]) -> list[str]:
    """The nodes above ``node`` when it stands at ``at``: the copies a version owns if ``node`` is a changed one."""
    out = []
    for other in path:
        node = digest(node) if other is None else digest(other, node) if at & 1 else digest(node, other)
        out.append(node)
        at >>= 1
    return out


def build_blocks(nodes: DataFrame, keep: list[str], height: int = HEIGHT) -> DataFrame:
    """One pass over aligned blocks: per node its siblings and ancestors within the block, and the block's own node.

    ``nodes``: group, ``at`` (place in the group), ``n`` (nodes of the group), ``hash``, ``changed`` (the
    tampered hash or null). A group of no more nodes than a block ends here, with as many levels as it needs;
    the blocks of a larger one go up by ``height`` levels each. A task holds one block at a time.
    """
    kept = [f for f in nodes.schema.fields if f.name in keep]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    names = [f.name for f in kept]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        hashes, changed, n = table.column("hash").to_pylist(), table.column("changed").to_pylist(), table.column("n")[0].as_py()
        levels = levels_of(hashes, min(height, (n - 1).bit_length()))
        paths = [siblings(levels, i) for i in range(len(hashes))]
        arrays = [table.column(c) for c in names]
        arrays += [
            pa.array(paths, pa.list_(pa.string())),
            pa.array([ancestors(c or h, i, p) for i, (h, c, p) in enumerate(zip(hashes, changed, paths))], pa.list_(pa.string())),
            pa.array([levels[-1][0]] * len(hashes)),
        ]
        return pa.table(arrays, names=[*names, "path", "copies", "top"])

    # places are dense, so a block has 2 ** height rows at most
    return nodes.withColumn("_block", F.shiftright("at", height)).groupBy("group", "_block").applyInArrow(
        run, f"{ddl}, path array<string>, copies array<string>, top string")


def folded(start: Column, at: Column, path: Column) -> Column:
    """The nodes above ``start`` along ``path`` (siblings from below, null where there is none), as an array."""
    step = lambda acc, other: F.struct(
        F.shiftright(acc["at"], 1).alias("at"),
        F.array_append(acc["up"], F.sha2(F.when(other.isNull(), F.element_at(acc["up"], -1))
                                         .when(acc["at"].bitwiseAND(F.lit(1).cast("bigint")) == 1, F.concat(other, F.element_at(acc["up"], -1)))
                                         .otherwise(F.concat(F.element_at(acc["up"], -1), other)), 256)).alias("up"))
    first = F.struct(at.cast("bigint").alias("at"), F.array(start).alias("up"))
    return F.slice(F.aggregate(path, first, step, lambda acc: acc["up"]), 2, F.size(path) + 1)


@dataclass
class Manifest:
    """``leaves``: every row with its place, leaf, path and version; ``blocks``: one table a pass, base nodes of the upper levels."""

    leaves: DataFrame
    blocks: list[DataFrame]

    def versions(self) -> DataFrame:
        """(group, at, level, node_at, hash): the ancestors each tampered leaf owns, the leaf itself as level 0, up to the root.

        All other nodes of a version are the base tree's. Level counts go on from the group's tree into the tree of groups.
        """
        owned = F.concat(F.array("changed"), "copies")
        rows = self.leaves.filter("changed IS NOT NULL").select("group", "at", "n_levels", "group_at", F.posexplode(owned).alias("level", "hash"))
        at = F.when(F.col("level") <= F.col("n_levels"), F.expr("shiftright(at, level)")).otherwise(F.expr("shiftright(group_at, level - n_levels)"))
        return rows.select("group", "at", "level", at.alias("node_at"), "hash")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def manifest(docs: DataFrame, fields: list[str] = FIELDS, id_col: str = "doc_id", group: str = "lang", altered: Column | None = None,
             alteration: dict[str, Column] | None = None, height: int = HEIGHT) -> Manifest:
    """Tree, proofs and tampered versions of ``docs``.

    ``leaves`` has per row: ``id_col``, ``group``, ``at`` (place of the leaf), ``leaf``, ``subroot``, ``root``,
    ``path`` (siblings from the leaf to the root, null where a node is alone), ``changed`` (the tampered leaf, null
    where nothing changes), ``copies`` (the ancestors recomputed from the tampered, else the original leaf and the
    original siblings) and ``folded_root``, the last of them. Where ``altered`` is true, the leaf is hashed with
    the columns of ``alteration`` in place of the original ones; a version is a leaf whose hash differs.

    Null groups are a group of their own and come first, groups are ordered bytewise; null ids come first;
    rows of equal ids are ordered by leaf, so repeated rows stand side by side and each is a leaf. Columns not
    in ``fields`` are ignored. An empty table gives no rows and has no root.
    """
    block = 1 << height
    base = {f: F.col(f) for f in fields}
    leaf = leaf_hash(base)
    tampered = F.lit(None).cast("string")
    if altered is not None:
        again = leaf_hash(base | (alteration or {}))
        tampered = F.when(altered & (again != leaf), again)
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(group).alias("group"), leaf.alias("hash"), tampered.alias("changed")))

    # one range sort gives every leaf its place, however large a group is
    sorted_rows, parts = placed(rows, [F.col("group").asc(), F.col("id").asc(), F.col("hash").asc()])
    # parts: one row per partition of the sort
    sorted_rows = sorted_rows.join(F.broadcast(parts), "_pid").withColumn("_g", F.col("_off") + F.col("_idx"))
    firsts = cut(sorted_rows.groupBy("group").agg(F.min("_g").alias("first"), F.count(F.lit(1)).alias("n")).withColumnRenamed("group", "fgroup"))
    nodes = sorted_rows.join(bounded_broadcast(firsts), _same("group", "fgroup")).select(
        "id", "group", (F.col("_g") - F.col("first")).alias("at"), "n", "hash", "changed")

    passes = [cut(build_blocks(nodes, ["id", "group", "at", "n", "hash", "changed"], height))]
    while not passes[-1].filter(F.col("n") > block).isEmpty():
        low = passes[-1]
        # a block is one node of the next pass; groups that are done stay as they are
        up = low.groupBy("group", F.shiftright("at", height).alias("at")).agg(
            F.ceil(F.max("n") / block).alias("n"), F.max("top").alias("hash")).withColumn("changed", F.lit(None).cast("string"))
        passes.append(cut(build_blocks(up, ["group", "at", "n", "hash", "changed"], height)))

    # one node a group is left: the tree over the groups
    tops = passes[-1].groupBy("group").agg(F.max("top").alias("hash"))
    ordered, gparts = placed(cut(tops), [F.col("group").asc()])
    n_groups = ordered.count()
    subs = ordered.join(F.broadcast(gparts), "_pid").select(
        F.col("group").alias("name"), F.lit(0).alias("group"), (F.col("_off") + F.col("_idx")).alias("at"), F.lit(n_groups).cast("bigint").alias("n"), "hash", F.lit(None).cast("string").alias("changed"))
    tiers = [cut(build_blocks(subs, ["name", "group", "at", "n", "hash", "changed"], height))]
    while n_groups > block:
        n_groups = -(-n_groups // block)
        up = tiers[-1].groupBy(F.shiftright("at", height).alias("at")).agg(F.max("top").alias("hash")).select(
            F.lit(0).alias("group"), "at", F.lit(n_groups).cast("bigint").alias("n"), "hash", F.lit(None).cast("string").alias("changed"))
        tiers.append(cut(build_blocks(up, ["group", "at", "n", "hash", "changed"], height)))

    # paths grow from the top down: a node's own siblings in its block, then the path of its block
    above = tiers[-1].select("at", "path", F.col("top").alias("root"))
    for tier in reversed(tiers[:-1]):
        above = _continued(tier, above, [], ["root"], height)
    names = tiers[0].select("at", F.col("name").alias("group"), F.col("hash").alias("subroot"))
    paths = above.join(names, "at").withColumnRenamed("at", "group_at")
    last = passes[-1].join(bounded_broadcast(cut(paths.select(F.col("group").alias("pgroup"), F.col("path").alias("over"), "root", "subroot", "group_at"))), _same("group", "pgroup"))
    carried = ["root", "subroot", "group_at"]
    last = last.withColumns({"path": F.concat("path", "over"), "n_levels": F.size("path")})
    if len(passes) == 1:
        return Manifest(_versions(last, height), passes + tiers)
    above = cut(last.select("group", "at", "path", *carried, "n_levels"))
    for low in reversed(passes[1:-1]):
        above = cut(_continued(low, above, ["group"], [*carried, "n_levels"], height))
    leaves = _continued(passes[0], above, ["group"], [*carried, "n_levels"], height, ["id", "changed", "hash", "copies", "top"])
    return Manifest(_versions(leaves, height), passes + tiers)


def _continued(low: DataFrame, above: DataFrame, by: list[str], carried: list[str], height: int, more: list[str] = []) -> DataFrame:
    """The nodes of ``low``, each path with that of its block in ``above`` after it; ``n_levels`` adds up."""
    over = above.select(*[F.col(c).alias(f"o_{c}") for c in (*by, "at", "path", *carried)])
    on = [_same(c, f"o_{c}") for c in by] + [F.shiftright("at", height) == F.col("o_at")]
    joined = low.join(bounded_broadcast(over), on) if by else low.join(over, on)
    out = [F.col(c) for c in (*by, "at", *more)] + [F.concat("path", "o_path").alias("path")]
    for c in carried:
        out.append((F.size("path") + F.col("o_n_levels")).alias(c) if c == "n_levels" else F.col(f"o_{c}").alias(c))
    return joined.select(*out)


def _versions(leaves: DataFrame, height: int) -> DataFrame:
    """Each version goes on above its block: the last node it owns there is folded along the rest of the path."""
    own = F.size("copies")
    start = F.when(own > 0, F.element_at("copies", -1)).otherwise(F.coalesce("changed", "hash"))
    # the place of the block, then that of the group in the tree of groups
    at = F.when(own < F.col("n_levels"), F.shiftright("at", height)).otherwise(F.col("group_at"))
    inner = F.slice("path", own + 1, F.greatest(F.col("n_levels") - own, F.lit(0)))
    outer = F.slice("path", F.col("n_levels") + 1, F.greatest(F.size("path") - F.col("n_levels"), F.lit(0)))
    out = leaves.withColumn("copies", F.concat("copies", folded(start, at, inner)))
    out = out.withColumn("_top", F.when(F.size("copies") > 0, F.element_at("copies", -1)).otherwise(F.coalesce("changed", "hash")))
    out = out.withColumn("copies", F.concat("copies", folded(F.col("_top"), F.col("group_at"), outer)))
    end = F.when(F.size("copies") > 0, F.element_at("copies", -1)).otherwise(F.coalesce("changed", "hash"))
    return out.withColumn("folded_root", end).select(
        "id", "group", "at", F.col("hash").alias("leaf"), "changed", "n_levels", "group_at", "subroot", "root", "path", "copies", "folded_root")


def proof_sha256() -> Column:
    """One digest over the siblings on the path to the root, from below; levels at which a node is alone add nothing."""
    return F.sha2(F.array_join("path", ""), 256)


#: The same level by level over the whole table. crc32 is spelt out bit by bit.
SQL = r"""
WITH RECURSIVE src AS (
  SELECT doc_id, lang, source, n_chars, text, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)) AS crc FROM documents
), lf AS (
  SELECT doc_id, lang, sha256({enc_doc} || {enc_source} || {enc_lang} || {enc_n} || {enc_text}) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256({enc_doc} || {enc_source} || {enc_lang} || {enc_n1} || {enc_text}) END AS other FROM src
), pl AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM lf
), tree AS (
  SELECT lang, 0 AS lvl, pos, n, leaf AS h FROM pl
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lang, lvl, pos // 2
), sub AS (
  SELECT lang, h, lvl AS top, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), wood AS (
  SELECT 0 AS lvl, pos, n, h FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM wood WHERE n > 1 GROUP BY lvl, pos // 2
), steps AS (
  SELECT p.doc_id, p.leaf, s.h AS subroot, s.pos AS sat, p.pos AS pos, p.lang, t.lvl, t.h AS other, xor(p.pos // (1 << t.lvl), 1) AS oat
  FROM pl p JOIN sub s ON p.lang IS NOT DISTINCT FROM s.lang JOIN tree t ON t.lang IS NOT DISTINCT FROM p.lang AND t.n > 1 AND t.pos = xor(p.pos // (1 << t.lvl), 1)
  UNION ALL
  SELECT p.doc_id, p.leaf, s.h, s.pos, p.pos, p.lang, s.top + o.lvl, o.h, xor(s.pos // (1 << o.lvl), 1)
  FROM pl p JOIN sub s ON p.lang IS NOT DISTINCT FROM s.lang JOIN wood o ON o.n > 1 AND o.pos = xor(s.pos // (1 << o.lvl), 1)
), proof AS (
  SELECT lang, pos, string_agg(other, '' ORDER BY lvl) AS line, map(list(lvl), list(other)) AS sib, map(list(lvl), list(oat)) AS place FROM steps GROUP BY lang, pos
), fold AS (
  SELECT p.lang, p.pos, 0 AS lvl, s.top + (SELECT max(lvl) FROM wood) AS last, coalesce(p.other, p.leaf) AS h, f.sib, f.place
  FROM pl p JOIN sub s ON p.lang IS NOT DISTINCT FROM s.lang LEFT JOIN proof f ON f.lang IS NOT DISTINCT FROM p.lang AND f.pos = p.pos
  UNION ALL
  SELECT lang, pos, lvl + 1, last, CASE WHEN sib[lvl] IS NULL THEN sha256(h) WHEN place[lvl] % 2 = 0 THEN sha256(sib[lvl] || h) ELSE sha256(h || sib[lvl]) END, sib, place
  FROM fold WHERE lvl < last
), root AS (SELECT h AS root FROM wood WHERE n = 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, root, sha256(coalesce(f.line, '')) AS proof_sha256, d.h AS folded_root, d.h = root AS verified
FROM pl p JOIN sub s ON p.lang IS NOT DISTINCT FROM s.lang JOIN fold d ON d.lang IS NOT DISTINCT FROM p.lang AND d.pos = p.pos AND d.lvl = d.last
LEFT JOIN proof f ON f.lang IS NOT DISTINCT FROM p.lang AND f.pos = p.pos, root
"""


def sql() -> str:
    filled = SQL
    for name, column in (("doc", "doc_id"), ("source", "source"), ("lang", "lang"), ("n", "n_chars"), ("n1", "(n_chars + 1)"), ("text", "text")):
        filled = filled.replace("{enc_" + name + "}", f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')")
    return filled
