"""The Merkle manifest against a plain tree, over several passes of blocks; versions against trees built anew."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hydrospark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n = row
    values = [doc_id, source, lang, None if n is None else n + more, text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way(tree, at):
    for nodes in tree[:-1]:
        yield nodes[at ^ 1] if (at ^ 1) < len(nodes) else None, at & 1
        at >>= 1


def plain(rows):
    """doc_id, leaf, subroot, root, proof, folded root of every row, and the copies of every version."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault(r[2], []).append(r)
    trees = {g: levels([leaf(r) for r in rs]) for g, rs in groups.items()}
    wood = levels([t[-1][0] for t in trees.values()])
    out = []
    for k, (g, rs) in enumerate(groups.items()):
        for i, r in enumerate(rs):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            path = [*way(trees[g], i), *way(wood, k)]
            node = leaf(r, 1 if bad else 0)
            copies = []
            for other, right in path:
                node = h(node) if other is None else h(other, node) if right else h(node, other)
                copies.append(node)
            out.append((r[0], leaf(r), trees[g][-1][0], wood[-1][0], h(*(o for o, _ in path if o)), node, tuple(copies)))
    return sorted(out, key=str)


def table(rng, sizes):
    rows = []
    for lang, n in sizes.items():
        ids = [rng.choice([None, 5, *range(1000)]) for _ in range(n)]
        rows += [(i, rng.choice([None, "", "é x" * 3, f"t{i}"]), lang, rng.choice([None, "a", "ü"]), rng.choice([None, 3, 10**12])) for i in ids]
    return rows


@pytest.mark.parametrize("sizes,height", [({"a": 1}, 2), ({None: 3, "a": 1, "b": 4, "ü": 5, "z": 37, "{": 70}, 2), ({"a": 33, "b": 64}, 3), ({f"g{i}": 2 for i in range(21)}, 2), ({"a": 40, None: 9}, 10)])
def test_against_a_plain_tree(spark, sizes, height):
    rows = table(random.Random(str(sizes)), sizes)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "group", "at", "hash", "path", "leaf", "root", "_pid")})
    made = merkle.manifest(docs, altered=F.crc32(F.col("doc_id").cast("string")) % 7 == 0, alteration={"n_chars": F.col("n_chars") + 1}, height=height)
    got = made.leaves.withColumn("proof", merkle.proof_sha256()).collect()
    assert sorted(((r["id"], r["leaf"], r["subroot"], r["root"], r["proof"], r["folded_root"], tuple(r["copies"])) for r in got), key=str) == plain(rows)
    # a version owns the nodes from its leaf to the root and nothing else
    owned = made.versions().collect()
    changed = [r for r in got if r["changed"]]
    assert len(owned) == sum(1 + len(r["copies"]) for r in changed)
    assert all(r["folded_root"] != r["root"] for r in changed) and all(r["folded_root"] == r["root"] for r in got if not r["changed"])


def test_a_version_is_the_tree_of_the_changed_table(spark):
    rows = [(i, f"text {i}", "a" if i % 3 else "b", "s", i) for i in range(50)]
    changed = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 0)
    made = merkle.manifest(spark.createDataFrame(rows, SCHEMA), altered=F.col("doc_id") == changed, alteration={"n_chars": F.col("n_chars") + 1}, height=2)
    again = merkle.manifest(spark.createDataFrame([(*r[:4], r[4] + (r[0] == changed)) for r in rows], SCHEMA), height=2)
    version = made.leaves.filter(F.col("id") == changed).first()
    assert version["folded_root"] == again.leaves.first()["root"] != version["root"]


def test_no_rows(spark):
    made = merkle.manifest(spark.createDataFrame([], SCHEMA), altered=F.lit(True), alteration={"n_chars": F.lit(1)})
    assert made.leaves.count() == 0 and made.versions().count() == 0
