"""Hard negatives by an inverted multi-index: exact top rows inside score windows, cells visited best first.

Vectors become integers and are cut into two halves, each half has a codebook of its own, and a pair of
codewords is a cell. The inner product of an anchor with any row of a cell is at most the sum of two half-scores:
the product with the codeword plus the anchor's norm times the radius of that codeword's rows. A
multi-sequence heap walks the cells by this bound, highest first, and an anchor is done as soon as the next
bound is below what its windows still need: then no unseen row can change them. The codebooks are fitted on a
bounded sample; every row is indexed and the radii are over all rows, so the answer is exact whatever the codebooks are.

Rows of a cell lie in blocks of about ``BLOCK`` rows, anchors of a cell in packs of about ``PACK``; a task
multiplies one pack with one block at a time. Rounds visit a growing number of cells.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hydrospark.llm.common import bounded_broadcast, cut

BLOCK, PACK = 1024, 256
#: Cells visited in the first round, and how many times as many in each further one.
FIRST, MORE = 8, 8
LOWEST, HIGHEST = -(2**62), 2**62
#: Components are below this in absolute value; their products then fit in a long for up to 2 ** 6 components.
LARGEST = 2**20


def codebook(points: np.ndarray, size: int, rounds: int = 8) -> np.ndarray:
    """Codewords of a sample by Lloyd's rounds, started from its first distinct rows."""
    _, first = np.unique(points, axis=0, return_index=True)
    words = points[np.sort(first)[:size]].astype(float)
    for _ in range(rounds):
        near = nearest(points, words)[0]
        counts = np.bincount(near, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, near, points)
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
    return words


def nearest(points: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each point and the distance to it."""
    far = (words * words).sum(1)[None, :] - 2.0 * points @ words.T
    near = far.argmin(1)
    return near, np.sqrt(((points - words[near]) ** 2).sum(1))


def multi_sequence(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """All pairs (i, j) by ``left[i] + right[j]``, highest first: a heap over two sorted lists."""
    a, b = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    heap, seen = [(-(left[a[0]] + right[b[0]]), 0, 0)], {(0, 0)}
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(a[i]), int(b[j])
        for i2, j2 in ((i + 1, j), (i, j + 1)):
            if i2 < len(a) and j2 < len(b) and (i2, j2) not in seen:
                seen.add((i2, j2))
                heapq.heappush(heap, (-(left[a[i2]] + right[b[j2]]), i2, j2))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows: in doubles where they hold them, else in longs."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column without nulls, shorter ones filled up with zeros."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(ends)
    if len(sizes) and (sizes == dim).all():
        return flat[ends[0]:ends[-1]].reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        out[i, :b - a] = flat[a:b]
    return out


class Index:
    """The rows by cell in blocks, the anchors in packs, and the codebooks with their radii."""

    def __init__(self, rows: DataFrame, anchors: Column, scale: float, sample: int, id_col: str, vector: str, label: str):
        base = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("v"),
                           F.coalesce(anchors, F.lit(False)).alias("anchor"))
        base = base.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(
            F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < LARGEST)))
        self.n, dim = base.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
        if self.n == 0:
            return
        dim, half = max(dim, 2), max(dim, 2) // 2
        size = int(min(max(np.ceil(np.sqrt(self.n / BLOCK)), 4), 64))
        drawn = base.select("v").orderBy(F.xxhash64("id", F.lit(13)), "id").limit(sample).toArrow().column("v").combine_chunks()
        points = np.floor(scale * matrix(drawn, dim))
        self.words = words = [codebook(points[:, :half], size), codebook(points[:, half:], size)]
        self.half, self.dim = half, dim

        def assign(batches):
            for b in batches:
                q = np.floor(scale * matrix(b.column("v"), dim))
                (c1, r1), (c2, r2) = nearest(q[:, :half], words[0]), nearest(q[:, half:], words[1])
                raw = q.astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("label"), b.column("anchor"), pa.array(c1.astype(np.int32)), pa.array(c2.astype(np.int32)), pa.array(r1), pa.array(r2),
                     pa.array([r.tobytes() for r in raw], pa.binary())], names=["id", "label", "anchor", "c1", "c2", "r1", "r2", "q"])

        self.rows = cut(base.mapInArrow(assign, "id bigint, label bigint, anchor boolean, c1 int, c2 int, r1 double, r2 double, q binary"))
        # one row per codeword
        radius = [{r[0]: r[1] for r in self.rows.groupBy(c).agg(F.max(d)).collect()} for c, d in (("c1", "r1"), ("c2", "r2"))]
        self.radii = [np.array([radius[k].get(i, 0.0) for i in range(len(words[k]))]) for k in (0, 1)]
        self.blocks = cut(self._gathered(self.rows, BLOCK))
        self.packs = cut(self._gathered(self.rows.filter("anchor"), PACK).withColumn("pack", F.monotonically_increasing_id()).drop("c1", "c2"))

    @staticmethod
    def _gathered(rows: DataFrame, size: int) -> DataFrame:
        """Rows of each cell dealt into groups of about ``size``: (c1, c2, n, ids, labels, q), sorted by id."""
        per_cell = cut(rows.groupBy("c1", "c2").agg(F.ceil(F.count(F.lit(1)) / size).alias("deals")))
        # cells are at most the product of two codebooks
        dealt = rows.join(F.broadcast(per_cell), ["c1", "c2"]).withColumn("deal", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("deals")))

        def pack(t: pa.Table) -> pa.Table:
            t = t.sort_by("id")
            return pa.table({"c1": t.column("c1")[:1], "c2": t.column("c2")[:1], "n": pa.array([t.num_rows], pa.int32()),
                             "ids": pa.array([t.column("id").to_numpy().astype("<i8").tobytes()], pa.binary()),
                             "labels": pa.array([t.column("label").to_numpy().astype("<i8").tobytes()], pa.binary()),
                             "q": pa.array([b"".join(t.column("q").to_pylist())], pa.binary())})

        return dealt.select("c1", "c2", "deal", "id", "label", "q").groupBy("c1", "c2", "deal").applyInArrow(pack, "c1 int, c2 int, n int, ids binary, labels binary, q binary")

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds of the half-scores of one anchor, per codeword of either half."""
        out = []
        for part, words, radii in zip((a[:self.half], a[self.half:]), self.words, self.radii):
            top = words @ part + np.sqrt((part * part).sum()) * radii
            out.append(top + 1e-3 + 1e-9 * np.abs(top))
        return out[0], out[1]


class _Bounds:
    """What tasks need of an index: codewords and radii."""

    def __init__(self, index: Index):
        self.half, self.dim, self.words, self.radii = index.half, index.dim, index.words, index.radii

    bounds = Index.bounds


REQUEST = "c1 int, c2 int, pack bigint, idx binary, mine binary, kinds binary, vectors binary, wins binary"


def _visits(index: _Bounds, start: int, stop: int):
    """Cells from place ``start`` to ``stop`` of each anchor's walk, while their bound reaches what its windows need."""
    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in ("pack", "ids", "labels", "q", "wins")}
                ids, kinds = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
                q = np.frombuffer(row["q"], "<i4").reshape(len(ids), index.dim)
                wins: dict[int, list[tuple[int, int, int]]] = {}
                for w in row["wins"] or []:
                    wins.setdefault(w["idx"], []).append((w["w"], w["floor"], w["hi"]))
                wide = max(map(len, wins.values()), default=0)
                lists = np.zeros((len(ids), wide, 3), np.int64)
                lists[:, :, 1] = 1  # an empty window
                cells = {}
                for i, found in wins.items():
                    lists[i, :len(found)] = found
                    need = min(f for _, f, _ in found)
                    for place, (bound, c1, c2) in enumerate(multi_sequence(*index.bounds(q[i].astype(float)))):
                        if place >= stop or bound < need:
                            break
                        if place >= start:
                            cells.setdefault((c1, c2), []).append(i)
                packs = [(c1, c2, row["pack"], np.array(m, "<i4")) for (c1, c2), m in cells.items()]
                for a in range(0, len(packs), 64):
                    part = packs[a:a + 64]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([p[0] for p in part], pa.int32()), pa.array([p[1] for p in part], pa.int32()), pa.array([p[2] for p in part], pa.int64()),
                        *(pa.array([x(p[3]).tobytes() for p in part], pa.binary()) for x in (lambda m: m, lambda m: ids[m], lambda m: kinds[m], lambda m: q[m], lambda m: lists[m]))],
                        names=["c1", "c2", "pack", "idx", "mine", "kinds", "vectors", "wins"])
    return run


def _scores(same: bool, dim: int, k: int):
    """The best ``k`` rows of one block for each window of the anchors of one pack that came to its cell."""
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                raw = {c: b.column(c)[r].as_py() for c in ("idx", "mine", "kinds", "vectors", "wins", "ids", "labels", "q")}
                idx, mine, kinds = np.frombuffer(raw["idx"], "<i4"), np.frombuffer(raw["mine"], "<i8"), np.frombuffer(raw["kinds"], "<i8")
                ids, labels = np.frombuffer(raw["ids"], "<i8"), np.frombuffer(raw["labels"], "<i8")
                wins = np.frombuffer(raw["wins"], "<i8").reshape(len(idx), -1, 3)
                s = products(np.frombuffer(raw["vectors"], "<i4").reshape(len(idx), dim), np.frombuffer(raw["q"], "<i4").reshape(len(ids), dim))
                fits = (labels[None, :] == kinds[:, None]) & (ids[None, :] != mine[:, None]) if same else labels[None, :] != kinds[:, None]
                fits &= (s >= wins[:, :, 1].min(1)[:, None]) & (s <= wins[:, :, 2].max(1)[:, None])
                out = []
                for i in np.flatnonzero(fits.any(1)):
                    at = np.flatnonzero(fits[i])
                    # rows lie by id, and the sort keeps that order among equal scores
                    at = at[np.argsort(-s[i, at], kind="stable")]
                    found = s[i, at]
                    for w, low, high in wins[i]:
                        if low > high:
                            continue
                        a = np.searchsorted(-found, -high, side="left")
                        top = at[a:a + k][found[a:a + k] >= low]
                        out += [(idx[i], mine[i], w, s[i, j], ids[j]) for j in top]
                if out:
                    cols = np.array(out, np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), b.column("pack")[r].as_py(), np.int64)), *map(pa.array, cols)], names=["pack", "idx", "mine", "w", "score", "id"])
    return run


BEST = "pack bigint, idx bigint, mine bigint, w bigint, score bigint, id bigint"


def search(index: Index, windows: DataFrame, same: bool, k: int) -> DataFrame:
    """The ``k`` best rows of each window: (pack, idx, mine, w, score, id, rank), ``mine`` being the anchor's id.

    ``windows``: (pack, idx, w, lo, hi), bounds of the score inclusive. With ``same`` rows of the anchor's label
    other than the anchor count, else rows of other labels. Higher scores first, then smaller ids.
    """
    known = _Bounds(index)
    cells = len(index.words[0]) * len(index.words[1])
    order = Window.partitionBy("pack", "idx", "w").orderBy(F.desc("score"), "id")
    best, start, stop = None, 0, FIRST
    while True:
        floors = windows.withColumn("floor", F.col("lo"))
        if best is not None:
            # a full window needs no more than ties of its last row, which a smaller id may win
            last = best.filter(F.col("rank") == k).select("pack", "idx", "w", F.col("score").alias("last"))
            floors = windows.join(last, ["pack", "idx", "w"], "left").withColumn("floor", F.greatest("lo", F.coalesce("last", "lo")))
        # a pack has about PACK anchors of at most as many windows as positives are asked for
        held = floors.filter("floor <= hi").groupBy("pack").agg(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), F.col("w").cast("bigint").alias("w"), "floor", "hi")).alias("wins"))
        asked = cut(index.packs.join(held, "pack").select("pack", "ids", "labels", "q", "wins").mapInArrow(_visits(known, start, stop), REQUEST))
        if asked.isEmpty():
            break
        found = asked.join(index.blocks, ["c1", "c2"]).drop("c1", "c2").mapInArrow(_scores(same, index.dim, k), BEST)
        both = found if best is None else found.unionByName(best.drop("rank"))
        best = cut(both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
        if stop >= cells:
            break
        start, stop = stop, stop * MORE
    return best if best is not None else index.rows.sparkSession.createDataFrame([], BEST + ", rank int")


def hard_negatives(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0,
                   n_positives: int = 5, n_negatives: int = 5, least: int = 80, most: int = 100, sample: int = 8192) -> DataFrame:
    """Hard negatives of each anchor and positive: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become ``floor(scale * x)``; the score of two rows is their integer inner product. An anchor's
    positives are its ``n_positives`` best other rows of its label. For each of them the ``n_negatives`` best rows
    of other labels with ``least * positive <= 100 * negative <= most * positive`` are told, of equal scores
    the smaller id first; ``rank`` counts those told. Windows that hold fewer rows tell all of them.

    Rows with a null id, label, vector or component, or a component that is not finite or above 2 ** 20 once
    scaled, take no part. Shorter vectors are filled up with zeros. Rows of one id are not "other" rows to each
    other; as negatives each of them counts. An empty table, or one without anchors, gives no rows. ``sample``
    bounds the rows on which the codebooks are fitted, the first by a hash of their id; all rows are indexed.
    """
    spark = rows.sparkSession
    index = Index(rows, anchors, scale, sample, id_col, vector, label)
    if index.n == 0:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    every = index.packs.select("pack", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("n") - 1).cast("bigint"))).alias("idx"))
    wide = every.withColumns({"w": F.lit(0).cast("bigint"), "lo": F.lit(LOWEST).cast("bigint"), "hi": F.lit(HIGHEST).cast("bigint")})
    positives = search(index, wide, True, n_positives).select(
        "pack", "idx", F.col("mine").alias("anchor_id"), F.col("rank").cast("bigint").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # smallest and largest whole numbers within the two bounds; div cuts toward zero
    lo = F.expr(f"(positive_score * {least}L) div 100 + IF(positive_score > 0 AND (positive_score * {least}L) % 100 != 0, 1, 0)")
    hi = F.expr(f"(positive_score * {most}L) div 100 - IF(positive_score < 0 AND (positive_score * {most}L) % 100 != 0, 1, 0)")
    windows = cut(positives.select("pack", "idx", "w", lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi")).filter("lo <= hi"))
    negatives = search(index, windows, False, n_negatives).select("pack", "idx", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return negatives.join(positives, ["pack", "idx", "w"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same by definition: every anchor against every row.
SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
       n.id AS negative_id, positive_score, n.score AS negative_score
FROM p JOIN s n USING (anchor_id) WHERE NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
QUALIFY rank <= 5
"""


def sql() -> str:
    return SQL
