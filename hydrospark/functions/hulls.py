"""Convex hulls of grid cells, as functions for ``mapInArrow`` and ``groupBy(block).applyInArrow``: cells of a batch or a block at most."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: A node of one level spans 2 ** BITS nodes of the level below, a block LEVELS levels.
BITS, LEVELS = 2, 6

Cells = list[tuple[int, int]]


def hull(cells: Cells) -> Cells:
    """Corners of the convex hull of sorted distinct cells."""
    if len(cells) < 3:
        return cells
    out: Cells = []
    for way in (cells, cells[::-1]):
        half: Cells = []
        for r, c in way:
            while len(half) > 1:
                (r0, c0), (r1, c1) = half[-2:]
                if (r1 - r0) * (c - c0) > (c1 - c0) * (r - r0):
                    break
                half.pop()
            half.append((r, c))
        out += half[:-1]
    return out


def runs(key: np.ndarray, r: np.ndarray, c: np.ndarray) -> Iterator[tuple[int, Cells]]:
    """(key, hull of its cells) of the rows of three columns in any order."""
    order = np.lexsort((c, r, key))
    key, r, c = key[order], r[order], c[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (r[1:] != r[:-1]) | (c[1:] != c[:-1])]
    key, r, c = key[new], r[new].tolist(), c[new].tolist()
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        yield int(key[a]), hull(list(zip(r[a:b], c[a:b])))


def corners(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, r, c) that are corners of the hull of a label's rows in one batch."""
    for batch in batches:
        if batch.num_rows:
            found = [(k, r, c) for k, cells in runs(*[batch.column(n).to_numpy() for n in ("label", "r", "c")]) for r, c in cells]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*found), (pa.int64(), pa.int32(), pa.int32()))], names=["label", "r", "c"])


def block(base: int):
    """Rows (node, r, c) of the nodes of level ``base`` in a block to (level, node, cells): hulls of the nodes of LEVELS levels and of the block."""
    def run(table: pa.Table) -> pa.Table:
        level, node, size, cells = [], [], [], []
        nodes = dict(runs(*[table.column(n).to_numpy() for n in ("node", "r", "c")]))
        for k in range(LEVELS + 1):
            if k:
                above: dict[int, Cells] = {}
                for n, found in nodes.items():
                    above.setdefault(n >> BITS, []).extend(found)
                nodes = {n: hull(sorted(set(found))) for n, found in above.items()}
            level += [base + k] * len(nodes)
            node += nodes
            for found in nodes.values():
                size.append(len(found))
                cells += found
        r, c = [pa.array(x, pa.int32()) for x in zip(*cells)]
        held = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.StructArray.from_arrays([r, c], ["r", "c"]))
        return pa.table({"level": pa.array(level, pa.int32()), "node": pa.array(node, pa.int64()), "cells": held})
    return run
