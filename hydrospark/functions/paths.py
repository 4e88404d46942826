"""Flow paths inside one tile of cells, as functions for ``groupBy(tile).applyInArrow``: arrays of a tile at most."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Stands for no cell in arrays; tiles are 2 ** BITS cells wide and high.
NONE = -(1 << 62)
BITS = 8
#: Kinds of rows told of a tile.
INTO, ENTRY, ODD, CYCLE = 0, 1, 2, 3


def tile_of(cell: np.ndarray) -> np.ndarray:
    return (cell >> (32 + BITS)) * (1 << 32) + ((cell & 0xFFFFFFFF) >> BITS)


def column(table: pa.Table, name: str, kind=np.int64) -> np.ndarray:
    return table.column(name).to_numpy().astype(kind, copy=False)


def locate(cells: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted cell among the cells, -1 where it is not there."""
    if not len(cells):
        return np.full(len(wanted), -1)
    order = np.argsort(cells, kind="stable")
    at = order[np.minimum(np.searchsorted(cells[order], wanted), len(cells) - 1)]
    return np.where(cells[at] == wanted, at, -1)


def follow(jump: np.ndarray, length: np.ndarray, acc: np.ndarray, far: np.ndarray):
    """(end, length, acc, far): the last place of each path and the way to it; sums and longest ways of all places above.

    ``jump`` is the next place or -1. None if a path comes back to itself. Pointers double their reach each round.
    """
    jump, length, acc, far = jump.copy(), length.copy(), acc.copy(), far.copy()
    end = np.where(jump < 0, np.arange(len(jump)), -1)
    for _ in range(len(jump).bit_length() + 1):
        k = np.flatnonzero(jump >= 0)
        if not len(k):
            return end, length, acc, far
        to, more, reach = jump[k], acc[k], far[k] + length[k]
        np.add.at(acc, to, more)
        np.maximum.at(far, to, reach)
        length[k] += length[to].copy()
        end[k], jump[k] = end[to], jump[to]
    return None


def told(names: list[str], kinds: list, *columns) -> pa.Table:
    return pa.table({n: pa.array(c, type=k) for n, k, c in zip(names, kinds, columns, strict=True)})


def _nullable(cells: np.ndarray) -> pa.Array:
    return pa.array(cells, type=pa.int64(), mask=cells == NONE)


def _parts(table: pa.Table):
    """Rows of the cells of the tile, the other rows, and whether a cell comes twice or has no weight."""
    own = column(table, "mark") == 0
    cells = column(table, "cell")[own]
    return own, cells, len(np.unique(cells)) < len(cells)


def crossing(whole: bool):
    """Rows (cell, down, len, acc, far, mark) of a tile: its cells (mark 0) and, marked 1, those that a path of another tile enters.

    Without ``whole``: what leaves the tile (INTO: the cell entered, sum and longest way) and where a path goes on that
    enters (ENTRY: cell, the next cell entered, the way there). With it, marked rows bring sum and longest way from
    outside, and all cells get theirs.
    """
    def run(table: pa.Table) -> pa.Table:
        weight = table.schema.field("acc").type
        own, cells, odd = _parts(table)
        raw = table.column("acc").to_numpy()[own]
        names, kinds = ["kind", "cell", "nxt", "len", "acc", "far"], [pa.int8(), pa.int64(), pa.int64(), pa.float64(), weight, pa.float64()]

        def only(kind):
            return told(names, kinds, [kind], [None], [None], [None], [None], [None])

        if odd or table.filter(pa.array(own)).column("acc").null_count:
            return only(ODD)
        down, step = column(table, "down")[own], column(table, "len", np.float64)[own]
        acc, far = raw.astype(weight.to_pandas_dtype()), np.zeros(len(cells))
        enter = column(table, "cell")[~own]
        at = locate(cells, enter)
        if whole:
            ok = at >= 0
            np.add.at(acc, at[ok], table.column("acc").to_numpy()[~own][ok].astype(acc.dtype))
            np.maximum.at(far, at[ok], column(table, "far", np.float64)[~own][ok])
        leaves = (down != NONE) & (tile_of(down) != tile_of(cells))
        jump = np.where((down == NONE) | leaves, -1, locate(cells, down))
        found = follow(jump, np.where(jump >= 0, step, 0.0), acc, far)
        if found is None:
            return only(CYCLE)
        end, length, acc, far = found
        if whole:
            return told(names, kinds, np.full(len(cells), INTO, np.int8), cells, pa.nulls(len(cells), pa.int64()), pa.nulls(len(cells), pa.float64()), acc, far)
        x = np.flatnonzero(leaves)
        e = np.unique(at[at >= 0])
        on = leaves[end[e]]
        out = [
            np.r_[np.full(len(x), INTO, np.int8), np.full(len(e), ENTRY, np.int8)], np.r_[down[x], cells[e]],
            _nullable(np.r_[np.full(len(x), NONE), np.where(on, down[end[e]], NONE)]),
            np.r_[np.zeros(len(x)), length[e] + np.where(on, step[end[e]], 0.0)],
            np.r_[acc[x], np.zeros(len(e), acc.dtype)], np.r_[far[x] + step[x], np.zeros(len(e))],
        ]
        return told(names, kinds, *out)
    return run


def stopping(table: pa.Table) -> pa.Table:
    """Rows (cell, down, mark) of a tile, mark 0 its cells, 1 cells entered from another tile, 2 targets: where each path stops.

    (kind, cell, ptr, done): done at a target, or null at an end; else ``ptr`` is the cell entered in another tile.
    INTO rows are all cells, ENTRY rows those entered once more.
    """
    mark = column(table, "mark")
    own, cells, odd = _parts(table)
    names, kinds = ["kind", "cell", "ptr", "done"], [pa.int8(), pa.int64(), pa.int64(), pa.bool_()]
    if odd:
        return told(names, kinds, [ODD], [None], [None], [None])
    down, ids = column(table, "down")[own], column(table, "cell")
    stop = np.zeros(len(cells), bool)
    at = locate(cells, ids[mark == 2])
    stop[at[at >= 0]] = True
    leaves = ~stop & (down != NONE) & (tile_of(down) != tile_of(cells))
    jump = np.where(stop | leaves | (down == NONE), -1, locate(cells, down))
    found = follow(jump, np.zeros(len(cells)), np.zeros(len(cells)), np.zeros(len(cells)))
    if found is None:
        return told(names, kinds, [CYCLE], [None], [None], [None])
    end = found[0]
    ptr, done = np.where(stop[end], cells[end], np.where(leaves[end], down[end], NONE)), ~leaves[end]
    e = locate(cells, ids[mark == 1])
    e = np.unique(e[e >= 0])
    return told(names, kinds, np.r_[np.full(len(cells), INTO, np.int8), np.full(len(e), ENTRY, np.int8)], np.r_[cells, cells[e]],
                _nullable(np.r_[ptr, ptr[e]]), np.r_[done, done[e]])
