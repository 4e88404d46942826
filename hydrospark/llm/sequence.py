"""Viterbi decoding of many label sequences at once."""

from __future__ import annotations

import numpy as np


def viterbi(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Best label of every position of several sequences laid end to end.

    ``scores`` is (positions, labels), ``lengths`` the positions of each sequence, ``trans[i, j]`` the
    score of label j after label i. All sequences advance together, one position a step, the longest
    first; ties go to the lower label.
    """
    total, k = scores.shape
    path = np.zeros(total, np.int16)
    lengths = np.asarray(lengths, np.int64)
    if not total:
        return path
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    first, size = first[order], lengths[order]
    # sequences still alive at step t are the first alive[t] of the order
    alive = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")
    back = np.zeros((total, k), np.int16)
    delta = scores[first] + (0 if start is None else start)
    last = np.empty((len(size), k))
    for t in range(1, int(size[0])):
        n = alive[t]
        if n < len(delta):
            last[n:len(delta)] = delta[n:]
            delta = delta[:n]
        came = delta[:, :, None] + trans
        at = first[:n] + t
        best = came.argmax(1)
        back[at] = best
        delta = np.take_along_axis(came, best[:, None, :], 1)[:, 0] + scores[at]
    last[:len(delta)] = delta
    state = last.argmax(1)
    # walk back, again all together: sequences join as their last position is reached
    for t in range(int(size[0]) - 1, -1, -1):
        n = alive[t]
        at = first[:n] + t
        path[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    return path
