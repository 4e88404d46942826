"""Secret scans: base patterns, and a linear-chain conditional random field over tokens."""

from __future__ import annotations

import copy
import re
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hydrospark.llm.common import map_slices
from hydrospark.llm.sequence import viterbi

# Base patterns, their least lengths and their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_RUN = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

TOKEN = re.compile(r"\s+|[\w+/.=-]+|[^\w\s+/.=-]+")
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
#: Words whose nearness makes a value a likely secret.
NEAR_WORDS = {"password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "key", "auth", "authorization", "bearer", "credential",
              "credentials", "private_key", "access_key", "client_secret", "passphrase"}
LENGTHS = np.array([3, 6, 12, 16, 20, 24, 32])
REACH = 4
FILES = 8


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, sorted by start, then kind."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(k in low for k in ASSIGN_KEYS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # matches of the whole pattern are maximal runs, so looking for long ones alone finds the same
    found += [(m.start(), 2, m.end()) for m in HEX_RUN.finditer(text)]
    return sorted(found)


def secret_values(text: str) -> list[tuple[int, int]]:
    """Character ranges of the secret itself inside the base matches."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(s, e) for s, k, e in base_spans(text) if k > 0]
    return sorted(out)


def shapes(words: list[str]) -> np.ndarray:
    """Shape number of each distinct token: length class and which kinds of characters it has."""
    cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    digit, upper = (cp >= 48) & (cp <= 57), (cp >= 65) & (cp <= 90)
    lower = (cp >= 97) & (cp <= 122)
    hexed = digit | ((cp >= 97) & (cp <= 102)) | ((cp >= 65) & (cp <= 70))
    other = ~(digit | upper | lower) & (cp < 128)
    count = lambda x: np.add.reduceat(x.astype(np.int64), first)
    d, u, lo = count(digit), count(upper), count(lower)
    bits = (d > 0) + 2 * (u > 1) + 4 * (lo > 0) + 8 * (count(hexed) == lens) + 16 * (count(other) > 0) + 32 * (d * 5 > lens)
    return np.searchsorted(LENGTHS, lens, side="right") * 64 + bits


class Tokens:
    """Tokens of several texts with the feature numbers that the field looks at."""

    def __init__(self, texts: list[str]):
        words: list[str] = []
        pieces = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            found = TOKEN.findall(t)
            pieces[i] = len(found)
            words += found
        lens = np.fromiter(map(len, words), np.int64, len(words))
        start = np.concatenate([[0], np.cumsum(lens)])[:-1].astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), pieces)
        codes, distinct = pd.factorize(np.array(words, dtype=object)) if words else (np.zeros(0, np.int64), [])
        blank = np.fromiter((w.isspace() for w in distinct), bool, len(distinct))
        keep = ~blank[codes] if words else np.zeros(0, bool)
        base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1].astype(np.int64)
        self.doc, codes = doc[keep], codes[keep]
        self.start = start[keep] - base[self.doc]
        self.end = self.start + lens[keep]
        self.counts = np.bincount(self.doc, minlength=len(texts))
        shape_of = shapes(list(distinct)) if words else np.zeros(0, np.int64)
        key_of = np.fromiter((w.lower().strip("._-=/+") in NEAR_WORDS for w in distinct), bool, len(distinct))
        self.shape, self.key = shape_of[codes], key_of[codes]
        self._near()
        key = self.key
        # file features: does it have a near word, and how dense are digits-bearing tokens
        has_key = np.bincount(self.doc, key, len(texts)) > 0
        dense = np.bincount(self.doc, (self.shape & 1), len(texts)) / np.maximum(self.counts, 1)
        self.file = (has_key * 4 + np.searchsorted([0.001, 0.02, 0.2], dense))[self.doc]

    def _near(self) -> None:
        """Tokens since the last near word, 0 where it is out of reach."""
        self.near = np.zeros(len(self.key), np.int64)
        for back in range(1, REACH + 1):
            hit = np.zeros(len(self.key), bool)
            hit[back:] = self.key[:-back] & (self.doc[back:] == self.doc[:-back])
            self.near[(self.near == 0) & hit] = back

    def only(self, keep: np.ndarray) -> Tokens:
        """The same texts without some of their tokens."""
        part = copy.copy(self)
        for name in ("doc", "start", "end", "shape", "key", "file"):
            setattr(part, name, getattr(self, name)[keep])
        part._near()
        return part

    def features(self) -> np.ndarray:
        """(tokens, features) of weight row numbers; each feature has rows of its own."""
        n = len(self.shape)
        size, bits = self.shape // 64, self.shape % 64
        prev, prev2, nxt = np.full(n, 64), np.full(n, 64), np.full(n, 64)
        same = self.doc[1:] == self.doc[:-1]
        prev[1:] = np.where(same, bits[:-1], 64)
        nxt[:-1] = np.where(same, bits[1:], 64)
        prev2[2:] = np.where(self.doc[2:] == self.doc[:-2], bits[:-2], 64)
        dense = bits // 32
        parts = [size, bits, size * 2 + dense, prev, prev2, nxt, self.near * 8 + size, self.near * 2 + dense, self.file]
        return np.stack([o + x for o, x in zip(FEATURE_FROM, parts, strict=True)], 1)


FEATURE_SIZES = [8, 64, 16, 65, 65, 65, 8 * (REACH + 1), 2 * (REACH + 1), FILES]
FEATURE_FROM = np.concatenate([[0], np.cumsum(FEATURE_SIZES)[:-1]])
N_WEIGHTS = sum(FEATURE_SIZES)


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def fit_crf(features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, steps: int = 80, rate: float = 0.15, l2: float = 1e-3):
    """Weights and transitions of the field by gradient ascent (Adam) on the conditional likelihood of all windows.

    Windows are padded to one length and all advance together in the forward and backward passes.
    """
    k, n = 3, len(lengths)
    width = int(lengths.max())
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    pos = np.minimum(first[:, None] + np.arange(width), len(labels) - 1)
    real = np.arange(width) < lengths[:, None]
    rows, inverse = np.unique(features, return_inverse=True)
    inverse = inverse.reshape(features.shape)
    w, t = np.zeros((len(rows), k)), np.zeros((k, k))
    gold_w = np.zeros_like(w)
    for f in range(features.shape[1]):
        np.add.at(gold_w, (inverse[:, f], labels), 1)
    y = labels[pos]
    gold_t = np.zeros_like(t)
    inner = real[:, 1:]
    np.add.at(gold_t, (y[:, :-1][inner], y[:, 1:][inner]), 1)
    params, mom, var = [w, t], [np.zeros_like(w), np.zeros_like(t)], [np.zeros_like(w), np.zeros_like(t)]
    for step in range(1, steps + 1):
        e = w[inverse].sum(1)[pos]
        alpha = np.zeros((n, width, k))
        alpha[:, 0] = e[:, 0]
        for i in range(1, width):
            a = logsumexp(alpha[:, i - 1, :, None] + t, 1) + e[:, i]
            alpha[:, i] = np.where(real[:, i, None], a, alpha[:, i - 1])
        z = logsumexp(alpha[:, -1], 1)
        beta = np.zeros((n, width, k))
        exp_t = np.zeros_like(t)
        for i in range(width - 2, -1, -1):
            both = t[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :]
            beta[:, i] = np.where(real[:, i + 1, None], logsumexp(both, 2), 0.0)
            p = np.exp(alpha[:, i, :, None] + both - z[:, None, None])
            exp_t += p[real[:, i + 1]].sum(0)
        marg = np.exp(alpha + beta - z[:, None, None])[real]
        exp_w = np.stack([np.bincount(inverse.ravel(), np.repeat(marg[:, j], features.shape[1]), len(rows)) for j in range(k)], 1)
        for p, m, v, g in zip(params, mom, var, ((gold_w - exp_w) / n - l2 * w, (gold_t - exp_t) / n - l2 * t)):
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            p += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    full = np.zeros((N_WEIGHTS, k))  # what was never seen in training says nothing
    full[rows] = w
    return full, t


def window_labels(text: str, context: int, negative_at: int | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature and label arrays around each secret of a text, or around one place where it has none."""
    tok = Tokens([text])
    n = len(tok.start)
    if not n:
        return []
    y = np.zeros(n, np.int64)
    for s, e in secret_values(text):
        inside = np.flatnonzero((tok.start < e) & (tok.end > s))
        y[inside] = INSIDE
        if len(inside):
            y[inside[0]] = BEGIN
    out = cut_windows(tok, y, context, negative_at)
    if (y == BEGIN).any():
        # once more without quotes and signs, or the field would learn those rather than the secret and its word
        words = (tok.shape % 64 & 0b000111) > 0
        words |= y != OUTSIDE
        out += cut_windows(tok.only(words), y[words], context, None)
    return out


def cut_windows(tok: Tokens, y: np.ndarray, context: int, negative_at: int | None) -> list[tuple[np.ndarray, np.ndarray]]:
    marks = np.flatnonzero(y == BEGIN).tolist()
    if not marks and negative_at is not None:
        marks = [negative_at % len(y)]
    x, out, done = tok.features(), [], -1
    for m in marks:
        a, b = max(m - context, 0), min(m + context, len(y))
        if a >= done:
            out.append((x[a:b], y[a:b]))
            done = b
    return out


def fit(docs: DataFrame, text: str = "text", sample: int = 12_000, context: int = 12, negative_every: int = 8, per_text: int = 64):
    """Train the field on windows around base matches in a bounded hash sample of texts.

    About ``sample`` different whole texts are looked at (all if there are fewer), a text and its copies once; every
    secret in them gives a window of ``context`` tokens on either side, with and without signs, up to ``per_text``
    windows a text, evenly spread over it, and one text in ``negative_every`` without a secret a window at a place set by its
    hash. So at most ``sample`` times ``per_text`` windows reach the driver, however often a text repeats. Labels
    come from the base patterns alone. Without any base match in the sample the field keeps every token outside.
    """
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    total = rows.select("h").distinct().count()
    unit = F.col("h").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    chosen = rows.filter(unit < min(1.0, sample / max(total, 1))).groupBy("h").agg(F.min("text").alias("text"))

    def windows(batches):
        for batch in batches:
            xs, ys = [], []
            for t, h in zip(batch.column("text").to_pylist(), batch.column("h").to_pylist()):
                if not base_spans(t) and (h >> 53) % negative_every:
                    continue
                found = window_labels(t, context, (h >> 56) & 0xFFFFFF)
                for x, y in found if len(found) <= per_text else [found[i * len(found) // per_text] for i in range(per_text)]:
                    xs.append(x.ravel())
                    ys.append(y)
            yield pa.RecordBatch.from_pydict({"x": pa.array(xs, pa.list_(pa.int64())), "y": pa.array(ys, pa.list_(pa.int64()))})

    got = chosen.mapInArrow(windows, "x array<bigint>, y array<bigint>").toPandas()
    # one order whatever the partitions
    pairs = sorted((list(x), list(y)) for x, y in zip(got["x"], got["y"]))
    if not any(BEGIN in y for _, y in pairs):
        w = np.zeros((N_WEIGHTS, 3))
        w[:, OUTSIDE] = 1.0
        return w, np.zeros((3, 3))
    lengths = np.array([len(y) for _, y in pairs])
    x = np.concatenate([x for x, _ in pairs]).reshape(lengths.sum(), -1)
    return fit_crf(x, np.concatenate([y for _, y in pairs]), lengths)


def field_spans(texts: list[str], weights: np.ndarray, trans: np.ndarray) -> list[list[tuple[int, int]]]:
    """Character ranges tagged begin or inside by the best path."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    tok = Tokens(texts)
    if not len(tok.start):
        return out
    x = tok.features()
    emission = weights[x[:, 0]]
    for f in range(1, x.shape[1]):
        emission += weights[x[:, f]]
    path = viterbi(emission, tok.counts, trans)
    for i in np.flatnonzero(path != OUTSIDE):
        held = out[tok.doc[i]]
        if path[i] == INSIDE and held and i and path[i - 1] != OUTSIDE and tok.doc[i - 1] == tok.doc[i]:
            held[-1] = (held[-1][0], int(tok.end[i]))
        else:
            held.append((int(tok.start[i]), int(tok.end[i])))
    return out


def outside(spans: list[tuple[int, int]], base: list[tuple[int, int, int]], least: int = 6) -> list[tuple[int, int]]:
    """``spans`` as they are where no base span touches them, else their parts outside base spans that have ``least`` characters."""
    joined: list[list[int]] = []
    for s, _, e in sorted(base):
        if joined and s < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e])
    ends, out = [b[1] for b in joined], []
    for s, e in spans:
        i, at = bisect_right(ends, s), s
        if i == len(joined) or joined[i][0] >= e:
            out.append((s, e))
            continue
        while i < len(joined) and joined[i][0] < e:
            if joined[i][0] - at >= least:
                out.append((at, joined[i][0]))
            at = joined[i][1]
            i += 1
        if e - at >= least:
            out.append((at, e))
    return out


def _scan(part: pa.RecordBatch, text: str, weights: np.ndarray, trans: np.ndarray) -> dict[str, list]:
    texts = [t or "" for t in part.column(text).to_pylist()]
    out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_field", "base_spans", "spans")}
    for t, more in zip(texts, field_spans(texts, weights, trans)):
        base = base_spans(t)
        for k, name in enumerate(("n_assign", "n_access", "n_hex")):
            out[name].append(sum(b[1] == k for b in base))
        added = [(s, 3, e) for s, e in outside(more, base)]
        out["n_field"].append(len(added))
        show = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        out["base_spans"].append(show(base))
        out["spans"].append(show(sorted(base + added)))
    return out


def scan_secrets(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` plus counts by base kind, ``n_field``, ``base_spans`` and ``spans`` (kind:start:end, comma-joined) of the whole text.

    Spans are whole matches in code points, end exclusive, by start, then kind. The field adds spans of
    kind ``crf``; of one that touches a base span the parts outside it, if they have 6 characters. Null text counts as empty and has no spans. Input columns named
    like one made here are replaced.
    """
    made = ["n_assign", "n_access", "n_hex", "n_field", "base_spans", "spans"]
    keep = [c for c in docs.columns if c not in made]
    weights, trans = model
    schema = "n_assign bigint, n_access bigint, n_hex bigint, n_field bigint, base_spans string, spans string"
    return map_slices(docs.select(*keep), text, lambda part: _scan(part, text, weights, trans), schema, keep)


