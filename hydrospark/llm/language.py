"""Language identification: script ranges, per-word scores, Viterbi over words with a switching penalty."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hydrospark.llm.common import map_slices
from hydrospark.llm.sequence import viterbi

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16

# First code point of script blocks (Unicode), in order; a block ends where the next begins.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFF00, "other"), (0x20000, "han"), (0x30000, "other"),
]
SCRIPT_FROM = np.array([a for a, _ in SCRIPTS])
SCRIPT_NAMES = sorted({b for _, b in SCRIPTS})
SCRIPT_ID = np.array([SCRIPT_NAMES.index(b) for _, b in SCRIPTS])


def scripts_of(points: np.ndarray) -> np.ndarray:
    return SCRIPT_ID[np.searchsorted(SCRIPT_FROM, points, side="right") - 1]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed letter trigrams of distinct words (with word borders), the first trigram of each word, its script."""
    joined = "\x01" + "\x01".join(words) + "\x01"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = cp[:-2] * np.uint64(0x9E3779B97F4A7C15) + cp[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + cp[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    bucket = (h >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)
    letter = cp[1:-1] != 1
    lens = np.fromiter(map(len, words), np.int64, len(words))
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    return bucket[letter], first, scripts_of(cp[1:-1][letter][first].astype(np.int64))


def split_words(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Codes of the words of all texts, the distinct words, and the word count of each text."""
    words: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        found = WORD.findall(t.lower())
        if found and not any(any(map(str.isalpha, w)) for w in found):
            found = []
        counts[i] = len(found)
        words += found
    if not words:
        return np.zeros(0, np.int64), [], counts
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    return codes.astype(np.int64), list(distinct), counts


class Model:
    """Log-probabilities of trigram buckets by language, and which scripts each language is written in."""

    def __init__(self, langs: list[str], logp: np.ndarray, script_ok: np.ndarray):
        self.langs, self.logp, self.script_ok = langs, logp, script_ok

    def word_scores(self, words: list[str]) -> np.ndarray:
        bucket, first, script = trigrams(words)
        scores = np.add.reduceat(self.logp[bucket].astype(np.float64), first, axis=0)
        allowed = self.script_ok[script]
        # a script that no language was seen in says nothing; one that some were rules out the rest
        known = allowed.any(1)
        scores[~known] = 0
        scores[known] = np.where(allowed[known], scores[known], scores[known].min(1, keepdims=True) - 50.0)
        return scores


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = 2000, smooth: float = 0.3, script_share: float = 0.001,
        most_langs: int = 1000) -> Model:
    """Count letter trigrams by language on a bounded sample of labelled rows.

    About ``per_lang`` different whole texts of each language are used (a hash threshold computed from the
    language's number of different texts), a text and its copies once; all of them when there are fewer. Rows
    without text or label teach nothing. More than ``most_langs`` labels are refused: each is a column of the model.
    """
    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(text).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_langs + 1).collect()}
    if len(sizes) > most_langs:
        raise ValueError(f"more than {most_langs} language labels")
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    limit = F.create_map(*[x for name in langs for x in (F.lit(name), F.lit(min(1.0, per_lang / sizes[name])))])
    unit = F.col("h").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    chosen = rows.filter(unit < limit[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def count(batches):
        table: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, part in pd.DataFrame({"t": batch.column("text").to_pylist(), "l": batch.column("lang").to_pylist()}).groupby("l"):
                codes, words, _ = split_words(part["t"].tolist())
                if not words:
                    continue
                bucket, first, script = trigrams(words)
                weight = np.bincount(codes, minlength=len(words))
                per_gram = np.repeat(weight, np.diff(np.append(first, len(bucket))))
                held = table.setdefault(name, np.zeros(BUCKETS + len(SCRIPT_NAMES)))
                held[:BUCKETS] += np.bincount(bucket, per_gram, BUCKETS)
                held[BUCKETS:] += np.bincount(script, weight, len(SCRIPT_NAMES))
        for name, held in table.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "k": pa.array(at, pa.int64()), "n": held[at]})

    counts = chosen.mapInArrow(count, "lang string, k bigint, n double").groupBy("lang", "k").agg(F.sum("n").alias("n")).toPandas()
    full = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(langs)))
    full[counts["k"].to_numpy(int), counts["lang"].map(langs.index).to_numpy(int)] = counts["n"].to_numpy(float)
    grams, script = full[:BUCKETS], full[BUCKETS:]
    used = max(1, int((grams.sum(1) > 0).sum()))
    logp = np.log((grams + smooth) / (grams.sum(0) + smooth * used))
    ok = script >= np.maximum(script.sum(0) * script_share, 1)
    return Model(langs, logp.astype(np.float32), ok)


def _label(part: pa.RecordBatch, text: str, model: Model, penalty: float, spans: bool, sure_margin: float | None = None) -> dict[str, object]:
    texts = [t or "" for t in part.column(text).to_pylist()]
    codes, words, counts = split_words(texts)
    n, k = len(texts), len(model.langs)
    pred = np.array(["und"] * n, dtype=object)
    score, n_langs = np.zeros(n), np.zeros(n, np.int64)
    sure_share = np.zeros(n)
    out_spans: list[list[dict]] = [[] for _ in texts]
    if words and k:
        table = model.word_scores(words)
        lens = np.fromiter(map(len, words), np.float64, len(words))
        trans = np.full((k, k), -penalty)
        np.fill_diagonal(trans, 0.0)
        path = viterbi(table[codes], counts, trans)
        doc = np.repeat(np.arange(n), counts)
        letters = np.bincount(doc * k + path, lens[codes], n * k).reshape(n, k)
        total = np.bincount(doc * k, 0 * lens[codes], n * k).reshape(n, k)
        for j in range(k):
            total[:, j] = np.bincount(doc, table[codes, j], n)
        has = counts > 0
        best = letters.argmax(1)
        share = letters[np.arange(n), best] / np.maximum(letters.sum(1), 1)
        # how sure: share of letters in the winner's spans, times the chance of the winner by mean evidence a word
        margin = (total - total.max(1, keepdims=True)) / np.sqrt(np.maximum(counts, 1))[:, None]
        soft = np.exp(margin)
        soft /= soft.sum(1, keepdims=True)
        sure = share * soft[np.arange(n), best]
        pred[has] = np.array(model.langs, dtype=object)[best[has]]
        score[has] = sure[has]
        n_langs = (letters > 0).sum(1)
        if sure_margin is not None:
            sure_share = share_of_sure_spans(table, codes, doc, path, lens[codes], n, sure_margin)
        if spans:
            start = np.concatenate([[0], np.cumsum(counts)])
            for i in np.flatnonzero(has):
                p = path[start[i]:start[i + 1]]
                edge = np.flatnonzero(np.diff(p)) + 1
                if not len(edge):
                    out_spans[i] = [{"lang": model.langs[p[0]], "start": 0, "end": len(texts[i])}]
                    continue
                at = offsets(texts[i], len(p))
                cuts = [0, *(at[e] for e in edge), len(texts[i])]
                names = [model.langs[p[0]], *(model.langs[p[e]] for e in edge)]
                out_spans[i] = [{"lang": x, "start": a, "end": b} for x, a, b in zip(names, cuts, cuts[1:])]
    res = {"lang_pred": pred.tolist(), "score": np.clip(score, 0, 1), "n_langs": n_langs}
    return res | ({"lang_spans": out_spans} if spans else {}) | ({"sure_share": sure_share} if sure_margin is not None else {})


def share_of_sure_spans(table: np.ndarray, codes: np.ndarray, doc: np.ndarray, path: np.ndarray, lens: np.ndarray, n: int, margin: float) -> np.ndarray:
    """Share of each text's letters in spans whose language beats the next one by ``margin`` a word, over the words of the span."""
    edge = np.flatnonzero((np.diff(doc) != 0) | (np.diff(path) != 0)) + 1
    first = np.concatenate([[0], edge])
    size = np.diff(np.append(first, len(codes)))
    spans, found = np.arange(len(first)), path[first]
    word_span = np.repeat(spans, size)
    evidence = np.stack([np.bincount(word_span, table[codes, j], len(first)) for j in range(table.shape[1])], axis=1)
    own = evidence[spans, found]
    evidence[spans, found] = -np.inf
    sure = own - evidence.max(1) >= margin * size
    letters = np.bincount(word_span, lens, len(first))
    return np.bincount(doc[first], letters * sure, n) / np.maximum(np.bincount(doc[first], letters, n), 1)


def offsets(text: str, n: int) -> list[int]:
    """Start of each word in the text; lower-casing may change the length, then starts are found in the lower-cased text."""
    low = text.lower()
    found = [m.start() for m in WORD.finditer(low)]
    if len(low) != len(text):
        back = [i for i, ch in enumerate(text) for _ in ch.lower()]
        found = [back[f] for f in found]
    return found[:n]


def identify(docs: DataFrame, model: Model, text: str = "text", penalty: float = 8.0, spans: bool = True,
             sure_margin: float | None = None) -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score``, ``n_langs`` and the labelled character spans ``lang_spans``.

    Each word is scored by its letter trigrams under the languages whose script it is written in;
    Viterbi with ``penalty`` for each switch labels the words; the document takes the language with the
    most letters. Only the text is looked at. Null text, text without a letter, and any text under a
    model without languages is ``und`` with score 0 and no spans. Long texts are decoded whole. Columns
    of the input that carry one of the four names are replaced. With ``sure_margin`` (nats), ``sure_share``
    is the share of letters in spans whose language beats the next one by that much a word of the span; it
    depends neither on the length of the text nor on the number of its languages.
    """
    made = ["lang_pred", "score", "n_langs", "lang_spans"] + (["sure_share"] if sure_margin is not None else [])
    keep = [c for c in docs.columns if c not in made]
    schema = "lang_pred string, score double, n_langs bigint" + (", lang_spans array<struct<lang:string,start:int,end:int>>" if spans else "")
    schema += ", sure_share double" if sure_margin is not None else ""
    return map_slices(docs.select(*keep), text, lambda part: _label(part, text, model, penalty, spans, sure_margin), schema, keep)
