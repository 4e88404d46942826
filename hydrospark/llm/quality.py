"""Quality rules: fixed limits, then robust multivariate outliers per language and source."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hydrospark.llm.common import bounded_broadcast, cut, map_slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Transformed statistics and the least spread each is credited with in place of a smaller one, so that a statistic which is
#: the same nearly everywhere (no symbols, no repeated lines) does not turn any deviation into an outlier.
FEATURES = {"log_words": 0.5, "log_word_len": 0.15, "symbol_rate": 0.05, "dup_line_rate": 0.1, "repeat_rate": 0.15}

#: The 0.999 quantile of chi-square for five statistics: any one of them alone can be an outlier.
LIMIT = 20.515


def repeat_words(codes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words of each document that lie in a 3-word window found twice or more in that document."""
    out = np.zeros(n_docs, np.int64)
    if len(codes) < 3:
        return out
    u = int(codes.max()) + 1
    # each step numbers the distinct keys anew, so the products stay exact in 64 bits
    key = pd.factorize(doc * u + codes)[0].astype(np.int64)
    key = pd.factorize(key[:-1] * u + codes[1:])[0].astype(np.int64)
    key = pd.factorize(key[:-1] * u + codes[2:])[0]
    key[doc[:-2] != doc[2:]] = -1
    inside = key >= 0
    again = np.zeros(len(key), bool)
    again[inside] = np.bincount(key[inside])[key[inside]] > 1
    covered = np.zeros(len(codes), bool)
    for shift in range(3):
        covered[shift:shift + len(again)] |= again
    return np.bincount(doc[covered], minlength=n_docs).astype(np.int64)


def dup_lines(text: str) -> int:
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[str] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += WORD.search(line) is not None
        seen.add(line)
    return n


def _stats(part: pa.RecordBatch, text: str) -> dict[str, object]:
    texts = [t or "" for t in part.column(text).to_pylist()]
    words: list[str] = []
    n_words = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        found = WORD.findall(t)
        n_words[i] = len(found)
        words += found
    doc = np.repeat(np.arange(len(texts)), n_words)
    codes = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64) if words else np.zeros(0, np.int64)
    return {
        "n_words": n_words,
        "word_chars": [len(t) - sum(map(t.count, SPACES)) for t in texts],
        "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
        "n_dup_lines": [dup_lines(t) for t in texts],
        "n_repeat_words": repeat_words(codes, doc, len(texts)),
        "n_lines": [t.count("\n") + 1 for t in texts],
    }


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus word, symbol and repetition counts of the whole text; null counts as empty."""
    keep = [c for c in docs.columns if c != text and c not in (*STATS, "n_lines")]
    return map_slices(docs.select(*keep, text), text, lambda part: _stats(part, text), ", ".join(f"{s} bigint" for s in (*STATS, "n_lines")), keep)


def transformed() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "log_words": F.log1p(F.col("n_words").cast("double")),
        "log_word_len": F.log1p(F.col("word_chars") / n),
        "symbol_rate": F.log1p(F.col("n_symbols") / n),
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_rate": F.asin(F.sqrt(F.least(F.col("n_repeat_words") / n, F.lit(1.0)))),
    }


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance from the joined centre ``c`` and the inverse scatter ``inv`` (row-major)."""
    p = len(names)
    d = [F.col(x) - F.col("c")[i] for i, x in enumerate(names)]
    terms = [d[i] * d[j] * F.col("inv")[i * p + j] * (1.0 if i == j else 2.0) for i in range(p) for j in range(i, p)]
    return sum(terms[1:], terms[0])


def _moments(rows: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(x) for x in names]).alias("s1"),
        F.array(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).alias("s2"),
    )


def _scatter(moments: DataFrame, names: list[str], floors: list[float], prior: float, share: float) -> DataFrame:
    """Centre and inverse scatter per group, shrunk toward the language's by ``prior`` rows; one row per group."""
    p = len(names)
    index = {ij: k for k, ij in enumerate((i, j) for i in range(p) for j in range(i, p))}
    full = [index[min(i, j), max(i, j)] for i in range(p) for j in range(p)]
    pooled = moments.groupBy("_lang").agg(
        F.sum("n").alias("pn"), F.array(*[F.sum(F.col("s1")[i]) for i in range(p)]).alias("p1"),
        F.array(*[F.sum(F.col("s2")[i]) for i in range(len(index))]).alias("p2"))
    least, diagonal = np.square(floors), np.arange(p)
    # the kept share of a normal sample has less spread than the whole; chi-square consistency factor
    factor = consistency(share, p)

    def solve(frames):
        for g in frames:
            def mean_cov(n, s1, s2):
                n = g[n].to_numpy(float)[:, None]
                m = np.array(g[s1].tolist(), float) / n
                full2 = np.array(g[s2].tolist(), float)[:, full] / n
                return m, full2.reshape(-1, p, p) - m[:, :, None] * m[:, None, :]
            if not len(g):
                continue
            (m, c), (pm, pc) = mean_cov("n", "s1", "s2"), mean_cov("pn", "p1", "p2")
            w = (g["n"] / (g["n"] + prior)).to_numpy(float)
            m = w[:, None] * m + (1 - w)[:, None] * pm
            c = w[:, None, None] * c + (1 - w)[:, None, None] * pc
            c = c * factor
            c[:, diagonal, diagonal] = np.maximum(c[:, diagonal, diagonal], least)
            inv = np.linalg.inv(c)
            yield pd.DataFrame({"_lang": g["_lang"], "_source": g["_source"], "c": list(m), "inv": list(inv.reshape(-1, p * p))})

    return moments.join(pooled, "_lang").mapInPandas(solve, "_lang string, _source string, c array<double>, inv array<double>")


def consistency(share: float, p: int, steps: int = 20_000) -> float:
    """share / P(chi2_{p+2} <= q) with q the ``share`` quantile of chi2_p, by numeric integration."""
    x = np.linspace(0, 200, steps * 10 + 1)[1:]
    dens = x ** (p / 2 - 1) * np.exp(-x / 2)
    cdf = np.cumsum(dens)
    cdf /= cdf[-1]
    upper = x ** (p / 2) * np.exp(-x / 2)
    cdf2 = np.cumsum(upper)
    cdf2 /= cdf2[-1]
    k = int(np.searchsorted(cdf, share))
    return float(share / cdf2[min(k, len(x) - 1)])


def robust_distances(rows: DataFrame, features: dict[str, float], share: float = 0.75, c_steps: int = 4, prior: float = 50.0) -> DataFrame:
    """``rows`` plus ``d2``: squared robust distance from its (``_lang``, ``_source``) group.

    Minimum covariance determinant by concentration steps that run as aggregations: start at the
    group medians and absolute deviations, keep the ``share`` of each group nearest to the centre,
    estimate centre and scatter from it, repeat. All rows take part in every step; a group's cut is
    an approximate percentile with an error of 0.01 % of ranks. Hot groups need no care since every
    step pre-aggregates on the map side.
    """
    names, floors, keys = list(features), list(features.values()), ["_lang", "_source"]
    rows = cut(rows)
    mid = cut(rows.groupBy(*keys).agg(*[F.percentile_approx(x, 0.5, 10_000).alias(f"m_{x}") for x in names]))
    near = rows.join(bounded_broadcast(mid), keys)
    mad = cut(near.groupBy(*keys).agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{x}")), 0.5, 10_000).alias(f"a_{x}") for x in names])
              .join(mid, keys))
    p = len(names)
    zero = F.lit(0.0)
    spread = [F.lit(1.0) / F.greatest(F.pow(F.col(f"a_{x}") * 1.4826, 2), F.lit(float(f * f))) for x, f in zip(names, floors, strict=True)]
    model = cut(mad.select(*keys, F.array(*[F.col(f"m_{x}") for x in names]).alias("c"),
                           F.array(*[spread[i] if i == j else zero for i in range(p) for j in range(p)]).alias("inv")))
    for _ in range(c_steps):
        scored = rows.join(bounded_broadcast(model), keys).withColumn("d2", _distance(names))
        limit = cut(scored.groupBy(*keys).agg(F.percentile_approx("d2", share, 10_000).alias("limit")))
        kept = scored.join(bounded_broadcast(limit), keys).filter("d2 <= limit")
        model = cut(_scatter(cut(_moments(kept, names, keys)), names, floors, prior, share))
    return rows.join(bounded_broadcast(model), keys).withColumn("d2", _distance(names)).drop("c", "inv")


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", limit: float = LIMIT,
                  share: float = 0.75, c_steps: int = 4) -> DataFrame:
    """Counts, the fixed rules and the outlier verdict of every document; the text itself is left out.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated 3-word windows.
    ``kept``: not ``base_failed`` and within ``limit`` squared robust distances of its language and
    source. Groups are estimated from the documents that pass the fixed rules. Null or empty text has
    zero counts and fails; null language or source forms a group of its own; repeated rows are judged
    alike; an empty table gives an empty one. Other columns pass through, but for those named like a
    column made here, which are dropped.
    """
    made = {*STATS, *FEATURES, "n_lines", "base_failed", "kept", "d2", "c", "inv", "limit", "_lang", "_source",
            *(f"{k}_{x}" for k in "ma" for x in FEATURES)} - {text, lang, source}
    stats = text_stats(docs.drop(*made), text)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    rows = cut(stats.withColumns({"base_failed": failed, "_lang": key(lang), "_source": key(source), **transformed()}))
    passed = robust_distances(rows.filter("not base_failed"), FEATURES, share, c_steps)
    both = passed.unionByName(rows.filter("base_failed").withColumn("d2", F.lit(None).cast("double")))
    return both.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= limit, F.lit(False))).drop("_lang", "_source", *FEATURES)
