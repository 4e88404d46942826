"""Decoding, spans and samples against brute force."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from hydrospark.llm import language, secrets
from hydrospark.llm.sequence import viterbi


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(40):
        k = int(rng.integers(1, 4))
        lengths = rng.integers(0, 6, int(rng.integers(1, 6)))
        scores, trans = rng.normal(size=(int(lengths.sum()), k)), rng.normal(size=(k, k))
        got, at = viterbi(scores, lengths, trans), 0
        for n in lengths:
            part = scores[at:at + n]
            value = lambda p: sum(part[i, s] for i, s in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
            if n:
                assert np.isclose(value(got[at:at + n].tolist()), max(map(value, itertools.product(range(k), repeat=int(n)))))
            at += n


def test_parts_of_spans_outside_base_spans():
    rng = random.Random(2)
    for _ in range(300):
        cuts = sorted(rng.sample(range(80), 8))
        spans = [(a, b) for a, b in zip(cuts[::2], cuts[1::2])]
        base = [(s, rng.randrange(3), s + rng.randrange(1, 20)) for s in rng.sample(range(80), rng.randrange(4))]
        held = {i for s, _, e in base for i in range(s, e)}
        want = []
        for s, e in spans:
            if not held & set(range(s, e)):
                want.append((s, e))
                continue
            runs = "".join("x" if i in held else "." for i in range(s, e))
            at = s
            for key, run in itertools.groupby(runs):
                n = len(list(run))
                if key == "." and n >= 6:
                    want.append((at, at + n))
                at += n
        assert secrets.outside(spans, base) == want


def test_a_text_and_its_copies_are_one_sample(spark):
    """One page with many secrets, copied 100,000 times: its windows reach the driver once, and the languages stay in balance."""
    page = " ".join(f'token = "{i:032x}" and some words between them' for i in range(300))
    other = spark.range(200).select(F.concat(F.lit('so the key is secret: "'), F.sha2(F.col("id").cast("string"), 256), F.lit('" here')).alias("text"), F.lit("en").alias("lang"))
    copies = spark.range(100_000).select(F.lit(page).alias("text"), F.lit("de").alias("lang"))
    seen = []
    plain, secrets.fit_crf = secrets.fit_crf, lambda x, y, lengths: seen.append(len(lengths)) or (None, None)
    try:
        secrets.fit(other.unionByName(copies))
    finally:
        secrets.fit_crf = plain
    assert 100 < seen[0] <= 201 * 64 and seen[0] < 64 + 200 * 4 + 1
    once = other.unionByName(copies.limit(1))
    assert np.array_equal(language.fit(once).logp, language.fit(other.unionByName(copies)).logp)
