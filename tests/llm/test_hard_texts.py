"""Texts made of an operator's own trigger: long runs of blanks for the encoder, many notices for the license search."""

import random
import time

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hydrospark.llm import licenses, tokens

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_long_blanks_are_encoded_as_by_the_other_library(spark):
    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    texts = [f"{a}{blank * n}{b}" for blank in (" ", "\n", " \n", "\xa0") for n in (10, 999, 1000, 1001, 5000) for a, b in (("x", "y"), ("", "y"), ("x", ""), ("x.", " .y"), ("1", "\t2"))]
    texts += [" " * 5_000_000 + "a", "\n" * 5_000_000 + "a", "a" + " " * 1_000_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    start = time.time()
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.section_tokens(rows, RANKS).select("doc_id", "n_tokens").collect()}
    assert time.time() - start < 60
    assert got == {i: len(other.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_two_vocabularies_of_one_name(spark, tmp_path):
    small = tmp_path / "byte_bpe_50k.tiktoken"
    with open(RANKS, "rb") as f:
        small.write_bytes(b"\n".join(f.read().splitlines()[:256]))
    docs = spark.createDataFrame([(1, "the river and the bridge")], "doc_id long, text string")
    counts = [tokens.section_tokens(docs, str(v)).first()["n_tokens"] for v in (RANKS, small, RANKS)]
    assert counts[1] == 24 and counts[0] == counts[2] < 10


def test_many_notices_take_time_in_proportion():
    s = licenses.Searcher()
    took = []
    for n in (20_000, 160_000):
        text = licenses.normalise("licensed under the mit licence " * n)
        start = time.process_time()
        assert len(s.find(text)) == n
        took.append(time.process_time() - start)
    assert took[1] < 30


def near(a, b):
    """Least edits that turn notice ``a`` into a stretch of ``b`` from one blank to another, for every end in ``b``."""
    row = [0 if i and b[i - 1] == " " else 10**6 for i in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], 10**6
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return {j: row[j] for j in range(1, len(b)) if b[j] == " "}


def test_search_against_edit_distance():
    """Every text within the bound is found, edited notices beside exact ones included; nothing else is."""
    rng, s = random.Random(4), licenses.Searcher()
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            c = list(rng.choice(licenses.NOTICES)[0])
            for _ in range(rng.randrange(4)):
                c[rng.randrange(1, len(c) - 1)] = rng.choice("abz")
            parts.append("".join(c))
        text = licenses.normalise(" ".join(parts))
        found = s.find(text)
        for a, b, label, edits, n in found:
            assert min(near(p, text[a - 1:b + 1])[b - a + 1] for p, lab in licenses.NOTICES if lab == label and len(p) == n) <= edits
        for phrase, _ in licenses.NOTICES:
            for end, edits in near(phrase, text).items():
                if edits <= len(phrase) // 12:
                    assert any(a < end and end - len(phrase) - edits < b for a, b, *_ in found)


def test_an_edited_notice_beside_an_exact_one(spark):
    docs = spark.createDataFrame([(1, "Licensed under the MIT licence. Licensed under the MIT license.")], "doc_id long, text string").withColumn("spans", F.lit(1))
    assert [(x["start"], x["end"], x["edits"]) for x in licenses.scan_licenses(docs).first()["license_spans"]] == [(0, 30, 1), (32, 62, 0)]


def test_texts_full_of_base_phrases(spark):
    text = "mit license " * 90_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = licenses.scan_licenses(docs).first()
    assert (r["n_base"], r["first_word"], r["last_word"], r["n_words"]) == (90_000, 0, 179_998, 180_000)
