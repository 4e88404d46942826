"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import random

import pytest
from pyspark.sql import functions as F

from hydrospark.llm import decontaminate, language, licenses, linedup, mixing, neardup, quality, secrets, tokens, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def sentence(seed, n=60, words=("the", "old", "stone", "bridge", "over", "a", "narrow", "river", "was", "built", "by", "monks", "and", "traders", "of", "wool")):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + str(rng.randrange(30)) * (rng.random() < 0.3) for _ in range(n))


LONG = "\n".join(sentence(i, 40) for i in range(3000))
ROWS = [
    (1, sentence(1), "en", "a", 10), (2, sentence(1), "en", "a", 10), (3, None, "en", "a", None), (4, "", None, "b", 0),
    (5, "   \n\t\n", "en", None, 5), (None, sentence(2), "en", "b", 7), (None, sentence(2), "en", "b", 7), (7, LONG, "en", "a", 1),
    (8, "1234 5678 !!", "de", "b", 2), (9, "été Ünïcode 日本語 текст 😀", "fr", "b", 2), (10, sentence(10), "en", "a", 3), (10, sentence(10), "en", "a", 3),
]
CLASH = ["score", "labels", "spans", "n_words", "kept", "d2", "bands", "grams", "rid", "_rid", "n_lines", "n_deleted", "pass", "block", "n_tokens", "c", "inv"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *cols):
    return sorted((tuple(r[c] for c in ("doc_id", *cols)) for r in df.collect()), key=str)


def test_language(spark, docs, clashing, none):
    model = language.fit(docs)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect() if r["doc_id"] is not None}
    assert {k: got[k]["lang_pred"] for k in (3, 4, 5, 8)} == {3: "und", 4: "und", 5: "und", 8: "und"}
    assert all(got[k]["score"] == 0 and got[k]["lang_spans"] == [] for k in (3, 4, 5, 8))
    assert got[1]["lang_pred"] == "en" and got[1]["lang_spans"][-1]["end"] == len(sentence(1))
    assert got[7]["lang_pred"] == "en" and 0 <= got[9]["score"] <= 1
    assert by_id(language.identify(clashing, model), "lang_pred", "score") == by_id(language.identify(docs, model), "lang_pred", "score")
    assert language.identify(none, model).count() == 0
    nothing = language.fit(none)
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}


def test_tokens(docs, clashing, none):
    got = tokens.section_tokens(docs, VOCABULARY).collect()
    assert len(got) == len(ROWS)
    assert all(r["n_tokens"] == r["n_outside"] + sum(s["n_tokens"] for s in r["sections"]) for r in got)
    assert all(r["n_tokens"] == 0 and r["sections"] == [] for r in got if r["doc_id"] in (3, 4))
    assert by_id(tokens.section_tokens(clashing, VOCABULARY), "n_tokens") == by_id(tokens.section_tokens(docs, VOCABULARY), "n_tokens")
    assert tokens.section_tokens(none, VOCABULARY).count() == 0


def test_line_dedup(docs, clashing, none):
    got = linedup.dedup_lines(docs)
    assert got.count() == len(ROWS) and set(docs.columns) < set(got.columns)
    by = [(r["doc_id"], r["text"], r["n_lines"], r["n_deleted"]) for r in got.collect()]
    assert (1, sentence(1), 1, 0) in by and (2, "", 1, 1) in by
    assert sorted(x[3] for x in by if x[0] is None) == [0, 1] and sorted(x[3] for x in by if x[0] == 10) == [0, 1]
    assert (3, None, 0, 0) in by and (4, "", 0, 0) in by and (5, "   \n\t\n", 1, 0) in by and (7, LONG, 3000, 0) in by
    assert by_id(linedup.dedup_lines(clashing), "text", "n_deleted") == by_id(got, "text", "n_deleted")
    assert linedup.dedup_lines(none).count() == 0


def test_secrets(docs, clashing, none):
    model = secrets.fit(docs)
    assert not any(r["spans"] for r in secrets.scan_secrets(docs, model).collect())
    assert secrets.scan_secrets(clashing, model).count() == len(ROWS)
    assert secrets.scan_secrets(none, model).count() == 0
    assert secrets.scan_secrets(docs, secrets.fit(none)).count() == len(ROWS)


def test_licenses(docs, clashing, none):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert all((got[k]["n_words"], got[k]["labels"], got[k]["score"], got[k]["first_word"]) == (0, "", 0.0, None) for k in (3, 4, 5))
    assert by_id(licenses.scan_licenses(clashing), "n_words", "labels") == by_id(licenses.scan_licenses(docs), "n_words", "labels")
    assert licenses.scan_licenses(none).count() == 0


def test_jaccard(docs, clashing, none):
    got = neardup.jaccard_classes(docs)
    rows = by_id(got, "class_id", "n_copies", "n_links")
    assert len(rows) == len(ROWS)
    assert (1, 1, 2, 1) in rows and (2, 1, 2, 1) in rows and rows.count((10, 10, 2, 1)) == 2 and rows.count((None, None, 2, 1)) == 2
    assert all((k, k, 1, 0) in rows for k in (3, 4, 5, 7, 8, 9))
    assert by_id(neardup.jaccard_classes(clashing), "class_id", "n_links") == by_id(got, "class_id", "n_links")
    assert neardup.jaccard_classes(none).count() == 0
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and 2 not in {r["doc_id"] for r in kept.collect()}
    assert neardup.keep_one(none).count() == 0


def test_warc(spark, docs, none):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (None, None, "<p>x</p>"), (4, "bad\r\nurl x", None), (5, "", ""),
            (6, "http://ü", "é" * 3_000_000), (7, "http://c", "a\r\n\r\nb")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("place", F.lit(2))
    path = warc.write_pages(pages)
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.page_records(spark, path).collect()), key=str)
    assert got == sorted([(1, 8, "response", None), (2, 8, "revisit", 1), (2, 8, "revisit", 1), (None, 8, "revisit", 1), (4, 0, "response", None), (5, 0, "revisit", 4),
                          (6, 6_000_000, "response", None), (7, 6, "response", None)], key=str)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.page_records(spark, warc.write_pages(empty)).count() == 0


ITEM = "A train leaves town with 40 boxes of apples and 12 km of rope , then Peter adds 40 more boxes before noon on the second day of the trip"


def test_decontamination(spark, docs, clashing, none):
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, "too short"), (None, sentence(99_999, 30))], "item_id long, text string")
    assert decontaminate.leaks(docs, items).count() == 0
    more = [(20, "So it goes. " + ITEM + " and on", "en", "a", 1), (21, ITEM.replace("40", "55").replace("12", "9").replace("Peter", "Maria"), "en", "a", 1),
            (22, ITEM.replace("40", "55", 1), "en", "a", 1), (23, sentence(99_999, 30), "en", "a", 1), (None, ITEM, "en", "a", 1)]
    both = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    got = {(r["doc_id"], r["item_id"]): (r["n_slots"], r["n_changed"]) for r in decontaminate.leaks(both, items).collect()}
    # 22 gives one slot value two meanings: the changed one does not count, all the rest does
    assert got == {(20, 1): (4, 0), (21, 1): (4, 4), (22, 1): (3, 0), (23, None): (0, 0), (None, 1): (4, 0)}
    clean = [r["doc_id"] for r in decontaminate.without_leaks(both, items).collect()]
    assert sorted(clean, key=str) == sorted((r[0] for r in ROWS), key=str)
    wide = both.select("*", *[F.lit("x").alias(c) for c in CLASH])
    assert decontaminate.leaks(wide, items).count() == 5
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(both, items.limit(0)).count() == 0


def test_mixing(docs, clashing, none):
    got = mixing.mix(docs, budget_share=0.5, block_docs=2)
    assert sum(r["n_tokens"] for r in got.collect()) <= 0.5 * sum(r["n"] for r in docs.select(mixing.n_tokens(F.col("text")).alias("n")).collect())
    assert by_id(mixing.mix(clashing, budget_share=0.5, block_docs=2), "pass", "block", "place") == by_id(got, "pass", "block", "place")
    assert mixing.mix(none).count() == 0
    assert {r["source"] for r in mixing.mix(docs).collect()} <= {"a", "b", None}


def test_quality(docs, clashing, none):
    got = quality.quality_rules(docs)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(ROWS) and "text" not in got.columns
    assert all(rows[k]["base_failed"] and not rows[k]["kept"] and rows[k]["n_words"] == 0 for k in (3, 4, 5))
    assert rows[1]["kept"] and rows[1]["kept"] == rows[2]["kept"]
    assert by_id(quality.quality_rules(clashing), "n_words", "kept") == by_id(got, "n_words", "kept")
    assert quality.quality_rules(none).count() == 0
