"""Cases of the second review: each lost documents or parts of the job before."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from test_edges import ITEM, SCHEMA, sentence


def stage(spark, tmp_path, texts, items, ids=None):
    """Row numbers of ``texts`` that the benchmark stage lets through."""
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i if ids is None else ids[i], t, "en", "a", i) for i, t in enumerate(texts)]
    return sorted(r["n_chars"] for r in corpus_pipeline.benchmark_stage(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect())


def test_texts_of_many_languages_stay(spark):
    """Texts of two to four languages of which each span is sure, short and long; words that are as likely in all languages go."""
    rng = random.Random(3)
    letters = {"aa": "abcdeo", "bb": "fghiju", "cc": "klmnpe", "dd": "qrstvi"}
    talk = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randrange(3, 8))) for _ in range(n))
    rows = [(i, talk(lang, 80), lang, "a", 0) for i, lang in enumerate(sorted(letters) * 20)]
    mixed = [" ".join(talk(lang, n) for lang in langs) for n in (30, 600) for langs in (["aa", "bb"], ["aa", "bb", "cc"], ["aa", "bb", "cc", "dd"])]
    muddle = " ".join(["zzzz", "wwww", "yyyy"] * 40)
    rows += [(1000 + k, t, None, "a", k + 1) for k, t in enumerate([*mixed, muddle, "12 34"])]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r["n_chars"] for r in corpus_pipeline.language_stage(spark, docs.filter("n_chars IS NOT NULL"), "").collect() if r["n_chars"]) == [1, 2, 3, 4, 5, 6]


def test_one_broken_slot_does_not_hide_a_leak(spark, tmp_path):
    texts = [
        ITEM.replace("40", "55", 1),  # equal values became different
        ITEM.replace("40", "7").replace("12", "7"),  # different values became equal
        sentence(3),
    ]
    assert stage(spark, tmp_path, texts, [ITEM]) == [2]


def test_slots_that_are_mixed_up_cover_nothing(spark, tmp_path):
    row = lambda values: " ".join(f"{v} and {w}" for v, w in zip(values[::2], values[1::2]))
    table = row([1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2])
    assert stage(spark, tmp_path, [row([3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]), row([3, 4] * 6)], [table]) == [0]


def test_alignments_close_together_add_up(spark, tmp_path):
    passage = sentence(77, 36)
    words = passage.split(" ")
    thirds = [" ".join(words[i:i + 12]) for i in (0, 12, 24)]
    question = "at dawn young Peter gave old Maria some of the apples that Walter and Susan had found near Oxford while little Henry slept"
    longer = question
    for name, other in (("Peter", "Anna Lee"), ("Maria", "Tom Fox"), ("Walter", "Ben Ali"), ("Susan", "Eva Kern"), ("Oxford", "New York"), ("Henry", "Max Roe")):
        longer = longer.replace(name, other)
    heading = "the Old Stone Bridge Over The Narrow River And The Wool Trade"
    texts = [
        f"{thirds[0]} indeed {thirds[1]} again {thirds[2]}",
        f"and {longer} there",
        f"see {heading} there",
        f"{thirds[0]} {sentence(5, 900)} {thirds[2][:60]}",  # far apart: no leak
    ]
    assert stage(spark, tmp_path, texts, [passage, question, heading]) == [3]


def test_rows_with_null_or_equal_ids_are_judged_one_by_one(spark, tmp_path):
    texts, ids = [sentence(1), ITEM, sentence(2), sentence(3), ITEM, sentence(3), sentence(4)], [None, None, None, 10, 10, 10, 10]
    assert stage(spark, tmp_path, texts, [ITEM], ids) == [0, 2, 3, 5, 6]
    docs = spark.createDataFrame([(i, t, "en", "a", k) for k, (i, t) in enumerate(zip(ids, texts))], SCHEMA)
    assert sorted(r["n_chars"] for r in corpus_pipeline.jaccard_stage(spark, docs, "").collect()) == [0, 2, 3, 4, 6]
    nothing = docs.limit(1).withColumn("text", F.lit(None).cast("string"))
    assert corpus_pipeline.jaccard_stage(spark, nothing.union(nothing), "").count() == 2


def test_each_statistic_alone_can_be_an_outlier(spark):
    from hydrospark.llm import quality
    rng = random.Random(9)
    words = lambda n, size=5: ["".join(rng.choice("abcdefghij") for _ in range(size)) for _ in range(n)]
    again = words(68)
    planted = [
        " ".join(words(3600)), " ".join(words(300, 12)),  # words, their length
        " ".join(w[1:] + "#" if i < 87 else w for i, w in enumerate(words(300))),  # symbols
        "\n".join(x for _ in range(50) for x in (" ".join(words(5)), "abcde")),  # lines
        " ".join(again + words(82) + again + words(82)),  # windows
    ]
    rows = [(i, " ".join(words(300)), "en", "a", 0) for i in range(300)] + [(1000 + i, t, "en", "a", 0) for i, t in enumerate(planted)]
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[1000 + i]["base_failed"] or got[1000 + i]["kept"] for i in range(5))
    assert all(got[i]["kept"] for i in range(300))


def test_long_runs_do_not_end_the_job(spark, tmp_path):
    """Runs of names, joined digits, signs and blanks of 200,000 pieces, in query and stage; the item after them is found."""
    n = 200_000
    runs = ["Alpha " * n, "1," * n, "." * n, "1 " * n, " " * n, "Alpha 12 km " * (n // 3), "Ab, " * n]
    assert stage(spark, tmp_path, [f"{r}\n so then {ITEM}" for r in runs] + runs, [ITEM]) == list(range(len(runs), 2 * len(runs)))


def test_tables_of_placeholders_find_nothing(spark):
    """A document of numbers does not meet an item of numbers, in as few rows; within an alignment they count."""
    from hydrospark.llm import decontaminate
    numbers = " ; ".join(str(i) for i in range(5000))
    items = spark.createDataFrame([(1, " ; ".join(str(i) for i in range(100, 112))), (2, "what is the sum of the numbers " + " , ".join(str(i) for i in range(20)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, numbers, "en", "a", 0), (2, "so what is the sum of the numbers " + " , ".join(str(i + 50) for i in range(20)), "en", "a", 0)], SCHEMA)
    got = [(r["doc_id"], r["item_id"], r["n_tokens"], r["n_slots"], r["n_changed"]) for r in decontaminate.leaks(docs, items).collect()]
    assert got == [(2, 2, 27, 20, 20)]


def test_names_that_open_a_sentence_or_grow(spark):
    from hydrospark.llm import decontaminate
    item = "Peter has four old boats. Peter sells two of them to Maria and keeps the rest for the summer."
    other = "Anna Lee has four old boats. Anna Lee sells two of them to Tom and keeps the rest for the summer."
    mixed = "Anna has four old boats. Walter sells two of them to Tom and keeps the rest for the summer."
    docs = spark.createDataFrame([(1, other, "en", "a", 0), (2, mixed, "en", "a", 0)], SCHEMA)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = sorted((r["doc_id"], r["n_slots"], r["n_changed"]) for r in decontaminate.leaks(docs, items).collect())
    assert got == [(1, 3, 3), (2, 2, 2)]
