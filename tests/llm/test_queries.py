"""Registered queries over whole tables: against their SQL, or against a plain version in Python."""

import base64
import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from compare import compare, connect

import corpus_pipeline
from hydrospark.llm import decontaminate, linedup, mixing, neardup, queries, secrets, tokens

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
Q = queries.queries()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas().to_dict("records")


def run(spark, name):
    return {r["doc_id"]: r for r in Q[name](spark, SF).collect()}


@pytest.mark.parametrize("name", list(queries.oracles()))
def test_sql(spark, name):
    ok, message = compare(name, Q[name](spark, SF), connect(SF), queries.oracles()[name])
    assert ok, message


def test_op1(spark, documents):
    got = run(spark, "op1_language_id")
    assert len(got) == len(documents)
    assert all(got[d["doc_id"]]["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2) for d in documents)
    judged = [got[d["doc_id"]]["lang_pred"] == d["lang"] for d in documents if got[d["doc_id"]]["held_out"]]
    assert np.mean(judged) >= 0.95 and all(0 <= r["score"] <= 1 for r in got.values())


def test_op2(spark, documents):
    """Another library's encoding and a loop over its tokens."""
    from tokenizers import Tokenizer
    enc = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    enc.encode_special_tokens = True
    got = run(spark, "op2_token_counts")
    for d in documents[:80]:
        sections = []
        at = 0
        for line in d["text"].split("\n"):
            cuts = [0, *[m.end() for m in re.finditer(r"[.!?]+[ \t]+", line) if m.end() < len(line)], len(line)]
            sections += [(at + a, at + b) for a, b in zip(cuts, cuts[1:]) if b > a]
            at += len(line) + 1
        counts, outside = [0] * len(sections), 0
        spans = enc.encode(d["text"], add_special_tokens=False).offsets
        for a, b in spans:
            held = [min(b, hi) - max(a, lo) for lo, hi in sections]
            if held and max(held) > 0:
                counts[held.index(max(held))] += 1
            else:
                outside += 1
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["n_outside"]) == (len(spans), outside)
        assert [(s["start"], s["end"], s["n_tokens"]) for s in r["sections"]] == [(a, b, n) for (a, b), n in zip(sections, counts)]


def test_allocation_of_crossing_tokens():
    starts, ends = np.array([0, 3, 8, 12]), np.array([3, 8, 12, 30])
    # 0-3 in the first; 3-8 has two characters on either side of the gap: the earlier; 8-12 in the second; 12-30 mostly in the last
    assert tokens.allocate(starts, ends, np.array([0, 6, 14, 15]), np.array([5, 14, 15, 40])).tolist() == [0, 0, 1, 3]
    assert tokens.allocate(starts, ends, np.array([], int), np.array([], int)).tolist() == [-1] * 4


def test_op4(spark, documents):
    got = run(spark, "op4_secret_scan")
    key = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in "password") + "|" + "|".join(
        "".join(f"[{c.lower()}{c.upper()}]" for c in w) for w in ("passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    assign = re.compile(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for d in documents:
        t = d["text"]
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(base))
        r = got[d["doc_id"]]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(b[1] == k for b in base) for k in range(3))
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))


def test_field_learns_and_generalises(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("etaoinshr"), rng.integers(2, 8)))
    secret = lambda: "".join(rng.choice(list("0123456789abcdefABCDEFGHJKxyz"), 32))
    rows = [(i, " ".join(word() for _ in range(30)) + (f' token = "{secret()}" ' if i % 3 == 0 else " ") + " ".join(word() for _ in range(30))) for i in range(240)]
    model = secrets.fit(spark.createDataFrame(rows, "doc_id long, text string"), negative_every=1)
    seen = [t for i, t in rows if i % 3 == 0]
    assert all(spans for spans in secrets.field_spans(seen, *model))
    fresh = [" ".join(word() for _ in range(20)) + f" bearer {secret()} " + " ".join(word() for _ in range(20)) for _ in range(20)]
    assert sum(bool(s) for s in secrets.field_spans(fresh, *model)) >= 15
    clean = [" ".join(word() for _ in range(200)) for _ in range(20)]
    assert not any(secrets.field_spans(clean, *model))


def test_op5(spark, documents):
    got = run(spark, "op5_license_scan")
    phrases = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
    for d in documents:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d["text"])
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        at = sorted((i, label) for p, label in phrases for i in range(len(words)) if words[i:i + len(p.split())] == p.split())
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_base"]) == (len(words), len(at))
        assert (r["first_word"], r["last_word"]) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x[1] for x in at})) and {x[1] for x in at} <= set(r["labels"].split(","))


def test_fuzzy_notice_against_edit_distance():
    from hydrospark.llm.licenses import NOTICES, Searcher, normalise

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng, s = np.random.default_rng(1), Searcher()
    for phrase, _ in NOTICES:
        for n in range(len(phrase) // 12 + 1):
            chars = list(phrase)
            for i in rng.choice(np.arange(1, len(chars) - 1), n, replace=False):
                chars[i] = "z" if chars[i] != " " else chars[i]
            text = "before it " + "".join(chars) + " and after"
            found = s.find(normalise(text))
            assert found and min(x[3] for x in found) <= distance("".join(chars), phrase)
    assert s.find(normalise("nothing of the kind is licensed here")) == []


def grams(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(rows):
    sets = [grams(t) for _, t in rows]
    where, degree, parent = {}, Counter(), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in where.get(g, ()))
        for g in s:
            where.setdefault(g, []).append(i)
        for j, k in shared.items():
            if k >= 0.8 * (len(s) + len(sets[j]) - k) - 1e-6:
                degree[i] += 1
                degree[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (least[root(i)], degree[i]) for i, (d, _) in enumerate(rows)}


def test_op6(spark, documents):
    want = classes([(d["doc_id"], d["text"]) for d in documents])
    assert {k: (r["class_id"], r["n_links"]) for k, r in run(spark, "op6_jaccard_join").items()} == want


def test_op6_dense_group_without_a_centre(spark):
    """Copies of one text with many or few words changed: some link, some do not, in one bucket."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in rng.choice(200, int(rng.integers(0, 9)), replace=False):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    got = neardup.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got.collect()} == classes(rows)


def test_op7(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas().to_dict("records")
    first, want = {}, {}
    for p in sorted(pages, key=lambda p: p["page_id"]):
        data = (p["html"] or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        home = first.setdefault(digest, p["page_id"])
        want[p["page_id"]] = (len(data), digest, "response" if home == p["page_id"] else "revisit", None if home == p["page_id"] else home)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in Q["op7_warc"](spark, SF).collect()}
    assert got == want


def test_op10(spark, documents):
    got = run(spark, "op10_quality_rules")
    for d in documents:
        w = re.findall(r"[^\x20\x09-\x0D]+", d["text"])
        windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        often = Counter(windows)
        repeat = len({i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)})
        lines, seen, again = d["text"].split("\n"), set(), 0
        for line in lines:
            again += line in seen and re.search(r"[^\x20\x09-\x0D]", line) is not None
            seen.add(line)
        r = got[d["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", d["text"])), again, repeat)
        assert r["base_failed"] == (len(w) < 50 or 100 * repeat > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [got[k]["kept"] for k, v in labels.items() if v == 1 and not got[k]["base_failed"]]
    assert np.mean(clean) >= 0.98


def test_pipeline_stages(spark, tmp_path, documents):
    """Each stage against SQL or plain Python over what the stage before it wrote."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        old, new = before.toPandas(), docs.toPandas()
        kept[name] = (old, new)
        if name != "mixing":
            assert docs.columns == corpus_pipeline.COLUMNS
        con = duckdb.connect()
        con.register("documents", old)
        con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
        if name == "language_id":
            assert set(new["doc_id"]) <= set(old["doc_id"]) and len(new) >= 0.98 * len(old)
        elif name == "line_dedup":
            want = {r[0]: r[3] for r in con.execute(linedup.SQL.format(w=20)).fetchall() if r[2] == 0 or r[3]}
            assert dict(zip(new["doc_id"], new["text"])) == want
        elif name == "jaccard_join":
            want = classes(list(zip(old["doc_id"], old["text"])))
            assert set(new["doc_id"]) == {d for d, (c, _) in want.items() if d == c}
        elif name == "decontamination":
            gone = {r[0] for r in con.execute(decontaminate.sql()).fetchall()}
            assert set(new["doc_id"]) == set(old["doc_id"]) - gone
        else:
            want = con.execute(mixing.sql()).fetchall()
            assert sorted(map(tuple, new[["doc_id", "source", "n_tokens", "pass", "block"]].values.tolist())) == sorted(r[:5] for r in want)


def test_mixing_of_a_hot_source_in_many_blocks(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", " ".join(["w"] * (1 + i % 11))) for i in range(1500)]
    rows += [(5000 + i, "rare", "a b c") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    for options in ({"block_docs": 20}, {"block_docs": 7, "entropy_share": 0.99, "most_passes": 2.5, "budget_share": 0.7}, {"block_docs": 50, "budget_share": 9.0}):
        ok, message = compare("mix", mixing.mix(docs, **options), con, mixing.sql(**options))
        assert ok, message
