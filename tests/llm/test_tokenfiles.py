"""Token sets: whole round trips against one plain encoding, the layout of the files, reads that pass over the rest."""

import glob
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hydrospark.llm import queries, tokenfiles as T

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: [*(t.encode(text, add_special_tokens=False).ids if text else []), 2]


def test_query(spark, plain):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    want, at = [], 0
    for d in docs:
        ids = plain(d["text"])
        want.append((d["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.queries()["op12_token_output"](spark, SF).collect()) == want


def test_pieces_do_not_change_the_ids(plain):
    with open(VOCABULARY, encoding="utf-8") as f:
        enc = T.Encoder(f.read())
    rng = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "\r\n", "a", "B", "é", "1", "½", ".", "'s", "'", "!", "\xa0", " ", "​", "\x1c", "\x85", "日本", "😀", "<|endoftext|>", "́", "\x0b", "\x00", "﻿", "_", "²"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(5000)]
    flat, sizes = enc.encode(pa.array(texts), 2)
    assert flat.tolist() == [i for t in texts for i in plain(t)] and sizes.tolist() == [len(plain(t)) for t in texts]


def test_edges(spark, plain):
    rows = [(5, "x y"), (5, "x y"), (None, "b"), (None, "a"), (None, "a"), (1, None), (2, ""), (3, " " * 1_000_000 + "a"), (4, "z" * 300_000), (9, "\n" * 400_000), (10, "<|endoftext|>")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("ids", "part", "start", "tie", "row", "n_tokens")})
    path = T.write_tokens(docs, VOCABULARY)
    got = sorted(T.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], list(r["ids"])) for r in got if r["doc_id"]] == [(i, plain(t)) for i, t in sorted(((i, t) for i, t in rows if i), key=lambda r: r[0])]
    assert [r["doc_id"] for r in got[:3]] == [None] * 3 and sorted(str(list(r["ids"])) for r in got[:3]) == sorted(str(plain(t)) for t in ("a", "a", "b"))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:])) and all(r["n_tokens"] == len(r["ids"]) for r in got)
    nothing = T.write_tokens(docs.limit(0), VOCABULARY)
    assert T.crc_of_ids(T.read_tokens(spark, nothing)).count() == 0
    with pytest.raises(ValueError):
        T.Layout("plain").options()


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_layout_and_selective_reads(spark, plain, encoding):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["river", "stone", "bridge", "wool"]) + str(rng.randrange(999)) for _ in range(rng.randrange(60)))) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    path = T.write_tokens(docs, VOCABULARY, layout=T.Layout(encoding, row_group_bytes=20_000, page_bytes=4_000, page_rows=100))
    files = glob.glob(f"{path}/ids/*.parquet".removeprefix("file:"))
    assert files
    for f in files:
        meta = pq.ParquetFile(f).metadata
        lists = meta.row_group(0).column(4)
        assert lists.path_in_schema == "ids.list.element"
        assert ("RLE_DICTIONARY" in lists.encodings or "PLAIN_DICTIONARY" in lists.encodings) if encoding == "dictionary" else "DELTA_BINARY_PACKED" in lists.encodings
        assert meta.row_group(0).column(0).has_column_index and lists.has_offset_index
        ends = [(meta.row_group(k).column(0).statistics.min, meta.row_group(k).column(0).statistics.max) for k in range(meta.num_row_groups)]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    assert max(pq.ParquetFile(f).metadata.num_row_groups for f in files) > 1
    stream = [i for _, t in rows for i in plain(t)]
    some = T.read_tokens(spark, path, F.col("doc_id").between(700, 705))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,700)" in plan
    assert {r["doc_id"]: list(r["ids"]) for r in some.collect()} == {i: plain(rows[i][1]) for i in range(700, 706)}
    counts = T.read_tokens(spark, path, columns=[])
    assert "ids" not in counts._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1].split(">")[0]
    for start, n in ((0, 10), (1234, 5000), (len(stream) - 7, 100), (len(stream), 5)):
        got = sorted(T.read_window(spark, path, start, n).collect(), key=lambda r: r["start"])
        assert [i for r in got for i in r["ids"]] == stream[start:start + n]
