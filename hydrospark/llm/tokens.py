"""Token counts by section: whole documents are encoded once, tokens are attributed by their character spans."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hydrospark.llm.common import map_slices

# Fixed value: the split pattern of the public byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: A run of white space so long that the pattern's look-ahead would exhaust the regex engine.
LONG_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")

#: A vocabulary file larger than this is refused: it travels to every task.
VOCABULARY_BYTES = 64_000_000


def load_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}


def encode(enc, text: str) -> np.ndarray:
    """Token ids of a text. A long run of blanks is cut where the pattern cuts it: before its last
    character, which goes with what follows, or at the end of the text; the run is a piece of its own."""
    out, at = [], 0
    for m in LONG_BLANKS.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += enc.encode_ordinary(text[at:m.start()])
        out += enc._encode_single_piece(text[m.start():end].encode())
        at = end
    out += enc.encode_ordinary(text[at:])
    return np.asarray(out, np.int64)


#: A section ends after a sentence's end and the blanks behind it, or before a line feed.
SENTENCE_END = re.compile(r"[.!?]+[\x20\t]+")


def sections_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Section bounds of all texts: (text number, start, end) of the sentences of each line, without line feeds."""
    doc, start, end = [], [], []
    for i, t in enumerate(texts):
        at = 0
        for line in t.split("\n"):
            if line:
                cuts = [at + m.end() for m in SENTENCE_END.finditer(line) if m.end() < len(line)]
                start += [at, *cuts]
                end += [*cuts, at + len(line)]
                doc += [i] * (len(cuts) + 1)
            at += len(line) + 1
    return np.array(doc, np.int64), np.array(start, np.int64), np.array(end, np.int64)


def token_spans(enc, size_of: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character start and end of each token of the text; a token that holds part of a character covers all of it."""
    raw = text.encode("utf-8", "replace")
    ids = encode(enc, text)
    ends = np.cumsum(size_of[ids])
    starts = ends - size_of[ids]
    if len(raw) == len(text):
        return starts, ends
    byte = np.frombuffer(raw, np.uint8)
    number = np.cumsum((byte & 0xC0) != 0x80) - 1  # character that each byte belongs to
    return number[starts], number[ends - 1] + 1


def allocate(starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Section of each token, -1 for none. Sections are disjoint and sorted.

    A token goes to the section that holds most of its characters, the earliest of equals; one that
    touches no section goes to none. Only the sections that a token touches are compared.
    """
    if not len(lo):
        return np.full(len(starts), -1, np.int64)
    first = np.searchsorted(hi, starts, side="right")       # first section ending after the token's start
    last = np.searchsorted(lo, ends, side="left") - 1       # last section starting before the token's end
    got = np.where(first <= last, first, -1)
    held = lambda k, i: np.minimum(hi[k], ends[i]) - np.maximum(lo[k], starts[i])
    two = np.flatnonzero(last == first + 1)
    got[two] = np.where(held(last[two], two) > held(first[two], two), last[two], first[two])
    for i in np.flatnonzero(last > first + 1):
        k = np.arange(first[i], last[i] + 1)
        got[i] = k[np.argmax(held(k, i))]
    return got


def _count(part: pa.RecordBatch, id_col: str, text: str, tools) -> dict[str, np.ndarray]:
    enc, size_of = tools()
    texts = [t or "" for t in part.column(text).to_pylist()]
    doc, lo, hi = sections_of(texts)
    bound = np.searchsorted(doc, np.arange(len(texts) + 1))
    counts, crossing, outside, total = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if not t:
            continue
        s, e = token_spans(enc, size_of, t)
        a, b = lo[bound[i]:bound[i + 1]], hi[bound[i]:bound[i + 1]]
        got = allocate(s, e, a, b)
        inside = got >= 0
        counts[bound[i]:bound[i + 1]] = np.bincount(got[inside], minlength=len(a))
        over = inside & ((s < a[got]) | (e > b[got])) if len(a) else inside
        crossing[bound[i]:bound[i + 1]] = np.bincount(got[over], minlength=len(a))
        total[i], outside[i] = len(s), (~inside).sum()
    return {"doc": doc, "lo": lo, "hi": hi, "counts": counts, "crossing": crossing, "outside": outside, "total": total}


def section_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of every sentence of every line of every text: one row per document, with a list of its sections.

    ``n_tokens`` counts the whole text encoded once; ``sections`` lists start, end, tokens and how many
    of these tokens reach over the section's border; ``n_outside`` counts tokens that touch no section
    (line feeds alone). Tokens that cross a border go to the section holding most of their characters,
    the earlier of equals, so that the sections and ``n_outside`` add up to ``n_tokens``. Null or empty
    text has no tokens and no sections. Repeated rows are counted alike.

    ``vocabulary`` is the path of a rank file (base64 token and rank a line) of a public tokenizer; it is
    read on the driver and its content, of at most 64 MB, travels with the job.
    """
    with open(vocabulary, "rb") as f:
        content = f.read()
    if len(content) > VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} has more than {VOCABULARY_BYTES} bytes")
    sent = docs.sparkSession.sparkContext.broadcast(content)
    held = []

    def tools():
        if not held:
            import tiktoken
            ranks = load_ranks(sent.value)
            size_of = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, rank in ranks.items():
                size_of[rank] = len(token)
            held.append((tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size_of))
        return held[0]

    def run(part: pa.RecordBatch) -> dict[str, object]:
        x = _count(part, id_col, text, tools)
        at = pa.array(np.searchsorted(x["doc"], np.arange(len(x["total"]) + 1)).astype(np.int32))
        items = pa.StructArray.from_arrays([pa.array(x["lo"].astype(np.int32)), pa.array(x["hi"].astype(np.int32)), pa.array(x["counts"]), pa.array(x["crossing"])],
                                           names=["start", "end", "n_tokens", "n_crossing"])
        return {"n_tokens": x["total"], "n_outside": x["outside"], "sections": pa.ListArray.from_arrays(at, items)}

    return map_slices(docs.select(id_col, text), text, run,
                      "n_tokens bigint, n_outside bigint, sections array<struct<start:int,end:int,n_tokens:bigint,n_crossing:bigint>>", [id_col])

