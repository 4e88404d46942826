"""Token ids as Parquet list columns: documents in id order, controlled row groups and pages, selective reads.

A token set is a folder of two tables. ``ids`` has one row per document, sorted by id over all files:
``doc_id``, ``part`` (number of its file), ``n_tokens``, ``local_start`` (tokens before it in its file) and
``ids``, the list itself. ``parts`` has one row per file with the tokens in all files before it, so a place in
the whole stream is one addition away and no file is written twice. Ids are sorted and every page has its
minimum and maximum in the page index: a read by id opens the row groups and pages that can hold it, and a read of
``n_tokens`` never touches the column of lists.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hydrospark.llm.common import bounded_broadcast, map_slices, shared_dir, slices

#: A vocabulary file larger than this is refused: it travels to every task.
VOCABULARY_BYTES = 64_000_000

# White space of every Unicode version, and characters that some versions or libraries also call white space.
BLANK = " \\t\\n\\r\\x0b\\x0c\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
DOUBTFUL = re.compile("[\\x1c-\\x1f\\x85\\u180e\\u200b\\u2060\\ufeff]")
# Texts that are not cut at every single blank: a blank behind a blank, or doubtful characters. Syntax of RE2.
UNEVEN = r"[\x09-\x0d\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] |[\x1c-\x1f\x{85}\x{180e}\x{200b}\x{2060}\x{feff}]"
#: A line break behind another blank, syntax of RE2; and what stands for a blank and line break: a doubtful character, which texts that are cut at blanks do not hold.
BLANK_LINE = r"[\x09-\x0d\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]\n"
LINE = "\x1c"
SURE_CUT = re.compile("(?<=[!-~])(?=[ \\t\\n\\r])")

#: Pieces a worker remembers (about 50 bytes each) before it forgets the half met least often, and the longest of them.
MEMORY, LONGEST = 500_000, 40

#: Bytes of text encoded at once: a piece is looked up once a slice, so larger slices save work; about 12 times that is held.
SLICE_BYTES = 8_000_000


@dataclass(frozen=True)
class Layout:
    """How the list column is stored.

    ``encoding``: ``dictionary`` (a dictionary page per row group, packed indices) or ``delta`` (version 2
    pages, differences packed to the bit width of their block). Row groups end near ``row_group_bytes``, pages
    near ``page_bytes`` or at ``page_rows`` documents, whichever comes first.
    """

    encoding: str = "dictionary"
    row_group_bytes: int = 64 * 1024 * 1024
    page_bytes: int = 256 * 1024
    page_rows: int = 2_000
    codec: str = "zstd"

    def options(self) -> dict[str, str]:
        if self.encoding not in ("dictionary", "delta"):
            raise ValueError(f"encoding {self.encoding!r} is neither 'dictionary' nor 'delta'")
        listed = "ids.list.element"
        out = {
            "compression": self.codec, "parquet.block.size": str(self.row_group_bytes), "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_rows), "parquet.dictionary.page.size": str(4 * 1024 * 1024),
            "parquet.enable.dictionary": "true",
        }
        if self.encoding == "delta":
            out |= {"parquet.writer.version": "PARQUET_2_0", f"parquet.enable.dictionary#{listed}": "false"}
        return out


def pieces_of(text: str) -> list[str]:
    """The text cut where a token of a byte-level vocabulary never reaches over: before a run of blanks.

    The split pattern of such vocabularies looks ahead but never back, and takes a blank only at the start of a
    token or among blanks. A text with characters of doubtful kind is cut behind plain ASCII alone.
    """
    return SURE_CUT.split(text) if DOUBTFUL.search(text) else PIECE.findall(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(vocabulary: str) -> Encoder:
    """The encoder of this Python worker: tasks that follow each other in it share what it remembers."""
    if vocabulary not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


class Encoder:
    """Encodes texts piece by piece with a bounded memory of pieces."""

    def __init__(self, vocabulary: str):
        import os
        # the tasks of an executor share its cores already
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        named = self.tokenizer.get_vocab(with_added_tokens=False)
        #: Bytes of each token: in a byte-level vocabulary a character of its name stands for a byte.
        self.bytes_of = np.zeros(max(named.values(), default=0) + 1, np.int64)
        for name, i in named.items():
            self.bytes_of[i] = len(name)
        # the pieces remembered: where the ids of each begin in ``ids``, how many they are, and how often they were met
        self.pieces, self.ids = pa.array([], pa.string()), np.zeros(0, np.int32)
        self.first, self.sizes, self.met = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces, and first place and number of the ids of each. Those that begin and end a run of blanks cleanly go many to a call."""
        n_bytes = pc.binary_length(new)
        clean = pc.and_(pc.or_(pc.starts_with(new, " "), pc.starts_with(new, "\n")), pc.equal(pc.binary_length(pc.utf8_rtrim_whitespace(new)), n_bytes))
        clean = clean.to_numpy(zero_copy_only=False)
        joined = new.filter(pa.array(clean)).to_pylist()
        groups = ["".join(joined[a:a + 400]) for a in range(0, len(joined), 400)]
        ids = array("i")
        for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False):
            ids.extend(e.ids)
        # no token reaches over a piece's end, so the bytes tell which tokens are whose
        ends = np.cumsum(self.bytes_of[np.frombuffer(ids, np.int32)]) if len(ids) else np.zeros(0, np.int64)
        piece_ends = np.cumsum(n_bytes.to_numpy(zero_copy_only=False)[clean].astype(np.int64))
        cuts = np.concatenate([[0], np.searchsorted(ends, piece_ends) + 1])
        first, sizes = np.zeros(len(new), np.int64), np.zeros(len(new), np.int32)
        first[clean], sizes[clean] = cuts[:-1], np.diff(cuts)
        for i, e in zip(np.flatnonzero(~clean).tolist(), self.tokenizer.encode_batch_fast(new.filter(pa.array(~clean)).to_pylist(), add_special_tokens=False)):
            first[i], sizes[i] = len(ids), len(e.ids)
            ids.extend(e.ids)
        return np.array(ids, np.int32), first, sizes

    def _known(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in one array, and first place and number of the ids of each piece; pieces not met before are encoded and remembered."""
        at = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy(zero_copy_only=False).copy()
        self.met[at[at >= 0]] += 1
        new = np.flatnonzero(at < 0)
        at[new] = len(self.pieces) + np.arange(len(new))
        unmet = pieces.take(pa.array(new))
        ids, first, sizes = self._learn(unmet)
        flat = np.concatenate([self.ids, ids])
        first, sizes = np.concatenate([self.first, first + len(self.ids)]), np.concatenate([self.sizes, sizes])
        self._remember(pa.concat_arrays([self.pieces, unmet]), flat, first, sizes)
        return flat, first[at], sizes[at]

    def _remember(self, pieces: pa.Array, flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> None:
        met = np.concatenate([self.met, np.ones(len(pieces) - len(self.met), np.int32)])
        kept = np.flatnonzero(pc.less_equal(pc.utf8_length(pieces), LONGEST).to_numpy(zero_copy_only=False))
        if len(kept) > MEMORY:
            # those met most often stay, of equals the latest
            kept = np.sort(kept[::-1][np.argsort(-met[kept[::-1]], kind="stable")[:MEMORY // 2]])
            met = met // 2
        n = sizes[kept].astype(np.int64)
        begin = np.cumsum(n) - n
        self.ids = flat[np.repeat(first[kept] - begin, n) + np.arange(n.sum())]
        self.pieces, self.first, self.sizes, self.met = pieces.take(pa.array(kept)), begin, sizes[kept], met[kept]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, ``end_id`` after each text, and the number of ids of each text."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        plain = pc.invert(pc.match_substring_regex(texts, UNEVEN))
        even_texts = texts.filter(plain)
        # a line break behind a blank belongs to that blank's run; others begin a piece, and stand as LINE till then
        lone = pc.invert(pc.match_substring_regex(even_texts, BLANK_LINE))
        words = pc.split_pattern(pc.if_else(lone, pc.replace_substring(even_texts, "\n", " " + LINE), even_texts), " ")
        coded = words.values.dictionary_encode()
        # every word but a text's first has its blank before it; those that do not are listed behind
        starts, n_coded = words.offsets.to_numpy().astype(np.int64), len(coded.dictionary)
        codes = coded.indices.to_numpy().astype(np.int32)
        place: dict[str, int] = {}
        code = lambda p: place.setdefault(p, n_coded + len(place))
        codes[starts[:-1]] = [code(w) for w in words.values.take(pa.array(starts[:-1])).to_pylist()]
        others = [[code(p) for p in pieces_of(t)] for t in texts.filter(pc.invert(plain)).to_pylist()]
        pieces = pc.replace_substring(pc.binary_join_element_wise(" ", coded.dictionary, ""), " " + LINE, "\n")
        flat, first, sizes = self._known(pa.concat_arrays([pieces, pa.array(list(place), pa.string())]))
        # the end of a text is one more piece
        end, flat, first, sizes = len(sizes), np.append(flat, np.int32(end_id)), np.append(first, len(flat)), np.append(sizes, np.int32(1))
        del pieces, place, coded, even_texts
        if others:
            even = plain.to_numpy(zero_copy_only=False)
            whole, rest = iter(np.split(codes, starts[1:-1])), iter(others)
            parts = [next(whole) if e else np.array(next(rest), np.int32) for e in even.tolist()]
            counts = np.array([len(c) for c in parts])
            codes, starts = np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])
        codes = np.insert(codes, starts[1:], end)
        n = sizes[codes]
        ends = np.cumsum(n, dtype=np.int64)
        # each id's place in ``flat``: 32 bits hold it, as a slice and its pieces are bounded by a text
        place_of = np.repeat((first[codes] - ends + n).astype(np.int32), n)
        place_of += np.arange(len(place_of), dtype=np.int32)
        ids = flat[place_of]
        # places of the first piece of each text, end pieces included
        heads = starts[:-1] + np.arange(len(starts) - 1)
        return ids, np.add.reduceat(n.astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int = 2, layout: Layout = Layout(), id_col: str = "doc_id", text: str = "text") -> str:
    """Encode every whole text once and write the token set; returns its folder below the shared one.

    ``vocabulary`` is a file of the tokenizers library that the driver can read, with byte-level pieces; its
    content travels with the job. A null or empty text is ``end_id`` alone. Strings of special tokens inside a
    text are ordinary text. Rows are ordered by id, null ids first; rows of equal ids by a hash of their text, then
    by their place in the input: each is a document of its own. Other columns are not written.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read()
    if len(content) > VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} has more than {VOCABULARY_BYTES} characters")
    sent = spark.sparkContext.broadcast(content)
    # the place in the scan parts equal rows, so that they do not fill one range; the ranges are by id
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc(), F.col("tie").asc(), F.col("row").asc()]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    kind = ordered.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        encoder, at = encoder_for(sent.value), 0
        for batch in slices(batches, "text", SLICE_BYTES):
            flat, sizes = encoder.encode(batch.column("text"), end_id)
            ends = np.cumsum(sizes)
            if len(flat) >= 2**31:
                raise ValueError("a text has more tokens than an Arrow list can hold")
            lists = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(sizes), part, np.int32)), pa.array(sizes), pa.array(at + ends - sizes), lists],
                names=["doc_id", "part", "n_tokens", "local_start", "ids"])
            at += int(sizes.sum())

    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    made = ordered.mapInArrow(run, f"doc_id {kind}, part int, n_tokens bigint, local_start bigint, ids array<int>")
    made.write.options(**layout.options()).parquet(f"{path}/ids")
    sizes = spark.read.schema(made.schema).parquet(f"{path}/ids").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"))
    # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes.withColumn("offset", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("bigint"))).write.parquet(f"{path}/parts")
    return path


def read_tokens(spark: SparkSession, path: str, where: Column | None = None, columns: list[str] = ("ids",)) -> DataFrame:
    """(doc_id, start, n_tokens, *columns) of the documents for which ``where`` (over doc_id, n_tokens) holds.

    Conditions on ``doc_id`` reach the files, where row groups and pages outside are passed over. Without
    ``ids`` among the columns no token is read. ``start`` counts the ids of all documents before.
    """
    rows = spark.read.parquet(f"{path}/ids")
    if where is not None:
        rows = rows.filter(where)
    parts = spark.read.parquet(f"{path}/parts").select(F.col("part").alias("_part"), "offset")
    joined = rows.join(bounded_broadcast(parts, 200_000), F.col("part") == F.col("_part"))
    return joined.select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", *columns)


def read_window(spark: SparkSession, path: str, start: int, length: int) -> DataFrame:
    """(start, ids): the pieces of documents that make up the tokens ``start`` to ``start + length`` of the stream.

    ``start`` is the place of each piece. The files of the window are found from the table of files; in them
    only documents that reach into the window are read.
    """
    end = start + length
    held = spark.read.parquet(f"{path}/parts").filter((F.col("offset") < end) & (F.col("offset") + F.col("n_tokens") > start))
    held = held.select(F.col("part").alias("_part"), "offset")
    rows = spark.read.parquet(f"{path}/ids").join(bounded_broadcast(held, 200_000), F.col("part") == F.col("_part"))
    at = F.col("offset") + F.col("local_start")
    first = F.greatest(F.lit(start) - at, F.lit(0))
    last = F.least(F.lit(end) - at, F.col("n_tokens"))
    inside = rows.filter((at < end) & (at + F.col("n_tokens") > start))
    return inside.select((at + first).alias("start"), F.slice("ids", (first + 1).cast("int"), (last - first).cast("int")).alias("ids"))


def crc_of_ids(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """``rows`` with ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers) in place of the lists."""
    kept = [f for f in rows.schema.fields if f.name != ids]

    def run(batches):
        for batch in batches:
            lists = batch.column(ids)
            flat = lists.values.to_numpy().astype("<u4")
            cuts = lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(crc, pa.int64())], names=[*(f.name for f in kept), "ids_crc32"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", ids_crc32 bigint")
