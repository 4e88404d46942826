"""WARC archives as a Spark data source: write pages with payload revisits, read records with header predicates."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage,
)

from hydrospark.llm.common import bounded_broadcast, cut, shared_dir

SCHEMA = ("warc_type string, record_id string, target_uri string, warc_date string, refers_to string, payload_digest string, "
          "payload_bytes bigint, payload binary")
HEADERS = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date",
           "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
INPUT = "record_id string, target_uri string, refers_to string, digest_hex string, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest.json"
#: A new split may begin after so many bytes of an archive.
SPLIT_BYTES = 4 << 20


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file:///" + path[len("file:/"):].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


# ---------------------------------------------------------------- writing

def record_bytes(record_id: str, uri: str | None, refers_to: str | None, digest: str, payload: bytes, date: str) -> bytes:
    """One record; a revisit keeps the HTTP headers, with the length of the payload it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in uri))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to:
        lines += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(record: bytes, level: int) -> bytes:
    """A gzip member whose extra field ``sl`` tells its own length, so that readers can step over it."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    data = pack.compress(record) + pack.flush()
    size = 10 + 2 + 12 + len(data) + 8
    return (b"\x1f\x8b\x08\x04" + b"\0\0\0\0" + b"\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(record) & 0xFFFFFFFF)
            + data + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF))


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    splits: list[int]


class WarcWriter(DataSourceArrowWriter):
    """One archive a task, under a name of its own; the manifest written on commit names those that count."""

    def __init__(self, path: str, level: int, date: str):
        self.path, self.level, self.date = path, level, date

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = locate(self.path)
        fs.create_dir(path, recursive=True)
        name, at, splits = f"{uuid.uuid4().hex}.warc.gz", 0, [0]
        with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in iterator:
                for rid, uri, ref, digest, payload in zip(*(batch.column(c).to_pylist() for c in ("record_id", "target_uri", "refers_to", "digest_hex", "payload"))):
                    data = member(record_bytes(rid, uri, ref, base64.b32encode(bytes.fromhex(digest)).decode(), payload or b"", self.date), self.level)
                    if at - splits[-1] >= SPLIT_BYTES:
                        splits.append(at)
                    out.write(data)
                    at += len(data)
        return Written(name, at, splits)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = locate(self.path)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps([[m.name, m.size, m.splits] for m in messages if m]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = locate(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{path}/{m.name}")


# ---------------------------------------------------------------- reading

@dataclass
class Part(InputPartition):
    name: str
    start: int
    end: int


def parse_headers(block: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in block.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        out[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


class Members:
    """The records of a stretch of an archive; each gives its head first, the rest only on demand."""

    def __init__(self, stream, end: int):
        self.stream, self.end = stream, end

    def __iter__(self) -> Iterator[Record]:
        s = self.stream
        while s.tell() < self.end:
            at = s.tell()
            head = s.read(24)
            if head[:2] != b"\x1f\x8b":
                s.seek(at)
                yield PlainRecord(s)
            elif len(head) == 24 and head[3] & 4 and head[12:14] == b"sl":
                size = struct.unpack("<I", head[16:20])[0]
                yield SizedRecord(s.read(size - 24))
                s.seek(at + size)
            else:
                s.seek(at)
                record = StreamRecord(s)
                yield record
                record.finish()


class Record:
    def head(self) -> bytes: ...
    def rest(self, length: int) -> bytes: ...


class SizedRecord(Record):
    def __init__(self, data: bytes):
        self.inflate, self.data, self.held = zlib.decompressobj(-15), data[:-8], b""

    def head(self) -> bytes:
        self.held = self.inflate.decompress(self.data, 2048)
        while b"\r\n\r\n" not in self.held and self.inflate.unconsumed_tail:
            self.held += self.inflate.decompress(self.inflate.unconsumed_tail, 2048)
        head, _, self.held = self.held.partition(b"\r\n\r\n")
        return head

    def rest(self, length: int) -> bytes:
        return (self.held + self.inflate.decompress(self.inflate.unconsumed_tail))[:length]


class PlainRecord(Record):
    """Uncompressed: what is not wanted is stepped over by its stated length."""

    def __init__(self, stream):
        self.stream, self.at = stream, stream.tell()

    def head(self) -> bytes:
        held = b""
        while b"\r\n\r\n" not in held:
            more = self.stream.read(2048)
            if not more:
                break
            held += more
        head = held.partition(b"\r\n\r\n")[0]
        self.body = self.at + len(head) + 4
        self.stream.seek(self.body + int(parse_headers(head).get("content-length", 0)) + 4)
        return head

    def rest(self, length: int) -> bytes:
        after = self.stream.tell()
        self.stream.seek(self.body)
        data = self.stream.read(length)
        self.stream.seek(after)
        return data


class StreamRecord(Record):
    """A gzip member of unknown length: inflated in pieces to find its end, kept only where wanted."""

    def __init__(self, stream):
        self.stream, self.inflate, self.held = stream, zlib.decompressobj(31), b""

    def _more(self) -> bytes:
        data = self.stream.read(1 << 16)
        out = self.inflate.decompress(data)
        if self.inflate.eof:
            self.stream.seek(self.stream.tell() - len(self.inflate.unused_data))
        return out if data else b""

    def head(self) -> bytes:
        while b"\r\n\r\n" not in self.held and not self.inflate.eof and (more := self._more()):
            self.held += more
        head, _, self.held = self.held.partition(b"\r\n\r\n")
        return head

    def rest(self, length: int) -> bytes:
        while len(self.held) < length and not self.inflate.eof and (more := self._more()):
            self.held += more
        return self.held[:length]

    def finish(self) -> None:
        while not self.inflate.eof and self._more():
            pass


class WarcReader(DataSourceReader):
    """Record-type and header predicates are decided from the headers; other records are stepped over.

    Option ``payload``: ``decode`` gives the payload, ``verify`` reads and checks it against the stated
    digest without passing it on, ``skip`` does not inflate it at all.
    """

    def __init__(self, path: str, payload: str):
        self.path, self.payload, self.filters = path, payload, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, EqualNullSafe, In, IsNotNull, StringStartsWith)):
                self.filters.append((column, type(f).__name__, f.value if hasattr(f, "value") else None))
            else:
                yield f

    def partitions(self) -> list[Part]:
        fs, path = locate(self.path)
        if fs.get_file_info(f"{path}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{path}/{MANIFEST}", compression=None) as f:
                listed = json.loads(f.read())
        else:
            infos = fs.get_file_info(pafs.FileSelector(path)) if fs.get_file_info(path).type == pafs.FileType.Directory else [fs.get_file_info(path)]
            listed = [[i.base_name, i.size, [0]] for i in infos if i.base_name.endswith((".warc", ".warc.gz"))]
        parts = [Part(name, a, b) for name, size, splits in listed if size for a, b in zip(splits, [*splits[1:], size])]
        return parts or [Part("", 0, 0)]

    def wanted(self, row: dict[str, str | None]) -> bool:
        for column, kind, value in self.filters:
            have = row[column]
            ok = {"EqualTo": have is not None and have == value, "EqualNullSafe": have == value, "IsNotNull": have is not None,
                  "In": have is not None and have in (value or ()), "StringStartsWith": have is not None and have.startswith(value or "")}[kind]
            if not ok:
                return False
        return True

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.string()) for c in HEADERS] + [("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0
        if part.name:
            fs, path = locate(self.path)
            whole = f"{path}/{part.name}" if fs.get_file_info(path).type == pafs.FileType.Directory else path
            with fs.open_input_file(whole) as f:
                f.seek(part.start)
                for record in Members(f, part.end):
                    head = parse_headers(record.head())
                    row = {c: head.get(h) for c, h in HEADERS.items()}
                    if row["payload_digest"]:
                        row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
                    if not self.wanted(row):
                        continue
                    row |= self.body(record, head, row)
                    rows.append(row)
                    held += len(row["payload"] or b"") + 400
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def body(self, record: Record, head: dict[str, str], row: dict[str, str | None]) -> dict[str, object]:
        size, http = int(head.get("content-length", 0)), "application/http" in head.get("content-type", "")
        if self.payload == "skip" and not (http and row["warc_type"] == "revisit"):
            return {"payload_bytes": None, "payload": None}
        block = record.rest(size)
        inner, found, data = block.partition(b"\r\n\r\n") if http else (b"", True, block)
        if row["warc_type"] == "revisit":
            stated = parse_headers(inner).get("content-length")
            return {"payload_bytes": int(stated) if stated else None, "payload": None}
        if not found:
            data = b""
        if self.payload == "verify" and row["payload_digest"]:
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            if digest != row["payload_digest"]:
                raise ValueError(f"payload of {row['record_id']} has digest {digest}, its header says {row['payload_digest']}")
        return {"payload_bytes": len(data), "payload": data if self.payload == "decode" else None}


class WarcSource(DataSource):
    """``spark.read.format("warc")``; see ``WarcReader`` and ``WarcWriter`` for the options."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "decode"))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("level", "4")), self.options.get("date", "2026-01-01T00:00:00Z"))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, payload: str = "decode") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Archive rows of ``pages``: of equal payloads of at least ``least_bytes``, the smallest page_id is kept, the others refer to it.

    Rows with one page_id and one payload are told apart by their place in the input, null ids come
    last; their record ids carry that place. Only the digests that occur more than once take part in the
    join, and their payloads do not.
    """
    rows = pages.select(F.col(page_id).cast("bigint").alias("id"), F.col(url).cast("string").alias("target_uri"),
                        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"), F.monotonically_increasing_id().alias("place"))
    rows = rows.withColumn("digest_hex", F.sha1("payload"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "place")
    first = cut(rows.filter(F.length("payload") >= least_bytes).groupBy("digest_hex").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
                .filter("n > 1").drop("n"))
    name = lambda i, place: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.concat(F.lit("null:"), place.cast("string"))), F.lit(">"))
    joined = rows.join(bounded_broadcast(first, 100_000), "digest_hex", "left")
    other = F.col("first").isNotNull() & (F.col("first.place") != F.col("place")) & (F.length("payload") >= least_bytes)
    return joined.select(name(F.col("id"), F.col("place")).alias("record_id"), "target_uri",
                         F.when(other, name(F.col("first.id"), F.col("first.place"))).alias("refers_to"), "digest_hex",
                         # the writer needs the length of what a revisit leaves out
                         "payload")


def write_pages(pages: DataFrame, path: str | None = None, **columns) -> str:
    """Write ``pages`` as archives below ``path`` (default: a new folder in the shared one); returns the folder."""
    spark = pages.sparkSession
    register(spark)
    path = path or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    with_revisits(pages, **columns).write.format("warc").mode("append").save(path)
    return path


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """Per archived page its id, payload size and digest, type and the page it refers to.

    Responses are read whole and checked against their digests; of revisits only the head is inflated.
    """
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) AS bigint)")
    columns = [number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"),
               number("refers_to").alias("refers_to"), "target_uri"]
    whole = read_warc(spark, path, "verify").filter(F.col("warc_type") == "response")
    again = read_warc(spark, path, "skip").filter(F.col("warc_type") == "revisit")
    return whole.select(*columns).unionByName(again.select(*columns))
