"""WARC archives as a Python data source, and page tables written to them and read back.

Reading plans partitions of whole files (small ones together), takes record-type and header predicates from Spark's
filters, parses a record's headers first, and seeks past payloads that no requested column or predicate needs. Writing
makes one file for each task and roll size; a manifest names the files of finished tasks, so a retried task leaves no
double records.

Null html is an empty payload. Records with equal payloads of at least REVISIT_BYTES become revisits of the one with the
largest page_id; rows repeated with that id are each a response. Rows without page_id have a record without id and revisit
like any other. An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha1

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from paperloom.llm.common import fresh_path, materialise, small_batches

REVISIT_BYTES = 1000
FILE_BYTES = 256 << 20
PARTITION_BYTES = 128 << 20
#: Rows that a broadcast of duplicate digests may have (about 60 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 200_000
MANIFEST = "_files.txt"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, header_digest string, payload_bytes long, payload_sha1 string, payload binary"
#: Columns that the headers alone decide.
HEADER_COLUMNS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "header_digest": "warc-payload-digest"}
ARROW = {"payload_bytes": pa.int64(), "payload": pa.binary()}
BATCH_BYTES = 4 << 20


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; a path without scheme is a local one."""
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def header_safe(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record_bytes(record_type: str, record_id: str | None, uri: str | None, refers_to: str | None, digest: str, payload: bytes) -> bytes:
    """One record; a revisit keeps the HTTP headers, which tell the payload's length, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Record-ID: <{record_id}>"] if record_id is not None else []
    head += [f"WARC-Target-URI: {header_safe(uri)}"] if uri is not None else []
    head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"] if record_type == "revisit" else []
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows of record_type, record_id, target_uri, refers_to, header_digest (hex SHA-1) and payload."""

    def __init__(self, path: str, gzip: bool, file_bytes: int) -> None:
        self.path, self.gzip, self.file_bytes = path, gzip, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, folder = place(self.path)
        where.create_dir(folder, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                columns = [batch.column(c).to_pylist() for c in ("record_type", "record_id", "target_uri", "refers_to", "header_digest", "payload")]
                for row in zip(*columns):
                    if out is None or size >= self.file_bytes:
                        if out:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                        out, size = where.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                    record = record_bytes(*row[:5], row[5] or b"")
                    if self.gzip:  # each record is a member of its own
                        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                        record = pack.compress(record) + pack.flush()
                    out.write(record)
                    size += len(record)
        finally:
            if out:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        where, folder = place(self.path)
        where.create_dir(folder, recursive=True)
        old = manifest(where, folder) or []
        with where.open_output_stream(f"{folder}/{MANIFEST}", compression=None) as out:
            out.write("".join(f"{n}\n" for n in [*old, *(n for m in messages if m for n in m.names)]).encode())


def manifest(where: fs.FileSystem, folder: str) -> list[str] | None:
    if where.get_file_info(f"{folder}/{MANIFEST}").type == fs.FileType.NotFound:
        return None
    with where.open_input_stream(f"{folder}/{MANIFEST}", compression=None) as file:
        return file.read().decode().split()


class Inflated:
    """A gzip file of one member a record, read forward; skipping inflates but keeps nothing."""

    def __init__(self, raw) -> None:
        self.raw, self.member, self.held, self.begun = raw, zlib.decompressobj(31), b"", False

    def more(self) -> bool:
        if self.member.eof:
            rest = self.member.unused_data or self.raw.read(1 << 16)
            if rest:
                self.member = zlib.decompressobj(31)
        else:
            rest = self.raw.read(1 << 16)
        if not rest:
            return False
        self.begun = True
        self.held += self.member.decompress(rest)
        return True

    def read(self, n: int) -> bytes:
        parts, left = [self.held], n - len(self.held)
        while left > 0:
            self.held = b""
            if not self.more():
                raise ValueError(f"truncated archive: a record lacks {left} of {n} bytes")
            parts.append(self.held)
            left -= len(self.held)
        whole = b"".join(parts)
        out, self.held = whole[:n], whole[n:]
        return out

    def skip(self, n: int, strict: bool = True) -> None:
        while n:
            if not self.held and not self.more():
                if strict:
                    raise ValueError(f"truncated archive: a record lacks {n} bytes")
                return
            k = min(n, len(self.held))
            self.held, n = self.held[k:], n - k

    def head(self) -> bytes | None:
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.held.strip() or not self.member.eof and self.begun:
                    raise ValueError("truncated archive: a record's headers don't end")
                return None
        out, self.held = self.held[:end], self.held[end + 4 :]
        return out


class Plain:
    """An uncompressed file; skipping seeks."""

    def __init__(self, raw, size: int) -> None:
        self.raw, self.size, self.at, self.base, self.held = raw, size, 0, 0, b""

    def fill(self, n: int) -> None:
        """Hold n bytes from ``at`` on, where there are as many."""
        if self.at - self.base + n > len(self.held):
            self.raw.seek(self.at)
            self.base, self.held = self.at, self.raw.read(max(n, 1 << 16))

    def read(self, n: int) -> bytes:
        self.fill(n)
        begin = self.at - self.base
        out = self.held[begin : begin + n]
        if len(out) < n:
            raise ValueError(f"truncated archive: a record lacks {n - len(out)} of {n} bytes")
        self.at += n
        return out

    def skip(self, n: int, strict: bool = True) -> None:
        if strict and self.at + n > self.size:
            raise ValueError(f"truncated archive: a record lacks {self.at + n - self.size} bytes")
        self.at = min(self.size, self.at + n)

    def head(self) -> bytes | None:
        want = 1 << 10
        while True:
            self.fill(min(want, self.size - self.at))
            begin = self.at - self.base
            if (end := self.held.find(b"\r\n\r\n", begin)) >= 0:
                self.at += end + 4 - begin
                return self.held[begin:end]
            if want >= self.size - self.at:
                if self.held[begin:].strip():
                    raise ValueError("truncated archive: a record's headers don't end")
                return None
            want *= 4


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def header_value(column: str, found: dict[str, str]) -> str | None:
    value = found.get(HEADER_COLUMNS[column])
    if value is None:
        return None
    if column in ("record_id", "refers_to"):
        return value.removeprefix("<").removesuffix(">")
    if column == "header_digest":
        kind, _, digest = value.partition(":")
        return base64.b32decode(digest).hex() if kind == "sha1" and len(digest) == 32 else digest.lower()
    return value


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], wanted: dict[str, list]) -> None:
        self.path, self.columns, self.wanted = path, columns, wanted

    def pushFilters(self, filters: list) -> Iterator:
        """Take equalities, memberships and not-null tests on what headers decide; give back the rest."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column not in HEADER_COLUMNS:
                yield f
            elif isinstance(f, EqualTo):
                self.narrow(column, [f.value])
            elif isinstance(f, In):
                self.narrow(column, list(f.value))
            elif isinstance(f, IsNotNull):
                self.wanted.setdefault(column, None)
            else:
                yield f

    def narrow(self, column: str, values: list) -> None:
        old = self.wanted.get(column)
        self.wanted[column] = [v for v in values if v is not None and (old is None or v in old)]

    def partitions(self) -> list[Files]:
        where, folder = place(self.path)
        named = manifest(where, folder)
        found = [i for i in where.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)) if i.is_file and i.path.endswith((".warc", ".warc.gz"))]
        if named is not None:
            found = [i for i in found if posixpath.basename(i.path) in set(named)]
        out: list[Files] = []
        size = 0
        for info in sorted(found, key=lambda i: i.path):
            if not out or size + info.size > PARTITION_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(info.path)
            size += info.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        where, _ = place(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with where.open_input_file(path) as raw:
                source = Inflated(raw) if path.endswith(".gz") else Plain(raw, raw.size())
                for row in self.records(source):
                    rows.append(row)
                    held += 200 + sum(len(x) for x in row if isinstance(x, bytes))
                    if held >= BATCH_BYTES:
                        yield self.batch(rows)
                        rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, ARROW.get(n, pa.string())) for n, c in zip(self.columns, zip(*rows))], names=self.columns)

    def records(self, source) -> Iterator[tuple]:
        body_wanted = bool({"payload_sha1", "payload"} & set(self.columns))
        http_wanted = body_wanted or "payload_bytes" in self.columns
        while (head := source.head()) is not None:
            found = headers(head)
            length = int(found.get("content-length", 0))
            named = {c: header_value(c, found) for c in HEADER_COLUMNS}
            if any(named[c] is None or (values is not None and named[c] not in values) for c, values in self.wanted.items()):
                source.skip(length)
                source.skip(4, strict=False)
                continue
            payload, size = None, None
            if http_wanted and "application/http" in found.get("content-type", ""):
                http = source.head() or b""
                left = length - len(http) - 4
                size = int(next((v for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"), left))
                if body_wanted and found.get("warc-type") != "revisit":
                    payload = source.read(left)
                    size = len(payload)
                else:
                    source.skip(left)
            elif body_wanted:
                payload = source.read(length)
                size = len(payload)
            else:
                source.skip(length)
                size = length if http_wanted else None
            source.skip(4, strict=False)
            more = {"payload_bytes": size, "payload": payload, "payload_sha1": sha1(payload).hexdigest() if payload is not None and "payload_sha1" in self.columns else None}
            yield tuple(named[c] if c in named else more[c] for c in self.columns)


class WarcSource(DataSource):
    """``spark.read.format("warc")``; options: path, type (a record type), and for writing compression, fileBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        kind = self.options.get("type")
        return WarcReader(self.options["path"], schema.fieldNames(), {"record_type": [kind]} if kind else {})

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("compression", "none") == "gzip", int(self.options.get("filebytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, columns: str | None = None) -> DataFrame:
    """Records of all archives under a path. ``columns`` (DDL) names the ones to fill: leave payloads out to skip them."""
    register(spark)
    reader = spark.read.format("warc")
    return (reader.schema(columns) if columns else reader).load(path)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The records of a page table, equal large payloads as revisits."""
    payload = F.encode(F.coalesce(pages[html_col].cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("target_uri"), payload.alias("payload")).withColumn("header_digest", F.sha1("payload"))
    large = F.length("payload") >= REVISIT_BYTES
    same = rows.filter(large).groupBy("header_digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 AND first_id IS NOT NULL")
    same = materialise(same.drop("n"), "warc-digests")
    if same.count() <= BROADCAST_ROWS:
        same = F.broadcast(same)
    joined = rows.join(same, "header_digest", "left")
    urn = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    revisit = large & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        "target_uri",
        F.when(revisit, urn(F.col("first_id"))).alias("refers_to"),
        "header_digest",
        "payload",
    )


def round_trip(pages: DataFrame, path: str | None = None, compression: str = "none") -> DataFrame:
    """Write the pages as archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    small_batches(spark)
    register(spark)
    path = path or fresh_path(spark, "warc")
    page_records(pages).write.format("warc").mode("append").option("compression", compression).save(path)
    back = read(spark, path, "record_type string, record_id string, refers_to string, header_digest string, payload_bytes long, payload_sha1 string")
    page = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    return back.select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        # a response's own payload is hashed again; a revisit has only its header's word
        F.coalesce("payload_sha1", "header_digest").alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
