"""Files as rows: decoding, lines of office documents, registry archives, JSON buffers, per-folder metadata.

Everything goes through Spark's ``binaryFile`` or JSON readers, so a folder in any store can be read; formats whose parser
isn't installed here (PDF, images) raise an error that names it.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import cut

#: Encodings in the order in which they are tried.
TEXT_CASCADE = ("utf-8-sig", "utf-8", "cp950", "big5", "latin-1")
MASKING_CASCADE = ("utf-8", "utf-8-sig", "big5", "cp950", "latin-1")
PLAIN_SUFFIXES = (".txt", ".csv", ".tsv", ".md", ".log", ".json", ".yaml", ".yml", ".ini")
LINE_END = re.compile("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")
ARCHIVE_BYTES = 3 << 30


def decode(data: bytes, cascade: tuple[str, ...] = TEXT_CASCADE) -> str:
    """The text by the first encoding that fits, else with replacement marks."""
    for encoding in cascade:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode(cascade[0], "replace")


def decode_strict(data: bytes) -> str:
    """UTF-8, else Big5, else an error: what a line list accepts."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("big5")


def _xml_texts(data: bytes, member: str, paragraph: str, text: str | None) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        root = ElementTree.fromstring(archive.read(member))
    local = lambda e: e.tag.rpartition("}")[2]
    out = []
    for p in root.iter():
        if local(p) in paragraph.split():
            out.append("".join(p.itertext()) if text is None else "".join(t.text or "" for t in p.iter() if local(t) == text))
    return [x for x in out if x.strip()]


def _active_sheet(archive: zipfile.ZipFile, names: list[str]) -> str:
    """The member that holds the sheet on which the workbook was left."""
    first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    if not {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(names):
        return first
    local = lambda e: e.tag.rpartition("}")[2]
    book = list(ElementTree.fromstring(archive.read("xl/workbook.xml")).iter())
    at = next((int(e.get("activeTab", 0)) for e in book if local(e) == "workbookView"), 0)
    links = [next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == "id"), "") for e in book if local(e) == "sheet"]
    targets = {e.get("Id"): e.get("Target", "") for e in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    target = targets.get(links[at], "") if at < len(links) else ""
    member = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return member if member in names else first


def _sheet_cells(data: bytes) -> list[str]:
    """Filled cells of a workbook's active sheet (the first, where none is named), row by row."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = archive.namelist()
        local = lambda e: e.tag.rpartition("}")[2]
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in root if local(si) == "si"]
        sheet = ElementTree.fromstring(archive.read(_active_sheet(archive, names)))
    out = []
    for c in sheet.iter():
        if local(c) != "c":
            continue
        value = "".join(t.text or "" for t in c.iter() if local(t) in ("v", "t"))
        out.append(shared[int(value)] if c.get("t") == "s" and value else value)
    return [x.strip() for x in out if x.strip()]


def file_lines(path: str, data: bytes) -> list[str]:
    """Lines of one file by its suffix."""
    suffix = re.search(r"(\.[a-z0-9]+)?$", path.lower())[0]
    if suffix == ".docx":
        return _xml_texts(data, "word/document.xml", "p", "t")
    if suffix == ".odt":
        return _xml_texts(data, "content.xml", "p h", None)
    if suffix == ".xlsx":
        return _sheet_cells(data)
    if suffix == ".pdf":
        raise ValueError(f"{path}: reading PDF needs a parser that isn't installed")
    parts = LINE_END.split(decode_strict(data))
    return parts[:-1] if parts[-1] == "" else parts


def read_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, pos, line) of all files under a path; a file that can't be read has one row with its error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found, error = file_lines(name, data), None
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    found, error = [None], str(e)[:500]
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(found, pa.string()), pa.array([error] * n, pa.string())], names=["path", "pos", "line", "error"])

    return files.mapInArrow(run, "path string, pos long, line string, error string")


#: Elements of a word-processor file that tell of tracked changes and of comments.
CHANGE_ELEMENTS = {"ins", "del"}
COMMENT_ELEMENTS = {"commentReference", "commentRangeStart"}


def office_findings(data: bytes) -> list[tuple[str, str, str]]:
    """(category, severity, detail) of one docx: authors, tracked changes, comments, macros; a broken file is a finding."""
    out = []
    local = lambda e: e.tag.rpartition("}")[2]
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            names = archive.namelist()
            if "docProps/core.xml" in names:
                found = {local(e): (e.text or "").strip() for e in ElementTree.fromstring(archive.read("docProps/core.xml")).iter()}
                authors = {k: found[k] for k in ("creator", "lastModifiedBy") if found.get(k)}
                if authors:
                    out.append(("metadata-leak", "warn", ", ".join(f"{k}={v}" for k, v in authors.items())))
            if "word/document.xml" in names:
                seen: set[str] = set()
                with archive.open("word/document.xml") as body:
                    for _, element in ElementTree.iterparse(body):
                        seen.add(local(element))
                        element.clear()
                if seen & CHANGE_ELEMENTS:
                    out.append(("track-changes", "warn", ""))
                if seen & COMMENT_ELEMENTS:
                    out.append(("comments", "warn", ""))
            if any(n.startswith("word/vbaProject") for n in names):
                out.append(("macro", "fail", ""))
    except (zipfile.BadZipFile, ElementTree.ParseError, EOFError) as e:
        out.append(("open-fail", "fail", str(e)[:500]))
    return out


def read_findings(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """(path, category, severity, detail) of all word-processor files under a path; files without findings have no row.

    Spark's binary reader passes over files of no bytes, so these have no row either.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = office_findings(data)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), *(pa.array([f[k] for f in found], pa.string()) for k in range(3))], names=["path", "category", "severity", "detail"])

    return files.mapInArrow(run, "path string, category string, severity string, detail string")


def read_texts(spark: SparkSession, path: str, cascade: tuple[str, ...] = TEXT_CASCADE) -> DataFrame:
    """(path, text) of plain files in whatever encoding."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(d, cascade) for d in batch.column(1).to_pylist()], pa.string())], names=["path", "text"])

    return files.mapInArrow(run, "path string, text string")


def archive_csv(data: bytes) -> bytes:
    """The largest CSV of a zip, or the bytes themselves."""
    if not data.startswith(b"PK\x03\x04"):
        return data
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        members = [i for i in archive.infolist() if i.filename.lower().endswith(".csv")]
        if not members:
            raise ValueError("the archive holds no CSV")
        largest = max(members, key=lambda i: i.file_size)
        if largest.file_size > ARCHIVE_BYTES:
            raise ValueError("the archive's CSV is too large")
        return archive.read(largest)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(pos, cells map) of registry files, CSV or zip, UTF-8 or Big5, quoted cells over several lines included.

    A file is one task; exports of that kind are single files of some hundred megabytes.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            for data in batch.column(0).to_pylist():
                raw = archive_csv(data)
                try:
                    text = raw.decode("utf-8-sig")
                except UnicodeDecodeError:
                    text = raw.decode("big5", "replace")
                rows, pos = [], 0
                for row in csv.DictReader(io.StringIO(text)):
                    rows.append([(k.strip(), v) for k, v in row.items() if k is not None and isinstance(v, str)])
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(range(pos, pos + 5000), pa.int64()), pa.array(rows, kind)], names=["pos", "cells"])
                        rows, pos = [], pos + 5000
                yield pa.RecordBatch.from_arrays([pa.array(range(pos, pos + len(rows)), pa.int64()), pa.array(rows, kind)], names=["pos", "cells"])

    return files.mapInArrow(run, "pos long, cells map<string,string>")


def registry_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """Cells of the named headers as columns, beside pos."""
    return rows.select("pos", *[F.element_at("cells", n).alias(n) for n in names])


def read_buffer(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records; what isn't JSON is kept in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def quarantined_buffer(spark: SparkSession, path: str, schema: str, folder: str, stamp: str) -> DataFrame:
    """The records of a buffer that can be read; what can't is kept, line by line with its file, in a folder of that stamp."""
    rows = cut(read_buffer(spark, path, schema).withColumn("_file", F.col("_metadata.file_path")))
    bad = rows.filter("_corrupt IS NOT NULL").select("_file", "_corrupt")
    if not bad.isEmpty():
        bad.write.json(f"{folder.rstrip('/')}/corrupt-{stamp}")
    return rows.filter("_corrupt IS NULL").drop("_corrupt", "_file")


def read_metadata(spark: SparkSession, path: str, schema: str, newest: str = "created_at") -> DataFrame:
    """meta.json of each folder under a path, newest first."""
    return spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "meta.json").option("recursiveFileLookup", "true").json(path).orderBy(F.desc(newest))


def page_spec(spec: str, count: int) -> list[int]:
    """Pages of a spec such as ``1-3,5,7-`` or ``4-2``, in its order, those that exist."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        m = re.fullmatch(r"(\d*)\s*-\s*(\d*)|(\d+)", part)
        if not m or part == "-":
            raise ValueError(f"bad page range: {part}")
        if m[3]:
            first = last = int(m[3])
        else:
            first, last = int(m[1] or 1), int(m[2] or count)
        out += range(first, last + 1) if first <= last else range(first, last - 1, -1)
    return [p for p in out if 1 <= p <= count]


def pages_of(spec: Column, count: Column) -> Column:
    """The same as a column: an array of page numbers."""
    parts = F.transform(F.filter(F.split(spec, ","), lambda p: F.trim(p) != ""), lambda p: F.trim(p))

    def span(p: Column) -> Column:
        low = F.coalesce(F.nullif(F.trim(F.substring_index(p, "-", 1)), F.lit("")).try_cast("int"), F.lit(1))
        high = F.coalesce(F.nullif(F.trim(F.substring_index(p, "-", -1)), F.lit("")).try_cast("int"), count)
        return F.sequence(low, high)

    return F.filter(F.flatten(F.transform(parts, span)), lambda k: (k >= 1) & (k <= count))
