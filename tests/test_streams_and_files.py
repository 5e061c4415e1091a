import io
import zipfile

import pytest

from paperloom.sources import files, sinks
from paperloom.streaming import events


def drain(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


@pytest.fixture
def stream(spark, tmp_path):
    rows = [(k, f"2024-01-01 0{k // 10}:{k % 10}0:00" if k % 10 < 6 else f"2024-01-01 0{k // 10}:59:00", k % 3, "error", 1.0, "{}") for k in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", df.ts.cast("timestamp")).union(df.withColumn("ts", df.ts.cast("timestamp")).limit(3)).coalesce(1).write.parquet(str(tmp_path / "in"))
    return events.read_events(spark, str(tmp_path / "in"))


def test_windows(stream):
    rows = drain(events.buckets(stream), "buckets").collect()
    assert rows and all(r.n >= 10 for r in rows)


def test_once(stream):
    assert drain(events.once(stream), "once").count() == 60


def test_sessions(stream):
    assert drain(events.sessions(stream), "sessions").count() > 0


def test_stream_lockouts(stream):
    attempts = stream.selectExpr("user_id AS key", "ts", "false AS ok")
    assert drain(events.lockouts(attempts, threshold=5, window_s=7200), "lockouts").count() >= 3


def test_forward(stream, spark, tmp_path):
    out = str(tmp_path / "sent")

    def sink(lines):
        with open(out, "a") as f:
            f.writelines(f"{x}\n" for x in lines)

    def broken(lines):
        raise OSError("down")

    from pyspark.sql import functions as F

    line = F.concat_ws(",", "event_id", "event_type")
    events.forward(stream, str(tmp_path / "mark"), {"a": sink, "b": broken}, {"a": line, "b": line}, pause_s=0.01).awaitTermination()
    assert len(open(out).readlines()) == 63
    lost = spark.read.parquet(str(tmp_path / "mark-dead-letters")).collect()
    assert sorted(r.line for r in lost) == sorted(open(out).read().split()) and {(r.destination, r.error) for r in lost} == {("b", "down")}
    events.forward(stream, str(tmp_path / "mark"), {"a": sink}, {"a": line}).awaitTermination()
    assert len(open(out).readlines()) == 63


def test_line_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("一\r\n二\n".encode("big5"))
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>you</w:t></w:r></w:p><w:p/></w:document>')
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>x</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="m"><row><c t="s"><v>0</v></c><c><v>7</v></c><c/></row></worksheet>')
    rows = files.read_lines(spark, str(tmp_path)).orderBy("path", "pos").collect()
    got = {}
    for r in rows:
        got.setdefault(r.path[-5:], []).append(r.line)
    assert got["a.txt"] == ["一", "二"] and got[".docx"] == ["Hello you"] and got[".xlsx"] == ["x", "7"]
    assert [r.error for r in rows if r.path.endswith("pdf")][0]


def test_active_sheet():
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="r"><bookViews><workbookView activeTab="1"/></bookViews><sheets><sheet name="p" r:id="a"/><sheet name="q" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet7.xml"/></Relationships>')
        for k in (1, 7):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="m"><row><c><v>{k}</v></c></row></worksheet>')
    assert files.file_lines("b.xlsx", book.getvalue()) == ["7"]


def test_masking_cascade():
    marked = "\ufeffmark".encode()
    assert files.decode(marked) == "mark" and files.decode(marked, files.MASKING_CASCADE) == "\ufeffmark"
    assert files.decode("壹佰".encode("big5"), files.MASKING_CASCADE) == "壹佰"
    assert files.decode(b"\xff\xfe\x81", files.MASKING_CASCADE) == "ÿþ\x81"


def test_registry_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("small.csv", "a\n1\n")
        z.writestr("big.csv", '統一編號,營業人名稱\n12345678,"two\nlines"\n')
    rows = files.registry_columns(files.read_registry(spark, str(tmp_path)), ["統一編號", "營業人名稱"]).collect()
    assert [tuple(r)[1:] for r in rows] == [("12345678", "two\nlines")]


@pytest.mark.parametrize("kind", ["csv", "json", "xml", "txt", "md"])
def test_exports(spark, tmp_path, kind):
    df = spark.createDataFrame([("=1", 2), ("a|b", None)], "name string, n int")
    sinks.export(df, str(tmp_path / kind), kind)
    text = "".join(p.read_text() for p in (tmp_path / kind).glob("part-*"))
    assert {"csv": "'=1,2", "json": '{"name":"=1","n":2}', "xml": "<name>=1</name>", "txt": "=1 ", "md": "| a\\|b |"}[kind] in text


def test_buffer(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"a": 1}\n{broken\n')
    rows = files.read_buffer(spark, str(tmp_path / "b.json"), "a int").orderBy("a").collect()
    assert [(r.a, bool(r._corrupt)) for r in rows] == [(None, True), (1, False)]


def test_metadata_of_folders(spark, tmp_path):
    for k, (name, at) in enumerate([("a", "2024-01-02"), ("b", "2024-03-01"), ("c", None)]):
        (tmp_path / "jobs" / name).mkdir(parents=True)
        (tmp_path / "jobs" / name / "meta.json").write_text('{\n "id": %d,\n "created_at": %s}' % (k, f'"{at}"' if at else "null"))
        (tmp_path / "jobs" / name / "other.json").write_text("not json")
    rows = files.read_metadata(spark, str(tmp_path / "jobs"), "id long, created_at string").collect()
    assert [(r.id, r.created_at) for r in rows] == [(1, "2024-03-01"), (0, "2024-01-02"), (2, None)]


def test_a_swapped_table_is_whole(spark, tmp_path):
    sinks.swap_table(spark.range(3), "swapped", str(tmp_path), "v1")
    before = spark.table("swapped")
    sinks.swap_table(spark.range(10, 15), "swapped", str(tmp_path), "v2")
    assert before.count() == 3 and [r.id for r in spark.table("swapped").orderBy("id").collect()] == [10, 11, 12, 13, 14]
    with pytest.raises(Exception, match="exist"):
        sinks.swap_table(spark.range(1), "swapped", str(tmp_path), "v2")


def test_list_rows_are_cut_at_the_first_tab(spark):
    lines = spark.createDataFrame([(1, 1, "3\ta\tb"), (1, 0, "=1+1"), (2, 0, "")], "doc_id long, pos long, line string")
    assert [(r.doc_id, r.a, r.b) for r in sinks.list_rows(lines).collect()] == [(1, "'=1+1", ""), (1, "3", "a\tb"), (2, "", "")]


def test_routes(spark):
    from paperloom.operators import receipts

    rows = spark.createDataFrame([("台北", "左營"), ("台北", None), ("", "左營"), (None, None)], "origin string, destination string")
    assert [r.r for r in rows.select(receipts.route(rows).alias("r")).collect()] == ["台北 → 左營", "台北", "左營", ""]


def test_samples_of_a_stream(spark, stream):
    rows = drain(events.samples(stream.select("ts", "event_id", "value"), every="1 hour", late="0 seconds"), "samples").collect()
    assert len(rows) >= 5 and all(r.ts.minute == 0 for r in rows)
    assert {r.event_id for r in rows} <= {9, 19, 29, 39, 49, 59}


def test_unreadable_records_are_put_aside(spark, tmp_path):
    (tmp_path / "buffer").mkdir()
    (tmp_path / "buffer" / "a.json").write_text('{"id": 1}\n{"id": \n{"id": 2}\n')
    (tmp_path / "buffer" / "b.json").write_text("not json\n")
    good = files.quarantined_buffer(spark, str(tmp_path / "buffer"), "id long", str(tmp_path / "aside"), "s1")
    assert sorted(r.id for r in good.collect()) == [1, 2] and good.columns == ["id"]
    kept = spark.read.json(str(tmp_path / "aside" / "corrupt-s1")).collect()
    assert sorted(r._corrupt for r in kept) == ["not json", '{"id": '] and {r._file[-6:] for r in kept} == {"a.json", "b.json"}
