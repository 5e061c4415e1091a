import random
import math
import gzip
import hashlib

from collections import Counter

import pytest
from pyspark.sql import functions as F

from paperloom.llm import chat, url_filter, warc


def test_rules_and_model(spark):
    rows = [(k, f"https://good{k % 7}.net/de/{k}") for k in range(60)] + [(100 + k, f"http://BAD{k % 5}.com/en/{k}?casino") for k in range(60)]
    rows += [(500, "https://a.example.com/en/77"), (501, "https://example.net/de/8"), (502, "https://notexample.com/en/7"), (503, None), (504, "no scheme"), (505, ""), (506, "https://good1.org/de/5"), (507, "http://bad1.info/en/5?casino"), (508, "http://h" + "x" * 5000), (508, "http://h" + "x" * 5000), (509, "ftp://Éa.Org/es/")]
    df = spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, verdict string")
    got = {}
    for r in url_filter.judge(df).collect():
        got.setdefault(r.page_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows) and len(got[508]) == 2
    one = {k: v[0] for k, v in got.items()}
    assert (one[500].rule, one[500].verdict) == ("example.com/en/7", "allow")
    assert (one[501].rule, one[501].verdict) == ("example.net/de/8", "block")
    assert (one[502].rule, one[502].verdict) == ("com/en/", "block")
    assert (one[509].host, one[509].rule) == ("Éa.org", "org/es/")
    assert [(one[k].host, one[k].path) for k in (503, 504, 505)] == [("", "")] * 3
    assert (one[506].verdict, one[507].verdict) == ("allow", "block")


def test_no_labelled_urls(spark):
    df = spark.createDataFrame([(1, "http://x.dev/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in url_filter.judge(df).collect()} == {"allow"}
    assert url_filter.judge(df.limit(0)).count() == 0


def blended(count, context, kinds, shorter):
    return (count + kinds * shorter) / (context + kinds) if context else shorter


def plain_model(urls):
    """P(s | ab) of every cell by a plain recount of one class's folded urls."""
    size = url_filter.ALPHABET
    three, two, ones = Counter(), Counter(), Counter()
    for u in urls:
        codes = [url_filter.SYMBOLS.index(c) for c in u]
        for a, b, s in zip(codes, codes[1:], codes[2:]):
            three[a, b, s] += 1
            two[b, s] += 1
            ones[s] += 1
    total, kinds = sum(ones.values()), len(ones)
    none = [(ones[s] + kinds / size + 1 / size) / (total + kinds + 1) for s in range(size)]
    after_b = {b: [two[b, s] for s in range(size)] for b in range(size)}
    one = {b: [blended(n, sum(row), sum(x > 0 for x in row), none[s]) for s, n in enumerate(row)] for b, row in after_b.items()}
    out = {}
    for a in range(size):
        for b in range(size):
            row = [three[a, b, s] for s in range(size)]
            out[a, b] = [blended(n, sum(row), sum(x > 0 for x in row), one[b][s]) for s, n in enumerate(row)]
    return out


def test_ratios_are_those_of_two_models_whose_probabilities_sum_to_one(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["allow", "block"]), "".join(rng.choice("abc./-09~") for _ in range(rng.randrange(25)))) for _ in range(60)]
    urls = spark.createDataFrame(rows, "verdict string, u string").select("verdict", url_filter.folded(F.col("u")).alias("folded"))
    both = [plain_model([r.folded for r in urls.collect() if r.verdict == kind]) for kind in ("allow", "block")]
    for own in both:
        assert all(sum(p) == pytest.approx(1) for p in own.values())
    size = url_filter.ALPHABET
    ratios = {r.cell: r.ratio for r in url_filter.model(urls).collect()}
    assert len(ratios) == size**3
    for (a, b), p in both[0].items():
        for s in range(size):
            assert ratios[(a * size + b) * size + s] == pytest.approx(math.log(p[s] / both[1][a, b][s]), abs=1e-9)


TURNS = [(1, 0, "user", "hi & <b>"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", None), (1, 3, "assistant", "&lt;|end|> 日本"), (2, 0, None, ""), (None, 5, "assistant", "<|turn|>x"), (3, None, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (4, 0, "user", "x" * 100_000)]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*t, "f") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_turns(df, "conv_id", "turn", "role", chat.text_part(F.col("text")))
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for conv in (1, 2, None, 3, 4):
        turns = sorted([((t[1] if t[1] is not None else -1), t[2] or "", t[3] or "") for t in TURNS if t[0] == conv])
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        learned = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(learned))
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    for r in formatted.collect():
        assert r.formatted.count(chat.TURN) == r.formatted.count(chat.END) == len(r["mask"])
        assert "[INST]" not in r.formatted and "</s>" not in r.formatted
    assert chat.read_back(chat.format_turns(df.limit(0), "conv_id", "turn", "role", chat.text_part(F.col("text")))).count() == 0


def test_typed_parts(spark):
    parts = [("text", "see ", None, None), ("image", None, "s3://a.png", None), ("text", "<|image|>", None, None), ("audio", None, "b.wav", 2.5), ("document", None, None, 3.0), ("odd", "t", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_turns(df, "conv_id", "turn", "role", F.col("parts")).first()
    assert "see <|image:1|>&lt;|image|><|audio:2|><|document:3|>t" in r.formatted and r.n_tokens_attached == 576 + 63 + 3072
    assert [(a.turn, a.number, a.type, a.ref, a.tokens, a.place) for a in r.attachments] == [(1, 1, "image", "s3://a.png", 576, 1), (1, 2, "audio", "b.wav", 63, 3), (1, 3, "document", None, 3072, 4)]


BIG = "é<p>" * 400
PAGES = [(1, "http://a/1", BIG), (2, "http://a/2\r\nX: y", BIG), (3, None, "small"), (4, "http://a/4", "small"), (5, "http://a/5", None), (6, "http://a/6", BIG + "x"), (7, "http://a/7", BIG), (7, "http://a/7", BIG), (None, "http://n", BIG), (8, "u", "WARC/1.1\r\n\r\n" * 200)]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_round_trip(spark, tmp_path, compression):
    df = spark.createDataFrame([(*p, "c") for p in PAGES], "page_id long, url string, html string, record_type string").repartition(3)
    got = sorted((tuple(r) for r in warc.round_trip(df, str(tmp_path / "w"), compression).collect()), key=repr)
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        first = max(j for j, _, h in PAGES if (h or "") == (html or "") and j is not None)
        revisit = len(raw) >= 1000 and i != first
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=repr)


def test_warc_reads_headers_first(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.register(spark)
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.page_records(df).write.format("warc").mode("append").option("fileBytes", "3000").save(path)
    assert len(list((tmp_path / "w").glob("*.warc"))) > 2
    (tmp_path / "w" / "left-by-a-failed-task.warc").write_bytes(b"WARC/1.1\r\nbroken")
    records = warc.read(spark, path)
    assert records.count() == len(PAGES)
    assert records.filter("record_type = 'revisit'").count() == 3
    assert records.filter("record_id = 'urn:page:4'").first().payload == b"small"
    assert bytes(records.filter("target_uri IS NULL").first().payload) == b"small"
    narrow = warc.read(spark, path, "record_id string, payload_bytes long")
    assert {r.record_id: r.payload_bytes for r in narrow.collect()}["urn:page:1"] == len(BIG.encode())
    reader = warc.WarcReader(path, ["record_type"], {})
    assert not list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit")])) and reader.wanted == {"record_type": ["revisit"]}
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3


def test_empty_archive(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none, str(tmp_path / "w")).count() == 0


def test_two_attachments_of_one_type_and_odd_units(spark):
    parts = [("image", None, "a", float("nan")), ("image", None, "b", -3.0), ("image", None, "c", 1.5)]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"c long, t long, r string, parts array<{chat.PART}>")
    r = chat.format_turns(df, "c", "t", "r", F.col("parts")).first()
    assert "<|image:1|><|image:2|><|image:3|>" in r.formatted
    assert [a.tokens for a in r.attachments] == [576, 0, 864] and r.n_tokens_attached == 1440


@pytest.mark.parametrize("name", ["a.warc", "a.warc.gz"])
def test_truncated_archives_are_errors(tmp_path, name):
    body = b"HTTP/1.1 200 OK\r\n\r\n" + bytes(range(256)) * 40
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    whole = gzip.compress(record) + gzip.compress(record) if name.endswith("gz") else record + record
    columns = ["record_type", "payload_bytes", "payload"]
    (tmp_path / name).write_bytes(whole)
    read = lambda: [r for b in warc.WarcReader(str(tmp_path), columns, {}).read(warc.Files([str(tmp_path / name)])) for r in b.to_pylist()]
    assert [r["payload_bytes"] for r in read()] == [256 * 40] * 2
    for lost in (30, len(whole) // 4, len(whole) // 2 - 20):
        (tmp_path / name).write_bytes(whole[:-lost])
        with pytest.raises(ValueError):
            read()
        with pytest.raises(ValueError):
            list(warc.WarcReader(str(tmp_path), ["record_type"], {}).read(warc.Files([str(tmp_path / name)])))
