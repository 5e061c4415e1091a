"""Paragraph alignment against a plain re-statement of the rounds, and findings of word-processor files."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import alignment, layout
from paperloom.sources import files


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_common_length_against_the_table():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc 為", k=rng.randrange(0, 90))) for _ in range(2))
        assert alignment.common_length(a, b) == lcs(a, b)
    assert alignment.ratio("", "") == 1.0 and alignment.ratio("a", "") == 0.0


def test_token_sets():
    assert alignment.token_set_ratio("b a", "a b c") == 1.0
    assert alignment.token_set_ratio("a", "b") == 0.0
    assert alignment.partial_ratio("abc", "xxabcxx") == 1.0 and alignment.partial_ratio("", "abc") == 0.0


def test_rounds(spark):
    left = [(1, 0, "Same line"), (1, 1, "Same line"), (1, 2, "the quick brown fox jumps over"), (1, 3, "first half second half"), (1, 4, "qqqq"), (1, 5, None), (1, 6, " ​ "), (None, 0, "lost")]
    right = [(1, 0, "Same  line"), (1, 1, "the quick brown fox jumped over"), (1, 2, "first half"), (1, 3, "second half"), (1, 4, "zzzz"), (1, 5, "yyyy"), (2, 0, "Same line")]
    schema = "doc_id long, pos int, text string"
    found = alignment.align_paragraphs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()
    got = {r.left_pos: (r.doc_id, r.right_pos, r.method, round(r.confidence, 3)) for r in found}
    assert len(found) == len(got)
    assert got[0] == (1, [0], "equal", 1.0)
    assert got[2][1:3] == ([1], "alike") and got[2][3] > 0.85
    # All words of a half stand in the whole, so the second round takes the first half alone.
    assert got[3] == (1, [2], "alike", 1.0)
    assert {k: v[2] for k, v in got.items() if k in (1, 4)} == {1: "place", 4: "place"}
    assert got[1][1] == [3] and got[4][1] == [4] and got[4][3] == 0.0


def test_one_against_several():
    found = alignment.match_rest([(0, "alphabetagamma")], [(5, "alpha"), (6, "beta"), (7, "gamma"), (8, "zz")])
    assert found == [(0, [5, 6, 7], "joined", 1.0)]


def test_no_side_is_used_twice():
    rng = random.Random(3)
    words = "red blue green black white grey".split()
    for _ in range(60):
        sides = [[(k, " ".join(rng.choices(words, k=rng.randrange(1, 6)))) for k in range(rng.randrange(0, 7))] for _ in range(2)]
        found = alignment.match_rest(*sides)
        used = [p for f in found for p in f[1]]
        assert len(used) == len(set(used)) and len({f[0] for f in found}) == len(found)
        assert all(f[3] >= 0.85 or f[2] == "place" and f[3] <= 0.5 for f in found)


def docx(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("_bin", ".bin"), data)
    return out.getvalue()


def test_office_findings(spark, tmp_path):
    w = 'xmlns:w="w"'
    core = '<c xmlns:dc="d" xmlns:cp="p"><dc:creator> Ann </dc:creator><cp:lastModifiedBy></cp:lastModifiedBy></c>'
    (tmp_path / "a.docx").write_bytes(docx(docProps__core_xml=core, word__document_xml=f'<w:d {w}><w:ins w:id="1"/><w:commentReference/></w:d>', word__vbaProject_bin="x"))
    (tmp_path / "b.docx").write_bytes(docx(word__document_xml=f"<w:d {w}><w:insideH/></w:d>"))
    (tmp_path / "c.docx").write_bytes(b"no archive")
    (tmp_path / "d.docx").write_bytes(b"")
    (tmp_path / "e.txt").write_text("left out")
    got = sorted((r.path.rpartition("/")[2], r.category, r.severity) for r in files.read_findings(spark, str(tmp_path)).collect())
    assert got == [("a.docx", "comments", "warn"), ("a.docx", "macro", "fail"), ("a.docx", "metadata-leak", "warn"), ("a.docx", "track-changes", "warn"), ("c.docx", "open-fail", "fail")]
    assert files.office_findings(b"")[0][0] == "open-fail"
    assert files.read_findings(spark, str(tmp_path)).filter("category = 'metadata-leak'").first().detail == "creator=Ann"


def test_script_language(spark):
    rows = [("これは日本語の文です",), ("這是一個測試,不為別的",), ("这会儿时间还早么",), ("plain words",), ("",), (None,)]
    found = spark.createDataFrame(rows, "text string").select(T.script_language(F.col("text")).alias("x")).collect()
    assert [r.x for r in found] == ["ja", "zh-Hant", "zh-Hans", "en", "unknown", "unknown"]


def test_row_tables(spark):
    cells = [(1, 0, 0.0, 50.0), (1, 0, 100.0, 150.0), (1, 1, 5.0, 55.0), (1, 1, 110.0, 160.0), (1, 2, 0.0, 400.0), (1, 3, 0.0, 20.0), (1, 3, 300.0, 320.0), (1, 4, 0.0, 50.0), (1, 4, 60.0, 90.0), (1, 5, None, 3.0)]
    found = layout.row_tables(spark.createDataFrame(cells, "page int, row int, x0 double, x1 double"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, 1, 2, 2), (1, 3, 3, 1, 2)]


def recovered_by_hand(lines, known):
    out = []
    for doc in sorted({r[0] for r in lines}):
        have, total = ["".join(t.split()) for d, t in known if d == doc], 0
        present = lambda t: any("".join(t.split()) in h for h in have)
        for page in sorted({r[1] for r in lines if r[0] == doc}):
            mine = sorted((y, t.strip(), h) for d, p, y, h, t in lines if (d, p) == (doc, page) and t.strip())
            if sum(not present(t) for _, t, _ in mine) * 2 >= len(mine):
                continue
            n = 0
            for y, t, h in mine:
                if n < 5 and total < 20 and len(t) <= 100 and not present(t) and (y / h < 0.15 or y / h > 0.6) and set(t) - set("_ "):
                    have.append("".join(t.split()))
                    out.append((doc, page, y, t))
                    n, total = n + 1, total + 1
    return out


def test_recovered_lines(spark):
    rng = random.Random(5)
    words = ["ab", "abc", "b c", "cab", "dd", "____", "x" * 101, "year", "cabdd", " pad "]
    lines = [(d, p, 10.0 * k, 200.0, " ".join(rng.choices(words, k=rng.randrange(1, 4)))) for d in range(6) for p in range(12) for k in range(20)]
    known = [(d, t) for d, _, _, _, t in lines if rng.random() < 0.3]
    frames = spark.createDataFrame(lines, "doc_id int, page int, y double, height double, text string"), spark.createDataFrame(known, "doc_id int, text string")
    found = sorted(tuple(r) for r in alignment.recovered_lines(*frames).collect())
    assert found and found == sorted(recovered_by_hand(lines, known))


def test_recovered_lines_of_odd_rows(spark):
    schema = "doc_id int, page int, y double, height double, text string"
    known = spark.createDataFrame([(1, "one two"), (1, None)], "doc_id int, text string")
    lines = spark.createDataFrame([(1, 0, 1.0, 100.0, "one"), (1, 0, 2.0, 100.0, "two"), (1, 0, 3.0, 100.0, "three"), (1, 0, 4.0, None, "four"), (1, 0, None, 100.0, "five"), (1, 0, 5.0, 100.0, None), (None, 0, 5.0, 100.0, "six"), (1, 0, 6.0, 100.0, "onet"), (1, 0, 7.0, 0.0, "wo")], schema)
    assert [tuple(r) for r in alignment.recovered_lines(lines, known).collect()] == [(1, 0, 3.0, "three")]
    assert alignment.recovered_lines(lines.limit(0), known).count() == 0


def test_bounds_never_hide_a_likeness():
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "be", "ta", "alpine"]
    for _ in range(400):
        a, b = (" ".join(rng.choices(words, k=rng.randrange(1, 7))) for _ in "ab")
        for f in (alignment.ratio, alignment.token_set_ratio):
            whole, cut_off = f(a, b), f(a, b, 0.85)
            assert cut_off == whole if whole >= 0.85 else cut_off < 0.85, (f.__name__, a, b)
