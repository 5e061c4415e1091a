import hashlib
import random
import re
from collections import Counter
from itertools import permutations
from zlib import crc32

import pytest

from paperloom.llm import filter_audit, spelling, substrings

ROWS = "doc_id long, text string, n long, source string"


# ---- repeated passages


def brute_repeats(docs):
    words = [(t or "").encode().split() for _, t in docs]
    seen = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    out = []
    for (i, _), w in zip(docs, words):
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repeating(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(200)] + ["é", "Ünï", "w1"]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (34, 35, 36, 50, 80, 300)]
    texts = []
    for _ in range(120):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 40, 150]))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            own = list(rng.choice(passages))
            if rng.random() < 0.5:
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            text += own + [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 30]))]
        texts.append(" ".join(text))
    texts += [texts[3], texts[3], texts[7] + "  ", None, None, "", " \n ", "one", " ".join(["la"] * 34), " ".join(["le"] * 35), " ".join(["li"] * 36), " ".join(["ba", "be"] * 60), "\t".join(["lo"] * 90)]
    return [(None if k == 9 else k // 2 if k < 8 else k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("crowd, piece", [(1000, 1 << 19), (2, 1 << 19), (3, 60)])
def test_repeats_by_brute_force(spark, monkeypatch, crowd, piece):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    docs = repeating(crowd)
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], ROWS).repartition(3)
    if piece < 1000:  # workers read the bound from their own module, so the pieces themselves are tried here
        monkeypatch.setattr(substrings, "PIECE_WORDS", piece)
        words = [w for _, w in docs if w]
        got = [(n, at, len(own)) for own, sizes, n, at in substrings.pieces([w.encode() for w in words])]
        windows = sum(max(0, s - 34) for _, sizes, _, _ in substrings.pieces([w.encode() for w in words]) for s in sizes)
        assert got and windows == sum(max(0, len(w.split()) - 34) for w in words)
        return
    got = substrings.digest(substrings.remove_repeats(df))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_repeats(docs)


def test_repeats_of_an_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], ROWS)).count() == 0


def test_a_row_that_repeats_whole(spark):
    text = " ".join(f"x{k}" for k in range(50))
    df = spark.createDataFrame([(4, text, 1, "a")] * 3 + [(5, "y " + text, 1, "b"), (6, text[:40], 1, "b")], ROWS)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(df).collect())
    assert got == [(4, 50, 50, "")] * 3 + [(5, 51, 50, "y"), (6, len(text[:40].split()), 0, text[:40])]


# ---- spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(docs, every=97):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out, form = [], {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
        out.append([w, n, len(near), form[w], words.get(form[w])])
    for row in out:
        root = row[0]
        while form[root]:
            root = form[root]
        row.append(root)
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("part", [2000, 5])
def test_variants_by_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(spelling, "PART_WORDS", part)
    rng = random.Random(part)
    base = ["".join(rng.choice("etaoinÉéàÿ×z") for _ in range(rng.choice([4, 5, 6, 6, 9, 14]))) for _ in range(25)]
    docs = []
    for k in range(300):
        text = []
        for _ in range(rng.choice([0, 20, 60])):
            w = base[min(int(rng.expovariate(0.2)), 24)]
            if rng.random() < 0.25:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("ae") + w[at:], w[:at] + rng.choice("éT") + w[at + 1 :]])
            text.append(w)
        docs.append((None if k == 3 else k, rng.choice([" ", "-", "1"]).join(text)))
    docs += [(301, None), (302, ""), (303, "a" * 5000 + " " + "a" * 4999), (5, docs[5][1])] + [(310 + k, "a" * 5000 + " " + "a" * 4999) for k in range(3)]
    docs += [(400 + k, "chained " * 20 + "chainedx " * 8 + "chainedxy " * 3) for k in range(2)]
    got = spelling.variants(spark.createDataFrame([(*r, 1, "x") for r in docs], ROWS).repartition(3))
    columns = ["word", "n", "n_near", "form", "form_n", "root"]
    rows = sorted((tuple(r) for r in got.select(columns).collect()), key=repr)
    assert rows == brute_variants(docs)
    assert sum(r[2] > 0 for r in rows) > 50 and any(r[3] and r[5] != r[3] for r in rows)


def test_variants_of_an_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], ROWS)).count() == 0


# ---- filters


def brute_audit(docs, labels):
    fails, parts = [], []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        duplicate = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        failed = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text), duplicate]
        fails.append({f for f, x in zip("ABCDE", failed) if x})
        parts.append(source or "")
    good, toxic = ({i for i, *values in labels if values[k] == 1} for k in (0, 1))
    out = {}
    for order in permutations("ABCDE"):
        left = list(range(len(docs)))
        for step, f in enumerate(order, 1):
            gone = [k for k in left if f in fails[k]]
            left = [k for k in left if f not in fails[k]]
            for part in set(parts):
                own = [k for k in gone if parts[k] == part]
                failing = [k for k in range(len(docs)) if parts[k] == part and f in fails[k]]
                out[part, "".join(order), step] = [sum(parts[k] == part for k in left), len(own), len(failing) - len(own), sum(fails[k] == {f} for k in failing), sum(docs[k][0] in good for k in own), sum(docs[k][0] in toxic for k in own)]
    for (part, order, step), row in out.items():
        row.append(sum(out[part, o, o.index(order[step - 1]) + 1][1] for o in map("".join, permutations("ABCDE"))))
    return sorted((*k, *v) for k, v in out.items())


@pytest.mark.parametrize("ranges", [1, 7])
def test_audit_by_brute_force(spark, ranges):
    rng = random.Random(ranges)
    words = [f"w{k}" for k in range(120)] + ["Abc", "#", "DEF", "é"]
    texts = [" ".join(rng.choice(words[: rng.choice([20, 124])]) for _ in range(rng.choice([3, 49, 50, 80]))) for _ in range(25)] + ["", None, "ÀÉ #", "x" * 3000]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["a", "b", None, ""])) for _ in range(90)]
    docs += [(k, "many copies of one text", "a") for k in range(100, 180)] + [(100, "many copies of one text", "b")] * 30
    labels = [(k % 70, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(100)] + [(None, 1, 1)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, mask int")
        got = filter_audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        assert sorted(tuple(r) for r in got.select(names).collect()) == brute_audit(docs, labels)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_audit_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
