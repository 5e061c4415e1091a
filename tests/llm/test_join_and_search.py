import random
from itertools import combinations

import numpy as np
import pytest

from paperloom.llm import jaccard, topk
from pyspark.sql import functions as F


def brute_components(docs):
    sets = {}
    for k, (i, t) in enumerate(docs):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[k] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(docs)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(docs))


def planted(seed, n_groups=40):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    out = []
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 30, 90, 200]))]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy) + (" " + passage if rng.random() < 0.3 else ""))
    out += ["", None, "   ", "one", "ONE", "one two three four", "a b c d e", "A  b\tc\nd e"]
    rng.shuffle(out)
    return [(k * 3 + 1, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_by_brute_force(spark, seed):
    docs = planted(seed)
    df = spark.createDataFrame([(*r, 5) for r in docs], "doc_id long, text string, component_id int").repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_documents(df).collect())
    assert got == brute_components(docs)
    if seed == 1:
        kept = jaccard.keep_one(df)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in got})


def test_odd_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "x y z u v w"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_documents(df).collect()), key=repr)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (None, 2, None), (7, 0, 7)], key=repr)
    assert sorted(r.doc_id or -1 for r in jaccard.keep_one(df).collect()) == [-1, 5, 7]
    assert jaccard.join_documents(df.limit(0)).count() == 0
    assert jaccard.keep_one(df.limit(0)).count() == 0


def test_one_id_with_two_texts_keeps_both(spark):
    rows = [(1, "a b c d e f g"), (1, "z y x w v u t"), (1, "z y x w v u t"), (2, "z y x w v u t"), (None, "a b c d e f g"), (None, "k l m n o p q"), (None, "k l m n o p q"), (8, ""), (8, ""), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("map", F.create_map(F.lit("k"), F.lit("v"))).withColumn("mark", F.lit(3)).repartition(4)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted([(1, "a b c d e f g"), (1, "z y x w v u t"), (None, "k l m n o p q"), (8, ""), (8, ""), (9, None)], key=repr)
    same = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_documents(df).collect()}
    assert same == {(1, 3, 1), (2, 3, 1), (None, 3, 1), (None, 3, None), (8, 0, 8), (9, 0, 9)}


def test_chain_of_stars(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100, 101), (103, 102), (102, 101)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(1, 41)) and {got[k] for k in (101, 102, 103)} == {100}


def fits(a, b):
    return a[0] == b[0] and a[1] != b[1] and a[2] != b[2] and 3 * a[3] <= b[4] and 3 * b[3] <= a[4]


@pytest.mark.parametrize("block,pair_slice", [(2, 7), (32, 200_000), (4, 50)])
def test_bucket_pairs_by_brute_force(monkeypatch, block, pair_slice):
    monkeypatch.setattr(jaccard, "PAIR_SLICE", pair_slice)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(block)
    n = 600
    token, node = rng.integers(0, 12, n).astype(np.uint64), rng.integers(0, 90, n)
    comp = np.array([k // 3 for k in range(90)])
    size = np.array([20 + 3 * (k % 9) for k in range(90)])[node]
    reach = 4 * size - 7 * rng.integers(0, 4, n)
    got = set()
    for a, b in jaccard.pairs_in_bucket(token, node, comp[node], size.astype(np.int32), reach.astype(np.int32)):
        assert len(a) <= pair_slice * block
        got |= set(zip(a.tolist(), b.tolist()))
    boxes = {}
    for t, h, s, r in zip(token.tolist(), node.tolist(), size.tolist(), reach.tolist()):
        _, _, _, low, high = boxes.get((t, h), (t, h, 0, s, r))
        boxes[t, h] = (t, h, int(comp[h]), min(low, s), max(high, r))
    assert got == {tuple(sorted((x[1], y[1]))) for x, y in combinations(boxes.values(), 2) if fits(x, y)}


@pytest.mark.parametrize("case", ["too far back", "no larger set reaches back"])
def test_lists_in_which_nothing_fits_are_skipped(monkeypatch, case):
    blocks = []
    before = jaccard.Blocks._down

    def counted(self, level, i, first, end, need):
        blocks.append(int((-(-end // jaccard.BLOCK**level) - first // jaccard.BLOCK**level).sum()))
        yield from before(self, level, i, first, end, need)

    monkeypatch.setattr(jaccard.Blocks, "_down", counted)

    def looked_at(n):
        k = np.arange(n)
        if case == "too far back":
            size, comp = 100 + k % 30, k
            reach = 4 * size - 7 * 30
        else:  # the small sets are one component and reach the large ones, which are hit too far back
            size, comp = np.where(k % 2, 130, 100), np.where(k % 2, k, 0)
            reach = np.where(k % 2, 4 * 130 - 7 * 33, 400)
        blocks.clear()
        assert not list(jaccard.pairs_in_bucket(np.zeros(n, np.uint64), k, comp, size.astype(np.int32), reach.astype(np.int32)))
        return sum(blocks)

    assert looked_at(16_000) <= 16_000 * jaccard.BLOCK


def test_thue_morse_words_are_told_apart(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    assert jaccard.shingles(word.encode())[0] != jaccard.shingles(other.encode())[0]
    df = spark.createDataFrame([(1, word), (2, other), (3, word[:16]), (4, other[:16])], "doc_id long, text string")
    assert {r.component_id for r in jaccard.join_documents(df).collect()} == {1, 2, 3, 4}


def test_word_hashes_depend_on_each_byte():
    words = [b"x" * k for k in range(1, 200)] + [b"x" * k + b"\0" for k in range(1, 70)] + [b"x" * k + b"y" + b"x" * (70 - k) for k in range(71)]
    with np.errstate(over="ignore"):
        one, each = jaccard.word_hashes(words), [jaccard.word_hashes([w])[0] for w in words]
    assert len(set(one.tolist())) == len(set(words)) and one.tolist() == each


@pytest.mark.parametrize("part_sets", [3, 10, 10**6])
def test_long_lists_cut_into_parts_lose_no_pair(spark, part_sets):
    rng = np.random.default_rng(6)
    common = rng.integers(0, 2**63, 4).astype(np.uint64)
    rows = []
    for k in range(40):
        own = rng.integers(0, 2**63, 3).astype(np.uint64)
        rows.append((k, 100, k // 2, np.concatenate([own, common[rng.random(4) < 0.7]]).tobytes()))
    placed = spark.createDataFrame([(a, b, a, c, bytearray(d)) for a, b, c, d in rows], "node long, n long, head long, comp long, prefix binary").repartition(3)
    tokens = np.sort(common)
    frequent = spark.sparkContext.broadcast((tokens, np.full(4, 40)))
    got = {(r.a, r.b) for r in jaccard.candidates(jaccard.postings(placed, 7, frequent, part_sets)).collect()}
    prefix = {r[0]: set(np.frombuffer(r[3], np.uint64).tolist()) for r in rows}
    assert got == {(a, b) for a, b in combinations(range(40), 2) if a // 2 != b // 2 and prefix[a] & prefix[b]}


def test_ties_of_the_order_lose_no_link(spark):
    """All shingles are equally frequent, so that only the hash itself orders them."""
    docs = planted(5, 12)
    sets = {i: jaccard.shingles((t or "").encode()) for i, t in docs}
    tokens = np.unique(np.concatenate(list(sets.values())))
    frequent = spark.sparkContext.broadcast((tokens, np.full(len(tokens), 5)))
    texts = spark.createDataFrame([(i, t) for i, t in docs if len(sets[i])], "node long, text string").withColumn("doc_id", F.col("node")).repartition(7)
    prefix = {r.node: np.frombuffer(r.prefix, np.uint64) for r in jaccard.representatives(texts, frequent).collect()}
    for a, b in combinations(prefix, 2):
        if jaccard.linked(len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b]))):
            assert len(np.intersect1d(prefix[a], prefix[b]))


def test_members_answers_are_derived_from_heads(spark):
    """Two clusters whose heads don't link, with members that do, or seem to until their own tokens are looked at."""
    rng = random.Random(8)
    fresh = iter(f"n{k}" for k in range(100_000))
    out = []
    for _ in range(25):
        base = [next(fresh) for _ in range(300)]

        def edited(words, n, rng=rng):
            words = list(words)
            for k in rng.sample(range(0, 300, 6), n):
                words[k] = next(fresh)
            return words

        one, two = edited(base, 5), edited(base, 5)
        groups = [edited(one, rng.choice([1, 2, 3])) for _ in range(6)] + [edited(two, rng.choice([1, 2, 3])) for _ in range(6)]
        out += [one, two, *groups]
    docs = [(k, " ".join(words)) for k, words in enumerate(out)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_documents(df).collect())
    assert got == brute_components(docs)


def test_hot_keys_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_PAIRS", 3)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    docs = planted(9, 10) + [(9000 + k, "the same words again and again in this text of ten") for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_documents(df).collect())
    assert got == brute_components(docs)


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 900))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = rng.random(len(a)) < rng.uniform(0.8, 1)
        b = np.unique(np.concatenate([a[keep], rng.integers(0, 2**63, int(len(a) * rng.uniform(0, 0.2))).astype(np.uint64)]))
        if jaccard.linked(len(a), len(b), len(np.intersect1d(a, b))):
            assert jaccard.may_link(len(a), jaccard.sketch(a), len(b), jaccard.sketch(b))


def test_shingles_are_words_not_bytes():
    assert len(jaccard.shingles("É b c d e f".encode())) == 2
    assert (jaccard.shingles(b"A b  c\td e") == jaccard.shingles(b"a b c d e")).all()
    assert len(np.intersect1d(jaccard.shingles(b"ab c d e f"), jaccard.shingles(b"a bc d e f"))) == 0


def brute_top(rows, k=5):
    fit = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    fit = list(dict((((i, tuple(v))), (i, v)) for i, v in fit).values())
    out = []
    for q, qv in fit:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in fit if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("n", [0, 1, 3, 260])
def test_search_by_brute_force(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(k), [float(x) for x in np.float32(rng.normal(size=6)).round(1)]) for k in range(n)]
    if n > 200:
        same = rows[7][1]
        rows = [(i, same if i % 3 == 0 else v) for i, v in rows]  # a third of all rows is one vector
        rows += [(1000, None), (1001, [1.0, None]), (1050, [float("nan")]), (1100, [float("inf")]), (None, [1.0]), (1150, []), (1200, [0.5]), rows[5], rows[50], (-50, [3.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).repartition(3)
    got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect())
    assert got == brute_top(rows)


def test_equal_ids_with_different_vectors_keep_their_places(spark):
    rows = [(50, [1.0, 1.0])] + [(9, [2.0 - k / 8, k / 8]) for k in range(5)] + [(10, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect())
    assert got == brute_top(rows) == [(50, r, 9, 256 * 512) for r in range(1, 6)]


def test_scores_beyond_64_bits_rank_by_their_true_values(spark):
    rows = [(0, [1e16, 1e16, -1e16]), (1, [1e16, 1e16, 1.0]), (2, [1e16, 1.0, 1.0]), (3, [-1e16, -1e16, 1e16]), (4, [3.0, 2.0, 1.0]), (5, [1e16, 1e16, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect())
    assert [r[:3] for r in got] == [r[:3] for r in brute_top(rows)]
    assert got[0][3] == 2**63 - 1 and got[-1][3] == -(2**63)
