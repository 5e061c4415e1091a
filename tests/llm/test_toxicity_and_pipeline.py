import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from paperloom.llm import toxicity

LARGE = "/root/testdata/sf0.1"


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    pos = label.sum()
    return (rank[label == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(label) - pos))


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{LARGE}/documents.parquet"), spark.read.parquet(f"{LARGE}/labels.parquet")
    found = toxicity.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = found[found.held_out]
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in held.doc_id[:50])
    assert auc(held.score.to_numpy(), held.toxic.to_numpy()) > 0.97
    flagged = held[held.predicted == 1]
    assert flagged.toxic.mean() > 0.95 and len(flagged) > 0.9 * held.toxic.sum()
    assert found.score.between(0, 1).all() and ((found.score >= 0.3) == (found.predicted == 1)).all()


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "you idiot", "s"), (2, None, "s"), (3, "", "s"), (None, "x", "s"), (1, "you idiot", "s"), (4, "a" * 100_000, "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, labels).count() == 6
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert toxicity.drop_toxic(docs, labels.limit(0)).columns == docs.columns


def test_trees_and_calibration_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = toxicity.fit_trees(x[:400], y[:400])
    assert auc(trees.margin(x[400:]), y[400:]) > 0.97
    knots, shares = toxicity.fit_isotonic(trees.margin(x[400:]), y[400:])
    assert (np.diff(knots) >= 0).all() and (np.diff(shares) >= 0).all()


def test_lexicon_is_the_same_however_rows_are_dealt(spark):
    texts = [("you scum licence", 1, False)] * 12 + [("a clean licence", 0, False)] * 12 + [("other clean words", 0, False)] * 6
    rows = spark.createDataFrame(texts, "text string, toxic int, calibrates boolean")
    one, some, many = (toxicity.learn_lexicon(rows.repartition(n)) for n in (1, 8, 100))
    assert one == some == many and set(one) == {b"you", b"scum"}


def test_long_words_reach_the_lexicon(spark):
    texts = [("x" * 60 + " here", 1, False)] * 12 + [("a clean here", 0, False)] * 12
    rows = spark.createDataFrame(texts, "text string, toxic int, calibrates boolean")
    assert set(toxicity.learn_lexicon(rows)) == {b"x" * 60}


def test_scores_are_the_same_however_rows_are_dealt(spark):
    docs = spark.createDataFrame([(k, f"w{k % 7} w{k % 11} " + ("you scum" if k % 5 == 0 else "fine day")) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(400)], "doc_id long, toxic int")
    one, many = ({r.doc_id: r.score for r in toxicity.score(docs.repartition(n), labels).collect()} for n in (1, 100))
    assert one == many


def test_obfuscated_words_are_features():
    lexicon = {b"idiot": 2.0}
    plain, hidden = toxicity.features(b"you are an idiot", lexicon), toxicity.features(b"you are an 1d1ot", lexicon)
    names = toxicity.FEATURES
    assert plain[names.index("near_second")] == 1 and hidden[names.index("folded_density")] > 0 and hidden[names.index("lexicon_density")] == 0


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    """Tables in which every stage has something to do."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    clean = [" ".join(word() for _ in range(60)) for _ in range(120)]
    toxic = [t + " you idiot scum" for t in (" ".join(word() for _ in range(40)) for _ in range(40))]
    rows = [(k, t) for k, t in enumerate(clean + toxic)]
    rows += [(1000, clean[0]), (1001, clean[1].replace(clean[1].split()[5], "other")), (1002, "start " + clean[2] + " token = abcdef0123456789"), (1003, None), (1004, "")]
    benchmark = [(1, " ".join(clean[3].split()[5:20]))]
    labels = [(k, int(k >= 120)) for k in range(160)]
    folder = str(tmp_path_factory.mktemp("tiny"))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_by_hand(spark, tiny):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, tiny).collect()}
    # toxic ones go, copies of 0, 1 and 2 go, the contaminated one goes
    assert set(got) == ({*range(120)} - {3}) | {1003, 1004}
    assert got[1003].n_tokens == got[1004].n_tokens == 0


def test_stages_keep_columns(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tiny)
        assert out.columns == docs.columns, name
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "encoding"]


def test_secret_stage_takes_effect(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").filter("doc_id = 1002")
    text = corpus_pipeline.secrets_stage(spark, docs, tiny).first().text
    assert "abcdef0123456789" not in text and text.startswith("start ")


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")]


def test_lexicon_by_a_plain_recount(spark):
    rng = random.Random(11)
    bad, plain_words = ["grok", "blarg", "Zonk"], [f"w{k}" for k in range(40)]
    rows = []
    for k in range(120):
        toxic = k % 3 == 0
        words = rng.choices(plain_words, k=rng.randrange(1, 12)) + (rng.choices(bad, k=2) if toxic or k % 11 == 0 else [])
        rows.append((k, " ".join(words), int(toxic), k % 4 == 0))
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, toxic int, calibrates boolean").repartition(5))
    used = [(set(t.lower().split()), x) for _, t, x, c in rows if not c]
    n = [sum(x == kind for _, x in used) for kind in (1, 0)]
    want = {}
    for w in set().union(*(ws for ws, _ in used)):
        t, c = (sum(w in ws and x == kind for ws, x in used) for kind in (1, 0))
        odds = math.log((t + 0.5) / (n[0] + 1)) - math.log((c + 0.5) / (n[1] + 1)) - math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        if odds > 0.3 and t >= max(toxicity.LEAST_DOCUMENTS, toxicity.LEAST_SHARE * n[0]):
            want[w.encode()] = odds
    assert got.keys() == want.keys() >= {b"grok", b"blarg", b"zonk"} and all(got[w] == pytest.approx(want[w]) for w in want)


def test_isotonic_fit_is_the_greatest_of_least_means():
    rng = np.random.default_rng(4)
    margin = np.sort(rng.normal(size=60))
    y = (rng.random(60) < 1 / (1 + np.exp(-margin))).astype(float)
    knots, shares = toxicity.fit_isotonic(margin, y)
    fitted = [max(min(y[i : j + 1].mean() for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    assert sorted(set(np.round(shares, 9))) == sorted(set(np.round(fitted, 9))) and (np.diff(knots) > 0).all()


def test_repeated_rows_are_fitted_once(spark):
    docs = [(k, f"bad word{k % 7}" if k % 2 else f"fine word{k % 5}") for k in range(80)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, toxic int")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    once = toxicity.training_rows(frame(docs), labels, 50)
    often = toxicity.training_rows(frame(docs + docs[:9] * 20).repartition(3), labels, 50)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, often.collect())) and often.count() == 50


def test_workers_drop_what_other_operators_kept(tmp_path):
    import gc

    import public_tokenizers

    from paperloom.llm import bpe, common, decontaminate

    usual = gc.get_threshold()
    path = public_tokenizers.path("byte_bpe_50k.json")
    kept = bpe.coder(path)
    assert kept.encode_batch(["a word"]) and kept.cache
    decontaminate.automaton("key", [("1", b"one two three")])
    common.settle("bpe")
    assert bpe.coder(path) is kept and not decontaminate._resident
    common.settle()
    assert bpe.coder.cache_info().currsize == 0 and gc.get_threshold() == usual and gc.get_freeze_count() == 0
