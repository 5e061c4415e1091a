"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features are densities of learned lexicon words (plain and behind obfuscation), their proximity to second-person words,
capitals, punctuation and obfuscation rates. Labels come from training rows alone; language, source and ids are no inputs.

The classifier is fitted on at most SAMPLE_ROWS labelled training rows, the ones with the smallest hashes; scoring covers
every row. Null and empty texts have zero features and get the score of such texts. Rows without doc_id are scored, and
held out of nothing. Without both labels among the training rows the score is their share of toxic ones (0 without any).
Repeated rows give repeated rows and are fitted once; of contradicting labels of one doc_id the higher counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import materialise, settle, small_batches, trim

SAMPLE_ROWS = 20_000
#: Sampled ids up to which they are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
LEXICON_WORDS = 150
#: A lexicon word stands in so many toxic documents at least, and in this share of them.
LEAST_DOCUMENTS, LEAST_SHARE = 3, 0.01
THRESHOLD = 0.3
NEAR_WORDS = 4

#: Second-person words of the corpus's languages.
SECOND_PERSON = frozenset(
    w.encode()
    for w in "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros vuestro".split()
)
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or b == 39 else 32 for b in range(256))
_FOLDS = dict(zip(b"013457@$!", b"oieastasi"))
FOLDED = bytes(_FOLDS.get(b, PLAIN[b]) for b in range(256))
HIDDEN = re.compile(rb"[A-Za-z][*@$!0-9][*@$!0-9]?[A-Za-z]")
SHOUTED = re.compile(rb"(?<![A-Za-z])[A-Z]{3,}(?![A-Za-z])")
STRETCHED = re.compile(rb"([A-Za-z])\1\1")
BURST = re.compile(rb"[!?]{2,}")

FEATURES = (
    "lexicon_density lexicon_weight lexicon_peak lexicon_count lexicon_kinds folded_density folded_weight near_second near_rate second_density "
    "capitals shouted exclamations questions bursts punctuation digits hidden stretched other_bytes"
).split()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(raw: bytes | None, lexicon: dict[bytes, float]) -> list[float]:
    out = [0.0] * len(FEATURES)
    if not raw:
        return out
    words = raw.translate(PLAIN).split()
    n, size = max(1, len(words)), len(raw)
    kinds = set(words)
    found = kinds & lexicon.keys()
    second = kinds & SECOND_PERSON
    if found:
        hits = [k for k, w in enumerate(words) if w in found]
        weights = [lexicon[words[k]] for k in hits]
        out[0], out[1], out[2], out[3], out[4] = len(hits) / n, sum(weights) / n, max(weights), float(len(hits)), float(len(found))
        if second:
            places = [k for k, w in enumerate(words) if w in second]
            at = np.searchsorted(places, hits)
            before = np.array([-(10**9), *places])[at]
            after = np.array([*places, 10**9])[at]
            near = int((np.minimum(np.array(hits) - before, after - np.array(hits)) <= NEAR_WORDS).sum())
            out[7], out[8] = float(near), near / len(hits)
    folded = raw.translate(FOLDED).split()
    if hidden := (set(folded) & lexicon.keys()):
        n_plain = Counter(w for w in words if w in hidden)
        n_folded = Counter(w for w in folded if w in hidden)
        extra = {w: n_folded[w] - n_plain[w] for w in hidden if n_folded[w] > n_plain[w]}
        out[5], out[6] = sum(extra.values()) / n, sum(lexicon[w] * c for w, c in extra.items()) / n
    if second:
        out[9] = sum(w in second for w in words) / n
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    out[10] = count[65:91].sum() / letters
    out[11] = len(SHOUTED.findall(raw)) / n
    out[12], out[13] = count[33] / n, count[63] / n
    out[14] = len(BURST.findall(raw)) / n
    out[15] = (count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()) / size
    out[16] = count[48:58].sum() / size
    out[17] = len(HIDDEN.findall(raw)) / n
    out[18] = len(STRETCHED.findall(raw)) / n
    out[19] = count[128:].sum() / size
    return out


# ---- the model


@dataclass
class Trees:
    """Boosted trees of logistic loss on binned features; each tree is arrays of (feature, cut, left, right, value)."""

    base: float = 0.0
    trees: list[list[np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, left, right, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                inner = left[node] >= 0
                if not inner.any():
                    break
                go = np.where(x[rows, feature[node]] <= cut[node], left[node], right[node])
                node = np.where(inner, go, node)
            out += value[node]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least_rows: int = 8, ridge: float = 1.0) -> Trees:
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    cuts = [np.unique(np.append(c, np.quantile(v[v > 0], np.linspace(0, 1, 17)[:-1]))) if (v > 0).any() else c for c, v in zip(cuts, x.T)]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], axis=1)
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = Trees(float(np.log(share / (1 - share))))
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, curve = p - y, p * (1 - p)
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, level: int, nodes=nodes, grad=grad, curve=curve) -> int:
            me = len(nodes)
            g, h = grad[rows].sum(), curve[rows].sum()
            nodes.append([0, 0.0, -1, -1, -rate * g / (h + ridge)])
            if level == depth or len(rows) < 2 * least_rows:
                return me
            best = (1e-6, 0, 0)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, f]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (grad[rows], curve[rows], np.ones(len(rows))))
                gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
                gain[(ns < least_rows) | (len(rows) - ns < least_rows)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
            if best[0] > 1e-6:
                _, f, k = best
                low = binned[rows, f] <= k
                nodes[me][:2] = [f, cuts[f][k]]
                nodes[me][2] = grow(rows[low], level + 1)
                nodes[me][3] = grow(rows[~low], level + 1)
            return me

        grow(np.arange(len(y)), 0)
        table = np.array(nodes)
        tree = [table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4]]
        model.trees.append(tree)
        margin += Trees(0.0, [tree]).margin(x)
    return model


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (mean margin of each pool) and their shares, ascending."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []
    for m, v in zip(margin[order], y[order]):
        pools.append([m, v, 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            m2, v2, n2 = pools.pop()
            pools[-1] = [pools[-1][0] + m2, pools[-1][1] + v2, pools[-1][2] + n2]
    # a margin is summed with its pool and divided here
    return np.array([m / n for m, _, n in pools]), np.array([(v + 0.0) / n for _, v, n in pools])


@dataclass
class Model:
    lexicon: dict[bytes, float]
    trees: Trees | None
    knots: np.ndarray
    shares: np.ndarray
    constant: float

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.constant)
        margin = self.trees.margin(np.array([features(t, self.lexicon) for t in texts]).reshape(len(texts), len(FEATURES)))
        calibrated = np.interp(margin, self.knots, self.shares)
        # ties of the calibration keep the order of the margins
        return np.clip(0.998 * calibrated + 0.002 / (1 + np.exp(-margin)), 0.0, 1.0)


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(doc_id, text, toxic, calibrates) of the sampled training rows."""
    ids = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    ids = ids.filter(~held_out(F.col("id"))).withColumn("mix", F.xxhash64("id", F.lit(17))).orderBy("mix", "id").limit(sample_rows)
    # each id counts once, however often its row is repeated: the fit's bound is one of rows; of several texts that of the least hash
    joined = docs.join(F.broadcast(ids) if sample_rows <= BROADCAST_ROWS else ids, docs.doc_id == ids.id)
    once = joined.groupBy("doc_id", "toxic", "mix").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return once.select("doc_id", "text", "toxic", (F.pmod("mix", F.lit(4)) == 0).alias("calibrates"))


def learn_lexicon(rows: DataFrame) -> dict[bytes, float]:
    """Words with the largest smoothed log-odds of standing in a toxic text, by documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        toxic: Counter[bytes] = Counter()
        clean: Counter[bytes] = Counter()
        n = [0, 0]
        for batch in batches:
            for text, label in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                (toxic if label else clean).update(set((text or b"").translate(PLAIN).split()))
                n[bool(label)] += 1
        words = list(toxic.keys() | clean.keys())  # all of them: the sums must not depend on how rows are dealt
        yield pa.RecordBatch.from_arrays([pa.array([b"", *words], pa.binary()), pa.array([n[1], *(toxic[w] for w in words)], pa.int64()), pa.array([n[0], *(clean[w] for w in words)], pa.int64())], names=["word", "t", "c"])

    counts = rows.filter("NOT calibrates").select("text", "toxic").mapInArrow(run, "word binary, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = materialise(counts, "lexicon")
    total = counts.filter(F.octet_length("word") == 0).first()
    if not total or not total.t or not total.c:
        return {}
    odds = F.ln((F.col("t") + 0.5) / (total.t + 1)) - F.ln((F.col("c") + 0.5) / (total.c + 1))
    # evidence: log-odds less what chance gives a rare word
    odds = odds - F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    top = counts.filter(F.octet_length("word") > 0).filter(F.col("t") >= max(LEAST_DOCUMENTS, LEAST_SHARE * total.t)).withColumn("odds", odds).filter("odds > 0.3").orderBy(F.desc("odds"), "word").limit(LEXICON_WORDS)
    return {bytes(r.word): float(r.odds) for r in top.collect()}


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the training rows of ``labels`` among ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    rows = materialise(training_rows(docs, labels, sample_rows), "training")
    lexicon = learn_lexicon(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            x = [features(t, lexicon) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "calibrates", "x"])

    table = rows.mapInArrow(run, "doc_id long, toxic int, calibrates boolean, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    y = table["toxic"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        return Model(lexicon, None, np.zeros(0), np.zeros(0), float(y.mean()) if len(y) else 0.0)
    x = np.array(table["x"].tolist())
    calibrates = table["calibrates"].to_numpy(dtype=bool)
    if len(set(y[calibrates])) < 2 or len(set(y[~calibrates])) < 2:
        calibrates = np.zeros(len(y), dtype=bool)
    trees = fit_trees(x[~calibrates], y[~calibrates])
    on = calibrates if calibrates.any() else ~calibrates
    knots, shares = fit_isotonic(trees.margin(x[on]), y[on])
    return Model(lexicon, trees, knots, shares, float(y.mean()))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.scores(batch.column(1).cast(pa.binary()).to_pylist()))], names=["doc_id", "score"])
        trim()

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents, with all their columns, that score below the threshold."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, sample_rows))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            yield batch.filter(pa.array(model.value.scores(batch.column(at).cast(pa.binary()).to_pylist()) < THRESHOLD))
        trim()

    return docs.mapInArrow(run, docs.schema)
