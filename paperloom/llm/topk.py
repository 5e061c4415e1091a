"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of (term, weight); blocks of them are stored term by term, as postings. For a block of queries
and a block of candidates, each term's query weights scatter its weighted postings into a dense score array; a partition
selection keeps k of each query and block, and a window merges the blocks' selections.

Query blocks are dealt to every group of candidate blocks by an equi-join on the group, so no side is broadcast or
collected, and any number of groups splits the work evenly whatever the vectors hold. There are no more groups than blocks
of candidates: queries are copied as often as the work can be split, however many partitions a shuffle has.

Scores are exact: where weights are so large that 64 bits could overflow, the block is summed in Python integers, and
the scores rank by their true values; the column itself saturates.

Rows without id, and vectors that are null or hold a null or non-finite component, take no part. Vectors of different
lengths are compared on the terms both have; an empty vector scores 0. Candidates with the query's own id are left out.
Repeated rows (equal id and vector) count once, as query and as candidate; equal ids with different vectors are different
rows, each with a place of its own. Fewer than k candidates give fewer rows; an empty table gives none. Weights saturate
at 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
#: Queries and candidates whose scores are accumulated at a time: the score array stays in the processor's cache.
TILE_QUERIES = 64
#: Candidates for each group of blocks, at least.
GROUP_ROWS = 2048
POSTINGS = "block long, n int, ids binary, marks binary, terms binary, starts binary, rows binary, weights binary"


def weights(vector: Column) -> Column:
    """floor(256 * x) of every component, or null if the vector takes no part."""
    doubles = vector.cast("array<double>")
    unfit = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~unfit, F.transform(doubles, lambda x: F.floor(256 * x)))


def pack(ids: np.ndarray, marks: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> tuple[bytes, ...]:
    """ids, marks, terms, starts, rows and weights of a block: the postings of each term, zero weights left out."""
    row = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
    term = np.arange(len(values), dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    kept = values != 0
    row, term, value = row[kept], term[kept], values[kept]
    order = np.argsort(term, kind="stable")
    row, term, value = row[order], term[order], value[order]
    terms, starts = np.unique(term, return_index=True)
    return ids.tobytes(), marks.tobytes(), terms.tobytes(), np.append(starts, len(term)).astype(np.int64).tobytes(), row.tobytes(), value.tobytes()


def postings(vectors: DataFrame) -> DataFrame:
    """Blocks of at most BLOCK_ROWS rows of (id, w, mark), made where the rows lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                ids = part.column(0).to_numpy()
                lists = part.column(1)
                lengths = lists.value_lengths().to_numpy()
                values = lists.flatten().to_numpy().astype(np.int64)
                marks = part.column(2).to_numpy()
                _, first = np.unique(np.stack([ids, marks]), axis=1, return_index=True)
                if len(first) < len(ids):  # repeated rows
                    keep = np.zeros(len(ids), dtype=bool)
                    keep[first] = True
                    values, ids, marks, lengths = values[np.repeat(keep, lengths)], ids[keep], marks[keep], lengths[keep]
                packed = pack(ids, marks, lengths, values)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([len(ids)], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], names=POSTINGS_NAMES)
                block += 1

    return vectors.mapInArrow(run, POSTINGS)


POSTINGS_NAMES = [c.split()[0] for c in POSTINGS.split(", ")]


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    ids, starts = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["starts"], np.int64)
    rows, values = np.frombuffer(row["rows"], np.int32), np.frombuffer(row["weights"], np.int64)
    return ids, np.frombuffer(row["marks"], np.int64), {t: (rows[a:b], values[a:b]) for t, a, b in zip(np.frombuffer(row["terms"], np.int64).tolist(), starts.tolist(), starts[1:].tolist())}


def peak(terms: dict[int, tuple[np.ndarray, np.ndarray]]) -> float:
    return max((float(np.abs(w.astype(np.float64)).max()) for _, w in terms.values()), default=0.0)


def spread(terms: dict[int, tuple[np.ndarray, np.ndarray]], n: int, kind: type) -> dict[int, tuple[np.ndarray | None, np.ndarray]]:
    """The postings with weights of the given kind; those that at least half of the rows share are laid out row by row."""
    out = {}
    for term, (rows, w) in terms.items():
        w = w.astype(kind)
        if 2 * len(rows) >= n:
            full = np.zeros(n, dtype=kind)
            full[rows] = w
            out[term] = None, full
        else:
            out[term] = rows, w
    return out


def accumulate(queries: dict, n_queries: int, candidates: dict, n_candidates: int, kind: type) -> np.ndarray:
    """Scores of all queries of a tile against all candidates of a (spread) block, one shared term after the other."""
    scores = np.zeros((n_queries, n_candidates), dtype=kind)
    part = np.empty(n_candidates, dtype=kind)
    for term, (q, qw) in queries.items():
        if term not in candidates:
            continue
        c, cw = candidates[term]
        for at, w in zip(q.tolist(), qw.astype(kind)):
            if c is None:
                np.multiply(cw, w, out=part)
                scores[at] += part
            else:
                scores[at, c] += w * cw
    return scores


def select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id, the query's own id left out."""
    fit = np.flatnonzero(ids != own)
    score = scores[fit]
    if len(fit) > k:
        cut = np.partition(score, len(fit) - k)[len(fit) - k]
        fit = np.concatenate([fit[score > cut], (tied := fit[score == cut])[np.argsort(ids[tied], kind="stable")[: k]]])
        score = scores[fit]
    best = sorted(zip((-int(s) for s in score), ids[fit].tolist(), fit.tolist()))[:k]
    return np.array([place for _, _, place in best], dtype=np.int64)


def digits(scores: list[int]) -> list[pa.Array]:
    """Integers of up to some 160 bits as (high, middle, low) parts of 64, 50 and 50 bits that sort as they do."""
    mask = (1 << 50) - 1
    return [pa.array(x, pa.int64()) for x in ([s >> 100 for s in scores], [(s >> 50) & mask for s in scores], [s & mask for s in scores])]


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the k best candidates of every query row."""
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCK_ROWS))
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), weights(vectors[vector_col]).alias("w"), is_query.alias("asks")).filter("id IS NOT NULL AND w IS NOT NULL")
    most = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = max(1, min(most, -(-rows.count() // GROUP_ROWS)))
    rows = rows.withColumn("mark", F.xxhash64("w"))
    candidates = postings(rows.select("id", "w", "mark")).withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))
    asked = postings(rows.filter("asks").select("id", "w", "mark")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), *[F.col(c).alias(f"q_{c}") for c in POSTINGS_NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in range(batch.num_rows):
                row = batch.slice(one, 1).to_pylist()[0]
                ids, marks, terms = unpack({c: row[c] for c in POSTINGS_NAMES})
                q_ids, q_marks, q_terms = unpack({c: row[f"q_{c}"] for c in POSTINGS_NAMES})
                bound = peak(terms) * peak(q_terms) * max(1, len(terms))
                kind = np.int32 if bound < 2**31 - 1 else np.int64 if bound < 2**62 else object
                full = spread(terms, len(ids), kind)
                for at in range(0, len(q_ids), TILE_QUERIES):
                    tile = {t: (q[s] - at, w[s]) for t, (q, w) in q_terms.items() if (s := slice(*np.searchsorted(q, (at, at + TILE_QUERIES)))).start < s.stop}
                    n = min(TILE_QUERIES, len(q_ids) - at)
                    scores = accumulate(tile, n, full, len(ids), kind)
                    found = [select(scores[i], ids, int(q_ids[at + i]), k) for i in range(n)]
                    best = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
                    of = np.repeat(np.arange(n), [len(f) for f in found])
                    exact = [int(s) for s in scores[of, best]]
                    held = pa.array([min(max(s, -(2**63)), 2**63 - 1) for s in exact], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[at + of]), pa.array(q_marks[at + of]), pa.array(ids[best]), pa.array(marks[best]), held, *digits(exact)], names=FOUND)

    best = candidates.join(asked.hint("shuffle_hash"), "group").mapInArrow(run, ", ".join(f"{c} long" for c in FOUND))
    once = best.dropDuplicates(["query_id", "query_mark", "vec_id", "mark"])
    order = Window.partitionBy("query_id", "query_mark").orderBy(F.desc("high"), F.desc("middle"), F.desc("low"), "vec_id", "mark")
    ranked = once.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


FOUND = ["query_id", "query_mark", "vec_id", "mark", "score", "high", "middle", "low"]
