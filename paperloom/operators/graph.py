"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import by_key, cut

#: Rows of whole groups that a task takes at a time; a group of more is left to joins.
HELD = 200_000


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n numbered nodes the smallest one that it is linked with."""
    root = np.arange(n)
    while len(a):
        # of each link's roots the larger hangs on the smaller one, then all nodes on the last of theirs
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in order of the keys, none of them null, as tables of whole groups with HELD rows or some more, and the
    numbers of the groups."""
    held: list[pa.RecordBatch] = []

    def numbers(rows: pa.Table) -> np.ndarray:
        new = np.zeros(len(rows), bool)
        for key in keys:
            values = rows.column(key).combine_chunks()
            new[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
        return np.cumsum(new)

    size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += len(batch)
        if size >= HELD:
            rows = pa.Table.from_batches(held)
            group = numbers(rows)
            last = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if last:
                yield rows.slice(0, last), group[:last]
            held = rows.slice(last).combine_chunks().to_batches()
            size = 0 if last else -size  # a group that goes on is looked at again when it has doubled
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, numbers(rows)


def components_within(edges: DataFrame, by: str) -> DataFrame:
    """(node, root) as ``components`` of edges (by, a, b) whose nodes belong to one value of ``by`` each.

    Tasks solve groups of up to HELD edges, many at a time; the edges of larger groups go to ``components``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in whole_groups(batches, by):
            ends = pa.chunked_array([*rows.column("a").chunks, *rows.column("b").chunks])
            nodes = pc.unique(ends)
            nodes = nodes.take(pc.sort_indices(nodes))
            at = pc.index_in(ends, value_set=nodes).to_numpy()
            root = roots(len(nodes), at[: len(rows)], at[len(rows) :])
            yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(root))], names=["node", "root"])

    counted = by_key(edges.select(by, "a", "b").dropna(), by).withColumn("_n", F.count("*").over(Window.partitionBy(by)))
    kind = edges.schema["a"].dataType.simpleString()
    small = counted.filter(F.col("_n") <= HELD).select(by, "a", "b").sortWithinPartitions(by).mapInArrow(run, f"node {kind}, root {kind}")
    large = counted.filter(F.col("_n") > HELD)
    return small if large.isEmpty() else small.union(components(large))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): the smallest node reachable.

    Large stars hang the larger neighbours of a node on its smallest one, small stars the smaller ones, until nothing moves;
    each round is checkpointed. Neighbourhoods are never gathered, only their minima are. Edges with a null end are left out.
    """
    pairs = cut(edges.select("a", "b").filter("a <> b").distinct())
    while True:
        both = pairs.union(pairs.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        hung = large.join(least, F.col("a") == F.col("u"))
        small = hung.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        after = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        if after.count() == pairs.count() and after.exceptAll(pairs).isEmpty():
            roots = after.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
            return roots.union(after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct().join(roots.select("node"), "node", "left_anti"))
        pairs = after
