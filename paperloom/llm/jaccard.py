"""N-gram Jaccard join by set relations: which documents share at least three quarters of their word shingles?

A document's set holds its distinct five-word shingles (the whole sequence, if it has fewer words). Two sets link when
100 * intersection >= 75 * union. The join goes from cheap relations to costly ones:

1. equal sets form a class; one representative stands for it (copies are never paired);
2. close sets: a set that shares its lowest hashes with a leader is held against that leader alone. One with
   8 * intersection >= 7 * union to a head belongs to the head's cluster. Jaccard distance is a metric, so all sets of a
   cluster link with one another: their answers follow from the head's, no pair of them is looked at;
3. the index: a cluster posts each token of its members' prefixes (in a global order, frequent shingles last) once, with
   the least size and the farthest reach of the members that hold it. Lists are sorted by size and cut into blocks with
   bounds of reach and component; whole blocks that no pair can fit are skipped, and so are pairs of one component;
4. answers of heads: sketches rule pairs of heads out, the rest are intersected. What a member answers is derived from
   its head's answer: by the distances alone where these decide, else from the head's intersection and the tokens by
   which the member differs from the head. Only what is then still open is held against each other set by set;
5. components of all links are found by alternating star contractions.

Shingles are 64-bit hashes of word hashes, mixed after each word; a wrong link takes colliding hashes within one pair of
documents. No pair of documents with different texts that links is lost: order, leaders and clusters only decide how much
is skipped.

Null, empty and blank texts have empty sets, link with nothing and are their own component. A row without doc_id is
compared like any other; its component is the smallest doc_id reached, null if there is none. Repeated rows are copies;
different texts under one doc_id are different sets. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import forget, forget_since, materialise, settle, small_batches, steps, trim

WORDS = 5
#: Rows (of one or two 64-bit keys) up to which a side is broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 1_000_000
#: Frequent shingles that the global order puts last: a bound of 8 bytes each on what every worker holds.
FREQUENT_ROWS = 200_000
#: Tokens that a task counts together, and in how many of its distinct sets one must stand to be reported.
CHUNK_TOKENS = 4_000_000
LEAST_SEEN = 3
LEADER_TOKENS = 8
BUCKET_POSTINGS = 400_000
#: A frequent shingle's list is cut into parts of about so many clusters, and each pair of parts is a bucket of its own.
PART_SETS = 30_000
FLUSH_POSTINGS = 250_000
#: Entries of a block of a list, and pairs of an entry and a block that are looked at together.
BLOCK = 32
PAIR_SLICE = 200_000
SKETCH_BITS = 512
#: Pairs of one set that are dealt to one task, where sets are moved to their pairs.
HOT_PAIRS = 500
#: Distances are compared with this margin, so that rounding never decides.
MARGIN = 1e-9

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words of more bytes are hashed one by one.
LANE_BYTES = 64
STEP, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which each bit depends on each."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def stir(x: np.ndarray, y: np.ndarray) -> None:
    """Mix y into x in place: a bijection of x for each y, and of y for each x."""
    x ^= y
    x *= MIX_A
    x ^= x >> np.uint64(32)
    x *= STEP
    x ^= x >> np.uint64(29)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word: eight bytes after the other are mixed in, for all words at once."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    data = b"".join(words) + bytes(8)
    start = np.cumsum(size) - size
    lanes = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    found = size.astype(np.uint64)
    stir(found, lanes[start] & MASKS[np.minimum(size, 8)])
    rows, done = np.flatnonzero((size > 8) & (size <= LANE_BYTES)), 8
    while len(rows):
        part = found[rows]
        stir(part, lanes[start[rows] + done] & MASKS[np.minimum(size[rows] - done, 8)])
        found[rows] = part
        done += 8
        rows = rows[size[rows] > done]
    for k in np.flatnonzero(size > LANE_BYTES).tolist():
        found[k] = int.from_bytes(blake2b(words[k], digest_size=8).digest(), "little")
    return found


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        hashes = word_hashes(words)
        n = min(WORDS, len(words))
        found = np.full(len(words) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            stir(found, hashes[k : len(words) - n + 1 + k])
    found.sort()
    return found[np.r_[True, found[1:] != found[:-1]]]


def signature(tokens: np.ndarray) -> bytes:
    return blake2b(tokens.tobytes(), digest_size=16).digest()


def sketch(tokens: np.ndarray) -> bytes:
    """Parity of the number of tokens at each of a power of two of bits: as many bits as tokens, or more."""
    bits = max(SKETCH_BITS, 1 << int(len(tokens) - 1).bit_length())
    return np.packbits((np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def may_link(n_a: int, sketch_a: bytes, n_b: int, sketch_b: bytes, distance: float = 0.25) -> bool:
    """False only if the sets are farther apart: differing parity bits are a lower bound of the symmetric difference."""
    a, b = np.unpackbits(np.frombuffer(sketch_a, np.uint8)), np.unpackbits(np.frombuffer(sketch_b, np.uint8))
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    apart = max(int(np.count_nonzero(a != b)), abs(n_a - n_b))
    return 2 * apart <= (distance + MARGIN) * (n_a + n_b + apart)


def held(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which members of b the ascending set a holds."""
    if not len(a):
        return np.zeros(len(b), dtype=bool)
    return a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b


def linked(n_a: int, n_b: int, common: int) -> bool:
    return common > 0 and 100 * common >= 75 * (n_a + n_b - common)


def bounded(df: DataFrame) -> DataFrame:
    """The frame with a broadcast hint if it is small enough, else as it is; ``df`` is a written table."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def hot_keys(counts: DataFrame) -> DataFrame:
    """(end, hot, parts), written: keys with many rows and the number of tasks to deal them to, from counts (end, key, n)."""
    return materialise(counts.filter(F.col("n") > HOT_PAIRS).select("end", F.col("key").alias("hot"), F.ceil(F.col("n") / HOT_PAIRS).cast("int").alias("parts")), "hot")


def join_hot(left: DataFrame, side: DataFrame, key: str, other: str, hot: DataFrame) -> DataFrame:
    """left ⋈ side on ``key``; rows of a hot key are dealt to several tasks by the column ``other`` of the left."""
    small, parts = bounded(hot.filter(F.col("end") == key).drop("end")), F.coalesce("parts", F.lit(1))
    dealt = left.join(small, F.col(key) == F.col("hot"), "left").withColumn("salt", F.pmod(F.xxhash64(other), parts).cast("int")).drop("hot", "parts")
    copied = side.join(small, F.col(key) == F.col("hot"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("hot", "parts")
    return dealt.join(copied, [key, "salt"]).drop("salt")


def join_ends(pairs: DataFrame, side: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b, …), a written table, with the side's columns for the nodes at both ends, named column_a and column_b."""
    ends = pairs.select(F.explode(F.array(F.struct(F.lit("a").alias("end"), F.col("a").alias("key")), F.struct(F.lit("b").alias("end"), F.col("b").alias("key")))).alias("x"))
    hot = hot_keys(ends.groupBy("x.end", "x.key").agg(F.count("*").alias("n")))
    is_hot, out = not hot.isEmpty(), pairs
    for end, other in ("ab", "ba"):
        own = side.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns))
        out = join_hot(out, own, end, other, hot) if is_hot else out.join(own, end)
    return out


# ---- profiles


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n, sig) of every row, and (token, seen) for shingles that many distinct sets of a task hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        known: set[bytes] = set()
        kept: list[np.ndarray] = []
        size = 0

        def frequent() -> pa.RecordBatch:
            tokens = np.concatenate(kept)
            kept.clear()
            tokens.sort()
            # a token stands LEAST_SEEN times in a row where it equals the one so many places on
            often = np.unique(tokens[: 1 - LEAST_SEEN][tokens[: 1 - LEAST_SEEN] == tokens[LEAST_SEEN - 1 :]])
            seen = np.searchsorted(tokens, often, "right") - np.searchsorted(tokens, often, "left")
            n = len(often)
            return pa.RecordBatch.from_arrays([*(pa.nulls(n, pa.int64()) for _ in range(3)), pa.nulls(n, pa.binary()), pa.array(often.view(np.int64)), pa.array(seen.astype(np.int64))], names=NAMES)

        for batch in batches:
            sets = [shingles(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            sigs = [signature(s) if len(s) else None for s in sets]
            for s, sig in zip(sets, sigs):
                if sig and sig not in known:
                    known.add(sig)
                    kept.append(s)
                    size += len(s)
            n = len(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=NAMES)
            if size >= CHUNK_TOKENS:
                yield frequent()
                size = 0
                known.clear()
        if kept:
            yield frequent()
        trim()

    return docs.select("doc_id", "mark", "text").mapInArrow(run, "doc_id long, mark long, n long, sig binary, token long, seen long")


NAMES = ["doc_id", "mark", "n", "sig", "token", "seen"]


def frequent_tokens(profile: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles and in how many sets they were seen, ascending by hash; at most FREQUENT_ROWS."""
    rows = profile.filter("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "token").limit(FREQUENT_ROWS).toArrow()
    tokens = rows.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows.column("seen").to_numpy()[order]


def set_classes(rows: DataFrame) -> DataFrame:
    """(sig, node, doc_id, mark, copies): each class's number and the row that stands for it, with that row's repeats."""
    once = rows.filter("sig IS NOT NULL").groupBy("sig", "doc_id", "mark").agg(F.count("*").alias("copies"))
    first = once.groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "copies")).alias("first"))
    return first.select("sig", F.monotonically_increasing_id().alias("node"), "first.doc_id", "first.mark", "first.copies")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text, doc_id), once for each row of ``wanted``, a written table of classes."""
    out = None
    for part, many in ((wanted.filter("copies = 1"), False), (wanted.filter("copies > 1"), True)):
        if many and part.isEmpty():
            continue
        of = bounded(part.select("node", F.col("doc_id").alias("of"), F.col("mark").alias("of_mark")))
        found = docs.join(of, (docs.mark == of.of_mark) & docs.doc_id.eqNullSafe(of.of)).select("node", "text", "doc_id")
        found = found.dropDuplicates(["node"]) if many else found
        out = found if out is None else out.union(found)
    return out


def representatives(texts: DataFrame, frequent) -> DataFrame:
    """(node, doc_id, n, lowest, sketch, prefix) of each class; the prefix is in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        last, seen = frequent.value
        for batch in batches:
            rows = []
            for node, text, doc_id in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                tokens = shingles(text)
                n = len(tokens)
                p = n - (3 * n + 3) // 4 + 1
                prefix = tokens[:p]
                if len(last):
                    # rare shingles by hash, then the frequent ones by how often they were seen, the most frequent last
                    at = np.minimum(np.searchsorted(last, tokens), len(last) - 1)
                    often = last[at] == tokens
                    prefix = tokens[~often][:p]
                    if len(prefix) < p:
                        many = tokens[often]
                        prefix = np.concatenate([prefix, many[np.argsort(seen[at[often]], kind="stable")][: p - len(prefix)]])
                rows.append((node, doc_id, n, tokens[:LEADER_TOKENS].view(np.int64), sketch(tokens), prefix.tobytes()))
            if rows:
                node, doc_id, n, lowest, sketches, prefixes = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(n, pa.int64()), pa.array(lowest, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(prefixes, pa.binary())], names=["node", "doc_id", "n", "lowest", "sketch", "prefix"])
        trim()

    return texts.mapInArrow(run, "node long, doc_id long, n long, lowest array<long>, sketch binary, prefix binary")


# ---- intersections


def token_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, tokens) of the given nodes, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["node", "tokens"])
        trim()

    wanted = materialise(classes.join(nodes.distinct(), "node", "left_semi").select("node", "doc_id", "mark", "copies"), "wanted")
    sets = materialise(texts_of(docs, wanted).mapInArrow(run, "node long, tokens binary"), "sets")
    forget(wanted)
    return sets


def intersections(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, …), a written table, with n_a, n_b, common and distance; close ones (8 * common >= 7 * union)
    also with the tokens that a lost and gained against b."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y in zip(batch.column("tokens_a").to_pylist(), batch.column("tokens_b").to_pylist()):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = held(b, a)
                common = int(np.count_nonzero(shared))
                union = len(a) + len(b) - common
                close = 8 * common >= 7 * union
                rows.append((len(a), len(b), common, 1 - common / union, b[~held(a, b)].tobytes() if close else None, a[~shared].tobytes() if close else None))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], names=[*names, "n_a", "n_b", "common", "distance", "lost", "gained"])
        trim()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    both = join_ends(pairs, sets, ["tokens"]).select(*names, "tokens_a", "tokens_b")
    return both.mapInArrow(run, f"{kinds}, n_a long, n_b long, common long, distance double, lost binary, gained binary")


LINKED = "common > 0 AND 100 * common >= 75 * (n_a + n_b - common)"


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b, reach), a written table, that their sketches don't show to be farther apart than ``reach``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("n_a", "sketch_a", "n_b", "sketch_b", "reach")]
            yield batch.select(["a", "b", "reach"]).filter(pa.array([may_link(*x) for x in zip(*columns)], pa.bool_()))

    both = join_ends(pairs, nodes.select("node", "n", "sketch"), ["n", "sketch"])
    return both.select("a", "b", "reach", "n_a", "sketch_a", "n_b", "sketch_b").mapInArrow(run, "a long, b long, reach double")


def leader_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b, reach): each representative with the one of the smallest doc_id in each list of its lowest hashes.

    Originals come before their copies where ids are given in order, and are nearer to each copy than copies are.
    """
    lowest = nodes.select("node", "doc_id", F.explode("lowest").alias("token"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first")
    leaders = materialise(lowest.groupBy("token").agg(first, F.count("*").alias("n")).filter("n > 1").select("token", F.col("first.node").alias("leader"), "n"), "lists")
    lowest = lowest.drop("doc_id")
    if leaders.count() <= BROADCAST_ROWS:
        met = lowest.join(F.broadcast(leaders.drop("n")), "token")
    else:
        met = join_hot(lowest, leaders.drop("n"), "token", "node", hot_keys(leaders.select(F.lit("token").alias("end"), F.col("token").alias("key"), "n")))
    return met.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"), F.lit(0.25).alias("reach")).distinct()


def cluster_homes(near: DataFrame) -> DataFrame:
    """(node, head, distance, lost, gained): the nearest head that a node is close to; a head is close to no leader itself."""
    close = near.filter("lost IS NOT NULL")
    inner = close.select(F.col("a").alias("inner")).distinct()
    best = close.join(inner, F.col("b") == F.col("inner"), "left_anti").groupBy("a").agg(F.min(F.struct("distance", "b", "lost", "gained")).alias("best"))
    return best.select(F.col("a").alias("node"), F.col("best.b").alias("head"), "best.distance", "best.lost", "best.gained")


# ---- the index


def merge_postings(token: np.ndarray, head: np.ndarray, comp: np.ndarray, n: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry for each token and cluster, ascending: the least size and the farthest reach of its members."""
    order = np.lexsort((head, token))
    token, head, comp, n, reach = (x[order] for x in (token, head, comp, n, reach))
    at = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (head[1:] != head[:-1])]) if len(token) else np.zeros(0, np.int64)
    if len(at) == len(token):
        return token, head, comp, n, reach
    return token[at], head[at], comp[at], np.minimum.reduceat(n, at), np.maximum.reduceat(reach, at)


def postings(placed: DataFrame, buckets: int, frequent, part_sets: int = PART_SETS) -> DataFrame:
    """(bucket, tokens, heads, comps, sizes, reaches): packed postings of the clusters; long lists are cut into parts.

    ``reach`` of a token at place p of the prefix of a set of n is 4n - 7p: two sets that meet first at this token can only
    link if three times the size of each is within the reach of the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        last, seen = frequent.value
        split = np.flatnonzero(seen > part_sets)
        wide, parts = last[split], -(-seen[split] // part_sets)
        waiting: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            token, head, comp, n, reach = merge_postings(*(np.concatenate(x) for x in zip(*waiting)))
            bucket = ((token >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            if len(wide):
                at = np.minimum(np.searchsorted(wide, token), len(wide) - 1)
                hot = np.flatnonzero(wide[at] == token)
                if len(hot):
                    # each pair of parts of a long list meets in one bucket: a posting goes to all pairs of its own part
                    k = parts[at[hot]]
                    copy = np.repeat(hot, k)
                    other = np.arange(len(copy)) - np.repeat(np.cumsum(k) - k, k)
                    own = mix(head[copy].view(np.uint64)).view(np.int64) % np.repeat(k, k)
                    low, high = np.minimum(own, other), np.maximum(own, other)
                    far = buckets + (token[copy] >> np.uint64(8)).astype(np.int64) * 65536 % (1 << 55) + low * 256 + high
                    keep = np.ones(len(token), dtype=bool)
                    keep[hot] = False
                    token, head, comp, n, reach, bucket = (np.concatenate([x[keep], x[copy]]) for x in (token, head, comp, n, reach, bucket))
                    bucket[len(bucket) - len(copy) :] = far
                    order = np.argsort(bucket, kind="stable")
                    token, head, comp, n, reach, bucket = (x[order] for x in (token, head, comp, n, reach, bucket))
            names, starts = np.unique(bucket, return_index=True)
            cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)]))
            columns = [pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (token, head, comp, n.astype(np.int32), reach.astype(np.int32))]
            return pa.RecordBatch.from_arrays([pa.array(names), *columns], names=["bucket", *PACKED])

        for batch in batches:
            prefixes = [np.frombuffer(x, np.uint64) for x in batch.column(4).to_pylist()]
            if not prefixes:
                continue
            length = np.array([len(x) for x in prefixes])
            token = np.concatenate(prefixes)
            place = np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length)
            head, comp, n = (np.repeat(batch.column(k).to_numpy(), length) for k in (1, 2, 3))
            waiting.append((token, head, comp, n, 4 * n - 7 * place))
            size += len(token)
            if size >= FLUSH_POSTINGS:
                yield flush()
                waiting, size = [], 0
        if waiting:
            yield flush()
            waiting = []
        trim()

    return placed.select("node", "head", "comp", "n", "prefix").mapInArrow(run, "bucket long, tokens binary, heads binary, comps binary, sizes binary, reaches binary")


PACKED = {"tokens": np.uint64, "heads": np.int64, "comps": np.int64, "sizes": np.int32, "reaches": np.int32}


class Blocks:
    """Bounds of runs of BLOCK, BLOCK^2, … entries: the farthest reach, and the component if all have one (else -1)."""

    def __init__(self, reach: np.ndarray, comp: np.ndarray) -> None:
        self.reach, self.comp = [reach], [comp]
        while len(self.reach[-1]) > BLOCK:
            at = np.arange(0, len(self.reach[-1]), BLOCK)
            low, high = np.minimum.reduceat(self.comp[-1], at), np.maximum.reduceat(self.comp[-1], at)
            self.reach.append(np.maximum.reduceat(self.reach[-1], at))
            self.comp.append(np.where(low == high, low, -1))

    def find(self, i: np.ndarray, first: np.ndarray, end: np.ndarray, need: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j): entries j of [first, end) with reach of at least ``need`` and another component than entry i.

        Blocks that can't hold one are skipped whole; at most PAIR_SLICE blocks or so are looked at together.
        """
        yield from self._down(len(self.reach) - 1, i, first, end, need)

    def _down(self, level: int, i: np.ndarray, first: np.ndarray, end: np.ndarray, need: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        width = BLOCK**level
        low, count = first // width, -(-end // width) - first // width
        upto, at = np.cumsum(count), 0
        while at < len(i):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIR_SLICE, "right")))
            c = count[at:stop]
            own = np.repeat(np.arange(at, stop), c)
            block = np.arange(len(own)) - np.repeat(np.cumsum(c) - c, c) + low[own]
            fit = (self.reach[level][block] >= need[own]) & (self.comp[level][block] != self.comp[0][i[own]])
            own, block = own[fit], block[fit]
            if len(own) and level:
                yield from self._down(level - 1, i[own], np.maximum(first[own], block * width), np.minimum(end[own], (block + 1) * width), need[own])
            elif len(own):
                yield i[own], block
            at = stop


def pairs_in_bucket(token: np.ndarray, head: np.ndarray, comp: np.ndarray, n: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of clusters of different components; each list's blocks are skipped by size, place and component."""
    token, head, comp, n, reach = merge_postings(token, head, comp, n, reach)
    if not len(token):
        return
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    mixed = np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)
    keep = np.repeat(mixed, np.diff(np.r_[starts, len(token)]))
    if not keep.any():
        return
    token, head, comp, n, reach = (x[keep] for x in (token, head, comp, n.astype(np.int64), reach.astype(np.int64)))
    number = np.cumsum(np.r_[True, token[1:] != token[:-1]]) - 1
    place = number << 33 | n
    order = np.argsort(place, kind="stable")
    number, place, head, comp, n, reach = (x[order] for x in (number, place, head, comp, n, reach))
    # partners that are not smaller: up to a third of the entry's reach
    first = np.arange(1, len(n) + 1)
    end = np.searchsorted(place, number << 33 | np.maximum(reach // 3, 0), "right")
    asks = np.flatnonzero(end > first)
    for i, j in Blocks(reach, comp).find(asks, first[asks], end[asks], 3 * n[asks]):
        both = np.unique(np.stack([np.minimum(head[i], head[j]), np.maximum(head[i], head[j])], axis=1), axis=0)
        yield both[:, 0], both[:, 1]


def candidates(packed: DataFrame) -> DataFrame:
    """(a, b) of clusters of different components whose prefixes meet; a task holds one bucket and a slice of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
            for a, b in pairs_in_bucket(*(np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*rows), PACKED.values()))):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        bucket, rows = None, []
        for batch in batches:
            for name, *row in zip(*(batch.column(c).to_pylist() for c in ["bucket", *PACKED])):
                if name != bucket and rows:
                    yield from pairs(rows)
                    rows = []
                bucket = name
                rows.append(row)
        if rows:
            yield from pairs(rows)
            rows = []
        trim()

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long").distinct()


def search_index(placed: DataFrame, nodes: DataFrame, radius: DataFrame | None, frequent) -> DataFrame:
    """(a, b, reach), written: pairs of clusters of ``placed`` (node, head, comp, n, prefix) that may hold a link."""
    spark = placed.sparkSession
    total = placed.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // BUCKET_POSTINGS) + 1)
    found = materialise(candidates(postings(placed, buckets, frequent)), "candidates")
    reach = F.lit(0.25)
    pairs = found
    for end in "ab" if radius is not None else "":
        pairs = pairs.join(bounded(radius.select(F.col("head").alias(end), F.col("radius").alias(f"radius_{end}"))), end, "left")
        reach = reach + F.coalesce(f"radius_{end}", F.lit(0.0))
    pairs = materialise(pairs.select("a", "b", reach.cast("double").alias("reach")), "reaches")
    far = materialise(plausible(pairs, nodes), "plausible")
    forget(found, pairs)
    return far


# ---- answers of members, derived from their heads'


def member_answers(open_pairs: DataFrame, homes: DataFrame, radius: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, other, n_a, n_b, common, distance, spare) of members against the head of the other cluster.

    A member's intersection is its head's, less the lost tokens that the other head holds, and with the gained ones. Members
    that the distances rule out are left out; ``spare`` is how far the other cluster's members may stand off its head.
    """
    spare = radius.select(F.col("head").alias("other"), "radius")
    ways = [open_pairs.select(F.col(x).alias("head"), F.col(y).alias("other"), F.col(f"n_{x}").alias("n_head"), F.col(f"n_{y}").alias("n_other"), F.col("common").alias("common_head"), F.col("distance").alias("apart")) for x, y in ("ab", "ba")]
    asked = ways[0].union(ways[1]).join(bounded(spare), "other", "left").withColumn("spare", F.coalesce("radius", F.lit(0.0))).drop("radius")
    # a large cluster's members are dealt to several tasks, and so are the members that ask one other head
    hot = hot_keys(homes.groupBy(F.lit("head").alias("end"), F.col("head").alias("key")).agg(F.count("*").alias("n")))
    members = join_hot(homes, asked, "head", "node", hot).filter(F.col("apart") - F.col("distance") <= 0.25 + F.col("spare") + MARGIN)
    members = materialise(members.select("node", "other", "n_head", "n_other", "common_head", "spare", "lost", "gained"), "asked")
    hot = hot_keys(members.groupBy(F.lit("other").alias("end"), F.col("other").alias("key")).agg(F.count("*").alias("n")))
    rows = join_hot(members, sets.select(F.col("node").alias("other"), "tokens"), "other", "node", hot)
    rows = rows.select("node", "other", "n_head", "n_other", "common_head", "spare", "lost", "gained", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, other, n_head, n_other, common, spare, lost, gained, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                less, more, of = (np.frombuffer(x, np.uint64) for x in (lost, gained, tokens))
                n, common = n_head - len(less) + len(more), common - int(np.count_nonzero(held(of, less))) + int(np.count_nonzero(held(of, more)))
                out.append((node, other, n, n_other, common, 1 - common / (n + n_other - common), spare))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["node", "other", "n_a", "n_b", "common", "distance", "spare"])
        trim()

    return rows.mapInArrow(run, "node long, other long, n_a long, n_b long, common long, distance double, spare double")


# ---- components


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for nodes of a written edge table (a, b); large-star, then small-star.

    The minima are written before they are joined: the hub of a star is broadcast, or its rows are split by AQE.
    """
    own = False  # the caller's edges stay
    while True:
        both = edges.union(edges.select("b", "a"))
        low = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "minima")
        large = both.join(bounded(low), both.a == low.u).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialise(large, "stars")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = materialise(down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"), "minima")
        hung = down.join(bounded(least), down.a == least.u)
        small = hung.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        small = materialise(small, "stars")
        forget(large, low, least, *[edges] * own)
        own = True
        # a star forest is reached when every node hangs on one root that hangs on none
        stars = small.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
        open_ends = small.join(small.select(F.col("a").alias("inner")).distinct(), F.col("b") == F.col("inner"), "left_semi")
        if stars.filter("n > 1").isEmpty() and open_ends.isEmpty():
            return small.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = small


# ---- the join


def linked_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written: rows (doc_id, mark, n, sig), and (sig, root, component_id) of every class of equal sets."""
    spark = docs.sparkSession
    small_batches(spark)
    began = steps()
    profile = materialise(profiles(docs), "profiles")
    frequent = spark.sparkContext.broadcast(frequent_tokens(profile))
    rows = profile.filter("token IS NULL").select("doc_id", "mark", "n", "sig")
    classes = materialise(set_classes(rows), "classes")
    nodes = materialise(representatives(texts_of(docs, classes), frequent), "nodes")

    pairs = materialise(leader_pairs(nodes), "leaders")
    leaders = materialise(plausible(pairs, nodes), "plausible")
    sets = token_sets(docs, classes, leaders.select(F.col("a").alias("node")).union(leaders.select("b")))
    near = materialise(intersections(leaders, sets), "near")
    forget(pairs, leaders, sets)
    homes = materialise(cluster_homes(near), "homes")
    radius = materialise(homes.groupBy("head").agg(F.max("distance").alias("radius")), "radius")
    links = materialise(near.filter(LINKED).select("a", "b"), "links")
    comp = bounded(components(links).withColumnRenamed("root", "up"))
    placed = nodes.join(comp, "node", "left").join(bounded(homes.select("node", "head")), "node", "left")
    placed = placed.select("node", "n", F.coalesce("head", "node").alias("head"), F.coalesce("up", "node").alias("comp"), "prefix")

    far = search_index(placed, nodes, radius, frequent)
    sets = token_sets(docs, classes, far.select(F.col("a").alias("node")).union(far.select("b")))
    met = materialise(intersections(far, sets).filter(F.col("distance") <= F.col("reach") + MARGIN), "met")
    links = links.union(met.filter(LINKED).select("a", "b"))
    unsure = met.filter(f"NOT ({LINKED})")
    if not unsure.isEmpty():  # clusters that head links have joined meanwhile need no answers from each other
        links = materialise(links, "links")
        joined = bounded(components(links))
        for end in "ab":
            unsure = unsure.join(joined.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
        unsure = materialise(unsure.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).drop("root_a", "root_b"), "unsure")
    if not unsure.isEmpty():
        answers = materialise(member_answers(unsure, homes, radius, sets), "answers")
        links = links.union(answers.filter(LINKED).select(F.col("node").alias("a"), F.col("other").alias("b")))
        left = answers.filter(f"NOT ({LINKED})").filter(F.col("distance") <= 0.25 + F.col("spare") + MARGIN).filter("spare > 0").select("node").distinct()
        if not left.isEmpty():  # members that may link with members: the same index, a set each
            again = materialise(placed.join(left, "node", "left_semi").withColumn("head", F.col("node")), "members")
            rest = search_index(again, nodes, None, frequent)
            rest_sets = token_sets(docs, classes, rest.select(F.col("a").alias("node")).union(rest.select("b")))
            links = links.union(intersections(rest, rest_sets).filter(LINKED).select("a", "b"))
    links = materialise(links.distinct(), "links")
    forget(nodes, near, homes, radius, far, sets, met)

    roots = bounded(components(links))
    named = materialise(classes.join(roots, "node", "left").select("sig", F.coalesce("root", "node").alias("root"), "doc_id"), "roots")
    least = materialise(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    found = materialise(named.drop("doc_id").join(bounded(least), "root").select("sig", "root", "component_id"), "found")
    forget_since(began, profile, found)
    return rows, found


def plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def join_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    rows, found = linked_sets(plain(docs, id_col, text_col))
    out = rows.join(bounded(found.select(F.col("sig").alias("of"), "component_id")), rows.sig == F.col("of"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, of which one for each component stays.

    It is the row with the smallest doc_id (rows without one come last), then with the smallest text hash; of repeats of
    that row one stays. Rows with an empty set are linked with nothing and stay.
    """
    rows, found = linked_sets(plain(docs, id_col, text_col))
    keys = rows.filter("sig IS NOT NULL").groupBy("sig", "doc_id", "mark").agg(F.count("*").alias("copies"))
    keys = keys.join(bounded(found.select("sig", "root")), "sig").groupBy("root", "doc_id", "mark").agg(F.sum("copies").alias("copies"))
    keys = materialise(keys.withColumn("none", F.col("doc_id").isNull()), "keys")
    first = materialise(keys.groupBy("root").agg(F.min(F.struct("none", "doc_id", "mark")).alias("first")), "first")
    stays = keys.join(bounded(first), "root").withColumn("stays", F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.mark") == F.col("mark")))
    own_id, own_mark, of_id, of_mark = (f"{x}_{uuid4().hex}" for x in ("own_id", "own_mark", "of_id", "of_mark"))
    # rows that go, and rows that stay but have repeats, of which one is added again
    out = materialise(stays.filter("NOT stays OR copies > 1").select(F.col("doc_id").alias(of_id), F.col("mark").alias(of_mark), "stays"), "leaving")
    tagged = docs.withColumns({own_id: docs[id_col].cast("long"), own_mark: F.xxhash64(docs[text_col].cast("string"))})
    same = F.col(own_id).eqNullSafe(F.col(of_id)) & (F.col(own_mark) == F.col(of_mark))
    kept = tagged.join(bounded(out.drop("stays")), same, "left_anti")
    repeated = out.filter("stays")
    if not repeated.isEmpty():
        kept = kept.union(tagged.join(bounded(repeated.drop("stays")), same, "left_semi").dropDuplicates([own_id, own_mark]))
    return kept.drop(own_id, own_mark)
