"""Spelling variants: words of the corpus that are one edit apart, found by bands of letter-parity masks.

A word's mask has a bit for each letter, set if the letter occurs an odd number of times. One inserted, deleted or replaced
code point flips at most two bits, so of a mask's three bands at least one is the same in both words. Words therefore meet
in buckets of (band, value of the band, length), where a word also visits the bucket of the next length. In a bucket no pair
is looked at whose other two bands don't fit: a replaced letter leaves two words of one length equal in all bits but for
those of one letter of each, and a word with a letter more has the shorter one's bits after that letter is taken away. So
each word offers its bits less one letter, letter by letter, and only words with equal offers are compared, letter by
letter. A pair is reported by the first of its equal bands only. Buckets of frequent values are cut into parts, and each
pair of parts is a bucket of its own, so that a task holds a bounded number of words.

Letters and words: runs of A-Z, a-z and U+00C0 to U+00FF, of which A-Z are lower-cased. A run of a document may lose one
code point, as a checksum of its doc_id and the run decides (``typo_every``; 0 for none); that derives misspellings from the
table itself. Counts are over all documents. Null and empty texts hold no runs; a null doc_id counts as the empty string in
the checksum; repeated rows count again. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import forget, forget_since, materialise, small_batches, steps, trim

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
TYPO_EVERY, MIN_LENGTH, MIN_COUNT, FACTOR = 97, 5, 3, 2
#: Distinct words that a task counts before it hands its counts on.
HELD_WORDS = 300_000
BANDS, BAND_BITS = 3, 30
#: Letters in about the order of how often they occur, dealt to the bands in turn so that bands tell words apart alike.
ORDER = "etaoinsrhldcumfpgwybvkxjqz"
#: Words of a part of a bucket, words of small buckets that are looked through at once, and pairs that are compared together.
PART_WORDS = 20_000
HELD_ROWS = 20_000
PAIR_SLICE = 100_000
BROADCAST_ROWS = 1_000_000


def letter_bits() -> np.ndarray:
    """The bit of each code point in each band, 0 in the others: a-z by frequency, then the rest, dealt to the bands in turn."""
    bits = np.zeros((BANDS, 256), np.int64)
    for k, code in enumerate([*map(ord, ORDER), *range(0xE0, 0x100), *range(0xC0, 0xE0)]):
        bits[k % BANDS, code] = 1 << k // BANDS
    return bits


BITS = letter_bits()


# ---- words and their counts


def word_counts(docs: DataFrame, id_col: str, text_col: str, typo_every: int) -> DataFrame:
    """(word, n) of all words of at least MIN_LENGTH code points and MIN_COUNT occurrences."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            words = [w for w in found if len(w) >= MIN_LENGTH]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([found[w] for w in words], pa.int64())], names=["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                runs = Counter(RUNS.findall((text or b"").translate(LOWER).decode("utf-8", "replace")))
                if typo_every:
                    seed = crc32(f"{name or ''}:".encode())
                    for word in list(runs):
                        at = crc32(word.encode(), seed)
                        if at % typo_every == 0:
                            at %= len(word)
                            n = runs.pop(word)
                            found[word[:at] + word[at + 1 :]] += n
                found.update(runs)
                if len(found) >= HELD_WORDS:
                    yield flush()
        if found:
            yield flush()
        trim()

    parts = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


# ---- buckets and pairs


def buckets(words: DataFrame) -> DataFrame:
    """(bucket, own, word, n): each word in its three buckets and as a visitor in those of the next length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column(0), len(batch)
            if not n:
                continue
            text = [w.encode("latin-1") for w in words.to_pylist()]
            length = np.fromiter(map(len, text), np.int64, n)
            codes = np.frombuffer(b"".join(text), np.uint8)
            for band in range(BANDS):
                value = np.bitwise_xor.reduceat(BITS[band][codes], np.cumsum(length) - length)
                for visit in (0, 1):
                    bucket = ((length + visit) << 2 | band) << BAND_BITS | value
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(n, not visit)), words, batch.column(1)], names=["bucket", "own", "word", "n"])
        trim()

    return words.select("word", "n").mapInArrow(run, "bucket long, own boolean, word string, n long")


def in_parts(rows: DataFrame) -> DataFrame:
    """The rows with (low, high): rows of a large bucket go to each pair of parts that holds their own part."""
    large = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter(F.col("size") > PART_WORDS)
    large = materialise(large.select("bucket", F.ceil(F.col("size") / PART_WORDS).cast("int").alias("parts")), "large")
    # buckets of more than PART_WORDS rows each; beyond the bound the join shuffles
    side = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    dealt = rows.join(side, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).drop("parts", "other")


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.count_nonzero(a != b, axis=1) == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Does b, one longer, come from a by one insertion? What they share in front and behind covers all of a."""
    n = a.shape[1]
    front, behind = a == b[:, :n], (a == b[:, 1:])[:, ::-1]
    led = np.where(front.all(axis=1), n, np.argmin(front, axis=1))
    trailed = np.where(behind.all(axis=1), n, np.argmin(behind, axis=1))
    return led + trailed >= n


def equal_offers(offer: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): pairs of words with an equal offer, from offers in ascending order; each offer's words are held against the
    first behind them, then the second, while there are any."""
    at, step = np.arange(len(offer)), 1
    while len(at):
        at = at[at + step < len(offer)]
        at = at[offer[at] == offer[at + step]]
        yield word[at], word[at + step]
        step += 1


def taken_offers(offer: np.ndarray, word: np.ndarray, rest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): words with an offer that equals all bits of visitor j."""
    first, end = np.searchsorted(offer, rest, "left"), np.searchsorted(offer, rest, "right")
    count = end - first
    upto, at = np.cumsum(count), 0
    while at < len(rest):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIR_SLICE, "right")))
        c = count[at:stop]
        j = np.repeat(np.arange(at, stop), c)
        yield word[np.arange(len(j)) - np.repeat(np.cumsum(c) - c, c) + first[j]], j
        at = stop


def near_pairs(band: int, own: np.ndarray, visitors: np.ndarray, own_at: np.ndarray, visitor_at: np.ndarray, across: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Near words of some buckets of one band and length: (i, j) of own words, and (i, j) of own words and visitors.

    Words are rows of code points; ``own_at`` and ``visitor_at`` hold (bucket number, part) of each. ``across`` tells for each
    bucket whether only words of different parts are paired.
    """
    one, two = (k for k in range(BANDS) if k != band)
    bits = BITS[one] | BITS[two] << BAND_BITS
    kept = bits[own]
    row, column = np.nonzero(kept)
    offer = np.bitwise_xor.reduce(kept, axis=1)[row] ^ kept[row, column]
    names, offer = np.unique(offer, return_inverse=True)
    offer += own_at[0][row] * len(names)
    order = np.lexsort((row, offer))
    offer, row = offer[order], row[order]
    fresh = np.r_[True, (offer[1:] != offer[:-1]) | (row[1:] != row[:-1])] if len(row) else np.zeros(0, bool)
    offer, row = offer[fresh], row[fresh]
    rest = np.bitwise_xor.reduce(bits[visitors], axis=1)
    known = np.minimum(np.searchsorted(names, rest), max(0, len(names) - 1))
    rest = np.where(names[known] == rest, known + visitor_at[0] * len(names), -1) if len(names) else np.full(len(rest), -1)
    out = []
    for found, codes, at, near in ((equal_offers(offer, row), own, own_at, one_replaced), (taken_offers(offer, row, rest), visitors, visitor_at, lambda a, b: one_inserted(b, a))):
        pairs = [np.zeros(0, np.int64)]
        for i, j in found:
            for k in range(0, len(i), PAIR_SLICE):
                x, y = i[k : k + PAIR_SLICE], j[k : k + PAIR_SLICE]
                fit = ~across[own_at[0][x]] | (own_at[1][x] != at[1][y])
                x, y = x[fit], y[fit]
                for e in range(band):  # an earlier band that is equal reports the pair
                    differs = np.bitwise_xor.reduce(BITS[e][own[x]], axis=1) != np.bitwise_xor.reduce(BITS[e][codes[y]], axis=1)
                    x, y = x[differs], y[differs]
                fit = near(own[x], codes[y])
                pairs.append(x[fit] * len(codes) + y[fit])
        out.append(np.divmod(np.unique(np.concatenate(pairs)), max(1, len(codes))))
    return tuple(out)


def links(words: DataFrame) -> DataFrame:
    """(word, other, other_n): each pair of near words, both ways."""
    dealt = in_parts(materialise(buckets(words), "buckets"))

    def pairs_of(keys: np.ndarray, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Near words of whole buckets of one band and length; ``keys`` are the bucket's number and the three key columns."""
        number, bucket, low, high = keys
        length, band = int(bucket[0]) >> BAND_BITS + 2, int(bucket[0]) >> BAND_BITS & 3
        across = np.zeros(int(number[-1]) + 1, bool)
        across[number] = low != high
        own, part = rows.column("own").to_numpy(), rows.column("part").to_numpy()
        words, n = rows.column("word").combine_chunks(), rows.column("n").combine_chunks()
        places = [np.flatnonzero(own), np.flatnonzero(~own)]
        texts = words.to_pylist()
        codes = [np.frombuffer("".join([texts[k] for k in at.tolist()]).encode("latin-1"), np.uint8).reshape(len(at), size) for at, size in zip(places, (length, length - 1))]
        if not len(codes[0]):
            return
        at = [np.stack([number[p], part[p]]) for p in places]
        for (i, j), behind in zip(near_pairs(band, *codes, *at, across), places):
            ends = pa.array(places[0][i]), pa.array(behind[j])
            for x, y in (ends, ends[::-1]):
                yield pa.RecordBatch.from_arrays([words.take(x), words.take(y), n.take(y)], names=["word", "other", "other_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, last, size = [], [], None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, keys, size
            if held:
                yield from pairs_of(np.concatenate(keys, axis=1), pa.Table.from_batches(held))
            held, keys, size = [], [], 0

        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)])
            new = np.r_[last is None or bool((key[:, 0] != last).any()), (key[:, 1:] != key[:, :-1]).any(axis=0)]
            kind = key[0] >> BAND_BITS
            at = 0
            while at < len(batch):
                # rows up to where the length or the band changes, or where a bucket begins and enough rows are held
                stop = at + int(np.searchsorted(kind[at:], kind[at], "right"))
                if held and (keys[-1][1, -1] >> BAND_BITS != kind[at] or (size >= HELD_ROWS and new[at])):
                    yield from flush()
                begins = np.flatnonzero(new[at + 1 : stop]) + at + 1
                far = begins[begins - at + size >= HELD_ROWS]
                stop = int(far[0]) if len(far) else stop
                number = np.cumsum(new[at:stop]) + (int(keys[-1][0, -1]) if keys else -int(new[at]))
                keys.append(np.vstack([number, key[:, at:stop]]))
                held.append(batch.slice(at, stop - at))
                size += stop - at
                at = stop
            last = key[:, -1]
        yield from flush()
        trim()

    keys = ["bucket", "low", "high"]
    return dealt.select(*keys, "own", "part", "word", "n").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "word string, other string, other_n long")


# ---- forms and roots


def roots(forms: DataFrame) -> DataFrame:
    """(word, root), written, of a written table (word, form): pointers are doubled until all stand on words without form.

    A form occurs at least twice as often as its word, so chains have no rings and the rounds are few.
    """
    at = materialise(forms.select("word", F.col("form").alias("root")), "pointers")
    while True:
        jump = at.select(F.col("word").alias("by"), F.col("root").alias("far"))
        nxt = materialise(at.join(jump, F.col("root") == F.col("by"), "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "pointers")
        forget(at)
        at = nxt
        if at.filter("moved").isEmpty():
            return at.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typo_every: int = TYPO_EVERY) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word."""
    began = steps()
    words = materialise(word_counts(docs, id_col, text_col, typo_every), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("least"), F.col("other").alias("form"))).alias("best")
    near = links(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    named = words.join(near, "word", "left").withColumn("form_n", -F.col("best.least"))
    holds = F.col("form_n") >= FACTOR * F.col("n")
    named = materialise(named.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("best.form")).alias("form"), F.when(holds, F.col("form_n")).alias("form_n")), "forms")
    ends = roots(named.filter("form IS NOT NULL").select("word", "form"))
    out = materialise(named.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")), "variants")
    forget_since(began, out)
    return out
