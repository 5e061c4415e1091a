"""Byte-level BPE by speculation: greedy longest match proposes, pair checks verify, only failures are merged exactly.

A token sequence is the BPE encoding of a word exactly when every token encodes to itself and every adjacent pair,
encoded alone, stays that pair. Longest match finds such a sequence for nearly all words; the pairs of a whole batch of
words are checked together in numpy, and words with a failing pair are merged rank by rank.

Null text counts as empty; an empty text has no tokens and decodes to the empty text. Special strings inside a text
become their added tokens, as the tokenizers library does by default. Repeated rows give repeated rows.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from paperloom.llm.common import keep, map_texts

#: Fixed value: the pre-token pattern of the byte-level scheme.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space between two characters that no definition calls white space always starts a pre-token.
CUT = re.compile(r"(?<=\S) (?=\S)")
RARE_SPACE = re.compile(r"[^\S \n]")
#: Entries that a worker's cache holds before it is emptied.
CACHE_ENTRIES = 250_000
GROUP_TEXTS = 256
#: Words of up to so many bytes are merged together, a batch at a time.
SHORT_BYTES = 256

ENCODED = "doc_id long, n_tokens long, ids binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: visible Latin-1 characters stand for themselves, the rest follow from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(shifted)}


class LookupTable:
    """Integers to integers by open addressing; a whole array of keys is looked up at once, -1 where absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(8, int(4 * len(keys)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(self.mask + 1, -1, dtype=np.int64)
        self.values = np.full(self.mask + 1, -1, dtype=np.int64)
        keys, values = np.asarray(keys, dtype=np.int64), np.asarray(values, dtype=np.int64)
        slots = self.slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            taken, first = np.unique(np.where(free, slots, -1), return_index=True)
            first = first[taken >= 0]
            self.keys[slots[first]], self.values[slots[first]] = keys[first], values[first]
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slots = self.slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], -1)
        live = np.flatnonzero((found != keys) & (found >= 0))
        while len(live):
            slots[live] = (slots[live] + 1) & self.mask
            found = self.keys[slots[live]]
            same = found == keys[live]
            out[live[same]] = self.values[slots[live[same]]]
            live = live[~same & (found >= 0)]
        return out


class BytePairCoder:
    """Encoder and decoder over one vocabulary file; tokens are handled by rank (256 bytes, then merges in order)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError("only byte-level vocabularies without a normalizer are supported")
        to_byte = byte_alphabet()
        vocab = spec["model"]["vocab"]
        raw = {piece: bytes(to_byte[c] for c in piece) for piece in vocab}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        singles = sorted((p for p in vocab if len(raw[p]) == 1), key=lambda p: raw[p])
        order = [*singles, *(a + b for a, b in merges)]
        self.rank_of = {raw[p]: r for r, p in enumerate(order)}
        if len(self.rank_of) != len(order) or len(singles) != 256:
            raise ValueError("each merge must make a new token, and all 256 bytes must be tokens")
        self.ids = np.array([vocab[p] for p in order], dtype="<u4")
        self.left = np.arange(len(order), dtype=np.int64)
        self.right = self.left.copy()
        for r, (a, b) in enumerate(merges, 256):
            self.left[r], self.right[r] = self.rank_of[raw[a]], self.rank_of[raw[b]]
        self.base = n = len(order)
        keys = self.left[256:] * n + self.right[256:]
        self.merged_at = dict(zip(keys.tolist(), range(256, n)))
        self.byte_rank = [self.rank_of[bytes([b])] for b in range(256)]
        self.byte_ranks = np.array(self.byte_rank, dtype=np.int64)
        self.pairs = LookupTable(keys, np.arange(256, n))
        #: Tokens that encode to themselves; longest match may propose no others.
        own = np.ones(n, dtype=bool)
        grown = np.arange(256, n)
        own[256:] = self.compatible(self.left[256:], self.right[256:], grown)
        for r in range(256, n):
            own[r] &= own[self.left[r]] and own[self.right[r]]
        self.build_trie(own)
        size = max(int(self.ids.max()), *(t["id"] for t in spec["added_tokens"] or [{"id": 0}])) + 1
        self.bytes_of = [b""] * size
        for raw_bytes, r in self.rank_of.items():
            self.bytes_of[int(self.ids[r])] = raw_bytes
        self.added = {}
        for t in spec["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError("added tokens that take in their surroundings are not supported")
            self.added[t["content"]] = np.array([t["id"]], dtype="<u4").tobytes()
            self.bytes_of[t["id"]] = t["content"].encode()
        self.added_split = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.words = regex.compile(PATTERN)
        self.cache: dict[str, bytes] = {}
        self.merged_exactly = 0

    def compatible(self, first: np.ndarray, second: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """For each pair: does no merge below ``below`` (default: any) cross the border while both tokens are built?

        The pair is taken apart from the border outwards, the youngest merge first; a crossing merge that comes before
        the merge just undone would have happened instead.
        """
        a, b = first.astype(np.int64).copy(), second.astype(np.int64).copy()
        limit = np.full(len(a), len(self.ids), dtype=np.int64) if below is None else below.astype(np.int64).copy()
        fine, live = np.ones(len(a), dtype=bool), np.arange(len(a))
        n = self.base
        while len(live):
            x, y = a[live], b[live]
            keys = x * n + y
            rank = self.pairs.get(keys)
            crosses = (rank >= 0) & (rank < limit[live])
            fine[live[crosses]] = False
            go = ~crosses
            live, x, y = live[go], x[go], y[go]
            # undo the younger of the two border merges; on a tie the left one happened first, so the right one is undone
            undo_left = (x >= 256) & ((y < 256) | (x > y))
            undo_right = (y >= 256) & ~undo_left
            limit[live] = np.where(undo_left, x, np.where(undo_right, y + 1, limit[live]))
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_right, self.left[y], y)
            live = live[undo_left | undo_right]
        return fine

    def build_trie(self, own: np.ndarray) -> None:
        """Nodes are numbered; the tokens that encode to themselves end at nodes."""
        child: dict[int, int] = {}
        token_at = [-1] * 257
        for raw_bytes, rank in self.rank_of.items():
            if not own[rank]:
                continue
            node = raw_bytes[0] + 1
            for b in raw_bytes[1:]:
                node = child.setdefault(node * 256 + b, len(token_at))
                if node == len(token_at):
                    token_at.append(-1)
            token_at[node] = rank
        self.token_at = np.array(token_at, dtype=np.int64)
        self.children = LookupTable(np.fromiter(child.keys(), np.int64), np.fromiter(child.values(), np.int64))

    def propose(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match for all words of a batch: the tokens in order, and where each starts."""
        until = np.repeat(ends, lengths)
        node = data.astype(np.int64) + 1
        best, size = self.byte_ranks[data], np.ones(len(data), dtype=np.int64)
        live, depth = np.arange(len(data)), 1
        while len(live):
            live = live[live + depth < until[live]]
            step = self.children.get(node[live] * 256 + data[live + depth])
            live, step = live[step >= 0], step[step >= 0]
            node[live] = step
            depth += 1
            token = self.token_at[step]
            ends_here = token >= 0
            best[live[ends_here]], size[live[ends_here]] = token[ends_here], depth
        at, first = starts[lengths > 0], np.zeros(len(data), dtype=bool)
        while len(at):
            first[at] = True
            nxt = at + size[at]
            at = nxt[nxt < until[at]]
        places = np.flatnonzero(first)
        return best[places], places

    def merge_batch(self, parts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many short words together: each round, every word makes its first merge of lowest rank."""
        n, none = self.base, np.int64(1) << 40
        done_parts, done_owner = [], []

        def ranks_of(at: np.ndarray) -> np.ndarray:
            nxt = np.minimum(at + 1, len(parts) - 1)
            inside = (nxt > at) & (owner[nxt] == owner[at])
            found = self.pairs.get(parts[at] * n + parts[nxt])
            return np.where(inside & (found >= 0), found, none)

        ranks = ranks_of(np.arange(len(parts)))
        while len(parts):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            where = np.arange(len(parts))
            lowest = np.minimum.reduceat(ranks * len(parts) + where, starts)
            rank, at = lowest // len(parts), lowest % len(parts)
            active = rank < none
            keep = np.repeat(active, np.diff(np.r_[starts, len(parts)]))
            done_parts.append(parts[~keep])
            done_owner.append(owner[~keep])
            at = at[active]
            parts[at] = rank[active]
            keep[at + 1] = False
            new_at = np.cumsum(keep)[at] - 1
            parts, owner, ranks = parts[keep], owner[keep], ranks[keep]
            if len(parts):
                ranks[new_at] = ranks_of(new_at)
                left = new_at[new_at > 0] - 1
                ranks[left] = ranks_of(left)
        parts, owner = np.concatenate(done_parts), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return parts[order], owner[order]

    def merge_long(self, word: bytes) -> list[int]:
        """Exact merging of one long word with a heap: n log n."""
        n, known = self.base, self.merged_at
        parts: list[int | None] = list(map(self.byte_rank.__getitem__, word))
        after, before = [*range(1, len(parts)), -1], list(range(-1, len(parts) - 1))
        heap = [(rank, k) for k in range(len(parts) - 1) if (rank := known.get(parts[k] * n + parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            nxt = after[k] if parts[k] is not None else -1
            if nxt < 0 or known.get(parts[k] * n + parts[nxt]) != rank:
                continue
            parts[k], parts[nxt] = rank, None
            after[k] = after[nxt]
            if after[k] >= 0:
                before[after[k]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right >= 0 and (r := known.get(parts[left] * n + parts[right])) is not None:
                    heapq.heappush(heap, (r, left))
        return [p for p in parts if p is not None]

    def learn(self, words: list[str]) -> None:
        """Encode words the worker hasn't met: propose for all, check all their pairs, merge exactly where one fails."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        word_of = np.repeat(np.arange(len(raw)), lengths)
        tokens, places = self.propose(data, starts, ends, lengths)
        owner = word_of[places]
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        bad = np.zeros(len(raw), dtype=bool)
        bad[owner[inner[~self.compatible(tokens[inner], tokens[inner + 1])]]] = True
        self.merged_exactly += int(bad.sum())
        good = ~bad[owner]
        found, owners = [tokens[good]], [owner[good]]
        if (short := bad & (lengths <= SHORT_BYTES)).any():
            of = short[word_of]
            merged, merged_owner = self.merge_batch(self.byte_ranks[data[of]], word_of[of])
            found.append(merged)
            owners.append(merged_owner)
        for k in np.flatnonzero(bad & (lengths > SHORT_BYTES)).tolist():
            merged = self.merge_long(raw[k])
            found.append(np.array(merged, dtype=np.int64))
            owners.append(np.full(len(merged), k, dtype=np.int64))
        flat, owner = np.concatenate(found), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        codes = self.ids[flat[order]].tobytes()
        stops = (4 * np.cumsum(np.bincount(owner, minlength=len(raw)))).tolist()
        begin = 0
        for word, stop in zip(words, stops):
            self.cache[word] = codes[begin:stop]
            begin = stop

    def learn_chunks(self, chunks: set[str]) -> None:
        """Fill the cache for chunks; a chunk that is one pre-token shares its entry with that word."""
        known, split, new = self.cache, {}, set()
        for chunk in chunks:
            if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
                new.add(chunk)
            else:
                split[chunk] = words = self.words.findall(chunk)
                new.update([w for w in words if w not in known])
        if new:
            self.learn(list(new))
        for chunk, words in split.items():
            known[chunk] = b"".join([known[w] for w in words])

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Spans whose borders are pre-token borders in any context; joined by nothing they are the text."""
        if not text:
            return []
        plain = not ("  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or RARE_SPACE.search(text))
        parts = text.split(" ") if plain else CUT.split(text)
        return [parts[0], *[" " + p for p in parts[1:]]]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        pieces: list[list[str | bytes]] = []
        for text in texts:
            if self.added_split and any(a in text for a in self.added):
                own: list[str | bytes] = []
                at = 0
                for m in self.added_split.finditer(text):
                    own += [*self.chunks(text[at : m.start()]), self.added[m[0]]]
                    at = m.end()
                pieces.append(own + self.chunks(text[at:]))
            else:
                pieces.append(self.chunks(text))
        # the cache is emptied between groups of texts only, so all chunks of a group are in it
        out: list[bytes] = []
        for at in range(0, len(pieces), GROUP_TEXTS):
            if len(self.cache) > CACHE_ENTRIES:
                self.cache.clear()
            known, some = self.cache, pieces[at : at + GROUP_TEXTS]
            if new := {c for p in some for c in p if c not in known and c.__class__ is str}:
                self.learn_chunks(new)
            for p in some:
                out.append(b"".join([known[c] if c.__class__ is str else c for c in p]))
        return out

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


@functools.cache
def coder(path: str) -> BytePairCoder:
    """One coder, with its caches, for each worker process and vocabulary, until another operator works there."""
    usual = gc.get_threshold()

    def drop() -> None:
        coder.cache_clear()
        gc.unfreeze()
        gc.set_threshold(*usual)

    keep("bpe", drop)
    gc.freeze()
    gc.set_threshold(100_000, 50, 50)  # millions of cached strings would be traversed again and again
    return BytePairCoder(path)


def _texts(texts: list[bytes | None]) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in texts]


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_tokens, ids (little-endian unsigned 32-bit)."""

    def make():
        bpe = coder(vocabulary)

        def work(ids, texts):
            codes = bpe.encode_batch(_texts(texts))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(c) // 4 for c in codes], pa.int64()), pa.array(codes, pa.binary())], names=["doc_id", "n_tokens", "ids"])

        return work

    return map_texts(df, id_col, text_col, ENCODED, make, "bpe")


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode from the ids, and return digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def make():
        bpe = coder(vocabulary)

        def work(ids, texts):
            codes = bpe.encode_batch(_texts(texts))
            columns = [
                pa.array(ids, pa.int64()),
                pa.array([len(c) // 4 for c in codes], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in codes]),
                pa.array([hashlib.sha256(bpe.decode(c).encode()).hexdigest() for c in codes]),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return work

    return map_texts(df, id_col, text_col, DIGESTS, make, "bpe")
