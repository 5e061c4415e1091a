import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from paperloom.llm import bpe, token_counts

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

ODD = [
    "", " ", "   ", "a", "<|endoftext|>", "a<|endoftext|> b <|endoftext|>x", " a  b ", "a\n\n b\t c \n", "ab" * 500, "日本語 テスト   ", "²½ Ⅷ१२", "it's we'll I'M don't",
    "a\x1c b \x1f\x85 c", "  x 　y", "trail  ", "▁a▁▁ b▁", "a ▁ b", "</s> <s> [INST]", "\x00\x01", "é é", "🙂🙂 👩‍👩‍👧", "don't'll've",
]


def texts():
    rng = random.Random(5)
    alphabet = "ab cde's\n\t é日!1.▁<|>"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 90))) for _ in range(600)] + ["x" * 3000, "na" * 5000, "word " * 4000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x") for k, t in enumerate(texts())] + [(-1, None, "y"), (0, ODD[0], "again")]
    # an extra column that bears a result's name must not disturb
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_round_trip_equals_the_library(docs):
    library = Tokenizer.from_file(BYTE_BPE)
    got = {}
    for r in bpe.round_trip(docs, BYTE_BPE).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[0]) == 2
    for k, t in [*enumerate(texts()), (-1, "")]:
        ids = library.encode(t, add_special_tokens=False).ids
        r = got[k][0]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_ids_are_returned(docs):
    r = bpe.encode(docs.filter("doc_id = 3"), BYTE_BPE).first()
    assert np.frombuffer(r.ids, "<u4").tolist() == Tokenizer.from_file(BYTE_BPE).encode("a").ids


def test_both_ways_of_merging_agree():
    coder = bpe.BytePairCoder(BYTE_BPE)
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioutrnsl ") for _ in range(rng.randint(1, 60))).encode() for _ in range(300)]
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    parts, of = coder.merge_batch(coder.byte_ranks[data], owner)
    assert [parts[of == k].tolist() for k in range(len(words))] == [coder.merge_long(w) for w in words]


def test_speculation_fails_for_some_words_and_is_mended():
    coder = bpe.BytePairCoder(BYTE_BPE)
    coder.encode_batch(["thndouha thatble atre thananth hesh toaneaonwh haouer thtiinat bleshou"])
    assert coder.merged_exactly > 0


def test_cache_may_be_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(bpe, "GROUP_TEXTS", 2)
    coder, library = bpe.BytePairCoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    some = texts()[:60]
    assert [np.frombuffer(c, "<u4").tolist() for c in coder.encode_batch(some)] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]


def test_counts_equal_the_library(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, PIECES).collect()}
    for k, t in [*enumerate(texts()), (-1, "")]:
        assert (got[k].n_tokens, got[k].n_bytes) == (len(library.encode(t)), len(t.encode()))


def test_count_cache_may_be_emptied(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 5)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    lengths = token_counts.PretokenLengths(PIECES, {"word": 1})
    assert [lengths.count(t) for t in texts()] == [len(library.encode(t)) for t in texts()]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(none, BYTE_BPE).count() == 0
    assert token_counts.count_tokens(none, PIECES).count() == 0
