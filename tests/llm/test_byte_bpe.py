"""Byte-level BPE against the library that owns the format, and its matrices against one merge at a time."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from loomline.llm import byte_bpe

ALPHABET = "abehit 'ÀßΣ01²\x85\xa0\x1c_#-é́中😀\n\t"


@pytest.fixture(scope="module")
def model():
    return byte_bpe.load(byte_bpe.default_path(), byte_bpe.default_pattern())


@pytest.fixture(scope="module")
def library(model):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=model.ranks, special_tokens={})


def one_by_one(ranks, piece):
    """Merge the leftmost pair of least rank until none is left."""
    at = [bytes([b]) for b in piece]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(at, at[1:])) if a + b in ranks]
        if not found:
            return [ranks[w] for w in at]
        _, i = min(found)
        at[i:i + 2] = [at[i] + at[i + 1]]


def test_equals_library(model, library):
    rng = random.Random(5)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = ["", "a" * 5000, " " * 3000, "x" * 200_000, some("abcdefghijklmnopqrstuvwxyz", 50_000), some(ALPHABET, 200_000), "<|endoftext|> it's  \n\n x", *[some(ALPHABET, rng.randint(0, 80)) for _ in range(800)], *[some("ab", rng.randint(0, 300)) for _ in range(200)]]
    got = [np.frombuffer(b"".join(parts), "<u4").tolist() for parts in model.packed(texts)]
    assert got == [library.encode_ordinary(t) for t in texts] and model.encode(None) == []
    assert all(model.decode(ids) == t.encode() for ids, t in zip(got, texts))


def test_every_code_point(model, library):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for k in range(0, len(chars), 4096):
        t = "".join(f"a{c}1{c} " for c in chars[k:k + 4096])
        assert model.encode(t) == library.encode_ordinary(t)


@pytest.mark.parametrize("seed", range(6))
def test_small_vocabularies(seed):
    """Vocabularies made at random, where a token's own bytes may merge to other tokens: then one merge a round."""
    rng = random.Random(seed)
    words = {bytes([b]) for b in range(256)}
    while len(words) < 256 + 60:
        a, b = rng.choice(sorted(w for w in words if set(w) <= set(b"abc"))), rng.choice(sorted(w for w in words if set(w) <= set(b"abc")))
        words.add(a + b)
    order = sorted(words, key=len) if seed % 2 else [bytes([b]) for b in range(256)] + rng.sample(sorted(w for w in words if len(w) > 1), 60)
    ranks = {w: i for i, w in enumerate(order)}
    model = byte_bpe.ByteBPE(ranks, r"\S+|\s+")
    pieces = [bytes(rng.choice(b"abc") for _ in range(rng.choice([0, 1, 2, 5, 9, 40, 90]))) for _ in range(300)]
    assert [x.tolist() for x in model.merge(pieces)] == [one_by_one(ranks, p) for p in pieces]


def test_digests_and_columns(spark, library):
    rows = [(1, None, 0), (2, "", 0), (3, "word " * 60_000 + "é" * 5000, 0), (4, "same text", 0), (4, "same text", 0), (None, "x<|endoftext|>y", 0), *[(10 + i, f"row {i} has\nits {i * i} words", 0) for i in range(300)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS int").repartition(2)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())] += 1
    assert Counter(map(tuple, byte_bpe.digests(df).collect())) == want
    both = byte_bpe.decode(byte_bpe.encode(df), ids_col="ids_")
    assert both.columns == ["doc_id", "text", "IDS", "ids_", "decoded"]
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() and r["ids_"] == library.encode_ordinary(r["text"] or "") for r in both.collect())
    assert byte_bpe.digests(df.limit(0)).count() == 0 and byte_bpe.encode(df.limit(0)).count() == 0


def test_memory_of_pieces_starts_again(model, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECE_BYTES", 2000)
    monkeypatch.setattr(byte_bpe, "AT_ONCE", 50)
    own = byte_bpe.ByteBPE(model.ranks, byte_bpe.default_pattern())
    text = " ".join(f"zq{i}xv" for i in range(400))
    assert own.encode(text) == library.encode_ordinary(text) and own.held < 20_000
