from __future__ import annotations

import hashlib
import random

import pytest
import public_tokenizers
import tiktoken

from maskwright.llm import byte_bpe as bb

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bb.read_ranks(PATH)


@pytest.fixture(scope="module")
def encoding(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec(ranks):
    return bb.Codec(bb.Tables(ranks, public_tokenizers.PATTERN))


def check(codec, encoding, texts):
    ids = codec.ids(texts)
    assert ids.to_pylist() == [encoding.encode_ordinary(t or "") for t in texts]
    assert codec.decode(ids).to_pylist() == [(t or "").encode() for t in texts]


def test_odd_texts(codec, encoding):
    check(codec, encoding, [
        "", None, "a" * 300, "a" * 3000, "ab" * 1000, "日本語のテキスト" * 100, " " * 500, "-" * 777 + "x",
        "<|endoftext|>", "é̀ ñ 🎉🎉 \u0000\n\n\n  x", "I'll we've'S", "\x1c \x85 a b", "٣٤ 12½",
    ])


def test_random_texts(codec, encoding):
    rng = random.Random(1)
    kinds = ["abcdeéß日 .,1\n", "abct", "".join(map(chr, range(128))), "thereinst "]
    for kind in kinds:
        check(codec, encoding, ["".join(rng.choice(kind) for _ in range(rng.randint(1, 400))) for _ in range(60)])


def test_every_class_boundary(codec, encoding):
    chars = [chr(x) for x in range(0x3100) if not 0xD800 <= x < 0xE000][::3]
    check(codec, encoding, ["a" + c + "1" + c + c + "!" + c + " " + c + "  " + c for c in chars])


def test_long_pieces_take_the_loop(ranks, encoding, monkeypatch):
    monkeypatch.setattr(bb, "LONG_PIECE", 3)
    rng = random.Random(2)
    own = bb.Codec(bb.Tables(ranks, public_tokenizers.PATTERN))
    check(own, encoding, ["".join(rng.choice("aethinrs") for _ in range(rng.randint(4, 60))) for _ in range(40)])


def test_small_cache(ranks, encoding, monkeypatch):
    monkeypatch.setattr(bb, "CACHE_PIECES", 5)
    own = bb.Codec(bb.Tables(ranks, public_tokenizers.PATTERN))
    for k in range(5):
        check(own, encoding, [f"somewordy thingy{k} qwzx" * 3, "again somewordy"])


def test_query_digests(spark, encoding):
    held = bb.tables(spark, PATH, public_tokenizers.PATTERN)
    docs = spark.createDataFrame(
        [(1, "plain text", 3), (2, None, 4), (2, "", 5), (None, "né " * 20_000, 6), (1, "plain text", 3)],
        "doc_id long, text string, ids int",
    )
    rows = bb.digests(bb.decode(bb.encode(docs, held), held)).collect()
    expected = []
    for doc, text, _ in docs.collect():
        ids = encoding.encode_ordinary(text or "")
        expected.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)
    assert sorted(map(tuple, bb.digests(bb.round_trip(docs, held)).collect()), key=str) == sorted(expected, key=str)
    assert bb.encode(docs.limit(0), held).count() == 0
