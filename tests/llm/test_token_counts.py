from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskwright.llm import queries
from maskwright.llm import token_counts as tc

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, "a", "A" * 3000, "ab" * 1000, "I'll we've they're 's'S 're're '", "日本語のテキスト" * 30, "-" * 777 + "x", "!'re ''ve x'l",
    "é̀ ñ é 🎉🎉 \u0000\n\n\n  x", "İstanbul ΣΑΣ ß", "\x1c \x85 a\x1cb​", "٣٤ 12½ ²",
    "<|endoftext|>", "a!!<|startoftext|>b <|endoftext|><|endoftext|> <|endoftex", "x" * 40 + "<|ENDOFTEXT|>", "ẛ̣ ﬁ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return tc.Counter(tc.Vocabulary(PATH))


def size(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_whole_texts(counter, library):
    rng = random.Random(1)
    kinds = ["abcdeéß日 .,1\n", "abct'", "".join(map(chr, range(128))), "thereinst ", "'lrevsdtm a", "aA<|>endoftx", "̧́‍eaß🎉中 "]
    texts = ODD + ["".join(rng.choice(k) for _ in range(rng.randint(1, 300))) for k in kinds for _ in range(60)]
    assert [int(counter.text_steps(t).sum()) for t in texts] == [size(library, t) for t in texts]


def test_every_prefix_equals_encoding_it_again(counter, library):
    rng = random.Random(2)
    texts = ["Strawberry shortcakes, I'll've 're're unbelievably-good!!! x<|endoftext|>y", "a!!<|startoftext|>b <|endoftex", "Überraschung für naïve 日本語 ñandú"]
    texts += ["".join(rng.choice("aethinrs'") for _ in range(60)) for _ in range(30)]
    for text in texts:
        upto = [0, *counter.text_steps(text).cumsum().tolist()]
        assert upto == [size(library, text[:k]) for k in range(len(text) + 1)]


def test_class_boundaries(counter, library):
    chars = [chr(x) for x in range(0x3100) if not 0xD800 <= x < 0xE000][::3] + [chr(x) for x in range(0x1E000, 0x20000, 31)]
    texts = ["a" + c + "1" + c + c + "!" + c + " " + c + "  " + c for c in chars]
    assert [int(counter.text_steps(t).sum()) for t in texts] == [size(library, t) for t in texts]
    assert [counter.budget(t, 9)[0] for t in texts] == [size(library, t) for t in texts]
    mixed = [f"{a}{b}x{a} 1{b}" for a in map(chr, range(0x250)) for b in "\xa0é'"]
    assert [counter.budget(t, 9)[0] for t in mixed] == [size(library, t) for t in mixed]


def test_budgets_are_the_last_place_within(counter):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("aethinrs' \n!é") for _ in range(80)) for _ in range(40)]
    for text in texts:
        counts = [0, *counter.text_steps(text).cumsum().tolist()]
        for budget in (0, 1, 2, 5, 11, 10**6):
            assert counter.budget(text, budget) == (counts[-1], max(k for k, n in enumerate(counts) if n <= budget))


def test_small_caches(library, monkeypatch):
    monkeypatch.setattr(tc, "CACHE_WORDS", 5)
    monkeypatch.setattr(tc, "CACHE_PAIRS", 3)
    own = tc.Counter(tc.Vocabulary(PATH))
    for k in range(5):
        text = f"somewordy thingy{k} qwzx again somewordy"
        assert int(own.text_steps(text).sum()) == own.budget(text, 3)[0] == size(library, text)


def test_stored_steps_answer_without_the_text(spark, library):
    held = tc.vocabulary(spark, PATH)
    texts = ["Unbelievable strawberries, I'll say!", None, "", "a " * 3000, "zzz<|endoftext|>"]
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, steps int")
    stored = tc.prefix_counts(docs, held)
    found = stored.select(
        "doc_id", tc.count_at(F.lit(9)).alias("at"), tc.fitting(4).alias("fit"), tc.over(4).alias("over"), tc.over(2999).alias("much")
    ).collect()
    for row in found:
        text = texts[row.doc_id] or ""
        fit = max(k for k in range(len(text) + 1) if size(library, text[:k]) <= 4) if len(text) < 100 else 8
        assert (row.at, row.fit, row.over, row.much) == (
            size(library, text[:9]), fit, size(library, text) > 4, size(library, text) > 2999)
    assert tc.prefix_counts(docs.limit(0), held).count() == 0


def test_query_equals_the_library(spark, library, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (5, "same id")], "doc_id long, text string")
    odd = odd.withColumn("n_tokens", F.lit("own"))
    docs.unionByName(odd, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    expected = [(d, len(t.encode()), size(library, t), size(library, t) > 2048) for d, t in texts]
    found = queries.op11_token_counts(spark, str(tmp_path)).collect()
    assert sorted([tuple(r)[:4] for r in found], key=str) == sorted(expected, key=str)
    by_id = dict(texts)
    for row in found:
        if row.n_tokens > 2048 and row.doc_id is not None and len(by_id[row.doc_id]) < 20_000 and by_id[row.doc_id].isascii():
            text = by_id[row.doc_id]
            assert size(library, text[: row.n_fit]) <= 2048
            later = range(row.n_fit + 1, min(row.n_fit + 30, len(text)) + 1)
            assert all(size(library, text[:k]) > 2048 for k in later)
