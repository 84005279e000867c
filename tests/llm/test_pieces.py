import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import pieces

MODEL = "piece_bpe_32k.model"
LIB = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))


def texts_of(n, seed):
    rng = random.Random(seed)
    parts = ["the", "Über", " ", "  ", "\n", "日本", "𝒳", "▁", "ing", "tion", "'", "a", "12", "é", "\0", "　", "word", "xyzzyx", "<s>", "</s>", "<0x41>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_ids_equal_the_library(spark):
    texts = texts_of(400, 1) + ["", None, " ", "a" * 5000, "ab" * 150 + " c", " " * 300, "née " * 2000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "x")], "doc_id long, text string, ids string")
    got = pieces.encode_decode(docs, keep=True).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == LIB.encode(text), text
        assert r["decoded"] == text.replace("▁", " ") == LIB.decode(r["ids"])


def test_whole_small_table_equals_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pieces.encode_decode(docs, keep=True).collect():
        assert r["ids"] == LIB.encode(texts[r["doc_id"]]) and r["decoded"] == texts[r["doc_id"]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    ids, bounds = pieces.Encoder(pieces.load_vocabulary(MODEL)).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == LIB.encode(texts)


def test_suffix_array_and_ranges():
    rng = np.random.default_rng(2)
    places = rng.integers(0, 4, 300)
    order, _ = pieces.suffix_array(places, 16)
    want = sorted(range(300), key=lambda i: (tuple(places[i : i + 16]) + (0,) * 16)[:16])
    key = lambda i: (tuple(places[i : i + 16]) + (0,) * 16)[:16]
    assert [key(i) for i in order] == [key(i) for i in want]
    v = pieces.load_vocabulary(MODEL)
    text = "the thing in the inn "
    at = v.places(np.array([ord(c) for c in text], dtype=np.uint32))
    edges = pieces.Edges(v, at)
    for a in range(len(text)):
        for n in range(2, 17):
            want = v.ids.get(text[a : a + n], -1) if a + n <= len(text) else -1
            assert edges.find(np.array([a]), np.array([n]))[0] == want


def test_empty_table(spark):
    assert pieces.encode_decode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def encode(texts):
    ids, bounds = pieces.Encoder(pieces.load_vocabulary(MODEL)).encode(texts)
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abdeinorst日本の言語é\0", max_size=60), max_size=5), st.integers(1, 12), st.integers(16, 60))
def test_long_parts_and_small_indexes_change_nothing(texts, long, indexed):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pieces, "LONG", long)
        patch.setattr(pieces, "INDEXED", indexed)
        assert encode(texts) == LIB.encode(texts)


def test_unspaced_texts():
    rng = random.Random(8)
    words = ["the", "ing", "over", "日本", "言語", "の", "tion", "x", "12", "zq"]
    texts = ["".join(rng.choice(words) for _ in range(n)) for n in (300, 5000, 60_000)] + ["日本語の文章" * 3000, "e" * 20_000, "return" * 4000 + "{" * 500]
    assert encode(texts) == LIB.encode(texts)


def test_a_million_unspaced_letters():
    rng = random.Random(9)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    assert encode([text]) == LIB.encode([text])
