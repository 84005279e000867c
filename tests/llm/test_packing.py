import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import packing

HF = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_layout(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    slots, used = packing.plan(counts, 50)
    open_, seen = [], 0
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(open_) if r >= n]
        if fit:
            open_[min(fit, key=lambda i: open_[i])] -= n
        else:
            open_.append(50 - n)
    assert used == len(open_)
    assert sum(s.hi - s.lo for s in slots) == len(lengths)


def test_pack_matches_the_tokenizer_library(spark):
    rng = random.Random(5)
    words = ["the", "naïve", "x1", "<|endoftext|>", "日本", " ", "it's", "  ", "\n\n", "1234567", " ", "é́"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 60))) for _ in range(200)]
    texts += [None, "", "a " * 4000, "the end " * 1023 + "the", "z" * 5000, texts[3], texts[3]]
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in enumerate(texts)], "doc_id long, text string, rank int, salt string")
    rows = packing.pack(docs, keep_ids=True).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        ids = got.setdefault(r["doc_id"], [])
        assert r["start"] == len(ids) and r["length"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert r["length"] == 2048 or r["piece"] == 0
        ids += r["ids"]
    assert got == {i: [*HF.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    check_layout(rows, 2048)


def test_pack_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty).count() == 0
    same = spark.createDataFrame([(1, "one two")] * 5 + [(None, "x")], "doc_id long, text string")
    rows = packing.pack(same, capacity=7).collect()
    assert len(rows) == 6
    assert check_layout(rows, 7) == 3


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "\n", "\t", "\r\n", "  ", "日", "é", "\u3000", "\x85", "\xa0", ".", "12", "<|endoftext|>"]), max_size=40).map("".join), st.integers(1, 4), st.integers(1, 9))
def test_parts_leave_the_ids_as_they_are(text, run, part):
    encode = packing.load_tokenizer("byte_bpe_50k")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(packing, "_BLANKS", re.compile(packing._BLANKS.pattern.replace("4096", str(run))))
        patch.setattr(packing, "_PART", part)
        assert encode(text).tolist() == HF.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 5_000_000, "\n" * 5_000_000 + "x", "z" * 5_000_000, "1" * 5_000_000, "a" + " \n\t" * 1_000_000 + "b c", "日" + " " * 1_000_000 + "!"], ids=["spaces", "lines", "letters", "digits", "mixed", "wide"])
def test_long_runs_are_encoded(text):
    ids = packing.load_tokenizer("byte_bpe_50k")(text)
    assert ids.tolist() == HF.encode(text, add_special_tokens=False).ids
