import hashlib
import random
import re

import numpy as np
import pytest

from quillon.llm import substring, words

SCHEMA = "doc_id long, text string, block int, text_hash string"


def brute(rows, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    low = {}
    for (i, *_), w in zip(rows, split):
        for s in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[s : s + window])
                low[key] = min(low.get(key, i), i)
    out = []
    for (i, *_), w in zip(rows, split):
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and low[tuple(w[s : s + window])] < i:
                gone |= set(range(s, s + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept) if gone else None))
    return sorted(out, key=str)


def corpus(seed, window):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "Bé", "c", "d.", "𝒳"]) + str(rng.randrange(30))
    passages = [[word() for _ in range(window + rng.choice([-2, -1, 0, 1, 5, window]))] for _ in range(12)]
    texts = []
    for _ in range(150):
        w = [word() for _ in range(rng.randrange(0, 3 * window))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            p = rng.choice(passages[:2] if rng.random() < 0.5 else passages)
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        texts.append(rng.choice([" ", "\n", " \t\r"]).join(w))
    texts += [None, "", " ", texts[0], texts[0], "x " * (5 * window), "x " * (3 * window)]
    ids = rng.sample(range(-500, 10_000), len(texts))
    rows = [(i, t, 1, "x") for i, t in zip(ids, texts)]
    return rows + [rows[3], (rows[5][0], rows[6][1], 0, ""), (None, rows[7][1], 0, "")]


@pytest.mark.parametrize(("seed", "window", "chunk"), [(1, 10, 300), (2, 6, 2000), (3, 10, 4_000_000), (4, 50, 5000)])
def test_against_brute_force(spark, monkeypatch, seed, window, chunk):
    monkeypatch.setattr(words.chunks, "__defaults__", (chunk,))
    rows = corpus(seed, window)
    got = sorted(map(tuple, substring.dedup(spark.createDataFrame(rows, SCHEMA).repartition(5), window).collect()), key=str)
    assert got == brute(rows, window)


def test_empty_table(spark):
    assert substring.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packed_prints_round_trip():
    prints = np.unique(np.random.default_rng(0).integers(0, 1 << 24, 5000)).astype(np.uint32)
    assert (substring._unpack(substring._pack(prints)) == prints).all()
    assert len(substring._unpack(substring._pack(prints[:0]))) == 0
