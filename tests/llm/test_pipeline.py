"""The pipeline against plain versions of its stages, over a whole small table."""

import re

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from quillon.llm import jaccard, pii
from quillon.runtime import Scratch
from test_jaccard import shingle_set
from test_packing import check_layout
from test_pii import brute as plain_pii
from test_substring import brute as plain_cut

SF = "/root/testdata/sf0.001"


def stage(spark, k, docs):
    return Scratch(spark, "test").table(cp.STAGES[k][1](spark, docs, SF), "stage")


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def plain_classes(docs, rule):
    sets = {i: shingle_set(r["text"], rule.k) for i, r in docs.items()}
    low, ids = {i: i for i in sets}, sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and rule.den * len(sets[a] & sets[b]) >= rule.num * len(sets[a] | sets[b])]
    for _ in range(50):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = stage(spark, 0, docs)
    before, known = rows(docs), rows(one)
    assert one.columns == docs.columns and len(known) >= 0.98 * len(before)
    assert all(r["text"] == before[i]["text"] for i, r in known.items())
    assert sum(r["lang"] == before[i]["lang"] for i, r in known.items()) >= 0.97 * len(known)

    two = stage(spark, 1, one)
    classes = plain_classes(known, jaccard.Rule())
    apart = rows(two)
    assert two.columns == docs.columns and set(apart) == {i for i, c in classes.items() if i == c}

    three = stage(spark, 2, two)
    cut = rows(three)
    want = {i: (kept, gone) for i, n, gone, _, kept in plain_cut([(i, r["text"]) for i, r in apart.items()], 50)}
    assert set(cut) == {i for i, (kept, gone) in want.items() if not gone or kept}
    assert all(r["text"] == (want[i][0] if want[i][1] else apart[i]["text"]) for i, r in cut.items())

    four = stage(spark, 3, three)
    masked = rows(four)
    assert set(masked) == set(cut)
    for i, r in masked.items():
        assert r["n_chars"] == len(r["text"])
        spans = plain_pii(cut[i]["text"])
        assert all(cut[i]["text"][s:e] not in r["text"] for _, s, e in spans)
        assert pii.of_text(cut[i]["text"]) or r["text"] == cut[i]["text"], "without a candidate a text stays as it is"
        assert not spans or re.search("<(email|ip|card|phone)>", r["text"])

    five = stage(spark, 4, four)
    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {i: len(hf.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in masked.items()}
    packed = five.collect()
    got = {}
    for r in packed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == sizes
    assert check_layout(packed, 2048) <= np.ceil(sum(sizes.values()) / 2048) * 1.02 + 1


def test_run_equals_the_stages_and_takes_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(90_001, None, None, None, None), (90_002, "", "en", "s", 0), (90_003, "1 2 3", None, "s", 5), (90_004, " " * 1_000_000, "en", "s", 0), (80_000, "the " + "\n" * 1_000_000 + "end of that", "en", "s", 0)], docs.schema)
    odd = odd.unionByName(docs.limit(5)).unionByName(docs.limit(5))
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    got = cp.run(spark, str(tmp_path))
    assert got.filter(F.col("doc_id") >= 90_000).count() == 0
    assert got.count() > 30
    assert got.groupBy("doc_id", "piece").count().filter("count > 1").count() == 0
    empty = cp.load(spark, str(tmp_path), "documents").limit(0)
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
