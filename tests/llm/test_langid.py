import numpy as np
from pyspark.sql import functions as F

from quillon.llm import langid


def slow(scores, penalty):
    value, back = scores[0].copy(), []
    for s in scores[1:]:
        step = value[:, None] - penalty * (1 - np.eye(len(s)))
        back.append(step.argmax(0))
        value = step.max(0) + s
    return value.max()


def test_viterbi_reaches_the_best_score():
    rng = np.random.default_rng(1)
    for _ in range(40):
        lengths = rng.choice([1, 2, 63, 64, 65, 128, 200, 700], size=rng.integers(1, 6))
        states = int(rng.integers(1, 5))
        scores = rng.normal(size=(lengths.sum(), states)).astype(np.float32)
        doc = np.repeat(np.arange(len(lengths)) * 2, lengths)
        labels = langid.viterbi(scores, doc, 1.5)
        for d in np.unique(doc):
            mine = np.flatnonzero(doc == d)
            total = scores[mine, labels[mine]].sum() - 1.5 * (np.diff(labels[mine]) != 0).sum()
            assert abs(total - slow(scores[mine].astype(float), 1.5)) < 1e-2


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = docs.withColumn("out", langid.held_out(F.col("doc_id")))
    model = langid.fit(known.filter("not out"))
    rows = langid.identify(known.filter("out"), model, spans=False).join(known.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_scripts_mixed_spans_and_edges(spark):
    en, ru, fr = "the cat and the dog were walking with that", "кошка и собака гуляли вместе тут", "le chat et les chiens étaient avec elle"
    train = spark.createDataFrame([(en, "en"), (ru, "ru"), (fr, "fr"), (None, "en"), ("x", None)] * 3, "text string, lang string")
    model = langid.fit(train)
    assert model.languages == ["en", "fr", "ru"]
    texts = [en, f"{en}. {ru}!", None, "", "123 !?", "漢字", f"{fr}; {en}", "𝒳 " + ru, en, "x" * 300_000]
    docs = spark.createDataFrame([(i, t, "zz", 3) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 3, 4, 7, 8)] == ["en", "en", "und", "und", "und", "ru", "en"]
    assert [(s["lang"], texts[1][s["start"] : s["end"]]) for s in got[1]["spans"]] == [("en", en), ("ru", ru)]
    assert [(s["lang"], texts[6][s["start"] : s["end"]]) for s in got[6]["spans"]] == [("fr", fr), ("en", en)]
    assert got[5]["lang_pred"] in model.languages and got[2]["score"] == 0


def test_nothing_to_learn_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(none)
    some = spark.createDataFrame([(1, "text"), (1, "text")], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.identify(some, model).collect()] == ["und", "und"]
    assert langid.identify(none, model).count() == 0
