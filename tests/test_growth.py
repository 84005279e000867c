"""Plans and parts whose cost must not outgrow the input."""

import datetime as dt

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import morphology, sets
from quillon.operators import postings as P


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_bits_are_made_after_the_exchange(spark):
    day = dt.date
    rows = [(1, "a", day(1970, 1, 2)), (1, "a", day(1970, 1, 3)), (1, "b", day(1969, 12, 31)), (2, "a", day(2300, 1, 1)), (2, "a", None), (3, None, day(1970, 1, 2))]
    got = P.date_bits(spark.createDataFrame(rows, "doc_id long, name string, date date"))
    assert plan(got).index("Generate") < plan(got).index("Exchange")
    nanos = 86_400_000_000_000
    want = {(2, "a64"), (3, None)}
    for doc, name, bits in ((1, "a", nanos | 2 * nanos), (1, "b", -nanos & (2**64 - 1))):
        want |= {(doc, f"{name}{i:02d}") for i in range(64) if bits >> i & 1} | {(doc, f"{name}64")}
    held = [tuple(r) for r in got.collect()]
    assert len(held) == len(set(held)) and set(held) == want


def test_writing_postings_reads_texts_once_and_cuts_a_frequent_token(spark, tmp_path, monkeypatch):
    seen = tmp_path / "seen"

    def count(batches):
        for batch in batches:
            with open(seen, "a") as out:
                out.write("x" * batch.num_rows)
            yield batch

    rows = spark.range(400).coalesce(1).selectExpr("'^the$' as token", "id as doc_id").mapInArrow(count, "token string, doc_id long")
    monkeypatch.setattr(P, "ROWS", 25)
    written = P.write(rows, f"file://{tmp_path}/written")
    assert len(seen.read_text()) == 400, "neither a sampling nor a second pass over the texts"
    files = written.withColumn("file", F.input_file_name()).groupBy("file").count().collect()
    assert len(files) >= 12 and max(r["count"] for r in files) <= 100
    assert written.count() == 400 == written.distinct().count()


def test_ids_and_not_bitmaps_are_sent(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 70_000), ("b", 1), ("b", 1), ("b", 2)], "token string, doc_id long")
    got = sets.packed(rows, "token", parts=3)
    assert plan(got).rindex("bitmap_construct_agg") < plan(got).index("Exchange")
    assert sorted(tuple(r) for r in sets.packed_count(got, "token").collect()) == [("a", 2), ("b", 2)]
    assert sorted(tuple(r) for r in sets.unpacked(got, "token").collect()) == [("a", 1), ("a", 70_000), ("b", 1), ("b", 2)]


def test_merged_runs_are_compared_where_they_are_sorted(spark, tmp_path, monkeypatch):
    run = spark.range(300).selectExpr("'^the$' as token", "id as doc_id")
    runs = [P.write(run, f"file://{tmp_path}/a"), P.write(run.filter("doc_id > 99"), f"file://{tmp_path}/b")]
    monkeypatch.setattr(P, "ROWS", 25)
    out = P.compacted(runs, f"file://{tmp_path}/out")
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(300))
    assert len(out.withColumn("file", F.input_file_name()).select("file").distinct().collect()) >= 12
    # From the top: both halves of the comparison come before the exchange, so no task compares what a file happens to hold.
    text = plan(P.merged(*runs))
    assert text.rindex("HashAggregate") < text.index("Exchange")


def test_kgrams_of_a_text_at_once(spark):
    words = [["ab", "𝒳a", "щщщщ", "aaaaaa"], ["x"], [], None]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id int, words array<string>")
    for most in (3, 4, 5):
        one = F.array_distinct(F.flatten(F.transform("words", lambda w: T.kgrams(w, most))))
        for r in rows.select(T.distinct_kgrams(F.col("words"), most).alias("got"), one.alias("want")).collect():
            assert (r["got"] is None and r["want"] is None) or sorted(r["got"]) == sorted(r["want"])
    docs = spark.createDataFrame([(1, "Ab cd ab")], "doc_id long, text string")
    assert "lambda" not in plan(P.postings(docs, config=P.IndexConfig(kgram=4)))


def test_a_small_dictionary_is_sent_to_the_words(spark, monkeypatch):
    bases = [(1, 0, "cat", "cat"), (2, 1, "the", "the"), (3, 0, "ox", "ox"), (4, 0, "o", "oak")]
    morph = morphology.dictionary(spark, "en", bases, [(0, 0, "", 1), (0, 1, "s", 1), (0, 2, "x", 1), (1, 0, "", 14)])
    docs = spark.createDataFrame([(1, "The cat, cats and ox oak"), (2, "the"), (3, None), (4, "dog xyz")], "doc_id long, text string")
    for profile in (P.Profile(morph=morph), P.Profile(morph=morph, stop_words=frozenset({"dog", "cats"}))):
        got = P.postings(docs, profile)
        assert plan(got).count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan(got)
        with monkeypatch.context() as m:
            m.setattr(P, "FEW", 0)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, P.postings(docs, profile).collect()))
