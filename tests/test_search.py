import datetime as dt

import pytest

from quillon.operators import morphology
from quillon.operators import postings as P
from quillon.plans import search
from quillon.sources import files
from quillon.streaming import ingest

DATES = [
    ("2025-06-01", None), ("2012-05-10", None), ("2016-09-13", "2025-03-01"), ("2019-01-20", None),
    ("2005-04-02", "2026-01-01"), ("1992-05-01", None), ("2011-09-01", "2026-02-01"), ("1990-01-01", None),
]


@pytest.fixture(scope="module")
def dated(spark):
    docs = [(i, f"$creation_date:{a}\n" + (f"  $deletion_date:{b} \r\n" if b else "") + f"слово doc{i}") for i, (a, b) in enumerate(DATES)]
    return search.Index.build(spark.createDataFrame(docs, "doc_id long, text string"))


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("{ 2010-01-02 $creation_date * }", [0, 1, 2, 3, 6]),
        ("{ * $creation_date 2010-01-01 }", [4, 5, 7]),
        ("{ 1970-01-01 $creation_date 2000-01-01 }", [5, 7]),
        ("[ 2010-01-01 : 2026-03-15 ]", [5, 7]),
        ("[ 2025-01-01 : 2025-12-01 ]", [1, 3, 4, 5, 6, 7]),
        ("{ 2026-01-15 $deletion_date * }", [0, 1, 3, 5, 6, 7]),
        ("{ 2020-01-01 $creation_date 2010-01-01 }", []),
        ("( слово & { * $creation_date 2000-01-01 } )", [5, 7]),
        ("( ! { * $creation_date 2010-01-01 } )", [0, 1, 2, 3, 6]),
    ],
)
def test_dates(dated, query, want):
    assert ids(dated.search(query)) == want


def test_words_and_edges(spark):
    docs = spark.createDataFrame(
        [(0, "Кушать подано"), (1, "куща и КУШ"), (2, None), (3, ""), (4, "the cat"), (4, "the dog"), (5, "кушак, the end")], "doc_id long, text string"
    )
    index = search.Index.build(docs)
    assert ids(index.search("куш*")) == [0, 1, 5]
    assert ids(index.search("( ! the )")) == [0, 1, 2, 3]
    assert ids(index.search("( ( cat | dog ) & the )")) == [4]
    assert ids(index.search("the cat")) == []
    compat = search.Index.build(docs, P.Profile(letters=P.RUSSIAN_LETTERS), prefix_mode="range")
    assert ids(compat.search("куш*")) == [0, 1, 5] and ids(compat.search("the")) == []
    grams = search.Index.build(docs, config=P.IndexConfig(kgram=4))
    assert ids(grams.search("куш*ть")) == [0]
    assert ids(grams.search("*д*")) == [0, 1, 2, 3, 4, 5], "parts under three symbols say nothing"
    assert ids(grams.search("*подано")) == [], "a part longer than the grams"
    with pytest.raises(ValueError):
        index.search("ку*ть")


@pytest.mark.parametrize("query", ["( a & b | c )", "", "( a & b", "{ 2020-01-01 name * }", "[ 2020-01-01 ]", ") a", "( & a )", "( a ) b"])
def test_malformed(query):
    with pytest.raises(ValueError):
        search.parse(query)


def test_parse_tree():
    assert search.parse("( a & b* )") == search.Op("&", (search.Term("a"), search.Term("b*")))
    assert search.parse("{ * $d 2020-02-03 }") == search.Range("d", None, dt.date(2020, 2, 3))


def test_morphology_and_stop_words(spark):
    bases = [(1, 0, "кетчуп", "кетчуп"), (2, 1, "с", "с"), (3, 2, "след", "след")]
    suffixes = [(0, 0, "", 1), (0, 1, "а", 1), (1, 0, "", 13), (2, 0, "", 1), (2, 1, "ы", 1)]
    morph = morphology.dictionary(spark, "ru", bases, suffixes)
    docs = spark.createDataFrame([(0, "следы кетчупа"), (1, "след с горчицей"), (2, "с")], "doc_id long, text string")
    index = search.Index.build(docs, P.Profile(morph=morph))
    assert {r["token"] for r in index.postings.collect()} == {"^след$", "^кетчуп$", "^горчицей$"}
    assert ids(index.search("( следы & с )")) == [0, 1]
    assert ids(index.search("с")) == [0, 1, 2]
    assert ids(index.search("кетчупы")) == []


def test_dictionary_blocks_and_write(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"b{'x' * (i % 3)} a") for i in range(3000)], "doc_id long, text string")
    rows = P.postings(docs)
    numbers = P.dictionary(rows)
    assert sorted((r["feature_id"], r["token"]) for r in numbers.collect()) == [(0, "^a$"), (1, "^b$"), (2, "^bx$"), (3, "^bxx$")]
    block = P.encoded(rows, numbers).filter("feature_id = 0 and block_id = 2")
    assert sorted(r["place"] for r in block.collect()) == list(range(3000 - 2048))
    back = P.write(rows, f"{tmp_path}/p")
    assert back.count() == 6000 and P.docs_of(back, "^bx$").count() == 1000
    assert P.docs_between(back, "^b", "^by").count() == 3000


def test_files_and_streams(spark, tmp_path):
    for name, text in (("b/two.txt", "second"), ("a.txt", "first\nline"), ("b/one.txt", "$creation_date:2020-01-01")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    docs = files.documents(spark, f"{tmp_path}/in")
    assert [r["text"] for r in docs.orderBy("doc_id").collect()] == ["first\nline", "$creation_date:2020-01-01", "second"]
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/docs")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/docs")
    ingest.append_postings(stream, f"{tmp_path}/post", f"{tmp_path}/c1").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/post").select("token", "doc_id")
    assert sorted(map(tuple, got.collect())) == [("^first$", 0), ("^line$", 0), ("^second$", 2)]
    spark.createDataFrame([(1, 1, 0, "a"), (1, 2, 1, None)], "key int, seq long, op int, value string").write.parquet(f"{tmp_path}/ops")
    ops = spark.readStream.schema("key int, seq long, op int, value string").parquet(f"{tmp_path}/ops")
    ingest.append_log(ops, f"{tmp_path}/log", f"{tmp_path}/c2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2


def test_rows_that_share_a_doc_id_give_distinct_postings(spark):
    from quillon.operators import postings as P

    docs = spark.createDataFrame([(4, "the cat"), (4, "the dog"), (5, "the")], "doc_id long, text string")
    for config in (P.IndexConfig(), P.IndexConfig(kgram=3)):
        rows = [tuple(r) for r in P.postings(docs, config=config).collect()]
        assert len(rows) == len(set(rows)) and ("^the$" if not config.kgram else "^th", 4) in rows
    runs = P.postings(docs.limit(2)), P.postings(docs)
    assert sorted(map(tuple, P.merged(*runs).collect())) == sorted(map(tuple, P.postings(docs).collect()))


def test_dates_beyond_nanoseconds_have_no_bits(spark):
    import datetime as dt

    from quillon.operators import postings as P

    dates = spark.createDataFrame([(1, "d", dt.date(2300, 1, 1))], "doc_id long, name string, date date")
    assert [r["token"] for r in P.date_bits(dates).collect()] == ["d64"]
