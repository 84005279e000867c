import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import charsets, scalars
from quillon.functions import text as T
from quillon.operators import symbols


def one(spark, text, *columns):
    row = spark.createDataFrame([(text,)], "text string").select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)




def test_ngrams_in_order(spark):
    got = one(spark, "abcde", T.ngrams(T.symbols(F.col("text")), 1, 5))
    assert got == ["a", "ab", "abc", "abcd", "abcde", "b", "bc", "bcd", "bcde", "c", "cd", "cde", "d", "de", "e"]
    assert one(spark, "абвгдеж", T.ngrams(T.symbols(F.col("text")), 2, 3)) == ["аб", "абв", "бв", "бвг", "вг", "вгд", "гд", "где", "де", "деж", "еж"]
    assert one(spark, "", T.ngrams(T.symbols(F.col("text")), 1, 2)) == []
    assert one(spark, "a", T.ngrams(T.symbols(F.col("text")), 2, 3)) == []
    assert one(spark, None, T.ngrams(T.symbols(F.col("text")), 1, 2)) is None
    with pytest.raises(ValueError):
        T.ngrams(F.col("text"), 3, 2)


def test_filter_and_words(spark):
    assert one(spark, "   !:,213213Hello,]]][[[[    World  !   ", T.alpha_filter(F.col("text"))) == " hello world "
    assert one(spark, "    12321321  ,,, \\///!!! Здравствуй, [[[ Мир  ]]]  !!!!", T.alpha_filter(F.col("text"))) == " здравствуй мир "
    assert one(spark, "Добро пожаловать, dear friend", T.words(F.col("text"))) == ["Добро", "пожаловать", "dear", "friend"]
    assert one(spark, "ab", T.kgrams(F.col("text"), 4)) == ["^ab", "ab$", "^ab$"]


def test_utf8(spark):
    text = "f!Ющтਉ"
    rows = symbols.positions(spark.createDataFrame([(1, "f!Ющ₂ਉ")], "id int, text string"), "id").orderBy("position").collect()
    assert [r["byte_position"] for r in rows] == [1, 2, 4, 6, 9, 12]
    assert [r["size"] for r in rows] == [1, 1, 2, 2, 3, 3]
    for s in (text, "", "𝒳a", "\u0000x"):
        assert one(spark, s, T.from_code_points(T.code_points(F.col("text")))) == s
    assert one(spark, "", T.from_code_points(F.array(F.lit(0x110000)))) == "�"


def test_classes_and_case(spark):
    for symbol, kind in [("A", "Lu"), ("я", "Ll"), ("7", "Nd"), ("!", "Po"), (" ", "Zs"), ("+", "Sm"), ("漢", "Lo"), ("\t", "Cc")]:
        assert one(spark, symbol, T.symbol_class(F.col("text"))) == kind
    assert one(spark, "漢", T.is_group(F.col("text"), "hieroglyph"), T.is_group(F.col("text"), "cased_letter")) == (True, False)
    assert one(spark, "ß", T.upper_symbol(F.col("text"))) == "ß"
    assert one(spark, "Ё", T.lower_symbol(F.col("text"))) == "ё"
    with pytest.raises(ValueError):
        T.is_class(F.col("text"), "Xx")
    rows = symbols.describe(spark.createDataFrame([(1, "Aя")], "id int, text string"), "id").orderBy("position").collect()
    assert [(r["hex"], r["class"], r["other_case"]) for r in rows] == [("41", "Lu", "a"), ("44F", "Ll", "Я")]


@pytest.mark.parametrize("charset", charsets.CHARSETS)
def test_code_pages(spark, charset):
    data = bytearray(range(1, 256))
    got = spark.createDataFrame([(data,)], "b binary").select(charsets.decode(F.col("b"), charset)).first()[0]
    assert got == "".join(charsets.table(charset)[1:])
    assert len(charsets.table(charset)) == 256


def test_another_page(spark, monkeypatch):
    monkeypatch.setattr(charsets, "_PAGES", dict(charsets._PAGES))
    charsets.register("test-page", "cp437", {0x80: "☃"})
    row = spark.createDataFrame([(bytearray([0x41, 0x80, 0x81]),)], "b binary")
    assert row.select(charsets.decode(F.col("b"), "test-page")).first()[0] == "A☃ü"
    with pytest.raises(ValueError):
        charsets.register("cp866", "cp866")


def test_known_bytes():
    assert charsets.table("koi8-ru")[0xAE] == "ў" and charsets.table("koi8-ru")[0xBE] == "Ў"
    assert charsets.table("mac-ukraine")[0xA2] == "Ґ" and charsets.table("mac-cyrillic")[0xA2] == "¢"
    assert charsets.table("cp1252")[0x81] == "\0" and charsets.table("cp1251")[0xC0] == "А"


def test_filter_line(spark):
    assert one(spark, "$creation_date:2020-01-02", T.filter_line(F.col("text"), "А-Яа-яЁё")) == "$creation_date:2020-01-02"
    assert one(spark, "Ёж, cat 1", T.filter_line(F.col("text"), "А-Яа-яЁё")) == "Ёж       "


def test_bytes_that_may_not_be_utf8(spark):
    data = [bytearray.fromhex("6621D0AED189D082E0A889"), bytearray.fromhex("61C0AFED A0 80 FF E282"), bytearray(), None]
    df = spark.createDataFrame(list(enumerate(data)), "id int, data binary")
    got = {}
    for r in symbols.decode(df, "id").orderBy("id", "at").collect():
        got.setdefault(r["id"], []).append((r["position"], r["byte_position"], r["size"], r["code"]))
    assert got[0] == [(1, 1, 1, 0x66), (2, 2, 1, 0x21), (3, 4, 2, 0x42E), (4, 6, 2, 0x449), (5, 8, 2, 0x402), (6, 11, 3, 0xA09)]
    assert got[1] == [(1, 1, 1, 0x61), (1, 3, 2, 0), (1, 6, 3, 0), (1, 9, 0, 0)]
    assert set(got) == {0, 1}


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=20))
def test_legal_bytes_decode_alike_on_both_ways(text):
    data = text.encode()
    fast, slow = symbols._legal(data), symbols._any(data)
    assert [list(c) for c in fast] == ([list(c) for c in slow] or [[]] * 5)


def test_scalar_bytes(spark):
    df = spark.createDataFrame([(1,), (0xFFFFFFFF,), (0,), (-2,)], "v long")
    rows = df.select("v", scalars.to_bytes(F.col("v"), 4).alias("a"), scalars.to_bytes(F.col("v"), 8).alias("b")).collect()
    assert [bytes(r["b"]) for r in rows] == [(v % 2**64).to_bytes(8, "little") for v in (1, 0xFFFFFFFF, 0, -2)]
    assert [bytes(r["a"]) for r in rows][:3] == [v.to_bytes(4, "little") for v in (1, 0xFFFFFFFF, 0)]
    back = df.select(scalars.from_bytes(scalars.to_bytes(F.col("v"), 8), 8)).collect()
    assert [r[0] for r in back] == [1, 0xFFFFFFFF, 0, -2]


def test_long_texts_leave_in_bounded_batches(spark, monkeypatch):
    """A batch holds about PIECE symbols, and a text cut in pieces has the columns of the whole."""
    texts = [b"ab\xff\xe2\x82" * 3, "aщ₂𝒳".encode() * 40_000, b"", b"\xf0\x9d\x92" + b"x" * 200_000, b"\x80" * 70_000, "щ".encode() * 70_000 + b"\xe2\x82"]
    for data in texts:
        whole = symbols._any(data) if data else ()
        parts = list(symbols._pieces(data))
        assert b"".join(p["symbol"][1] for p in parts) == data
        for name, column in zip(("at", "position", "byte_position", "size", "code"), whole):
            assert (np.concatenate([p[name] for p in parts]) == column).all()
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(texts)], "id int, data binary")
    run = {}
    monkeypatch.setattr(type(df), "mapInArrow", lambda rows, f, schema: run.update(f=f))
    symbols.decode(df, "id", ("code", "symbol"))
    held = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "data": texts})
    got = list(run["f"](iter([held])))
    assert max(b.num_rows for b in got) < 2 * symbols.PIECE
    for i, data in enumerate(texts):
        rows = [b.filter(pc.equal(b.column("id"), i)) for b in got]
        assert b"".join(s for b in rows for s in b.column("symbol").to_pylist()) == data


def test_positions_need_no_exchange(spark):
    rows = spark.createDataFrame([(1, "aщ𝒳"), (2, None), (3, "")], "id int, text string")
    got = symbols.positions(rows, "id")
    assert [tuple(r) for r in got.collect()] == [(1, 1, "a", 1, 1, 97), (1, 2, "щ", 3, 2, 0x449), (1, 3, "𝒳", 7, 4, 0x1D4B3)]
    assert got.schema.simpleString() == "struct<id:int,position:int,symbol:string,byte_position:bigint,size:int,code:int>"
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
