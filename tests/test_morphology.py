import pytest
from pyspark.sql import functions as F

from quillon.functions import pos
from quillon.operators import morphology


def words(spark, *items):
    return spark.createDataFrame([(w,) for w in items], "word string")


def test_goldens(spark):
    ru = morphology.dictionary(spark, "ru", [(1, 0, "мам", "мама")], [(0, 0, "а", 1), (0, 1, "ой", 2), (0, 2, "а", 3)])
    assert {r["attr"] for r in morphology.analyze(words(spark, "мама", "мамаx", "мам"), ru).collect()} == {1, 3}
    en = morphology.dictionary(spark, "en", [(1, 0, "hello", "hello")], [(0, 0, "ab", 1), (0, 1, "acc", 2)])
    assert [r["attr"] for r in morphology.analyze(words(spark, "helloab"), en).collect()] == [1]
    ask = spark.createDataFrame([(1, 1), (1, 2), (1, 9), (7, 1)], "lem_id int, attr int")
    got = {(r["lem_id"], r["attr"]): r["form"] for r in morphology.generate(ask, ru).collect()}
    assert got == {(1, 1): "мама", (1, 2): "мамой", (1, 9): "", (7, 1): ""}
    forms = morphology.all_forms(spark.createDataFrame([(1,)], "lem_id int"), ru).first()
    assert forms["forms"] == ["мама", "мамой"] and forms["n"] == 2
    main = {r["lem_id"]: (r["main_form"], r["found"]) for r in morphology.main_form(spark.createDataFrame([(1,), (2,)], "lem_id int"), ru).collect()}
    assert main == {1: ("мама", True), 2: (None, False)}
    with pytest.raises(ValueError):
        morphology.dictionary(spark, "ru", [(1, 5, "x", "x")], [(0, 0, "", 1)])


def test_dictionary_grows_and_takes_an_alphabet(spark):
    more = morphology.Dictionary("en", *_tables(spark, [(1, 0, "no", "no")], [(0, 0, "", 1)]), alphabet="[a-z'ñ]")
    bases, suffixes = _tables(spark, [(2, 1, "niñ", "niño")], [(1, 0, "o's", 2)])
    more = more.with_bases(bases).with_suffixes(suffixes)
    got = {(r["word"], r["lem_id"]) for r in morphology.analyze(words(spark, "no", "niño's", "no-"), more).collect()}
    assert got == {("no", 1), ("niño's", 2)}


def _tables(spark, bases, suffixes):
    held = morphology.dictionary(spark, "en", bases, suffixes)
    return held.bases, held.suffixes


def test_dictionary_source(spark, tmp_path):
    tabs = morphology.parse_tabs(["// comment", "", "  аа A С мр,ед,им", "аб A С мр,ед,рд", "зз A НЕЧТО"], "ru")
    assert tabs == {"аа": pos.pack(pos.RUSSIAN, "noun", gender=1, number=1, case=1), "аб": pos.pack(pos.RUSSIAN, "noun", gender=1, number=1, case=2), "зз": 0}
    source = "2\n%*аа%А*аб\n%Ы*аб%Ь*зз\n0\n1\nskip\n0\n2\nСТОЛ 0 x\nПЕН 1\n".split("\n")
    morph = morphology.compile_dictionary(spark, "ru", tabs | {"аа": tabs["аа"]}, source)
    assert [tuple(r) for r in morph.bases.orderBy("lem_id").collect()] == [(1, 0, "стол", "стол"), (2, 1, "пен", "пен")]
    assert {(r["line_id"], r["suffix"]) for r in morph.suffixes.collect()} == {(0, ""), (0, "а"), (1, "ы")}
    morph.write(f"{tmp_path}/d")
    back = morphology.Dictionary.read(spark, f"{tmp_path}/d", "ru")
    assert {(r["word"], r["lem_id"]) for r in morphology.analyze(words(spark, "стола", "пены", "пен"), back).collect()} == {("стола", 1), ("пены", 2)}
    with pytest.raises(ValueError):
        morphology.parse_tabs(["аа A"], "ru")
    with pytest.raises(ValueError):
        morphology.compile_dictionary(spark, "ru", tabs, ["1", "%x*нет"])


def test_pack_decode_describe(spark):
    cases = []
    for name, rules in pos.LANGUAGES.items():
        for part in rules.tags:
            for fill in (0, 1):
                cases.append((name, part, pos.pack(rules, part, **{f: fill for f, _ in rules.layouts.get(part, ())}), fill))
    df = spark.createDataFrame(cases, "language string, part string, attr int, fill int")
    for name, rules in pos.LANGUAGES.items():
        for r in df.filter(F.col("language") == name).select("part", "fill", pos.decode(F.col("attr"), rules).alias("p"), pos.describe(F.col("attr"), rules).alias("d")).collect():
            got = r["p"].asDict()
            assert got.pop("tag") == r["part"]
            have = {f for f, _ in rules.layouts.get(r["part"], ())}
            assert {f for f, v in got.items() if v is not None} == have
            assert all(got[f] == r["fill"] for f in have)
            assert r["d"].startswith(rules.titles[rules.tags.index(r["part"])])
    noun = pos.pack(pos.RUSSIAN, "noun", number=1, gender=2, case=4, lang=2)
    assert noun == 1 | 1 << 5 | 2 << 7 | 2 << 9 | 4 << 12
    text = spark.createDataFrame([(noun,)], "attr int").select(pos.describe(F.col("attr"), pos.RUSSIAN)).first()[0]
    assert text == "существительное, единственное число, женский род, дательный падеж, архаизм"


def test_tab_lines():
    assert pos.parse_tab_line("Эф A С мр,ед,рд,2", pos.RUSSIAN)[1] == pos.pack(pos.RUSSIAN, "noun", gender=1, number=1, case=3)
    assert pos.parse_tab_line("x A КР_ПРИЛ мр,ед", pos.RUSSIAN)[1] == pos.pack(pos.RUSSIAN, "adjective", gender=1, number=1, brevity=1)
    assert pos.parse_tab_line("x A ИНФИНИТИВ мр", pos.RUSSIAN)[1] == pos.pack(pos.RUSSIAN, "verb")
    assert pos.parse_tab_line("va 1 VERB prsa,1,2,m", pos.ENGLISH)[1] == pos.pack(pos.ENGLISH, "verb", time=2, person=3, gender=1)
