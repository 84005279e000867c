import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.operators import patterns, sets


def values(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_set_algebra(spark):
    a, b = sets.of(spark, 1, 2, 3, 40_000, 70_000), sets.of(spark, 2, 3, 5)
    assert values(sets.intersect(a, b)) == [2, 3]
    assert values(sets.union(a, b, sets.of(spark, 9))) == [1, 2, 3, 5, 9, 40_000, 70_000]
    assert values(sets.andnot(a, b)) == [1, 40_000, 70_000]
    assert values(sets.xor(a, b)) == [1, 5, 40_000, 70_000]
    assert values(sets.flip(b, 2, 6)) == [4] and values(sets.flip(b, 2, 6, closed=True)) == [4, 6]
    assert values(sets.remove_range(a, 2, 40_000)) == [1, 40_000, 70_000]
    assert values(sets.select(a, 3)) == [40_000] and values(sets.select(a, 9)) == []
    assert tuple(sets.rank(a, 3).first()) == (3, 2) and tuple(sets.rank(a, 4).first()) == (3, -1)
    assert values(sets.page(a, 1, 2)) == [2, 3] and values(sets.seek(a, 3)) == [3, 40_000, 70_000]
    assert sets.to_text(b).first()[0] == "{2,3,5}"
    assert tuple(sets.measures(a).first()) == (5, 1, 70_000)
    assert sets.contains_range(a, 1, 4).first()[0] and not sets.contains_range(a, 1, 5).first()[0]
    m = sets.pair_measures(a, b).first()
    assert (m["n_and"], m["n_or"], m["n_andnot"], m["n_xor"], m["jaccard"]) == (2, 6, 3, 4, 2 / 6)
    assert sets.pair_measures(sets.of(spark, 2), b).first()["strict_subset"] and sets.pair_measures(b, b).first()["equal"]
    assert values(sets.complement(b, sets.between(spark, 0, 7))) == [0, 1, 4, 6]
    assert [r["place"] for r in sets.ranked(a).orderBy("doc_id").collect()] == [0, 1, 2, 3, 4]


def test_packed_round_trip(spark):
    ids = sorted({0, 1, 7, 8, 32766, 32767, 32768, 65535, 65536, *random.Random(0).sample(range(200_000), 300)})
    df = sets.of(spark, *ids)
    bits = sets.packed(df)
    assert values(sets.unpacked(bits)) == ids
    assert sets.packed_count(bits).first()[0] == len(ids)
    other = sets.packed(sets.of(spark, 0, 7, 100_001))
    assert values(sets.unpacked(sets.packed_intersect(bits, other))) == sorted({0, 7, 100_001} & set(ids))
    assert values(sets.unpacked(sets.packed_union(bits.unionByName(other)))) == sorted({*ids, 100_001})


def run(spark, pats, text, how=patterns.occurrences):
    p = spark.createDataFrame(pats, "id long, pattern string")
    t = spark.createDataFrame([(0, text), (1, None), (2, "")], "text_id long, text string")
    return sorted((r["end"], r["id"]) for r in how(t, p).collect())


def test_occurrences(spark):
    pats = [(1, "abcde"), (2, "ab"), (3, "abc"), (4, "abcd"), (5, "cde"), (9, "")]
    want = [(3, 5), (5, 2), (6, 3), (7, 4), (8, 1), (8, 5)]
    plain = lambda t, p: patterns.joined(t, p.filter("pattern <> ''"))
    assert run(spark, pats, "cdeabcde") == want == run(spark, pats, "cdeabcde", plain)
    assert run(spark, [(1, "he"), (2, "hers"), (3, "his"), (4, "she"), (5, "she")], "ushers") == [(4, 1), (4, 4), (4, 5), (6, 2)]
    t = spark.createDataFrame([(0, "ushers")], "text_id long, text string")
    p = spark.createDataFrame([(1, "he"), (4, "she")], "id long, pattern string")
    assert [r["ids"] for r in patterns.symbol_matches(t, p).orderBy("end").collect()] == [[], [], [], [1, 4], [], []]
    assert {(r["word"], r["id"]) for r in patterns.lookup(spark.createDataFrame([("he",), ("h",)], "word string"), p).collect()} == {("he", 1)}
    assert patterns.prefixes(p).count() == 5


@settings(max_examples=150, deadline=None)
@given(st.text("ab", max_size=6), st.text("ab", max_size=3), st.text("ab", max_size=3))
def test_regular_algebra(text, x, y):
    a, b = patterns.Nfa.word(x, 1), patterns.Nfa.word(y, 2)
    for machine, want in (
        (a.then(b), text == x + y),
        (patterns.any_of(a, b), text in (x, y)),
        (a.star(), text == x * (len(text) // max(1, len(x)))),
        (a.then(b).reverse(), text[::-1] == x + y),
    ):
        dfa = machine.determined()
        assert bool(machine.match(text)) == bool(dfa.match(text)) == bool(dfa.minimal().match(text)) == want
    assert patterns.any_of(a, a).determined().match(x) == {1}


def test_dfa_rows(spark):
    dfa = patterns.any_of(patterns.Nfa.word("ab", 1), patterns.Nfa.word("cb", 1)).determined().minimal()
    assert len(dfa.table) == 3 and dfa.transitions(spark).count() == 3
    assert "accepts [1]" in str(patterns.Nfa.word("ab", 1))


def test_written_automaton(spark, tmp_path):
    dfa = patterns.any_of(patterns.Nfa.word("ab", 1), patterns.Nfa.word("cb", 2).star()).determined().minimal()
    dfa.write(spark, f"{tmp_path}/dfa")
    assert patterns.Dfa.read(spark, f"{tmp_path}/dfa") == dfa


def test_empty_and_full(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    assert tuple(sets.is_full(ids(1, 2, 9), ids(1, 2)).first()) == (False, True)
    assert tuple(sets.is_full(ids(1), ids(1, 2)).first()) == (False, False)
    assert tuple(sets.is_full(ids(), ids()).first()) == (True, True)


def test_accepted_by_an_expression(spark):
    word = patterns.Nfa.word
    nfa = patterns.any_of(word("aé", 7).star(), word("a", 2).then(word("😀", 5)), word("aé", 1))
    dfa = nfa.determined().minimal()
    texts = ["", "a", "aé", "aéaé", "a😀", "a😀a", "x", "aéx", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", patterns.accepted(F.col("text"), dfa).alias("ids"))
    got = {r["text"]: r["ids"] for r in rows.collect()}
    assert got == {t: None if t is None else sorted(nfa.match(t)) for t in texts}
    assert got["aé"] == [1, 7] and got["a😀"] == [5] and got[""] == [7]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    nothing = patterns.Dfa([{}], [set()])
    assert rows.select(patterns.accepted(F.col("text"), nothing).alias("ids")).filter("size(ids) > 0").count() == 0
