import random

import pytest

from quillon.operators import kv, levels
from quillon.operators.levels import Store, located


def run_of(spark, rows):
    return spark.createDataFrame([(bytearray(k), s, o, v) for k, s, o, v in rows], "key binary, seq long, op tinyint, value string")


def pairs(df):
    return sorted((bytes(r["key"]), r["value"]) for r in df.collect())


def store(spark, path, policy, size=900):
    return Store(spark, f"file://{path}/{policy}", value="string", levels=kv.Levels(policy, max_table_bytes=size))


def batches(count, each, seed=11):
    rng = random.Random(seed)
    keys = [rng.randbytes(3) for _ in range(40)]
    rows = [(rng.choice(keys), s, int(rng.random() < 0.2)) for s in range(1, count * each + 1)]
    rows = [(k, s, o, None if o else f"v{s}") for k, s, o in rows]
    return [rows[i * each : (i + 1) * each] for i in range(count)]


def state(rows, snapshot):
    last = {}
    for k, s, _, v in rows:
        if s <= snapshot:
            last[k] = v
    return sorted((k, v) for k, v in last.items() if v is not None)


@pytest.mark.parametrize("policy", kv.POLICIES)
def test_flushes_against_a_dict(spark, tmp_path, policy):
    runs = batches(3, 50)
    held = store(spark, tmp_path, policy)
    for run in runs:
        held.flush(run_of(spark, run))
        for level in {x.level for x in held.tables}:
            at = held.at(level)
            assert len(at) < (2 if policy == "simple" else held.levels.capacity(level))
            assert policy == "simple" or all(a.max_key < b.min_key for a, b in zip(at, at[1:]))
    rows = sum(runs, [])
    assert sum(x.versions for x in held.tables) == 150 == held.log().count()
    again = store(spark, tmp_path, policy)
    assert sorted(again.tables, key=str) == sorted(held.tables, key=str) and again.sequence() == 150
    for snapshot in (70, 150):
        assert pairs(again.scan(snapshot=snapshot)) == state(rows, snapshot)
    low, high = sorted({r[0] for r in rows})[7], sorted({r[0] for r in rows})[22]
    live = state(rows, 150)
    assert pairs(again.scan(bytearray(low), bytearray(high))) == [p for p in live if low <= p[0] < high]
    assert pairs(again.get(bytearray(low))) == [p for p in live if p[0] == low]
    for strict in (False, True):
        want = [p for p in live if p[0] > low or (p[0] == low and not strict)][:1]
        assert pairs(again.lower_bound(bytearray(low), strict=strict)) == want
    assert pairs(again.lower_bound(b"\xff\xff\xff\xff")) == []
    again.squash((70,))
    assert pairs(again.scan(snapshot=70)) == state(rows, 70) and pairs(again.scan()) == live
    assert sum(x.versions for x in again.tables) < 150
    assert again.vacuum() > 0 and pairs(store(spark, tmp_path, policy).scan()) == live


def test_policies_shape_the_levels(spark, tmp_path):
    """One key range a batch: simple counts in binary, granular leaves what gets no rows alone, leveled rewrites its levels."""
    batch = lambda i: run_of(spark, [(bytes([i, j]), 20 * i + j + 1, 0, "x" * 10) for j in range(20)])
    simple = store(spark, tmp_path, "simple")
    levels = []
    for i in range(4):
        simple.flush(batch(i))
        levels.append(sorted(x.level for x in simple.tables))
    assert levels == [[0], [1], [0, 1], [2]]
    paths, written = {}, {}
    for policy in ("granular", "leveled"):
        held = store(spark, tmp_path, policy, size=500)
        for i in (0, 1, 2):
            held.flush(batch(i))
        before = {x.path for x in held.tables}
        held.written.clear()
        held.flush(batch(3))
        paths[policy], written[policy] = before & {x.path for x in held.tables}, sum(held.written.values())
        assert held.log().count() == 80
    assert paths["granular"], "tables without new rows keep their files"
    assert written["granular"] and written["leveled"]


def test_reads_visit_only_tables_that_meet_the_range(spark, tmp_path):
    held = store(spark, tmp_path, "leveled", size=100)
    held.flush(run_of(spark, [(bytes([i]), i + 1, 0, "x" * 20) for i in range(60)]))
    assert len(held.tables) > 10
    assert pairs(held.get(bytearray([7]))) == [(b"\7", "x" * 20)] and sum(held.visits.values()) == 1
    assert pairs(held.lower_bound(bytearray([7]))) == [(b"\7", "x" * 20)] and sum(held.visits.values()) == 2
    assert held.manifest().count() == len(held.tables)


def test_odd_input(spark, tmp_path):
    held = store(spark, tmp_path, "granular", size=200)
    assert held.flush(run_of(spark, [])).tables == [] and held.sequence() == 0 and pairs(held.scan()) == []
    hot = [(b"k", s, 0, "y" * 30) for s in range(1, 41)] + [(b"", 41, 0, ""), (b"z", 42, 1, None), (b"z", 42, 1, None)]
    held.flush(run_of(spark, hot).selectExpr("*", "1 as _mark", "2 as table"))
    assert held.log().count() == 43 and pairs(held.scan()) == [(b"", ""), (b"k", "y" * 30)]
    held.squash()
    assert held.log().count() == 2
    assert held.flush(run_of(spark, [(b"k", 50, 1, None), (b"", 51, 1, None)])).squash().tables == []
    assert pairs(store(spark, tmp_path, "granular").scan()) == []


def test_located_counts_ends_below_the_key(spark):
    rows = spark.createDataFrame([(k, s) for k in range(10) for s in range(3)], "key int, seq long")
    got = {r["key"]: r["n"] for r in located(rows, [2, 5, 9], "n").collect()}
    assert got == {k: (k > 2) + (k > 5) for k in range(10)}


def test_tables_of_another_source(spark, tmp_path):
    levels = kv.Levels("granular", max_table_bytes=900)
    held = Store(spark, f"file://{tmp_path}/orc", value="string", levels=levels, form="orc")
    runs = batches(2, 50)
    for rows in runs:
        held.flush(run_of(spark, rows))
    again = Store(spark, f"file://{tmp_path}/orc", value="string", levels=levels, form="orc")
    assert pairs(again.scan()) == state(runs[0] + runs[1], 100)


def test_many_ends_are_counted_as_few(spark, monkeypatch):
    rows = spark.createDataFrame([(k, s) for k in range(10) for s in range(3)], "key int, seq long")
    counts = lambda: {r["key"]: r["n"] for r in located(rows, [2, 5, 9], "n").collect()}
    few = counts()
    monkeypatch.setattr(levels, "FEW", 2)
    assert counts() == few


def test_granular_writes_rows_where_they_stay(spark, tmp_path):
    """A flush into an empty store writes each row once and not once for each level it passes."""
    held = store(spark, tmp_path, "granular", size=100)
    rows = [(bytes([i]), i + 1, 0, "x" * 20) for i in range(60)]
    held.flush(run_of(spark, rows))
    assert max(x.level for x in held.tables) >= 3
    assert sum(held.written.values()) == sum(x.bytes for x in held.tables)
    assert all(held.written[i] == sum(x.bytes for x in held.at(i)) and len(held.at(i)) < held.levels.capacity(i) for i in held.written)
    more = [(bytes([i]), 100 + i, 0, "y" * 20) for i in range(0, 60, 3)]
    held.written.clear()
    held.flush(run_of(spark, more))
    assert sum(held.written.values()) <= sum(x.bytes for x in held.tables)
    assert held.log().count() == 80 and pairs(held.scan()) == state([(k, s, o, v) for k, s, o, v in rows + more], 200)
    for i in {x.level for x in held.tables}:
        assert len(held.at(i)) < held.levels.capacity(i) and all(a.max_key < b.min_key for a, b in zip(held.at(i), held.at(i)[1:]))
