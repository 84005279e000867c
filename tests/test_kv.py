import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import kv

SCHEMA = "key binary, seq long, op tinyint, value string"


def log(spark, rows):
    return spark.createDataFrame([(bytearray(k), s, o, v) for k, s, o, v in rows], SCHEMA)


def pairs(df):
    return sorted((bytes(r["key"]), r["value"]) for r in df.collect())


LADDER = [(b"\1\2\3", 1, 0, "10"), (b"\1\2\3", 2, 0, "20"), (b"\1\2\3", 3, 1, None), (b"\1\2\3", 4, 0, "30")]


def test_snapshot_ladder(spark):
    df = log(spark, LADDER)
    got = [[v for _, v in pairs(kv.get(df, bytearray(b"\1\2\3"), s))] for s in (0, 1, 2, 3, 4, None)]
    assert got == [[], ["10"], ["20"], [], ["30"], ["30"]]
    assert kv.current_sequence(df).first()["seq"] == 4
    assert kv.current_sequence(df.limit(0)).first()["seq"] == 0


def test_sparse_ladder_states(spark):
    df = log(spark, [(b"k", 1, 0, "10"), (b"k", 3, 0, "20"), (b"k", 5, 1, None), (b"k", 7, 0, "30")])
    keys = spark.createDataFrame([(bytearray(b"k"),), (bytearray(b"other"),)], "key binary")
    got = {}
    for s in (0, 1, 2, 3, 4, 5, 6, 7):
        got[s] = {bytes(r["key"]): (r["state"], r["value"]) for r in kv.state(df, keys, s).collect()}
    assert [got[s][b"k"] for s in got] == [
        ("not_found", None), ("found", "10"), ("found", "10"), ("found", "20"), ("found", "20"), ("deleted", None), ("deleted", None), ("found", "30"),
    ]
    assert all(got[s][b"other"] == ("not_found", None) for s in got)


def test_scans_and_bounds(spark):
    df = log(spark, [(bytes([i]), i + 1, 0, str(10 * i)) for i in range(10)])
    assert pairs(kv.scan(df, bytearray([3]), bytearray([7]))) == [(bytes([i]), str(10 * i)) for i in (3, 4, 5, 6)]
    assert pairs(kv.lower_bound(df, bytearray([4]))) == [(b"\4", "40")]
    assert pairs(kv.upper_bound(df, bytearray([4]))) == [(b"\5", "50")]
    assert pairs(kv.upper_bound(df, bytearray([9]))) == []
    gone = kv.delete(df, spark.createDataFrame([(bytearray([4]), 11)], "key binary, seq long"))
    assert pairs(kv.lower_bound(gone, bytearray([4]))) == [(b"\5", "50")]


def test_empty_value_and_empty_key_are_kept(spark):
    assert pairs(kv.scan(log(spark, [(b"", 1, 0, ""), (b"a", 2, 0, "")]))) == [(b"", ""), (b"a", "")]


def test_random_log_against_a_dict_at_snapshots_for_all_policies(spark, tmp_path):
    rng = random.Random(42)
    keys = [rng.randbytes(rng.randrange(5, 8)) for _ in range(200)]
    rows = [(rng.choice(keys), s, int(rng.random() < 0.1), None) for s in range(1, 1001)]
    rows = [(k, s, o, None if o else str(rng.random())) for k, s, o, _ in rows]
    want = {}
    for snapshot in (400, 1000):
        state = {}
        for k, s, o, v in rows[:snapshot]:
            state[k] = v if o == 0 else None
        want[snapshot] = sorted((k, v) for k, v in state.items() if v is not None)
    df = log(spark, rows)
    for policy in kv.POLICIES:
        whole = kv.compact(df, f"{tmp_path}/{policy}", policy, partitions=4)
        assert whole.count() == 1000
        for snapshot in want:
            assert pairs(kv.scan(whole, snapshot=snapshot)) == want[snapshot]
        files = kv.manifest(whole).collect()
        assert len(files) == 1 or policy != "simple"
        ranges = sorted((bytes(f["min_key"]), bytes(f["max_key"])) for f in files)
        assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:])), "versions of a key stay in one file"


def test_merge_layout_and_facade(spark):
    runs = [spark.createDataFrame([(i, v) for v in vs], "source int, v int") for i, vs in enumerate([[1, 4, 9], [], [1, 2, 9]])]
    assert [r["v"] for r in kv.merge_sorted(*runs, by=["v"]).collect()] == [1, 1, 2, 4, 9, 9]
    assert [r["v"] for r in kv.merge_sorted(*runs, by=["v"], limit=3).collect()] == [1, 1, 2]
    df = log(spark, [(bytes([i // 3]), i + 1, 0, "x" * 20) for i in range(90)])
    layout = kv.level_layout(df, kv.Levels(max_table_bytes=200)).collect()
    per_level = {}
    for r in layout:
        per_level[r["level"]] = per_level.get(r["level"], 0) + 1
    top = max(per_level)
    assert all(per_level[k] == 2 ** (k + 1) - 1 for k in range(top))
    assert sum(r["versions"] for r in layout) == 90
    with pytest.raises(ValueError):
        kv.Levels("other")
    store = kv.KvLog.empty(spark, "int", "string", "granular").put(spark.createDataFrame([(2, "b"), (1, "a")], "key int, value string"), order=["key"])
    store = store.delete(spark.createDataFrame([(1,)], "key int"), order=["key"]).put(spark.createDataFrame([(3, "c")], "key int, value string"), order=["key"])
    assert store.sequence() == 4
    assert [tuple(r) for r in store.scan().collect()] == [(2, "b"), (3, "c")]
    assert [tuple(r) for r in store.scan(snapshot=2).collect()] == [(1, "a"), (2, "b")]


def test_squashed_keeps_what_snapshots_see(spark):
    rng = random.Random(3)
    rows = [(bytes([rng.randrange(20)]), s, int(rng.random() < 0.4), None) for s in range(1, 301)]
    rows = [(k, s, o, None if o else str(s)) for k, s, o, _ in rows]
    df = log(spark, rows)
    small = kv.squashed(df, (50, 200))
    for snapshot in (50, 200, None):
        assert pairs(kv.scan(small, snapshot=snapshot)) == pairs(kv.scan(df, snapshot=snapshot))
    assert small.count() <= 60
    last = {k: o for k, _, o, _ in rows}
    assert kv.squashed(df).count() == sum(o == kv.PUT for o in last.values()), "without snapshots no delete stays"


def test_merge_rules(spark):
    rows = [(b"a", 1, 0, "1"), (b"a", 2, 1, None), (b"a", 3, 0, "2"), (b"a", 4, 0, "5"), (b"b", 5, 0, "7"), (b"c", 6, 0, "8"), (b"c", 7, 1, None)]
    got = kv.merged(log(spark, rows), top=F.max, n=F.count)
    assert sorted((bytes(r["key"]), r["top"], r["n"]) for r in got.collect()) == [(b"a", "5", 2), (b"b", "7", 1)]
