import numpy as np
from pyspark.sql import functions as F

from quillon.llm import topk


def brute(rows, every, k=5):
    clean = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            clean[i] = min(clean.get(i, v), v)
    ints = {i: [int(np.nan_to_num(np.floor(np.float64(256) * x))) for x in v] for i, v in clean.items()}
    out = set()
    for q in ints:
        if q % every == 0:
            scored = sorted((-min(max(sum(a * b for a, b in zip(ints[q], v)), -(2**63)), 2**63 - 1), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def run(spark, rows, every, **more):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, block int, cutoff int")
    got = topk.search(df, F.col("vec_id") % every == 0, **more).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(60)] + [(i, [-1.0] * 8) for i in range(500, 510)]
    rows += [(600, None), (601, [1.0, None] + [0.0] * 6), (602, [float("nan")] * 8), (603, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(605, [1.0, 2.0]), (610, [2.0, 1.0]), (5, [-5.0] * 8), (615, []), (620, [1e9] * 8), (625, [-1e12] * 8)]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_few_and_none(spark):
    rows = [(0, [0.1, 0.2]), (1, [0.3, -0.4]), (2, [0.3, -0.4])]
    assert run(spark, rows, 1) == brute(rows, 1)
    assert run(spark, [], 1) == set()


def test_scores_beyond_a_long_reach_the_top(spark):
    rows = [(i, [3e7] * 8) for i in range(3)] + [(3, [1e8] * 8), (4, [1e9] * 8), (5, [-1e9] * 8), (6, [0.5] * 8), (7, [1e15] * 8), (8, [-1e300] * 8), (9, [1e308] + [1.0] * 7)]
    got = run(spark, rows, 1)
    assert got == brute(rows, 1)
    assert max(r[3] for r in got) == 2**63 - 1


def test_cutoffs_leave_blocks_unread(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 50)
    met = []
    monkeypatch.setattr(topk.Scratch, "table", lambda self, df, label, keep=topk.Scratch.table: met.append(keep(self, df, label)) or met[-1])
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=16) * 2.0 ** -(i // 100)).tolist()) for i in range(1000)]
    assert run(spark, rows, 10) == brute(rows, 10)
    pairs = next(t for t in met if "cutoff" in t.columns and "block" in t.columns).count()
    assert pairs < 0.5 * 100 * 20, "most pairs of a query and a block are bounded away"
