import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import multiindex
from quillon.llm.components import components
from quillon.runtime import Scratch


def brute(rows, threshold=0.98):
    clean = {}
    for i, v, label, *_ in rows:
        key = (label is not None, label or 0, v is not None, v or [])
        if i is not None and (i not in clean or key < clean[i][0]):
            clean[i] = (key, v, label)
    unit = {}
    for i, (_, v, label) in clean.items():
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v) / np.abs(v).max()
            unit[i] = (label, x / np.linalg.norm(x))
    links = {i: set() for i in clean}
    for i, (a, x) in unit.items():
        for j, (b, y) in unit.items():
            if i < j and a == b and len(x) == len(y) and x @ y >= threshold:
                links[i].add(j)
                links[j].add(i)
    low = {i: i for i in clean}
    while any(low[j] != min(low[i], low[j]) for i in links for j in links[i]):
        for i in links:
            low[i] = min([low[i], *(low[j] for j in links[i])])
    return {(i, len(links[i]), low[i], low[i] == i) for i in clean}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "BLOCK", 32)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    rows = []
    for i in range(600):
        v = base[i % 60] if i % 3 else base[rng.integers(2)]
        noise = rng.normal(size=16) * np.linalg.norm(v) / 4 * rng.choice([0.0, 0.1, 0.19, 0.25])
        rows.append((i, (v + noise).tolist(), int(i % 2), 0, 0))
    rows += [(700, None, 1, 0, 0), (701, [0.0] * 16, 1, 0, 0), (702, [float("nan")] * 16, 1, 0, 0), (703, base[0].tolist(), None, 0, 0)]
    rows += [(704, [1.0, 2.0], 1, 0, 0), (705, [2.0, 4.0], 1, 0, 0), (706, [], 1, 0, 0), (None, base[0].tolist(), 1, 0, 0), (5, base[1].tolist(), 9, 0, 0)]
    rows += [(707, [None] * 16, 1, 0, 0), (708, [1e300] * 16, 1, 0, 0), (709, [1e300] * 16, 1, 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep int, cell int")
    got = {tuple(r) for r in multiindex.near_duplicates(df).collect()}
    want = brute(rows)
    assert {g[0] for g in got} == {w[0] for w in want}
    found, truth = sum(g[1] for g in got), sum(w[1] for w in want)
    assert 0.99 * truth <= found <= truth
    assert len(got - want) <= 0.02 * len(want)


def test_empty_and_few(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert multiindex.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(3, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (9, [0.0, 1.0], 1)]
    got = {tuple(r) for r in multiindex.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(3, 1, 3, True), (4, 1, 3, False), (9, 0, 9, True)}


def test_components_of_chains_stars_and_loops(spark):
    rng = np.random.default_rng(1)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7000, 7000)]
    pairs += [(int(a), int(b)) for a, b in rng.integers(2000, 2400, (150, 2))]
    rng.shuffle(pairs)
    edges = spark.createDataFrame([tuple(map(int, p)) for p in pairs], "u long, v long").repartition(7)
    got = {r["id"]: r["component_id"] for r in components(edges, Scratch(spark, "test")).collect()}
    low = {x: x for p in pairs for x in p}
    for _ in range(100):
        for u, v in pairs:
            low[u] = low[v] = min(low[u], low[v])
    assert got == {x: low[x] for u, v in pairs for x in (u, v) if low[x] != x}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(0, 5), min_size=1, max_size=6), st.lists(st.floats(0, 5), min_size=1, max_size=6), st.floats(0.5, 1))
def test_traversal_visits_pairs_in_order_until_the_recall_is_met(first, second, recall):
    first, second = [0.0, *sorted(first)], [0.0, *sorted(second)]
    chance = [2.0**-x for x in first], [2.0**-x for x in second]
    left = sum(chance[0]) * sum(chance[1])
    got = list(multiindex.traverse(first, second, chance, left, recall))
    assert len(set(got)) == len(got)
    costs = [first[i] + second[j] for i, j in got]
    assert costs == sorted(costs)
    every = {(i, j) for i in range(len(first)) for j in range(len(second))}
    assert all(first[i] + second[j] >= costs[-1] for i, j in every - set(got)), "the cheapest come first"
    rest = sum(chance[0][i] * chance[1][j] for i, j in every - set(got))
    assert rest <= 1 - recall + 1e-9
    if len(got) > 1:
        i, j = got[-1]
        assert rest + chance[0][i] * chance[1][j] > 1 - recall - 1e-9, "and no cell is visited in vain"


def test_the_share_of_vectors_met_falls_as_tables_grow():
    rng = np.random.default_rng(3)
    vectors = multiindex.unit(rng.normal(size=(4000, 64)))
    share = []
    for n in (50_000, 3_000_000):
        books = multiindex.Codebooks(vectors, 0.98, 0.997, multiindex.codewords(n))
        own, visits = books.visits(vectors)
        held = np.bincount(own, minlength=len(books.first) * len(books.second))
        share.append(np.mean([held[v].sum() for v in visits]) / len(vectors))
    assert share[1] < 0.5 * share[0]
    assert multiindex.codewords(10) == multiindex.CODEWORDS and multiindex.codewords(10**15) == multiindex.MOST_WORDS
