import random
import re

import pytest

from quillon.llm import jaccard

SCHEMA = "doc_id long, text string, n long, token string"


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, rule):
    sets = {i: shingle_set(t, rule.k) for i, t, *_ in rows}
    low = {i: i for i in sets}
    ids = [i for i in sets if sets[i]]
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if rule.den * len(sets[a] & sets[b]) >= rule.num * len(sets[a] | sets[b])]
    for _ in sets:
        moved = False
        for a, b in links:
            m = min(low[a], low[b])
            moved |= low[a] != m or low[b] != m
            low[a] = low[b] = m
        if not moved:
            break
    return {(i, len(s), low[i]) for i, s in sets.items()}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "Cd", "éf", "gh", "IJ", "kl"]) + str(rng.randrange(40))
    passage = [word() for _ in range(30)]
    base = [[word() for _ in range(rng.randrange(1, 80))] for _ in range(25)]
    docs = []
    for _ in range(220):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = word()
        if rng.random() < 0.3:
            words += passage
        docs.append(rng.choice([" ", "\n", "\t "]).join(words))
    docs += [" ".join(passage + [word()]) for _ in range(40)] + ["a", "a b", "a  b", "A B c", "", None, "x " * 500]
    ids = rng.sample(range(10_000), len(docs))
    return [(i, t, 1, "x") for i, t in zip(ids, docs)]


@pytest.mark.parametrize(("seed", "rule"), [(1, jaccard.Rule(4, 85, 100)), (2, jaccard.Rule()), (3, jaccard.Rule(2, 60, 100))])
def test_against_brute_force(spark, monkeypatch, seed, rule):
    monkeypatch.setattr(jaccard, "SHORT", 4)
    rows = corpus(seed)
    got = {tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(6), rule).collect()}
    want = brute(rows, rule)
    assert got == want, sorted(got ^ want)[:10]


def test_last_round_alone_is_complete(spark, monkeypatch):
    """Without short lists and pivots, the last round must find every link by itself."""
    monkeypatch.setattr(jaccard, "SHORT", 0)
    monkeypatch.setattr(jaccard, "_pivots", lambda lists, *more: lists.selectExpr("g u", "g v").limit(0))
    rule, rows = jaccard.Rule(3, 70, 100), corpus(4)
    got = {tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA), rule).collect()}
    assert got == brute(rows, rule)


def test_edge_rows(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e", 1, "x"), (4, "a b c d e", 1, "x"), (4, "a b c d e", 1, "x"), (2, "A b C d\n e", 1, "x"), (9, None, 1, "x")]
    got = sorted(map(tuple, jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 1, None), (4, 1, 2), (4, 1, 2), (2, 1, 2), (9, 0, 9)], key=str)


def test_members_of_one_group_that_are_apart_meet_only_where_they_may_link(spark):
    """Texts of one size with one prefix, by hand: the order of shingles is by hash, so texts are drawn until prefixes agree."""
    rng = random.Random(6)
    rule = jaccard.Rule(1, 80, 100)
    words = [f"w{i}" for i in range(400)]
    sets, _ = jaccard._sets(jaccard.pa.array([" ".join(words)]), 1)
    by_hash = {int(jaccard._sets(jaccard.pa.array([w]), 1)[0][0]): w for w in words}
    order = [by_hash[int(h)] for h in sets]
    n = 20
    head, rest = order[: int(rule.prefix(n))], order[int(rule.prefix(n)) :]
    rows = [(i, " ".join(head + rng.sample(rest[:40] if i % 2 else rest, n - len(head))), 1, "x") for i in range(60)]
    rows += [(100 + i, " ".join(head + rest[i : i + n - len(head)]), 1, "x") for i in range(12)]
    got = {tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA), rule).collect()}
    assert got == brute(rows, rule)
    assert len({c for *_, c in got}) > 10
