import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0,
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((pii.KINDS.index(kind), m.start(), m.end()))
    return out


PARTS = ["a", "@", ".", "b.c", "x@y.zz", "1", "12", "255", "256", "001.2.3.4", "-", " ", "+", "(", ")", "4111111111111111", "4111 1111-1111 1111", "+1 (968) 555-9364", "é", "𝒳", "%", "٣"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
def test_base_spans_match_the_plain_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_long_runs_stay_linear():
    for text in ["1234 " * 60_000, "a (at) b" + " dot c" * 50_000, "1 . " * 70_000, "(212) 555-" * 30_000, "1" * 200_000, "a" * 200_000, "a@" * 100_000, "1." * 100_000, "+1 " * 70_000]:
        pii.of_text(text)


def test_detect_digest_and_mask(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(150)]
    texts += [None, "", "mail bob@mail.example.com", "write to bob (at) mail (dot) example (dot) com", texts[1]]
    texts += [f"contact u{i}@mail.example.com now" for i in range(60)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = {r["doc_id"]: r for r in pii.digest(pii.detect(docs)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        want = brute(text or "")
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want)
        assert rows[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == j for w in want) for j in range(4)]
        assert set(filter(None, said.split(","))) <= set(filter(None, rows[i]["spans"].split(",")))
    small = docs.drop("spans").filter("doc_id >= 150 and doc_id < 153")
    masked = {r["doc_id"]: r["text"] for r in pii.mask(small).collect()}
    assert masked == {150: None, 151: "", 152: "mail <email>"}


def test_empty_table(spark):
    assert pii.digest(pii.detect(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def planted(seed, truths, decoys, base):
    """Texts with looser personal data, look-alikes that are none, and base matches: (text, kind, start, end, whether true)."""
    rng = random.Random(seed)
    d = lambda n, low=0: "".join(str(rng.randrange(low if i == 0 else 0, 10)) for i in range(n))

    def card(valid):
        body = "4" + d(14)
        return next(c for c in (body + str(i) for i in range(10)) if pii.luhn(c) is valid)

    area = lambda: rng.choice("2345678") + rng.choice("01234568") + rng.choice("023456789")
    phone = lambda: f"{area().replace('37', '38').replace('96', '86')}-{rng.choice('23456789')}{d(1)}{rng.choice('023456789')}-{d(4)}"
    true = [
        lambda: ("please call {} by phone", phone(), "phone"),
        lambda: ("Telefon: {} ab 9", phone(), "phone"),
        lambda: ("nach {} 190.1.2.3 weiter", f"+1 ({area()}) 555-{d(4)}", "phone"),
        lambda: ("write to {} today", f"user{d(2)} (at) mail (dot) example (dot) com", "email"),
        lambda: ("tarjeta {} 12345 vale", card(True), "card"),
        lambda: ("host {} up", f"{rng.randrange(1, 99)} . {d(2, 1)} . {d(1)} . {d(1)}", "ip"),
    ]
    false = [
        lambda: ("order {} shipped", card(False), "card"),
        lambda: ("hash ab{}cd end", d(16, 1), "card"),
        lambda: ("part {} in stock", f"1{d(2)}-0{d(2)}-{d(4)}", "phone"),
        lambda: ("section {} of it", f"{rng.randrange(300, 999)} . {d(2, 1)} . {d(1)} . {d(1)}", "ip"),
        lambda: ("see {} there", f"pic{d(2)} (at) site (dot) png", "email"),
    ]
    out = []
    for makers, n, good in ((true, truths, True), (false, decoys, False)):
        for i in range(n):
            shape, span, kind = makers[i % len(makers)]()
            text = shape.format(span)
            at = text.index(span)
            out.append((text, kind, at, at + len(span), good))
    for i in range(base):
        out.append((rng.choice([f"und x{i}@mail.example.com so", f"le +1 ({area()}) 555-{d(4)} la", f"the {card(True)} of", f"el {d(2, 1)}.{d(2, 1)}.1.2 y"]), None, 0, 0, False))
    return out


@pytest.mark.parametrize("truths, decoys, base", [(300, 300, 0), (300, 300, 3000), (300, 30, 300), (60, 600, 600), (300, 0, 0)])
def test_added_spans_are_right_at_every_mix(spark, truths, decoys, base):
    cases = planted(truths + decoys + base, truths, decoys, base)
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")
    added = {(r["doc_id"], s["kind"], s["start"], s["end"]) for r in pii.detect(docs).collect() for s in r["spans"] if not s["base"]}
    want = {(i, *c[1:4]) for i, c in enumerate(cases) if c[4]}
    recall, precision = len(added & want) / len(want), len(added & want) / max(1, len(added))
    print(f"recall {recall:.3f} precision {precision:.3f}")
    assert recall >= 0.95 and precision >= 0.95, (sorted((cases[i][0], k) for i, k, *_ in added ^ want)[:20])
