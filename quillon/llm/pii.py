"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

1. Candidates. Every base match (email, ip, card, phone) and every looser look-alike: an address written "a (at) b dot c",
   four dotted groups with blanks, a run of card layout that is no base match by itself (it fails Luhn, or other digits stand
   beside it), a number in phone layout without "+" or with more digits beside it.
2. Labelers vote for, against, or abstain; none looks at whether the base pattern matched.
   form: label lengths, leading zeros, Luhn, grouping. gazetteer: name endings, address ranges, issuer ranges with their
   lengths, calling codes, area codes. words: telling words close by in four languages, for and against. edges: letters or
   digits that touch the span. company: a base match close by.
3. EM. The votes of all candidates, counted by kind and code, fit a two-class model of labeler reliabilities, with priors that
   hold labelers better than chance, so what one kind of candidate gets hangs little on the mix. Counts are exact for the
   whole corpus, and their number is bounded by the codes that exist.
4. Classifier. A logistic model per kind, fitted to the posteriors weighted by the same counts, judges votes, length and
   layout. Looser candidates over `threshold` are added; base matches always stay.

Texts are read once; the candidates, a few per text, are kept as a written table while the model is fitted.

Defined results: a null text is empty; offsets are code points, end exclusive; looser candidates that overlap a base match or
an earlier one are left out; rows repeat freely; further columns are ignored. With no candidates nothing is added.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.words import lean
from quillon.runtime import Scratch, small_batches

KINDS = ("email", "ip", "card", "phone")

# Base patterns. An address is found from its @, a digit run is entered at its first digit only, and possessive repeats
# give nothing back: the matches are those of the plain patterns, in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

# Looser look-alikes; only the method's labelers make them spans. Possessive repeats keep them linear on any text.
_SPELLED = re.compile(
    r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]++"
    r"(?:\x20?(?:[\[(]\x20?dot\x20?[\])]|\.|\x20dot\x20)\x20?[a-z0-9-]++)++"
)
_AT = re.compile(r"(?i)[\[(]\x20?at\x20?[\])]")
_BARE_PHONE = re.compile(r"(?<![0-9+.(-])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_LOOSE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\x20?\.\x20?[0-9]{1,3}){3}(?![0-9.])")
_LOOSE_CARD = re.compile(r"(?<![0-9])(?:[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}|[0-9]{13,19})(?![0-9])")

# Gazetteers.
_ENDINGS = frozenset("com org net edu gov mil int info biz name io co me tv eu de at ch fr be lu es mx ar cl pe uk ie us ca au nz it pt nl pl se no dk fi cz jp cn kr in br ru".split())
_FILES = frozenset("png jpg jpeg gif svg txt htm html php js css json xml csv py java exe zip gz pdf doc".split())
#: Issuer ranges: first and last prefix, and the lengths of their numbers.
_ISSUERS = (
    ("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("300", "305", (14,)),
    ("36", "36", (14,)), ("38", "39", (14,)), ("3528", "3589", (16,)), ("6011", "6011", (16, 19)), ("644", "659", (16, 19)), ("62", "62", (16, 19)),
)
_CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 220 221 234 254 255 256 260 263 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 378 380 381 382 385 386 387 389 420 421 423 500 501 502 503 504 505 506 507 509 590 591 592 593 594 595 596 597 598 599 673 675 676 677 679 852 853 855 856 880 886 960 961 962 963 964 965 966 967 968 970 971 972 973 974 975 976 977 992 993 994 995 996 998".split())
#: Telling words close by, in English, German, French and Spanish: for, and against.
_WORDS = {
    "email": ("mail email contact write address kontakt schreib adresse courriel contacter correo escrib contacto", "file image path file datei fichier archivo"),
    "ip": ("ip server host login addr address client network netz rechner adresse serveur réseau hôte servidor red dirección", "version release section chapter figure abschnitt kapitel fassung chapitre figura sección capítulo versión"),
    "card": ("card visa mastercard amex credit debit payment karte kreditkarte zahlung carte bancaire paiement tarjeta crédito pago", "order serial tracking isbn invoice ticket part bestellung rechnung seriennummer commande facture série pedido factura serie"),
    "phone": ("phone tel telephone call mobile cell fax telefon anruf handy rufnummer téléphone appel portable teléfono llam móvil", "part order serial isbn invoice version item bestellung artikel commande référence pedido artículo"),
}
_TELLING = {kind: tuple(re.compile(r"\b(?:" + "|".join(side.split()) + ")") for side in sides) for kind, sides in _WORDS.items()}
_NEAR = 40
#: Votes: each labeler gives 0 (abstain), 1 (against) or 2 (for). A code holds them in base 3, in this order.
LABELERS = ("form", "gazetteer", "words", "edges", "company")
#: How often a labeler votes for and against, of true and of false candidates, as one believes beforehand.
_PRIOR = {
    "form": (0.85, 0.05, 0.30, 0.55), "gazetteer": (0.70, 0.03, 0.25, 0.50), "words": (0.30, 0.02, 0.05, 0.20), "edges": (0.90, 0.05, 0.60, 0.35),
    "company": (0.30, 0.001, 0.15, 0.001),
}
#: What the prior counts for: this many candidates, and this multiple of those seen.
_STRENGTH, _SHARE = 50, 1.0
FEATURES = ("base", "length", "layout")
_CODES, _BITS = 3 ** len(LABELERS), 1 << len(FEATURES)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base matches, kind by kind, leftmost first."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > done and text[low - 1] in _LOCAL:
            low -= 1
        if low < at and (domain := _DOMAIN.match(text, at + 1)):
            out.append((0, low, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    if text.count(".") > 2:
        for m in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in m[0].split(".")):
                out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Look-alikes that overlap no base match."""
    taken: list[tuple[int, int]] = []  # disjoint, in order
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    out = []
    finders = []
    if _AT.search(text):
        finders.append((0, _SPELLED))
    if any(c in text for c in "0123456789"):
        finders += [(1, _LOOSE_IP), (2, _LOOSE_CARD), (3, _BARE_PHONE)]
    for kind, pattern in finders:
        for m in pattern.finditer(text):
            s, e = m.span()
            i = bisect.bisect(taken, (s, e))
            if (i == 0 or taken[i - 1][1] <= s) and (i == len(taken) or e <= taken[i][0]):
                out.append((kind, s, e))
                taken.insert(i, (s, e))
    return out


def _email(body: str) -> tuple[int, int]:
    plain = re.sub(r"(?i)\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20|\x20?\.\x20?", ".", re.sub(r"(?i)\x20?[\[(]\x20?at\x20?[\])]\x20?", "@", body))
    local, _, domain = plain.rpartition("@")
    labels = domain.lower().split(".")
    well = len(local) <= 64 and not (local.startswith(".") or local.endswith(".") or ".." in local)
    well = well and all(0 < len(x) <= 63 and x[0] != "-" != x[-1] for x in labels) and len(labels[-1]) > 1 and labels[-1].isalpha()
    return 2 if well else 1, 2 if labels[-1] in _ENDINGS else 1 if labels[-1] in _FILES else 0


def _ip(body: str) -> tuple[int, int]:
    parts = body.replace(" ", "").split(".")
    well = all(len(p) < 4 and int(p) <= 255 and (p == "0" or p[0] != "0") for p in parts)
    first = int(parts[0][-9:])
    return 2 if well else 1, 1 if first in (0, 127) or first >= 224 else 2


def _card(body: str) -> tuple[int, int]:
    digits = _NOT_DIGIT.sub("", body)
    issued = any(a <= digits[: len(a)] <= b and len(digits) in sizes for a, b, sizes in _ISSUERS)
    return 2 if luhn(digits) else 1, 2 if issued else 1


def _phone(body: str) -> tuple[int, int]:
    groups = [g for g in _NOT_DIGIT.split(body) if g]
    if body.startswith("+"):
        digits = "".join(groups)
        well = 10 <= len(digits) <= 13 and len(groups) <= 6 and len(groups[-1]) > 1
        return 2 if well else 1, 2 if any(digits[:n] in _CALLING for n in (1, 2, 3)) else 1
    # Area and exchange codes of the North American plan: from 2 up; no area code has 9 in the middle or ends in 11.
    area, exchange = groups[0], groups[1]
    well = len(groups) == 3 and exchange[0] >= "2" and exchange[1:] != "11"
    return 2 if well else 1, 2 if area[0] >= "2" and area[1] != "9" and area[1:] != "11" and area[:2] not in ("37", "96") else 1


_JUDGES = (_email, _ip, _card, _phone)


def judge(text: str, kind: int, start: int, end: int, base: bool, company: bool) -> tuple[int, int]:
    """Votes and features of a candidate, each as one code."""
    body = text[start:end]
    near = text[max(0, start - _NEAR) : start].lower() + " | " + text[end : end + _NEAR].lower()
    good, bad = (pattern.search(near) is not None for pattern in _TELLING[KINDS[kind]])
    touched = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    votes = (*_JUDGES[kind](body), 0 if good == bad else 2 if good else 1, 1 if touched else 2, 2 if company else 0)
    layout = any(c in " -.()" for c in body)
    return sum(v * 3**j for j, v in enumerate(votes)), base + 2 * (len(body) >= 14) + 4 * layout


def of_text(text: str) -> list[tuple[int, int, int, int, int]]:
    """(kind, start, end, votes, features) of the candidates of one text, by kind, then start."""
    base = base_spans(text)
    every = sorted([(*s, True) for s in base] + [(*s, False) for s in _loose_spans(text, base)])
    starts, ends = sorted(s for _, s, _ in base), sorted(e for *_, e in base)

    def company(s: int, e: int, own: bool) -> bool:
        """Whether a base match other than this one starts or ends within reach."""
        begun = bisect.bisect_left(starts, e + _NEAR) - bisect.bisect_left(starts, s - _NEAR)
        ended = bisect.bisect_right(ends, s) - bisect.bisect_left(ends, s - _NEAR)
        return begun > own or ended > 0

    return [(k, s, e, *judge(text, k, s, e, own, company(s, e, own))) for k, s, e, own in every]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and, per text, its candidates: kind, start, end, votes, features."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "votes", "features")
        kind = pa.list_(pa.struct([(n, pa.int32()) for n in names]))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [[dict(zip(names, c, strict=True)) for c in of_text(text or "")] for text in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "found"])

    small_batches(docs.sparkSession)
    ids = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {ids}, found array<struct<kind:int,start:int,end:int,votes:int,features:int>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def fit(counts: list[tuple[int, int, int, int]], rounds: int = 50) -> dict[tuple[int, int, int], float]:
    """Probability that a candidate is personal data, for each (kind, votes, features) that was counted.

    EM estimates, per kind, how often each labeler votes for or against true and false candidates; a logistic model is then
    fitted to the posteriors over votes and features. Whether a candidate is a base match is no feature.
    """
    model: dict[tuple[int, int, int], float] = {}
    for kind in range(len(KINDS)):
        rows = [r for r in counts if r[0] == kind]
        if not rows:
            continue
        n = np.array([r[3] for r in rows], dtype=float)
        votes = np.array([[r[1] // 3**j % 3 for j in range(len(LABELERS))] for r in rows])
        feats = np.array([[r[2] >> j & 1 for j in range(1, len(FEATURES))] for r in rows], dtype=float)
        hits = np.stack([votes == 2, votes == 1])  # for and against, by row and labeler
        believed = np.array([_PRIOR[x] for x in LABELERS]).T.reshape(2, 2, -1)  # true or false, for or against, labeler
        held = _STRENGTH + _SHARE * n.sum()
        rates, prior = believed, 0.5
        for _ in range(rounds):
            odds = np.log(prior) - np.log1p(-prior) + (hits * np.log(rates[0] / rates[1])[:, None, :]).sum((0, 2))
            post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            prior = ((n * post).sum() + held / 2) / (n.sum() + held)
            for side, share in enumerate((n * post, n * (1 - post))):
                counted = (hits * share[None, :, None]).sum(1) + held * believed[side]
                rates = np.stack([counted / (share.sum() + held), rates[1]]) if side == 0 else np.stack([rates[0], counted / (share.sum() + held)])
        x = np.column_stack([np.ones(len(n)), feats, votes == 2, votes == 1])
        w = np.zeros(x.shape[1])
        weight = n / n.sum()
        for _ in range(400):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
            step = np.linalg.solve(curve, x.T @ (weight * (post - p)) - 1e-3 * w)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-7:
                break
        score = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        model |= {(kind, r[1], r[2]): float(s) for r, s in zip(rows, score, strict=True)}
    return model


def accepted(found: DataFrame, threshold: float) -> list[tuple[int, int, int]]:
    """The (kind, votes, features) of looser candidates that the fitted classifier lets through."""
    counts = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.features").count()
    model = fit([tuple(r) for r in counts.collect()])
    return sorted(k for k, score in model.items() if score >= threshold and not k[2] & 1)


def detect(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Spans of personal data of every text.

    Returns doc_id and spans, an array of (kind, start, end, base, score) by kind, then start.
    """
    found = Scratch(docs.sparkSession, "pii").table(candidates(docs), "candidates")
    loose = accepted(found, threshold)
    good = F.array(*[F.lit((k * _CODES + v) * _BITS + f) for k, v, f in loose]) if loose else F.array().cast("array<int>")
    names = F.array(*[F.lit(k) for k in KINDS])
    kept = F.filter(
        "found",
        lambda c: (c["features"].bitwiseAND(1) == 1)
        | F.array_contains(good, (c["kind"] * _CODES + c["votes"]) * _BITS + c["features"]),
    )
    span = F.transform(
        kept,
        lambda c: F.struct(
            F.element_at(names, c["kind"] + 1).alias("kind"),
            c["start"].alias("start"),
            c["end"].alias("end"),
            (c["features"].bitwiseAND(1) == 1).alias("base"),
        ),
    )
    return found.select("doc_id", span.alias("spans"))


def digest(spans: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans as text."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
    )


def mask(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; overlapping spans are masked as one.

    Learns from all texts first, then finds the spans again while it rewrites them, so no text is shuffled. Null texts stay.
    """
    loose = set(accepted(candidates(docs), threshold))

    def masked(text: str | None) -> str | None:
        spans = [(s, e, k) for k, s, e, v, f in of_text(text or "") if f & 1 or (k, v, f) in loose]
        if not spans:
            return text
        parts, at = [], 0
        for s, e, k in sorted(spans, key=lambda x: (x[0], -x[1])):
            if s >= at:
                parts += [text[at:s], f"<{KINDS[k]}>"]
            at = max(at, e)
        return "".join([*parts, text[at:]])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [masked(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, "text", pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
