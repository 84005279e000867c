"""The search language: text to tree, tree to one plan.

    query := '{' (date | '*') '$'name (date | '*') '}'        value of a date attribute within a closed range
           | '[' date ':' date ']'                            created by the first date and not deleted before the second
           | '(' q ('&' q)* ')' | '(' q ('|' q)* ')' | '(' '!' q ')'
           | word | prefix'*' | pattern with '*' elsewhere

Parentheses nest. All words of a query are looked up in one filtered scan of the postings and one aggregation by document,
whatever their number; dates are range predicates. The documents table is read only if a document without any hit can
match. Deviations on purpose: an inverted date range is empty, a prefix is a prefix (prefix_mode="range" gives the range
that ends at the last letter я instead), and dates compare as dates.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import postings as P


@dataclass(frozen=True)
class Term:
    word: str


@dataclass(frozen=True)
class Range:
    name: str
    low: dt.date | None
    high: dt.date | None


@dataclass(frozen=True)
class Alive:
    low: dt.date
    high: dt.date


@dataclass(frozen=True)
class Op:
    kind: str
    parts: tuple


_TOKEN = re.compile(r"[(){}\[\]&|!]|[^\s(){}\[\]&|!]+")


def parse(query: str) -> Term | Range | Alive | Op:
    """The tree of a query; ValueError if it is malformed or mixes operators in one parenthesis."""
    items = [m.group() for m in _TOKEN.finditer(query)]
    at = 0

    def take(want: str | None = None) -> str:
        nonlocal at
        if at >= len(items) or (want is not None and items[at] != want):
            raise ValueError(f"expected {want or 'a term'} at item {at + 1} of {query!r}")
        at += 1
        return items[at - 1]

    def date(item: str) -> dt.date | None:
        return None if item == "*" else dt.date.fromisoformat(item)

    def until(close: str) -> list[str]:
        out = []
        while (item := take()) != close:
            out.append(item)
        return out

    def one():
        item = take()
        if item == "{":
            body = until("}")
            if len(body) != 3 or not body[1].startswith("$"):
                raise ValueError(f"a date range is {{ from $name to }}: {query!r}")
            return Range(body[1][1:], date(body[0]), date(body[2]))
        if item == "[":
            body = "".join(until("]")).split(":")
            if len(body) != 2:
                raise ValueError(f"an interval is [ from : to ]: {query!r}")
            return Alive(dt.date.fromisoformat(body[0]), dt.date.fromisoformat(body[1]))
        if item == "(":
            if items[at : at + 1] == ["!"]:
                take("!")
                inner = one()
                take(")")
                return Op("!", (inner,))
            parts, kind = [one()], None
            while (sign := take()) != ")":
                if sign not in "&|" or kind not in (None, sign):
                    raise ValueError(f"one kind of operator per parenthesis: {query!r}")
                kind = sign
                parts.append(one())
            return parts[0] if kind is None else Op(kind, tuple(parts))
        if item in ")}]&|!":
            raise ValueError(f"unexpected {item!r} in {query!r}")
        return Term(item)

    if not items:
        raise ValueError("an empty query")
    tree = one()
    if at == len(items):
        return tree
    if all(re.fullmatch(r"[^\s(){}\[\]&|!]+", x) for x in items):
        return Term(" ".join(items))  # several bare words are one literal, which no token equals
    raise ValueError(f"trailing text in {query!r}")


@dataclass
class Index:
    """What a search reads. docs and attrs may be missing where no query needs them."""

    postings: DataFrame
    docs: DataFrame | None = None
    attrs: DataFrame | None = None
    profile: P.Profile = field(default_factory=P.Profile)
    config: P.IndexConfig = field(default_factory=P.IndexConfig)
    prefix_mode: str = "strict"

    @classmethod
    def build(cls, docs: DataFrame, profile: P.Profile = P.Profile(), config: P.IndexConfig = P.IndexConfig(), **more) -> Index:
        return cls(P.postings(docs, profile, config), docs.select("doc_id"), P.attributes(docs), profile, config, **more)

    def search(self, query: str) -> DataFrame:
        return search(self, query)


def search(index: Index, query: str) -> DataFrame:
    """The doc_ids that a query matches."""
    tree = parse(query)
    words: list[str] = []
    _walk(tree, lambda t: words.append(t.word.lower()) if isinstance(t, Term) and "*" not in t.word else None)
    forms = _forms(index, words)
    tokens: list[Column] = []
    dates: list[tuple[str, Column]] = []
    condition = _compile(index, tree, forms, tokens, dates)
    flags = None
    if tokens:
        hit = F.lit(False)
        for t in tokens:
            hit = hit | t
        columns = [F.bool_or(t).alias(f"t{i}") for i, t in enumerate(tokens)]
        flags = index.postings.filter(hit).groupBy("doc_id").agg(*columns)
    if dates:
        names = sorted({n for n, _ in dates})
        rows = index.attrs.filter(F.col("name").isin(*names))
        columns = [F.bool_or((F.col("name") == n) & c).alias(f"d{i}") for i, (n, c) in enumerate(dates)]
        dated = rows.groupBy("doc_id").agg(*columns)
        flags = dated if flags is None else flags.join(dated, "doc_id", "full")
    names = [f"t{i}" for i in range(len(tokens))] + [f"d{i}" for i in range(len(dates))]
    if condition({n: False for n in names}):
        universe = index.docs.select("doc_id").distinct()
        flags = universe if flags is None else universe.join(flags, "doc_id", "left")
    elif flags is None:
        return index.postings.select("doc_id").limit(0)
    matched = condition({n: F.coalesce(n, F.lit(False)) for n in names})
    return flags.filter(F.lit(matched) if isinstance(matched, bool) else matched).select("doc_id")


def _walk(tree, visit: Callable) -> None:
    visit(tree)
    for part in tree.parts if isinstance(tree, Op) else ():
        _walk(part, visit)


def _forms(index: Index, words: list[str]) -> dict[str, list[str] | None]:
    """Main forms of the query's words; None for a stop word."""
    if index.profile.morph is None:
        return {w: None if w in index.profile.stop_words else [w] for w in words}
    if not words:
        return {}
    df = index.postings.sparkSession.createDataFrame([(w,) for w in words], "word string")
    return {r["word"]: None if r["stop"] else list(r["forms"]) for r in P.forms_of(df, index.profile).collect()}


def _compile(index: Index, tree, forms: dict, tokens: list[Column], dates: list[tuple[str, Column]]) -> Callable[[dict], object]:
    """A function of flag values, plain or columns, that tells whether a document matches; adds the flags it needs."""

    def token(c: Column) -> Callable:
        tokens.append(c)
        name = f"t{len(tokens) - 1}"
        return lambda f: f[name]

    def dated(name: str, c: Column) -> Callable:
        dates.append((name, c))
        flag = f"d{len(dates) - 1}"
        return lambda f: f[flag]

    def both(parts: list[Callable], use: Callable) -> Callable:
        def value(f: dict):
            out = parts[0](f)
            for p in parts[1:]:
                out = use(out, p(f))
            return out

        return value

    col, day = F.col("token"), F.col("date")
    always = lambda f: (True if all(isinstance(v, bool) for v in f.values()) else F.lit(True))
    never = lambda f: (False if all(isinstance(v, bool) for v in f.values()) else F.lit(False))
    negate = lambda x: (not x) if isinstance(x, bool) else ~x
    if isinstance(tree, Op):
        parts = [_compile(index, p, forms, tokens, dates) for p in tree.parts]
        if tree.kind == "!":
            return lambda f: negate(parts[0](f))
        return both(parts, (lambda a, b: a & b) if tree.kind == "&" else (lambda a, b: a | b))
    if isinstance(tree, Range):
        if tree.low and tree.high and tree.low > tree.high:
            return never
        inside = F.lit(True)
        if tree.low:
            inside = inside & (day >= F.lit(tree.low))
        if tree.high:
            return dated(tree.name, inside & (day <= F.lit(tree.high)))
        return both([dated(tree.name, inside), lambda f, has=dated(tree.name, F.lit(True)): negate(has(f))], lambda a, b: a | b)
    if isinstance(tree, Alive):
        created = dated("creation_date", day <= F.lit(tree.low))
        later = dated("deletion_date", day >= F.lit(tree.high))
        deleted = dated("deletion_date", F.lit(True))
        return lambda f: created(f) & (later(f) | negate(deleted(f)))
    word = tree.word.lower()
    if "*" not in word:
        if forms.get(word) is None:
            return always
        return token(col.isin(*[f"^{w}$" for w in forms[word]]))
    if word.endswith("*") and word.count("*") == 1:
        prefix = "^" + word[:-1]
        if index.prefix_mode == "range":
            return token((col >= prefix) & (col < prefix[:-1] + "я"))
        return token(col.startswith(prefix))
    if not index.config.kgram:
        raise ValueError("wildcards inside a word need an index of k-grams")
    grams = [g for part in f"^{word}$".split("*") for g in re.findall(r"[^$]*\$|[^$]+", part) if len(g) >= 3]
    if any(len(g) > index.config.kgram for g in grams):
        return never
    return both([token(col == g) for g in grams], lambda a, b: a & b) if grams else always
