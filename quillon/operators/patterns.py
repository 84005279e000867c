"""Matching many patterns: exact lookup, all occurrences, and regular-language algebra.

Patterns are a table (id, pattern); one pattern may have several ids. Occurrences are reported as (id, end), end being the
1-based position of the last symbol, longer patterns first at one end.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T

#: An automaton is sent to executors only for pattern tables up to this many symbols; larger ones are joined.
MOST_SYMBOLS = 4_000_000


def lookup(words: DataFrame, patterns: DataFrame) -> DataFrame:
    """Ids of the patterns that equal each word (column word): an equi-join."""
    return words.join(patterns.withColumnRenamed("pattern", "word"), "word")


def prefixes(patterns: DataFrame) -> DataFrame:
    """The trie as a transition table: state (a prefix), symbol, next_state, ids accepted there."""
    cut = patterns.select("id", "pattern", F.explode(F.sequence(F.lit(1), F.length("pattern"))).alias("n")).filter("length(pattern) > 0")
    rows = cut.select(
        F.expr("substring(pattern, 1, n - 1)").alias("state"),
        F.expr("substring(pattern, n, 1)").alias("symbol"),
        F.expr("substring(pattern, 1, n)").alias("next_state"),
        F.when(F.col("n") == F.length("pattern"), F.col("id")).alias("id"),
    )
    return rows.groupBy("state", "symbol", "next_state").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def occurrences(texts: DataFrame, patterns: DataFrame, key: str = "text_id") -> DataFrame:
    """(key, id, end) of every occurrence in texts (key, text); empty patterns and null texts match nothing.

    A small pattern table becomes an automaton on every executor; a large one is joined to the text's windows.
    """
    sized = patterns.filter("length(pattern) > 0").select(F.col("id").cast("long").alias("id"), "pattern")
    symbols = sized.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()[0]
    return _automaton(texts, sized, key) if symbols <= MOST_SYMBOLS else joined(texts, sized, key)


def joined(texts: DataFrame, patterns: DataFrame, key: str = "text_id") -> DataFrame:
    """Occurrences by an equi-join of patterns with all windows of their lengths."""
    lengths = sorted(r[0] for r in patterns.select(F.length("pattern")).distinct().collect())

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length("text") - n + 1, F.lit(1)))
        rows = F.transform(starts, lambda i: F.struct((i + n - 1).alias("end"), F.substring(F.col("text"), i, n).alias("pattern")))
        return F.when(F.length("text") >= n, rows).otherwise(F.array().cast("array<struct<end:int,pattern:string>>"))

    if not lengths:
        return texts.select(key, F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("end")).limit(0)
    rows = texts.filter("text is not null").select(key, F.explode(F.flatten(F.array(*map(of_length, lengths)))).alias("w")).select(key, "w.*")
    return rows.join(patterns, "pattern").select(key, "id", F.col("end").cast("long").alias("end"))


def _automaton(texts: DataFrame, patterns: DataFrame, key: str) -> DataFrame:
    by_pattern: dict[str, list[int]] = {}
    for row in patterns.collect():
        by_pattern.setdefault(row["pattern"], []).append(row["id"])
    shared = texts.sparkSession.sparkContext.broadcast({p: sorted(set(i)) for p, i in by_pattern.items()})
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for pattern, ids in shared.value.items():
            machine.add_word(pattern, ids)
        if shared.value:
            machine.make_automaton()
        for batch in batches:
            row, found, end = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for at, ids in machine.iter(text) if text and shared.value else ():
                    for pattern_id in ids:
                        row.append(i)
                        found.append(pattern_id)
                        end.append(at + 1)
            keys = batch.column(key).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(found, pa.int64()), pa.array(end, pa.int64())], [key, "id", "end"])

    return texts.select(key, "text").mapInArrow(run, f"{key} {kind}, id long, end long")


def symbol_matches(texts: DataFrame, patterns: DataFrame, key: str = "text_id") -> DataFrame:
    """Per symbol of each text the ids of the patterns that end there, the last symbol included."""
    found = occurrences(texts, patterns, key).groupBy(key, "end").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    each = texts.filter("length(text) > 0").select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.length("text").cast("long"))).alias("end"))
    return each.join(found, [key, "end"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))


@dataclass
class Nfa:
    """A nondeterministic automaton; symbol None is an empty move. State 0 starts."""

    moves: dict[int, list[tuple[str | None, int]]] = field(default_factory=dict)
    accepts: dict[int, set[int]] = field(default_factory=dict)
    size: int = 1

    @classmethod
    def word(cls, text: str, pattern_id: int = 0) -> Nfa:
        out = cls({i: [(c, i + 1)] for i, c in enumerate(text)}, {len(text): {pattern_id}}, len(text) + 1)
        return out

    def copy_into(self, other: Nfa) -> int:
        """Add this automaton's states to another; returns where they begin."""
        base = other.size
        for state, moves in self.moves.items():
            other.moves.setdefault(base + state, []).extend((c, base + to) for c, to in moves)
        other.size += self.size
        return base

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        seen, queue = set(states), deque(states)
        while queue:
            for c, to in self.moves.get(queue.popleft(), ()):
                if c is None and to not in seen:
                    seen.add(to)
                    queue.append(to)
        return frozenset(seen)

    def step(self, states: Iterable[int], symbol: str) -> frozenset[int]:
        return self.closure({to for s in states for c, to in self.moves.get(s, ()) if c == symbol})

    def symbols(self, states: Iterable[int]) -> set[str]:
        return {c for s in states for c, _ in self.moves.get(s, ()) if c is not None}

    def accepted(self, states: Iterable[int]) -> set[int]:
        return {i for s in states for i in self.accepts.get(s, ())}

    def match(self, text: str) -> set[int]:
        states = self.closure({0})
        for c in text:
            states = self.step(states, c)
        return self.accepted(states)

    def then(self, other: Nfa) -> Nfa:
        out = Nfa()
        a, b = self.copy_into(out), other.copy_into(out)
        out.moves.setdefault(0, []).append((None, a))
        for state in self.accepts:
            out.moves.setdefault(a + state, []).append((None, b))
        out.accepts = {b + s: set(i) for s, i in other.accepts.items()}
        return out

    def star(self) -> Nfa:
        out = Nfa()
        a = self.copy_into(out)
        out.moves.setdefault(0, []).append((None, a))
        out.accepts = {a + s: set(i) for s, i in self.accepts.items()}
        for state in self.accepts:
            out.moves.setdefault(a + state, []).append((None, a))
        out.accepts[0] = self.accepted(self.accepts)
        return out

    def reverse(self) -> Nfa:
        out = Nfa(size=self.size + 1)
        for state, moves in self.moves.items():
            for c, to in moves:
                out.moves.setdefault(to + 1, []).append((c, state + 1))
        out.moves.setdefault(0, []).extend((None, s + 1) for s in self.accepts)
        out.accepts = {1: self.accepted(self.accepts)}
        return out

    def determined(self) -> Dfa:
        """The subset construction."""
        start = self.closure({0})
        names, queue, table, accepts = {start: 0}, deque([start]), [], []
        while queue:
            states = queue.popleft()
            row = {}
            for c in sorted(self.symbols(states)):
                to = self.step(states, c)
                if to not in names:
                    names[to] = len(names)
                    queue.append(to)
                row[c] = names[to]
            table.append(row)
            accepts.append(self.accepted(states))
        return Dfa(table, accepts)

    def __str__(self) -> str:
        """States in breadth-first order with their moves and ids."""
        order, queue = {0: 0}, deque([0])
        lines = []
        while queue:
            s = queue.popleft()
            told = []
            for c, to in self.moves.get(s, ()):
                if to not in order:
                    order[to] = len(order)
                    queue.append(to)
                told.append(f"{'ε' if c is None else c}->{order[to]}")
            ids = sorted(self.accepts.get(s, ()))
            lines.append(f"{order[s]}: {' '.join(told)}" + (f" accepts {ids}" if ids else ""))
        return "\n".join(lines)


def any_of(*machines: Nfa) -> Nfa:
    """The union of automata."""
    out = Nfa()
    for m in machines:
        base = m.copy_into(out)
        out.moves.setdefault(0, []).append((None, base))
        out.accepts |= {base + s: set(i) for s, i in m.accepts.items()}
    return out


@dataclass(frozen=True)
class Dfa:
    """A deterministic automaton: a move table and the ids of each state."""

    table: list[dict[str, int]]
    accepts: list[set[int]]

    def match(self, text: str) -> set[int]:
        state = 0
        for c in text:
            if (state := self.table[state].get(c, -1)) < 0:
                return set()
        return self.accepts[state]

    def minimal(self) -> Dfa:
        """Merge states that no text tells apart."""
        group: list = [tuple(sorted(a)) for a in self.accepts]
        while True:
            sign = [(group[s], tuple(sorted((c, group[t]) for c, t in row.items()))) for s, row in enumerate(self.table)]
            names = {x: i for i, x in enumerate(dict.fromkeys(sign))}
            now = [names[x] for x in sign]
            if len(set(now)) == len(set(group)):
                break
            group = now
        table, accepts = [{} for _ in set(now)], [set() for _ in set(now)]
        for s, row in enumerate(self.table):
            table[now[s]] = {c: now[t] for c, t in row.items()}
            accepts[now[s]] = self.accepts[s]
        return Dfa(table, accepts)

    def transitions(self, spark) -> DataFrame:
        """The move table as rows state, symbol, next_state."""
        return spark.createDataFrame([(s, c, t) for s, row in enumerate(self.table) for c, t in sorted(row.items())], "state int, symbol string, next_state int")

    def write(self, spark: SparkSession, path: str) -> None:
        """One row a state: its ids and its moves."""
        rows = [(s, sorted(self.accepts[s]), sorted(row.items())) for s, row in enumerate(self.table)]
        spark.createDataFrame(rows, "state int, ids array<int>, moves array<struct<symbol:string,next_state:int>>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Dfa:
        rows = spark.read.parquet(path).orderBy("state").collect()
        return cls([{m["symbol"]: m["next_state"] for m in r["moves"]} for r in rows], [set(r["ids"]) for r in rows])


def accepted(text: Column, machine: Dfa) -> Column:
    """The ids, ascending, of the languages a text is in; no id gives an empty array, a null text null.

    The automaton is part of the plan, as one alphabet and one list of next states a state, so texts stay in the JVM.
    """
    none = F.array().cast("array<int>")
    rows = [sorted(row.items()) for row in machine.table]
    alphabets = F.array(*[F.lit("".join(c for c, _ in row)) for row in rows])
    moves = F.array(*[F.array(*[F.lit(to) for _, to in row]).cast("array<int>") if row else none for row in rows])
    ids = F.array(*[F.array(*[F.lit(i) for i in sorted(a)]).cast("array<int>") if a else none for a in machine.accepts])

    def step(state: Column, symbol: Column) -> Column:
        at = F.position(symbol, F.get(alphabets, state)) - 1
        return F.coalesce(F.get(F.get(moves, state), at), F.lit(-1))

    last = F.aggregate(T.symbols(text), F.lit(0), step)
    return F.when(text.isNotNull(), F.coalesce(F.get(ids, last), none))
