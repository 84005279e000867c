"""Language identification: script ranges, word scores and Viterbi over spans of mixed text.

A model holds, for each learned language, log frequencies of hashed letter trigrams (a letter with its neighbours inside the
word) and its share of letters by script. Counts cover all training rows; only sums, bounded by languages times buckets,
reach the driver. To label a text, the script of a word narrows the languages to those that use it, each word is scored
under those, and Viterbi with a penalty for switching labels the words; runs of one label are spans. The label that holds
most letters is the prediction, its share of all letters the score.

Viterbi runs over all texts of a chunk in step: words are cut into short segments, each segment gives a small matrix of
best scores between states, the matrices chain per text, and the segments are then traced back together.

Defined results: a null text or one without a letter is `und` with score 0; without training rows all are `und`; training rows
of more than MOST_LANGUAGES languages are an error; ties go to the language that sorts first; rows repeat freely; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.words import chunks, lean
from quillon.runtime import small_batches

UND = "und"
BUCKETS = 1 << 16
#: A model, which is sent to all tasks, holds BUCKETS numbers a language; segments hold the square of the languages.
MOST_LANGUAGES = 256
SEGMENT = 64
#: Bytes of text that are worked on at a time; arrays hold about forty times as much.
CHUNK = 500_000

# First and last code point of the blocks that hold a script's letters. Code 0 is any other script.
SCRIPTS = (
    ("Latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A))),
    ("Greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("Cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("Armenian", ((0x530, 0x58F),)),
    ("Hebrew", ((0x590, 0x5FF),)),
    ("Arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("Devanagari", ((0x900, 0x97F),)),
    ("Bengali", ((0x980, 0x9FF),)),
    ("Tamil", ((0xB80, 0xBFF),)),
    ("Thai", ((0xE00, 0xE7F),)),
    ("Georgian", ((0x10A0, 0x10FF),)),
    ("Kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("Han", ((0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F))),
    ("Hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
)


class _Letters:
    """Lower-case letter of each code point (0: no letter), filled in as code points turn up."""

    def __init__(self) -> None:
        self.known = np.zeros(0x110000, dtype=bool)
        self.lower = np.zeros(0x110000, dtype=np.uint32)

    def of(self, codes: np.ndarray) -> np.ndarray:
        present = np.flatnonzero(np.bincount(codes, minlength=1))
        for c in present[~self.known[present]].tolist():
            char = chr(c)
            low = char.lower()
            self.lower[c] = (ord(low) if len(low) == 1 else c) if char.isalpha() else 0
            self.known[c] = True
        return self.lower[codes]


_LETTERS = _Letters()
_SCRIPT_STARTS = np.array(sorted(a for _, blocks in SCRIPTS for a, _ in blocks))
_SCRIPT_OF = {a: (b, i + 1) for i, (_, blocks) in enumerate(SCRIPTS) for a, b in blocks}
_SCRIPT_ENDS = np.array([_SCRIPT_OF[a][0] for a in _SCRIPT_STARTS])
_SCRIPT_CODES = np.array([_SCRIPT_OF[a][1] for a in _SCRIPT_STARTS])


def scripts(letters: np.ndarray) -> np.ndarray:
    at = np.maximum(np.searchsorted(_SCRIPT_STARTS, letters, side="right") - 1, 0)
    inside = (letters >= _SCRIPT_STARTS[at]) & (letters <= _SCRIPT_ENDS[at])
    return np.where(inside, _SCRIPT_CODES[at], 0)


@dataclass
class _Chunk:
    """Letters of a chunk of texts, and its words as runs of letters."""

    bucket: np.ndarray  # of each letter
    script: np.ndarray  # of each word
    first: np.ndarray  # index of each word's first letter among the letters
    start: np.ndarray  # code points of each word within its text
    end: np.ndarray
    doc: np.ndarray  # row of each word


def _read(texts: list[str | None]) -> _Chunk:
    texts = [t or "" for t in texts]
    bounds = np.append(0, np.cumsum([len(t) for t in texts]))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = np.zeros(len(codes) + 2, dtype=np.uint32)
    letters[1:-1] = _LETTERS.of(codes)
    at = np.flatnonzero(letters)
    edge = np.zeros(len(codes) + 3, dtype=bool)
    edge[bounds + 1] = True
    opens = (letters[at - 1] == 0) | edge[at]
    closes = (letters[at + 1] == 0) | edge[at + 1]
    before = np.where(opens, np.uint32(0), letters[at - 1])
    after = np.where(closes, np.uint32(0), letters[at + 1])
    h = before * np.uint32(0x9E3779B1) ^ letters[at] * np.uint32(0x85EBCA77) ^ after * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    first = np.flatnonzero(opens)
    start, end = at[first] - 1, at[closes]
    doc = np.searchsorted(bounds, start, side="right") - 1
    return _Chunk((h & np.uint32(BUCKETS - 1)).astype(np.int32), scripts(letters[at[first]]), first, start - bounds[doc], end - bounds[doc], doc)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: log frequencies
    allowed: np.ndarray  # scripts x languages


def fit(train: DataFrame, smooth: float = 0.5, least_share: float = 0.01) -> Model:
    """Learn from the rows of train (text, lang) with a text and a lang."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                langs = np.array(part.column("lang").to_pylist(), dtype=object)
                for lang in sorted(set(langs)):
                    chunk = _read(part.column("text").take(pa.array(np.flatnonzero(langs == lang))).to_pylist())
                    sums = total.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS) + 1, dtype=np.int64))
                    sums[:BUCKETS] += np.bincount(chunk.bucket, minlength=BUCKETS)
                    sizes = np.diff(np.append(chunk.first, len(chunk.bucket)))
                    sums[BUCKETS:] += np.bincount(chunk.script, sizes, len(SCRIPTS) + 1).astype(np.int64)
        for lang, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(sums[at])], ["lang", "bucket", "n"])

    small_batches(train.sparkSession)
    rows = train.filter("text is not null and lang is not null").select("text", "lang")
    counts = rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(counts.column("lang").to_pylist(), dtype=object)
    languages = sorted(set(names))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} languages in the training rows; a model holds {MOST_LANGUAGES} at most")
    sums = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(languages)))
    sums[counts.column("bucket").to_numpy(), np.searchsorted(np.array(languages, dtype=object), names)] = counts.column("n").to_numpy()
    grams, by_script = sums[:BUCKETS], sums[BUCKETS:]
    table = np.log((grams + smooth) / (grams.sum(0) + smooth * BUCKETS)) if languages else grams
    allowed = by_script >= least_share * np.maximum(by_script.sum(0), 1)
    allowed[~allowed.any(1)] = True
    return Model(languages, table.astype(np.float32), allowed)


def viterbi(scores: np.ndarray, doc: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word: the sum of its scores, less `penalty` for each change within a row."""
    n, states = scores.shape
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    opens = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    inside = np.arange(n) - np.repeat(opens, np.diff(np.append(opens, n)))
    head = np.flatnonzero(inside % SEGMENT == 0)
    sizes = np.diff(np.append(head, n))
    order = np.argsort(-sizes, kind="stable")  # longest first: those still running are a prefix
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    live = [int((sizes > t).sum()) for t in range(int(sizes.max()))]
    at = head[order]
    chain = np.full((len(head), states, states), -np.inf, dtype=np.float32)
    chain[:, np.arange(states), np.arange(states)] = 0
    for t, k in enumerate(live):
        part = chain[:k]
        chain[:k] = np.maximum(part, part.max(2, keepdims=True) - penalty) + scores[at[:k] + t][:, None, :]
    # Chain the segments of each row: the i-th segments of all rows at once.
    place = (inside[head] // SEGMENT)[order]
    row = np.searchsorted(opens, at, side="right") - 1
    by_place = np.argsort(place, kind="stable")
    groups = np.split(by_place, np.cumsum(np.bincount(place))[:-1])
    value = np.zeros((len(opens), states), dtype=np.float32)
    enter = np.zeros((len(head), states), dtype=np.float32)
    for g in groups:
        enter[g] = value[row[g]]
        now = (enter[g][:, :, None] + chain[g]).max(1)
        value[row[g]] = now - now.max(1, keepdims=True)
    last = value.argmax(1)
    start = np.zeros(len(head), dtype=np.int64)
    stop = np.zeros(len(head), dtype=np.int64)
    for g in reversed(groups):
        stop[g] = last[row[g]]
        start[g] = (enter[g] + chain[g, :, stop[g]]).argmax(1)
        last[row[g]] = start[g]
    # Inside a segment both ends are known now.
    value = np.full((len(head), states), -np.inf, dtype=np.float32)
    value[np.arange(len(head)), start] = 0
    come = np.zeros((len(live), len(head), states), dtype=np.int8 if states < 128 else np.int32)
    for t, k in enumerate(live):
        part = value[:k]
        best = part.argmax(1)
        jump = part[np.arange(k), best][:, None] - penalty
        switch = jump > part
        come[t, :k] = np.where(switch, best[:, None], np.arange(states))
        value[:k] = np.where(switch, jump, part) + scores[at[:k] + t]
    labels = np.zeros(n, dtype=np.int64)
    state = stop.copy()
    for t in range(len(live) - 1, -1, -1):
        k = live[t]
        labels[at[:k] + t] = state[:k]
        state[:k] = come[t, np.arange(k), state[:k]]
    return labels


def identify(docs: DataFrame, model: Model, penalty: float = 12.0, spans: bool = True, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, lang_pred, score and, if asked for, spans (start, end, lang) in code points of each text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        names = np.array([*m.languages, UND], dtype=object)
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                n = part.num_rows
                pred, score, found = np.full(n, len(m.languages)), np.zeros(n), [[] for _ in range(n)]
                chunk = _read(part.column("text").to_pylist())
                if m.languages and len(chunk.first):
                    scores = np.add.reduceat(m.table[chunk.bucket], chunk.first, axis=0)
                    scores = np.where(m.allowed[chunk.script], scores, np.float32(-1e4))
                    scores -= scores.max(1, keepdims=True)
                    labels = viterbi(scores, chunk.doc, penalty)
                    sizes = chunk.end - chunk.start
                    held = np.zeros((n, len(m.languages)))
                    np.add.at(held, (chunk.doc, labels), sizes)
                    has = held.sum(1) > 0
                    pred[has] = held[has].argmax(1)
                    score[has] = held[has].max(1) / held[has].sum(1)
                    if spans:
                        cut = np.flatnonzero(np.append(True, (chunk.doc[1:] != chunk.doc[:-1]) | (labels[1:] != labels[:-1])))
                        stop = np.append(cut[1:], len(labels)) - 1
                        for a, b in zip(cut.tolist(), stop.tolist(), strict=True):
                            found[chunk.doc[a]].append({"start": int(chunk.start[a]), "end": int(chunk.end[b]), "lang": names[labels[a]]})
                out = [*map(part.column, keep), pa.array(names[pred], pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(out + [pa.array(found, span)] * spans, [*keep, "lang_pred", "score"] + ["spans"] * spans)

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double"
    schema += ", spans array<struct<start:int,end:int,lang:string>>" * spans
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; null ids are neither held out nor learned from."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2
