"""Substring dedup by fixed-block anchors.

A word goes if some window of `window` words around it also starts in a document with a smaller doc_id. Every window holds
a whole block of half its length on its own document's grid, so:

1. Index the non-overlapping blocks of every document, and probe them with every rolling window of that length of all
   documents. A block is an anchor if the probes of two documents carry it.
2. Extend anchors: each window around one is hashed whole, and a window that has a smaller holder marks its words.
   Neighbouring marked windows make up the maximal repeats, whose words are then cut from the texts.

Both exchanges send sorted fingerprints of a chunk of documents as a few packed blobs per hash bucket, not rows. A chunk
settles by itself what its own documents repeat, and sends one entry for each of its distinct windows, so a passage that a
third of all documents hold costs an entry per chunk. Buckets are as many as the texts' size asks for, so a task's share stays
the same as the input grows. Anchors may be false (28-bit fingerprints within a bucket), which costs work, not words; windows
are compared by two independent 64-bit hashes of their words, which for 10**13 windows are all right but with a chance below
10**-12. Only texts with anchors, and then with repeats, are shuffled, found by bounded bloom filters.

Defined results: a null text has no words; null doc_ids take no part and keep their text; rows that share a doc_id are
separate texts, of which none is smaller than the other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.jaccard import bloom, may_hold
from quillon.llm.words import U64, chunks, lean, mix, split, windows
from quillon.runtime import Scratch, small_batches

_PRINT_BITS = 28
#: Bytes of text for a bucket: some four million windows.
BUCKET_BYTES = 24 << 20


def _pack(sorted_prints: np.ndarray) -> bytes:
    """Ascending numbers as byte planes of their gaps, which the shuffle's compression shrinks well."""
    gaps = np.diff(sorted_prints, prepend=np.uint32(0)).astype("<u4")
    return gaps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def _first_of_equal(hashes: np.ndarray, checks: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each place, the first value of its run of equal hashes and checks."""
    if not len(hashes):
        return values
    heads = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])))
    return np.repeat(values[heads], np.diff(np.append(heads, len(hashes))))


_ANCHOR_ROW = "bucket int, probes binary, twice binary, prints binary, doc binary, text_hash binary, block binary, settled boolean"


def _probes(block: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per chunk and bucket: the distinct probes, which of them two documents hold, and the blocks they do not settle."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = split(part.column("text"))
                hashed, at = windows(words, words.hashes(), block)
                if not len(at):
                    continue
                bucket = (hashed >> U64(32)) % U64(buckets)
                key = bucket << U64(_PRINT_BITS) | hashed & U64((1 << _PRINT_BITS) - 1)
                order = np.argsort(key, kind="stable")
                key, at = key[order], at[order]
                doc = words.doc[at]
                heads = _runs(key)
                run_of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(key))))
                twice = np.zeros(len(heads), dtype=bool)
                twice[run_of[1:][(key[1:] == key[:-1]) & (doc[1:] != doc[:-1])]] = True
                inside = at - words.first[doc]
                blocks = np.flatnonzero(inside % block == 0)
                settled = twice[run_of[blocks]]
                ids = part.column("doc_id").to_numpy()
                text_hash = part.column("text_hash").to_numpy()
                rows = []
                distinct = key[heads]
                cuts = np.append(_runs(distinct >> U64(_PRINT_BITS)), len(distinct))
                open_blocks = blocks[~settled]
                open_bucket = (key[open_blocks] >> U64(_PRINT_BITS)).astype(np.int64)
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    name = int(distinct[a] >> U64(_PRINT_BITS))
                    lo, hi = np.searchsorted(open_bucket, [name, name + 1])
                    mine = open_blocks[lo:hi]
                    prints = (distinct[a:b] & U64((1 << _PRINT_BITS) - 1)).astype(np.uint32)
                    rows.append((name, _pack(prints), np.packbits(twice[a:b]).tobytes(), *_entries(key, doc, inside, mine, ids, text_hash, block), False))
                done = blocks[settled]
                if len(done):
                    name = int(mix(ids[:1].astype(np.int64).view(U64))[0] % U64(buckets))
                    rows.append((name, b"", b"", *_entries(key, doc, inside, done, ids, text_hash, block), True))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int32()] + [pa.binary()] * 6 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in _ANCHOR_ROW.split(", ")])

    return run


def _entries(key, doc, inside, at, ids, text_hash, block) -> tuple[bytes, bytes, bytes, bytes]:
    prints = (key[at] & U64((1 << _PRINT_BITS) - 1)).astype("<u4")
    return prints.tobytes(), ids[doc[at]].tobytes(), text_hash[doc[at]].tobytes(), (inside[at] // block).astype("<i4").tobytes()


def _joined(table: pa.Table, name: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=dtype)


def _anchors(table: pa.Table) -> pa.Table:
    """The blocks of one bucket that the probes of two documents carry."""
    open_ = table.filter(pa.compute.invert(table.column("settled")))
    prints = [_unpack(p) for p in open_.column("probes").to_pylist()]
    twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(p)).astype(bool) for t, p in zip(open_.column("twice").to_pylist(), prints, strict=True)]
    every = np.concatenate(prints) if prints else np.zeros(0, np.uint32)
    many = np.unique(every[np.concatenate(twice)]) if prints else every
    every.sort()
    many = np.union1d(many, every[1:][every[1:] == every[:-1]])
    hit = np.isin(_joined(open_, "prints", "<u4"), many)
    sure = table.filter(table.column("settled"))
    out = []
    for name, dtype in (("doc", "<i8"), ("text_hash", "<i8"), ("block", "<i4")):
        out.append(pa.array(np.concatenate([_joined(open_, name, dtype)[hit], _joined(sure, name, dtype)])))
    return pa.Table.from_arrays(out, ["doc_id", "text_hash", "block"])


_WINDOW_ROW = "bucket int, hashes binary, checks binary, doc binary, text_hash binary, first binary, settled boolean"


def _windows(window: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per chunk and bucket: hashes of the windows around anchors, for the smallest document of the chunk that holds each.

    A window's bucket is drawn from the least hash of the half windows in it, so neighbours mostly go together and come back
    as runs. Windows with a smaller holder in the chunk are settled, and only passed on.
    """
    block = window // 2

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = split(part.column("text"))
                hashes = words.hashes()
                whole, at = windows(words, hashes, window)
                if not len(at):
                    continue
                check, _ = windows(words, words.hashes(second=True), window, second=True)
                near = np.zeros(len(words.doc) + window + 1, dtype=np.int32)
                marks = part.column("blocks")
                row = np.repeat(np.arange(part.num_rows), np.diff(marks.offsets.to_numpy()))
                place = words.first[row] + marks.flatten().to_numpy().astype(np.int64) * block
                np.add.at(near, np.maximum(place - (window - block), 0), 1)
                np.add.at(near, place + 1, -1)
                wanted = np.cumsum(near)[at] > 0
                half, half_at = windows(words, hashes, block)
                least = np.full(len(words.doc) + 1, np.iinfo(np.uint64).max, dtype=U64)
                least[half_at] = half
                whole, check, at = whole[wanted], check[wanted], at[wanted]
                if not len(at):
                    continue
                span, reach = window - block + 1, 1
                while reach * 2 <= span:
                    least[: len(least) - reach] = np.minimum(least[: len(least) - reach], least[reach:])
                    reach *= 2
                bucket = mix(np.minimum(least[at], least[at + span - reach])) % U64(buckets)
                ids = part.column("doc_id").to_numpy()
                text_hash = part.column("text_hash").to_numpy()
                doc = words.doc[at]
                order = np.lexsort((ids[doc], check, whole))
                least_id = _first_of_equal(whole[order], check[order], ids[doc][order])
                sure = np.empty(len(order), dtype=bool)
                sure[order] = least_id < ids[doc][order]
                rows = []
                first = (at - words.first[doc]).astype("<i4")
                open_ = np.flatnonzero(~sure)
                open_ = open_[np.argsort(bucket[open_], kind="stable")]
                cuts = np.append(_runs(bucket[open_]), len(open_))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    mine = open_[a:b]
                    rows.append((int(bucket[mine[0]]), whole[mine].tobytes(), check[mine].tobytes(), ids[doc[mine]].tobytes(), text_hash[doc[mine]].tobytes(), first[mine].tobytes(), False))
                done = np.flatnonzero(sure)
                if len(done):
                    name = int(mix(ids[:1].astype(np.int64).view(U64))[0] % U64(buckets))
                    rows.append((name, b"", b"", ids[doc[done]].tobytes(), text_hash[doc[done]].tobytes(), first[done].tobytes(), True))
                if rows:
                    kinds = [pa.int32()] + [pa.binary()] * 5 + [pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in _WINDOW_ROW.split(", ")])

    return run


def _repeats(table: pa.Table) -> pa.Table:
    """Runs of window starts of one bucket that have a smaller holder: doc_id, text_hash, low, high."""
    open_ = table.filter(pa.compute.invert(table.column("settled")))
    sure = table.filter(table.column("settled"))
    hashes, checks, doc = _joined(open_, "hashes", "<u8"), _joined(open_, "checks", "<u8"), _joined(open_, "doc", "<i8")
    order = np.lexsort((doc, checks, hashes))
    hit = order[doc[order] > _first_of_equal(hashes[order], checks[order], doc[order])]
    cols = [np.concatenate([_joined(open_, c, t)[hit], _joined(sure, c, t)]) for c, t in (("doc", "<i8"), ("text_hash", "<i8"), ("first", "<i4"))]
    doc, text_hash, first = (c[o] for o in [np.lexsort((cols[2], cols[1], cols[0]))] for c in cols)
    heads = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (text_hash[1:] != text_hash[:-1]) | (first[1:] > first[:-1] + 1))) if len(doc) else np.zeros(0, np.int64)
    ends = np.append(heads[1:], len(doc)) - 1 if len(doc) else heads
    return pa.Table.from_arrays([pa.array(doc[heads]), pa.array(text_hash[heads]), pa.array(first[heads]), pa.array(first[ends])], ["doc_id", "text_hash", "low", "high"])


def _filter(ids: DataFrame) -> Broadcast:
    """A bloom filter of the ids, sent to all tasks."""
    return ids.sparkSession.sparkContext.broadcast(bloom(ids, ids.count()))


def _may_hold(filter_: Broadcast, ids: pa.Array) -> np.ndarray:
    """Whether each doc_id may be one of those the filter was made of; a null is none of them."""
    return may_hold(filter_.value, pa.compute.fill_null(ids, 0).to_numpy(zero_copy_only=False)) & np.asarray(ids.is_valid())


def _known(docs: DataFrame, filter_: Broadcast) -> DataFrame:
    """Rows whose doc_id may be in the filter."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_may_hold(filter_, batch.column("doc_id"))))

    return docs.mapInArrow(run, docs.schema)


def cut_words(words: list[bytes], ranges: list[dict] | None, window: int) -> list[bytes]:
    """The words outside the windows that start at any range's low to high."""
    if not ranges:
        return words
    kept, at = [], 0
    for r in sorted(ranges, key=lambda r: r["low"]):
        kept += words[at : max(at, r["low"])]
        at = max(at, r["high"] + window)
    return kept + words[at:]


def _texts(window: int, keep: tuple[str, ...], but: Broadcast | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The result's rows; without those that _known() finds by the filter `but`, if one is given."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if but is not None:
                batch = batch.filter(pa.array(~_may_hold(but, batch.column("doc_id"))))
            total, kept = [], []
            gone = batch.column("ranges").to_pylist()
            for text, ranges in zip(batch.column("text").to_pylist(), gone, strict=True):
                words = (text or "").encode().split()  # of bytes: at 0x20 and 0x09-0x0D
                total.append(len(words))
                kept.append(cut_words(words, ranges, window))
            yield pa.RecordBatch.from_arrays(
                [
                    *map(batch.column, keep),
                    pa.array(total, pa.int64()),
                    pa.array([n - len(k) for n, k in zip(total, kept, strict=True)], pa.int64()),
                    pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k in kept]),
                    pa.array([None if not r else b" ".join(k).decode() for k, r in zip(kept, gone, strict=True)], pa.string()),
                ],
                [*keep, "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return run


def dedup(docs: DataFrame, window: int = 50, texts: bool = True, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, n_words, n_removed, kept_sha256 of each row, and `kept`: the kept words where some went, else null.

    window must be even. `texts`: whether to return kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "substring")
    block = window // 2
    held = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // BUCKET_BYTES))
    more = [c for c in keep if c not in ("doc_id", "text")]
    source = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"), F.struct(F.lit(0).alias("_"), *more).alias("more"))
    live = source.select("doc_id", "text", "text_hash").filter("doc_id is not null and text is not null")
    probes = live.mapInArrow(_probes(block, buckets), _ANCHOR_ROW)
    anchors = probes.groupBy("bucket").applyInArrow(_anchors, "doc_id long, text_hash long, block int")
    anchors = scratch.table(anchors.groupBy("doc_id", "text_hash").agg(F.collect_set("block").alias("blocks")), "anchors")
    near = _known(live, _filter(anchors.select(F.col("doc_id").alias("id")))).join(anchors.hint("merge"), ["doc_id", "text_hash"])
    repeats = near.mapInArrow(_windows(window, buckets), _WINDOW_ROW).groupBy("bucket").applyInArrow(_repeats, "doc_id long, text_hash long, low int, high int")
    ranges = scratch.table(repeats.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("low", "high")).alias("ranges")), "ranges")
    passed = _filter(ranges.select(F.col("doc_id").alias("id")))
    names = ["doc_id", "text", *[f"more.{c}" for c in more], "ranges"]
    cut = _known(source, passed).join(ranges.hint("merge"), ["doc_id", "text_hash"], "left").select(*names)
    whole = source.withColumn("ranges", F.lit(None).cast(ranges.schema["ranges"].dataType)).select(*names)
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", n_words long, n_removed long, kept_sha256 string, kept string"
    # Each side has its own _texts, and the other rows are told apart there: a task then never has two Python workers at once.
    out = whole.mapInArrow(_texts(window, keep, but=passed), schema).unionByName(cut.mapInArrow(_texts(window, keep), schema))
    return out if texts else out.drop("kept")
