"""Best-fit packing of tokenized documents by length-histogram planning.

Documents become pieces of at most `capacity` token ids. Only the histogram of piece lengths (at most `capacity` numbers)
reaches the driver, where best fit decreasing runs over counts: one step places all pieces of a length that fit a class of
sequences with equal free space. The plan is a list of slot ranges, a piece takes a slot by its rank within its length, and
ranks come from salted windows, so neither a hot length nor the corpus ever meets in one task.

Defined results: a null text is empty (one piece with id 0 alone); rows repeat freely, each row is packed by itself; an
empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.words import lean
from quillon.runtime import Scratch, small_batches

#: Texts of these characters alone are split alike by both tokenizer libraries whatever their Unicode version.
_PLAIN = re.compile(r"[\x20-\x7e\n\r\t¡-ɏ]*")
#: A run of blanks this long between visible ASCII characters or the ends of the text. The splitting patterns backtrack over
#: such a run (one library overflows its stack); they would make one pre-token of it, less its last blank if text follows.
_BLANKS = re.compile(r"(?:(?<=[!-~])|\A)[\x20\n\r\t]{4096,}(?=[!-~]|\Z)")
#: Texts are encoded in parts of about this many characters, cut before a space that follows a visible ASCII character: a
#: pre-token starts there in any case.
_PART = 200_000
_CUT = re.compile(r"(?<=[!-~])\x20")


def parts(text: str) -> Iterator[tuple[str, bool]]:
    """Parts of a text whose ids one after the other are the text's ids, and whether a part is one pre-token of blanks."""
    at = 0
    for run in _BLANKS.finditer(text):
        low, high = run.span()
        high -= high < len(text)
        yield from ((part, False) for part in _cuts(text[at:low]))
        if high > low:
            yield text[low:high], True
        at = high
    yield from ((part, False) for part in _cuts(text[at:]))


def _cuts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > _PART and (cut := _CUT.search(text, at + _PART)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@functools.lru_cache(maxsize=4)
def load_tokenizer(name: str):
    """An encoder for the byte-level vocabulary `name`.json.

    The rank file beside it holds the same vocabulary; its library is about four times as fast and gives the same ids for
    plain texts. All other texts go through the tokenizers library itself.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    special = {t.content: i for i, t in exact.get_added_tokens_decoder().items() if t.special}
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(part: str, blanks: bool) -> list[int]:
        if blanks:
            return fast._encode_single_piece(part)
        if _PLAIN.fullmatch(part) and not any(s in part for s in special):
            return fast.encode_ordinary(part)
        return exact.encode(part, add_special_tokens=False).ids

    def encode(text: str) -> np.ndarray:
        return np.concatenate([np.array(ids(*part), dtype="<u4") for part in parts(text)])

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; all but the first are full."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenize(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_tokenizer(tokenizer)
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("src", "piece", "start", "length", "ids_crc32", "ids")}
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    rows["src"].append(i)
                    rows["piece"].append(piece)
                    rows["start"].append(start)
                    rows["length"].append(length)
                    rows["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        rows["ids"].append(part)
            out = {
                "doc_id": batch.column("doc_id").take(pa.array(rows["src"], pa.int64())),
                "piece": pa.array(rows["piece"], pa.int32()),
                "start": pa.array(rows["start"], pa.int64()),
                "length": pa.array(rows["length"], pa.int64()),
                "ids_crc32": pa.array(rows["ids_crc32"], pa.int64()),
            }
            if keep_ids:
                out["ids"] = pa.array(rows["ids"], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    small_batches(docs.sparkSession)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>" if keep_ids else ""))


@dataclass(frozen=True)
class Slots:
    """Pieces of `length` with ranks lo to hi-1 fill sequences from `first` on, `each` to a sequence, from place `base`."""

    length: int
    lo: int
    hi: int
    first: int
    each: int
    base: int


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Slots], int]:
    """Best fit decreasing over a length histogram: the slot ranges, and the number of sequences.

    Open sequences are kept as ranges by free space. A step uses up a range or the pieces of a length, so the plan has
    O(capacity) ranges of sequences however many documents there are.
    """
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)
    have = 0  # bit r: some sequence has r ids free
    slots: list[Slots] = []
    used = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fits = have >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                first, n = free[room].pop()
            else:
                room, first = capacity, used
                n = -(-left // (capacity // length))
                used += n
            each = min(room // length, left)
            take = min(n, left // each)
            slots.append(Slots(length, rank, rank + take * each, first, each, capacity - room))
            rank, left = rank + take * each, left - take * each
            if n > take:
                free[room].append((first + take, n - take))
            rest = room - each * length
            if rest:
                free[rest].append((first, take))
            for r in (room, rest):
                have = have | (1 << r) if free[r] else have & ~(1 << r)
    return slots, used


def ranked(pieces: DataFrame, salts: int) -> tuple[DataFrame, dict[int, int]]:
    """Pieces with their rank among those of equal length, and the length histogram.

    Each length is dealt over `salts` windows; a window's first rank is what the windows before it hold.
    """
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "salt", "before")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    place = salted.withColumn("place", F.row_number().over(order) - 1)
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = place.join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("place"))
    return rows.drop("salt", "place", "before"), counts


def assign(pieces: DataFrame, slots: list[Slots]) -> DataFrame:
    """Join pieces to their planned slots on length and rank. The plan is bounded by the capacity, so it is sent whole."""
    table = np.array([(s.length, s.lo, s.first, s.each, s.base) for s in slots], dtype=np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    shared = pieces.sparkSession.sparkContext.broadcast(table)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        lengths, begins = np.unique(rows[:, 0], return_index=True)
        ends = np.append(begins[1:], len(rows))
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.zeros(len(length), dtype=np.int64)
            where = np.searchsorted(lengths, length)
            for k in np.unique(where):
                mine = where == k
                at[mine] = begins[k] + np.searchsorted(rows[begins[k] : ends[k], 1], rank[mine], side="right") - 1
            _, lo, first, each, base = rows[at].T
            out = batch.drop_columns(["rank"])
            out = out.append_column("sequence_id", pa.array(first + (rank - lo) // each))
            yield out.append_column("offset", pa.array(base + (rank - lo) % each * length))

    kept = [f for f in pieces.schema.fields if f.name != "rank"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return pieces.mapInArrow(run, schema + ", sequence_id long, offset long")


def pack(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k",
    capacity: int = 2048,
    end_id: int = 0,
    keep_ids: bool = False,
) -> DataFrame:
    """Pack documents (doc_id, text) into as few sequences of at most `capacity` ids as best fit decreasing finds.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for.
    """
    spark = docs.sparkSession
    pieces = Scratch(spark, "packing").table(tokenize(docs, tokenizer, capacity, end_id, keep_ids), "pieces")
    rows, counts = ranked(pieces, salts=4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    slots, _ = plan(counts, capacity)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, "rank"]
    return assign(rows.select(*names), slots)
