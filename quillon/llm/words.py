"""Words of whole batches of texts as arrays: bounds, 64-bit hashes, shingles and rolling windows.

A word is a maximal run of bytes other than space and 0x09-0x0D. All work is on the UTF-8 bytes of an Arrow column, for
a chunk of documents at a time, so no Python object is made for a word.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1_000_000
#: Words that are hashed at a time; arrays hold about forty bytes for each byte of them.
_SLICE_WORDS = 30_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix: a bijection that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
# The second of each gives hashes that are independent of the first's.
_BYTE_CODES = (_BYTE_CODE, mix(_BYTE_CODE ^ U64(0x3C79AC492BA7B653)))
_WORD_BASES = (0xD6E8FEB86659FD93, 0x9FB21C651E98DF25)
_ROLL_BASES = (0xA24BAED4963EE407, 0xE7037ED1A0B428DB)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), U64(base), dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and the n+1 bounds of the rows. A null is an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = texts.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts hold at most `most` bytes together; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start, batch.num_rows - start)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """Give freed memory back when a task ends: workers wait idle between tasks, several to an executor, and would keep it."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


@dataclass
class Words:
    """doc: row of each word; start, end: its byte bounds; first: words before each row (n+1 entries)."""

    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self, second: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes; with `second`, another one."""
        out = np.empty(len(self.start), dtype=U64)
        longest = int((self.end - self.start).max(initial=0))
        power = _powers(_WORD_BASES[second], longest)
        for a in range(0, len(out), _SLICE_WORDS):
            start, end = self.start[a : a + _SLICE_WORDS], self.end[a : a + _SLICE_WORDS]
            low, sizes = int(start[0]), end - start
            data = self.data[low : int(end[-1])]
            inside = np.arange(len(data), dtype=np.int64) - np.repeat(start - low, np.diff(np.append(start, end[-1])))
            inside[_SPACE[data]] = 0
            value = _BYTE_CODES[second][data] * power[inside]
            value[_SPACE[data]] = 0
            out[a : a + _SLICE_WORDS] = mix(np.add.reduceat(value, start - low) + sizes.astype(U64))
        return out


def split(texts: pa.Array, lower: bool = False) -> Words:
    """The words of each row. With `lower`, A-Z become a-z first; other letters stay."""
    data, bounds = text_bytes(texts)
    if lower:
        data = _LOWER[data]
    n = len(data)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    before = np.empty(n, dtype=bool)
    before[:1] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1:] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    doc = np.searchsorted(bounds, start, side="right") - 1
    first = np.zeros(len(bounds), dtype=np.int64)
    np.cumsum(np.bincount(doc, minlength=len(bounds) - 1), out=first[1:])
    return Words(data, doc, start, end, first)


def shingles(words: Words, hashes: np.ndarray, k: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each k-word shingle; a row of 1 to k-1 words gives its whole sequence as one."""
    n = len(hashes)
    power = _powers(_ROLL_BASES[second], k + 1)
    out, row = np.zeros(0, U64), np.zeros(0, np.int64)
    if n >= k:
        total = np.zeros(n - k + 1, dtype=U64)
        for i in range(k):
            total += hashes[i : n - k + 1 + i] * power[i + 1]
        whole = words.doc[: n - k + 1] == words.doc[k - 1 :]
        out, row = mix(total[whole]), words.doc[: n - k + 1][whole]
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), dtype=U64)
        for i in range(k - 1):
            has = counts[short] > i
            extra[has] += hashes[words.first[short[has]] + i] * power[i + 1]
        out = np.concatenate([out, mix(extra ^ mix(counts[short].astype(U64)))])
        row = np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        out, row = out[order], row[order]
    return out, row


def windows(words: Words, hashes: np.ndarray, k: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of k consecutive words of one row, and the index of its first word."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    power = _powers(_ROLL_BASES[second], n)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(hashes * power, out=total[1:])
    inverse = _powers(pow(_ROLL_BASES[second], -1, 1 << 64), n - k + 1)
    at = np.flatnonzero(words.doc[: n - k + 1] == words.doc[k - 1 :])
    return mix((total[at + k] - total[at]) * inverse[at]), at


def row_sets(shingle: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted within the row, and the rows+1 bounds."""
    order = np.lexsort((shingle, row))
    shingle, row = shingle[order], row[order]
    keep = np.ones(len(row), dtype=bool)
    keep[1:] = (shingle[1:] != shingle[:-1]) | (row[1:] != row[:-1])
    shingle, row = shingle[keep], row[keep]
    bounds = np.zeros(rows + 1, dtype=np.int64)
    np.cumsum(np.bincount(row, minlength=rows), out=bounds[1:])
    return shingle, bounds
