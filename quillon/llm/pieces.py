"""SentencePiece encoding and decoding by suffix-array matching.

A text is written with U+2581 for spaces and one before it, and falls into units: a run of U+2581 and what follows up to the
next one. No piece crosses a unit, so a batch encodes each unit it has not met before once.
1. The new units are concatenated and indexed by suffix arrays over as many symbols as the longest piece has, each over a part
   of bounded size that reaches into the next one by that many symbols.
2. Every piece of the vocabulary is binary-searched for the range of suffixes that start with it; each occurrence is an edge
   from its first to its last symbol.
3. Edges are sorted by position, and a mask of lengths per position makes finding one a step.
4. Relaxing: units fall apart where no edge crosses. In rounds, each part replaces its best-scored pair of neighbours that an
   edge spans, the leftmost of equals, until none is left; a long part takes the same pairs from a heap, as it would need a
   round for each. That is the rule of a byte-pair model, whose result is not the cheapest path through the edges.

Symbols that no piece spells become their UTF-8 bytes. Ids equal those of the sentencepiece library.

Defined results: a null or empty text has no ids and decodes to the empty text; U+2581 in a text comes back as a space; rows
repeat freely; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.words import chunks, lean

SPACE = "▁"
_UNIT = re.compile(" +[^ ]*")
#: Parts of units with more symbols take their pairs from a heap instead of in rounds; the result is the same.
LONG = 200
#: Symbols that one suffix array indexes.
INDEXED = 400_000
#: Units remembered between the batches of a task, at most.
KEPT = 400_000
_NONE = np.int32(2**31 - 1)


class Vocabulary:
    """The pieces of a byte-pair model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        self.byte = np.array([i for i in every if model.is_byte(i)], dtype=np.int32)
        plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        text = {i: model.id_to_piece(i).replace(SPACE, " ") for i in plain}
        self.ids = {p: i for i, p in text.items()}
        scores = np.array([model.get_score(i) for i in every])
        self.order = np.searchsorted(np.unique(-scores), -scores).astype(np.int32)  # equal scores share a place
        self.spell = [b""] * len(every)
        for i, p in text.items():
            self.spell[i] = p.encode()
        for b, i in enumerate(self.byte.tolist()):
            self.spell[i] = bytes([b])
        # Symbols get places 1, 2, ... by code point; all that no piece spells share one that no piece has.
        self.symbols = np.array(sorted({ord(c) for p in self.ids for c in p}), dtype=np.uint32)
        self.foreign = len(self.symbols) + 1
        self.single = np.full(self.foreign + 1, -1, dtype=np.int32)
        long = []
        for p, i in self.ids.items():
            if len(p) == 1:
                self.single[self.places(np.array([ord(p)], dtype=np.uint32))[0]] = i
            else:
                long.append((p, i))
        self.size = np.array([len(p) for p, _ in long], dtype=np.int32)
        self.number = np.array([i for _, i in long], dtype=np.int32)
        self.longest = max(16, -(-int(self.size.max(initial=2)) // 4) * 4)
        codes = np.zeros((len(long), self.longest), dtype=np.uint32)
        for row, (p, _) in enumerate(long):
            codes[row, : len(p)] = [ord(c) for c in p]
        places = np.where(codes > 0, self.places(codes), 0).astype(np.uint64)
        self.low = _keys(places)
        self.high = _keys(np.where(np.arange(self.longest) < self.size[:, None], places, np.uint64(0xFFFF)))

    def places(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.symbols, codes), len(self.symbols) - 1)
        return np.where(self.symbols[at] == codes, at + 1, self.foreign)


def _keys(places: np.ndarray) -> np.ndarray:
    """Rows of symbol places as numbers of four places each."""
    p = places.reshape(len(places), -1, 4)
    return p[:, :, 0] << np.uint64(48) | p[:, :, 1] << np.uint64(32) | p[:, :, 2] << np.uint64(16) | p[:, :, 3]


@functools.lru_cache(maxsize=2)
def load_vocabulary(name: str) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path(name))


def suffix_array(places: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in the order of the `longest` symbols that start there, and those symbols as keys, by position."""
    n = len(places)
    p = np.zeros(n + longest + 4, dtype=np.uint64)
    p[:n] = places
    four = p[:-3] << np.uint64(48) | p[1:-2] << np.uint64(32) | p[2:-1] << np.uint64(16) | p[3:]
    keys = [four[k : k + n] for k in range(0, longest, 4)]
    rank = np.unique(four[: n + longest], return_inverse=True)[1].astype(np.uint64)
    reach = 4
    while reach < longest:
        pad = np.zeros(n + longest, dtype=np.uint64)
        pad[: len(rank) - reach] = rank[reach:]
        rank = np.unique(rank << np.uint64(32) | pad, return_inverse=True)[1].astype(np.uint64)
        reach *= 2
    return np.argsort(rank[:n]).astype(np.int64), keys


def _bound(order: np.ndarray, keys: list[np.ndarray], wanted: np.ndarray, after: bool) -> np.ndarray:
    """For each wanted key, how many suffixes sort before it (with `after`: before or equal)."""
    low = np.zeros(len(wanted), dtype=np.int64)
    high = np.full(len(wanted), len(order), dtype=np.int64)
    for _ in range(len(order).bit_length()):
        mid = (low + high) >> 1
        at = order[np.minimum(mid, len(order) - 1)]
        less, same = np.zeros(len(wanted), dtype=bool), np.ones(len(wanted), dtype=bool)
        for k, key in enumerate(keys):
            have = key[at]
            less |= same & (have < wanted[:, k])
            same &= have == wanted[:, k]
        right = (less | same if after else less) & (low < high)
        low = np.where(right, mid + 1, low)
        high = np.where(right, high, np.where(low < high, mid, high))
    return low


class Edges:
    """Occurrences of pieces of two symbols and more in the concatenated units, sorted by position, then length."""

    def __init__(self, vocabulary: Vocabulary, places: np.ndarray) -> None:
        found = [self._part(vocabulary, places, low) for low in range(0, len(places), INDEXED)] or [(np.zeros(0, np.int64),) * 3]
        at, size, self.piece = (np.concatenate(c) for c in zip(*found, strict=True))
        self.mask = np.zeros(len(places), dtype=np.int64)
        np.bitwise_or.at(self.mask, at, np.int64(1) << size)
        self.first = np.searchsorted(at, np.arange(len(places)))
        reach = np.zeros(len(places) + 1, dtype=np.int64)
        np.maximum.at(reach, at, at + size)
        #: Whether an edge spans this position and the one before it.
        self.crossed = np.maximum.accumulate(reach)[:-1]
        self.crossed = np.append(False, self.crossed[:-1] > np.arange(1, len(places))) if len(places) else np.zeros(0, bool)

    @staticmethod
    def _part(vocabulary: Vocabulary, places: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges that start in one indexed part: positions, symbols and pieces."""
        own = min(INDEXED, len(places) - low)
        order, keys = suffix_array(places[low : low + own + vocabulary.longest], vocabulary.longest)
        first = _bound(order, keys, vocabulary.low, after=False)
        count = np.maximum(_bound(order, keys, vocabulary.high, after=True) - first, 0)
        piece = np.repeat(np.arange(len(count)), count)
        begin = np.repeat(first - np.append(0, np.cumsum(count)[:-1]), count)
        at = order[begin + np.arange(len(piece))]
        inside = at < own
        at, piece = at[inside], piece[inside]
        size = vocabulary.size[piece].astype(np.int64)
        sort = np.argsort(at * 64 + size)
        return at[sort] + low, size[sort], vocabulary.number[piece[sort]]

    def find(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Piece ids of the edges that start at `at` with `size` symbols; -1 where there is none."""
        bit = np.int64(1) << np.minimum(size, 62).astype(np.int64)
        mask = self.mask[at]
        slot = self.first[at] + np.bitwise_count(mask & (bit - 1)).astype(np.int64)
        has = (mask & bit) != 0
        return np.where(has, self.piece[np.where(has, slot, 0)] if len(self.piece) else -1, -1)


def relax(edges: Edges, order: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, symbols) of the merged symbols of all units. unit: the unit of each position, ascending, -1 for gaps."""
    at = np.flatnonzero(unit >= 0)
    unit, size = unit[at], np.ones(len(at), dtype=np.int64)

    def cost(k: np.ndarray) -> np.ndarray:
        """Place of the piece that symbol k and the next one make."""
        after = np.minimum(k + 1, len(at) - 1)
        piece = edges.find(at[k], np.where(after > k, size[k] + size[after], 0))
        ok = (piece >= 0) & (after > k) & (unit[after] == unit[k])
        return np.where(ok, order[np.maximum(piece, 0)], _NONE)

    out: list[tuple[np.ndarray, np.ndarray]] = []
    pair = cost(np.arange(len(at)))
    while len(at):
        head = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        best = np.minimum.reduceat(pair, head)
        spread = np.repeat(best, np.diff(np.append(head, len(at))))
        done = spread == _NONE
        hit = np.flatnonzero((pair == spread) & ~done)
        hit = hit[np.append(True, unit[hit][1:] != unit[hit][:-1])] if len(hit) else hit
        out.append((at[done], size[done]))
        size[hit] += size[hit + 1]
        keep = ~done
        keep[hit + 1] = False
        shift = np.cumsum(keep) - 1
        at, size, unit, pair = at[keep], size[keep], unit[keep], pair[keep]
        hit = shift[hit]
        touched = np.concatenate([hit, hit[hit > 0] - 1])
        if len(touched):
            pair[touched] = cost(touched)
    at, size = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (at, size)
    sort = np.argsort(at)
    return at[sort], size[sort]


def relax_long(edges: Edges, order: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """relax() for one long part, positions low to high-1, by a heap of its pairs."""
    n = high - low
    ends = array("q", range(1, n + 1))  # end of the symbol that starts here; 0 once it is part of another
    before = array("q", range(-1, n - 1))  # start of the symbol before
    first, mask, piece = edges.first[low:high], edges.mask[low:high], edges.piece

    def entry(a: int) -> int:
        """Place of the piece that symbol a and the next one make, position and size, as one number; -1 if there is none."""
        if a < 0 or ends[a] >= n:
            return -1
        size = ends[ends[a]] - a
        if size > 62 or not (bits := int(mask[a])) >> size & 1:
            return -1
        place = int(order[piece[int(first[a]) + (bits & ((1 << size) - 1)).bit_count()]])
        return (place << 40 | a) << 6 | size

    start = np.arange(n - 1)
    place = edges.find(low + start, np.full(n - 1, 2))
    has = start[place >= 0]
    heap = ((order[place[has]].astype(np.int64) << 40 | has) << 6 | 2).tolist()
    heapq.heapify(heap)
    while heap:
        code = heapq.heappop(heap)
        size, a = code & 63, code >> 6 & (1 << 40) - 1
        b = ends[a]
        if not b or b >= n or not ends[b] or ends[b] - a != size:
            continue
        end = ends[a] = a + size
        ends[b] = 0
        if end < n:
            before[end] = a
        for c in (a, before[a]):
            if (e := entry(c)) >= 0:
                heapq.heappush(heap, e)
    stops = np.frombuffer(ends, dtype=np.int64)
    at = np.flatnonzero(stops)
    return at + low, stops[at] - at


class Encoder:
    """Encodes batches of texts; units met before are remembered."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.int32)
        self.bounds = np.zeros(1, dtype=np.int64)

    def _learn(self, units: list[str]) -> None:
        v = self.vocabulary
        codes = np.frombuffer("\0".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        starts = np.append(0, np.cumsum(sizes + 1)[:-1])
        unit = np.repeat(np.arange(len(units)), np.append(sizes[:-1] + 1, sizes[-1:]))
        gap = np.zeros(len(codes), dtype=bool)
        gap[starts[1:] - 1] = True
        places = np.where(gap, 0, v.places(codes))
        edges = Edges(v, places)
        part = np.cumsum(~edges.crossed) - 1  # a gap is a part of its own, and so is a symbol in no edge
        heads = np.flatnonzero(~edges.crossed)
        long = np.diff(np.append(heads, len(codes))) > LONG
        merged = [relax(edges, v.order, np.where(gap | long[part], -1, part))]
        for i in np.flatnonzero(long).tolist():
            merged.append(relax_long(edges, v.order, int(heads[i]), int(heads[i + 1]) if i + 1 < len(heads) else len(codes)))
        at, size = (np.concatenate(c) for c in zip(*merged, strict=True))
        if long.any():
            sort = np.argsort(at)
            at, size = at[sort], size[sort]
        ids = np.where(size > 1, edges.find(at, size), v.single[places[at]])
        owner = unit[at]
        missing = np.flatnonzero(ids < 0)
        if len(missing):
            spelled = [v.byte[list(chr(c).encode("utf-8", "surrogatepass"))] for c in codes[at[missing]].tolist()]
            width = np.ones(len(ids), dtype=np.int64)
            width[missing] = [len(s) for s in spelled]
            owner = np.repeat(owner, width)
            grown = np.repeat(ids, width)
            grown[grown < 0] = np.concatenate(spelled)
            ids = grown
        for u in units:
            self.known[u] = len(self.known)
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(np.bincount(owner, minlength=len(units))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the bounds of the texts."""
        if len(self.known) > KEPT:
            self.__init__(self.vocabulary)
        units: list[str] = []
        counts = [0]
        for text in texts:
            if text:
                units += _UNIT.findall(" " + text.replace(SPACE, " "))
            counts.append(len(units))
        fresh = [u for u in dict.fromkeys(units) if u not in self.known]
        if fresh:
            self._learn(fresh)
        known = self.known
        index = np.array([known[u] for u in units], dtype=np.int64)
        size = self.bounds[index + 1] - self.bounds[index]
        total = np.append(0, np.cumsum(size))
        ids = self.flat[np.repeat(self.bounds[index] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.array(counts)]


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of ids: pieces and bytes joined, without the space put before it."""
    return b"".join([vocabulary.spell[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


def encode_decode(docs: DataFrame, model: str = "piece_bpe_32k.model", keep: bool = False) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian 32-bit ids), decoded_sha256, and with `keep` also ids and decoded."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_vocabulary(model)
        encoder = Encoder(vocabulary)
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, bounds = encoder.encode(part.column("text").to_pylist())
                ids = ids.astype("<u4")
                cols: list[list] = [[], [], [], [], []]
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    mine = ids[a:b]
                    text = decode(vocabulary, mine.tolist())
                    row = (b - a, zlib.crc32(mine.tobytes()), hashlib.sha256(text.encode()).hexdigest(), mine, text)
                    for c, x in zip(cols[: 5 if keep else 3], row, strict=False):
                        c.append(x)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.string()]
                arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: 5 if keep else 3]
                names = ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "ids", "decoded"][: len(arrays) + 1]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_ids long, ids_crc32 long, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>, decoded string" if keep else ""))
