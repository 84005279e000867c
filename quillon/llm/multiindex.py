"""Near-duplicate vectors through an inverted multi-index.

Unit vectors are cut in halves with a codebook each; the pair of nearest codewords is a vector's cell on the product grid.
A half's excess for a codeword is its distance to the plane between that codeword and its own one, so a neighbour at that
displacement can lie across; for neighbours just at the threshold, in any direction, the chance of that is known. Each vector
walks the two sorted lists of excesses with a heap (the multi-sequence traversal), cells in order of the summed squares from
its own one outwards, and stops where the chances of all cells left add up to less than 1 - `recall`. Codebooks grow with the
cube root of the number of vectors, so the share of all vectors that one meets falls as the table grows. Every vector is
indexed and probes; pairs in a visited cell are verified by cosine in double precision, and a pair that both sides find
counts once for each.

Copies of a vector share one representative with their number. A cell is cut into blocks of index rows and blocks of probes
that meet pairwise, so a crowded cell is many tasks; a task returns sums of links per vector and a spanning forest of its
links, never the pairs.

Defined results: a vec_id that repeats keeps its smallest (label, vector); a null vec_id has no row; vectors that are null,
empty, zero or hold null or non-finite components, or have no label, have no links; vectors of different length have no
links with each other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import components
from quillon.llm.vectors import dealt, matrix, usable
from quillon.runtime import Scratch

#: The codebooks are fitted to at most this many vectors, those with the smallest hashes.
SAMPLE = 8192
#: Codewords of each half for up to WORDS_FOR vectors; more vectors get more, by the cube root, up to MOST_WORDS.
CODEWORDS, WORDS_FOR, MOST_WORDS = 24, 50_000, 512
BLOCK = 2048
_FOUND = "id long, n long, u long, v long"


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def kmeans(points: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Codewords by Lloyd's rounds from distinct random points; a codeword without points stays where it is."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    words = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        near = (-2 * points @ words.T + (words**2).sum(1)).argmin(1)
        for j in range(len(words)):
            if (mine := near == j).any():
                words[j] = points[mine].mean(0)
    return words


def excess(half: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row, and the squared distance to the plane that parts it from each codeword."""
    square = (half**2).sum(1)[:, None] - 2 * half @ words.T + (words**2).sum(1)
    own = square.argmin(1)
    gap = square - square[np.arange(len(half)), own][:, None]
    apart = np.linalg.norm(words[own][:, None, :] - words[None, :, :], axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = np.where(apart > 0, gap / (2 * apart), 0.0)
    return own, np.maximum(plane, 0.0) ** 2


def codewords(vectors: int) -> int:
    return min(MOST_WORDS, max(CODEWORDS, round(CODEWORDS * (vectors / WORDS_FOR) ** (1 / 3))))


_ERFC = np.frompyfunc(math.erfc, 1, 1)


def traverse(first: list[float], second: list[float], chance: tuple[list[float], list[float]], left: float, recall: float) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of places in two ascending lists in order of their summed costs, until what is left is below 1 - recall.

    chance: the probability of each place; left: of all pairs together. Each pair is reached along one way only.
    """
    heap = [(first[0] + second[0], 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        yield i, j
        left -= chance[0][i] * chance[1][j]
        if left <= 1 - recall:
            return
        if j + 1 < len(second):
            heapq.heappush(heap, (first[i] + second[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(first):
            heapq.heappush(heap, (first[i + 1] + second[0], i + 1, 0))


class Codebooks:
    """The product grid for vectors of one length."""

    def __init__(self, sample: np.ndarray, threshold: float, recall: float, words: int) -> None:
        dim = sample.shape[1]
        self.cut = max(1, dim // 2)
        self.first = kmeans(sample[:, : self.cut], words)
        self.second = kmeans(sample[:, self.cut :], words) if dim > self.cut else np.zeros((1, 0))
        self.recall = recall
        # A neighbour just at the threshold is displaced by this much along a given direction, by standard deviation.
        self.spread = math.sqrt(max(1 - threshold**2, 1e-12) / max(1, dim - 1))

    def visits(self, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Own cell and visited cells of each row, nearest first."""
        sides = [excess(vectors[:, : self.cut], self.first), excess(vectors[:, self.cut :], self.second)]
        own = sides[0][0] * len(self.second) + sides[1][0]
        order = [np.argsort(cost, axis=1, kind="stable") for _, cost in sides]
        costs = [np.take_along_axis(cost, o, 1) for (_, cost), o in zip(sides, order, strict=True)]
        chances = [(0.5 * _ERFC(np.sqrt(c) / (self.spread * math.sqrt(2)))).astype(float) for c in costs]
        for c in chances:
            c[:, 0] = 1.0  # its own
        left = chances[0].sum(1) * chances[1].sum(1)
        out: list[np.ndarray] = []
        for row in range(len(vectors)):
            if left[row] - 1 <= 1 - self.recall:
                out.append(own[row : row + 1].astype(np.int32))
                continue
            walk = traverse(costs[0][row].tolist(), costs[1][row].tolist(), (chances[0][row].tolist(), chances[1][row].tolist()), left[row], self.recall)
            at = np.array(list(walk))
            out.append((order[0][row][at[:, 0]] * len(self.second) + order[1][row][at[:, 1]]).astype(np.int32))
        return own, out


def _assign(books: dict[int, Codebooks]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cells = np.zeros(len(dims), dtype=np.int32)
            visits: list[np.ndarray] = [np.zeros(1, np.int32)] * len(dims)
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                if int(dim) in books:
                    own, seen = books[int(dim)].visits(unit(matrix(batch.column("embedding").take(pa.array(mine)), int(dim))))
                    cells[mine] = own
                    for i, s in zip(mine, seen, strict=True):
                        visits[i] = s
            out = batch.append_column("cell", pa.array(cells))
            yield out.append_column("visits", pa.array(visits, pa.list_(pa.int32())))

    return run


def _meet(threshold: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(probes: pa.Table, index: pa.Table) -> pa.Table:
        ids, sums, forest = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        if probes.num_rows and index.num_rows:
            dim = index.column("i_dim")[0].as_py()
            left, right = unit(matrix(probes.column("embedding"), dim)), unit(matrix(index.column("i_embedding"), dim))
            pid, iid = probes.column("rep").to_numpy(), index.column("i_rep").to_numpy()
            pn, in_ = probes.column("copies").to_numpy(), index.column("i_copies").to_numpy()
            a, b = [], []
            for low in range(0, len(pid), 512):
                x, y = np.nonzero(left[low : low + 512] @ right.T >= threshold)
                a.append((x + low).astype(np.int32))
                b.append(y.astype(np.int32))
            x, y = np.concatenate(a), np.concatenate(b)
            apart = pid[x] != iid[y]
            x, y = x[apart], y[apart]
            if len(x):
                # A pair is counted for the index row here too, unless that row visits the probe's own cell itself.
                cells, code = np.unique(probes.column("cell").to_numpy(), return_inverse=True)
                seen = index.column("i_visits").combine_chunks()
                row = np.repeat(np.arange(len(iid)), np.diff(seen.offsets.to_numpy()))
                flat = seen.flatten().to_numpy()
                at = np.minimum(np.searchsorted(cells, flat), len(cells) - 1)
                back = np.zeros((len(iid), len(cells)), dtype=bool)
                hit = cells[at] == flat
                back[row[hit], at[hit]] = True
                alone = ~back[y, code[x]]
                ids = np.concatenate([pid, iid])
                sums = np.concatenate(
                    [np.bincount(x, in_[y], len(pid)), np.bincount(y[alone], pn[x[alone]], len(iid))]
                ).astype(np.int64)
                ids, sums = ids[sums > 0], sums[sums > 0]
                forest = _forest(pid, iid, x, y)
        n = len(ids) + len(forest)
        gap = lambda have, at: pa.array(np.pad(have, (at, n - at - len(have))), mask=(np.arange(n) < at) | (np.arange(n) >= at + len(have)))
        return pa.Table.from_arrays(
            [gap(ids, 0), gap(sums, 0), gap(forest[:, 0], len(ids)), gap(forest[:, 1], len(ids))], ["id", "n", "u", "v"]
        )

    return run


def _forest(pid: np.ndarray, iid: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(node, smallest node in reach) for the nodes that the pairs join."""
    nodes, at = np.unique(np.concatenate([pid, iid]), return_inverse=True)
    x, y = at[x], at[len(pid) + y]
    low = np.arange(len(nodes))
    while True:
        now = low.copy()
        np.minimum.at(now, x, low[y])
        np.minimum.at(now, y, now[x])
        now = now[now]
        if (now == low).all():
            break
        low = now
    moved = np.flatnonzero(low != np.arange(len(nodes)))
    return np.column_stack([nodes[moved], nodes[low[moved]]])


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.997, words: int | None = None) -> DataFrame:
    """Links of equal label and cosine of at least `threshold`.

    vectors: vec_id, embedding, label. words: codewords of each half, by the number of vectors if not given. Returns vec_id, n_links, component_id, kept.
    """
    scratch = Scratch(vectors.sparkSession, "multiindex")
    named = vectors.filter("vec_id is not null").select(F.col("vec_id").cast("long"), F.struct("label", "embedding").alias("s"))
    every = named.groupBy("vec_id").agg(F.min("s").alias("s")).select("vec_id", "s.label", "s.embedding")
    fit = usable(F.col("embedding")) & F.col("label").isNotNull() & F.exists("embedding", lambda x: x != 0)
    every = scratch.table(every.withColumn("fit", fit), "vectors")
    live = every.filter("fit")
    groups = scratch.table(
        live.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "groups"
    )
    words = words or codewords(groups.count())
    reps = groups.withColumn("dim", F.size("embedding"))
    sample = reps.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("dim", "embedding").toArrow()
    dims = sample.column("dim").to_numpy()
    books = {
        int(d): Codebooks(unit(matrix(sample.column("embedding").take(pa.array(np.flatnonzero(dims == d))), int(d))), threshold, recall, words)
        for d in np.unique(dims)
    }
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema.fields)
    indexed = scratch.table(reps.mapInArrow(_assign(books), f"{fields}, cell int, visits array<int>"), "indexed")
    keys = ["label", "dim", "at"]
    own = indexed.groupBy("label", "dim", F.col("cell").alias("at")).agg(F.count("*").alias("rows"))
    asked = indexed.select("label", "dim", F.explode("visits").alias("at")).groupBy(*keys).agg(F.count("*").alias("probes"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sizes = scratch.table(own.join(asked, keys).select(*keys, blocks("rows").alias("ib"), blocks("probes").alias("pb")), "sizes")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    probes = indexed.select("label", "dim", "rep", "copies", "embedding", "cell", F.explode("visits").alias("at")).join(sizes, keys)
    probes = probes.withColumn("p", dealt(F.col("pb"), "rep")).withColumn("i", upto("ib")).drop("ib", "pb")
    index = indexed.withColumn("at", F.col("cell")).join(sizes, keys)
    index = index.withColumn("i", dealt(F.col("ib"), "rep")).withColumn("p", upto("pb"))
    index = index.select(*[F.col(c).alias(f"i_{c}") for c in (*keys, "i", "p", "rep", "copies", "embedding", "visits")])
    met = probes.groupBy(*keys, "i", "p").cogroup(index.groupBy(*[f"i_{c}" for c in (*keys, "i", "p")])).applyInArrow(_meet(threshold), _FOUND)
    met = scratch.table(met, "links")
    sums = met.filter("id is not null").groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n"))
    comps = components(met.filter("u is not null"), scratch).withColumnRenamed("id", "rep")
    known = groups.select("rep", "copies").join(sums, "rep", "left").join(comps, "rep", "left")
    known = scratch.table(
        known.select(
            "rep",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component_id", "rep").alias("component_id"),
        ),
        "known",
    )
    members = live.select("vec_id", "label", "embedding").join(groups.select("label", "embedding", "rep"), ["label", "embedding"])
    rows = every.select("vec_id").join(members.select("vec_id", "rep"), "vec_id", "left").join(known, "rep", "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (component == F.col("vec_id")).alias("kept"),
    )
