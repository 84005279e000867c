"""Connected components of a distributed edge list, and links inside one block of pairs.

Stars are contracted in rounds. Each round first replaces the edges of a partition by a spanning forest, then hangs every
node's larger neighbours, and then its smaller ones, on the smallest node in its reach. Minima combine before the shuffle
and are written before the join, so a hub with any number of edges is split by the engine and never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import Scratch


class Forest:
    """Union by smallest label over any hashable labels."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (above := up.get(root, root)) != root:
            root = above
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def link(self, a, b) -> bool:
        """Whether a and b were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True

    def stars(self) -> Iterable[tuple]:
        """(node, root) for every node that is not its own root."""
        return ((x, r) for x in list(self.up) if (r := self.find(x)) != x)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        pairs = np.column_stack([batch.column("u").to_numpy(), batch.column("v").to_numpy()])
        for u, v in np.unique(pairs, axis=0).tolist():
            forest.link(u, v)
    rows = list(forest.stars())
    for i in range(0, len(rows), 50_000):
        part = np.array(rows[i : i + 50_000], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["u", "v"])


def _forests(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_forest, "u long, v long")


def _state(stars: DataFrame) -> tuple:
    row = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first()
    return tuple(row)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component_id) for every node that reaches a smaller one; component_id is the smallest id in reach.

    edges: columns u and v (long), either order, loops and repeats allowed.
    """
    now = scratch.table(_forests(edges.select("u", "v").filter("u <> v")), "edges")
    before = None
    while (state := _state(now)) != before:
        before = state
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.table(_forests(large.filter("u <> v")), "large")
        down = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            down.select("u", F.col("m").alias("v"))
        )
        after = scratch.table(_forests(small.filter("u <> v")), "edges")
        scratch.drop(now, least, large, down)
        now = after
    return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id"))
