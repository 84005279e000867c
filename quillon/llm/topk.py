"""Exact top-k inner products in three phases with one uniform threshold.

A vector is cut into slices; a slice's scores form one list per query. By Cauchy's inequality an entry's score in a slice is
at most the product of both norms there, so the rows with the largest norms head a slice's list.
1. Each query reads only the heads of its lists: per slice, the block of rows with the largest norms in it. The best of them
   are scored whole, and the k-th best score is a cutoff that the answer cannot fall below. This work is linear in the queries.
2. The cutoff goes out with the queries. A pair of a query and a block of rows is left out where the block's norms cannot
   reach it; blocks hold rows of like norm, so few blocks are read where norms differ. An entry that reaches the cutoff
   reaches cutoff / slices in some slice, so a block collects the entries that do so in any list, and drops those whose unseen
   slices cannot lift them to the cutoff.
3. The collected entries are scored exactly, and the k best of each block go to the final ranking.

Defined results: a score beyond a long is the nearest long, also for ranking; a vec_id that repeats keeps its smallest vector
(array order); null vec_ids and vectors that are null or hold null or non-finite components take no part; vectors of other
lengths than the query's are no candidates; ties go to the smaller vec_id; a query with fewer candidates than k returns all;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.vectors import dealt, matrix, usable
from quillon.runtime import Scratch, running_sum

QUERY_BLOCK, ROW_BLOCK = 1024, 4096
_FOUND = "query_id long, vec_id long, score long, cell int"


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """Components as whole numbers; those beyond the largest double are the largest double."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(scale * vectors))


def slices_of(dim: int, slices: int) -> list[np.ndarray]:
    return np.array_split(np.arange(dim), max(1, min(slices, dim)))


def norms(whole: np.ndarray, slices: int) -> np.ndarray:
    """The norm of each row in each slice; slices beyond a short vector's are 0."""
    out = np.zeros((len(whole), slices))
    most = np.maximum(np.abs(whole).max(axis=1, initial=0), 1)
    for j, part in enumerate(slices_of(whole.shape[1], slices)):
        out[:, j] = np.linalg.norm(whole[:, part] / most[:, None], axis=1)
    with np.errstate(over="ignore"):
        return out * most[:, None]


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer inner products; doubles carry them unless they could pass 2**53, then Python's integers do."""
    most = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(1, left.shape[1])
    if most < 2.0**50:  # sums of a few slices stay exact, too
        return left @ right.T
    whole = np.array([[int(x) for x in row] for row in left], dtype=object).reshape(left.shape)
    other = np.array([[int(x) for x in row] for row in right], dtype=object).reshape(right.shape)
    return whole.dot(other.T)


def bounded(scores: np.ndarray) -> np.ndarray:
    """Whole scores as longs; those beyond are the nearest long."""
    if scores.dtype == object:
        scores = np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in scores], dtype=np.int64)
    return scores.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best, ties to smaller ids."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], ~scores[keep]))[:k]]


def _sides(queries: pa.Table, rows: pa.Table, scale: int) -> tuple[np.ndarray, ...]:
    dim = rows.column("row_dim")[0].as_py()
    q = integers(matrix(queries.column("embedding"), dim), scale)
    c = integers(matrix(rows.column("row_vector"), dim), scale)
    return q, c, queries.column("vec_id").to_numpy(), rows.column("row_id").to_numpy()


def _found(out: list[tuple[int, np.ndarray, np.ndarray, int]]) -> pa.Table:
    n = [len(ids) for _, ids, _, _ in out]
    whole = lambda at, kind: np.concatenate([np.zeros(0, kind), *(o[at] for o in out)]).astype(kind)
    columns = [np.repeat(np.array([o[0] for o in out], np.int64), n), whole(1, np.int64), whole(2, np.int64), np.repeat(np.array([o[3] for o in out], np.int32), n)]
    return pa.Table.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score", "cell"])


def _heads(k: int, scale: int, slices: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best whole scores of the entries that lead the list of one slice."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and rows.num_rows:
            q, c, qids, ids = _sides(queries, rows, scale)
            at_slice = rows.column("row_slice")[0].as_py()
            part = slices_of(q.shape[1], slices)[at_slice]
            leads = q[:, part] @ c[:, part].T  # only to choose by, so rounding does no harm
            most = min(len(ids), 4 * k + 1)
            for i, query in enumerate(qids):
                at = np.argpartition(-np.nan_to_num(leads[i]), most - 1)[:most]
                at = at[ids[at] != query]
                score = bounded(products(q[i : i + 1], c[at])[0])
                top = _best(score, ids[at], k)
                out.append((query, ids[at][top], score[top], at_slice))
        return _found(out)

    return run


def _entries(k: int, scale: int, slices: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best of a block of rows among the entries that can reach each query's cutoff."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and rows.num_rows:
            q, c, qids, ids = _sides(queries, rows, scale)
            cell = rows.column("row_block")[0].as_py()
            cutoff = queries.column("cutoff").to_numpy(zero_copy_only=False)
            lists = [products(q[:, p], c[:, p]) for p in slices_of(q.shape[1], slices)]
            if any(x.dtype == object for x in lists):
                lists = [products(q, c)]  # doubles and whole numbers do not add up exactly
            for i, query in enumerate(qids):
                at = ids != query
                if cutoff[i] > -(2.0**62):  # lower ones may stand for scores below a long
                    floor = cutoff[i] - 1e-6 * abs(cutoff[i])
                    share = floor / len(lists)
                    seen = [x[i] >= share for x in lists]
                    reach = sum(np.where(s, x[i], share) for s, x in zip(seen, lists, strict=True))
                    at &= np.any(seen, axis=0) & (reach >= floor - 1e-6 * abs(floor))
                at = np.flatnonzero(at)
                score = bounded(sum(x[i][at] for x in lists))
                top = _best(score, ids[at], k)
                out.append((query, ids[at][top], score[top], cell))
        return _found(out)

    return run


def _ranked(found: DataFrame, k: int, groups: Column | int) -> DataFrame:
    """The k best per query, first within groups of cells, so that no query's entries meet unreduced."""
    best = [F.desc("score"), F.asc("vec_id")]
    part = found.withColumn("part", F.pmod("cell", groups if isinstance(groups, Column) else F.lit(groups)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*best))).filter(F.col("rank") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).filter(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, slices: int = 4) -> DataFrame:
    """The k highest integer inner products of each query row against every other row.

    vectors: vec_id, embedding. is_query: a condition on vec_id. Returns query_id, rank, vec_id, score.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    clean = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), "embedding")
    whole = clean.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            sizes = np.zeros((len(dims), slices))
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                sizes[mine] = norms(integers(matrix(batch.column("embedding").take(pa.array(mine)), int(dim)), scale), slices)
            yield batch.append_column("norms", pa.array(list(sizes), pa.list_(pa.float64())))

    kind = vectors.schema["embedding"].dataType.simpleString()
    rows = whole.withColumn("dim", F.size("embedding")).mapInArrow(measure, f"vec_id long, embedding {kind}, dim int, norms array<double>")
    rows = rows.withColumn("norm", F.aggregate("norms", F.lit(0.0), lambda s, x: s + x * x))
    # Blocks of rows of like norm: the place of a row among all, by norm, names its block.
    rows = scratch.table(running_sum(rows, [F.desc("norm"), "vec_id"], F.lit(1), "place").withColumn("block", F.floor(F.col("place") / ROW_BLOCK).cast("int")), "rows")
    queries = rows.filter(is_query).select("vec_id", "embedding", "dim", "norms")
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    queries = queries.withColumn("query_block", dealt(query_blocks, "vec_id"))
    each = lambda top: F.explode(F.sequence(F.lit(0), F.lit(top - 1)))
    right = lambda df, *more: df.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("row_vector"), F.col("dim").alias("row_dim"), *more)

    # Phase 1. The heads of the lists: the rows with the largest norms in each slice, for each length of vectors.
    sliced = rows.select("vec_id", "embedding", "dim", F.posexplode("norms").alias("slice", "size")).filter(F.col("slice") < F.greatest(F.col("dim"), F.lit(1)))
    head = sliced.withColumn("at", F.row_number().over(Window.partitionBy("dim", "slice").orderBy(F.desc("size"), "vec_id"))).filter(F.col("at") <= ROW_BLOCK)
    head = right(head, F.col("slice").alias("row_slice"), each(query_blocks).alias("row_query_block"))
    asked = queries.withColumn("slice", each(slices))
    leads = asked.groupBy("dim", "query_block", "slice").cogroup(head.groupBy("row_dim", "row_query_block", "row_slice")).applyInArrow(_heads(k, scale, slices), _FOUND)
    leads = leads.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.min("cell").alias("cell"))
    leads = _ranked(leads, k, 1).filter(F.col("rank") == k)
    cutoffs = scratch.table(leads.select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("cutoff")), "cutoffs")
    bounded_ = queries.join(cutoffs, "vec_id", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(float("-inf"))))

    # Phases 2 and 3. A block's largest norms say which queries it can serve.
    most = F.array(*[F.max(F.get("norms", F.lit(j))) for j in range(slices)])
    blocks = scratch.table(rows.groupBy("dim", "block").agg(most.alias("most")), "blocks")
    reach = F.aggregate(F.zip_with("norms", "most", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    met = scratch.table(bounded_.join(blocks, "dim").filter(reach * (1 + 1e-9) >= F.col("cutoff") - 1e-6 * F.abs("cutoff")).drop("norms", "most"), "met")
    wanted = met.select("dim", "block", "query_block").distinct()
    served = rows.select("vec_id", "embedding", "dim", "block").join(wanted, ["dim", "block"])
    served = right(served, F.col("block").alias("row_block"), F.col("query_block").alias("row_query_block"))
    found = met.groupBy("dim", "query_block", "block").cogroup(served.groupBy("row_dim", "row_query_block", "row_block")).applyInArrow(_entries(k, scale, slices), _FOUND)
    groups = F.greatest(F.lit(1), F.sqrt(F.lit(blocks.count())).cast("int"))
    return _ranked(found, k, groups).select("query_id", "rank", "vec_id", "score")
