"""Exact top-k inner products by distributed histogram selection.

Queries go in blocks of a fixed size, each against all rows; a block's result is stored before the next begins. For a block
every task scores its rows and counts the scores of each query into equal bins, sending only its topmost bins down to its
own k-th value; the summed counts tell in which bin the k-th highest score of all rows lies, and that bin is split again
until it is one score wide. A last pass keeps the scores at or above that value, of equal ones only the k smallest ids a
task, and ranks them.

Components become floor(scale * x) of x as double. Defined results: a vector that is null, empty, or holds a null or
non-finite component takes no part; vectors of different length do not meet; a query meets no row of its own id; repeated
ids are candidates of their own, and one query with the smallest of their vectors; fewer than k candidates: all of them; an empty table gives an empty result; scores must fit
in 53 bits, else the query fails. A null id takes no part. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, stored_parts

#: Queries of a block, rows scored at once, bins of a round.
BLOCK, ROWS, BINS = 2048, 4096, 1024


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, size, v (components as doubles without fraction), for the vectors that take part."""
    real = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine & (F.size("embedding") > 0))
    return rows.select("vec_id", F.size("embedding").alias("size"), F.transform(real, lambda x: F.floor(x * scale).cast("double")).alias("v"))


def _scores(batches: Iterator[pa.RecordBatch], ids: np.ndarray, matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block of rows their ids, and the scores [query, row]; the lowest integer stands where ids are equal."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.asarray(batch.column(0))
        values = np.asarray(batch.column(1).flatten()).reshape(len(rows), -1)
        for at in range(0, len(rows), ROWS):
            own = rows[at : at + ROWS]
            scores = (matrix @ values[at : at + ROWS].T).astype(np.int64)
            scores[ids[:, None] == own[None, :]] = np.iinfo(np.int64).min
            yield own, scores


def _histograms(rows: DataFrame, ids: np.ndarray, matrix: np.ndarray, low: np.ndarray, width: np.ndarray, k: int) -> dict[int, list]:
    """For each query (by place) its highest bins (bin, rows) from the top, as many as hold k rows beyond `low`."""

    def run(batches):
        sums = np.zeros((len(ids), BINS + 1), np.int64)
        for _, scores in _scores(batches, ids, matrix):
            bins = np.clip((scores - low[:, None]) // width[:, None], -1, BINS)
            bins[scores == np.iinfo(np.int64).min] = -1
            flat = (bins + np.arange(len(ids))[:, None] * (BINS + 1))[bins >= 0]
            sums += np.bincount(flat, minlength=sums.size).reshape(sums.shape)
        above = np.cumsum(sums[:, ::-1], axis=1)[:, ::-1] - sums
        q, b = np.nonzero((sums > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(sums[q, b])], names=["q", "bin", "n"])

    found = rows.mapInArrow(run, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
    found = found.withColumn("above", F.sum("n").over(Window.partitionBy("q").orderBy(F.col("bin").desc())) - F.col("n")).where(F.col("above") < k)
    out: dict[int, list] = {}
    for r in found.select("q", "bin", "n").collect():  # at most k bins for each query of the block
        out.setdefault(r.q, []).append((r.bin, r.n))
    return out


def _top_of_block(rows: DataFrame, ids: np.ndarray, matrix: np.ndarray, bound: float, k: int) -> DataFrame:
    top = np.ceil(np.sqrt((matrix**2).sum(axis=1)) * bound).astype(np.int64) + 1
    low, width = -top, np.maximum(1, -(-(2 * top + 1) // BINS))
    while True:
        found = _histograms(rows, ids, matrix, low, width, k)
        done = width == 1
        for q in range(len(ids)):
            seen, at = 0, int(low[q])
            for number, n in sorted(found.get(q, []), reverse=True):
                at = int(low[q] + number * width[q])
                seen += n
                if seen >= k:
                    break
            if seen < k:
                at = int(low[q]) if not done[q] else at
                done[q] = True  # fewer candidates than k: all of them
            low[q] = at
        if done.all():
            break
        # the bin that holds the k-th value is split; the bins above it stay in the top one
        width = np.where(done, width, np.maximum(1, -(-width // BINS)))

    def run(batches):
        for own, scores in _scores(batches, ids, matrix):
            q, r = np.nonzero((scores >= low[:, None]) & (scores != np.iinfo(np.int64).min))
            value, row = scores[q, r], own[r]
            order = np.lexsort((row, -value, q))
            q, value, row = q[order], value[order], row[order]
            first = np.searchsorted(q, q)
            keep = np.arange(len(q)) - first < k
            yield pa.RecordBatch.from_arrays([pa.array(ids[q[keep]]), pa.array(row[keep]), pa.array(value[keep])], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest scores of each query, ties to the smaller vec_id."""
    rows = cut(scaled(vectors, scale))
    sizes = rows.groupBy("size").agg(
        F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("bound"), F.count_if(is_query).alias("queries")
    )
    sizes = sorted(tuple(r) for r in sizes.collect())
    if any(bound * bound >= 2**53 for _, bound, _ in sizes):
        raise ValueError("scores of these vectors do not fit in 53 bits")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def parts() -> Iterator[DataFrame]:
        """The result of each block, stored before the next one begins, so that a lost executor costs one block at most."""
        yield ranked(rows.where("false").select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("score")))
        for size, bound, queries in sizes:
            same, blocks = rows.where(F.col("size") == size), -(-queries // BLOCK)
            for number in range(blocks):
                mine = same.where(is_query & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number))
                part = mine.groupBy("vec_id").agg(F.min("v").alias("v")).toArrow()
                if part.num_rows:
                    ids = np.asarray(part.column(0).combine_chunks())
                    matrix = np.asarray(part.column(1).combine_chunks().flatten()).reshape(len(ids), -1)
                    yield ranked(_top_of_block(same.select("vec_id", "v"), ids, matrix, bound, k))

    return stored_parts(parts())
