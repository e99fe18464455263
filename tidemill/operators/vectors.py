"""Vector search and its ranking rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vector
from ..sources.tables import checkpointed

#: Pivots at most, which the driver and each task hold.
PIVOTS = 4096
#: Queries of one scan.
QUERIES = 256


def search(vectors: DataFrame, query: list[float], n: int, threshold: float | None = None, where: Column | None = None, metric: str = "cosine") -> DataFrame:
    """The n vectors most like the query: vec_id, score. Metadata filters come first; n of 0 or less gives nothing. cosine:
    similarity, higher first; l2: distance, lower first."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = rows.select("vec_id", (vector.cosine if metric == "cosine" else vector.l2)(F.col("embedding"), q).alias("score")).where("score IS NOT NULL")
    if threshold is not None:
        rows = rows.where(F.col("score") >= threshold if metric == "cosine" else F.col("score") <= threshold)
    return rows.orderBy(F.col("score").desc() if metric == "cosine" else F.col("score").asc(), "vec_id").limit(max(0, n))


def search_many(vectors: DataFrame, queries: dict[int, list[float]], n: int, threshold: float | None = None) -> DataFrame:
    """(query, vec_id, score): the n vectors most like each of a block of queries, at most QUERIES of them, by cosine, ties to
    the smaller id. One scan without a shuffle of vectors: each task sends the best n of its rows for each query."""
    if len(queries) > QUERIES:
        raise ValueError(f"a block has {QUERIES} queries at most")
    schema = "query long, vec_id long, score double"
    if n <= 0 or not queries:
        return vectors.sparkSession.createDataFrame([], schema)
    asked, matrix = list(queries), np.array(list(queries.values()), float)
    length = np.linalg.norm(matrix, axis=1)
    rows = vectors.select("vec_id", vector.doubles(F.col("embedding")).alias("v")).where((F.size("v") == matrix.shape[1]) & F.forall("v", lambda x: x.isNotNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int]]] = [[] for _ in asked]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = np.asarray(batch.column(0)), np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            norms = np.linalg.norm(v, axis=1)
            for q, own in enumerate(matrix):
                size = norms * length[q]
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = (v * own).sum(axis=1) / size
                fits = np.flatnonzero((size > 0) & (score >= (-np.inf if threshold is None else threshold)))
                order = fits[np.lexsort((ids[fits], -score[fits]))][:n]
                best[q] = sorted([*best[q], *zip((-score[order]).tolist(), ids[order].tolist())])[:n]
        found = [(asked[q], i, -s) for q, own in enumerate(best) for s, i in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query", "vec_id", "score"])

    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    return rows.mapInArrow(run, schema).withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def reference(vectors: DataFrame, vec_id: int) -> list[float]:
    """The vector of a stored row; an unknown id is an error."""
    row = vectors.where(F.col("vec_id") == vec_id).select("embedding").first()
    if row is None:
        raise KeyError(vec_id)
    return list(row.embedding)


def softmax_shares(rows: DataFrame, score: str, key: str) -> DataFrame:
    """rows with share, softmax() of score within key. Two aggregates are joined back, so that no group meets in one task."""
    tops = rows.groupBy(key).agg(F.max(score).alias("_top"))
    raised = rows.join(tops, key).withColumn("_raised", F.exp(F.col(score) - F.col("_top")))
    sums = raised.groupBy(key).agg(F.sum("_raised").alias("_sum"))
    return raised.join(sums, key).withColumn("share", F.col("_raised") / F.col("_sum")).drop("_top", "_raised", "_sum")


def softmax(score: Column, *keys: str) -> Column:
    """Share of each row's exponential in its group, the largest score subtracted first."""
    w = Window.partitionBy(*keys)
    top = F.exp(score - F.max(score).over(w))
    return top / F.sum(top).over(w)


def chunk_search(chunks: DataFrame, query: list[float], n: int, share: float) -> DataFrame:
    """Best chunk of each document among the n nearest chunks whose softmax share is at least `share`. chunks: doc_id,
    vec_id, embedding."""
    hits = search(chunks, query, n)
    hits = hits.withColumn("share", softmax(F.col("score"))).where(F.col("share") >= share)  # at most n rows
    docs = chunks.select("vec_id", "doc_id").join(F.broadcast(hits), "vec_id")
    return docs.groupBy("doc_id").agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), "doc_id")


def _cells(rows: DataFrame, pivots: np.ndarray, eps: float) -> tuple[DataFrame, DataFrame]:
    """rows (id, v) of length one, each in the cell of its nearest pivot (list), and the cells that each has to visit: its own,
    and of those of greater number each that may hold a row within eps. With r the distance that eps is, by the triangle
    inequality such a row y of cell q has d(y, q) between d(x, q) - r and the cell's radius, and, as y is nearest to q,
    d(x, q) is at most d(x, p) + 2 r for x's own pivot p."""
    reach = float(np.sqrt(2 * eps))
    squares = (pivots**2).sum(axis=1)

    def distances(vs: pd.Series) -> np.ndarray:
        m = np.stack(vs.to_numpy())
        return np.sqrt(np.maximum(0, (m**2).sum(axis=1)[:, None] - 2 * m @ pivots.T + squares))

    @F.pandas_udf("struct<list:int,off:double>")
    def own(vs: pd.Series) -> pd.DataFrame:
        d = distances(vs) if len(vs) else np.zeros((0, 1))
        at = d.argmin(axis=1)
        return pd.DataFrame({"list": at.astype(np.int32), "off": d[np.arange(len(d)), at]})

    home = checkpointed(rows.select("id", "v", own("v").alias("at")).select("id", "v", "at.list", "at.off"))
    radius = np.full(len(pivots), -np.inf)
    for r in home.groupBy("list").agg(F.max("off").alias("radius")).collect():  # a row a pivot
        radius[r.list] = r.radius

    @F.pandas_udf("array<int>")
    def visits(vs: pd.Series, lists: pd.Series, off: pd.Series) -> pd.Series:
        if not len(vs):
            return pd.Series([], dtype=object)
        d, at = distances(vs), lists.to_numpy()
        slack = 1e-7
        near = (d <= radius[None, :] + reach + slack) & (d <= off.to_numpy()[:, None] + 2 * reach + slack) & (np.arange(len(pivots))[None, :] > at[:, None])
        near[np.arange(len(at)), at] = True
        return pd.Series([np.flatnonzero(row).astype(np.int32) for row in near])

    asked = home.select("id", "v", F.col("list").alias("home"), F.explode(visits("v", "list", "off")).alias("list"))
    return home.select("id", "v", "list"), asked.select("id", "v", "list", (F.col("home") == F.col("list")).cast("double").alias("own"))


def unit_rows(vectors: DataFrame) -> DataFrame:
    """id, v of length one, of the vectors (vec_id, embedding) that are not zero."""
    rows = vectors.select(F.col("vec_id").alias("id"), vector.doubles(F.col("embedding")).alias("v")).withColumn("_n", vector.norm(F.col("v"))).where("_n > 0")
    return rows.select("id", F.transform("v", lambda x: x / F.col("_n")).alias("v"))


def pairs_within(vectors: DataFrame, eps: float, block: int = 1024) -> DataFrame:
    """Pairs (a, b), a < b, at cosine distance of at most eps, exactly. Pivots, one for `block` vectors but PIVOTS at most, cut
    the vectors into cells; a vector is shipped to the cells only that may hold a neighbour of it, and cells of many vectors,
    copies among them, are pieces of bounded size. Where that ships vectors more often than all pairs of pieces would, cells are
    as large as a piece."""
    from . import ann

    rows = checkpointed(unit_rows(vectors))
    first = rows.first()
    if first is None:
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"))
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("id")).limit(min(PIVOTS, 1 + total // block)).select("v").collect()  # PIVOTS rows at most
    pivots = np.array([r.v for r in sample])
    home, asked = _cells(rows, pivots, eps)
    coarse = 1 + total // ann.PIECE
    if coarse < len(pivots) and asked.count() > total * (1 + coarse / 2):
        # eps reaches over most cells: as few as the pieces' size allows ship the vectors less often
        home, asked = _cells(rows, pivots[:coarse], eps)

    def compare(ids, v, _, visitors, w, own) -> tuple[np.ndarray, np.ndarray]:
        found = [], []
        for at in range(0, len(visitors), 1024):
            i, j = np.nonzero(1 - w[at : at + 1024] @ v.T <= eps)
            one, two = visitors[at + i], ids[j]
            keep = (own[at + i, 0] == 0) | (one < two)  # two of a cell visit each other
            found[0].append(np.minimum(one, two)[keep])
            found[1].append(np.maximum(one, two)[keep])
        return np.concatenate(found[0]), np.concatenate(found[1])

    return ann.meet_in_pieces(home.withColumn("own", F.lit(1.0)), asked, len(first.v), compare, "a long, b long", ("own",))
