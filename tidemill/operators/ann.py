"""Vector indexes: inverted lists around centroids, and random hyperplanes.

Both deal vectors to lists and compare a query with the vectors of some lists only. Inside a list everything is exact. Lists
are cut into pieces of at most PIECE vectors by a hash of the id, so a list of very many vectors, or of copies, is many
tasks; a piece keeps its vectors as a matrix while the queries of its list go by in batches, and gives each query its best
rows. A query's best rows of all pieces meet by query: `n` rows a piece at most.

Distances are Euclidean, of unit vectors for cosine; equal distances go to the smaller id. Vectors that are null, of another
size, hold a null or non-finite component, or are zero under cosine, take no part, as rows and as queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vector
from ..sources.buckets import BucketTable
from ..sources.tables import checkpointed

PIECE = 16_384
METRICS = ("l2", "cosine")


def usable(vectors: DataFrame, id: str, size: int, metric: str) -> DataFrame:
    """id, v (doubles, of length one under cosine), and the other columns."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    v = vector.doubles(F.col("embedding"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(id).isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") == size) & fine)
    rows = rows.withColumn("v", v)
    if metric == "cosine":
        rows = rows.withColumn("_norm", vector.norm(F.col("v"))).where("_norm > 0").withColumn("v", F.transform("v", lambda x: x / F.col("_norm"))).drop("_norm")
    return rows.drop("embedding")


def _matrix(lists: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(-1, size)


def _best(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, squared distance) of the n nearest rows of each query."""
    found = [[], [], []]
    squares = (rows**2).sum(axis=1)
    for at in range(0, len(queries), 256):
        part = queries[at : at + 256]
        rough = squares[None, :] - 2 * part @ rows.T + (part**2).sum(axis=1)[:, None]
        limit = np.partition(rough, min(n, len(ids)) - 1, axis=1)[:, min(n, len(ids)) - 1]
        # the product rounds by place: all rows about as near as the n-th are compared again, each in the same way
        q, r = np.nonzero(rough <= limit[:, None] + 1e-9 * (1 + np.abs(limit[:, None])))
        d = ((rows[r] - part[q]) ** 2).sum(axis=1)
        order = np.lexsort((ids[r], d, q))
        q, r, d = q[order], r[order], d[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < n
        for out, x in zip(found, (query_ids[at + q[keep]], ids[r[keep]], d[keep])):
            out.append(x)
    return tuple(np.concatenate(x) for x in found)


def meet_in_pieces(rows: DataFrame, asked: DataFrame, size: int, compare: Callable[..., tuple], schema: str, extra: tuple[str, ...] = (), piece: int = 0, last: Callable[..., tuple] | None = None) -> DataFrame:
    """compare's rows, of `schema`, for each list. rows and asked: list, id, v, and the columns of extra as doubles. Each piece
    of a list's rows, of at most PIECE or `piece` rows, meets all that ask the list, in batches: compare(ids, v, extras, ids
    asking, v asking, extras asking). With `last`, compare also takes what it gave for the piece's batch before, at first None,
    and the rows are those of last(ids, v, extras, what compare gave for the last batch)."""
    counts = F.broadcast(rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / min(PIECE, piece or PIECE)).cast("int").alias("pieces")))  # a row a list
    more = [F.col(c).cast("double").alias(c) for c in extra]
    dealt = rows.join(counts, "list").select("list", F.pmod(F.xxhash64("id"), F.col("pieces").cast("long")).cast("int").alias("piece"), F.lit(0).alias("kind"), "id", "v", *more)
    spread = asked.join(counts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(1).alias("kind"), "id", "v", *more)
    names = [part.strip().split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, seen = None, [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(i)) for i in range(3)], axis=1)
            cuts = np.append(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1, len(keys))
            begin = 0
            for end in cuts.tolist():
                if begin == end:
                    continue
                part, (own, piece, kind) = batch.slice(begin, end - begin), keys[begin].tolist()
                begin = end
                if (own, piece) != now:
                    if seen is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in last(*held[0], seen)], names=names)
                    now, held, seen = (own, piece), [], None
                extras = np.stack([np.asarray(part.column(i)) for i in range(5, 5 + len(extra))], axis=1) if extra else None
                mine = (np.asarray(part.column(3)), _matrix(part.column(4), size), extras)
                if kind == 0:
                    held.append(mine)
                elif held:
                    held = [tuple(np.concatenate(x) if x[0] is not None else None for x in zip(*held))]
                    if last:
                        seen = compare(*held[0], *mine, seen)
                        continue
                    found = compare(*held[0], *mine)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)
        if seen is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in last(*held[0], seen)], names=names)

    both = dealt.unionByName(spread).repartition("list", "piece").sortWithinPartitions("list", "piece", "kind")
    return both.mapInArrow(run, schema)


def ranked_in_lists(rows: DataFrame, asked: DataFrame, n: int, size: int) -> DataFrame:
    """query_id, vec_id, d2: for each query the n nearest rows of the lists it asks. rows: list, vec_id, v; asked: list,
    query_id, v. A row that is in several of a query's lists counts once."""
    compare = lambda ids, v, _, query_ids, queries, __: _best(ids, v, query_ids, queries, n)
    sides = rows.select("list", F.col("vec_id").alias("id"), "v"), asked.select("list", F.col("query_id").alias("id"), "v")
    found = meet_in_pieces(*sides, size, compare, "query_id long, vec_id long, d2 double").dropDuplicates(["query_id", "vec_id"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= n)


def scored(found: DataFrame, metric: str) -> DataFrame:
    """query_id, rank, vec_id, score: distance, or similarity under cosine."""
    return found.select("query_id", "rank", "vec_id", (F.sqrt("d2") if metric == "l2" else 1 - F.col("d2") / 2).alias("score"))


def exact(vectors: DataFrame, queries: DataFrame, n: int, size: int, metric: str = "l2") -> DataFrame:
    """query_id, rank, vec_id, score by comparing every query (query_id, embedding) with every vector (vec_id, embedding)."""
    rows, asked = usable(vectors, "vec_id", size, metric).withColumn("list", F.lit(0)), usable(queries, "query_id", size, metric).withColumn("list", F.lit(0))
    return scored(ranked_in_lists(rows, asked, n, size), metric)


def recall(found: DataFrame, true: DataFrame) -> float:
    """Share of the true hits (query_id, vec_id) that were found."""
    hits = true.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.agg(F.coalesce(F.count("hit") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(1.0))).first()[0]


def least_that_reaches(target: float, most: int, measure: Callable[[int], float]) -> tuple[int, float]:
    """The smallest setting from 1 to most whose measured recall reaches the target, by bisection, and that recall."""
    low, high, best = 1, most, measure(most)
    while low < high:
        middle = (low + high) // 2
        reached = measure(middle)
        if reached >= target:
            high, best = middle, reached
        else:
            low = middle + 1
    return high, best


class InvertedLists:
    """Vectors in lists around centroids, as a table in buckets of which a bucket is a list: a search reads the files of the
    lists it probes only, and added, changed and deleted rows rewrite the lists they are or were in.

    Centroids come of k-means over a sample of at most SAMPLE rows a list, chosen by a hash of the id; every row is indexed.
    Fewer rows than lists give as many lists as k-means finds. The centroids, `lists` rows at most, are held by the driver and
    each task."""

    SAMPLE = 256

    def __init__(self, spark: SparkSession, path: str, size: int, metric: str = "l2"):
        self.spark, self.path, self.size, self.metric = spark, path.rstrip("/"), size, metric
        found = spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()  # a row a list
        self.centroids = np.array([r.center for r in found], float).reshape(-1, size)
        self.rows = BucketTable(spark, f"{self.path}/rows", "vec_id long, list int, off double, v array<double>", "vec_id", bucket=F.col("list"))

    @classmethod
    def build(cls, vectors: DataFrame, path: str, size: int, lists: int = 100, metric: str = "l2", rounds: int = 10, seed: int = 1) -> InvertedLists:
        """A new index of vectors (vec_id, embedding) in an empty folder. Of rows that repeat an id the greatest counts."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark = vectors.sparkSession
        sample = usable(vectors, "vec_id", size, metric).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(lists * cls.SAMPLE)
        sample = checkpointed(sample.select(array_to_vector("v").alias("features")))
        n = sample.count()
        centers = []
        if n:
            centers = [[float(x) for x in c] for c in KMeans(k=max(2, min(lists, n)), maxIter=rounds, seed=seed).fit(sample).clusterCenters()] if n > 1 else [list(map(float, sample.first().features))]
        spark.createDataFrame(list(enumerate(centers)), "list int, center array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        index = cls(spark, path, size, metric)
        index.add(vectors)
        return index

    def _nearest(self, most: int):
        """A function of v: the `most` nearest centroids with their distances, nearest first."""
        centroids, squares = self.centroids, (self.centroids**2).sum(axis=1)

        @F.pandas_udf("array<struct<list:int,d:double>>")
        def nearest(vs: pd.Series) -> pd.Series:
            if not len(vs):
                return pd.Series([], dtype=object)
            rows = np.stack(vs.to_numpy())
            d = np.sqrt(np.maximum(0, (rows**2).sum(axis=1)[:, None] - 2 * rows @ centroids.T + squares))
            near = np.argsort(d, axis=1, kind="stable")[:, :most]
            return pd.Series([[{"list": int(i), "d": float(d[k, i])} for i in row] for k, row in enumerate(near)])

        return nearest

    def add(self, vectors: DataFrame) -> None:
        """Adds rows; those of ids that are there move to the list of their new vector."""
        if not len(self.centroids):
            return
        rows = usable(vectors, "vec_id", self.size, self.metric).groupBy("vec_id").agg(F.max("v").alias("v"))
        at = self._nearest(1)(F.col("v"))[0]
        rows = checkpointed(rows.select("vec_id", at["list"].alias("list"), at["d"].alias("off"), "v"))
        held = self.rows.read().join(rows.select("vec_id", F.col("list").alias("now")), "vec_id").where("list <> now").select("vec_id", "list")
        self._rewrite(held, rows)

    def remove(self, ids: DataFrame) -> None:
        """Takes out the rows of these ids (vec_id)."""
        self._rewrite(self.rows.read().join(ids.select("vec_id").distinct(), "vec_id").select("vec_id", "list"), None)

    def _rewrite(self, gone: DataFrame, new: DataFrame | None) -> None:
        """One commit: rows of `gone` (vec_id, list) leave their lists, new rows come."""
        schema = self.rows.schema
        out = gone.select("vec_id", "list", F.lit(None).cast("double").alias("off"), F.lit(None).cast("array<double>").alias("v"))
        both = out.withColumn("_out", F.lit(True)) if new is None else out.withColumn("_out", F.lit(True)).unionByName(new.withColumn("_out", F.lit(False)))
        both = checkpointed(both)
        touched = sorted(r[0] for r in both.select("list").distinct().collect())  # a row a list
        if touched:
            base = self.rows.version()
            old = self.rows._rows(base, touched).join(both.select("vec_id").distinct(), "vec_id", "left_anti")
            rows = old.unionByName(both.where("NOT _out").select(*schema.names)).withColumn("_bucket", F.col("list"))
            self.rows._write(rows, touched, base, None)

    def search(self, queries: DataFrame, n: int, probes: int = 10, refine: bool = False) -> DataFrame:
        """query_id, rank, vec_id, score of the n nearest rows of the `probes` nearest lists of each query (query_id,
        embedding). refine makes the result exact: by the triangle inequality a list farther from the query than its radius
        and the n-th distance found together holds nothing nearer, and every other list is compared as well."""
        if n <= 0 or not len(self.centroids):
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        asked = usable(queries.select("query_id", "embedding"), "query_id", self.size, self.metric)
        every = len(self.centroids)
        near = asked.select("query_id", "v", F.posexplode(self._nearest(every if refine else min(probes, every))(F.col("v"))).alias("place", "at"))
        near = near.select("query_id", "v", "place", "at.list", "at.d")
        if refine:
            near = checkpointed(near)
        first = ranked_in_lists(self._probed(near.where(F.col("place") < probes)), near.where(F.col("place") < probes).select("list", "query_id", "v"), n, self.size)
        if not refine:
            return scored(first, self.metric)
        first = checkpointed(first)
        limits = first.groupBy("query_id").agg(F.max("d2").alias("limit"), F.count(F.lit(1)).alias("found"))
        radius = self.rows.read().groupBy("list").agg(F.max("off").alias("radius"))  # a row a list
        rest = near.where(F.col("place") >= probes).join(F.broadcast(radius), "list").join(limits, "query_id", "left")
        open_ = (F.coalesce(F.col("found"), F.lit(0)) < n) | (F.col("d") - F.col("radius") <= F.sqrt("limit") + 1e-6 * (1 + F.col("d")))
        rest = checkpointed(rest.where(open_).select("list", "query_id", "v"))
        second = ranked_in_lists(self._probed(rest), rest, n, self.size)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "vec_id"))
        both = first.unionByName(second).withColumn("rank", place).where(F.col("rank") <= n)
        return scored(both, self.metric)

    def _probed(self, asked: DataFrame) -> DataFrame:
        """The rows of the lists that are asked for, from the files of those alone."""
        lists = sorted(r[0] for r in asked.select("list").distinct().collect())  # a row a list
        return self.rows.read(buckets=lists).select("list", "vec_id", "v")

    def tuned(self, queries: DataFrame, n: int, target: float = 0.9) -> tuple[int, float]:
        """The fewest probes that find `target` of the n nearest rows of these queries, and the share they find. queries
        should be a bounded sample."""
        queries = checkpointed(queries.select("query_id", "embedding"))
        true = checkpointed(self.search(queries, n, len(self.centroids)))
        return least_that_reaches(target, len(self.centroids), lambda probes: recall(self.search(queries, n, probes), true))


class Hyperplanes:
    """Vectors by the sides of random hyperplanes they lie on: `tables` times `bits` planes through the origin, drawn from a
    seed, so the index is a function of the vector alone and needs no training. A query asks, in each table, the bucket of
    its own sides and the `flips` buckets across the planes it is nearest to. For cosine."""

    def __init__(self, size: int, tables: int = 8, bits: int = 12, seed: int = 1):
        self.size, self.tables, self.bits = size, tables, bits
        self.planes = np.random.default_rng(seed).normal(size=(tables, bits, size))

    def _codes(self, flips: int):
        """A function of v: the buckets, numbered over all tables, of its own sides and of `flips` changes of sides."""
        planes, bits, tables = self.planes, self.bits, self.tables
        # changes of one side and of two, by the places of the sides in the order of their margins
        changes = sorted([(i,) for i in range(bits)] + [(i, j) for j in range(bits) for i in range(j)], key=lambda c: (sum((i + 1) ** 2 for i in c), c))[:flips]

        @F.pandas_udf("array<long>")
        def codes(vs: pd.Series) -> pd.Series:
            if not len(vs):
                return pd.Series([], dtype=object)
            rows = np.stack(vs.to_numpy())
            margin = np.einsum("tbs,ns->ntb", planes, rows)
            power = 1 << np.arange(bits)
            own = ((margin > 0) * power).sum(axis=2)
            out = [own]
            order = power[np.argsort(np.abs(margin), axis=2, kind="stable")]
            for change in changes:
                out.append(own ^ order[:, :, list(change)].sum(axis=2))
            found = np.stack(out, axis=2) + (np.arange(tables) << bits)[None, :, None]
            return pd.Series(list(found.reshape(len(rows), -1).astype(np.int64)))

        return codes

    def buckets(self, vectors: DataFrame) -> DataFrame:
        """list, vec_id, v: each vector (vec_id, embedding) in its bucket of each table."""
        rows = usable(vectors.select("vec_id", "embedding"), "vec_id", self.size, "cosine")
        return rows.select(F.explode(self._codes(0)(F.col("v"))).alias("list"), "vec_id", "v")

    def search(self, buckets: DataFrame, queries: DataFrame, n: int, flips: int = 8) -> DataFrame:
        """query_id, rank, vec_id, score of the n nearest rows in the buckets that each query (query_id, embedding) asks."""
        asked = usable(queries.select("query_id", "embedding"), "query_id", self.size, "cosine")
        asked = asked.select(F.explode(self._codes(flips)(F.col("v"))).alias("list"), "query_id", "v")
        return scored(ranked_in_lists(buckets, asked, n, self.size), "cosine")

    def tuned(self, buckets: DataFrame, vectors: DataFrame, queries: DataFrame, n: int, target: float = 0.9) -> tuple[int, float]:
        """The fewest changes of sides that find `target` of the n nearest rows of these queries, a bounded sample, and the
        share they find."""
        queries = checkpointed(queries.select("query_id", "embedding"))
        true = checkpointed(exact(vectors, queries, n, self.size, "cosine"))
        most = self.bits * (self.bits + 1) // 2
        # a true hit is found from the change on that leads to one of its buckets, so no search is needed to know the recall
        asked = usable(queries, "query_id", self.size, "cosine").select("query_id", F.posexplode(self._codes(most)(F.col("v"))).alias("place", "list"))
        pairs = true.select("query_id", "vec_id")
        held = buckets.select("list", "vec_id").join(F.broadcast(pairs), "vec_id")  # n rows a query of the sample
        met = held.join(asked, ["query_id", "list"]).groupBy("query_id", "vec_id").agg(F.min(F.col("place") % (1 + most)).alias("flips"))
        flips, total = np.array([r.flips for r in met.select("flips").collect()]), true.count()
        return least_that_reaches(target, most, lambda k: float((flips <= k).sum() / total) if total else 1.0)
