"""Tables in buckets and vector indexes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import ann, cluster
from tidemill.operators import vectors as vector_operators
from tidemill.plans import catalog
from tidemill.sources.buckets import BucketTable, Conflict
from tidemill.sources.exports import scratch

from .conftest import DATA

SCHEMA = "id long, a string, n long, s struct<x:long,y:string>"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def held(spark, rows=50, buckets=8):
    out = BucketTable(spark, scratch(spark), SCHEMA, "id", buckets)
    out.merge(spark.createDataFrame([(i, f"a{i}", i, (i, "y")) for i in range(rows)], SCHEMA))
    return out


def test_merge_rewrites_touched_buckets_only(spark):
    t = held(spark)
    before = t.files()
    new = spark.createDataFrame([(3, "new", 30), (77, "come", 7), (None, "no key", 0)], "id long, a string, n long")
    t.merge(new)
    found = {r.id: r for r in t.read().collect()}
    assert len(found) == 51 and tuple(found[3]) == (3, "new", 30, (3, "y")) and tuple(found[77]) == (77, "come", 7, None)
    touched = {r[0] for r in new.where("id IS NOT NULL").select(t.bucket).collect()}
    after = t.files()
    assert {b for b in after if after[b] != before.get(b)} == touched and len(touched) < len(after)
    assert {r.id for r in t.read(version=1).collect()} == set(range(50))


def test_a_batch_is_merged_once(spark):
    t = held(spark)
    sink = t.sink("feed", order="n")
    one = spark.createDataFrame([(1, "x", 100), (1, "y", 101), (2, "old", -1)], "id long, a string, n long")
    sink(one, 0)
    first, files = rows_of(t.read()), t.files()
    assert {r[0]: r[1] for r in first if r[0] < 3} == {0: "a0", 1: "y", 2: "a2"}  # the greatest n counts, a smaller one loses
    sink(one.withColumn("a", F.lit("again")), 0)
    assert rows_of(t.read()) == first and t.files() == files
    sink(one.withColumn("n", F.lit(500)), 1)
    assert t.version().batches == {"feed": 1} and {r.n for r in t.read().where("id < 3").collect()} == {0, 500}


def test_two_writers_of_one_version(spark):
    t = held(spark)
    other = BucketTable(spark, t.path, SCHEMA, "id", 8)
    base = other.version()
    t.merge(spark.createDataFrame([(1, "first")], "id long, a string"))
    rows = t.read(version=base.number).withColumn("_bucket", t.bucket)
    with pytest.raises(Conflict):
        other._write(rows.where("id = 1"), [0], base, None)
    assert {r.a for r in t.read().where("id = 1").collect()} == {"first"}
    other.merge(spark.createDataFrame([(1, "second")], "id long, a string"))  # the failed try's files are in no version
    assert {r.a for r in t.read().where("id = 1").collect()} == {"second"} and t.read().count() == 50


def test_update_delete_and_vacuum(spark):
    t = held(spark)
    assert t.update(F.col("id") < 10, {"s.y": F.lit("z"), "a": F.lit("a3")}) == (10, 10)
    files = t.files()
    assert t.update(F.col("id") < 10, {"a": F.lit("a3")}) == (10, 0) and t.files() == files
    assert {tuple(r) for r in t.read().where("id < 10").select("a", "s.x", "s.y").collect()} == {("a3", i, "z") for i in range(10)}
    t.merge(spark.createDataFrame([(900, "x")], "id long, a string"), insert=False)
    t.delete(spark.createDataFrame([(i,) for i in range(0, 50, 2)], "id long"))
    now = rows_of(t.read())
    assert [r[0] for r in sorted(now)] == list(range(1, 50, 2))
    t.delete(spark.createDataFrame([(i,) for i in range(50)], "id long"))
    assert t.read().count() == 0 and t.files() == {}
    t.merge(spark.createDataFrame([(5, "back")], "id long, a string"))
    assert t.vacuum() > 0 and len(t.versions()) == 1 and rows_of(t.read()) == [(5, "back", None, None)]
    with pytest.raises(KeyError):
        t.read(version=1)


def vectors(spark, matrix, ids=None):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(range(len(matrix)) if ids is None else ids, matrix)], "vec_id long, embedding array<double>")


def clustered(n=1500, groups=60, size=12, seed=4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, size)) * 4
    return centers[rng.integers(0, groups, n)] + rng.normal(size=(n, size))


def brute(matrix, asked, n, metric):
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True) if metric == "cosine" else matrix
    d = ((unit[asked][:, None, :] - unit[None]) ** 2).sum(axis=2)
    return {(int(q), int(i)) for q, row in zip(asked, d) for i in np.lexsort((np.arange(len(row)), row))[:n]}


def hits(df):
    return {(r.query_id, r.vec_id) for r in df.collect()}


def asking(df, where="vec_id % 20 = 0"):
    return df.where(where).select(F.col("vec_id").alias("query_id"), "embedding")


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_inverted_lists(spark, metric):
    matrix = clustered()
    df = vectors(spark, matrix)
    index = ann.InvertedLists.build(df, scratch(spark), 12, lists=50, metric=metric)
    assert index.rows.read().count() == len(matrix)
    true = brute(matrix, np.arange(0, 1500, 20), 10, metric)
    found = hits(index.search(asking(df), 10, probes=10))
    assert len(found & true) >= 0.9 * len(true)
    for probes in (1, 10):
        assert hits(index.search(asking(df), 10, probes=probes, refine=True)) == true
    assert hits(ann.exact(df, asking(df), 10, 12, metric)) == true
    few = asking(df, "vec_id = 40")
    near = index.search(few, 3, probes=2)
    assert [r.rank for r in near.orderBy("rank").collect()] == [1, 2, 3] and near.orderBy("rank").first().vec_id == 40
    read = {f.split("bucket=")[1].split("/")[0] for f in index._probed(few.select(F.lit(3).alias("list")).unionAll(few.select(F.lit(5)))).inputFiles()}
    assert read == {"3", "5"}  # of the other lists no file is opened


def test_inverted_lists_change(spark):
    matrix = clustered(400, 20)
    df = vectors(spark, matrix)
    index = ann.InvertedLists.build(df, scratch(spark), 12, lists=20)
    files = index.rows.files()
    index.add(vectors(spark, matrix[[5, 6]], [900, 6]))
    assert sum(index.rows.files().get(b) != f for b, f in files.items()) <= 2
    moved = vectors(spark, -matrix[[7]], [7])
    index.add(moved)
    index.remove(df.where("vec_id IN (0, 1)"))
    ids = [r.vec_id for r in index.rows.read().collect()]
    assert sorted(ids) == [*range(2, 400), 900]
    assert [r.vec_id for r in index.search(moved.withColumnRenamed("vec_id", "query_id"), 1).collect()] == [7]
    assert hits(index.search(asking(df, "vec_id = 5"), 2)) == {(5, 5), (5, 900)}
    again = ann.InvertedLists(spark, index.path, 12)  # as another session finds it
    assert hits(again.search(asking(df, "vec_id = 5"), 2)) == {(5, 5), (5, 900)}


def test_inverted_lists_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    odd = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, []), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1.0] * 3), (None, [1.0, 1.0]), (8, [0.0, 0.0]), (2, [0.0, 3.0])]
    df = spark.createDataFrame(odd, schema)
    for metric, ids in (("l2", {1, 2, 8}), ("cosine", {1, 2})):
        index = ann.InvertedLists.build(df, scratch(spark), 2, metric=metric)  # fewer rows than lists
        assert {r.vec_id for r in index.rows.read().collect()} == ids
        assert {r.vec_id for r in index.search(asking(df, "vec_id = 1"), 10, refine=True).collect()} == ids  # more asked than there are
        assert index.search(asking(df, "vec_id = 1"), 0).count() == index.search(asking(df, "vec_id = 1"), -5).count() == 0
        assert index.search(asking(df, "vec_id IN (3, 4, 5)"), 3).count() == 0
    for few in (odd[:1], []):
        index = ann.InvertedLists.build(spark.createDataFrame(few, schema), scratch(spark), 2)
        assert index.search(asking(df, "vec_id = 1"), 5).count() == len(few)


def test_long_lists_are_cut(spark, monkeypatch):
    """A third of all rows are copies: their list is many pieces, and ties go to the smaller ids."""
    monkeypatch.setattr(ann, "PIECE", 40)
    matrix = clustered(600, 20)
    matrix[100:300] = matrix[100]
    df = vectors(spark, matrix)
    true = brute(matrix, np.arange(0, 600, 20), 7, "l2")
    index = ann.InvertedLists.build(df, scratch(spark), 12, lists=10)
    assert hits(index.search(asking(df), 7, probes=2, refine=True)) == true == hits(ann.exact(df, asking(df), 7, 12))


def test_hyperplanes(spark):
    matrix = clustered()
    df = vectors(spark, matrix)
    planes = ann.Hyperplanes(12, tables=3, bits=8)
    buckets = planes.buckets(df).persist()
    true = brute(matrix, np.arange(0, 1500, 20), 10, "cosine")
    found = hits(planes.search(buckets, asking(df), 10, flips=12))
    assert len(found & true) >= 0.9 * len(true)
    assert len(hits(planes.search(buckets, asking(df), 10, flips=0)) & true) < len(found & true)
    all_sides = ann.Hyperplanes(12, tables=1, bits=2)
    assert hits(all_sides.search(all_sides.buckets(df), asking(df), 10, flips=3)) == true  # every bucket is asked
    flips, reached = planes.tuned(buckets, df, asking(df, "vec_id % 60 = 0"), 10, 0.9)
    assert reached >= 0.9 and flips <= 12


@pytest.mark.parametrize("name, metric", [("ivf_probed", "l2"), ("hyperplane_search", "cosine")])
def test_recall_of_the_queries(spark, name, metric):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").toPandas()
    true = brute(np.array(e.embedding.tolist(), float), np.arange(0, len(e), 20), 10, metric)
    assert len(hits(catalog.QUERIES[name](spark, DATA)) & true) >= 0.9 * len(true)


def test_pairs_ship_to_near_cells_only(spark, monkeypatch):
    monkeypatch.setattr(ann, "PIECE", 64)
    matrix = clustered(1200, 40)
    matrix[200:400] = matrix[200]
    df = vectors(spark, matrix)
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    for eps in (1e-9, 0.02, 0.3):
        near = np.triu(1 - unit @ unit.T <= eps, 1)
        pairs = vector_operators.pairs_within(df, eps, block=30)
        assert {(r.a, r.b) for r in pairs.collect()} == {(int(i), int(j)) for i, j in zip(*np.nonzero(near))}
    pivots = unit[::30]
    _, asked = vector_operators._cells(vector_operators.unit_rows(df), pivots, 0.02)
    assert asked.count() < 0.2 * len(matrix) * (len(pivots) + 1) / 2  # of all that tiles of all pairs would ship


def test_copies_count_in_dbscan(spark):
    rows = [(i, [1.0, 0.0]) for i in range(4)] + [(9, [0.0, 1.0]), (10, [0.0, 0.0]), (11, [0.0, 0.0]), (12, [1.0, 0.01])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.vec_id: r.cluster_id for r in cluster.dbscan(df, 0.1, 4).collect()} == {**{i: 0 for i in range(4)}, 12: 0, 9: None, 10: None, 11: None}
    assert {r.cluster_id for r in cluster.dbscan(df, 0.1, 6).collect()} == {None}


@pytest.mark.parametrize("size, samples, selection", [(3, 2, "eom"), (2, 1, "leaf")])
def test_hdbscan_in_pieces(spark, monkeypatch, size, samples, selection):
    """The same clusters as over one frame, which is tested by the definition."""
    import pandas as pd

    monkeypatch.setattr(ann, "PIECE", 50)
    matrix = clustered(260, 9, size=6, seed=3)
    matrix[30:50] = matrix[30]
    ids = np.arange(260) * 3
    got = {r.vec_id: r.cluster_id for r in cluster.hdbscan(vectors(spark, matrix, ids), size, samples, selection).collect()}
    whole = cluster._hdbscan(pd.DataFrame({"vec_id": ids, "embedding": list(matrix)}), size, samples, selection)
    assert got == {int(i): None if pd.isna(c) else int(c) for i, c in zip(whole.vec_id, whole.cluster_id)}
    assert len(set(got.values())) > 4


def test_hdbscan_asks_for_few_points_again(spark, monkeypatch):
    """All points meet once; after that only those whose listed neighbours don't settle their part's edge."""
    import pandas as pd

    shipped, real = [], ann.meet_in_pieces
    monkeypatch.setattr(ann, "PIECE", 100)
    monkeypatch.setattr(ann, "meet_in_pieces", lambda rows, asked, *a, **k: (shipped.append(asked.count()), real(rows, asked, *a, **k))[1])
    matrix, ids = np.random.default_rng(5).normal(size=(400, 12)), np.arange(400) + 7
    got = {r.vec_id: r.cluster_id for r in cluster.hdbscan(vectors(spark, matrix, ids), 2, 1, "leaf").collect()}
    whole = cluster._hdbscan(pd.DataFrame({"vec_id": ids, "embedding": list(matrix)}), 2, 1, "leaf")
    assert got == {int(i): None if pd.isna(c) else int(c) for i, c in zip(whole.vec_id, whole.cluster_id)}
    assert shipped[0] == 400 and sum(shipped[1:]) < 200


@pytest.mark.parametrize("name", ["hdbscan_eom", "hdbscan_leaf"])
def test_hdbscan_queries_take_all_points(spark, monkeypatch, name):
    """Every vector of the table has its row, also beyond a plan's max_points; the clusters are those of one frame of all."""
    from tidemill.plans import catalog

    monkeypatch.setitem(cluster.PLAN, "max_points", 100)
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    got = {r.vec_id: r.cluster_id for r in catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()}
    chosen = cluster.PROFILES[name]
    whole = cluster._hdbscan(rows, chosen["min_cluster_size"], chosen["min_samples"], chosen["selection"])
    assert len(rows) > 100 and got == dict(zip(whole.vec_id, whole.cluster_id.fillna(-1)))


def test_agglomerative_query_takes_all_points(spark, monkeypatch):
    from tidemill.plans import catalog

    monkeypatch.setitem(cluster.PLAN, "max_points", 100)
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    got = {r.vec_id: r.cluster_id for r in catalog.QUERIES["agglomerative"](spark, "/root/testdata/sf0.001").collect()}
    whole = [cluster._linkage(group, cluster.PROFILES["agglomerative_loose"]["distance"]) for _, group in rows.groupby("label")]
    assert len(rows) > 100 and got == {i: c for part in whole for i, c in zip(part.vec_id, part.cluster_id)}


def test_wide_eps_ships_vectors_once_a_piece(spark, monkeypatch):
    """Where eps reaches over all cells, a vector goes to as many cells as the pieces' size asks for, not to one for each pivot."""
    shipped = []
    real = ann.meet_in_pieces
    monkeypatch.setattr(ann, "meet_in_pieces", lambda rows, asked, *a, **k: (shipped.append(asked.count()), real(rows, asked, *a, **k))[1])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(4).normal(size=(400, 8)))], "vec_id long, embedding array<double>")
    found = {tuple(r) for r in vector_operators.pairs_within(df, 0.6, block=20).collect()}
    v = np.array([r.embedding for r in df.orderBy("vec_id").collect()])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert shipped == [400] and found == {(int(a), int(b)) for a, b in zip(*np.nonzero(1 - v @ v.T <= 0.6)) if a < b}


def test_tuned_changes_search_the_sample_once(spark, monkeypatch):
    """The recall of a number of changes is that of a search with it, without searching."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)))], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    planes = ann.Hyperplanes(8, tables=3, bits=5)
    buckets, true = planes.buckets(df).persist(), ann.exact(df, asked, 10, 8, "cosine").persist()
    want = ann.least_that_reaches(0.8, 15, lambda k: ann.recall(planes.search(buckets, asked, 10, k), true))
    monkeypatch.setattr(ann.Hyperplanes, "search", None)
    assert planes.tuned(buckets, df, asked, 10, 0.8) == pytest.approx(want)
