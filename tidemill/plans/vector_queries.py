"""Similarity search, clustering and storylines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector
from ..operators import cluster, graph, index, search, vectors
from ..sources.exports import scratch
from ..sources.tables import checkpointed
from .registry import query, table

QUERY = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, {QUERY} ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return vectors.search(e, vectors.reference(e, 0), 10).withColumn("score", F.round("score", 6))


@query(f"""
    SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, {QUERY} WHERE label IN (1, 2, 3))
    WHERE s >= 0.05 ORDER BY s DESC, vec_id LIMIT 20
""")
def vector_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return vectors.search(e, vectors.reference(e, 0), 20, threshold=0.05, where=F.col("label").isin(1, 2, 3)).withColumn("score", F.round("score", 6))


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], q), 6) AS score FROM embeddings, {QUERY} ORDER BY list_distance(embedding::DOUBLE[], q), vec_id LIMIT 10")
def l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return vectors.search(e, vectors.reference(e, 0), 10, metric="l2").withColumn("score", F.round("score", 6))


@query(f"""
    SELECT vec_id, label, round(exp(s - max(s) OVER (PARTITION BY label)) / sum(exp(s - m)) OVER (PARTITION BY label), 6) AS share FROM (
      SELECT *, max(s) OVER (PARTITION BY label) AS m FROM (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, {QUERY}))
""")
def softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    q = F.array(*[F.lit(float(x)) for x in vectors.reference(e, 0)])
    rows = e.select("vec_id", "label", vector.cosine(F.col("embedding"), q).alias("s"))
    return vectors.softmax_shares(rows, "s", "label").select("vec_id", "label", F.round("share", 6).alias("share"))


@query(f"""
    SELECT doc_id, round(max(s), 6) AS score FROM (SELECT doc_id, s, exp(s - max(s) OVER ()) / sum(exp(s - m)) OVER () AS share FROM (
      SELECT *, max(s) OVER () AS m FROM (SELECT vec_id % 100 AS doc_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, {QUERY} ORDER BY s DESC, vec_id LIMIT 50)))
    WHERE share >= 0.019 GROUP BY 1
""")
def chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir).select((F.col("vec_id") % 100).alias("doc_id"), "vec_id", "embedding")
    return vectors.chunk_search(e, vectors.reference(e, 0), 50, 0.019).withColumn("score", F.round("score", 6))


@query(f"""
    SELECT vec_id, lang, score, pos, total FROM (SELECT h.*, d.lang, row_number() OVER (ORDER BY s DESC, vec_id) AS pos, count(*) OVER () AS total FROM (
      SELECT vec_id, s, round(s, 6) AS score FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, {QUERY}) ORDER BY s DESC, vec_id LIMIT 30) h
      JOIN documents d ON d.doc_id = h.vec_id) WHERE pos BETWEEN 11 AND 20
""")
def vector_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    hits = vectors.search(e, vectors.reference(e, 0), min(3 * 10, 50))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    found = search.page(docs.join(F.broadcast(hits), "vec_id"), [F.col("score").desc(), F.col("vec_id")], skip=10, limit=10)  # at most 50 hits
    return found.withColumn("score", F.round("score", 6))


@query()
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.lit(None).cast("string").alias("brief"), "text")
    done = docs.where("doc_id % 2 = 0").select("doc_id")
    embed = lambda chunks: [[float(len(c)), float(c.count(" "))] for c in chunks]  # noqa: E731 - stands in for a model
    return index.build(docs, embed, done)


@query("SELECT event_id AS id, value AS score FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' AND value >= 30 AND event_id % 4 = 0 ORDER BY value DESC, event_id LIMIT 15")
def recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("value").alias("score"))
    picked = records.where("id % 4 = 0").select("id")  # some are no candidates
    return index.recommend(records, "2024-01-05", "2024-01-25", 30, picked, 15).select("id", "score")


@query(f"""
    SELECT vec_id, round(max(s), 6) AS score FROM (
      (SELECT vec_id, s FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, {QUERY}) ORDER BY s DESC, vec_id LIMIT 20)
      UNION ALL (SELECT vec_id, s * 0.9 FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)) AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 20))
    GROUP BY 1
""")
def summary_fulltext_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import dedup

    e = _vectors(spark, sf_dir)
    one = vectors.search(e, vectors.reference(e, 0), 20)
    two = vectors.search(e, vectors.reference(e, 1), 20).withColumn("score", F.col("score") * 0.9)
    return dedup.best_of([one, two], "vec_id", "score").withColumn("score", F.round("score", 6))


PAIRS = "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 0.6"


@query(f"SELECT a, b FROM ({PAIRS}) WHERE a < b")
def neighbour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.pairs_within(_vectors(spark, sf_dir), 0.6)


@query(f"""
    WITH RECURSIVE p AS ({PAIRS}), r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
    SELECT e.vec_id, CASE WHEN e.vec_id IN (SELECT a FROM p) THEN m.root ELSE -1 END AS cluster_id FROM embeddings e JOIN (SELECT a, min(b) AS root FROM r GROUP BY 1) m ON m.a = e.vec_id
""")
def dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.dbscan(_vectors(spark, sf_dir), eps=0.6).na.fill({"cluster_id": -1})


@query()
def agglomerative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.run_plan(_vectors(spark, sf_dir), cluster.plan("agglomerative_loose", max_points=None), block="label")


@query("SELECT label AS cluster_id, count(*) AS size, min(vec_id) AS repr_doc_id, max(ts) AS last_seen FROM embeddings JOIN events ON event_id = vec_id GROUP BY 1 ORDER BY size DESC, cluster_id LIMIT 5")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = _vectors(spark, sf_dir).select("vec_id", F.col("label").alias("cluster_id"))
    seen = table(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"), "ts")
    return cluster.summary(assigned, seen).orderBy(F.col("size").desc(), "cluster_id").limit(5)


@query("SELECT printf('cluster %d: %d members, representative %d', label, count(*), min(vec_id)) AS line FROM embeddings GROUP BY label")
def cluster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _vectors(spark, sf_dir).groupBy(F.col("label").alias("cluster_id")).agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("repr_doc_id"))
    return cluster.report_lines(found)


def _story_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents; the shares of the letters stand in for a model's embedding."""
    share = lambda x: (F.char_length("text") - F.char_length(F.replace("text", F.lit(x), F.lit("")))) / F.greatest(F.lit(1), F.char_length("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("title"), F.split("text", " ").alias("entities"), F.array(*map(share, "abcdefghijklmnopqrstuvwxyz")).alias("embedding"))
    return checkpointed(docs.withColumn("day", (F.col("doc_id") % 30).cast("double")))


@query("""
    SELECT entity, count(*) AS n FROM (SELECT unnest(list_concat(string_split(text, ' '), string_split(text, '.'), coalesce(CASE WHEN doc_id % 2 = 0 THEN [source] END, []))) AS entity
      FROM documents WHERE TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 AS INTEGER)) BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-02-01') WHERE regexp_matches(entity, '^\\s*\\S+')
    GROUP BY 1 ORDER BY n DESC, entity LIMIT 50
""".replace("\\\\", "\\"))
def top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("doc_id") % 60).cast("int"))
    docs = table(spark, sf_dir, "documents").select(
        ts.alias("ts"), F.split("text", " ").alias("people"), F.split("text", r"\.").alias("organizations"), F.when(F.col("doc_id") % 2 == 0, F.array("source")).alias("locations")
    )
    return graph.stop_entities(docs, "2024-02-01", 30, 50)


@query()
def storyline_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = graph.grow(_story_docs(spark, sf_dir), 0, ["the", "of", "and"], max_depth=3, window_days=30)
    return spark.createDataFrame([(int(a), int(b), round(float(s), 6)) for a, b, s in line.edges], "source long, target long, score double")


@query()
def storyline_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version that the walk of storyline_graph wrote while it grew."""
    folder = scratch(spark)
    graph.grow(_story_docs(spark, sf_dir), 0, ["the", "of", "and"], max_depth=3, window_days=30, snapshot=graph.snapshot_table(spark, folder, "seed 0"))
    return graph.latest_snapshot(spark, folder, "seed 0").withColumn("score", F.round("score", 6))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 OR value % 10 >= 5 THEN 'COMPLETED' ELSE 'REJECTED' END AS state FROM events")
def graph_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = F.when(F.col("event_id") % 7 > 0, F.col("value") % 10)  # a judgement that failed is missing
    return table(spark, sf_dir, "events").select("event_id", graph.verdicts(judged).alias("state"))


@query()
def hdbscan_eom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.run_plan(_vectors(spark, sf_dir), cluster.plan("hdbscan_eom", max_points=None)).na.fill({"cluster_id": -1})


@query()
def hdbscan_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.run_plan(_vectors(spark, sf_dir), cluster.plan("hdbscan_leaf", max_points=None)).na.fill({"cluster_id": -1})
