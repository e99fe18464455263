"""Joins, set operations and window computations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import dedup, joins
from .registry import query, table


@query("""
    SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
    WHERE n.n_nationkey = c.c_nationkey AND r.r_name = 'ASIA')
""")
def permission_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").where("r_name = 'ASIA'"), F.expr("n_regionkey = r_regionkey"))
    return table(spark, sf_dir, "customer").join(roles, F.expr("c_nationkey = n_nationkey"), "left_semi").select("c_custkey")


@query("""
    SELECT r_name, coalesce(string_agg(n_name, ',' ORDER BY n_name), '') AS roles, count(n_name) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1
""")
def users_with_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.collected(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation"), F.expr("n_regionkey = r_regionkey"), ["r_name"], "n_name", "roles")


@query("""
    SELECT n_name, coalesce(string_agg(s_name, ',' ORDER BY s_name), '') AS permissions, count(s_name) AS n FROM nation
    LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON s_nationkey = n_nationkey GROUP BY 1
""")
def roles_with_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    return joins.collected(table(spark, sf_dir, "nation"), rich, F.expr("s_nationkey = n_nationkey"), ["n_name"], "s_name", "permissions")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def archived_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = table(spark, sf_dir, "labels").where("quality = 1")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(valid, "doc_id", "left_semi")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("""
    SELECT h.vec_id, d.lang, h.score FROM (SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 40) h
    JOIN documents d ON d.doc_id = h.vec_id
""")
def hits_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6)
    hits = table(spark, sf_dir, "embeddings").select("vec_id", score.alias("score")).orderBy(F.col("score").desc(), "vec_id").limit(40)
    return joins.hydrate(hits, table(spark, sf_dir, "documents").select("doc_id", "lang"), "vec_id", "doc_id").select("vec_id", "lang", "score")


@query("""
    SELECT label AS cluster_id, count(*) AS size, min(vec_id) AS repr_doc_id, coalesce(max(CASE WHEN vec_id = m THEN text END), '(No Title)') AS title
    FROM (SELECT e.*, min(vec_id) OVER (PARTITION BY label) AS m FROM embeddings e) e LEFT JOIN (SELECT * FROM documents WHERE doc_id % 2 = 0) d ON d.doc_id = e.vec_id GROUP BY 1
""")
def cluster_left_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("cluster_id")).agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("repr_doc_id"))
    titles = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", F.col("text").alias("title"))
    return joins.with_fallback(clusters, titles, "repr_doc_id", "doc_id", {"title": "(No Title)"})


@query("""
    SELECT m.label AS cluster_id, m.vec_id AS doc_id, m.pos, coalesce(d.lang, '?') AS lang FROM (
      SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM embeddings) m
    LEFT JOIN documents d ON d.doc_id = m.vec_id AND d.doc_id % 3 > 0 WHERE m.pos BETWEEN 3 AND 7
""")
def member_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    ranked = table(spark, sf_dir, "embeddings").withColumn("place", place).where("place <= 7")  # as many as the slice reaches
    clusters = ranked.groupBy(F.col("label").alias("cluster_id")).agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    docs = table(spark, sf_dir, "documents").where("doc_id % 3 > 0").select("doc_id", "lang")
    return joins.members(clusters, docs, "cluster_id", "members", "doc_id", offset=2, limit=5, fallback={"lang": "?"})


@query("""
    SELECT d.doc_id, coalesce(a.label, b.label, -1) AS cluster_id FROM documents d LEFT JOIN (SELECT vec_id, label FROM embeddings WHERE vec_id % 2 = 0) a ON a.vec_id = d.doc_id
    LEFT JOIN (SELECT vec_id, label + 100 AS label FROM embeddings) b ON b.vec_id = d.doc_id
""")
def prefer_online_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    online = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster_id"))
    offline = e.select(F.col("vec_id").alias("doc_id"), (F.col("label") + 100).alias("cluster_id"))
    return joins.preferred(table(spark, sf_dir, "documents").select("doc_id"), [online, offline], "doc_id", "cluster_id").na.fill({"cluster_id": -1})


@query("SELECT doc_id FROM documents INTERSECT SELECT vec_id FROM embeddings WHERE label < 5")
def recommended_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "embeddings").where("label < 5").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id").join(ids, "doc_id", "left_semi")


@query("""
    SELECT doc_id FROM documents WHERE doc_id % 10 = 3 AND (doc_id IN (SELECT doc_id FROM labels) OR text IN (SELECT text FROM documents WHERE doc_id % 10 <> 3))
""")
def dup_uuid_or_informant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("informant"))
    known = docs.where("doc_id % 10 <> 3")
    return joins.known_by_either(docs.where("doc_id % 10 = 3"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id", known, "informant").select("doc_id")


@query("""
    SELECT a.doc_id, b.event_type, c.n_name FROM documents a LEFT JOIN events b ON b.event_id = a.doc_id LEFT JOIN nation c ON c.n_nationkey = a.doc_id
""")
def training_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "event_type")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), "n_name")
    return table(spark, sf_dir, "documents").select("doc_id").join(events, "doc_id", "left").join(nation, "doc_id", "left")


@query("""
    SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'error'
    AND abs(epoch(a.ts) - epoch(b.ts)) <= 7200
""")
def range_proximity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    near = joins.within(e.where("event_type = 'purchase'"), e.where("event_type = 'error'"), ["user_id"], "ts", seconds=7200)
    return near.select(F.col("left.event_id").alias("a_id"), F.col("right.event_id").alias("b_id"))


@query("""
    SELECT c.event_id, n.event_id AS node_id FROM (SELECT * FROM events WHERE event_type = 'signup') c,
    LATERAL (SELECT e.event_id FROM events e WHERE e.event_type = 'purchase' AND e.user_id = c.user_id AND abs(epoch(e.ts) - epoch(c.ts)) <= 86400 * 3 ORDER BY e.event_id LIMIT 1) n
""")
def echo_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    near = joins.within(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"), ["user_id"], "ts", seconds=3 * 86400)
    return near.groupBy(F.col("left.event_id").alias("event_id")).agg(F.min("right.event_id").alias("node_id"))


@query("""
    SELECT page_id, min(src) AS source FROM (SELECT page_id, regexp_extract(url, '^\\w+://([^/?#]*)', 1) AS host FROM pages) p
    JOIN (VALUES ('example.com', 'A'), ('example.net', 'B'), ('ththre.example.com', 'C')) s(domain, src)
    ON p.host = s.domain OR (p.host LIKE '%.' || s.domain AND NOT EXISTS (SELECT 1 FROM (VALUES ('ththre.example.com')) x(d) WHERE x.d = p.host)) GROUP BY 1
""".replace("\\\\", "\\"))
def media_source_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = spark.createDataFrame([("example.com", "A"), ("example.net", "B"), ("ththre.example.com", "C")], "domain string, source string")
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^\w+://([^/?#]*)", 1).alias("host"))
    return joins.by_domain(pages, sources, "host", "domain").select("page_id", "source")


@query("""
    SELECT vec_id, max(score) AS score FROM (SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS score FROM embeddings WHERE label % 2 = 0
      UNION ALL SELECT vec_id, round(embedding[2]::DOUBLE, 6) AS score FROM embeddings WHERE label % 3 = 0) GROUP BY 1 ORDER BY score DESC, vec_id LIMIT 30
""")
def best_hit_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    one = e.where("label % 2 = 0").select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("score"))
    two = e.where("label % 3 = 0").select("vec_id", F.round(F.col("embedding")[1].cast("double"), 6).alias("score"))
    return dedup.best_of([one, two], "vec_id", "score", 30)


@query("SELECT vec_id FROM embeddings WHERE embedding[1] > 0 INTERSECT SELECT vec_id FROM embeddings WHERE embedding[2] > 0")
def hits_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.col("embedding")[0] > 0).select("vec_id").intersect(e.where(F.col("embedding")[1] > 0).select("vec_id"))


@query("SELECT doc_id AS id, lang AS label FROM documents UNION ALL SELECT vec_id, NULL FROM embeddings")
def concat_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    return docs.unionByName(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), allowMissingColumns=True)


@query("SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS p FROM documents) WHERE p = 1")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "lang", "doc_id")
    return dedup.first_wins(rows, ["source", "lang"], [F.col("doc_id")])


@query("SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", F.concat_ws(",", F.array_distinct(F.col("t.role"))).alias("roles"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def last_command_per_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.last_per_key(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT min(vec_id) FROM embeddings GROUP BY label)")
def members_without_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return e.exceptAll(e.groupBy("label").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "label"))


@query("""
    SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 6) AS used FROM events
""")
def sliding_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(second).rangeBetween(-86_400_000_000, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(w), 6).alias("used"))


@query("""
    SELECT event_id, date_trunc('hour', ts) AS hourly, CAST(date_trunc('day', ts) AS TIMESTAMP) AS daily,
           CAST(date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY AS TIMESTAMP) AS weekly, CAST(date_trunc('month', ts) AS TIMESTAMP) AS monthly FROM events
""")
def reset_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    sunday = F.date_trunc("week", ts + F.expr("INTERVAL 1 DAY")) - F.expr("INTERVAL 1 DAY")
    kinds = {"hourly": F.date_trunc("hour", ts), "daily": F.date_trunc("day", ts), "weekly": sunday, "monthly": F.date_trunc("month", ts)}
    return table(spark, sf_dir, "events").select("event_id", *[c.cast("timestamp_ntz").alias(n) for n, c in kinds.items()])


@query("""
    SELECT doc_id, count(*) OVER (PARTITION BY source) AS source_rows, rank() OVER (PARTITION BY source ORDER BY n_chars DESC) AS place,
           CAST(min(n_chars) OVER (PARTITION BY source) AS BIGINT) AS shortest FROM documents
""")
def frequency_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source")
    place = F.rank().over(w.orderBy(F.col("n_chars").desc())).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", F.count(F.lit(1)).over(w).alias("source_rows"), place.alias("place"), F.min("n_chars").over(w).alias("shortest"))
