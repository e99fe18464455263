"""Aggregations, duplicate reports and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import score
from ..operators import dedup, stats
from . import mql
from .registry import query, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("""
    SELECT CAST(g.s AS INTEGER) AS score, count(e.event_id) AS n FROM generate_series(1, 10) g(s)
    LEFT JOIN (SELECT event_id, 1 + CAST(floor(value) AS BIGINT) % 10 AS s FROM events) e ON e.s = g.s GROUP BY 1
""")
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select((1 + F.floor("value") % 10).alias("bucket"))
    return stats.histogram(rows, F.col("bucket"), 1, 10)


@query("SELECT year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def stats_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_time(_events(spark, sf_dir), "ts", "hour")


@query("""
    SELECT year(t) AS year, month(t) AS month, day(t) AS day, hour(t) AS hour, count(*) AS n
    FROM (SELECT ts + INTERVAL 8 HOUR AS t FROM events) GROUP BY ALL
""")
def stats_hourly_tz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_time(_events(spark, sf_dir), "ts", "hour", zone="Asia/Shanghai")


@query("SELECT year(ts) AS year, month(ts) AS month, day(ts) AS day, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' GROUP BY ALL")
def stats_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_time(_events(spark, sf_dir).where("ts BETWEEN TIMESTAMP_NTZ '2024-01-03' AND TIMESTAMP_NTZ '2024-01-20'"), "ts", "day")


@query("SELECT year(o_orderdate) AS year, CAST(strftime(o_orderdate, '%U') AS INTEGER) AS week, count(*) AS n FROM orders GROUP BY ALL")
def stats_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_time(table(spark, sf_dir, "orders"), "o_orderdate", "week")


@query("SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n FROM orders GROUP BY ALL")
def stats_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_time(table(spark, sf_dir, "orders"), "o_orderdate", "month")


@query("SELECT user_id, n, CAST(sum(n) OVER () AS BIGINT) AS total FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, user_id LIMIT 10")
def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(_events(spark, sf_dir), "user_id", 10)


@query("SELECT event_type AS _id, round(sum(value), 6) AS total FROM events GROUP BY 1")
def sum_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mql.aggregate(_events(spark, sf_dir), [{"$group": {"_id": "$event_type", "total": {"$sum": "$value"}}}, {"$sort": {"_id": 1}}])
    return out.withColumn("total", F.round("total", 6))


@query("SELECT count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-11' AND event_type <> 'view'")
def count_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).where(F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz")).where(mql.compile_filter({"event_type": {"$ne": "view"}}))
    return rows.agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT event_type AS type, month(ts) AS month, count(*) AS n FROM events WHERE value >= 10 AND event_type IN ('click', 'view', 'error')
    GROUP BY ALL ORDER BY n DESC, type LIMIT 5
""")
def mql_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipeline = [
        {"$match": {"$and": [{"value": {"$gte": 10}}, {"event_type": {"$in": ["click", "view", "error"]}}]}},
        {"$group": {"_id": {"type": "$event_type", "month": {"$month": {"date": "$ts", "timezone": "UTC"}}}, "n": {"$sum": 1}}},
        {"$sort": {"n": -1, "_id.type": 1}},
        {"$limit": 5},
    ]
    return mql.aggregate(_events(spark, sf_dir), pipeline)


@query("""
    SELECT word AS _id, count(*) AS n FROM (SELECT unnest(list_concat(string_split(event_type, '_'), coalesce(CASE WHEN user_id % 2 = 0 THEN ['even'] END, []))) AS word FROM events)
    GROUP BY 1
""")
def mql_unwind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(
        F.split("event_type", "_").alias("a"), F.when(F.col("user_id") % 2 == 0, F.array(F.lit("even"))).alias("b"), F.array().cast("array<string>").alias("none")
    )
    pipeline = [
        {"$project": {"words": {"$concatArrays": ["$a", {"$ifNull": ["$b", "$none"]}]}}},
        {"$unwind": "$words"},
        {"$group": {"_id": "$words", "n": {"$sum": 1}}},
    ]
    return mql.aggregate(rows, pipeline)


@query("SELECT sha256(text) AS key, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents WHERE text <> '' GROUP BY text HAVING count(*) > 1")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.groups(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")


@query("SELECT sha256(text) AS key, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents WHERE text <> '' GROUP BY text HAVING count(*) > 1")
def dup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.group_members(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")
    return found.select("key", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"))


@query("""
    SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS documents, CAST(coalesce(sum(n), 0) - count(*) AS BIGINT) AS redundant
    FROM (SELECT count(*) AS n FROM documents WHERE text <> '' GROUP BY text HAVING count(*) > 1)
""")
def dup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.report(dedup.groups(table(spark, sf_dir, "documents"), F.col("text"), "doc_id"))


@query("SELECT doc_id, keep_id FROM (SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id FROM documents WHERE text <> '') WHERE doc_id <> keep_id")
def dedup_keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.redundant(table(spark, sf_dir, "documents"), F.col("text"), "doc_id", "newest")


@query("SELECT doc_id, keep_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id FROM documents WHERE text <> '') WHERE doc_id <> keep_id")
def dedup_keep_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.redundant(table(spark, sf_dir, "documents"), F.col("text"), "doc_id", "oldest")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, greatest(a, b, d) AS score, CASE greatest(a, b, d) WHEN a THEN 'action' WHEN b THEN 'breadth' ELSE 'depth' END AS key FROM (
      SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_suppkey % 11 AS DOUBLE) AS a, CAST(l_partkey % 11 AS DOUBLE) AS b, CAST(CAST(l_quantity AS BIGINT) % 11 AS DOUBLE) AS d FROM lineitem)
""")
def argmax_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = F.create_map(
        F.lit("depth"), (F.col("l_quantity").cast("long") % 11).cast("double"), F.lit("breadth"), (F.col("l_partkey") % 11).cast("double"),
        F.lit("action"), (F.col("l_suppkey") % 11).cast("double"), F.lit("opinion"), F.lit(99.0),
    )
    best = score.argmax(rates, without=["opinion"])
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", best.alias("best"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "best.score", "best.key")


@query("""
    SELECT doc_id, round((CASE WHEN hi > lo THEN (n_chars - lo) / CAST(hi - lo AS DOUBLE) ELSE 1 END + 0.1) / n, 9) AS weight FROM (
      SELECT doc_id, n_chars, count(*) OVER (PARTITION BY source) AS n, min(n_chars) OVER () AS lo, max(n_chars) OVER () AS hi FROM documents)
""")
def domain_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.inverse_frequency(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "n_chars")
    return rows.select("doc_id", F.round("weight", 9).alias("weight"))


@query("""
    SELECT count(DISTINCT user_id) AS spiders, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS success_rate, count(*) AS total,
           count(*) FILTER (event_type = 'error' AND ts >= TIMESTAMP '2024-01-29') AS failed_today FROM events
""")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)
    today = (F.col("event_type") == "error") & (F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz"))
    return _events(spark, sf_dir).agg(
        F.countDistinct("user_id").alias("spiders"), F.round(F.avg(ok), 6).alias("success_rate"), F.count(F.lit(1)).alias("total"), F.count_if(today).alias("failed_today")
    )


@query("SELECT event_type, min(ts) AS next_run FROM events GROUP BY 1")
def earliest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(F.min("ts").alias("next_run"))


@query("""
    SELECT coalesce(event_type || coalesce('/' || CAST(u AS VARCHAR), ''), '') AS prefix,
           CAST((event_type IS NOT NULL)::INT + (u IS NOT NULL)::INT AS INTEGER) AS depth, count(*) AS n
    FROM (SELECT event_type, user_id % 10 AS u FROM events) GROUP BY ROLLUP (event_type, u)
""")
def namespace_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy("event_type", (F.col("user_id") % 10).alias("u")).agg(F.count(F.lit(1)).alias("n"))
    return stats.prefix_rollup(rows, F.array("event_type", F.col("u").cast("string")), "n")


@query("SELECT DISTINCT CAST(user_id % 10 AS VARCHAR) AS child FROM events WHERE event_type = 'error'")
def namespace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.array("event_type", (F.col("user_id") % 10).cast("string")).alias("path"))
    return stats.children(rows, F.col("path"), ["error"])


@query("SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p <= 3")
def newest_n_per_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_type", "user_id", "event_id", "ts")
    return stats.latest_per_namespace(rows, ["event_type", "user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 3).drop("ts")


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type <> 'error') AS done, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def runtime_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("event_type") == "error"
    return _events(spark, sf_dir).groupBy("user_id").agg(
        F.count_if(error).alias("failed"), F.count_if(~error).alias("done"), F.round(F.avg("value"), 6).alias("mean_value")
    )


@query("SELECT source, round(avg(CASE WHEN s <> -1 THEN s END), 6) AS mean_score FROM (SELECT source, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE n_chars % 11 END AS s FROM documents) GROUP BY 1")
def judge_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.col("doc_id") % 7 == 0, -1).otherwise(F.col("n_chars") % 11)
    rows = table(spark, sf_dir, "documents").select("source", s.alias("s"))
    return rows.groupBy("source").agg(F.round(F.avg(F.when(F.col("s") != -1, F.col("s"))), 6).alias("mean_score"))


@query("SELECT round(count(*) / CAST(count(DISTINCT CAST(ts AS DATE)) AS DOUBLE), 1) AS per_day FROM events")
def per_day_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.agg(F.round(F.sum("n") / F.count(F.lit(1)), 1).alias("per_day"))


@query("""
    SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l.quality IS NULL THEN 'cross_check' WHEN l.quality = 0 THEN 'dropped' WHEN d.n_chars < 200 THEN 'short'
      WHEN NOT regexp_matches(d.text, '\\bthe\\b', 'i') THEN 'language' ELSE 'kept' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1
""".replace("\\\\", "\\"))
def funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    reasons = {"cross_check": F.col("quality").isNull(), "dropped": F.col("quality") == 0, "short": F.col("n_chars") < 200, "language": ~F.rlike("text", F.lit(r"(?i)\bthe\b"))}
    return stats.funnel(rows, reasons)


@query("SELECT count(DISTINCT source) AS n_sources, count(*) AS n_documents, CAST(sum(CAST(ceil(greatest(n_chars, 1) / 512.0) AS BIGINT)) AS BIGINT) AS n_chunks FROM documents")
def document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = F.ceil(F.greatest("n_chars", F.lit(1)) / 512)
    return table(spark, sf_dir, "documents").agg(F.countDistinct("source").alias("n_sources"), F.count(F.lit(1)).alias("n_documents"), F.sum(chunks).alias("n_chunks"))


@query("""
    SELECT informant, count(*) AS n FROM (SELECT unnest([user_id, user_id % 13]) AS informant FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15')
    GROUP BY 1 ORDER BY n DESC, informant LIMIT 12
""")
def recommended_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).where("ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-15'")
    ids = rows.select(F.explode(F.array("user_id", F.col("user_id") % 13)).alias("informant"))
    return ids.groupBy("informant").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "informant").limit(12)


@query("""
    SELECT count(*) FILTER (event_type = 'signup') AS waiting_process, count(*) FILTER (event_type = 'view') AS archived, count(*) FILTER (event_type = 'click') AS dropped,
           count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'other') AS conversation_warning, count(*) AS total FROM events
""")
def hub_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"signup": "waiting_process", "view": "archived", "click": "dropped", "error": "error", "other": "conversation_warning"}
    state = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("event_type")]
    return stats.hub_counters(table(spark, sf_dir, "events"), state, list(names.values()))
