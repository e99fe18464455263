"""Streams, run until their source is empty, and the batch rules that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.exports import scratch
from ..streaming import ingest, stateful
from .registry import query, table


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.source(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT DISTINCT user_id, event_type FROM events WHERE value > 0")
def stream_ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.collected(_stream(spark, sf_dir), F.col("value") > 0, ["user_id", "event_type"], "ts", late="60 days")
    return ingest.drain(rows.select("user_id", "event_type"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return ingest.drain(rows.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n"), mode="complete")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def stream_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    rows = _stream(spark, sf_dir).select("user_id", "event_id", "event_type")
    ingest.drain(rows, ingest.latest_table(folder, "user_id", "event_id", every=16))
    return ingest.latest_version(spark, folder, "user_id long, event_id long, event_type string", "user_id", "event_id")


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'duplicate' WHEN value < 5 THEN 'low_value' ELSE 'archive' END AS route FROM events")
def stream_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    ingest.drain(_stream(spark, sf_dir).select("event_id", "value"), ingest.route_to(folder, F.col("event_id") % 9 == 0, F.col("value") < 5))
    parts = [spark.read.schema("event_id long, route string").parquet(f"{folder}/{r}") for r in ("duplicate", "low_value", "archive")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("event_id", "route")


@query("""
    WITH RECURSIVE e AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS i FROM events),
      r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(t TIMESTAMP, a DOUBLE)[]) AS held, CAST(NULL AS BOOLEAN) AS fits FROM events
        UNION ALL SELECT user_id, i, CASE WHEN fits THEN list_append(kept, {'t': CAST(ts AS TIMESTAMP), 'a': CAST(value AS DOUBLE)}) ELSE kept END, fits
        FROM (SELECT *, coalesce(list_sum(list_transform(kept, lambda h: h.a)), 0) + value <= 120 AS fits
          FROM (SELECT e.*, list_filter(r.held, lambda h: h.t > e.ts - INTERVAL 24 HOUR) AS kept FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)))
    SELECT user_id, count(*) FILTER (fits) AS admitted, count(*) FILTER (NOT fits) AS refused FROM r WHERE i > 0 GROUP BY 1
""")
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.drain(ingest.limited(_stream(spark, sf_dir), "user_id", "ts", "value", 120.0, 86400))
    return out.groupBy("user_id").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("refused"))


@query()
def stream_online_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.source(spark, f"{sf_dir}/embeddings.parquet", table(spark, sf_dir, "embeddings").schema)
    out = ingest.drain(stateful.online_clusters(rows, "label", "vec_id", "embedding", event=0.5))
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


@query("""
    SELECT event_id AS uuid, CASE WHEN event_type = 'error' THEN NULL ELSE upper(event_type) END AS result, event_type = 'error' AS failed FROM events
""")
def stream_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    def analyse(content: str) -> str:
        if content == "error":
            raise ValueError("no answer")
        return content.upper()

    rows = _stream(spark, sf_dir).select(F.col("event_id").alias("uuid"), F.col("event_type").alias("content"))
    out = ingest.drain(ingest.analysed(rows, analyse, "uuid long, content string"))
    return out.select("uuid", "result", F.col("error").isNotNull().alias("failed"))


@query("""
    SELECT u.url, s.state IS NULL OR (s.state <> 'RUNNING' AND s.next_run <= TIMESTAMP '2024-01-15' AND s.state NOT IN ('SUCCESS', 'IGNORED') AND s.retries < 3) AS crawl
    FROM (SELECT event_id AS url FROM events) u LEFT JOIN (SELECT event_id AS url, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'RUNNING' ELSE 'SUCCESS' END AS state,
      ts AS next_run, user_id % 5 AS retries FROM events WHERE event_id % 3 > 0) s USING (url)
""")
def crawl_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "RUNNING").otherwise("SUCCESS")
    status = e.where("event_id % 3 > 0").select(F.col("event_id").alias("url"), state.alias("state"), F.col("ts").alias("next_run"), (F.col("user_id") % 5).alias("retries"))
    return ingest.should_crawl(e.select(F.col("event_id").alias("url")), status, F.lit("2024-01-15").cast("timestamp_ntz"))


@query("""
    SELECT user_id, count(*) FILTER (event_type = 'error' AND event_id > coalesce(c, -1)) AS errors FROM (
      SELECT *, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS c FROM events) GROUP BY 1
""")
def error_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return ingest.error_counts(e, "user_id", "event_id", F.col("event_type") == "error", F.col("event_type") == "purchase")


@query("""
    SELECT user_id AS url, arg_max(CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'SUCCESS' ELSE 'RUNNING' END, event_id) AS state, arg_max(ts, event_id) AS since,
           count(*) FILTER (event_type = 'error' AND event_id > coalesce(c, -1)) AS retries FROM (
      SELECT *, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS c FROM events) GROUP BY 1
""")
def crawl_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "SUCCESS").otherwise("RUNNING")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("url"), F.col("event_id").alias("seq"), state.alias("state"), "ts")
    return ingest.session_states(log)


@query("""
    SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s
""")
def debounced_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.bursts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "2 hours")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT n_name AS name, coalesce(s, 'run') AS signal FROM nation LEFT JOIN (SELECT n, arg_max(event_type, event_id) AS s FROM (SELECT *, user_id % 20 AS n FROM events) GROUP BY 1) ON n = n_nationkey")
def group_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("n_nationkey"), F.col("event_id").alias("seq"), F.col("event_type").alias("signal"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    return ingest.group_control(n.select("name"), n.join(e, "n_nationkey").select("name", "seq", "signal"))


@query("SELECT event_id, event_id % 3 = 0 AS stays FROM events WHERE event_type = 'error'")
def dead_letter_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id")
    done, stays = ingest.replayed(failed, lambda rows: rows.withColumn("ok", F.col("event_id") % 3 > 0), "event_id")
    return done.withColumn("stays", F.lit(False)).unionByName(stays.withColumn("stays", F.lit(True)))


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def trailing_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.trailing_window(table(spark, sf_dir, "events"), "ts", "2024-06-01").select("event_id")


@query("SELECT event_id, CASE WHEN value >= 50 THEN 'stuck' WHEN value >= 5 THEN 'very_slow' WHEN value >= 0.5 THEN 'slow' ELSE 'ok' END AS level FROM events")
def slow_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", ingest.slow_level(F.col("value")).alias("level"))


@query("SELECT event_id, priority FROM (SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-29' THEN 0 ELSE 1 END AS priority FROM events) ORDER BY priority, event_id LIMIT 400")
def priority_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    new = F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz")
    return ingest.by_priority(e.where(new), e.where(~new), "event_id", 400).select("event_id", "priority")


@query("SELECT event_id FROM events WHERE event_id % 4 = 0 ORDER BY ts DESC, event_id LIMIT 200")
def translation_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("revision", F.when(F.col("event_id") % 4 > 0, 1))
    return rows.where("revision IS NULL").orderBy(F.col("ts").desc(), "event_id").limit(200).select("event_id")
