"""Keyed merges, vector indexes and stateful streams over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ann
from ..sources import crawl, plugin
from ..sources.buckets import BucketTable
from ..sources.exports import scratch
from ..sources.tables import checkpointed
from ..streaming import followers, ingest, stateful
from .registry import query, table

ASKED = "vec_id % 20 = 0"


def _queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """All vectors, those that are searched for, and their size."""
    e = table(spark, sf_dir, "embeddings")
    size = e.where("embedding IS NOT NULL").select(F.size("embedding")).first()[0]
    return e.select("vec_id", "embedding"), e.where(ASKED).select(F.col("vec_id").alias("query_id"), "embedding"), size


@query(f"""
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(d, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (
      SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS d FROM embeddings q, embeddings v WHERE q.{ASKED}))
    WHERE rank <= 10
""")
def ivf_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's exact way: ten lists are probed, then those that the triangle inequality doesn't exclude."""
    vectors, asked, size = _queries(spark, sf_dir)
    index = ann.InvertedLists.build(vectors, scratch(spark), size)
    return index.search(asked, 10, refine=True).withColumn("score", F.round("score", 6))


@query()
def ivf_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many lists are probed as find nine tenths of the nearest rows of 64 of the queries."""
    vectors, asked, size = _queries(spark, sf_dir)
    index = ann.InvertedLists.build(vectors, scratch(spark), size)
    probes, _ = index.tuned(asked.orderBy(F.xxhash64("query_id")).limit(64), 10, target=0.92)
    return index.search(asked, 10, probes)


@query()
def hyperplane_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many changes of sides as find nine tenths of the nearest rows of 64 of the queries."""
    vectors, asked, size = _queries(spark, sf_dir)
    planes = ann.Hyperplanes(size, tables=8, bits=8)
    buckets = checkpointed(planes.buckets(vectors))
    flips, _ = planes.tuned(buckets, vectors, asked.orderBy(F.xxhash64("query_id")).limit(64), 10, target=0.92)
    return planes.search(buckets, asked, 10, flips)


@query("""
    SELECT vec_id, round(list_inner_product(v, v), 6) AS square FROM (
      SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 3 > 0 UNION ALL
      SELECT vec_id, list_transform(embedding, lambda x: 2 * x::DOUBLE) FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 5 > 0)
""")
def ivf_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that change move to other lists, rows that go leave theirs."""
    vectors, _, size = _queries(spark, sf_dir)
    index = ann.InvertedLists.build(vectors, scratch(spark), size)
    index.add(vectors.where("vec_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * 2)))
    index.remove(vectors.where("vec_id % 3 = 0 AND vec_id % 5 = 0"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return index.rows.read().select("vec_id", F.round(square, 6).alias("square"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def bucket_merge_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each user, merged batch by batch in an order that is not theirs; the first batch comes again."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    held = BucketTable(spark, scratch(spark), "user_id long, event_type string, event_id long, value double", "user_id", buckets=16)
    batches = events.withColumn("arrival", F.pmod(F.xxhash64("event_id"), F.lit(4)).cast("int"))
    ingest.drain(ingest.in_batches(batches, "arrival"), held.sink("events", order="event_id"))
    held.sink("events", order="event_id")(batches.where("arrival = 0").drop("arrival").withColumn("value", F.lit(-1.0)), 0)
    return held.read()


@query("""
    SELECT event_id, CASE event_type WHEN 'error' THEN 'E' WHEN 'purchase' THEN 'A' END AS flag, CASE WHEN event_id % 50 = 0 THEN 10.0 ELSE value END AS value FROM events WHERE event_id % 11 > 0
    UNION ALL SELECT event_id + 10000000, 'new', NULL FROM events WHERE event_id % 50 = 0
""")
def bucket_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates by condition, upserts of some columns, and deletes, as commits of one table."""
    events = table(spark, sf_dir, "events")
    held = BucketTable(spark, scratch(spark), "event_id long, event_type string, value double, flag string", "event_id", buckets=32)
    held.merge(events.select("event_id", "event_type", "value"))
    held.update(F.col("event_type") == "error", {"flag": F.lit("E")})
    held.update(F.col("event_type") == "purchase", {"flag": F.lit("A")})
    rated = events.where("event_id % 50 = 0")
    held.merge(rated.select("event_id", F.lit(10.0).alias("value")))
    held.merge(rated.select((F.col("event_id") + 10_000_000).alias("event_id"), F.lit("new").alias("flag")))
    held.merge(events.select((F.col("event_id") + 20_000_000).alias("event_id"), F.lit("x").alias("flag")), insert=False)
    held.delete(events.where("event_id % 11 = 0"))
    return held.read().select("event_id", "flag", "value")


#: A run's log from an event: it starts at the event's time and ends some hours later, or never.
_LOG = """
      SELECT user_id AS url, event_id AS run, 'start' AS kind, NULL AS status, ts FROM events
      UNION ALL SELECT user_id, event_id, 'finish', CASE event_type WHEN 'error' THEN 'TEMP_FAIL' WHEN 'purchase' THEN 'SUCCESS' ELSE 'SKIPPED' END, ts + to_hours(CAST(event_id % 9 AS INTEGER))
      FROM events WHERE event_id % 7 > 0"""


@query(f"""
    WITH log AS ({_LOG}),
      mark AS (SELECT max(ts) - INTERVAL 3 HOUR AS w FROM log),
      ended AS (
        SELECT s.url, s.run, s.ts AS started, CASE WHEN f.ts <= s.ts + INTERVAL 6 HOUR THEN f.ts ELSE s.ts + INTERVAL 6 HOUR END AS ended,
          CASE WHEN f.ts <= s.ts + INTERVAL 6 HOUR THEN f.status ELSE 'TIMEOUT' END AS status
        FROM log s LEFT JOIN log f ON s.run = f.run AND f.kind = 'finish' WHERE s.kind = 'start'),
      seen AS (SELECT ended.*, row_number() OVER (PARTITION BY url ORDER BY ended, status = 'TIMEOUT', run) AS i FROM ended, mark WHERE ended <= w),
      groups AS (SELECT *, status IN ('TEMP_FAIL', 'TIMEOUT') AS bad, count(*) FILTER (status NOT IN ('TEMP_FAIL', 'TIMEOUT')) OVER (PARTITION BY url ORDER BY i) AS g FROM seen)
    SELECT url, run, status, started, ended, CASE WHEN bad THEN count(*) FILTER (bad) OVER (PARTITION BY url, g ORDER BY i) ELSE 0 END AS retries FROM groups
""")
def stream_crawl_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with a limit of six hours, from a log of which events come up to two hours late, and some of them twice."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    start = e.select(F.col("user_id").alias("url"), F.col("event_id").alias("run"), F.lit("start").alias("kind"), F.lit(None).cast("string").alias("status"), "ts")
    status = F.when(F.col("event_type") == "error", "TEMP_FAIL").when(F.col("event_type") == "purchase", "SUCCESS").otherwise("SKIPPED")
    later = F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 9).cast("int"))
    finish = e.where("event_id % 7 > 0").select(F.col("user_id").alias("url"), F.col("event_id").alias("run"), F.lit("finish").alias("kind"), status.alias("status"), later.alias("ts"))
    log = start.unionByName(finish)
    first, last = log.agg(F.unix_timestamp(F.min("ts")), F.unix_timestamp(F.max("ts"))).first()
    share = max(1, -(-(last - first + 1) // 5))
    came = F.unix_timestamp("ts") + F.pmod(F.xxhash64("run", "kind"), F.lit(3)) * 3600  # up to two hours late
    log = log.withColumn("arrival", F.floor((came - first) / share).cast("int"))
    again = log.where("run % 5 = 0").withColumn("arrival", F.floor((came + 1800 - first) / share).cast("int"))
    out = ingest.drain(stateful.crawl_sessions(ingest.in_batches(log.unionByName(again), "arrival"), 6 * 3_600_000, "3 hours"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})


@query("SELECT count(*) FILTER (event_id % 9 = 0) AS duplicate, count(*) FILTER (event_id % 9 > 0 AND value < 5) AS low_value, count(*) FILTER (event_id % 9 > 0 AND value >= 5) AS archive, count(*) AS total FROM events")
def stream_hub_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that the routing stream itself reports, over four micro-batches."""
    events = table(spark, sf_dir, "events").select("event_id", "value", F.pmod(F.xxhash64("event_id"), F.lit(4)).cast("int").alias("arrival"))
    rows = ingest.routed(ingest.in_batches(events, "arrival"), F.col("event_id") % 9 == 0, F.col("value") < 5)
    counters = followers.HubCounters("hub")
    spark.streams.addListener(counters)
    try:
        ingest.drain(followers.counted(rows, "hub", **{r: F.col("route") == r for r in ("duplicate", "low_value", "archive")}))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(counters)
    return spark.createDataFrame([tuple(counters.totals[k] for k in ("duplicate", "low_value", "archive", "total"))], "duplicate long, low_value long, archive long, total long")


@query()
def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records are archived by one stream, whose table a second one follows and indexes; records that come again replace their
    chunks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.lit(None).cast("string").alias("brief"), "text")
    arrival = (F.col("doc_id") % 3).cast("int")
    again = docs.where("doc_id % 10 = 0").withColumn("text", F.concat(F.lit("corrected "), F.coalesce("text", F.lit(""))))
    archive, held, folder = scratch(spark), followers.chunk_table(spark, scratch(spark)), scratch(spark)
    came = docs.withColumn("arrival", arrival).unionByName(again.withColumn("arrival", F.lit(3)))
    ingest.drain(ingest.in_batches(came, "arrival"), lambda batch, number: batch.coalesce(1).write.mode("append").parquet(archive))
    embed = lambda chunks: [[float(len(c)), float(c.count(" "))] for c in chunks]  # noqa: E731 - stands in for a model
    ingest.drain(ingest.source(spark, archive, docs.schema, files=1), followers.index_sink(held, embed, folder, "index"))
    return held.read()


@query("""
    SELECT doc_id AS uuid, CASE WHEN text IS NOT NULL AND lang = 'en' THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE text END AS text, CASE WHEN text IS NOT NULL AND text <> '' AND lang = 'en' THEN 'r1' END AS revision
    FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents)
""")
def stream_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests come in three micro-batches, the last ones twice; the backlog is worked off after the stream, as one job. Upper case stands
    in for a model."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("uuid"), "text", "lang")
    archive = BucketTable(spark, scratch(spark), "uuid string, text string, lang string, revision string", "uuid", buckets=16)
    archive.merge(docs)
    asked = docs.select("uuid", F.when(F.col("lang") == "en", 0).otherwise(1).alias("priority"), F.xxhash64("uuid").alias("seq"))
    came = asked.withColumn("arrival", F.pmod(F.col("seq"), F.lit(3)).cast("int"))
    came = came.unionByName(came.where("arrival = 2").withColumn("seq", F.col("seq") + 1).withColumn("arrival", F.lit(3)))
    work = followers.Translations(spark, scratch(spark), archive, (F.col("lang") == "en") & (F.col("text") != ""), lambda f: f.assign(text=f.text.map(_upper)), "r1", fields=("text",))
    step = work.sink("requests", 200)

    def keep(batch: DataFrame, number: int) -> None:
        step(batch, number)
        archive.vacuum()  # nothing else reads it

    ingest.drain(ingest.in_batches(came, "arrival"), keep)
    work.work()
    archive.vacuum()
    return archive.read().select("uuid", "text", "revision")


def _upper(text: str) -> str:
    """A to Z in upper case."""
    return "".join(chr(ord(c) - 32) if "a" <= c <= "z" else c for c in text)


def _feed(url: str) -> str:
    """A channel's feed as a server would give it: one to three articles, and no answer for each tenth channel."""
    number = int(url.rsplit("/", 1)[1])
    if number % 10 == 0:
        raise OSError("no answer")
    items = "".join(f"<item><title>t</title><link>{url}/{i}</link><guid>{i}</guid></item>" for i in range(1 + number % 3))
    return f"<rss><channel><title>x</title>{items}</channel></rss>"


def _article(url: str) -> str:
    if url.endswith("/2"):
        raise ValueError("gone")
    return f"<html><body><article><p>text of {url}</p></article></body></html>"


@query("""
    SELECT event_type AS channel, 'http://h/' || event_id AS url, NULL AS text, 'OSError: no answer' AS error FROM events WHERE event_id % 10 = 0
    UNION ALL SELECT event_type, 'http://h/' || event_id || '/1', 'text of http://h/' || event_id || '/1', NULL FROM events WHERE event_id % 10 > 0 AND event_id % 3 >= 1
    UNION ALL SELECT event_type, 'http://h/' || event_id || '/2', NULL, 'ValueError: gone' FROM events WHERE event_id % 10 > 0 AND event_id % 3 = 2
""")
def configured_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl from a configuration by names: fetchers, discoverer, extractor, a filter of articles, and handlers that store
    what came and what failed."""
    done, failed = scratch(spark), scratch(spark)
    config = {
        "d_fetcher_name": "feeds", "e_fetcher_name": "articles", "discoverer_name": "feed", "extractor_name": "text", "article_filter": lambda url, channel: not url.endswith("/0"),
        "content_handler": lambda df: df.write.parquet(done), "exception_handler": lambda df: df.write.parquet(failed),
    }
    made, _ = crawl.from_config(config, {"feeds": _feed, "articles": _article})
    channels = table(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), F.concat(F.lit("http://h/"), F.col("event_id").cast("string")).alias("url"))
    made.run(channels)
    return spark.read.parquet(done).unionByName(spark.read.parquet(failed))


_PLUGIN = """
def latest(options):
    return int(options["items"])

def tasks(start, end, options):
    size = max(500, -(-(end - start) // 64))
    return [(i, min(i + size, end)) for i in range(start, end, size)]

def fetch(task, options):
    for i in range(*task):
        yield f"u{i}", f"http://h/{i}", "t", None if i % 4 == 0 else "c" * (i % 7), None
"""


@query("""
    SELECT 'u' || i AS uuid, 'http://h/' || i AS informant, length(repeat('c', CAST(i % 7 AS INTEGER))) AS size FROM range((SELECT count(*) FROM events)) t(i) WHERE i % 4 > 0
""")
def stream_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many items as there are events, from a plug-in that runs as a streaming source; items without content are left out."""
    plugin.register(spark)
    stream = spark.readStream.format("tidemill_crawl").options(code=_PLUGIN, items=str(table(spark, sf_dir, "events").count())).load()
    return ingest.drain(stream.where("content IS NOT NULL").select("uuid", "informant", F.char_length("content").cast("long").alias("size")))
