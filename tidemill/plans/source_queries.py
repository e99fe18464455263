"""Tables, exports, imports, feeds and sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from ..sources import exports, feeds, tables
from .registry import query, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("SELECT event_id, value FROM events WHERE event_type = 'purchase' ORDER BY value DESC, event_id LIMIT 30")
def collection_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan(spark, f"{sf_dir}/events.parquet", F.col("event_type") == "purchase", ["event_id", "value"], [F.col("value").desc(), F.col("event_id")], 30)


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'E' END AS flag, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS value FROM events")
def update_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", "event_type", "value")
    return tables.set_where(rows, F.col("event_type") == "error", {"flag": F.lit("E"), "value": F.lit(0.0)}).select("event_id", "flag", "value")


@query("SELECT count(*) AS matched, count(*) FILTER (value <> 0.0) AS modified FROM events WHERE event_type = 'error'")
def update_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.update_counts(_events(spark, sf_dir), F.col("event_type") == "error", {"value": F.lit(0.0)})


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 10.0 ELSE value END AS rating FROM events")
def manual_rating_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", F.col("value").alias("rating"))
    return tables.upsert(rows, rows.where("event_id % 10 = 0").withColumn("rating", F.lit(10.0)), "event_id")


@query("SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS label FROM embeddings WHERE vec_id % 11 <> 0")
def vector_replace_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    new = rows.where("vec_id % 7 = 0").withColumn("label", F.lit(-1))
    return tables.delete(tables.upsert(rows, new, "vec_id"), rows.where("vec_id % 11 = 0").select("vec_id"), "vec_id")


@query("SELECT event_id FROM events WHERE user_id % 3 > 0 AND event_id % 5 > 0")
def load_unarchived(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", F.when(F.col("user_id") % 3 == 0, "A").alias("flag_old"), F.when(F.col("event_id") % 5 == 0, "D").alias("flag_new"))
    return rows.where("flag_old IS NULL AND flag_new IS NULL").select("event_id")


@query("SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'")
def export_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = exports.week_bounds(2024, 2)
    path = exports.scratch(spark)
    exports.export(_events(spark, sf_dir).where(exports.in_range(F.col("ts"), start, end)), path, "json", ["event_id", "value"])
    return exports.import_json(spark, path, "event_id long, value double")


@query("SELECT event_id FROM events WHERE epoch_us(ts) / 1e6 >= 1704672000 AND epoch_us(ts) / 1e6 < 1705276800")
def export_epoch_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("epoch"))
    return rows.where(exports.in_range(F.col("epoch"), "2024-01-08", "2024-01-15", epoch_seconds=True)).select("event_id")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS bucket, count(*) AS n FROM orders GROUP BY 1")
def export_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = exports.scratch(spark)
    exports.export(table(spark, sf_dir, "orders"), path, "parquet", ["o_orderkey"], "month", "o_orderdate")
    rows = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", False).parquet(path)
    return rows.groupBy(F.date_format(F.col("bucket").cast("string").cast("date"), "yyyy-MM").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(ts, '%G-W%V') AS bucket, count(*) AS n FROM events GROUP BY 1")
def export_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = exports.scratch(spark)
    exports.export(_events(spark, sf_dir), path, "json", ["event_id"], "week", "ts")
    return spark.read.schema("event_id long, bucket string").json(path).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0")
def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = exports.scratch(spark)
    exports.export(table(spark, sf_dir, "customer").where("c_acctbal > 0"), path, "csv", ["c_custkey", "c_name"])
    return spark.read.option("header", True).schema("c_custkey long, c_name string").csv(path)


@query("SELECT count(*) AS n, date_trunc('second', min(ts)) AS first, date_trunc('second', max(ts)) AS last FROM events")
def json_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    n = F.col("event_id") % 3
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raw = F.when(n == 0, iso).when(n == 1, F.concat(F.lit('{"$date": "'), iso, F.lit('"}'))).otherwise(F.format_string('{"$date": %d}', F.unix_seconds(ts) * 1000))
    out = exports.profile(_events(spark, sf_dir).select(raw.alias("t")), F.col("t"))
    return out.select("n", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"))


@query("SELECT doc_id, sha256(text) AS checksum FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS p FROM documents) WHERE p = 1")
def content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("url"), "text", "doc_id")
    return exports.content_store(pages, "url", "text", "doc_id").select("doc_id", "checksum")


@query("SELECT event_id // 40 AS feed, count(*) AS n_entries, min(CAST(event_id AS VARCHAR)) AS first_guid, 'a & b' AS description FROM events GROUP BY 1")
def feed_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat(F.lit("<item><title>t</title><guid>"), F.col("event_id").cast("string"), F.lit("</guid><description>&lt;p&gt;a &amp;amp; b&lt;/p&gt;</description></item>"))
    rows = _events(spark, sf_dir).groupBy(F.floor(F.col("event_id") / 40).alias("feed")).agg(F.array_join(F.collect_list(item), "").alias("items"))
    xml = F.concat(F.lit("<rss><channel><title>x</title>"), "items", F.lit("</channel></rss>"))
    parsed = rows.select("feed", feeds.feed(xml).alias("f"))
    entries = parsed.select("feed", F.explode("f.entries").alias("e"))
    return entries.groupBy("feed").agg(F.count(F.lit(1)).alias("n_entries"), F.min("e.guid").alias("first_guid"), F.min("e.description").alias("description"))


@query("""
    SELECT CAST(doc_id AS VARCHAR) AS guid, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS title, CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '1970-01-01' ELSE TIMESTAMP '2024-01-02' END AS date,
           'https://a.b/' || lang AS link FROM documents WHERE doc_id % 4 > 0
""")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    articles = table(spark, sf_dir, "documents").select(
        F.when(k % 3 == 0, "").otherwise(F.col("source")).alias("title"),
        F.when(k % 4 > 0, F.col("lang")).alias("brief"),
        k.cast("string").alias("uuid"),
        F.when(k % 5 > 0, F.lit("2024-01-02").cast("timestamp_ntz")).alias("published"),
        feeds.join_url(F.lit("https://a.b/"), F.concat(F.lit("/"), "lang")).alias("link"),
    )
    return feeds.feed_items(articles).select("guid", "title", "date", "link")


@query("SELECT event_id AS id, 'https://a.b/' || CAST(event_id AS VARCHAR) AS loc, strftime(ts, '%Y-%m-%d') AS lastmod FROM events")
def sitemap_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = F.concat(
        F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://a.b/'), F.col("event_id").cast("string"), F.lit("</loc><lastmod>"),
        F.date_format("ts", "yyyy-MM-dd"), F.lit("</lastmod></url></urlset>"),
    )
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("id"), feeds.sitemap(xml).alias("m"))
    return rows.select("id", F.explode("m.urls").alias("u")).select("id", "u.loc", "u.lastmod")


@query("SELECT CASE event_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'valid' ELSE 'invalid' END AS status, count(*) AS n FROM events GROUP BY 1")
def feed_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 4
    rows = _events(spark, sf_dir).select(feeds.validity(F.when(n == 1, "<rss>").otherwise("<p>"), n > 0).alias("status"))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 20")
def feed_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", "ts")
    return search.page(rows, [F.col("ts").desc(), F.col("event_id")], limit=20).select("event_id")


@query("SELECT page_id AS uuid, url AS informant, 'crawler' AS source, length(html) AS size FROM pages")
def crawl_result_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    return rows.select(F.col("page_id").alias("uuid"), F.col("url").alias("informant"), F.lit("crawler").alias("source"), F.char_length("html").cast("long").alias("size"))


@query("SELECT event_id, ts - INTERVAL 8 HOUR AS ts FROM events UNION ALL SELECT event_id + 1000000, ts - INTERVAL 8 HOUR FROM events WHERE event_type = 'error'")
def insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = exports.scratch(spark), _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    tables.append(rows.select("event_id", "ts"), path, ["ts"], "Asia/Shanghai")
    tables.append(rows.where("event_type = 'error'").select((F.col("event_id") + 1_000_000).alias("event_id"), "ts"), path, ["ts"], "Asia/Shanghai")
    return spark.read.parquet(path).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("""
    SELECT 'archive' AS name, event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09'
    UNION ALL SELECT 'cache', o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2024-01-05' AND o_orderdate < TIMESTAMP '2024-01-09'
""")
def export_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {"archive": (_events(spark, sf_dir).select("ts", F.col("event_id").alias("id")), "ts"), "cache": (table(spark, sf_dir, "orders").select("o_orderdate", F.col("o_orderkey").alias("id")), "o_orderdate")}
    paths = exports.export_request(known, exports.scratch(spark), "all", "range", "2024-01-05", "2024-01-09")
    parts = [exports.import_json(spark, path, "id long").select(F.lit(name).alias("name"), "id") for name, path in zip(known, paths)]
    return parts[0].unionByName(parts[1])


@query("SELECT event_id, event_type, value FROM events UNION ALL SELECT event_id, event_type, value FROM events")
def import_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through arrays of a record a line, and through lines."""
    rows, out = _events(spark, sf_dir), []
    for kind in ("json_array", "json"):
        path = exports.scratch(spark)
        exports.export(rows, path, kind, ["event_id", "event_type", "value"])
        out.append(exports.import_json(spark, path, "event_id long, event_type string, value double"))
    return out[0].unionByName(out[1])
