"""Filters, lookups, sorting and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import search
from . import mql
from .registry import query, table

#: A record of two schema generations, made of events: the first has pub1 and score1, the second pub2 and score2.
GENERATIONS = """
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ts END AS pub1, CASE WHEN event_id % 3 = 0 THEN ts END AS pub2,
           CASE WHEN event_id % 2 = 0 THEN value END AS score1, CASE WHEN event_id % 3 = 0 THEN value / 10 END AS score2 FROM events
"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0
    return _events(spark, sf_dir).select(
        "event_id",
        F.when(first, F.col("ts")).alias("pub1"),
        F.when(second, F.col("ts")).alias("pub2"),
        F.when(first, F.col("value")).alias("score1"),
        F.when(second, F.col("value") / 10).alias("score2"),
    )


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("""
    SELECT event_id, ts, score, total, row_number() OVER (ORDER BY ts DESC, event_id) AS pos FROM (
      SELECT event_id, ts, value AS score, count(*) OVER () AS total FROM events
      WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' AND value >= 40)
    ORDER BY ts DESC, event_id LIMIT 20 OFFSET 20
""")
def search_time_score_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", "ts", F.col("value").alias("score"))
    where = search.time_between("ts", "2024-01-05 00:00:00", "2024-01-20 00:00:00") & search.score_at_least(40, "score")
    return search.page(rows.where(where), order=[F.col("ts").desc(), F.col("event_id")], skip=20, limit=20)


@query("SELECT * FROM events WHERE event_id IN (3, 5, 8, 13, 21, 99999999)")
def lookup_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_ids(_events(spark, sf_dir), "event_id", [3, 5, 8, 13, 21, 99999999])


@query("SELECT * EXCLUDE (text, n_chars) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def lookup_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    return search.by_ids(_articles(spark, sf_dir), "doc_id", ids, light=["text", "n_chars"])


@query("SELECT event_id FROM events WHERE event_id = 42")
def lookup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("event_id = 42").select("event_id").limit(1)


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts <= TIMESTAMP '2024-01-11 06:00:00'")
def filter_time_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = search.time_between("ts", "2024-01-10 06:00:00", "2024-01-11 06:00:00")
    return _events(spark, sf_dir).where(where).select("event_id", "ts")


@query(f"""
    SELECT event_id FROM ({GENERATIONS}) WHERE coalesce(pub1 BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-09', false)
    OR coalesce(pub2 BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-09', false)
""")
def filter_v1_v2_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generations(spark, sf_dir).where(search.time_between_any(["pub1", "pub2"], "2024-01-03", "2024-01-09")).select("event_id")


@query(f"SELECT event_id FROM ({GENERATIONS}) WHERE coalesce(score1 >= 30, false) OR coalesce(score2 >= 30, false)")
def filter_v1_v2_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generations(spark, sf_dir).where(search.score_at_least(30, "score1", "score2")).select("event_id")


@query("SELECT doc_id FROM documents WHERE coalesce(list_has_any(string_split(lower(text), ' '), ['worthless', 'moron', 'clown']), false)")
def filter_list_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _articles(spark, sf_dir).withColumn("words", F.split(F.lower("text"), " "))
    return rows.where(search.any_of("words", ["worthless", "moron", "clown"])).select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text || chr(10) || source, '\b(?:clown|trash|src7)\b', 'i')")
def keyword_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).where(search.keywords_any("clown  trash src7", "text", "source")).select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '\bthe\b', 'i') AND regexp_matches(text, '\bof\b', 'i') AND regexp_matches(text, '\bis\b', 'i')")
def keyword_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).where(search.keywords_all("the of is", "text")).select("doc_id")


@query("""
    SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25' AND value >= 20
    AND regexp_matches(event_type, '\\b(?:click|view)\\b', 'i')
""".replace("\\\\", "\\"))
def search_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = search.time_between("ts", "2024-01-05", "2024-01-25") & search.score_at_least(20, "value") & search.keywords_any("click view", "event_type")
    return _events(spark, sf_dir).where(where).select("event_id")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND value >= 10 AND value <= 60 AND user_id IN (1, 2, 3, 5, 8, 13)")
def condition_tree_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = mql.combine({"event_type": "click", "value": {"$gte": 10, "$lte": 60}, "user_id": {"$in": [1, 2, 3, 5, 8, 13]}}, "and")
    return _events(spark, sf_dir).where(mql.compile_filter(spec)).select("event_id")


@query("SELECT event_id FROM events WHERE event_type = 'error' OR value > 150 OR (user_id < 5 AND NOT regexp_matches(event_type, '^v'))")
def condition_tree_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"$or": [{"event_type": "error"}, {"value": {"$gt": 150}}, {"$and": [{"user_id": {"$lt": 5}}, {"event_type": {"$regex": "^[^v]"}}]}]}
    return _events(spark, sf_dir).where(mql.compile_filter(spec)).select("event_id")


@query("SELECT event_id, ts FROM events WHERE event_type = 'purchase' OR user_id = 7 ORDER BY ts DESC, event_id LIMIT 15 OFFSET 5")
def common_query_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = mql.combine({"event_type": "purchase", "user_id": 7}, "or")
    rows = _events(spark, sf_dir).where(mql.compile_filter(spec)).select("event_id", "ts")
    return search.page(rows, [F.col("ts").desc(), F.col("event_id")], skip=5, limit=15).drop("pos", "total")


@query(f"SELECT event_id FROM ({GENERATIONS}) WHERE pub1 IS NULL AND pub2 IS NULL")
def exists_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generations(spark, sf_dir).where(mql.compile_filter({"pub1": {"$exists": False}, "pub2": {"$exists": False}})).select("event_id")


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 42")
def nested_flag_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("appendix", F.from_json("props", "k bigint"))
    return rows.where(mql.compile_filter({"appendix.k": 42})).select("event_id")


@query(r"SELECT doc_id FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '^\s*\S+')")
def not_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).where(search.not_blank("text")).select("doc_id")


@query("SELECT doc_id, lang, coalesce(quality, -1) AS quality, coalesce(CAST(toxic AS VARCHAR), 'N/A') AS taxonomy FROM documents LEFT JOIN labels USING (doc_id)")
def clean_nulls_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _articles(spark, sf_dir).select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce(F.col("toxic").cast("string"), F.lit("N/A")).alias("taxonomy"))


@query("""
    SELECT doc_id, len(coalesce(people, [])) AS n_people, coalesce(brief, '') AS brief FROM (
      SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN string_split(text, ' ') END AS people,
             CASE WHEN doc_id % 5 > 0 THEN text END AS brief FROM documents)
""")
def process_document_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _articles(spark, sf_dir).select(
        "doc_id",
        F.when(F.col("doc_id") % 3 > 0, F.split("text", " ")).alias("people"),
        F.when(F.col("doc_id") % 5 > 0, F.col("text")).alias("brief"),
    )
    return search.with_defaults(rows, lists=["people"], texts=["brief"]).select("doc_id", F.size("people").cast("long").alias("n_people"), "brief")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL")
def low_value_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _articles(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.where(mql.compile_filter({"quality": {"$exists": False}})).select("doc_id")


@query(r"SELECT page_id FROM pages WHERE regexp_matches(url, '^https?://(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}(?::\d+)?(?:[/?#]\S*)?$', 'i')")
def filter_valid_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(text.valid_url(F.col("url"))).select("page_id")


@query(r"SELECT doc_id FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || '龥' WHEN 1 THEN '龦 ' || text WHEN 2 THEN '一' || text ELSE text END AS t FROM documents) WHERE regexp_matches(t, '[\x{4e00}-\x{9fa5}]')")
def filter_contains_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, body = F.col("doc_id") % 4, F.col("text")
    t = F.when(n == 0, F.concat(body, F.lit("龥"))).when(n == 1, F.concat(F.lit("龦 "), body)).when(n == 2, F.concat(F.lit("一"), body)).otherwise(body)
    return _articles(spark, sf_dir).withColumn("t", t).where(F.rlike("t", F.lit(r"[一-龥]"))).select("doc_id")


@query("""
    SELECT event_id, coalesce(CASE WHEN v IN ('true', '1', 'yes', 'y', 'on') THEN true WHEN v IN ('false', '0', 'no', 'n', 'off') THEN false END, false) AS flag,
           array_to_string(list_filter(list_transform(string_split(csv, ','), lambda x: trim(x)), lambda x: x <> ''), '+') AS items
    FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'no' WHEN 2 THEN '1' WHEN 3 THEN 'maybe' ELSE 'on' END AS v,
                 ' ' || event_type || ' ,, ' || CAST(user_id AS VARCHAR) AS csv FROM events)
""")
def request_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 5
    rows = _events(spark, sf_dir).select(
        "event_id",
        F.when(n == 0, "true").when(n == 1, "no").when(n == 2, "1").when(n == 3, "maybe").otherwise("on").alias("v"),
        F.concat(F.lit(" "), "event_type", F.lit(" ,, "), F.col("user_id").cast("string")).alias("csv"),
    )
    return rows.select("event_id", search.coerce_bool(F.col("v")).alias("flag"), F.concat_ws("+", search.split_list(F.col("csv"))).alias("items"))


@query("""
    SELECT page_id, parent || '/' || file AS channel FROM (
      SELECT page_id, coalesce(nullif(regexp_extract(url, '^\\w+://[^/]+/([^/?#]+)/[^/?#]+', 1), ''), '') AS parent,
             coalesce(nullif(regexp_extract(url, '^\\w+://[^/]+/(?:[^/?#]+/)?([^/?#]+)', 1), ''), '') AS file FROM pages)
    WHERE parent IN ('en', 'fr')
""".replace("\\\\", "\\"))
def channel_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("url", r"^\w+://[^/]+/([^/?#]+)/[^/?#]+", 1).alias("parent"),
        F.regexp_extract("url", r"^\w+://[^/]+/(?:[^/?#]+/)?([^/?#]+)", 1).alias("file"),
    )
    return rows.where(F.col("parent").isin("en", "fr")).select("page_id", F.concat_ws("/", "parent", "file").alias("channel"))


@query("""
    SELECT event_id FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'not a date' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS lastmod FROM events)
    WHERE coalesce(TRY_CAST(lastmod AS TIMESTAMP) BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-16', true)
""")
def lastmod_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 4
    rows = _events(spark, sf_dir).select("event_id", F.when(n == 1, "not a date").when(n > 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("lastmod"))
    return rows.where(search.lastmod_in_range(F.col("lastmod"), "2024-01-08", "2024-01-16")).select("event_id")


@query("""
    SELECT event_id FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'https://a.b/sitemap-' || strftime(ts, '%Y-%m-%d') || '.xml' WHEN 1 THEN 'https://a.b/sitemap-2024.xml'
      WHEN 2 THEN 'https://a.b/sitemap-2023.xml' ELSE 'https://a.b/map.xml' END AS url FROM events)
    WHERE CASE WHEN regexp_matches(url, '\\d{4}-\\d{2}-\\d{2}') THEN CAST(regexp_extract(url, '(\\d{4}-\\d{2}-\\d{2})', 1) AS TIMESTAMP) BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-16'
      WHEN regexp_matches(url, '2023\\.xml') THEN false ELSE true END
""".replace("\\\\", "\\"))
def url_date_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 4
    url = F.when(n == 0, F.concat(F.lit("https://a.b/sitemap-"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".xml")))
    url = url.when(n == 1, "https://a.b/sitemap-2024.xml").when(n == 2, "https://a.b/sitemap-2023.xml").otherwise("https://a.b/map.xml")
    rows = _events(spark, sf_dir).select("event_id", url.alias("url"))
    return rows.where(search.url_date_in_range(F.col("url"), "2024-01-08", "2024-01-16")).select("event_id")


@query("SELECT event_id, ts FROM events WHERE user_id = 9 AND event_type = 'view' AND ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-28' ORDER BY ts DESC, event_id LIMIT 10")
def login_log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"user_id": 9, "event_type": "view", "source": None}
    where = mql.compile_filter({k: v for k, v in wanted.items() if v is not None}) & search.time_between("ts", "2024-01-02", "2024-01-28")
    return search.page(_events(spark, sf_dir).where(where).select("event_id", "ts"), [F.col("ts").desc(), F.col("event_id")], limit=10).drop("pos", "total")


@query("SELECT count(*) AS total, arg_max(event_id, (ts, event_id)) AS newest_id, epoch_us(max(ts)) / 1e6 AS newest_epoch FROM events")
def summary_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.newest(_events(spark, sf_dir), "ts", "event_id")


@query("SELECT event_id, CAST(user_id AS VARCHAR) || ':' || event_type AS tag FROM events WHERE value > 100 ORDER BY event_id LIMIT 25")
def cached_filter_map_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).where("value > 100").orderBy("event_id").limit(25)
    return rows.select("event_id", F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("tag"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def top_informants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_counts(_events(spark, sf_dir), "user_id", 10)


@query("""
    SELECT event_id, ts, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS p FROM events) WHERE p = 1
""")
def best_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", "ts", "user_id", "value")
    return search.first_per_group(rows, ["user_id"], [F.col("value").desc(), F.col("event_id")]).drop("value")


@query("SELECT event_id, ts, value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR ORDER BY ts DESC, event_id LIMIT 50")
def recent_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", "ts", "value")
    last = F.broadcast(rows.agg(F.max("ts").alias("last")))  # one row
    return rows.join(last, F.col("ts") >= F.col("last") - F.expr("INTERVAL 48 HOURS")).drop("last").orderBy(F.col("ts").desc(), "event_id").limit(50)


@query("SELECT count(*) AS n_rows, CAST(ceil(count(*) / 100.0) AS BIGINT) AS n_pages FROM events")
def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"), F.ceil(F.count(F.lit(1)) / 100).alias("n_pages"))
