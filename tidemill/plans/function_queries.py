"""Scalar functions over texts, times, scores, lists and JSON."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, nested, score, text
from ..operators import search
from . import mql
from .registry import query, table

THINK = "'<think>plan ' || source || '</think> answer ' || CAST(doc_id AS VARCHAR) || ' &lt;analysis&gt;x&lt;/analysis&gt;'"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query(r"""
    SELECT doc_id, round(len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) / CAST(greatest(1, length(text)) AS DOUBLE), 9) AS cjk,
           round(len(regexp_extract_all(text, '[A-Za-z]')) / CAST(greatest(1, length(text)) AS DOUBLE), 9) AS latin FROM documents
""")
def cjk_ascii_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(
        "doc_id", F.round(text.share(F.col("text"), text.CJK), 9).alias("cjk"), F.round(text.share(F.col("text"), text.LATIN), 9).alias("latin")
    )


@query(r"""
    SELECT doc_id FROM (SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z]')) / CAST(greatest(1, length(t)) AS DOUBLE) AS latin, length(t) AS n,
        len(regexp_extract_all(t, '[\x{4e00}-\x{9fff}]')) / CAST(greatest(1, length(t)) AS DOUBLE) AS cjk
      FROM (SELECT doc_id, unnest([trim(text), trim(lang)]) AS t FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id, trim(repeat('中', 2 * length(text)) || text) FROM documents WHERE doc_id % 3 = 0))
    GROUP BY 1 HAVING bool_or(CASE WHEN n < 12 THEN latin > 0.2 AND cjk < 0.05 ELSE latin > 0.12 AND cjk < 0.18 END)
""")
def needs_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.col("doc_id") % 3 > 0
    body = F.when(other, F.col("text")).otherwise(F.concat(F.repeat(F.lit("中"), 2 * F.char_length("text")), "text"))
    return _docs(spark, sf_dir).where(text.any_foreign(body, F.when(other, F.col("lang")))).select("doc_id")


@query("SELECT doc_id, 'answer ' || CAST(doc_id AS VARCHAR) AS answer, 'plain ' || source AS pure FROM documents")
def strip_think(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("<think>plan "), "source", F.lit("</think> answer "), F.col("doc_id").cast("string"), F.lit(" &lt;analysis&gt;x&lt;/analysis&gt;"))
    other = F.concat(F.lit("<think>a\nb</think><answer>plain "), "source", F.lit("</answer>"))
    return _docs(spark, sf_dir).select("doc_id", text.strip_think(raw).alias("answer"), text.pure_response(other).alias("pure"))


@query("SELECT doc_id, '{\"k\": ' || CAST(n_chars AS VARCHAR) || '}' AS body FROM documents")
def strip_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("```json\n{\"k\": "), F.col("n_chars").cast("string"), F.lit("}\n```"))
    return _docs(spark, sf_dir).select("doc_id", text.strip_fence(raw).alias("body"))


@query("""
    SELECT doc_id, concat_ws(chr(10) || chr(10), nullif(trim(source), ''), nullif(trim(CASE WHEN doc_id % 2 = 0 THEN '  ' ELSE lang END), ''), nullif(trim(text), '')) AS body
    FROM documents
""")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    brief = F.when(F.col("doc_id") % 2 == 0, "  ").otherwise(F.col("lang"))
    return _docs(spark, sf_dir).select("doc_id", text.join_nonblank("\n\n", F.col("source"), brief, F.col("text")).alias("body"))


@query("""
    SELECT doc_id, contains(text, 'idiot') OR contains(text, 'scum') AS listed,
           CAST(len(string_split(text, ' the ')) - 1 + len(string_split(text, '.')) - 1 AS INTEGER) AS marks FROM documents
""")
def lexicon_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(
        "doc_id", text.contains_any(F.col("text"), ["idiot", "scum"]).alias("listed"), text.count_markers(F.col("text"), [" the ", "."]).cast("int").alias("marks")
    )


@query(r"SELECT page_id, lower(regexp_extract(url, '^\w+://([^/?#]*)', 1)) AS host FROM pages")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.host(F.col("url")).alias("host"))


@query(r"SELECT page_id, regexp_extract(lower(regexp_extract(url, '^\w+://([^/?#:]*)', 1)), '([^.]+\.[^.]+)$', 1) AS domain FROM pages")
def registrable_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.registrable_domain(text.host(F.col("url"))).alias("domain"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("text").cast("binary")
    return _docs(spark, sf_dir).select("doc_id", F.md5(raw).alias("md5"), F.sha2(raw, 256).alias("sha256"))


@query(r"""
    SELECT doc_id, regexp_replace(left(regexp_replace(trim(text), '[^a-zA-Z0-9\x{4e00}-\x{9fa5}_-]', '_', 'g'), 50), '_+', '_', 'g') AS slug,
           CAST(nullif(regexp_extract(source, '(\d+)', 1), '') AS BIGINT) AS number FROM documents
""")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.slug(F.col("text")).alias("slug"), text.first_integer(F.col("source")).alias("number"))


@query(r"""
    SELECT page_id, replace(regexp_replace(lower(regexp_extract(url, '^\w+://([^/?#:]*)', 1)), '^www\d*\.', ''), '.', '_') || '/news/'
      || regexp_replace(left(regexp_replace(trim(url), '[^a-zA-Z0-9\x{4e00}-\x{9fa5}_-]', '_', 'g'), 50), '_+', '_', 'g') || '_' || left(md5(html), 6) || '.html' AS path FROM pages
""")
def output_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = text.output_path(F.col("url"), F.col("html"), F.col("url"), F.lit(" news "), ".html")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


@query(r"SELECT doc_id, CASE WHEN length(t) > 70 THEN left(t, 70) || '…' ELSE t END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("SELECT DISTINCT source, 'https://' || source || '.org/a.xml,https://' || source || '.org/b.xml' AS maps FROM documents")
def robots_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.concat(F.lit("https://"), "source", F.lit(".org/"))
    robots = F.concat(F.lit("User-agent: *\nSitemap: "), at, F.lit("a.xml\nDisallow: /x\nsitemap:  "), at, F.lit("b.xml \n"))
    return _docs(spark, sf_dir).select("source").distinct().select("source", F.concat_ws(",", text.robots_sitemaps(robots)).alias("maps"))


@query("SELECT doc_id, '/img/' || CAST(doc_id AS VARCHAR) || '.png' AS image, 'a ![x](files/' || CAST(doc_id AS VARCHAR) || '.png) b' AS body FROM documents")
def markdown_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("a ![x](/img/"), F.col("doc_id").cast("string"), F.lit(".png) b"))
    return _docs(spark, sf_dir).select("doc_id", F.concat_ws(",", text.markdown_images(raw)).alias("image"), text.rewrite_markdown_images(raw, "files").alias("body"))


@query(r"SELECT c_custkey, length(n) BETWEEN 3 AND 50 AND regexp_matches(n, '^[A-Za-z0-9_.-]+$') AS valid FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN replace(c_name, '#', ' ') WHEN c_custkey % 3 = 1 THEN 'ab' ELSE replace(c_name, '#', '_') END AS n FROM customer)")
def username_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    name = F.when(k == 0, F.replace("c_name", F.lit("#"), F.lit(" "))).when(k == 1, "ab").otherwise(F.replace("c_name", F.lit("#"), F.lit("_")))
    return table(spark, sf_dir, "customer").select("c_custkey", text.valid_username(name).alias("valid"))


@query("""
    SELECT event_id, CAST(h // 2 AS INTEGER) AS full_stars, CAST(h % 2 AS INTEGER) AS half_stars, CAST(5 - h // 2 - h % 2 AS INTEGER) AS empty_stars,
           CASE WHEN v >= 0.8 THEN 'high' WHEN v >= 0.6 THEN 'medium' WHEN v >= 0.4 THEN 'low' ELSE 'none' END AS badge
    FROM (SELECT event_id, CAST(least(10, greatest(0, round(value / 10))) AS INTEGER) AS h, value / 100 AS v FROM events)
""")
def star_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    full, half, empty = text.stars(F.col("value") / 10)
    badge = text.similarity_badge(F.col("value") / 100)
    return _events(spark, sf_dir).select("event_id", full.alias("full_stars"), half.alias("half_stars"), empty.alias("empty_stars"), badge.alias("badge"))


@query("SELECT event_id, event_id % 3 < 2 AS feed FROM events")
def feed_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 3
    xml = F.when(n == 0, '<?xml version="1.0"?>\n<rss version="2.0">').when(n == 1, "<!-- x --><feed xmlns='a'>").otherwise("<html><rss>")
    return _events(spark, sf_dir).select("event_id", text.is_feed(xml).alias("feed"))


@query()
def unicode_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  Ａﬁ️​\U0001f600 "), "text")
    return _docs(spark, sf_dir).select(
        "doc_id", text.sanitize_unicode(raw).alias("compat"), text.sanitize_unicode(raw, strict=True, allow_emoji=False).alias("strict")
    )


@query()
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _docs(spark, sf_dir).select("doc_id", F.posexplode(text.chunk(F.col("text"), 512, 50)).alias("chunk_id", "chunk"))
    return pieces.select("doc_id", F.concat_ws("#", F.col("doc_id").cast("string"), F.concat(F.lit("chunk_"), F.col("chunk_id").cast("string"))).alias("id"), "chunk")


DATES = """
    SELECT event_id, CASE event_id % 8 WHEN 0 THEN CAST(epoch(date_trunc('second', ts))::BIGINT AS VARCHAR) WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%d')
      WHEN 3 THEN strftime(ts, '%d.%m.%Y') WHEN 4 THEN strftime(ts, '%d %b %Y') WHEN 5 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN 6 THEN 'InvalidTime' ELSE '' END AS s, ts FROM events
"""


@query(f"""
    SELECT event_id, CASE event_id % 8 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 5 THEN date_trunc('minute', ts)
      WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE CAST(date_trunc('day', ts) AS TIMESTAMP) END AS parsed FROM ({DATES})
""")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, n = F.col("ts"), F.col("event_id") % 8
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd.MM.yyyy", "dd MMM yyyy", "yyyy-MM-dd HH:mm"]
    raw = F.when(n == 0, F.unix_seconds(ts.cast("timestamp")).cast("string"))
    for i, f in enumerate(forms):
        raw = raw.when(n == i + 1, F.date_format(ts, f))
    raw = raw.when(n == 6, "InvalidTime").otherwise("")
    return _events(spark, sf_dir).select("event_id", dates.parse_time(raw).cast("timestamp_ntz").alias("parsed"))


@query("""
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) WHEN event_id % 3 = 1 THEN CAST(date_trunc('day', ts) AS TIMESTAMP) ELSE ts END AS published FROM events
""")
def publish_time_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, n = F.col("ts"), F.col("event_id") % 3
    digits = F.when(n == 0, F.array(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.second(ts)))
    out = dates.published(digits, F.when(n == 1, F.date_format(ts, "yyyy-MM-dd")), ts.cast("timestamp"))
    return _events(spark, sf_dir).select("event_id", out.cast("timestamp_ntz").alias("published"))


@query("""
    SELECT event_id, ts - INTERVAL 8 HOUR AS shifted, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local_text, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS local_day,
           round(epoch_us(ts) / 1e6, 6) AS epoch FROM events
""")
def shift_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return _events(spark, sf_dir).select(
        "event_id",
        dates.shift_hours(ts, -8).alias("shifted"),
        dates.local_text(ts.cast("timestamp"), "Asia/Shanghai").alias("local_text"),
        dates.local_text(ts.cast("timestamp"), "Asia/Shanghai", with_time=False).alias("local_day"),
        F.round(dates.epoch(ts), 6).alias("epoch"),
    )


@query("""
    SELECT event_id, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week_start, CAST(date_trunc('week', ts) + INTERVAL 7 DAY AS TIMESTAMP) AS week_end,
           CAST(date_trunc('month', ts) AS TIMESTAMP) AS month_start, CAST(date_trunc('month', ts) + INTERVAL 1 MONTH AS TIMESTAMP) AS month_end,
           strftime(ts, '%Y-%m-%d %H:00') AS hour_label, strftime(ts, '%Y-W%U') AS week_label, strftime(ts, '%G-W%V') AS iso_label,
           strftime(date_trunc('month', ts) - INTERVAL 1 MONTH, '%Y-%m-%d') AS previous_month FROM events
""")
def align_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    week, month = dates.aligned(ts, "week"), dates.aligned(ts, "month")
    return _events(spark, sf_dir).select(
        "event_id",
        week.cast("timestamp_ntz").alias("week_start"),
        dates.bucket_end(week, "week").cast("timestamp_ntz").alias("week_end"),
        month.cast("timestamp_ntz").alias("month_start"),
        dates.bucket_end(month, "month").cast("timestamp_ntz").alias("month_end"),
        dates.label(ts, "hour").alias("hour_label"),
        dates.label(ts, "week").alias("week_label"),
        dates.iso_week(ts).alias("iso_label"),
        dates.previous_month(ts).cast("string").alias("previous_month"),
    )


@query("SELECT event_id, round(greatest(0.0, least(1.0, 1 - (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) / 1e6 / 43200)), 6) AS recency FROM events")
def recency_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-20").cast("timestamp")
    return _events(spark, sf_dir).select("event_id", F.round(dates.recency(F.col("ts"), now), 6).alias("recency"))


DIMENSIONS = {"影响深度": "l_quantity", "新颖性与异常性": "l_partkey", "演化与连锁潜力": "l_suppkey", "影响广度": "l_orderkey", "可行动性": "l_linenumber", "舆情及认知影响": "l_discount"}


@query("""
    WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) % 13 AS depth, l_partkey % 13 AS novel, l_suppkey % 13 AS evolve, l_orderkey % 13 AS breadth,
        CAST(l_linenumber AS BIGINT) AS act, CAST(l_discount * 100 AS BIGINT) AS opinion,
        CASE l_partkey % 5 WHEN 0 THEN '政治与安全' WHEN 1 THEN '经济与金融' WHEN 2 THEN '社会与环境' WHEN 3 THEN '无情报价值' ELSE '其他' END AS tax,
        l_suppkey % 4 = 0 AS recap, l_suppkey % 7 = 0 AS stale, CASE WHEN l_orderkey % 3 = 0 THEN 0.95 WHEN l_orderkey % 3 = 1 THEN 0.88 ELSE 0.1 END AS sim, l_orderkey % 2 = 0 AS many FROM lineitem),
      c AS (SELECT l_orderkey, l_linenumber, tax, recap, stale, sim, many, least(10, depth) AS depth, least(10, novel) AS novel, least(10, evolve) AS evolve, least(10, breadth) AS breadth,
        least(10, act) AS act, least(10, opinion) AS opinion FROM r),
      s0 AS (SELECT *, (depth * 3.0::DOUBLE + novel * 2.5::DOUBLE + evolve * 2.0::DOUBLE + breadth * 1.5::DOUBLE + act * 1.5::DOUBLE + opinion * 0.5::DOUBLE) / 110 * 10
        * CAST(CASE tax WHEN '政治与安全' THEN 1.15 WHEN '经济与金融' THEN 1.05 WHEN '社会与环境' THEN 0.95 ELSE 1.0 END AS DOUBLE) AS s FROM c),
      s1 AS (SELECT * REPLACE (CASE WHEN recap THEN least(3.0::DOUBLE, s * 0.35::DOUBLE) ELSE s END AS s) FROM s0),
      s2 AS (SELECT * REPLACE (CASE WHEN stale THEN least(3.0::DOUBLE, s * 0.5::DOUBLE) ELSE s END AS s) FROM s1),
      s3 AS (SELECT * REPLACE (CASE WHEN sim >= 0.86 AND novel <= 3 THEN least(2.5::DOUBLE, s * 0.35::DOUBLE) ELSE s END AS s) FROM s2),
      s4 AS (SELECT * REPLACE (CASE WHEN sim >= 0.92 AND novel <= 2 THEN least(2.0::DOUBLE, s * 0.25::DOUBLE) ELSE s END AS s) FROM s3),
      s5 AS (SELECT * REPLACE (CASE WHEN many AND novel <= 4 THEN least(3.5::DOUBLE, s * 0.55::DOUBLE) ELSE s END AS s) FROM s4),
      s6 AS (SELECT * REPLACE (CASE WHEN act <= 2 AND novel <= 3 THEN least(3.0::DOUBLE, s) ELSE s END AS s) FROM s5),
      s7 AS (SELECT * REPLACE (CASE WHEN novel <= 2 AND act <= 2 AND evolve <= 3 THEN least(2.0::DOUBLE, s) ELSE s END AS s) FROM s6)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN tax = '无情报价值' THEN 0 ELSE least(10.0::DOUBLE, greatest(0.0::DOUBLE, s)) END, 12) AS score FROM s7
""")
def intelligence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem")
    values = [F.col("l_quantity").cast("long") % 13, F.col("l_partkey") % 13, F.col("l_suppkey") % 13, F.col("l_orderkey") % 13, F.col("l_linenumber").cast("long"), (F.col("l_discount") * 100).cast("decimal(12,2)").cast("long")]
    rates = F.map_from_arrays(F.array(*map(F.lit, DIMENSIONS)), F.array(*values))
    k = F.col("l_partkey") % 5
    tax = F.when(k == 0, "政治与安全").when(k == 1, "经济与金融").when(k == 2, "社会与环境").when(k == 3, "无情报价值").otherwise("其他")
    head = score.headline(F.when(F.col("l_suppkey") % 4 == 0, "年度报告"), F.when(F.col("l_suppkey") % 7 == 0, "旧闻"), F.lit(None).cast("string"), F.lit("news"))
    body = F.when(F.col("l_orderkey") % 2 == 0, "；；同时，第一，第二，第三").otherwise("plain")
    similar = F.when(F.col("l_orderkey") % 3 == 0, 0.95).when(F.col("l_orderkey") % 3 == 1, 0.88).otherwise(0.1)
    return score.with_intelligence_score(r, "score", rates, tax, head, body, similar, digits=12).select("l_orderkey", "l_linenumber", "score")


@query("""
    SELECT event_id, round(0.6 * (user_id % 100) / 100.0 + 0.4 * least(1.0, 0.5 * (user_id % 4)) - 0.008 * (hour(ts) * 0.043), 9) AS edge,
           printf('VecSim: %.2f', (user_id % 100) / 100.0) || CASE user_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' | Shared Entities: a' WHEN 2 THEN ' | Shared Entities: a, b' ELSE ' | Shared Entities: a, b, c' END
           || CASE WHEN hour(ts) = 0 THEN '' ELSE printf(' | Time Penalty: -%.2f (%.1f days)', 0.008 * (hour(ts) * 0.043), hour(ts) * 0.043) END AS reason FROM events
""")
def hybrid_edge_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    similarity, shared, days = (F.col("user_id") % 100) / 100, F.col("user_id") % 4, F.hour("ts") * 0.043
    names = F.slice(F.array(*map(F.lit, "abc")), 1, shared.cast("int"))
    return _events(spark, sf_dir).select("event_id", F.round(score.hybrid(similarity, shared, days), 9).alias("edge"), score.hybrid_reason(similarity, names, days).alias("reason"))


@query("""
    SELECT event_id, greatest(0, a - 1) + greatest(0, b - 1) AS rest, greatest(a, b) <= 1 AS dropped FROM (SELECT event_id, CAST(user_id % 4 AS DOUBLE) AS a, CAST(event_id % 3 AS DOUBLE) AS b FROM events)
""")
def score_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = F.create_map(F.lit("a"), (F.col("user_id") % 4).cast("double"), F.lit("b"), (F.col("event_id") % 3).cast("double"))
    less, dropped = score.reduced(rates)
    return _events(spark, sf_dir).select("event_id", (less["a"] + less["b"]).alias("rest"), dropped.alias("dropped"))


@query("""
    SELECT event_id, round(CASE WHEN l > 0 THEN value / l * 100 ELSE 0 END, 6) AS percent, l <= 0 OR value < l AS available, CASE WHEN l > 0 THEN value / l * 100 ELSE 0 END < 80 AS recommended
    FROM (SELECT event_id, value, CAST(user_id % 5 * 20 AS DOUBLE) AS l FROM events)
""")
def usage_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    percent, available, recommended = score.usage(F.col("value"), (F.col("user_id") % 5 * 20).cast("double"))
    return _events(spark, sf_dir).select("event_id", F.round(percent, 6).alias("percent"), available.alias("available"), recommended.alias("recommended"))


@query("""
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split(text, ' '), lambda x: trim(x) <> '' AND x NOT IN ('the', 'of', 'and')))), '|') AS rare,
           CAST(len(list_intersect(string_split(text, ' '), ['the', 'of', 'is'])) AS INTEGER) AS overlap FROM documents
""")
def rare_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", " ")
    return _docs(spark, sf_dir).select(
        "doc_id",
        F.array_join(F.sort_array(nested.rare(words, ["the", "of", "and"])), "|").alias("rare"),
        F.size(F.array_intersect(words, F.array(*map(F.lit, ["the", "of", "is"])))).alias("overlap"),
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, json_extract_string(props, '$.missing.path') AS missing FROM events")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", nested.json_path(F.col("props"), "$.k").alias("k"), nested.json_path(F.col("props"), "$.missing.path").alias("missing"))


@query("SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(json_extract(props, '$.k') AS VARCHAR) END AS k FROM events")
def json_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, props = F.col("event_id") % 4, F.col("props")
    raw = F.when(n == 0, props).when(n == 1, F.concat(F.lit("Here:\n```json\n"), props, F.lit("\n```"))).when(n == 2, F.concat(F.lit("so "), props, F.lit(" done"))).otherwise("no json")
    return _events(spark, sf_dir).select("event_id", nested.json_ladder(raw, "$.k").alias("k"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, true AS repaired FROM events")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.concat(F.lit("{k: "), F.get_json_object("props", "$.k"), F.lit(", list: [1, 2,],}"))
    fixed = _events(spark, sf_dir).select("event_id", nested.repair_json(broken).alias("fixed"))
    return fixed.select("event_id", F.get_json_object("fixed.json", "$.k").alias("k"), "fixed.repaired")


@query("""
    SELECT conv_id, string_agg('[' || CASE role WHEN 'assistant' THEN 'reply' ELSE role END || '] ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY 1
""")
def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", nested.turn_text(F.col("role"), F.col("text")).alias("line"))
    joined = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "line"))).alias("t"))
    return joined.select("conv_id", F.array_join("t.line", "\n").alias("transcript"))


@query("SELECT doc_id, 'Date 2024-01-31: ' || source || ' / ' || text AS prompt, 'lang: ' || lang || chr(10) || 'size: ' || CAST(n_chars AS VARCHAR) AS block FROM documents")
def prompt_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = nested.prompt("Date {CURRENT_DATE}: {SIMILAR} / {CONTENT}", {"CURRENT_DATE": F.lit("2024-01-31"), "SIMILAR": F.col("source"), "CONTENT": F.col("text")})
    block = nested.metadata_block({"lang": F.col("lang"), "nothing": F.lit(None).cast("string"), "size": F.col("n_chars")})
    return _docs(spark, sf_dir).select("doc_id", filled.alias("prompt"), block.alias("block"))


@query("SELECT event_type, event_id // 500 AS page, '| event_id | value |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || CAST(event_id AS VARCHAR) || ' | ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ' |', chr(10) ORDER BY event_id) AS md FROM events GROUP BY event_type, event_id // 500")
def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a page of 500 events each."""
    rows = _events(spark, sf_dir).select("event_type", F.floor(F.col("event_id") / 500).alias("page"), "event_id", nested.table_row(F.col("event_id"), F.floor("value")).alias("row"))
    lines = rows.groupBy("event_type", "page").agg(F.sort_array(F.collect_list(F.struct("event_id", "row"))).alias("t"))
    return lines.select("event_type", "page", F.concat_ws("\n", F.lit(nested.table_head("event_id", "value")), F.array_join("t.row", "\n")).alias("md"))


@query("SELECT event_id, key, value FROM (UNPIVOT (SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS user_id FROM events) ON event_type, user_id INTO NAME key VALUE value)")
def flatten_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user_id"), F.col("user_id").cast("string"))
    return _events(spark, sf_dir).select("event_id", F.explode(pairs).alias("key", "value"))


@query("SELECT event_id, n, CAST(coalesce(b, -1) AS BIGINT) AS b FROM (SELECT event_id, CAST(user_id % 2 AS BIGINT) + 1 AS n, CASE WHEN user_id % 2 = 1 THEN user_id END AS b FROM events)")
def map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.create_map(F.lit("a"), F.lit(1).cast("long"), F.lit("b"), F.col("user_id"), F.lit("c"), F.lit(0).cast("long"))
    kept = F.when(F.col("user_id") % 2 == 1, nested.without_keys(whole, ["c"])).otherwise(nested.without_keys(whole, ["b", "c"]))
    return _events(spark, sf_dir).select("event_id", F.size(kept).cast("long").alias("n"), nested.lookup(kept, "b", -1).alias("b"))


@query("SELECT event_id, round(least(10.0, greatest(0.0, coalesce(TRY_CAST(v AS DOUBLE), 0.0))), 6) AS clamped FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'n/a' WHEN 1 THEN CAST(value AS VARCHAR) ELSE CAST(-value AS VARCHAR) END AS v FROM events)")
def safe_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 3
    raw = F.when(n == 0, "n/a").when(n == 1, F.col("value").cast("string")).otherwise((-F.col("value")).cast("string"))
    return _events(spark, sf_dir).select("event_id", F.round(score.clamp(raw), 6).alias("clamped"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE replace(replace(trim(text), 'e', 'E'), 'a', '') END AS body FROM documents")
def scrubber_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    drop = lambda c: F.when(F.col("doc_id") % 5 == 0, "").otherwise(c)
    steps = [F.trim, drop, lambda c: F.replace(c, F.lit("e"), F.lit("E")), lambda c: F.replace(c, F.lit("a"), F.lit(""))]
    return _docs(spark, sf_dir).select("doc_id", text.scrubbed(F.col("text"), steps).alias("body"))


@query("SELECT event_id, TIMESTAMP '2024-01-05' <= ts AND ts <= TIMESTAMP '2024-01-10' AS inside FROM events")
def time_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", search.time_between("ts", "2024-01-05", "2024-01-10").alias("inside"))


@query("SELECT event_id, round(CASE WHEN event_id % 4 < 2 THEN epoch_us(ts) / 1e6 WHEN event_id % 4 = 2 THEN 1704067200.5 END, 6) AS at FROM events")
def archive_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, ts = F.col("event_id") % 4, F.col("ts")
    raw = F.when(n == 0, ts.cast("string")).when(n == 1, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))).when(n == 3, "no time")
    late = F.when(n == 2, F.lit("2024-01-01 00:00:00.5").cast("timestamp"))
    return _events(spark, sf_dir).select("event_id", F.round(dates.archived(raw, late), 6).alias("at"))


@query("""
    SELECT 'db.events.find({"$and": [{"event_type": "error"}, {"value": {"$gte": 50}}, {"ts": {"$lt": "ISODate(2024-01-15T00:00:00)"}}]})' AS shell, count(*) AS n
    FROM events WHERE event_type = 'error' AND value >= 50 AND ts < TIMESTAMP '2024-01-15'
""")
def filter_shell_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"$and": [{k: v} for k, v in (("event_type", "error"), ("value", {"$gte": 50}), ("ts", {"$lt": datetime.datetime(2024, 1, 15)}))]}
    return _events(spark, sf_dir).where(mql.compile_filter(spec)).agg(F.lit(mql.shell_text("events", spec)).alias("shell"), F.count(F.lit(1)).alias("n"))
