"""Training-set funnels, samples and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats, training
from .registry import query, table


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("quality") == 1, "A").otherwise("D")
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select((F.col("doc_id") % 150).alias("uuid"), flag.alias("flag"), F.col("doc_id").alias("seq"), F.col("source").alias("informant"), F.col("text").alias("content"))


FLAGGED = "(SELECT doc_id % 150 AS uuid, CASE WHEN quality = 1 THEN 'A' ELSE 'D' END AS flag, doc_id AS seq, source AS informant, text AS content FROM documents JOIN labels USING (doc_id))"


@query(f"SELECT uuid, min(seq) AS seq FROM {FLAGGED} WHERE flag = 'D' AND informant <> 'src0' GROUP BY 1")
def dropped_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.dropped_summary(_flagged(spark, sf_dir), F.col("informant") != "src0").select("uuid", "seq")


@query(f"SELECT uuid, min(seq) AS seq FROM {FLAGGED} WHERE informant <> 'src0' AND uuid IN (SELECT uuid FROM {FLAGGED} WHERE flag = 'A') GROUP BY 1")
def archived_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flagged(spark, sf_dir)
    return training.archived_summary(rows, rows, F.col("informant") != "src0").select("uuid", "seq")


@query("""
    SELECT doc_id FROM (SELECT doc_id, (CASE WHEN hi > lo THEN (n_chars - lo) / CAST(hi - lo AS DOUBLE) ELSE 1 END + 0.1) / n AS weight FROM (
      SELECT doc_id, n_chars, count(*) OVER (PARTITION BY source) AS n, min(n_chars) OVER () AS lo, max(n_chars) OVER () AS hi FROM documents))
    ORDER BY -ln((CAST('0x' || substr(md5('42:' || doc_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496) / weight, doc_id LIMIT 100
""")
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.inverse_frequency(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "n_chars")
    return training.weighted_sample(rows, "weight", 100, "doc_id").select("doc_id")


@query("""
    SELECT doc_id, CASE WHEN p < 0.8 THEN 'train' WHEN p < 0.9 THEN 'validation' ELSE 'test' END AS split FROM (
      SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY lang) AS p FROM documents)
""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "split")


@query("""
    SELECT d.doc_id AS uuid, text AS input, CASE WHEN l.doc_id IS NULL OR greatest(quality, toxic) <= 1 THEN '无情报价值' ELSE '' END AS tax FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def alpaca_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    archived = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("uuid"), F.lit("brief").alias("brief"), F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("toxic"), F.col("toxic").cast("double")).alias("rates")
    )
    cached = docs.select(F.col("doc_id").alias("uuid"), F.col("text").alias("content"))
    rows = training.alpaca_rows(docs.select(F.col("doc_id").alias("uuid")), cached, archived, "Extract the event.")
    return rows.select("uuid", "input", F.coalesce(F.get_json_object("output", "$.TAXONOMY"), F.lit("")).alias("tax"))


@query("SELECT doc_id AS id, CASE WHEN lang = 'fr' THEN -1.0 ELSE CAST(length(text) % 11 AS DOUBLE) END AS score FROM documents")
def judge_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    def judge(shown: str, lang: str) -> float:
        if lang == "fr":
            raise ValueError("no judgement")
        return len(shown) % 11

    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("input"), F.col("lang").alias("output"))
    return training.judged(rows, judge, "id long, input string, output string").select("id", "score")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return training.remaining(docs, docs.where("doc_id % 3 = 0"), "doc_id")


@query("SELECT doc_id AS position, CASE WHEN doc_id = 17 THEN 'good' END AS human_label, CASE WHEN doc_id = 17 THEN 'checked' END AS comment FROM documents")
def human_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), none.alias("human_label"), none.alias("comment"))
    return training.relabelled(rows, 17, "good", "checked")
