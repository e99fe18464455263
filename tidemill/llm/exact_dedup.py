"""Exact deduplication with DataFrame functions only.

Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D]. Rows meet by the 128-bit MD5 of
the normalised text. Each map task folds its rows of a hash to one before the shuffle, so a text that a third of all rows
share meets as one row of each map task; the verdicts return to the rows by salted keys. The smallest and largest text of
a group are carried along: if they differ, two texts share a hash, and the rows of that hash (only) are grouped by text.

Defined results: null text counts as empty; empty texts are one group; a null doc_id sorts first; rows that repeat a
doc_id are the same document and get the same verdict; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh, lookup, whole_text


def exact_groups(docs: DataFrame, hash_of=F.md5) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. hash_of maps a text to its group hash."""
    rows = docs.select("doc_id", whole_text().alias("t")).select(
        "doc_id",
        F.regexp_replace("t", r"[\x20\x09-\x0D]+", "").alias("norm"),
        F.char_length("t").alias("chars"),
    )
    rows = rows.withColumn("h", hash_of(F.col("norm").cast("binary")))
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").alias("id")))
    whole = rows.groupBy("h").agg(best.alias("best"), F.count(F.lit(1)).alias("n"), (F.min("norm") != F.max("norm")).alias("mixed"))
    groups = cut(whole.select("h", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), "mixed"))
    facts = rows.select("doc_id", "h", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    out = lookup(facts, groups.where(~F.col("mixed")).drop("mixed"), "h", F.col("doc_id"), how="inner")
    out = out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    mixed = groups.where("mixed").select("h").distinct()
    if not mixed.isEmpty():  # hashes that different texts share: their rows are grouped by the text itself
        odd = rows.join(mixed, "h", "left_semi")
        split = odd.groupBy("h", "norm").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        odd = odd.join(split, ["h", "norm"])
        out = out.unionByName(
            odd.select(
                "doc_id",
                F.col("best.id").alias("keep_id"),
                "group_size",
                F.col("doc_id").eqNullSafe(F.col("best.id")).alias("kept"),
                F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
            )
        )
    return out


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts; the columns of docs stay as they are. Of rows that repeat both the
    text and its doc_id, the one with the longest original text stays."""
    id_, sha, n, place = fresh(docs, "_id", "_sha", "_n", "_place")
    norm = F.regexp_replace(whole_text(), r"[\x20\x09-\x0D]+", "")
    kept = exact_groups(docs).where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias(n))
    kept = cut(kept.select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha), n))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.sha2(norm.cast("binary"), 256) == F.col(sha))
    out = docs.join(kept.where(F.col(n) == 1), same, "left_semi")
    if kept.where(F.col(n) > 1).isEmpty():
        return out
    repeated = docs.join(kept.where(F.col(n) > 1), same)
    first = F.row_number().over(Window.partitionBy(id_, sha).orderBy(F.char_length(whole_text()).desc()))
    return out.unionByName(repeated.withColumn(place, first).where(F.col(place) == 1).select(*docs.columns))
