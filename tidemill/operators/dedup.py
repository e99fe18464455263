"""Duplicate groups, survivors, and unions of result sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def groups(df: DataFrame, key: Column, id_name: str) -> DataFrame:
    """Keys that several rows share: n, and the first and last id. Null and empty keys are no group. The key is hashed for
    the shuffle, so long texts are not moved."""
    rows = df.where(key.isNotNull() & (key != "")).select(F.sha2(key.cast("binary"), 256).alias("key"), F.col(id_name))
    found = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(id_name).alias("first_id"), F.max(id_name).alias("last_id"))
    return found.where("n > 1")


def group_members(df: DataFrame, key: Column, id_name: str) -> DataFrame:
    """Ids of each group of duplicates in order, as a list. A group's ids meet in one row; use groups() for large ones."""
    rows = df.where(key.isNotNull() & (key != "")).select(F.sha2(key.cast("binary"), 256).alias("key"), F.col(id_name))
    return rows.groupBy("key").agg(F.sort_array(F.collect_list(id_name)).alias("ids")).where(F.size("ids") > 1)


def report(found: DataFrame) -> DataFrame:
    """Groups, rows in them, and redundant rows."""
    n = F.coalesce(F.sum("n"), F.lit(0))
    return found.agg(F.count(F.lit(1)).alias("groups"), n.alias("documents"), (n - F.count(F.lit(1))).alias("redundant"))


def redundant(df: DataFrame, key: Column, id_name: str, keep: str = "newest") -> DataFrame:
    """Ids to delete: all of each group but the newest or oldest. Groups are found by an aggregate, so a key of any size is
    folded before the shuffle."""
    if keep not in ("newest", "oldest"):
        raise ValueError("keep is newest or oldest")
    found = groups(df, key, id_name).select("key", F.col("last_id" if keep == "newest" else "first_id").alias("keep_id"))
    rows = df.where(key.isNotNull() & (key != "")).select(F.sha2(key.cast("binary"), 256).alias("key"), F.col(id_name))
    return rows.join(found, "key").where(F.col(id_name) != F.col("keep_id")).select(id_name, "keep_id")


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def best_of(hits: list[DataFrame], key: str, score: str, n: int = 0) -> DataFrame:
    """All hits, each key once with its best score, the best n."""
    every = hits[0]
    for other in hits[1:]:
        every = every.unionByName(other)
    best = every.groupBy(key).agg(F.max(score).alias(score))
    return best.orderBy(F.col(score).desc(), key).limit(n) if n > 0 else best


def last_per_key(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The value of the last row of each key."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))
