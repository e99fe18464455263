"""Training rows: funnels, weighted samples, splits, judged answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import score
from . import dedup


def dropped_summary(cached: DataFrame, is_url: Column) -> DataFrame:
    """First of each uuid among dropped records with a valid informant. cached: uuid, flag, seq, informant, ..."""
    rows = cached.where((F.col("flag") == "D") & is_url)
    return dedup.first_wins(rows, ["uuid"], [F.col("seq")])


def archived_summary(archived: DataFrame, cached: DataFrame, checks: Column) -> DataFrame:
    """First of each uuid among archived records that pass the checks and are flagged A in the cache."""
    valid = cached.where(F.col("flag") == "A").select("uuid")
    return dedup.first_wins(archived.where(checks).join(valid, "uuid", "left_semi"), ["uuid"], [F.col("seq")])


def weighted_sample(df: DataFrame, weight: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, each draw in proportion to weight: the n smallest exponential keys. The random number is
    13 hexadecimal digits of the MD5 of seed and key, so a recomputed task draws the same rows. Fewer than n rows: all of
    them."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    rows = df.where(F.col(weight) > 0).withColumn("_draw", -F.log(u) / F.col(weight))
    return rows.orderBy("_draw", key).limit(n).drop("_draw")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


def stratified_split(df: DataFrame, label: str, key: str, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """split: train, validation or test, in these shares of each label, by the order of a hash of the key. A label's rows
    never meet in one task: its order is that of the hash's first three digits, of which only counts are compared, and then
    of the rows that share them."""
    rows = df.withColumn("_hash", F.md5(F.col(key).cast("string").cast("binary"))).withColumn("_head", F.substring("_hash", 1, 3))
    counts = rows.groupBy(label, "_head").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(label)
    before = F.sum("_n").over(w.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col(label).alias("_label"), "_head", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(w).alias("_all"))
    inside = F.row_number().over(Window.partitionBy(label, "_head").orderBy("_hash", key))
    rows = rows.withColumn("_inside", inside).join(counts.withColumnRenamed("_head", "_h"), F.col(label).eqNullSafe(F.col("_label")) & (F.col("_head") == F.col("_h")))
    place = (F.col("_before") + F.col("_inside") - 0.5) / F.col("_all")
    split = F.when(place < train, "train").when(place < train + validation, "validation").otherwise("test")
    return rows.withColumn("split", split).select(*df.columns, "split")


def alpaca_rows(samples: DataFrame, cached: DataFrame, archived: DataFrame, instruction: str) -> DataFrame:
    """instruction, input, output for each sampled uuid: the archived record as JSON with its ratings lowered by one, or
    the worthless class where it was dropped or nothing is left of its ratings."""
    less, gone = score.reduced(F.col("rates"))
    rows = samples.join(cached.select("uuid", "content"), "uuid", "left").join(archived.select("uuid", "brief", "rates"), "uuid", "left")
    kept = F.to_json(F.struct("uuid", F.col("brief").alias("EVENT_BRIEF"), less.alias("RATE")))
    none = F.to_json(F.struct("uuid", F.lit("无情报价值").alias("TAXONOMY")))
    out = F.when(F.col("rates").isNull() | gone, none).otherwise(kept)
    return rows.where("content IS NOT NULL").select("uuid", F.lit(instruction).alias("instruction"), F.col("content").alias("input"), out.alias("output"))


def judged(rows: DataFrame, judge: Callable[[str, str], float], schema: str) -> DataFrame:
    """rows(id, input, output) with the judge's score; a judge that raises scores -1. The judge is called in tasks."""

    def one(shown: str, answer: str) -> float:
        try:
            return float(judge(shown, answer))
        except Exception:  # noqa: BLE001 - a failed judgement is a score of its own
            return -1.0

    # a few rows at a time, and no text comes back
    scored = F.udf(one, "double", useArrow=False).asNondeterministic()
    fields = rows.sparkSession.createDataFrame([], schema).schema
    return rows.select(*(F.col(f.name).cast(f.dataType) for f in fields), scored("input", "output").alias("score"))


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that an earlier run has not finished."""
    return rows.join(done.select(key), key, "left_anti")


def relabelled(rows: DataFrame, position: int, label: str, comment: str) -> DataFrame:
    """Rows with a human label and comment on one of them."""
    hit = F.col("position") == position
    return rows.withColumns({"human_label": F.when(hit, label).otherwise(F.col("human_label")), "comment": F.when(hit, comment).otherwise(F.col("comment"))})
