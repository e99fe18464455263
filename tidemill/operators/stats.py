"""Counts and histograms over time and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates


def hub_counters(records: DataFrame, state: Column, states: list[str]) -> DataFrame:
    """One row: a column for each state with the number of records in it, and total. States that no record has count 0."""
    return records.agg(*[F.count_if(state == s).alias(s) for s in states], F.count(F.lit(1)).alias("total"))


def histogram(df: DataFrame, score: Column, low: int, high: int) -> DataFrame:
    """Rows of each whole score from low to high; scores nothing has are 0, scores with a fraction count for none."""
    counts = df.where((score >= low) & (score <= high) & (score == F.floor(score))).groupBy(score.cast("int").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("score"))
    return every.join(counts, "score", "left").select("score", F.coalesce("n", F.lit(0)).alias("n"))


def by_time(df: DataFrame, ts: str, unit: str, zone: str = "UTC") -> DataFrame:
    """Counts by calendar unit in a local zone: year, and month, day, hour or week. Weeks start on Sunday."""
    local = F.col(ts) if zone == "UTC" else dates.to_local(F.col(ts).cast("timestamp"), zone)
    parts = {
        "hour": {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour},
        "day": {"year": F.year, "month": F.month, "day": F.dayofmonth},
        "week": {"year": F.year, "week": dates.sunday_week},
        "month": {"year": F.year, "month": F.month},
    }[unit]
    return df.groupBy(*[f(local).alias(name) for name, f in parts.items()]).agg(F.count(F.lit(1)).alias("n"))


def summary(df: DataFrame, category: str, n: int = 10) -> DataFrame:
    """The n largest categories with the total of all. The broadcast side is one row."""
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.orderBy(F.col("n").desc(), category).limit(n).crossJoin(F.broadcast(total))


def prefix_rollup(df: DataFrame, path: Column, counter: str) -> DataFrame:
    """Sums of a counter for every prefix of a path, the empty one included."""
    prefixes = F.transform(F.sequence(F.lit(0), F.size(path)), lambda i: F.slice(path, 1, i))
    rows = df.select(F.explode(prefixes).alias("prefix"), counter)
    return rows.groupBy(F.concat_ws("/", "prefix").alias("prefix"), F.size("prefix").alias("depth")).agg(F.sum(counter).alias(counter))


def children(df: DataFrame, path: Column, prefix: list[str]) -> DataFrame:
    """Distinct next elements below a path prefix."""
    n = len(prefix)
    under = (F.size(path) > n) & (F.slice(path, 1, n) == F.array(*map(F.lit, prefix)).cast("array<string>"))
    return df.where(under).select(path[n].alias("child")).distinct()


def latest_per_namespace(df: DataFrame, namespace: list[str], order: list[Column], n: int) -> DataFrame:
    """The newest n rows of each namespace; n of 0 or less keeps none."""
    place = F.row_number().over(Window.partitionBy(*namespace).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= max(0, n)).drop("_place")


def funnel(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Rows by the first reason that removes them, in the order given; the others are kept."""
    first = F.lit("kept")
    for name, cond in reversed(list(reasons.items())):
        first = F.when(F.coalesce(cond, F.lit(False)), name).otherwise(first)
    return df.groupBy(first.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def inverse_frequency(df: DataFrame, domain: str, score: str) -> DataFrame:
    """weight = 1 / rows of the domain, times the score between its smallest and largest (0 to 1, plus a tenth)."""
    counts = df.groupBy(domain).agg(F.count(F.lit(1)).alias("_n"))
    ends = df.agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    near = F.when(F.col("_high") > F.col("_low"), (F.col(score) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(1.0)
    rows = df.join(counts, domain).crossJoin(F.broadcast(ends))  # ends is one row
    return rows.withColumn("weight", (near + 0.1) / F.col("_n")).drop("_n", "_low", "_high")
