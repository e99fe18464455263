"""Record tables: scans, appends, updates, and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir. Where it is unset, a session whose executors are threads of the driver
    gets a local folder; on a cluster executors would not see it, so that is an error."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemill-checkpoint-"))
    return df.checkpoint(eager=True)


def scan(spark: SparkSession, path: str, where: Column | None = None, columns: list[str] | None = None, order: list[Column] | None = None, limit: int = 0) -> DataFrame:
    """A filtered, projected, sorted, limited table. A limit of 0 or less is ignored."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    df = df.select(*columns) if columns else df
    df = df.orderBy(*order) if order else df
    return df.limit(limit) if limit > 0 else df


def append(df: DataFrame, path: str, time_columns: list[str] = (), zone: str = "UTC") -> None:
    """Adds rows; naive times are local to zone and stored as UTC."""
    df.withColumns({c: F.to_utc_timestamp(c, zone) for c in time_columns}).write.mode("append").parquet(path)


def set_where(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Rows that match get new values; a dotted name sets a field of a struct."""
    hit = F.coalesce(where, F.lit(False))
    for name, value in values.items():
        top, _, rest = name.partition(".")
        new = F.col(top).withField(rest, value) if rest else value
        df = df.withColumn(top, F.when(hit, new).otherwise(F.col(top)) if top in df.columns else F.when(hit, new))
    return df


def update_counts(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """How many rows match, and how many of those would change."""
    changed = F.lit(False)
    for name, value in values.items():
        changed |= ~F.col(name).eqNullSafe(value)
    hit = F.coalesce(where, F.lit(False))
    return df.agg(F.count_if(hit).alias("matched"), F.count_if(hit & changed).alias("modified"))


def upsert(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """df with the rows of new in place of, or beside, its own."""
    return df.join(new, key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids, key, "left_anti")
