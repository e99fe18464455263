"""Exports and imports: JSON lines, JSON arrays, CSV, text; by time range, month, ISO week or year."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from .tables import checkpointed

SPLITS = {"month": lambda ts: F.date_format(ts, "yyyy-MM"), "week": dates.iso_week, "year": lambda ts: F.date_format(ts, "yyyy")}


def scratch(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder."""
    checkpointed(spark.range(1))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def in_range(ts: Column, start: str, end: str, epoch_seconds: bool = False) -> Column:
    """Half-open range [start, end); over a numeric column as epoch seconds."""
    if epoch_seconds:
        return (ts >= dates.epoch(F.lit(start).cast("timestamp"))) & (ts < dates.epoch(F.lit(end).cast("timestamp")))
    return (ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz"))


def month_bounds(year: int, month: int) -> tuple[str, str]:
    return f"{year:04d}-{month:02d}-01", f"{year + month // 12:04d}-{month % 12 + 1:02d}-01"


def week_bounds(year: int, week: int) -> tuple[str, str]:
    """Monday of an ISO week and of the next."""
    from datetime import date, timedelta

    monday = date.fromisocalendar(year, week, 1)
    return monday.isoformat(), (monday + timedelta(days=7)).isoformat()


def export(df: DataFrame, path: str, fmt: str = "json", columns: list[str] | None = None, split_by: str | None = None, ts: str | None = None) -> None:
    """Writes df, committed as a whole. split_by month, week or year makes one folder for each bucket of ts. CSV needs its
    columns named. json_array: each file holds one array, a record a line; a file without records holds an empty one."""
    if fmt == "csv" and not columns:
        raise ValueError("a CSV export needs its columns")
    if fmt == "json_array":
        if split_by:
            raise ValueError("arrays are not split")
        _as_array(df.select(*columns) if columns else df).write.mode("overwrite").text(path)
        return
    rows = df.select(*columns) if columns and not split_by else df
    if split_by:
        rows = df.withColumn("bucket", SPLITS[split_by](F.col(ts)))
        rows = rows.select("bucket", *columns) if columns else rows
        # all rows of a bucket stay where they are: one file for each task and bucket, no shuffle
        rows.write.partitionBy("bucket").mode("overwrite").format(fmt).save(path)
        return
    writer = rows.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def _as_array(df: DataFrame) -> DataFrame:
    """The lines of one array for each partition; a record is never held back for longer than the next one takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda x: pa.RecordBatch.from_arrays([pa.array([x])], names=["value"])
        yield line("[")
        last = None
        for batch in batches:
            own = batch.column(0).to_pylist()
            if own:
                lines = ([last] if last is not None else []) + own[:-1]
                yield pa.RecordBatch.from_arrays([pa.array([x + "," for x in lines], pa.string())], names=["value"])
                last = own[-1]
        if last is not None:
            yield line(last)
        yield line("]")

    return df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(run, "value string")


def export_request(tables: dict[str, tuple[DataFrame, str]], folder: str, target: str, mode: str, start: str = "", end: str = "", split_by: str | None = None) -> list[str]:
    """An export job: target is the name of a table or all, mode range or all. tables: name -> (rows, time column). Returns
    the folders written."""
    if mode not in ("range", "all") or target != "all" and target not in tables:
        raise ValueError(f"unknown export {mode} of {target}")
    out = []
    for name in tables if target == "all" else [target]:
        rows, ts = tables[name]
        out.append(f"{folder}/{name}")
        if mode == "range":
            export(rows.where(in_range(F.col(ts), start, end)), out[-1])
        else:
            export(rows, out[-1], split_by=split_by, ts=ts)
    return out


def import_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines, or files that hold one array each, on one line or many; all files of a path are of one kind, which the first
    text found decides."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    reader = spark.read.option("multiLine", bool(first and first.value.lstrip("\ufeff \t").startswith("[")))
    return (reader.schema(schema) if schema else reader).json(path)


def profile(df: DataFrame, time: Column) -> DataFrame:
    """Rows, and the first and last time. Times may be ISO text, text in {"$date": …} or milliseconds there."""
    as_text = time.cast("string")
    inner = F.get_json_object(as_text, "$['$date']")
    ts = F.coalesce(F.timestamp_millis(inner.try_cast("long")), inner.try_cast("timestamp"), as_text.try_cast("timestamp"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def content_store(pages: DataFrame, url: str, content: str, order: str) -> DataFrame:
    """First content of each address, with its checksum."""
    from ..operators.dedup import first_wins

    return first_wins(pages, [url], [F.col(order)]).withColumn("checksum", F.sha2(F.col(content).cast("binary"), 256))
