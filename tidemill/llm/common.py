"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hot keys are dealt to so many sub-keys before anything meets by key.
SALTS = 32


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go where spark.checkpoint.dir says. Where it is unset, a session whose executors are threads of the driver
    gets a local folder; on a cluster executors would not see it, so that is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemill-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and goes on from there, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while any(n in taken for n in names):
        names = tuple(f"_{n}" for n in names)
    return list(names)


def fold(divisor: int, name: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod divisor; a null doc_id is in fold 0."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(0)) % divisor


def lookup(facts: DataFrame, dim: DataFrame, key: str, salt_from: Column, how: str = "left") -> DataFrame:
    """facts with dim's columns, dim having one row per key. A key that holds a large part of facts is dealt to SALTS
    sub-keys: the distinct (key, salt) pairs, at most SALTS of them for a key, fetch dim's row, and facts meets those."""
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(salt_from), F.lit(SALTS)))
    pairs = salted.select(key, "_salt").distinct().join(dim, key, "left" if how == "left" else "inner")
    return salted.join(pairs, [key, "_salt"], how).drop("_salt")


def lean(run):
    """run, a function of Arrow batches, giving back its free memory when a task ends: workers serve many tasks, and what
    their allocators hold counts against the executor."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


_stored: list[str] = []


def stored_so_far() -> int:
    """Number of tables that stored() wrote in this process and that are still there."""
    return len(_stored)


def clear_stored(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the tables that stored() wrote in this process after the first `since`, but for the last `keep`. Results that are
    still to be computed may need them."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in _stored[since : len(_stored) - keep]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    del _stored[since : len(_stored) - keep]


def stored(df: DataFrame, compression: str | None = None) -> DataFrame:
    """df written as a Parquet table in the shared checkpoint folder, and read again. It stays until
    clear_stored() or until the folder is cleared; use cut() for small tables, which Spark clears itself where
    spark.cleaner.referenceTracking.cleanCheckpoints is on."""
    return stored_parts([df], compression)


def stored_parts(parts: Iterable[DataFrame], compression: str | None = None) -> DataFrame:
    """stored() of all rows of the parts, which have one schema and are computed and written one after the other."""
    path = None
    for part in parts:
        if path is None:
            ensure_checkpoint_dir(part.sparkSession)
            path = f"{part.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
            spark, schema = part.sparkSession, part.schema
        part.write.mode("append").parquet(path, compression=compression)
    _stored.append(path)
    return spark.read.schema(schema).parquet(path)
