"""Keyed tables in buckets: inserts, updates and deletes that rewrite only the buckets they touch.

A table is a folder. A row's bucket is a hash of its key, or what the caller names. A commit writes new files for the touched
buckets below data/<version> and then one small file, versions/<version>.json, that says for each bucket in which versions'
files it is; buckets without a change keep their files and names, and those that only gain rows keep them beside the new ones. That file is created, never replaced: a reader sees all of
a commit or none, and of two writers that started from one version the second gets an error and may begin again. A commit can
carry the name and number of a stream's batch; a batch that was committed before changes nothing.

Rows of a null key are left out of merges. A version stays readable until vacuum() deletes the files that only it needs.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import checkpointed


#: Keys of a commit up to which they are sent to all tasks, so that the rows they don't meet are not shuffled.
FEW = 500_000
#: Commits whose files a bucket keeps beside each other; then it is written as one.
PARTS = 16


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass
class Version:
    """What a commit's file says: each bucket's data versions, and each stream's last batch."""

    number: int = 0
    buckets: dict[int, list[int]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class BucketTable:
    """A table of rows with one key. schema: of the rows, without the bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str, buckets: int = 64, bucket: Column | None = None):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        self.bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int") if bucket is None else bucket.cast("int")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # versions

    def _names(self, folder: str) -> list[str]:
        place = self._path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._files.listStatus(place)] if self._files.exists(place) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        """A commit, the last one unless a number is given; before the first one the table is empty."""
        known = self.versions()
        if number is None:
            number = known[-1] if known else 0
        if number == 0:
            return Version()
        if number not in known:
            raise KeyError(number)
        source = self._files.open(self._path(f"{self.path}/versions/{number}.json"))
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()
        return Version(number, {int(b): v for b, v in found["buckets"].items()}, found["batches"])

    def _commit(self, new: Version) -> None:
        """Creates the commit's file; the store refuses to create a file twice."""
        name = self._path(f"{self.path}/versions/{new.number}.json")
        staged = self._path(f"{self.path}/versions/.{new.number}-{self.spark._jvm.java.util.UUID.randomUUID()}")
        self._files.mkdirs(name.getParent())
        out = self._files.create(staged, True)
        out.write(bytearray(json.dumps({"buckets": new.buckets, "batches": new.batches}).encode()))
        out.close()
        if self._files.exists(name) or not self._files.rename(staged, name):
            self._files.delete(staged, False)
            raise Conflict(f"version {new.number} of {self.path} was committed by another writer")

    def committed(self, batch: tuple[str, int] | None, base: Version) -> bool:
        """Whether a stream's batch (name, number) is in the table."""
        return batch is not None and base.batches.get(batch[0], -1) >= batch[1]

    # reading

    def _rows(self, version: Version, buckets: list[int] | None = None) -> DataFrame:
        wanted = sorted(version.buckets) if buckets is None else [b for b in buckets if b in version.buckets]
        paths = [f"{self.path}/data/{v}/bucket={b}" for b in wanted for v in version.buckets[b]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, of the last one by default; of some buckets only, whose files alone are read."""
        return self._rows(self.version(version), buckets)

    def files(self) -> dict[int, list[str]]:
        """Names of each bucket's files in the last version."""
        now, out = self.version(), {}
        for bucket, versions in now.buckets.items():
            folders = [f"data/{v}/bucket={bucket}" for v in versions]
            out[bucket] = sorted(f"{folder}/{n}" for folder in folders for n in self._names(folder) if not n.startswith(("_", ".")))
        return out

    # writing

    def _write(self, rows: DataFrame, touched: list[int], base: Version, batch: tuple[str, int] | None, kept: DataFrame | None = None, added: bool = False) -> int:
        """Commits rows (with column _bucket) in place of the touched buckets; gives the new version's number. kept: more rows
        of the touched buckets, written by the tasks that read them. added: rows of other buckets join what these hold."""
        new = Version(base.number + 1, {b: v for b, v in base.buckets.items() if b not in touched}, dict(base.batches))
        if batch is not None:
            new.batches[batch[0]] = batch[1]
        if touched or added:
            # a try that failed before its commit may have left files in the folder
            folder, number = f"{self.path}/data", new.number
            while self._files.exists(self._path(f"{folder}/{number}")):
                number += 1_000_000
            # rebalance: a large bucket is written by several tasks, small ones by one
            rows.withColumnRenamed("_bucket", "bucket").hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{folder}/{number}")
            if kept is not None:
                kept.withColumnRenamed("_bucket", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{folder}/{number}")
            found = {int(n.removeprefix("bucket=")) for n in self._names(f"data/{number}") if n.startswith("bucket=")}
            new.buckets |= {b: [*new.buckets.get(b, []), number] for b in found}
        self._commit(new)
        return new.number

    def _buckets_of(self, rows: DataFrame) -> dict[int, int]:
        """How many of the rows each bucket has."""
        return dict(sorted(tuple(r) for r in rows.groupBy("_bucket").count().collect()))  # a row a bucket

    def _arranged(self, rows: DataFrame) -> DataFrame:
        """rows with the table's columns, null where they have none."""
        return rows.select("_bucket", *(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema))

    def merge(self, new: DataFrame, order: str | None = None, insert: bool = True, delete: Column | None = None, batch: tuple[str, int] | None = None) -> int:
        """Rows of new replace the table's columns that new has, in the rows of their keys, or are added (insert). Of several
        new rows of a key the one with the greatest `order` counts, and it leaves a table row with a greater one alone;
        without order, keys of new must not repeat. delete: where it holds for a new row, the key's row goes. Gives the
        version's number."""
        base = self.version()
        if self.committed(batch, base):
            return base.number
        rows = new.where(F.col(self.key).isNotNull())
        if order is not None:
            others = [c for c in rows.columns if c != self.key]
            best = rows.groupBy(self.key).agg(F.max_by(F.struct(*others), F.struct(order, *[c for c in others if c != order])).alias("_new"))
            rows = best.select(self.key, "_new.*")
        rows = rows.withColumn("_gone", F.lit(False) if delete is None else F.coalesce(delete, F.lit(False))).withColumn("_bucket", self.bucket)
        if not base.buckets:
            return self._write(self._arranged(rows.where(~F.col("_gone"))), [], base, batch, added=insert)
        rows = checkpointed(rows)
        sizes = self._buckets_of(rows)
        touched, kept = list(sizes), None
        old = self._rows(base, touched)
        if sum(sizes.values()) <= FEW:
            keys = F.broadcast(rows.select(self.key))  # FEW rows at most
            kept = self._arranged(old.join(keys, self.key, "left_anti").withColumn("_bucket", self.bucket))
            old = old.join(keys, self.key, "left_semi")
        update = [c for c in old.columns if c in rows.columns and c != self.key]
        both = old.withColumn("_old", F.lit(True)).join(rows.select(F.struct(*rows.columns).alias("_new"), F.col(self.key)), self.key, "full_outer" if insert else "left")
        hit = F.col("_new").isNotNull()
        if order is not None:
            hit &= F.coalesce(F.col(f"_new.{order}") >= F.col(order), F.lit(True))
        both = both.where(~(hit & F.coalesce(F.col("_new._gone"), F.lit(False))))
        merged = both.withColumns({c: F.when(hit, F.col(f"_new.{c}").cast(self.schema[c].dataType)).otherwise(F.col(c)) for c in update})
        return self._write(self._arranged(merged.withColumn("_bucket", self.bucket)), touched, base, batch, kept)

    def update(self, where: Column, values: dict[str, Column], batch: tuple[str, int] | None = None) -> tuple[int, int]:
        """New values for the rows that match; a dotted name is a field of a struct. Gives how many match, and how many of
        those change. Buckets without a row that changes keep their files."""
        from .tables import set_where

        base = self.version()
        if self.committed(batch, base):
            return 0, 0
        rows, changed = self._rows(base).withColumn("_bucket", self.bucket), F.lit(False)
        for name, value in values.items():
            changed |= ~F.col(name).eqNullSafe(value)
        hit = F.coalesce(where, F.lit(False))
        counts = rows.where(hit).groupBy("_bucket").agg(F.count(F.lit(1)).alias("matched"), F.count_if(changed).alias("modified")).collect()  # a row a bucket
        touched = sorted(r["_bucket"] for r in counts if r.modified)
        if touched or batch is not None:
            self._write(self._arranged(set_where(self._rows(base, touched), where, values).withColumn("_bucket", self.bucket)), touched, base, batch)
        return sum(r.matched for r in counts), sum(r.modified for r in counts)

    def replace(self, new: DataFrame, by: str, ids: DataFrame | None = None, batch: tuple[str, int] | None = None, settled: bool = False) -> int:
        """All rows that share a value of `by` with new or ids go, rows of new come, in one commit. The table's buckets must be
        a function of `by`. Buckets where no row goes keep their files. settled: new is written already, and may be read more
        than once as it is."""
        base = self.version()
        if self.committed(batch, base):
            return base.number
        rows = self._arranged(new.withColumn("_bucket", self.bucket))
        rows = rows if settled else checkpointed(rows)
        gone = rows.select(by) if ids is None else rows.select(by).unionByName(ids.select(by))
        gone = checkpointed(gone.where(F.col(by).isNotNull()).distinct().withColumn("_bucket", self.bucket))
        sizes = self._buckets_of(gone)
        held = [b for b in sizes if b in base.buckets]
        if not held:
            return self._write(rows, [], base, batch, added=True)
        few = sum(sizes.values()) <= FEW
        keys = F.broadcast(gone.select(by)) if few else gone.select(by)  # FEW rows at most
        met = self._rows(base, held).select(by).join(keys, by, "left_semi").select(self.bucket.alias("_bucket"))
        touched = sorted({*self._buckets_of(met), *(b for b in held if len(base.buckets[b]) >= PARTS)})
        old = self._arranged(self._rows(base, touched).join(keys, by, "left_anti").withColumn("_bucket", self.bucket))
        if few:
            return self._write(rows, touched, base, batch, old, added=True)
        return self._write(old.unionByName(rows), touched, base, batch, added=True)

    def delete(self, ids: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """The rows of these keys go."""
        return self.merge(ids.select(self.key).distinct(), insert=False, delete=F.lit(True), batch=batch)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all versions but the last `keep`, and the files that only those needed; gives the number of deleted
        folders. Must not run beside a writer."""
        known = self.versions()
        used = {(v, b) for n in known[-keep:] for b, versions in self.version(n).buckets.items() for v in versions}
        for n in known[:-keep]:
            self._files.delete(self._path(f"{self.path}/versions/{n}.json"), False)
        gone = 0
        for version in self._names("data"):
            buckets = [n for n in self._names(f"data/{version}") if n.startswith("bucket=")]
            dead = [n for n in buckets if (int(version), int(n.removeprefix("bucket="))) not in used]
            whole = len(dead) == len(buckets)
            for name in [""] if whole else [f"/{n}" for n in dead]:
                self._files.delete(self._path(f"{self.path}/data/{version}{name}"), True)
            gone += len(dead)
        return gone

    def sink(self, name: str, order: str | None = None, insert: bool = True):
        """A foreachBatch function that merges each batch once, whatever is replayed."""
        def keep(batch: DataFrame, number: int) -> None:
            self.merge(batch, order=order, insert=insert, batch=(name, number))

        return keep
