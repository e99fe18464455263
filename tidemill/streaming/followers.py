"""Streams that follow the archive: its vector index, its translations, and the hub's counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import index
from ..sources.buckets import FEW, BucketTable
from ..sources.tables import checkpointed
from .ingest import Sink

CHUNKS = "doc_id {kind}, chunk_id string, chunk string, embedding array<double>"


def chunk_table(spark, path: str, kind: str = "long", buckets: int = 64) -> BucketTable:
    """An index of chunks, in buckets by document, so that a document's chunks are replaced together."""
    return BucketTable(spark, path, CHUNKS.format(kind=kind), "chunk_id", bucket=F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], size: int = 64) -> DataFrame:
    """chunks (doc_id, chunk_id, chunk) with embedding, or with the error of the batch of `size` chunks they were in."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size].copy()
                try:
                    part["embedding"], part["error"] = list(embed(part.chunk.tolist())), None
                except Exception as e:  # noqa: BLE001 - a batch that fails is kept with its error
                    part["embedding"], part["error"] = None, str(e) or type(e).__name__
                yield part

    kind = dict(chunks.dtypes)["doc_id"]
    return chunks.mapInPandas(run, CHUNKS.format(kind=kind) + ", error string")


def index_sink(table: BucketTable, embed: Callable[[list[str]], list[list[float]]], folder: str, name: str, size: int = 64, sizes: tuple[int, int] = index.FULL) -> Sink:
    """A sink for archived records (doc_id, title, brief, text): the chunks of each record replace those the index has of it.
    Chunks of a batch that the embedding function rejects go to <folder>/rejected with its error, and each micro-batch has a
    row in <folder>/log (documents, chunks, rejected). A micro-batch that comes again changes nothing and is not embedded."""

    def keep(batch: DataFrame, number: int) -> None:
        if table.committed((name, number), table.version()):
            return
        ids = checkpointed(batch.select("doc_id"))
        found = checkpointed(embedded(index.pieces(batch, sizes), embed, size))
        bad = F.col("error").isNotNull()
        found.where(bad).write.mode("overwrite").parquet(f"{folder}/rejected/batch={number}")
        counts = found.agg(F.count_if(~bad).alias("chunks"), F.count_if(bad).alias("rejected")).withColumn("documents", F.lit(ids.count()))
        counts.write.mode("overwrite").parquet(f"{folder}/log/batch={number}")
        table.replace(found.where(~bad).drop("error"), by="doc_id", ids=ids, batch=(name, number), settled=True)

    return keep


class Translations:
    """Records to be translated, as a table in buckets: new ones (priority 0) before the backlog (1), each in the order of
    seq. A record is in the queue once: requests for one that waits are left out."""

    SCHEMA = "uuid string, priority int, seq long"

    def __init__(self, spark, path: str, archive: BucketTable, needs: Column, translate: Callable[[pd.DataFrame], pd.DataFrame], revision: str, fields: tuple[str, ...] = ("title", "brief", "text")):
        """archive: uuid, the fields, revision, and others. needs: whether a record is to be translated at all. translate gets
        a frame of uuid and fields and gives it back with new texts, null or empty where it has none."""
        self.queue = BucketTable(spark, path, self.SCHEMA, "uuid", buckets=16)
        self.archive, self.needs, self.translate, self.revision, self.fields = archive, needs, translate, revision, fields

    def request(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Adds uuid, priority, seq. Ids are trimmed and in lower case; empty ones are left out; of several requests of one the
        most urgent, then the first counts."""
        uuid = F.lower(F.trim("uuid"))
        rows = rows.select(uuid.alias("uuid"), "priority", "seq").where(F.col("uuid") != "")
        first = rows.groupBy("uuid").agg(F.min(F.struct("priority", "seq")).alias("r")).select("uuid", "r.*")
        self.queue.merge(first.join(self.queue.read().select("uuid"), "uuid", "left_anti"), batch=batch)

    def work(self, n: int | None = None, patched: Callable[[DataFrame], None] | None = None) -> int:
        """Translates the next n records, or all that wait, and gives how many were taken. A step writes the archive anew
        where its records lie, so a long backlog is better done in one. Records that are not in the archive, have a revision or
        need none are taken as they are. patched gets the records with their new texts, before they leave the queue: a step
        that failed is done again."""
        taken = self.queue.read()
        taken = checkpointed(taken if n is None else taken.orderBy("priority", "seq", "uuid").limit(n))
        count = taken.count()
        if not count:
            return 0
        wanted = F.broadcast(taken.select("uuid")) if count <= FEW else taken.select("uuid")  # FEW rows at most
        due = self.archive.read().where(F.col("revision").isNull() & F.coalesce(self.needs, F.lit(False))).join(wanted, "uuid")
        translate, fields = self.translate, list(self.fields)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), 256):  # texts of a frame, their translations and both joined are in memory
                    part = frame.iloc[at : at + 256]
                    yield part.merge(translate(part)[["uuid", *fields]], on="uuid", suffixes=("", "_new"))

        new = due.select("uuid", *fields).mapInPandas(run, "uuid string, " + ", ".join(f"{f} string" for f in [*fields, *(f"{f}_new" for f in fields)]))
        found = {f: F.nullif(F.col(f"{f}_new"), F.lit("")) for f in fields}
        new = new.where(F.coalesce(*found.values()).isNotNull()).select("uuid", *(F.coalesce(x, f).alias(f) for f, x in found.items()), F.lit(self.revision).alias("revision"))
        whole = None
        if patched is not None:
            new = checkpointed(new)
            whole = checkpointed(due.drop(*fields, "revision").join(new, "uuid").select(*due.columns))
        self.archive.merge(new, insert=False)
        if patched is not None:
            patched(whole)
        self.queue.delete(taken)
        return count

    def sink(self, name: str, n: int, patched: Callable[[DataFrame], None] | None = None) -> Sink:
        """Requests of a micro-batch join the queue, then the next n records are translated."""

        def keep(batch: DataFrame, number: int) -> None:
            self.request(batch, (name, number))
            self.work(n, patched)

        return keep


def counted(stream: DataFrame, name: str, **conditions: Column) -> DataFrame:
    """stream, whose micro-batches report how many rows meet each condition, and how many there are (total)."""
    return stream.observe(name, *(F.count_if(c).alias(k) for k, c in conditions.items()), F.count(F.lit(1)).alias("total"))


class HubCounters(StreamingQueryListener):
    """Sums of what counted() streams of one name report, while the listener is added to the session. A micro-batch that runs
    again counts once."""

    def __init__(self, name: str):
        self.name, self.totals, self.last = name, {}, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row = progress.observedMetrics.get(self.name)
        if row is not None and progress.batchId > self.last.get(progress.id, -1):
            self.last[progress.id] = progress.batchId
            for k, v in row.asDict().items():
                self.totals[k] = self.totals.get(k, 0) + v

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
