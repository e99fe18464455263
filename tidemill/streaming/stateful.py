"""Streams whose state is more than an aggregate: online clusters and crawl sessions, as stateful processors.

Online clusters keep a map with an entry for each cluster, of which a batch reads and writes what it needs; crawl sessions one
value for a bucket of addresses. Both live in the RocksDB store (rocksdb_state)."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, on the executors' disks and in the checkpoint folder."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class OnlineClusters(StatefulProcessor):
    """Each vector of a block joins the most similar centroid from `event` on, else starts a cluster named by its key. Rows of
    a micro-batch are taken in the order of their keys, batches in theirs, so keys that arrive in order give the same
    clusters in one batch and in many. State: one entry a centroid, gone `ttl_ms` after it last took a vector (0: never)."""

    def __init__(self, key: str, vector: str, kind: str, event: float, duplicate: float, ttl_ms: int):
        self.key, self.vector, self.kind, self.event, self.duplicate, self.ttl_ms = key, vector, kind, event, duplicate, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.centers = handle.getMapState("centers", f"cluster {self.kind}", "center array<double>, size long", self.ttl_ms or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.key)
        known = sorted((k[0], np.array(v[0]), v[1]) for k, v in self.centers.iterator()) if self.centers.exists() else []
        ids, centers, sizes = [k for k, _, _ in known], [c for _, c, _ in known], [n for _, _, n in known]
        unit = np.array([c / max(1e-12, np.linalg.norm(c)) for c in centers])
        changed, out = set(), []
        for i, v in zip(batch[self.key].tolist(), batch[self.vector]):
            v = np.array(v, float) / max(1e-12, float(np.linalg.norm(v)))
            likeness = (unit * v).sum(axis=1) if ids else np.zeros(0)
            at = int(likeness.argmax()) if ids else -1
            best = float(likeness[at]) if ids else -1.0
            if best >= self.event:
                centers[at] = (centers[at] * sizes[at] + v) / (sizes[at] + 1)
                sizes[at] += 1
                unit[at] = centers[at] / max(1e-12, np.linalg.norm(centers[at]))
            else:
                at = len(ids)
                ids.append(i)
                centers.append(v)
                sizes.append(1)
                unit = np.vstack([unit, v]) if len(unit) else v[None]
            changed.add(at)
            out.append((i, ids[at], best, best >= self.duplicate))
        for at in sorted(changed):
            self.centers.updateValue((ids[at],), ([float(x) for x in centers[at]], sizes[at]))
        yield pd.DataFrame(out, columns=[self.key, "cluster", "similarity", "duplicate"])

    def close(self) -> None:
        pass


def online_clusters(stream: DataFrame, block: str, key: str, vector: str, event: float = 0.85, duplicate: float = 0.95, ttl_ms: int = 0) -> DataFrame:
    """(key, cluster, similarity, duplicate) of each vector as it comes; run it inside rocksdb_state()."""
    kind = dict(stream.dtypes)[key]
    schema = f"{key} {kind}, cluster {kind}, similarity double, duplicate boolean"
    processor = OnlineClusters(key, vector, kind, event, duplicate, ttl_ms)
    rows = stream.select(block, key, vector)
    return rows.groupBy(block).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if ttl_ms else "None")


#: Ends of a run after which the address is tried again, counting up; all others start the count anew.
RETRIED = ("TEMP_FAIL", "TIMEOUT")


class CrawlSessions(StatefulProcessor):
    """Runs of addresses from their log. Events wait until the watermark has passed them and are then taken by their time, so
    late and unordered arrival changes nothing, nor does an event that arrives twice. A run that has no finish within `limit`
    of its start ends as TIMEOUT then; a finish without a running start counts for nothing. A key is a bucket of addresses, as
    each call costs far more than an event. State: one value a bucket, of the waiting events, the running runs and the counts
    of retries of its addresses."""

    def __init__(self, limit_ms: int):
        self.limit_us = limit_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getValueState("sessions", "held binary")

    def _held(self) -> tuple[dict, dict, dict]:
        """(url, run, kind) -> (ts, status) of waiting events; url -> run -> start of running runs; url -> retries, if any."""
        return pickle.loads(self.sessions.get()[0]) if self.sessions.exists() else ({}, {}, {})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (waiting, running, retries), first = self._held(), None
        for frame in rows:
            times = frame.ts.to_numpy("datetime64[us]").astype(np.int64)
            waiting.update(zip(zip(frame.url.tolist(), frame.run.tolist(), frame.kind.tolist()), zip(times.tolist(), frame.status.tolist())))
            if len(times):
                first = int(times.min()) if first is None else min(first, int(times.min()))
        self.sessions.update((pickle.dumps((waiting, running, retries)),))
        self._wake(first)
        yield pd.DataFrame([], columns=["url", "run", "status", "started", "ended", "retries"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that the watermark has passed at once; one timer for the earliest of what is left
        now, out = timerValues.getCurrentWatermarkInMs() * 1000, []
        waiting, running, retries = self._held()
        due: dict = {}
        # of equal times starts come first, then finishes, then ends by the limit
        for (url, run, kind), (ts, status) in waiting.items():
            if ts <= now:
                due.setdefault(url, []).append((ts, ("start", "finish").index(kind), run, status))
        waiting = {k: v for k, v in waiting.items() if v[0] > now}
        for url, runs in running.items():
            ends = [(began + self.limit_us, 2, run, "TIMEOUT") for run, began in runs.items() if began + self.limit_us <= now]
            if ends:
                due.setdefault(url, []).extend(ends)
        for url, steps in due.items():
            runs, again = running.pop(url, {}), retries.pop(url, 0)
            # a run starts once, so its end by the limit is known beforehand; it counts if the run is still running then
            steps += [(ts + self.limit_us, 2, run, "TIMEOUT") for ts, kind, run, _ in steps if kind == 0 and ts + self.limit_us <= now]
            for ts, kind, run, status in sorted(steps, key=lambda x: x[:3]):
                if kind == 0:
                    runs[run] = ts
                elif run in runs and (kind == 1 or runs[run] + self.limit_us == ts):
                    again = again + 1 if status in RETRIED else 0
                    out.append((url, run, status, runs.pop(run), ts, again))
            if runs:
                running[url] = runs
            if again:
                retries[url] = again
        self.sessions.update((pickle.dumps((waiting, running, retries)),))
        left = [ts for ts, _ in waiting.values()] + [t + self.limit_us for runs in running.values() for t in runs.values()]
        self._wake(min(left, default=None))
        frame = pd.DataFrame(out, columns=["url", "run", "status", "started", "ended", "retries"])
        for c in ("started", "ended"):
            frame[c] = pd.to_datetime(frame[c], unit="us", utc=True).dt.tz_localize(None)
        yield frame

    def _wake(self, at_us: int | None) -> None:
        if at_us is not None:
            self.handle.registerTimer(-(-at_us // 1000))

    def close(self) -> None:
        pass


def crawl_sessions(log: DataFrame, limit_ms: int, late: str, buckets: int = 256) -> DataFrame:
    """(url, run, status, started, ended, retries) of each run as it ends. log: url, run, kind (start or finish), status (of a
    finish), ts; events may come `late` by as much. Addresses are dealt to `buckets`, whose waiting events a task holds one
    bucket at a time. Run it inside rocksdb_state()."""
    kind = dict(log.dtypes)["url"]
    rows = log.select("url", "run", "kind", "status", "ts").withWatermark("ts", late)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("url"), F.lit(buckets)))
    schema = f"url {kind}, run long, status string, started timestamp, ended timestamp, retries long"
    return rows.groupBy("bucket").transformWithStateInPandas(CrawlSessions(limit_ms), schema, "Append", "EventTime")
