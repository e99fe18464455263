"""Stateful streams against their rules taken one by one."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.sources.exports import scratch
from tidemill.streaming import ingest, stateful

VECTORS = "block string, id long, v array<double>"


def one_by_one(rows, event, duplicate):
    centers, out = {}, {}
    for block, i, v in sorted(rows, key=lambda r: r[1]):
        v = np.array(v) / np.linalg.norm(v)
        own = centers.setdefault(block, {})
        best, at = max(((float(c @ v / np.linalg.norm(c)), k) for k, (c, _) in own.items()), default=(-1.0, None), key=lambda x: x[0])
        if best >= event:
            c, n = own[at]
            own[at] = ((c * n + v) / (n + 1), n + 1)
        else:
            at = i
            own[at] = (v, 1)
        out[i] = (at, best >= duplicate, round(best, 9))
    return out


def near_copies(n=150, seed=2):
    rng = np.random.default_rng(seed)
    seeds = rng.normal(size=(12, 6))
    return [(f"b{i % 3}", i, [float(x) for x in seeds[rng.integers(12)] + rng.normal(size=6) * rng.choice([0.05, 0.5])]) for i in range(n)]


@pytest.mark.parametrize("batches", [1, 4])
def test_online_clusters_in_one_batch_and_in_many(spark, batches):
    rows = near_copies()
    df = spark.createDataFrame(rows, VECTORS).repartition(3).withColumn("arrival", F.floor(F.col("id") * batches / len(rows)).cast("int"))
    out = ingest.drain(stateful.online_clusters(ingest.in_batches(df, "arrival"), "block", "id", "v"))
    expected = one_by_one(rows, 0.85, 0.95)
    assert {r.id: (r.cluster, r.duplicate, round(r.similarity, 9)) for r in out.collect()} == expected
    assert 1 < len({c for c, _, _ in expected.values()}) < len(rows) and {d for _, d, _ in expected.values()} == {True, False}


def test_online_clusters_go_on_after_a_stop(spark):
    rows = near_copies()
    folder, checkpoint, found = scratch(spark), scratch(spark), scratch(spark)
    for part in (rows[:70], rows[70:]):
        spark.createDataFrame(part, VECTORS).coalesce(1).write.mode("append").parquet(folder)
        stream = stateful.online_clusters(ingest.source(spark, folder, spark.createDataFrame([], VECTORS).schema), "block", "id", "v")
        ingest.drain(stream, lambda batch, _: batch.write.mode("append").parquet(found), checkpoint=checkpoint)
    assert {r.id: r.cluster for r in spark.read.parquet(found).collect()} == {i: c for i, (c, _, _) in one_by_one(rows, 0.85, 0.95).items()}


def plain_sessions(log, limit, until):
    """Each address's log by time: starts, then finishes, then limits at one time."""
    out = []
    for url in {r[0] for r in log}:
        steps = sorted({(ts, ("start", "finish").index(kind), run, status) for u, run, kind, status, ts in log if u == url}, key=lambda s: s[:3])
        running, retries = {}, 0
        for ts in sorted({s[0] for s in steps} | {s[0] + limit for s in steps if s[1] == 0}):
            if ts > until:
                break
            for t, kind, run, status in steps:
                if t == ts and kind == 0:
                    running[run] = t
            ends = [(1, run, status) for t, kind, run, status in steps if t == ts and kind == 1] + [(2, run, "TIMEOUT") for run in sorted(running) if running[run] + limit == ts]
            for _, run, status in ends:
                if run in running:
                    retries = retries + 1 if status in stateful.RETRIED else 0
                    out.append((url, run, status, running.pop(run), ts, retries))
    return sorted(out)


def crawl_log(seed):
    rng = random.Random(seed)
    zero, log = datetime(2024, 1, 1), []
    for run in range(120):
        begin = zero + timedelta(minutes=rng.randrange(0, 3000, 10))
        url = f"u{rng.randrange(8)}"
        log.append((url, run, "start", None, begin))
        if rng.random() < 0.8:
            log.append((url, run, "finish", rng.choice(["SUCCESS", "TEMP_FAIL", "TEMP_FAIL", "PERM_FAIL", "SKIPPED"]), begin + timedelta(minutes=rng.choice([0, 10, 30, 59, 60, 61, 200]))))
    log.append(("u0", 900, "finish", "SUCCESS", zero + timedelta(minutes=50)))  # never started
    return log, rng


@pytest.mark.parametrize("batches", [1, 5])
def test_crawl_sessions(spark, batches):
    """Events come out of order, up to an hour late and some twice; rows that come in other batches change nothing."""
    log, rng = crawl_log(batches)
    span = max(r[-1] for r in log) - min(r[-1] for r in log) + timedelta(hours=1)
    rows = []
    for r in log:
        for again in range(1 + (rng.random() < 0.3)):
            late = timedelta(minutes=rng.randrange(0, 60))
            rows.append((*r, int((r[-1] + late - min(x[-1] for x in log)) / span * batches)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "url string, run long, kind string, status string, ts timestamp, arrival int")
    out = ingest.drain(stateful.crawl_sessions(ingest.in_batches(df, "arrival"), 3_600_000, "70 minutes"))
    got = sorted((r.url, r.run, r.status, r.started, r.ended, r.retries) for r in out.collect())
    expected = plain_sessions(log, timedelta(hours=1), max(r[-1] for r in log) - timedelta(minutes=70))
    assert got == expected
    assert {"TIMEOUT", "SUCCESS", "TEMP_FAIL"} <= {r[2] for r in got} and max(r[-1] for r in got) > 1


def test_crawl_sessions_of_many_addresses_in_few_buckets(spark):
    """Addresses of one bucket keep their own runs and counts of retries."""
    import datetime as dt

    begin = dt.datetime(2024, 5, 1)
    at = lambda minutes: begin + dt.timedelta(minutes=minutes)
    rows = []
    for u in range(60):
        for step in range(3):
            run, batch = u * 10 + step, 0 if step < 2 else 1
            rows.append((f"u{u}", run, "start", None, at(100 * step + u % 7), batch))
            if (u + step) % 4:
                rows.append((f"u{u}", run, "finish", "TEMP_FAIL" if u % 3 else "SUCCESS", at(100 * step + 20 + u % 7), batch))
    rows += [("last", 9999, "start", None, at(5000), 2), ("last", 9998, "start", None, at(5001), 3)]
    df = spark.createDataFrame(rows, "url string, run long, kind string, status string, ts timestamp, arrival int")
    out = ingest.drain(stateful.crawl_sessions(ingest.in_batches(df, "arrival"), 3_600_000, "10 minutes", buckets=2))
    expected = set()
    for u in range(60):
        retries = 0
        for step in range(3):
            ended = (u + step) % 4 > 0
            status = ("TEMP_FAIL" if u % 3 else "SUCCESS") if ended else "TIMEOUT"
            retries = 0 if status == "SUCCESS" else retries + 1
            start = 100 * step + u % 7
            expected.add((f"u{u}", u * 10 + step, status, at(start), at(start + (20 if ended else 60)), retries))
    assert {tuple(r) for r in out.collect()} == expected
