"""Plug-in streams, and the streams that follow the archive: stops, failures, replays."""

import pytest
from pyspark.sql import functions as F

from tidemill.operators import index
from tidemill.plans import catalog
from tidemill.sources import plugin
from tidemill.sources.buckets import BucketTable
from tidemill.sources.exports import scratch
from tidemill.streaming import followers, ingest

from .conftest import DATA

PLUGIN = """
def latest(options):
    return int(open(options["count"]).read())

def tasks(start, end, options):
    return [(i, min(i + 2, end)) for i in range(start, end, 2)]

def fetch(task, options):
    for i in range(*task):
        yield f"u{i}", "VERSION", "t", "c", None
"""


def test_plugin_stream(spark, tmp_path):
    """Each item once over stops; a changed plug-in is loaded anew, one that can't be loaded is passed over."""
    code, count, checkpoint, out = tmp_path / "p.py", tmp_path / "n", str(tmp_path / "checkpoint"), str(tmp_path / "out")
    plugin.register(spark)

    def run():
        stream = spark.readStream.format("tidemill_crawl").options(path=str(code), count=str(count)).load()
        ingest.drain(stream, lambda batch, _: batch.write.mode("append").parquet(out), checkpoint=checkpoint)
        return sorted((r.uuid, r.informant) for r in spark.read.parquet(out).collect())

    code.write_text(PLUGIN.replace("VERSION", "one"))
    count.write_text("5")
    first = [(f"u{i}", "one") for i in range(5)]
    assert run() == first
    assert run() == first
    code.write_text(PLUGIN.replace("VERSION", "two"))
    count.write_text("8")
    assert run() == first + [(f"u{i}", "two") for i in range(5, 8)]


def test_plugin_versions(tmp_path):
    code, count = tmp_path / "p.py", tmp_path / "n"
    count.write_text("3")
    code.write_text(PLUGIN.replace("VERSION", "one"))
    reader = plugin.CrawlStream({"path": str(code), "count": str(count)})
    assert reader.initialOffset() == {"at": 0} and reader.latestOffset() == {"at": 3}
    planned = reader.partitions({"at": 0}, {"at": 3})
    code.write_text(PLUGIN.replace("VERSION", "two"))
    count.write_text("2")  # a count that falls takes nothing back
    assert reader.latestOffset() == {"at": 3} and reader.partitions({"at": 3}, {"at": 3}) == []
    rows = lambda parts: [r[:2] for p in parts for r in reader.read(p)]
    assert rows(planned) == [("u0", "one"), ("u1", "one"), ("u2", "one")]  # what was planned runs as it was
    assert rows(reader.partitions({"at": 0}, {"at": 3})) == [("u0", "two"), ("u1", "two"), ("u2", "two")]
    code.write_text("def latest(:")
    assert rows(reader.partitions({"at": 2}, {"at": 3})) == [("u2", "two")]
    with pytest.raises(SyntaxError):
        plugin.CrawlStream({"path": str(code)}).latestOffset()


DOCS = "doc_id long, title string, brief string, text string"


def embed(chunks):
    if any("bad" in c for c in chunks):
        raise ValueError("no vectors")
    return [[float(len(c))] for c in chunks]


def test_index_follows_the_archive(spark):
    archive, folder, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    table = followers.chunk_table(spark, scratch(spark), buckets=8)
    sink, calls = followers.index_sink(table, embed, folder, "index", size=2, sizes=(40, 5)), []

    def archived(rows):
        spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(archive)

    def run(fails=()):
        def keep(batch, number):
            calls.append(number)
            if number in fails:
                raise RuntimeError("stopped before its commit")
            sink(batch, number)

        ingest.drain(ingest.source(spark, archive, spark.createDataFrame([], DOCS).schema), keep, checkpoint=checkpoint)

    long = "one two three four five six seven eight nine ten eleven twelve"
    archived([(1, "t", None, long), (2, "t", None, "short"), (3, None, None, None)])
    run()
    archived([(4, None, "b", "bad words here"), (5, None, None, "good"), (2, "t", None, "now it is longer than it was before, by far")])
    with pytest.raises(Exception, match="stopped"):
        run(fails={1})
    run()
    assert calls == [0, 1, 1]
    before = table.files()
    sink(spark.createDataFrame([(1, "x", None, "x")], DOCS), 1)  # a batch that was committed
    assert table.files() == before
    got = {}
    for r in table.read().collect():
        got.setdefault(r.doc_id, []).append((r.chunk_id, r.chunk, r.embedding))
    docs = spark.createDataFrame([(1, "t", None, long), (2, "t", None, "now it is longer than it was before, by far"), (4, None, "b", "bad words here"), (5, None, None, "good")], DOCS)
    expected, rejected = {}, {(r.chunk_id, r.error) for r in spark.read.parquet(f"{folder}/rejected").collect()}
    for r in index.pieces(docs, (40, 5)).collect():
        if r.chunk_id not in {c for c, _ in rejected}:
            expected.setdefault(r.doc_id, []).append((r.chunk_id, r.chunk, [float(len(r.chunk))]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    assert "4#chunk_0" in {c for c, _ in rejected} and {e for _, e in rejected} == {"no vectors"}
    log = {r.batch: (r.documents, r.chunks + r.rejected) for r in spark.read.parquet(f"{folder}/log").collect()}
    assert log == {0: (3, index.pieces(spark.createDataFrame([(1, "t", None, long), (2, "t", None, "short")], DOCS), (40, 5)).count()), 1: (3, 1 + 1 + len(expected[2]) + sum(c.startswith("2#") for c, _ in rejected))}


def test_translations(spark):
    archive = BucketTable(spark, scratch(spark), "uuid string, title string, text string, revision string", "uuid", buckets=4)
    archive.merge(spark.createDataFrame([(f"d{i}", f"t{i}", "foreign" if i % 2 else "own", "r0" if i == 9 else None) for i in range(12)], archive.schema))
    order, patched = [], []

    def translate(frame):
        return frame.assign(title=None, text=["" if u == "d7" else t.upper() for u, t in zip(frame.uuid, frame.text)])

    work = followers.Translations(spark, scratch(spark), archive, F.col("text") == "foreign", translate, "r1", ("title", "text"))
    asks = lambda rows: spark.createDataFrame(rows, "uuid string, priority int, seq long")
    backlog = [(f"d{i}", 1, i) for i in range(12)]
    work.request(asks(backlog), ("s", 0))
    work.request(asks([(" D11 ", 0, 100), ("d50", 0, 101), ("", 0, 102), (None, 0, 103), ("D50", 1, 99)]), ("s", 1))
    work.request(asks([("d99", 0, 200)]), ("s", 1))  # a batch that was taken before
    waiting = [tuple(r) for r in work.queue.read().orderBy("priority", "seq").collect()]
    assert waiting == [("d50", 0, 101), *backlog]  # d11 waits already, and keeps its place
    while True:
        before = {r.uuid for r in work.queue.read().collect()}
        if not work.work(5, lambda rows: patched.extend(r.uuid for r in rows.collect())):
            break
        order.append(before - {r.uuid for r in work.queue.read().collect()})
    assert order == [{"d50", "d0", "d1", "d2", "d3"}, {"d4", "d5", "d6", "d7", "d8"}, {"d9", "d10", "d11"}]
    assert sorted(patched) == ["d1", "d11", "d3", "d5"]  # d7 came back empty, d9 has a revision
    found = {r.uuid: (r.title, r.text, r.revision) for r in archive.read().collect()}
    assert found["d1"] == ("t1", "FOREIGN", "r1") and found["d2"] == ("t2", "own", None) and found["d7"] == ("t7", "foreign", None) and found["d9"] == ("t9", "foreign", "r0")
    work.request(asks([("d1", 0, 300)]))
    assert work.work(5) == 1 and len(patched) == 4  # asked for again, it is translated already


def test_stream_index_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.col("source").alias("title"), F.lit(None).cast("string").alias("brief"), "text")
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("corrected "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    got = sorted((r.chunk_id, r.chunk, r.embedding) for r in catalog.QUERIES["stream_index"](spark, DATA).collect())
    assert got == sorted((r.chunk_id, r.chunk, [float(len(r.chunk)), float(r.chunk.count(" "))]) for r in index.pieces(docs).collect())


def test_counters_count_a_batch_once(spark):
    counters = followers.HubCounters("hub")

    class Progress:
        def __init__(self, batch, n, name="hub"):
            self.id, self.batchId = "q", batch
            self.observedMetrics = {name: spark.createDataFrame([(n, 2 * n)], "a long, total long").first()}

    class Event:
        def __init__(self, *args):
            self.progress = Progress(*args)

    for args in ((0, 5), (1, 7), (1, 7), (2, 1), (3, 100, "other")):
        counters.onQueryProgress(Event(*args))
    assert counters.totals == {"a": 13, "total": 26}


def test_plugin_given_as_text():
    reader = plugin.CrawlStream({"code": PLUGIN.replace('int(open(options["count"]).read())', "4")})
    assert reader.latestOffset() == {"at": 4} and len(reader.partitions({"at": 1}, {"at": 4})) == 2


def test_a_backlog_is_one_commit(spark):
    """All that waits is translated in one step, so the archive is written once, whatever its length."""
    archive = BucketTable(spark, scratch(spark), "uuid string, text string, revision string", "uuid", buckets=4)
    archive.merge(spark.createDataFrame([(f"d{i}", "foreign" if i % 2 else "own", None) for i in range(600)], archive.schema))
    work = followers.Translations(spark, scratch(spark), archive, F.col("text") == "foreign", lambda f: f.assign(text=f.text.str.upper()), "r1", ("text",))
    work.request(archive.read().select("uuid", F.lit(1).alias("priority"), F.xxhash64("uuid").alias("seq")))
    assert work.work() == 600 and work.work() == 0 and len(archive.versions()) == 2
    got = {r.uuid: (r.text, r.revision) for r in archive.read().collect()}
    assert got == {f"d{i}": ("FOREIGN", "r1") if i % 2 else ("own", None) for i in range(600)}


def test_new_documents_leave_the_index_as_it_is(spark):
    """Files of a bucket stay where no document of it comes again."""
    table = followers.chunk_table(spark, scratch(spark), buckets=4)
    sink = followers.index_sink(table, embed, scratch(spark), "index")
    docs = lambda ids, text: spark.createDataFrame([(i, "t", None, text) for i in ids], DOCS)
    sink(docs(range(40), "one"), 0)
    before = table.files()
    sink(docs(range(40, 80), "two"), 1)
    after = table.files()
    assert len(before) == 4 and all(set(before[b]) < set(after[b]) for b in before)
    sink(docs([50], "three"), 2)
    assert sum(table.files()[b] != after[b] for b in after) == 1
    rows = {r.doc_id: r.chunk for r in table.read().collect()}
    assert table.read().count() == 80 and rows == {i: "t\n\n" + ("one" if i < 40 else "three" if i == 50 else "two") for i in range(80)}
