import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import cluster, dedup, discovery, graph, joins, stats, training, vectors
from tidemill.sources import exports, feeds, tables
from tidemill.streaming import ingest


def test_counters_and_caps(spark):
    rows = spark.createDataFrame([(["a", "b"], 1), (["a", "c"], 2), (["d"], 4), ([], 8)], "path array<string>, n int")
    sums = {r.prefix: r.n for r in stats.prefix_rollup(rows, F.col("path"), "n").collect()}
    assert sums == {"": 15, "a": 3, "a/b": 1, "a/c": 2, "d": 4}
    assert sorted(r.child for r in stats.children(rows, F.col("path"), ["a"]).collect()) == ["b", "c"]
    log = spark.createDataFrame([("x", i, s) for i, s in enumerate(["old_success", "keep_failed", "keep_pending", "new_success"])], "ns string, i int, item string")
    assert {r.item for r in stats.latest_per_namespace(log, ["ns"], [F.col("i").desc()], 3).collect()} == {"keep_failed", "keep_pending", "new_success"}
    assert stats.latest_per_namespace(log, ["ns"], [F.col("i").desc()], 0).count() == 0


def test_histogram_leaves_fractions_out(spark):
    rows = spark.createDataFrame([(1.0,), (1.0,), (7.5,), (11.0,), (None,)], "s double")
    assert {r.score: r.n for r in stats.histogram(rows, F.col("s"), 1, 10).collect()} == {i: 2 * (i == 1) for i in range(1, 11)}


def test_duplicates_ignore_null_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, ""), (6, "")], "id int, k string")
    assert [(r.n, r.first_id, r.last_id) for r in dedup.groups(rows, F.col("k"), "id").collect()] == [(2, 1, 2)]
    with pytest.raises(ValueError):
        dedup.redundant(rows, F.col("k"), "id", "middle")


def test_domain_join_prefers_the_longest(spark):
    hosts = spark.createDataFrame([("a.b.com",), ("b.com",), ("x.org",)], "host string")
    known = spark.createDataFrame([("b.com", 1), ("a.b.com", 2)], "domain string, source int")
    assert {r.host: r.source for r in joins.by_domain(hosts, known, "host", "domain").collect()} == {"a.b.com": 2, "b.com": 1}


def clouds(spark, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, 8))
    rows = [(i, [float(x) for x in (centers[i % 5] + rng.normal(size=8) * (0.15 if i < 90 else 3))], i % 2) for i in range(110)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def test_pairs_and_dbscan_equal_brute_force(spark):
    rows, df = clouds(spark)
    v = np.array([r[1] for r in rows], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for eps in (0.05, 0.3):
        near = 1 - v @ v.T <= eps
        np.fill_diagonal(near, False)
        expected = {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}
        assert {(r.a, r.b) for r in vectors.pairs_within(df, eps).collect()} == expected
        label = np.arange(len(v))
        core = near.sum(1) >= 1
        while True:
            new = np.array([min([label[i], *label[near[i] & core]]) if core[i] else label[i] for i in range(len(v))])
            if (new == label).all():
                break
            label = new
        got = {r.vec_id: r.cluster_id for r in cluster.dbscan(df, eps, 2).collect()}
        assert got == {i: int(label[i]) if core[i] else None for i in range(len(v))}


def test_average_linkage_merges_the_close(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.99, 0.1], 0), (3, [0.0, 1.0], 0), (4, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: r.cluster_id for r in cluster.agglomerative(df, "label", 0.25).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    with pytest.raises(ValueError):
        cluster.plan("unknown")


def test_storyline_walk(spark):
    near = lambda a: [float(np.cos(a)), float(np.sin(a))]
    docs = [(0, 0.0, "seed", ["x", "y"], near(0)), (1, 5.0, "next", ["x"], near(0.4)), (2, 5.5, "echo of next", ["x"], near(0.5)), (3, 11.0, "far", ["x", "y"], near(0.9)), (4, 90.0, "late", ["x"], near(0.1)), (5, 1.0, "other", ["q"], near(3))]
    df = spark.createDataFrame(docs, "doc_id long, day double, title string, entities array<string>, embedding array<double>")
    line = graph.grow(df, 0, ["stop"], max_depth=3, window_days=7)
    assert set(line.nodes) == {0, 1, 3} and line.folded == {1: [2]} and [e[:2] for e in line.edges] == [(0, 1), (1, 3)]
    assert graph.verdict(None) == graph.verdict(5) == "COMPLETED" and graph.verdict(4) == "REJECTED"
    with pytest.raises(KeyError):
        graph.grow(df, 99, [])


def test_samples_and_splits(spark):
    rows = spark.range(1000).withColumn("w", F.when(F.col("id") < 100, 9.0).otherwise(1.0)).withColumn("label", F.col("id") % 3)
    got = training.weighted_sample(rows, "w", 200, "id")
    assert got.count() == 200 == got.select("id").distinct().count()
    assert 0.3 < got.where("id < 100").count() / 200 < 0.65  # about half of all weight
    assert training.weighted_sample(rows, "w", 5000, "id").count() == 1000
    split = training.stratified_split(rows, "label", "id").groupBy("label", "split").count().collect()
    for r in split:
        assert abs(r["count"] - 333.3 * {"train": 0.8, "validation": 0.1, "test": 0.1}[r.split]) < 3


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a", (5,)), (2, None, (6,))], "id int, flag string, appendix struct<k:int>")
    tables.append(rows, path)
    tables.append(rows, path)
    assert tables.scan(spark, path, F.col("id") == 1, ["flag"]).count() == 2
    out = tables.set_where(rows, F.col("id") == 2, {"appendix.k": F.lit(9), "flag": F.lit("x")}).orderBy("id").collect()
    assert [(r.flag, r.appendix.k) for r in out] == [("a", 5), ("x", 9)]
    assert tables.delete(tables.upsert(rows, rows.limit(1), "id"), rows.limit(1), "id").count() == 1


def test_exports(spark, tmp_path):
    with pytest.raises(ValueError):
        exports.export(spark.range(3), str(tmp_path / "x"), "csv")
    assert exports.week_bounds(2024, 1) == ("2024-01-01", "2024-01-08") and exports.month_bounds(2024, 12) == ("2024-12-01", "2025-01-01")
    times = spark.createDataFrame([('{"$date": "2024-01-02T00:00:00Z"}',), ('{"$date": 1704067200000}',), ("2024-01-05",)], "t string")
    r = exports.profile(times, F.col("t")).first()
    assert (r.n, str(r["first"]), str(r["last"])) == (3, "2024-01-01 00:00:00", "2024-01-05 00:00:00")


def test_feeds(spark):
    rss = "<rss><channel><title>C</title><item><description>&lt;p&gt;x&lt;/p&gt;</description><enclosure url='u' type='image/png'/></item></channel></rss>"
    got = feeds.parse_feed(rss)
    assert got["language"] == "zh-cn" and got["entries"][0]["title"] == "Untitled" and got["entries"][0]["description"] == "x" and got["entries"][0]["media"] == ["u"]
    assert feeds.parse_feed("<broken")["fatal"] and feeds.parse_sitemap("<x")["kind"] == "invalid"
    assert feeds.parse_sitemap("<sitemapindex><sitemap><loc>a</loc></sitemap></sitemapindex>") == {"kind": "index", "urls": [{"loc": "a", "lastmod": None}]}
    items = spark.createDataFrame([("t&", "l", "d", "g", None)], "title string, link string, description string, guid string, date timestamp")
    assert "<title>t&amp;</title>" in feeds.rss_document("T", "L", items)


def test_article_group(spark):
    html = "<nav>" + "".join(f"<a href='/n{i}'>home</a>" for i in range(9)) + "</nav><div class='article-list'>" + "".join(f"<a href='/a{i}'>A long headline {i}</a>" for i in range(5)) + "</div>"
    groups = discovery.link_groups(spark.createDataFrame([(1, "http://h/", html)], "id int, url string, html string"), "id", "html", "url")
    best = discovery.article_group(groups, "id").collect()
    assert [(r.signature, r.n) for r in best] == [("div.article-list", 5)]


def test_stream_state(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [(1, "2024-01-01 00:00:00", 60.0), (1, "2024-01-01 01:00:00", 50.0), (1, "2024-01-01 02:00:00", 40.0), (1, "2024-01-03 00:00:00", 110.0), (2, "2024-01-01 00:00:00", 200.0)]
    df = spark.createDataFrame(rows, "k int, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(path)
    out = ingest.drain(ingest.limited(ingest.source(spark, path, df.schema), "k", "ts", "v", 120.0, 86400))
    assert sorted((r.k, str(r.ts), r.admitted) for r in out.collect()) == sorted((k, t, a) for (k, t, _), a in zip(rows, [True, True, False, True, False]))


def test_rate_limit_adds_as_sql_does(spark, tmp_path):
    """Amounts that reach the limit but for rounding, and rows without a key, an amount or a time."""
    import duckdb
    from tidemill.plans import catalog

    lists = [[26.69, 15.55, 8.6, 3.85, 19.99, 1.17, 15.97, 17.73, 10.45], [27.07, 1.26, 25.5, 16.5, 12.97, 17.69, 19.01]]
    rows = [(100 * u + i, f"2024-01-01 00:{i:02}:00", u, v) for u, amounts in enumerate(lists) for i, v in enumerate(amounts)]
    rows += [(500, "2024-01-01 00:00:00", 7, None), (501, None, 7, 90.0), (502, "2024-01-01 00:05:00", 7, 100.0), (503, "2024-01-01 00:00:00", None, 1.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = con.sql(catalog.ORACLE["stream_rate_limit"]).fetchall()
    got = catalog.QUERIES["stream_rate_limit"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) == [(0, 8, 1), (1, 7, 0), (7, 2, 0)]


def test_latest_table_over_batches(spark, tmp_path):
    folder = str(tmp_path / "state")
    keep = ingest.latest_table(folder, "url", "seq")
    keep(spark.createDataFrame([("a", 1, "run"), ("b", 2, "run")], "url string, seq int, state string"), 0)
    keep(spark.createDataFrame([("a", 3, "done")], "url string, seq int, state string"), 1)
    assert {r.url: r.state for r in spark.read.parquet(f"{folder}/1").collect()} == {"a": "done", "b": "run"}


def test_latest_table_of_changes(spark, tmp_path):
    """Whole versions come every third batch; the state is the same after each batch, also where one runs again."""
    folder, rng, state = str(tmp_path / "state"), np.random.default_rng(3), {}
    schema = "url string, seq int, state string"
    keep = ingest.latest_table(folder, "url", "seq", every=3)
    for number in range(8):
        rows = [(f"u{rng.integers(6)}", int(rng.integers(1000)) * 10 + number, f"s{number}") for _ in range(4)] if number != 4 else []
        for url, seq, now in rows:
            state[url] = max(state.get(url, (-1, "")), (seq, now))
        for _ in range(2):
            keep(spark.createDataFrame(rows, schema), number)
            got = ingest.latest_version(spark, folder, schema, "url", "seq").collect()
            assert len(got) == len(state) and {r.url: (r.seq, r.state) for r in got} == state
        assert (tmp_path / "state" / str(number)).exists() == (number % 3 == 2)
    with pytest.raises(ValueError):
        ingest.latest_version(spark, folder, schema)


def test_retries():
    calls = []

    def flaky(content):
        calls.append(content)
        raise ValueError("x")

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame([("u", "c")], "uuid string, content string")
    (r,) = ingest.analysed(rows, flaky, "uuid string, content string").collect()
    assert r.result is None and r.error == "x"


def test_crawl_plugins(spark, tmp_path, monkeypatch):
    from tidemill.sources import plugin

    (tmp_path / "demo_crawler.py").write_text(
        "def partitions(options):\n    return list(range(int(options['pages'])))\n\ndef fetch(task, options):\n    yield (f'u{task}', f'http://h/{task}', 't', 'c', None)\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setenv("PYTHONPATH", f"{tmp_path}")
    reader = plugin.CrawlReader({"module": "demo_crawler", "pages": "3"})
    rows = [row for p in reader.partitions() for row in reader.read(p)]
    assert [r[0] for r in rows] == ["u0", "u1", "u2"]
    assert plugin.CrawlSource.name() == "tidemill_crawl"
    plugin.register(spark)


def test_export_requests(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01", 1), ("2024-02-01", 2)], "t string, i int").withColumn("t", F.col("t").cast("timestamp_ntz"))
    paths = exports.export_request({"a": (rows, "t"), "b": (rows, "t")}, str(tmp_path), "all", "range", "2024-01-01", "2024-02-01")
    assert [spark.read.json(p).count() for p in paths] == [1, 1]
    with pytest.raises(ValueError):
        exports.export_request({}, str(tmp_path), "c", "all")


def linkage_brute(v, distance):
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    d = 1 - v @ v.T
    parts = [[i] for i in range(len(v))]
    while len(parts) > 1:
        far, i, j = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(parts) for j, b in enumerate(parts) if i < j)
        if far > distance:
            break
        parts[i] += parts.pop(j)
    return sorted(sorted(p) for p in parts)


def test_average_linkage_equals_brute_force():
    import pandas as pd

    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 40):
        for distance in (0.1, 0.45, 0.9):
            v = rng.normal(size=(n, 5)) + 2 * rng.normal(size=(4, 5))[rng.integers(0, 4, n)]
            got = cluster._linkage(pd.DataFrame({"vec_id": np.arange(n) * 3, "embedding": list(v)}), distance)
            parts = sorted(sorted(int(i) // 3 for i in g.vec_id) for _, g in got.groupby("cluster_id"))
            assert parts == linkage_brute(v, distance)
            assert all(g.vec_id.min() == c for c, g in got.groupby("cluster_id"))


def hdbscan_brute(v, size, samples, selection):
    """By the definition: components of the mutual-reachability graph at every distance, from far to near."""
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = np.maximum(0, 1 - v @ v.T)
    core = np.sort(d, axis=1)[:, min(samples, len(v)) - 1]
    d = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    np.fill_diagonal(d, 0)
    n = len(v)

    def parts(points, below):
        left, out = set(points), []
        while left:
            todo, own = [left.pop()], set()
            while todo:
                x = todo.pop()
                own.add(x)
                near = {y for y in left if d[x, y] < below}
                left -= near
                todo += near
            out.append(frozenset(own))
        return out

    levels = sorted({float(x) for x in d[np.triu_indices(n, 1)]}, reverse=True)
    clusters = []

    def grow(points, birth, parent):
        own = {"points": points, "stability": 0.0, "children": [], "parent": parent}
        clusters.append(own)
        now = points
        for level in levels:
            split = parts(now, level)
            if len(split) == 1:
                continue
            at, large = 1 / max(level, 1e-12), [p for p in split if len(p) >= size]
            own["stability"] += sum(len(p) for p in split if len(p) < size) * (at - birth)
            if len(large) >= 2:
                own["stability"] += sum(map(len, large)) * (at - birth)
                own["children"] = [grow(p, at, own) for p in large]
                return own
            if not large:
                return own
            now = large[0]
        return own

    def pick(c):
        below = [x for k in c["children"] for x in pick(k)]
        if selection == "leaf":
            return below or [c]
        value = lambda cs: sum(x["value"] for x in cs)
        c["value"] = c["stability"]
        return [c] if not below or c["stability"] >= value(below) else below

    top = grow(frozenset(range(n)), 0.0, None)
    chosen = [x for k in top["children"] for x in pick(k)]
    return sorted(sorted(c["points"]) for c in chosen)


@pytest.mark.parametrize("selection", ["eom", "leaf"])
def test_hdbscan_equals_brute_force(selection):
    import pandas as pd

    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 30, 45):
        for size, samples in ((3, 2), (2, 1), (4, 3)):
            v = rng.normal(size=(n, 6)) * 0.4 + 2 * rng.normal(size=(5, 6))[rng.integers(0, 5, n)]
            got = cluster._hdbscan(pd.DataFrame({"vec_id": np.arange(n) * 2, "embedding": list(v)}), size, samples, selection)
            parts = sorted(sorted(int(i) // 2 for i in g.vec_id) for _, g in got.groupby("cluster_id"))
            assert parts == (hdbscan_brute(v, size, samples, selection) if n > 1 else [])


def test_plans_bound_their_points(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)], f"2024-01-0{1 + i % 3} 12:00:00") for i in range(30)], "vec_id long, embedding array<double>, t string")
    df = df.withColumn("ts", F.col("t").cast("timestamp_ntz"))
    chosen = cluster.plan("hdbscan_leaf", window_hours=36, max_points=15)
    inside = cluster.bounded(df, chosen, "ts", "2024-01-03 18:00:00").collect()
    assert len(inside) == 15 and sum(r.vec_id % 3 == 2 for r in inside) == 10 and min(r.vec_id for r in inside if r.vec_id % 3 == 1) == 16
    assert {r.vec_id for r in cluster.bounded(df, chosen).collect()} == set(range(15, 30))
    assert {r.vec_id for r in cluster.run_plan(df, chosen, ts="ts", now="2024-01-03 18:00:00").collect()} == {r.vec_id for r in inside}
    assert cluster.run_plan(df.limit(0), chosen).count() == 0
    with pytest.raises(ValueError):
        cluster.hdbscan(df, selection="best")


def test_json_arrays_and_lines(spark, tmp_path):
    rows = [(i, f"t,{i}]") for i in range(25)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)
    for kind in ("json_array", "json"):
        exports.export(df, str(tmp_path / kind), kind)
        assert sorted(map(tuple, exports.import_json(spark, str(tmp_path / kind), "id long, t string").collect())) == rows
    forms = {"one": '[{"a": 1}, {"a": 2}]', "lines": '[\n{"a": 1},\n{"a": 2}\n]', "pretty": '\n  [\n  {\n    "a": 1\n  },\n  {\n    "a": 2\n  }\n]\n', "plain": '{"a": 1}\n{"a": 2}\n'}
    for name, body in forms.items():
        (tmp_path / f"{name}.json").write_text(body)
        assert sorted(r.a for r in exports.import_json(spark, str(tmp_path / f"{name}.json")).collect()) == [1, 2]
    exports.export(df.limit(0), str(tmp_path / "none"), "json_array")
    assert exports.import_json(spark, str(tmp_path / "none"), "id long, t string").count() == 0
    with pytest.raises(ValueError):
        exports.export(df, str(tmp_path / "x"), "json_array", split_by="month", ts="t")


def test_streams_of_several_batches(spark, tmp_path):
    rows = [(i % 4, i, f"s{i}") for i in range(40)]
    for n in range(4):
        spark.createDataFrame(rows[n * 10 : n * 10 + 10], "k long, seq long, state string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    folder, routes = str(tmp_path / "state"), str(tmp_path / "routes")
    assert ingest.latest_version(spark, folder, "k long, seq long, state string").count() == 0
    ingest.drain(ingest.source(spark, str(tmp_path / "in"), schema, files=1), ingest.latest_table(folder, "k", "seq"))
    got = ingest.latest_version(spark, folder, "k long, seq long, state string").collect()
    assert {(r.k, r.seq, r.state) for r in got} == {(k, max(s for q, s, _ in rows if q == k), f"s{max(s for q, s, _ in rows if q == k)}") for k in range(4)}
    ingest.drain(ingest.source(spark, str(tmp_path / "in"), schema, files=1), ingest.route_to(routes, F.col("seq") % 3 == 0, F.col("seq") % 3 == 1))
    assert {r: spark.read.parquet(f"{routes}/{r}").count() for r in ("duplicate", "low_value", "archive")} == {"duplicate": 14, "low_value": 13, "archive": 13}


def test_pages_without_a_limit(spark):
    from tidemill.operators import search

    rows = [(i, (i * 37) % 11) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    expected = [(i, v, p + 1, 200) for p, (i, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))]
    order = [F.col("v").desc(), F.col("id")]
    assert sorted(map(tuple, search.page(df, order).collect()), key=lambda r: r[2]) == expected
    assert sorted(map(tuple, search.page(df, order, skip=150).collect()), key=lambda r: r[2]) == expected[150:]
    assert search.page(df.limit(0), order).count() == 0


def test_snapshots_of_a_storyline(spark, tmp_path):
    near = lambda a: [float(np.cos(a)), float(np.sin(a))]
    docs = [(0, 0.0, "seed", ["x", "y"], near(0)), (1, 5.0, "next", ["x"], near(0.4)), (3, 11.0, "far", ["x", "y"], near(0.9))]
    df = spark.createDataFrame(docs, "doc_id long, day double, title string, entities array<string>, embedding array<double>")
    path = str(tmp_path / "snapshots")
    line = graph.grow(df, 0, ["stop"], snapshot=graph.snapshot_table(spark, path, "t1"))
    every = spark.read.parquet(path)
    assert {(r.version, r.state) for r in every.collect()} == {(1, "PROCESSING"), (2, "PROCESSING"), (3, "COMPLETED")}
    assert [every.where(f"version = {v} AND node IS NOT NULL").count() for v in (1, 2, 3)] == [2, 3, 3]
    last = graph.latest_snapshot(spark, path, "t1")
    assert {r.node for r in last.where("node IS NOT NULL").collect()} == set(line.nodes)
    assert {(r.source, r.target) for r in last.where("source IS NOT NULL").collect()} == {e[:2] for e in line.edges}


def test_configured_crawls(spark, tmp_path):
    from tidemill.sources import crawl

    def lists(url):
        if "broken" in url:
            raise OSError("no answer")
        items = "".join(f"<item><title>t</title><link>{url}/{i}</link><guid>{i}</guid></item>" for i in range(3))
        return f"<rss><channel><title>x</title>{items}</channel></rss>"

    def article(url):
        if url.endswith("/2"):
            raise ValueError("gone")
        return f"<html><body><article><p>{f'text of {url} and more words. ' * 40}</p></article></body></html>"

    seen = {}
    config = {
        "d_fetcher_name": "lists", "e_fetcher_name": "articles", "discoverer_name": "feed", "extractor_name": "main_content",
        "entry_points": {"a": "http://h/a", "b": "http://h/broken", "c": "http://h/c"}, "channel_filter": {"channel_list_filter": ["http://h/c"]},
        "article_filter": lambda url, channel: not url.endswith("/0"), "content_handler": lambda df: seen.update(done=df.count()), "exception_handler": lambda df: seen.update(failed=df.count()),
    }
    made, channels = crawl.from_config(config, {"lists": lists, "articles": article})
    rows = made.run(spark.createDataFrame(list(channels.items()), "channel string, url string")).collect()
    got = {r.url: (r.channel, r.error) for r in rows}
    assert got == {"http://h/a/1": ("a", None), "http://h/a/2": ("a", "ValueError: gone"), "http://h/broken": ("b", "OSError: no answer")}
    assert [r.text.strip()[:21] for r in rows if r.text] == ["text of http://h/a/1 "] and seen == {"done": 1, "failed": 2}
    with pytest.raises(ValueError):
        crawl.from_config(config | {"d_fetcher_name": "none"}, {"lists": lists, "articles": article})
    with pytest.raises(ValueError):
        crawl.from_config(config | {"extractor_name": "none"}, {"lists": lists, "articles": article})


def test_archive_times_and_counters(spark):
    from tidemill.functions import dates

    rows = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01 00:00:01",), ("x",), (None,)], "t string")
    assert [r.a for r in rows.select(dates.archived(F.col("t")).alias("a")).collect()] == [1704067200.0, 1704067201.0, None, None]
    now = rows.select(dates.archived(F.col("t"), F.current_timestamp()).alias("a")).collect()
    assert now[2].a > 1.7e9 and now[3].a > 1.7e9
    counts = stats.hub_counters(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "s string"), F.col("s"), ["a", "b", "c"]).first()
    assert (counts.a, counts.b, counts.c, counts.total) == (2, 1, 0, 4)


def test_markers_are_counted_by_themselves(spark):
    from tidemill.functions import text

    rows = spark.createDataFrame([("aaab;ab.c",), ("",), (None,)], "t string")
    for markers in ([";", ".", "ab"], ["aa", "ab"], ["a", "aab"]):
        got = [r.n for r in rows.select(text.count_markers(F.col("t"), markers).alias("n")).collect()]
        assert got == [sum("aaab;ab.c".count(m) for m in markers), 0, 0]
    assert [r.n for r in rows.select(text.contains_any(F.col("t"), ["x.", "b;a"]).alias("n")).collect()] == [True, False, False]
