"""The storyline query against a plain walk over all documents."""

import numpy as np

from tidemill.operators import graph, vectors
from tidemill.plans import catalog, vector_queries

from .conftest import DATA


def plain_walk(rows, seed, stop, depth, window):
    """Node by node, as the rules are told."""
    by = {r.doc_id: r for r in rows}
    unit = {i: np.array(r.embedding) for i, r in by.items()}
    rare = {i: {e for e in r.entities if e is not None and e.strip(" ") and e not in stop} for i, r in by.items() if r.entities is not None}
    nodes, edges, pool, seen, titles, queue = {seed: by[seed].day}, [], set(rare[seed]), {seed}, {}, [(seed, 0)]
    while queue and len(nodes) < graph.NODES:
        now, level = queue.pop(0)
        if level >= depth:
            continue
        like = {}
        for i, v in unit.items():
            size = np.linalg.norm(v) * np.linalg.norm(unit[now])
            if size > 0 and (s := float((v * unit[now]).sum() / size)) >= graph.RECALL:
                like[i] = s
        top = sorted(like, key=lambda i: (-like[i], i))[: graph.CANDIDATES]
        scored = []
        for i in top:
            days = by[i].day - by[now].day
            if i in rare and abs(days) <= window:
                edge = 0.6 * like[i] + 0.4 * min(len(rare[i] & pool) * 0.5, 1.0) - 0.008 * abs(days)
                if edge >= graph.ACCEPT:
                    scored.append((edge, i))
        taken = 0
        for edge, i in sorted(scored, key=lambda x: (-x[0], x[1])):
            if taken == graph.BRANCHES:
                break
            if i in seen:
                continue
            seen.add(i)
            echo = next((n for n, d in nodes.items() if abs(by[i].day - d) <= 1 and like[i] >= 0.65 or abs(by[i].day - d) <= 3 and like[i] >= 0.85), None)
            if echo is not None:
                if by[i].title[:15] not in titles.setdefault(echo, set()):
                    titles[echo].add(by[i].title[:15])
                    pool |= rare[i]
                continue
            nodes[i] = by[i].day
            edges.append((now, i, round(edge, 6)))
            pool |= rare[i]
            queue.append((i, level + 1))
            taken += 1
    return sorted(edges)


def test_storyline_query(spark):
    rows = vector_queries._story_docs(spark, DATA).collect()
    expected = plain_walk(rows, 0, {"the", "of", "and"}, 3, 30)
    assert len(expected) > 3
    assert sorted(tuple(r) for r in catalog.QUERIES["storyline_graph"](spark, DATA).collect()) == expected


def test_scans_are_as_many_as_levels(spark, monkeypatch):
    calls, search = [], vectors.search_many
    monkeypatch.setattr(graph.vector_search, "search_many", lambda *a: calls.append(len(a[1])) or search(*a))
    line = graph.grow(vector_queries._story_docs(spark, DATA), 0, ["the", "of", "and"], max_depth=3, window_days=30)
    assert len(calls) <= 3 and sum(calls) <= len(line.nodes)


def test_search_many(spark):
    rng = np.random.default_rng(1)
    matrix = rng.normal(size=(300, 5))
    matrix[10] = matrix[20] = matrix[5] * 2
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)] + [(900, None), (901, [0.0] * 5), (902, [1.0]), (903, [1.0, None, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = {i: list(map(float, matrix[i])) for i in (5, 7)}
    got = {}
    for r in vectors.search_many(df, asked, 4, 0.2).orderBy("query", r"vec_id").collect():
        got.setdefault(r["query"], []).append((round(-r.score, 9), r.vec_id))
    for i in asked:
        s = matrix @ matrix[i] / np.linalg.norm(matrix, axis=1) / np.linalg.norm(matrix[i])
        assert sorted(got[i]) == sorted((round(-float(x), 9), j) for j, x in enumerate(s) if x >= 0.2)[:4]
    assert vectors.search_many(df, asked, 0).count() == vectors.search_many(df, {}, 5).count() == 0
