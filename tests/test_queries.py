import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemill.plans import catalog, vector_queries

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame):
    def cell(v):
        return "null" if v is None or v is pd.NA or v != v else str(round(v, 7)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_sql_gives_the_same_rows(spark, duck, name):
    got, expected = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(expected.columns)
    assert plain(got) == plain(expected)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_queries_beyond_sql_run(spark, name):
    rows = catalog.QUERIES[name](spark, DATA).toPandas()
    assert len(rows.columns) > 0 and len(rows) > 0


def test_recommendation_knows_ids_of_any_size(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.withColumn("event_id", events.event_id + 1_000_000).write.parquet(f"{tmp_path}/events.parquet")
    here = vector_queries.recommendation(spark, "/root/testdata/sf0.001").collect()
    assert here and [(r.id, r.score) for r in vector_queries.recommendation(spark, str(tmp_path)).collect()] == [(r.id + 1_000_000, r.score) for r in here]


SMALL = "/root/testdata/sf0.001"


def rows_of(name, spark):
    return catalog.QUERIES[name](spark, SMALL).collect()


def test_online_clusters_one_by_one(spark):
    got = rows_of("stream_online_clusters", spark)
    sizes, centers = {}, {}
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "label", "embedding").toPandas().sort_values("vec_id")
    for i, label, v in rows.itertuples(index=False):
        v = np.array(v, float)
        v /= np.linalg.norm(v)
        near = [(float(c @ v / np.linalg.norm(c)), at) for at, (of, c) in centers.items() if of == label]
        best, at = max(near, default=(-1.0, None), key=lambda x: x[0])
        if best >= 0.5:
            centers[at] = (label, (centers[at][1] * sizes[at] + v) / (sizes[at] + 1))
            sizes[at] += 1
        else:
            centers[i], sizes[i] = (label, v), 1
    assert {r.cluster: r["size"] for r in got} == sizes


def pieces_hold(body, pieces, size, overlap):
    """The pieces can be laid along the text so that neighbours share at most overlap and only blanks lie between them."""
    ends = {0}
    for piece in pieces:
        assert 0 < len(piece) <= size and piece == piece.strip()
        starts = set()
        for end in ends:
            blank = len(body[end:]) - len(body[end:].lstrip())
            starts |= {at for at in range(max(0, end - overlap - 1), end + blank + 1) if body.startswith(piece, at)}
        ends = {at + len(piece) for at in starts if at + len(piece) > min(ends)}
        assert ends
    assert any(not body[end:].strip() for end in ends)


def test_chunks_and_index_hold_whole_texts(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    chunks = {}
    for r in rows_of("text_chunks", spark):
        chunks.setdefault(r.doc_id, {})[int(r.id.rsplit("_", 1)[1])] = r.chunk
    built = {}
    for r in rows_of("index_build", spark):
        assert r.embedding == [len(r.chunk), r.chunk.count(" ")]
        built.setdefault(r.doc_id, {})[int(r.chunk_id.removeprefix(f"{r.doc_id}#chunk_"))] = r.chunk
    assert set(built) == {d for d in docs if d % 2}
    for found, body in ((chunks, lambda d: d.text or ""), (built, lambda d: "\n\n".join(x.strip() for x in (d.source, d.text) if x and x.strip()))):
        for doc_id, of in found.items():
            assert sorted(of) == list(range(len(of)))
            pieces_hold(body(docs[doc_id]), [of[i] for i in sorted(of)], 512, 50)
    assert set(chunks) == {d for d, r in docs.items() if (r.text or "").strip()}
