"""Merkle manifest, clustering and token counts against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm import annulus, merkle, token_counts

from .fixtures import cases, documents

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(VOCABULARY)
OWN = token_counts.Transducer(token_counts.Vocabulary(open(VOCABULARY, encoding="utf-8").read()))


def library(texts):
    return [len(e.ids) for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("abcstrevldm' \n\t1é日.,!  ", max_size=60), max_size=5))
def test_counts_equal_the_library(texts):
    assert OWN.counts([t.encode() for t in texts]).tolist() == library(texts)


def long_texts():
    rng = random.Random(3)
    letters = lambda n, al: "".join(rng.choice(al) for _ in range(n))
    texts = [letters(3000, "abcdefghijklmnopqrstuvwxyzA") for _ in range(20)]
    texts += ["x" * 5000, "ab" * 4000, "日本" * 2000, " " * 3000, "-" * 3000 + "a", "\n" * 999, letters(5000, "é日 \t'sre1!"), "12345" * 700]
    return texts + ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>'s", "<|endoftext", "a　\xa0 b"]


@pytest.mark.parametrize("chunk, before, states", [(256, 64, 1 << 19), (7, 0, 1 << 19), (16, 3, 1 << 19), (256, 64, 300)])
def test_chunks_join_to_the_whole(monkeypatch, chunk, before, states):
    """Also where first states are assumed wrongly and maps are made anew, and where states are forgotten on the way."""
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    monkeypatch.setattr(token_counts, "BEFORE", before)
    monkeypatch.setattr(token_counts, "STATES", states)
    own = token_counts.Transducer(OWN.of)
    assert own.counts([t.encode() for t in long_texts()]).tolist() == library(long_texts())


def test_counted_table(spark):
    rows = [*cases(), *((200 + i, t) for i, t in enumerate(long_texts()))]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(documents(spark, rows), VOCABULARY).collect())
    expected = [(str(d), len((t or "").encode()), n, n > 1024) for (d, t), n in zip(rows, library([t or "" for _, t in rows]))]
    assert got == sorted(expected)
    assert token_counts.token_counts(documents(spark, []), VOCABULARY).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    values = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """All levels, the lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[g] = plain_tree([plain_leaf(r) for r in groups[g]])
    top = plain_tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, row in enumerate(groups[g]):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            acc, siblings = plain_leaf(row, 1 if hit else 0), []
            for levels, at in ((trees[g], i), (top, k)):
                for level in levels[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    siblings.append(other)
                    acc = sha(other + acc if at % 2 else acc + other)
                    at //= 2
            out.append((str(row[0]), plain_leaf(row), trees[g][-1][0], top[-1][0], sha("".join(siblings)), acc, acc == top[-1][0]))
    return sorted(out)


def manifest(docs):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = merkle.manifest(docs, tampered, {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1})
    return sorted((str(r[0]), *r[1:]) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def many_rows():
    rng = random.Random(8)
    rows = [(d, t, rng.choice(["en", "en", "en", "de", "é", "", None]), rng.choice(["s", None]), rng.choice([len(t or ""), None])) for d, t in cases()]
    rows += [rows[0]] * 40 + [(500 + i, f"t{i}", "en", "s", i) for i in range(70)] + [(1000, "alone", "zz", "s", 5)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("tier", [1, 2, 10])
def test_manifest(spark, monkeypatch, tier):
    """With tiers so low that proofs go through many of them, and in one tier; rows and ids that repeat, nulls, odd groups."""
    monkeypatch.setattr(merkle, "TIER", tier)
    schema = "doc_id long, text string, lang string, source string, n_chars long, d string, g string, i long, level int, part int, row string"
    rows = many_rows()
    docs = spark.createDataFrame([(*r, "x", "x", 1, 1, 1, "x") for r in rows], schema).repartition(3)
    got = manifest(docs)
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False}
    if tier == 2:
        assert manifest(docs.where("false")) == []
        for few in (rows[:1], [r for r in rows if r[2] == "en"][:5]):
            assert manifest(spark.createDataFrame([(*r, "x", "x", 1, 1, 1, "x") for r in few], schema)) == plain_manifest(few)


def plain_clusters(rows, clusters, rounds, size, scale, seed):
    kept = []
    for i, v in rows:
        if i is not None and v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(scale * float(np.float32(x)))) for x in v]))
    centroids = [v for _, v in sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept)[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        held = {}
        for _, v in kept:
            held.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(held[k]) for x in zip(*held[k])] if k in held else c for k, c in enumerate(centroids)]
    found = [(i, *near(v)) for i, v in kept]
    by = {}
    for _, d, k in found:
        by[k] = by.get(k, 0) + d
    digest = [sha(",".join(map(str, c))) for c in centroids]
    return sorted((i, k, d, by[k], sum(by.values()), digest[k]) for i, d, k in found)


def vectors(spark, rows):
    schema = "vec_id long, embedding array<float>, cluster int, distance long, n long"
    return spark.createDataFrame([(*r, 1, 1, 1) for r in rows], schema).repartition(3)


def clustered(df, **kw):
    return sorted(tuple(r) for r in annulus.clustered(df, **kw).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def test_clusters(spark):
    """Ties of distance and norm on a small grid, copies, odd vectors, centroids that lose all their vectors."""
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1, 0, 1, 2]) / 4 for _ in range(3)]) for i in range(160)]
    rows += [(200 + i, [0.5, 0.5, 0.5]) for i in range(80)] + [(7, [0.25, 0.0, 0.0]), (7, [0.0, 0.25, 0.0])]
    rows += [(300, None), (301, []), (302, [1.0, None, 1.0]), (303, [1.0, float("nan"), 0.0]), (304, [1.0, float("inf"), 0.0]), (305, [1.0] * 4), (None, [0.0] * 3), (306, [0.0] * 3), (307, [100.0, -50.0, 3.0])]
    kw = {"clusters": 40, "rounds": 5, "size": 3, "scale": 4, "seed": 2}
    assert clustered(vectors(spark, rows), **kw) == plain_clusters(rows, **kw)
    few = rows[:5]
    assert clustered(vectors(spark, few), **kw) == plain_clusters(few, **kw)
    assert clustered(vectors(spark, [(300, None)]), **kw) == [] == clustered(vectors(spark, []), **kw)
    with pytest.raises(Exception, match="53 bits"):
        clustered(vectors(spark, [(1, [1e30] * 3)]), **kw)


def test_only_centroids_of_the_annulus_are_compared():
    rng = np.random.default_rng(2)
    centroids = [tuple(map(int, v)) for v in rng.integers(-100, 100, (40, 16)) * np.linspace(0.2, 8, 40)[:, None]]
    near = annulus.Annulus(centroids)
    rows = np.floor(np.array(centroids)[rng.integers(0, 40, 3000)] + rng.normal(0, 6, (3000, 16)))
    chosen, distance = near.nearest(rows)
    d = ((rows[:, None, :] - np.array(centroids)[None]) ** 2).sum(axis=2)
    assert (chosen == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    assert near.compared < 0.25 * d.size
