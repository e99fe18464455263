import re

import corpus_pipeline
from pyspark.sql import functions as F

from tidemill.llm import exact_dedup, packing, simhash, suffix_dedup, toxicity

from .test_dedup import exact_brute, linked_sets, passages_brute, slow_fingerprint

DATA = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    steps = dict(corpus_pipeline.STAGES)
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    clean = steps["toxicity"](spark, docs, DATA)
    bad = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{DATA}/labels.parquet")).where("predicted = 1").collect()}
    assert clean.columns == docs.columns
    assert sorted(pairs(clean)) == sorted(p for p in pairs(docs) if p[0] not in bad)

    exact = steps["exact_dedup"](spark, clean, DATA)
    assert sorted(r[0] for r in pairs(exact)) == sorted(e[0] for e in exact_brute(pairs(clean)) if e[3])

    near = steps["simhash_near_dedup"](spark, exact, DATA)
    fps = {d: slow_fingerprint(t) for d, t in pairs(exact)}
    sets = linked_sets(fps.values(), 3)
    first = {}
    for d, f in fps.items():
        first[sets[f]] = min(d, first.get(sets[f], d))
    assert sorted(r[0] for r in pairs(near)) == sorted(first.values())

    left = steps["suffix_array_dedup"](spark, near, DATA)
    before = passages_brute(pairs(near))
    assert left.columns == docs.columns and left.count() == near.count()
    whole = {d: t for d, t in pairs(near)}
    for d, t in pairs(left):
        removed = next(x[2] for x in before if x[0] == d)
        assert len(whole[d].encode()) - removed - 8 * 4 <= len(t.encode()) <= len(whole[d].encode()) - removed

    packed = steps["best_fit_packing"](spark, left, DATA)
    assert {r.doc_id for r in packed.collect()} == {d for d, _ in pairs(left)}


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.count() > 0
    assert all(m is not None for m in (exact_dedup, packing, simhash, suffix_dedup, re))


def odd_tables(spark, folder, rows=None):
    """Documents of every odd case with clashing columns, and labels, as a data folder."""
    from .fixtures import documents

    docs = documents(spark, rows).withColumns({c: F.lit(c) for c in ("_id", "_md5", "md5", "toxic", "score", "row", "blob", "first", "root", "length", "bucket")})
    docs.write.parquet(f"{folder}/documents.parquet")
    marks = [(100 + i, 1, int(i % 6 == 0)) for i in range(30)] + [(1, None, None), (None, 1, 1)] if rows is None else []
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_on_odd_rows(spark, tmp_path):
    docs = odd_tables(spark, tmp_path)
    columns, steps = docs.columns, dict(corpus_pipeline.STAGES)
    whole = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    clean = steps["toxicity"](spark, docs, str(tmp_path))
    assert clean.columns == columns and set(whole(clean)) <= set(whole(docs))

    exact = steps["exact_dedup"](spark, docs, str(tmp_path))
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    texts = [plain(t) for _, t in whole(exact)]
    assert exact.columns == columns and sorted(texts) == sorted({plain(t) for _, t in whole(docs)})

    near = steps["simhash_near_dedup"](spark, docs, str(tmp_path))
    fps = [slow_fingerprint(t) for _, t in whole(docs)]
    sets = linked_sets(fps, 3)
    kept = [sets[slow_fingerprint(t)] for _, t in whole(near)]
    assert near.columns == columns and sorted(kept) == sorted(set(sets.values()))

    left = steps["suffix_array_dedup"](spark, docs, str(tmp_path))
    assert left.columns == columns and left.count() == docs.count()
    assert [r.text for r in left.where("doc_id = 6").collect()] == [None]

    packed = steps["best_fit_packing"](spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {d for d, _ in whole(docs)}

    from tidemill.llm import common

    before = common.stored_so_far()
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert rows.count() >= 1 and common.stored_so_far() == before + 1


def test_stages_on_empty_tables(spark, tmp_path):
    docs = odd_tables(spark, tmp_path, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == docs.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_row_of_each_linked_set_stays(spark):
    from .fixtures import documents

    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(1, a), (5, b), (5, a), (7, b), (7, b), (9, None), (9, ""), (None, b)]
    got = sorted((r.doc_id, r.text or "") for r in simhash.one_of_each(documents(spark, rows)).collect())
    assert got == [(1, a), (5, b), (9, "")]
    assert [r.text for r in simhash.one_of_each(documents(spark, [(3, a), (3, a), (3, b)])).orderBy("text").collect()] == [b, a]
