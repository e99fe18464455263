"""One query for each training-data operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annulus, bpe, exact_dedup, html_extract, langid, lm_scoring, merkle, packing, simhash, suffix_dedup, token_counts, topk, toxicity
from .common import documents


def _tokenizer(name: str) -> tuple[str, str]:
    """Place of a public vocabulary file, and the split pattern."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scores(documents(spark, sf_dir), folds=5, held=1, least=1)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(documents(spark, sf_dir), folds=3, held=1)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(documents(spark, sf_dir), *_tokenizer("byte_bpe_multi_50k.tiktoken"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), *_tokenizer("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), folds=4, held=2)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), words=3, distance=3)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(documents(spark, sf_dir), tampered, {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1})


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annulus.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), clusters=40, rounds=5, size=64, scale=256, seed=2)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json")[0], limit=1024)


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring,
        op2_language_id,
        op3_byte_bpe,
        op4_best_fit_packing,
        op5_toxicity,
        op6_simhash_near_dedup,
        op7_html_extraction,
        op8_suffix_array_dedup,
        op9_exact_dedup,
        op10_exact_top_k,
        op11_merkle_manifest,
        op12_centroid_clustering,
        op13_token_counts,
    )
}



def _manifest_sql() -> str:
    fields = {"doc_id": "doc_id", "source": "source", "lang": "lang", "n_chars": "n_chars", "text": "text"}
    leaf = lambda own: "sha256(" + " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || {v}, '-')" for v in (fields | own).values()) + ")"
    # crc32 of the few bytes of an id, bit by bit
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    up = "list_transform(range(0, (len(l) + 1) // 2), lambda k: sha256(l[2 * k + 1] || coalesce(l[2 * k + 2], '')))"
    return f"""
        WITH RECURSIVE crc AS (
          SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS b, 0 AS bits, 4294967295::BIGINT AS c FROM documents WHERE doc_id IS NOT NULL
          UNION ALL SELECT doc_id, b, bits + 1, {bit} FROM (
            SELECT doc_id, b, bits, CASE WHEN bits % 8 = 0 THEN xor(c, ord(substr(b, bits // 8 + 1, 1))) ELSE c END AS c FROM crc WHERE bits < 8 * length(b))),
        hit AS (SELECT doc_id FROM crc WHERE bits = 8 * length(b) AND xor(c, 4294967295) % 7 = 0),
        d AS (
          SELECT doc_id, lang, {leaf({})} AS leaf, CASE WHEN doc_id IN (SELECT doc_id FROM hit) THEN {leaf({"n_chars": "(n_chars + 1)"})} END AS changed FROM documents),
        p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
        t AS (
          SELECT lang, 0 AS level, list(leaf ORDER BY i) AS l FROM p GROUP BY lang
          UNION ALL SELECT lang, level + 1, {up} FROM t WHERE len(l) > 1),
        s AS (SELECT lang, l[1] AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i FROM t WHERE len(l) = 1),
        r AS (
          SELECT 0 AS level, list(subroot ORDER BY i) AS l FROM s
          UNION ALL SELECT level + 1, {up} FROM r WHERE len(l) > 1),
        low AS (SELECT lang, list(l ORDER BY level) AS levels FROM t WHERE len(l) > 1 GROUP BY lang),
        steps AS (
          SELECT p.doc_id, p.leaf, coalesce(p.changed, p.leaf) AS start, s.subroot,
            list_concat(
              list_transform(coalesce(low.levels, []), lambda v, k: {{'left': (p.i >> (k - 1)) % 2 = 1, 'd': coalesce(v[xor(p.i >> (k - 1), 1) + 1], '')}}),
              list_transform(coalesce((SELECT list(l ORDER BY level) FROM r WHERE len(l) > 1), []), lambda v, k: {{'left': (s.i >> (k - 1)) % 2 = 1, 'd': coalesce(v[xor(s.i >> (k - 1), 1) + 1], '')}})) AS path
          FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang LEFT JOIN low ON p.lang IS NOT DISTINCT FROM low.lang),
        f AS (
          SELECT doc_id, leaf, subroot, path, 0 AS done, start AS acc, row_number() OVER () AS own FROM steps
          UNION ALL SELECT doc_id, leaf, subroot, path, done + 1, sha256(CASE WHEN path[done + 1].left THEN path[done + 1].d || acc ELSE acc || path[done + 1].d END), own FROM f WHERE done < len(path))
        SELECT doc_id, leaf, subroot, top.l[1] AS root, sha256(list_aggregate(list_append(list_transform(path, lambda x: x.d), ''), 'string_agg', '')) AS proof_sha256,
          acc AS folded_root, acc = top.l[1] AS verified
        FROM f, r AS top WHERE len(top.l) = 1 AND done = len(path)
    """


def _clusters_sql(clusters: int = 40, rounds: int = 5, size: int = 64) -> str:
    """A CTE for each round's centroids."""
    parts = [
        f"""v AS MATERIALIZED (
          SELECT row_number() OVER () AS own, vec_id, v, list_inner_product(v, v) AS vv FROM (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0))""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS k, v AS c FROM v ORDER BY k LIMIT {clusters})",
    ]
    near = "SELECT own, arg_min(k, d * 64 + k) AS k, min(d) AS d FROM (SELECT own, k, vv - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS d FROM v, c{n}) GROUP BY own"
    for n in range(rounds):
        parts.append(f"a{n} AS MATERIALIZED ({near.format(n=n)})")
        mean = f"SELECT k, j, floor(sum(x) / count(*)) AS m FROM (SELECT k, unnest(v) AS x, unnest(range({size})) AS j FROM a{n} JOIN v USING (own)) GROUP BY k, j"
        parts.append(f"c{n + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{n} LEFT JOIN (SELECT k, list(m ORDER BY j) AS m FROM ({mean}) GROUP BY k) USING (k))")
    parts.append(f"a{rounds} AS MATERIALIZED ({near.format(n=rounds)})")
    return f"""
        WITH {", ".join(parts)}
        SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
          sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
        FROM a{rounds} JOIN v USING (own) JOIN c{rounds} USING (k)
    """


ORACLE = {
    "op11_merkle_manifest": _manifest_sql(),
    "op12_centroid_clustering": _clusters_sql(),
    "op9_exact_dedup": r"""
        WITH n AS (
          SELECT doc_id, length(coalesce(text, '')) AS chars,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
          FROM documents),
        w AS (
          SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
                 count(*) OVER (PARTITION BY norm) AS group_size
          FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
    """,
    "op10_exact_top_k": r"""
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
    """,
}
