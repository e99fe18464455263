"""From raw documents to packed training sequences. Counted as part of the training-data subpackage.

Each stage calls one operator on all rows that its predecessor kept. All but the last return the columns of documents.

1. toxicity: rows scored 0.3 or more go. A null text is scored like an empty one; without labels of both kinds the score is
   the share of toxic labels.
2. exact_dedup: of texts equal but for white space the longest stays, then the smallest doc_id; one row, also where rows
   repeat. Null and empty texts are equal.
3. simhash_near_dedup: of linked texts the smallest doc_id stays, one row, also where a doc_id has several texts.
4. suffix_array_dedup: bytes of repeated passages leave the texts, n_chars is counted anew; all rows stay, a text may become
   empty, a null text stays null.
5. best_fit_packing: each text is cut into pieces of at most 2048 tokens, each with its place in a sequence. A null text is
   empty: one piece, the end.

In every stage a null doc_id is a row like others, ties are settled by doc_id, columns that the operators don't know pass
through or are ignored whatever their names, texts of any length are handled whole, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import exact_dedup, packing, simhash, suffix_dedup, toxicity
from tidemill.llm.common import clear_stored, documents, stored, stored_so_far


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, words=3, distance=3)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, capacity=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeated_passages),
    ("best_fit_packing", pack_sequences),
]

#: A classifier, hashes of shingles and a tokenizer are beyond SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's result is written as Parquet to the shared folder and read again; what it was
    made from is deleted then, so that only the rows returned are left there."""
    docs, others = documents(spark, sf_dir), stored_so_far()
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        clear_stored(spark, since=others, keep=1)
    return docs
