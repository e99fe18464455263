"""Vector index: building, rebuilding, and what is missing from it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Chunk size and overlap of summaries and of full texts.
SUMMARY, FULL = (256, 30), (512, 50)


def missing(docs: DataFrame, indexed: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """Documents that the index does not hold; all of them when it is rebuilt."""
    return docs if indexed is None else docs.join(indexed.select(key), key, "left_anti")


def pieces(docs: DataFrame, sizes: tuple[int, int] = FULL) -> DataFrame:
    """doc_id, chunk_id, chunk of docs (doc_id, title, brief, text)."""
    body = text.join_nonblank("\n\n", F.col("title"), F.col("brief"), F.col("text"))
    cut = docs.select("doc_id", F.posexplode(text.chunk(body, *sizes)).alias("place", "chunk"))
    return cut.select("doc_id", F.format_string("%s#chunk_%d", F.col("doc_id").cast("string"), F.col("place")).alias("chunk_id"), "chunk")


def build(docs: DataFrame, embed: Callable[[list[str]], list[list[float]]], indexed: DataFrame | None = None, sizes: tuple[int, int] = FULL) -> DataFrame:
    """doc_id, chunk_id, chunk, embedding of the documents that are not indexed. docs: doc_id, title, brief, text. The
    embedding function gets a batch of chunks at a time, in tasks."""
    named = pieces(missing(docs, indexed), sizes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(embedding=embed(f.chunk.tolist()) if len(f) else [])

    kind = dict(docs.dtypes)["doc_id"]
    return named.mapInPandas(run, f"doc_id {kind}, chunk_id string, chunk string, embedding array<double>")


def recommend(records: DataFrame, start: str, end: str, threshold: float, chosen: DataFrame, n: int = 10) -> DataFrame:
    """Candidates in a closed period at or above a score that were also chosen, best first. records: id, ts, score; chosen:
    id (what a model picked; ids that are no candidates are dropped)."""
    from . import search

    rows = records.where(search.time_between("ts", start, end) & search.score_at_least(threshold, "score"))
    return rows.join(chosen.select("id").distinct(), "id", "left_semi").orderBy(F.col("score").desc(), "id").limit(n)
