"""Storylines: entities that are common in an era, and the graph that grows from a seed record."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nested
from . import vectors as vector_search

#: Fixed values of the walk.
NODES, CANDIDATES, BRANCHES, RECALL, ACCEPT = 50, 150, 2, 0.5, 0.55
ECHOES = ((1.0, 0.65), (3.0, 0.85))


def stop_entities(docs: DataFrame, until: str, days: int = 30, n: int = 50) -> DataFrame:
    """The n most frequent entities of the days before `until`. docs: ts, people, organizations, locations."""
    end = F.lit(until).cast("timestamp_ntz")
    rows = docs.where((F.col("ts") >= end - F.make_dt_interval(days=F.lit(days))) & (F.col("ts") <= end))
    names = rows.select(F.explode(nested.concat_lists(F.col("people"), F.col("organizations"), F.col("locations"))).alias("entity"))
    names = names.where(F.col("entity").isNotNull() & F.rlike("entity", F.lit(r"^\s*\S+")))
    return names.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "entity").limit(n)


@dataclass
class Storyline:
    nodes: dict = field(default_factory=dict)  # id -> days
    edges: list = field(default_factory=list)  # (source, target, score)
    folded: dict = field(default_factory=dict)  # node -> ids folded into it
    versions: list = field(default_factory=list)  # nodes after each round that accepted some


def _edge(similarity: float, shared: int, days: float) -> float:
    """score.hybrid() of one pair."""
    return 0.6 * similarity + 0.4 * min(shared * 0.5, 1.0) - 0.008 * abs(days)


def _candidates(docs: DataFrame, level: list[int]) -> dict[int, list]:
    """For each node of a level the docs like it (doc_id, day, title, rare, score), CANDIDATES at most."""
    own = docs.where(F.col("doc_id").isin(level)).select("doc_id", "embedding").collect()  # a row a node
    hits = vector_search.search_many(docs.select(F.col("doc_id").alias("vec_id"), "embedding"), {r.doc_id: list(r.embedding) for r in own}, CANDIDATES, RECALL)
    rows = docs.select("doc_id", "day", "title", "rare").join(F.broadcast(hits.withColumnRenamed("vec_id", "doc_id")), "doc_id")  # CANDIDATES a node
    out: dict[int, list] = {}
    for r in rows.collect():
        out.setdefault(r["query"], []).append(r)
    return out


def grow(
    docs: DataFrame, seed: int, stop: list[str], max_depth: int = 3, window_days: float = 7, snapshot: Callable[[Storyline, str], None] | None = None
) -> Storyline:
    """Walks from the seed, a level at a time. docs: doc_id, day (days since the epoch), title, entities, embedding. For all
    nodes of a level at once, NODES at most, one scan of the docs finds the candidates, CANDIDATES for each; so the scans are as
    many as the levels. Accepting and folding depend on the order of acceptance, and stay on the driver with those rows.
    snapshot gets the line and its state after each node that accepted some, and at the end."""
    rare = docs.withColumn("rare", nested.rare(F.col("entities"), stop))
    first = rare.where(F.col("doc_id") == seed).select("day", "rare").first()
    if first is None:
        raise KeyError(seed)
    line = Storyline(nodes={seed: first.day})
    pool, seen, titles = set(first.rare), {seed}, {}
    level, depth = [seed], 0
    while level and depth < max_depth and len(line.nodes) < NODES:
        found = _candidates(rare, level)
        below: list[int] = []
        for now in level:
            if len(line.nodes) >= NODES:
                break
            day, accepted = line.nodes[now], 0
            near = [(_edge(c.score, len(pool & set(c.rare)), c.day - day), c) for c in found.get(now, []) if c.rare is not None and c.day is not None and abs(c.day - day) <= window_days]
            for edge, c in sorted(near, key=lambda x: (-x[0], x[1].doc_id)):
                if accepted == BRANCHES or edge < ACCEPT:
                    break
                if c.doc_id in seen:
                    continue
                seen.add(c.doc_id)
                echo = next((n for n, d in line.nodes.items() if any(abs(c.day - d) <= far and c.score >= like for far, like in ECHOES)), None)
                if echo is not None:
                    if c.title[:15] not in titles.setdefault(echo, set()):
                        titles[echo].add(c.title[:15])
                        line.folded.setdefault(echo, []).append(c.doc_id)
                        pool |= set(c.rare)
                    continue
                line.nodes[c.doc_id] = c.day
                line.edges.append((now, c.doc_id, edge))
                pool |= set(c.rare)
                below.append(c.doc_id)
                accepted += 1
            if accepted:
                line.versions.append(len(line.nodes))
                if snapshot is not None:
                    snapshot(line, "PROCESSING")
        level, depth = below, depth + 1
    if snapshot is not None:
        snapshot(line, verdict(None))
    return line


def snapshot_table(spark: SparkSession, path: str, thread: str) -> Callable[[Storyline, str], None]:
    """A snapshot function that appends each version of a line to a table: thread, version, state, one row for each node (in
    order of time) and each edge. A line has at most NODES nodes."""
    schema = "thread string, version int, state string, node long, day double, source long, target long, score double"
    version = iter(range(1, 1 << 31))

    def keep(line: Storyline, state: str) -> None:
        number = next(version)
        rows = [(thread, number, state, int(n), float(d), None, None, None) for n, d in sorted(line.nodes.items(), key=lambda x: (x[1], x[0]))]
        rows += [(thread, number, state, None, None, int(a), int(b), float(s)) for a, b, s in line.edges]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    return keep


def latest_snapshot(spark: SparkSession, path: str, thread: str) -> DataFrame:
    rows = spark.read.parquet(path).where(F.col("thread") == thread)
    last = rows.agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(last), "version")  # one row


def verdicts(coherence: Column) -> Column:
    """verdict() of a column."""
    return F.when(coherence.isNull() | (coherence >= 5), "COMPLETED").otherwise("REJECTED")


def verdict(coherence: float | None) -> str:
    """State of a finished graph: a missing judgement passes."""
    return "COMPLETED" if coherence is None or coherence >= 5 else "REJECTED"
