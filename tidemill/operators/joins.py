"""Joins between records, hits, clusters and members. Nothing is broadcast by hint here: which side fits is left to the
optimizer's size checks and adaptive execution, except lists that arrive as parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collected(left: DataFrame, right: DataFrame, on: Column, keys: list[str], value: str, name: str) -> DataFrame:
    """left's keys with the sorted values of their matches, comma-separated, and their number. Keys without a match stay."""
    rows = left.join(right, on, "left").groupBy(*keys)
    return rows.agg(F.concat_ws(",", F.sort_array(F.collect_list(value))).alias(name), F.count(value).alias("n"))


def hydrate(hits: DataFrame, docs: DataFrame, hit_key: str, doc_key: str) -> DataFrame:
    """Hits that have a document, with its columns."""
    return hits.join(docs, F.col(hit_key) == F.col(doc_key))


def with_fallback(left: DataFrame, right: DataFrame, left_key: str, right_key: str, fallback: dict) -> DataFrame:
    """left with right's columns, or their fallback where right has no row."""
    out = left.join(right, F.col(left_key) == F.col(right_key), "left").drop(right_key)
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in fallback.items()})


def members(clusters: DataFrame, docs: DataFrame, key: str, lists: str, doc_key: str, offset: int, limit: int, fallback: dict) -> DataFrame:
    """A slice of each cluster's members with their rank from 1 and their documents. limit is 1 to 500, offset 0 or more."""
    first, count = max(0, offset), min(500, max(1, limit))
    rows = clusters.select(key, F.posexplode(F.slice(lists, first + 1, count)).alias("pos", doc_key))
    rows = rows.withColumn("pos", (F.col("pos") + 1 + first).cast("long"))
    out = rows.join(docs, doc_key, "left")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in fallback.items()})


def preferred(left: DataFrame, choices: list[DataFrame], key: str, value: str) -> DataFrame:
    """left with the value of the first choice that has one."""
    names = []
    for i, choice in enumerate(choices):
        names.append(f"_{value}{i}")
        left = left.join(choice.select(key, F.col(value).alias(names[-1])), key, "left")
    return left.withColumn(value, F.coalesce(*names)).drop(*names)


def known_by_either(rows: DataFrame, ids: DataFrame, id_name: str, others: DataFrame, other_name: str) -> DataFrame:
    """Rows known by their id or by another column: two equi-joins, where one join on "or" would compare all pairs."""
    by_id = rows.join(ids, id_name, "left_semi")
    by_other = rows.join(ids, id_name, "left_anti").join(others.select(other_name), other_name, "left_semi")
    return by_id.unionByName(by_other)


def within(left: DataFrame, right: DataFrame, keys: list[str], ts: str, seconds: int) -> DataFrame:
    """Pairs (left, right) that agree on keys and lie at most `seconds` apart. Both sides are cut into time buckets of that
    length, the right side put in three neighbouring ones, so the join is an equi-join on keys and bucket."""
    at = lambda d: F.unix_micros(d[ts].cast("timestamp"))
    width = seconds * 1_000_000
    a = left.select(F.struct(*left.columns).alias("left"), *[left[k] for k in keys], at(left).alias("_a"), F.floor(at(left) / width).alias("_bucket"))
    near = F.explode(F.sequence(F.floor(at(right) / width) - 1, F.floor(at(right) / width) + 1))
    b = right.select(F.struct(*right.columns).alias("right"), *[right[k] for k in keys], at(right).alias("_b"), near.alias("_bucket"))
    return a.join(b, [*keys, "_bucket"]).where(F.abs(F.col("_a") - F.col("_b")) <= width).select("left", "right")


def by_domain(df: DataFrame, domains: DataFrame, host: str, domain: str) -> DataFrame:
    """df with the columns of the longest domain that is its host or a suffix of it. Each host is expanded to its own
    suffixes, a handful, so the join is an equi-join."""
    labels = F.split(F.regexp_replace(F.col(host), r":\d+$", ""), r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    hosts = df.select(host).distinct().select(host, F.explode(suffix).alias(domain))
    best = hosts.join(domains, domain).groupBy(host).agg(F.max_by(F.struct(*domains.columns), F.length(domain)).alias("_d"))
    return df.join(best, host).select("*", *[F.col("_d")[c].alias(c) for c in domains.columns]).drop("_d")
