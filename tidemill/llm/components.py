"""Connected components of a link table, by contraction: nothing is collected, and no node's links meet in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def roots_of(links: DataFrame) -> DataFrame:
    """links(a, b): long node ids. Returns (node, root) for each linked node, root being the smallest node reachable.

    Each round every node hooks to its smallest neighbour, chains of hooks are followed to their end by doubling, and the
    links are renamed to the ends. Only smallest-of-their-surroundings nodes outlive a round, so they halve at least."""
    live = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    names = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
        hooks = cut(hooks)
        while True:  # follow the hooks to nodes that hook to themselves
            upper = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            longer = cut(hooks.join(upper, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            hooks = longer.select("node", "up")
            if longer.where("moved").isEmpty():
                break
        if names is None:
            names = hooks
        else:
            known = names.join(hooks.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left")
            names = cut(known.select("node", F.coalesce("top", "up").alias("up")))
        to = lambda c: hooks.select(F.col("node").alias(c), F.col("up").alias(f"{c}2"))
        moved = live.join(to("a"), "a").join(to("b"), "b").where("a2 <> b2")
        live = cut(moved.select(F.greatest("a2", "b2").alias("a"), F.least("a2", "b2").alias("b")).distinct())
    if names is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return names.select("node", F.col("up").alias("root"))
