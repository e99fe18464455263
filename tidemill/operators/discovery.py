"""Finding articles: link groups of list pages, sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pages

#: Words in a group's signature and texts.
GOOD_NAMES = ("article", "post", "item", "entry", "headline", "title", "feed", "story")
GOOD_TAGS = ("h2", "h3")
BAD_NAMES = ("nav", "menu", "header", "foot", "copyright", "sidebar", "aside", "widget", "ad", "meta", "tag", "category")
BAD_TEXTS = ("关于我们", "联系我们", "首页", "隐私政策", "home", "about", "contact", "privacy")
#: Addresses of a sitemap level that are sent to all tasks.
LEVEL = 100_000


def link_groups(df: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """Each page's links by the signature of their parent: n and the first five."""
    links = F.explode(pages.links(F.col(html), F.col(url))).alias("link")
    rows = df.select(key, links).select(key, "link.*")
    groups = rows.groupBy(key, "signature").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("href", "text")).alias("samples"))
    return groups.withColumn("samples", F.slice(F.sort_array("samples"), 1, 5))  # a page bounds its links


def _holds(text: Column, words: tuple) -> Column:
    out = F.lit(False)
    for w in words:
        out |= F.contains(text, F.lit(w))
    return out


def article_group(groups: DataFrame, key: str, least: int = 3) -> DataFrame:
    """The group of each page that looks most like its article list, if its score is above zero."""
    name = F.lower("signature")
    mean = F.aggregate("samples", F.lit(0.0), lambda a, s: a + F.length(s["text"])) / F.size("samples")
    score = F.col("n") + 30 * _holds(name, GOOD_NAMES).cast("int") + 15 * _holds(name, GOOD_TAGS).cast("int") - 50 * _holds(name, BAD_NAMES).cast("int")
    score += F.when(mean > 10, 15).when(mean < 5, -10).otherwise(0)
    score -= 30 * F.exists("samples", lambda s: _holds(F.lower(s["text"]), BAD_TEXTS)).cast("int")
    scored = groups.where(F.col("n") >= least).withColumn("score", score)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "signature"))
    return scored.withColumn("_place", place).where("_place = 1 AND score > 0").drop("_place")


def sitemap_walk(edges: DataFrame, start: list[str], most: int = 5000) -> DataFrame:
    """Addresses reachable from the start over (parent, child), breadth first, with their depth. Stops after the level on
    which `most` addresses are known."""
    from ..sources.tables import checkpointed

    spark = edges.sparkSession
    found = frontier = spark.createDataFrame([(s, 0) for s in start], "url string, depth int")
    depth, size = 0, len(start)
    while True:
        depth += 1
        # of both tables only the level is ever sent to all tasks
        level = F.broadcast(frontier) if size <= LEVEL else frontier.hint("shuffle_hash")
        ahead = level.join(edges, frontier.url == edges.parent).select(F.col("child").alias("url")).distinct()
        frontier = checkpointed(ahead.join(found, "url", "left_anti").withColumn("depth", F.lit(depth)))
        size = frontier.count()
        if not size:
            return found
        found = checkpointed(found.unionByName(frontier))
        if found.count() >= most:
            return found
