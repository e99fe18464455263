"""Crawls from a configuration: components by name, and the caller's functions for fetching, filtering and handling.

A crawl is three steps over tables: the channels are fetched, addresses are discovered in them, and the articles are fetched
and extracted. Fetching is a function that the caller hands in (address to content); it runs in tasks, and what it raises
stays with its row as an error. Handlers get a table: one of what was extracted, one of what failed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pages
from ..operators import discovery
from . import feeds

Fetch = Callable[[str], str]

#: Components by name: discoverers give rows (channel, url) of rows (channel, url, content), extractors text of HTML.
DISCOVERERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "feed": lambda df: df.select("channel", F.explode(feeds.feed(F.col("content"))["entries"]["link"]).alias("url")),
    "sitemap": lambda df: df.select("channel", F.explode(feeds.sitemap(F.col("content"))["urls"]["loc"]).alias("url")),
    "links": lambda df: df.select("channel", F.explode(pages.links(F.col("content"), F.col("url"))["href"]).alias("url")),
    "article_list": lambda df: _article_links(df),
}
EXTRACTORS: dict[str, Callable[[Column], Column]] = {"main_content": pages.main_content, "text": pages.html_to_text, "raw": lambda c: c}


@dataclass
class Crawl:
    """A configured crawl. article_filter sees an address and its channel; handlers see tables."""

    fetch_feed: Fetch
    fetch_content: Fetch
    discoverer: str = "links"
    extractor: str = "main_content"
    article_filter: Callable[[str, str], bool] | None = None
    content_handler: Callable[[DataFrame], None] | None = None
    exception_handler: Callable[[DataFrame], None] | None = None

    def __post_init__(self) -> None:
        for kind, name, known in (("discoverer", self.discoverer, DISCOVERERS), ("extractor", self.extractor, EXTRACTORS)):
            if name not in known:
                raise ValueError(f"unknown {kind} {name}")

    def run(self, channels: DataFrame) -> DataFrame:
        """channels(channel, url) -> channel, url, text, error: a row for each article, and one for each channel that failed.
        Fetched content is written once, so that nothing is fetched again for the handlers."""
        from .tables import checkpointed

        lists = checkpointed(fetched(channels, self.fetch_feed))
        found = DISCOVERERS[self.discoverer](lists.where("error IS NULL")).where("url IS NOT NULL").distinct()
        if self.article_filter is not None:
            found = found.where(_allowed(self.article_filter)(F.col("url"), F.col("channel")))
        articles = checkpointed(fetched(found, self.fetch_content))
        text = F.when(F.col("error").isNull(), EXTRACTORS[self.extractor](F.col("content")))
        none = F.lit(None).cast("string")
        out = articles.select("channel", "url", text.alias("text"), "error").unionByName(lists.where("error IS NOT NULL").select("channel", "url", none.alias("text"), "error"))
        if self.content_handler is not None:
            self.content_handler(out.where("error IS NULL"))
        if self.exception_handler is not None:
            self.exception_handler(out.where("error IS NOT NULL"))
        return out


def from_config(config: dict, fetchers: dict[str, Fetch]) -> tuple[Crawl, dict[str, str]]:
    """A crawl and its channels (name to address) by a configuration of component names; fetchers by their names. Channels in
    channel_list_filter are left out; what the configuration doesn't name has its default."""
    names = [config.get(key) for key in ("d_fetcher_name", "e_fetcher_name")]
    for name in names:
        if name not in fetchers:
            raise ValueError(f"unknown fetcher {name}")
    handlers = {key: config.get(key) for key in ("article_filter", "content_handler", "exception_handler")}
    parts = {key: config[f"{key}_name"] for key in ("discoverer", "extractor") if f"{key}_name" in config}
    left_out = set((config.get("channel_filter") or {}).get("channel_list_filter") or ())
    channels = {name: url for name, url in (config.get("entry_points") or {}).items() if url not in left_out and name not in left_out}
    return Crawl(fetchers[names[0]], fetchers[names[1]], **parts, **handlers), channels


def fetched(rows: DataFrame, fetch: Fetch) -> DataFrame:
    """rows(channel, url) with content, or the error that fetching raised."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for channel, url in zip(f.channel, f.url):
                try:
                    out.append((channel, url, fetch(url), None))
                except Exception as e:  # noqa: BLE001 - any failure is kept with its row
                    out.append((channel, url, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["channel", "url", "content", "error"])

    return rows.select("channel", "url").mapInPandas(run, "channel string, url string, content string, error string")


def _allowed(keep: Callable[[str, str], bool]):
    @F.pandas_udf("boolean")
    def run(url: pd.Series, channel: pd.Series) -> pd.Series:
        return pd.Series([bool(keep(u, c)) for u, c in zip(url, channel)])

    return run


def _article_links(df: DataFrame) -> DataFrame:
    """The links of the group of each page that looks most like its article list."""
    rows = df.select("channel", F.col("url").alias("page"), "content")
    best = discovery.article_group(discovery.link_groups(rows, "page", "content", "page"), "page").select("page", "signature")
    links = rows.select("channel", "page", F.explode(pages.links(F.col("content"), F.col("page"))).alias("link")).select("channel", "page", "link.href", "link.signature")
    return links.join(best, ["page", "signature"], "left_semi").select("channel", F.col("href").alias("url"))
