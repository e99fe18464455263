"""RSS and Atom feeds, sitemaps."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pages import text_of

ENTRY = "struct<title:string,link:string,published:string,authors:array<string>,description:string,guid:string,categories:array<string>,media:array<string>>"
FEED = f"struct<title:string,link:string,description:string,language:string,entries:array<{ENTRY}>,errors:array<string>,fatal:boolean>"


def _name(node) -> str:
    return node.tag.rpartition("}")[2]


def _text(node, *names: str) -> str:
    for child in node:
        if _name(child) in names and (child.text or "").strip():
            return child.text.strip()
    return ""


def _link(node) -> str:
    for child in node:
        if _name(child) == "link" and child.get("rel", "alternate") == "alternate":
            return child.get("href") or (child.text or "").strip()
    return ""


def parse_feed(xml: str | None) -> dict:
    """A feed with its defaults: language zh-cn, title Untitled; a broken feed has no entries and is fatal."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError as error:
        return {"title": "", "link": "", "description": "", "language": "zh-cn", "entries": [], "errors": [str(error)], "fatal": True}
    channel = next((c for c in root.iter() if _name(c) == "channel"), root)
    entries = []
    for item in (e for e in root.iter() if _name(e) in ("item", "entry")):
        authors = [(_text(a, "name") or (a.text or "")).strip() for a in item if _name(a) in ("author", "creator")]
        media = [m.get("url") for m in item if (_name(m) == "content" or _name(m) == "enclosure" and (m.get("type") or "").startswith(("image/", "video/", "audio/"))) and m.get("url")]
        entries.append(
            {
                "title": _text(item, "title") or "Untitled",
                "link": _link(item),
                "published": _text(item, "pubDate", "published", "updated"),
                "authors": [a for a in authors if a],
                "description": text_of(_text(item, "description", "summary")),
                "guid": _text(item, "guid", "id"),
                "categories": [c.get("term") or (c.text or "").strip() for c in item if _name(c) == "category"],
                "media": media,
            }
        )
    return {
        "title": _text(channel, "title"), "link": _link(channel), "description": _text(channel, "description", "subtitle"),
        "language": _text(channel, "language") or "zh-cn", "entries": entries, "errors": [], "fatal": False,
    }


def feed(xml: Column) -> Column:
    @F.pandas_udf(FEED)
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_feed(v) for v in values], columns=["title", "link", "description", "language", "entries", "errors", "fatal"])

    return run(xml)


def feed_items(articles: DataFrame) -> DataFrame:
    """title, link, description, guid, date of articles that have a brief and a uuid: the title falls back to the brief,
    the date to 1970-01-01."""
    rows = articles.where("brief IS NOT NULL AND brief <> '' AND uuid IS NOT NULL")
    return rows.select(
        F.coalesce(F.nullif("title", F.lit("")), "brief").alias("title"), "link", F.col("brief").alias("description"), F.col("uuid").alias("guid"),
        F.coalesce("published", F.lit("1970-01-01").cast("timestamp_ntz")).alias("date"),
    )


def join_url(base: Column, path: Column) -> Column:
    """Two parts with one slash between."""
    return F.concat_ws("/", F.regexp_replace(base, r"/$", ""), F.regexp_replace(path, r"^/", ""))


def rss_items(items: DataFrame) -> DataFrame:
    """The <item> element of each feed item; what is null is left out."""
    safe = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts = [F.concat(F.lit(f"<{tag}>"), safe(F.col(name)), F.lit(f"</{tag}>")) for tag, name in (("title", "title"), ("link", "link"), ("description", "description"), ("guid", "guid"))]
    date = F.concat(F.lit("<pubDate>"), F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss +0000"), F.lit("</pubDate>"))
    return items.select("guid", F.concat(F.lit("<item>"), *[F.coalesce(p, F.lit("")) for p in [*parts, date]], F.lit("</item>")).alias("item"))


def rss_document(title: str, link: str, items: DataFrame, n: int = 100) -> str:
    """A feed of the newest n items."""
    newest = items.orderBy(F.col("date").desc(), "guid").limit(n)
    body = "".join(r.item for r in rss_items(newest).collect())  # n items
    return f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{escape(title)}</title><link>{escape(link)}</link>{body}</channel></rss>'


SITEMAP = "struct<kind:string,urls:array<struct<loc:string,lastmod:string>>>"


def parse_sitemap(xml: str | None) -> dict:
    """kind index, leaf or invalid, and the addresses."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return {"kind": "invalid", "urls": []}
    urls = [{"loc": _text(n, "loc"), "lastmod": _text(n, "lastmod") or None} for n in root if _name(n) in ("url", "sitemap")]
    return {"kind": "index" if _name(root) == "sitemapindex" else "leaf", "urls": [u for u in urls if u["loc"]]}


def sitemap(xml: Column) -> Column:
    @F.pandas_udf(SITEMAP)
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_sitemap(v) for v in values], columns=["kind", "urls"])

    return run(xml)


def validity(xml: Column, fetched: Column) -> Column:
    """valid, invalid, or error where nothing was fetched."""
    from ..functions.text import is_feed

    return F.when(~F.coalesce(fetched, F.lit(False)), "error").when(is_feed(xml), "valid").otherwise("invalid")
