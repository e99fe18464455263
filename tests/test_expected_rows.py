"""Queries without SQL against plain versions of their whole results on the small tables."""

import unicodedata
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from tidemill.functions import pages
from tidemill.plans import catalog
from tidemill.sources import feeds

from .conftest import DATA


def column(spark, table, key, *names):
    return {r[0]: r[1:] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key, *names).collect()}


def test_unicode_sanitize_query(spark):
    docs = column(spark, "documents", "doc_id", "text")
    got = {r.doc_id: (r.compat, r.strict) for r in catalog.QUERIES["unicode_sanitize"](spark, DATA).collect()}
    assert set(got) == set(docs)
    for i, (text,) in docs.items():
        if text is None:
            assert got[i] == (None, None)
            continue
        plain = unicodedata.normalize("NFKC", "  Ａﬁ\ufe0f\u200b\U0001f600 " + text).replace("\ufe0f", "").strip()  # variation selectors go
        assert got[i][0] == plain
        # strict: no invisible marks, no emoji; on these texts nothing else goes
        assert got[i][1] == "".join(c for c in plain if c not in "\u200b\U0001f600").strip()


@pytest.mark.parametrize("name, plain", [("main_content", pages.main_part), ("html_markdown", lambda h: pages.convert(h, ["article"], [".ad"], markdown=True))])
def test_page_queries(spark, name, plain):
    """Each page by itself, in its own row; what the functions give is tested on hand-made pages."""
    html = column(spark, "pages", "page_id", "html")
    got = {r.page_id: r.body for r in catalog.QUERIES[name](spark, DATA).collect()}
    assert got == {i: plain(h) for i, (h,) in html.items()} and any(got.values())


HAND_MADE = {
    "<article><h2>Top <b>news</b></h2><p>One  two\n three</p><ul><li>a</li><li>b <a href='/x'>link</a></li></ul></article>": "## Top **news**\n\nOne two three\n\n- a\n- b [link](/x)",
    "<article><p>First<p>Second <span class=ad>buy</span>end<br>line</article><p>outside</p>": "First\n\nSecond end\nline",
    "<div><p>no article</p></div>": "",
    "<article><div><h1>T</h1><p>x &amp; y</p></div><script>var a;</script></article>": "# T\n\nx & y",
}


@pytest.mark.parametrize("html", HAND_MADE)
def test_markdown_of_hand_made_pages(html):
    assert pages.convert(html, ["article"], [".ad"], markdown=True) == HAND_MADE[html]


def test_snapshots_query(spark):
    edges = {tuple(r) for r in catalog.QUERIES["storyline_graph"](spark, DATA).collect()}
    rows = catalog.QUERIES["storyline_snapshots"](spark, DATA).collect()
    assert {(r.source, r.target, r.score) for r in rows if r.source is not None} == edges
    nodes = [r for r in rows if r.node is not None]
    assert {r.node for r in nodes} == {0} | {t for _, t, _ in edges} and {r.state for r in rows} == {"COMPLETED"} and len({r.version for r in rows}) == 1


def test_a_feed_with_marks_in_its_title(spark):
    items = spark.createDataFrame([("g", "a < b & c", "http://h/?a=1&b=2", "d")], "guid string, title string, link string, description string").withColumn("date", F.lit("2024-01-02").cast("timestamp_ntz"))
    root = ET.fromstring(feeds.rss_document("News & <views>", "http://h/?x=1&y=2", items))
    assert root.findtext("channel/title") == "News & <views>" and root.findtext("channel/link") == "http://h/?x=1&y=2" and root.findtext("channel/item/title") == "a < b & c"
