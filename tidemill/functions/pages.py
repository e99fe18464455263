"""Page functions that need a parser, as Arrow-batched pandas UDFs over the standard library's HTML parser."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("script style".split())
#: Elements whose start ends an open paragraph, and those that may be open inside it.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
INLINE = frozenset("a abbr b cite code em font i label mark q s small span strong sub sup u".split())
#: What marks boilerplate in a class or id, and in a paragraph.
CLUTTER = ("ad", "menu", "footer", "recommend", "related", "sidebar")
NOTICES = ("声明", "版权", "免责声明", "推荐阅读", "相关文章")

#: What readable() takes for content and for none, and what tags are worth.
LIKELY = frozenset("article articlebody body column content entry hentry main page post story text blog".split())
UNLIKELY = frozenset("ad ads advert banner breadcrumb combx comment comments community contact disqus extra foot footer footnote header masthead media menu meta nav navbar pager pagination popup promo related rss share shoutbox sidebar sponsor tags tool widget".split())
TAG_WORTH = {"div": 5, "article": 8, "main": 5, "section": 2, "pre": 3, "td": 3, "blockquote": 3, "form": -3, "ul": -3, "ol": -3, "li": -3, "dl": -3, "address": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "th": -5}
BLOCKS = frozenset("a article blockquote div dl img ol p pre section table ul".split())
SKIPPED = UNSEEN | {"nav", "aside", "footer", "header", "form", "noscript", "button"}
PARAGRAPH = 25


class Node:
    """An element: tag, attributes, children (elements and texts)."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def texts(self):
        for child in self.children:
            if isinstance(child, str):
                yield child
            elif child.tag not in UNSEEN:
                yield from child.texts()

    def text(self, separator: str = "") -> str:
        return separator.join(t.strip() for t in self.texts() if t.strip())

    def words(self, name: str) -> list[str]:
        return (self.attrs.get(name) or "").split()


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:  # a block ends a paragraph that is open, and what is open in it
            at = self.now
            while at.parent and at.tag in INLINE:
                at = at.parent
            if at.tag == "p":
                self.now = at.parent
        node = Node(tag, dict(attrs), self.now)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def handle_endtag(self, tag):
        at = self.now
        while at.parent and at.tag != tag:
            at = at.parent
        if at.parent:
            self.now = at.parent

    def handle_data(self, data):
        self.now.children.append(data)


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def text_of(html: str | None) -> str:
    return parse(html).text(" ")


def matches(node: Node, selector: str) -> bool:
    """tag, .class, #id, or tag.class and tag#id."""
    for mark, attr in (("#", "id"), (".", "class")):
        if mark in selector:
            tag, _, name = selector.partition(mark)
            return (not tag or node.tag == tag) and name in node.words(attr)
    return node.tag == selector


def convert(html: str | None, selectors: list[str], exclude: list[str], markdown: bool = False) -> str:
    """Text or simple Markdown of the selected elements (all, if none is given) without the excluded ones."""
    root = parse(html)
    chosen = [n for n in root.walk() if any(matches(n, s) for s in selectors)] if selectors else [root]
    lines: list[str] = []

    def render(node: Node) -> str:
        out = []
        for child in node.children:
            if isinstance(child, str):
                out.append(" ".join(child.split()) + (" " if child[-1:].isspace() else ""))
            elif child.tag in UNSEEN or any(matches(child, s) for s in exclude):
                continue
            elif not markdown:
                out.append(" " + render(child) + " ")
            elif child.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                out.append(f"\n\n{'#' * int(child.tag[1])} {render(child).strip()}\n\n")
            elif child.tag in ("p", "div", "article", "section"):
                out.append(f"\n\n{render(child).strip()}\n\n")
            elif child.tag == "li":
                out.append(f"\n- {render(child).strip()}")
            elif child.tag in ("b", "strong"):
                out.append(f"**{render(child).strip()}**")
            elif child.tag == "a":
                out.append(f"[{render(child).strip()}]({child.attrs.get('href') or ''})")
            elif child.tag == "br":
                out.append("\n")
            else:
                out.append(render(child))
        return "".join(out)

    for node in chosen:
        body = render(node)
        if markdown:
            while "\n\n\n" in body:
                body = body.replace("\n\n\n", "\n\n")
            lines.append(body.strip())
        else:
            lines.append(" ".join(body.split()))
    return "\n".join(x for x in lines if x)


def _marks(node: Node) -> set[str]:
    return {w for name in ("class", "id") for w in (node.attrs.get(name) or "").lower().replace("-", " ").replace("_", " ").split()}


def link_density(node: Node) -> float:
    """Share of an element's text that is inside links."""
    whole = len(node.text())
    return sum(len(n.text()) for n in node.walk() if n.tag == "a") / whole if whole else 0.0


def readable(root: Node) -> list[Node]:
    """The elements that hold a page's main text, by the scores of its paragraphs.

    A paragraph of PARAGRAPH characters or more is worth one, one more for each comma, and one for each 100 characters, three at
    most. Its parent gets all of that, the parent's parent half, on top of what their own tag, class and id are worth; a
    candidate keeps the share that isn't links. The best candidate is joined by those of its siblings that have a fifth of its
    score, or are long paragraphs with few links. Elements that a class or id marks as no content take no part."""
    score: dict[int, float] = {}
    nodes: dict[int, Node] = {}

    def skipped(node: Node | None) -> bool:
        while node is not None:
            if node.tag in SKIPPED or _marks(node) & UNLIKELY and not _marks(node) & LIKELY and node.tag not in ("body", "article"):
                return True
            node = node.parent
        return False

    def worth(node: Node) -> float:
        marks = _marks(node)
        return TAG_WORTH.get(node.tag, 0) + 25 * bool(marks & LIKELY) - 25 * bool(marks & UNLIKELY)

    def paragraph(node: Node) -> bool:
        return node.tag in ("p", "pre", "td") or node.tag == "div" and not any(n.tag in BLOCKS for n in node.walk())

    for node in root.walk():
        if not paragraph(node) or node.parent is None or skipped(node):
            continue
        text = node.text(" ")
        if len(text) < PARAGRAPH:
            continue
        value = 1 + sum(text.count(c) for c in ",，、") + min(len(text) // 100, 3)
        for above, share in ((node.parent, 1.0), (node.parent.parent, 0.5)):
            if above is not None:
                if id(above) not in score:
                    score[id(above)], nodes[id(above)] = worth(above), above
                score[id(above)] += value * share
    if not score:
        return []
    final = {k: s * (1 - link_density(nodes[k])) for k, s in score.items()}
    best = nodes[max(final, key=final.get)]  # of equal ones the first that a paragraph named
    limit = max(10.0, 0.2 * final[id(best)])
    if best.parent is None:
        return [best]
    out = []
    for child in best.parent.children:
        if isinstance(child, str):
            continue
        long = child.tag == "p" and len(child.text(" ")) > 80 and link_density(child) < 0.25
        if child is best or final.get(id(child), 0) >= limit or long and not skipped(child):
            out.append(child)
    return out


def main_part(html: str | None) -> str:
    """Text of the page's content: what readable() finds, or where that has less than 200 characters the article, else a
    content element, else the longest div over 100 characters, else all; without clutter, paragraphs under 50 characters and
    notices."""
    root = parse(html)
    parts = readable(root)
    if sum(len(n.text()) for n in parts) >= 200:
        found = Node("", {}, None)
        found.children = list(parts)
    else:
        found = next((n for n in root.walk() if n.tag == "article"), None)
        found = found or next((n for n in root.walk() if n.tag == "div" and ("content" in n.words("class") or n.attrs.get("id") == "content")), None)
    if found is None:
        longest = max((n for n in root.walk() if n.tag == "div"), key=lambda n: len(n.text()), default=None)
        found = longest if longest is not None and len(longest.text()) > 100 else root

    def keep(node: Node) -> bool:
        marks = _marks(node)
        if any(c == m or m == c + "s" or (len(c) > 2 and m.startswith(c)) for c in CLUTTER for m in marks):
            return False
        if node.tag == "p" and not any(n.tag == "p" for n in node.walk()):
            body = node.text()
            return len(body) >= 50 and not any(w in body.lower() for w in NOTICES)
        return node.tag not in UNSEEN

    def prune(node: Node) -> None:
        node.children = [c for c in node.children if isinstance(c, str) or keep(c)]
        for child in node.children:
            if isinstance(child, Node):
                prune(child)

    prune(found)
    return found.text(" ")


def quality_features(html: str | None, keywords: list[str]) -> tuple:
    root = parse(html)
    nodes = list(root.walk())
    tags = {n.tag for n in nodes}
    whole = root.text()
    lower = " ".join(root.texts()).lower()
    container = bool(tags & {"main", "article"}) or any(matches(n, s) for n in nodes for s in ("div#content", "div.container"))
    loading = "noscript" in tags or any(matches(n, "div.loading") for n in nodes)
    return {"html", "body"} <= tags, container, len(whole), len(nodes), loading, lower, sum(k.lower() in lower for k in keywords)


def quality(html: Column, keywords: list[str] | None = None) -> Column:
    """struct(valid, score, blocked): 100 less 40 without html and body, 30 without a main container, 25 for sparse text,
    50 for a wall against robots, 20 for placeholders, up to 15 for missing keywords. Valid from 70 on, unless blocked."""
    wanted = keywords or []

    @F.pandas_udf("valid boolean, score double, blocked boolean")
    def run(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for page in pages:
            whole, container, length, tags, loading, lower, found = quality_features(page, wanted)
            blocked = any(p in lower for p in ("enable javascript", "access denied", "cloudflare security", "captcha"))
            score = 100.0 - 40 * (not whole) - 30 * (not container) - 50 * blocked - 20 * loading
            score -= 25 * (tags > 0 and length / max(1, tags) < 0.3)
            if wanted and found / len(wanted) < 0.6:
                score -= 15 * (1 - found / len(wanted))
            rows.append((score >= 70 and not blocked, max(score, 0.0), blocked))
        return pd.DataFrame(rows, columns=["valid", "score", "blocked"])

    return run(html)


def links_of(html: str | None, base: str) -> list[tuple[str, str, str]]:
    """(address, text, signature of the parent) of each distinct link of a page."""
    out: dict[str, tuple] = {}
    for node in parse(html).walk():
        href = (node.attrs.get("href") or "").strip() if node.tag == "a" else ""
        if not href or href.startswith(("#", "javascript:")):
            continue
        parent = node.parent
        classes = sorted(parent.words("class")) if parent else []
        signature = "body" if parent is None or parent.tag in ("", "body") else ".".join([parent.tag, *classes])
        out.setdefault(urljoin(base, href), (node.text(), signature))
    return [(href, text, signature) for href, (text, signature) in out.items()]


def links(html: Column, url: Column) -> Column:
    @F.pandas_udf("array<struct<href:string,text:string,signature:string>>")
    def run(pages: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([[{"href": h, "text": t, "signature": s} for h, t, s in links_of(p, u or "")] for p, u in zip(pages, urls)])

    return run(html, url)


def html_to_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(text_of)

    return run(html)


def html_convert(html: Column, selectors: list[str], exclude: list[str], markdown: bool = False) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: convert(p, selectors, exclude, markdown))

    return run(html)


def main_content(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(main_part)

    return run(html)
