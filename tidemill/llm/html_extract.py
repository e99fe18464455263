"""Main text of web pages: marked articles, less the runs that suffix arrays over the pages of a host find repeated.

Each page is split into blocks once. Blocks inside a marked article (article, main, articleBody) are its text, less what
is marked inside it as a menu, advert, form, notice, comment and so on. All other visible tokens of a page are its stream.
The pages of a host are dealt to parts of about PART_BYTES of html, and each part has two suffix arrays, through `run`
tokens, over its distinct articles and its distinct streams.

Articles: a block goes that lies whole in runs held by more than half of the host's distinct articles, of which there must
be at least LEAST_ARTICLES: a line that nearly every page repeats is not the article's own. Copied articles and quoted
passages are on fewer pages, and an article that would lose COPY of its tokens or more, or all of them, stays as it is.
Where a host has several parts, each distinct article counts in one of them. A run of more than half of all is one of more than half
in some part: those runs of each part are counted over the whole host.

Pages without a marked article: the marked blocks go, and the blocks that lie whole in runs that distinct streams of the host
share; a block with a token of its own stays as it is. Pages with equal streams count as one page, so a copy does not
erase its original. A page that would lose nearly all its text, a near copy of others, keeps the blocks it is the least
holder of, so one page keeps them. Where such a host has several parts, their suffix arrays are merged: each part gives its
distinct runs with the least and the greatest stream that holds them, which meet by a 128-bit hash of host and run; the runs
that two streams hold go back to the streams by salted keys.

Defined results: null or empty html, or a page without main text: empty text; null url: a host of its own name; repeated
rows repeat their result; rows that repeat a page_id are pages of their own; an empty table gives an empty result. Other
columns are ignored. No page is cut.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, lookup, stored

#: Shortest run of tokens that counts as shared.
RUN = 6
#: Share of its kept tokens that a page must lose to count as a copy of other pages rather than a page with boilerplate.
COPY = 0.8
#: Fewest distinct articles of a part whose repeated runs count.
LEAST_ARTICLES = 5
#: Bytes of html of a host's part, whose suffix arrays one task holds.
PART_BYTES = 2 << 20

#: Elements and attribute words of markup.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NEVER = frozenset(
    "script style noscript template nav footer aside form button select textarea svg math iframe object canvas dialog menu head title audio video".split()
)
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "newsletter subscribe subscription signup social share sharing related recommended recommendations sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead comment comments disqus reply replies respond popup modal overlay widget widgets pagination "
    "pager toolbar login paywall skip".split()
)
HEADERS = frozenset("header topbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Elements whose end tag is often left out; the next block ends them.
OPEN_ENDED = frozenset("p li dd dt option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:script|style)\b[^>]*+>.*?(?:</(?:script|style)\s*>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([^<]++|<)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _marks(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is kept out, is a header, is an article."""
    out, header, main = tag in NEVER, tag == "header", tag in ("article", "main")
    if attributes and tag not in ("html", "body"):
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                out = True
            elif name == "role":
                out |= value.lower() in ROLES
                main |= value.lower() in ("main", "article")
            elif name == "itemprop":
                main |= value.lower() == "articlebody"
            elif name in ("class", "id"):
                words = {w.lower() for w in CAMEL.findall(value)}
                out |= bool(words & WORDS)
                header |= bool(words & HEADERS)
    return out, header, main


def blocks_of(page: str) -> tuple[bool, list[tuple[str, bool]]]:
    """Whether an article is marked, and (text, kept by its marks) of each visible block in page order. If an article is
    marked, the blocks it keeps are the page's main text."""
    parts = [m for m in PART.finditer(page) if m[2] or m[4]]
    closes: dict[str, int] = {}
    for m in parts:
        if m[1]:
            closes[m[2].lower()] = m.start()
    blocks: list[tuple[str, bool, bool]] = []
    text: list[str] = []
    article = 0  # depth of article elements
    article_tags: list[list] = []
    kept_out: list | None = None  # [tag, depth]
    header: list | None = None
    heading = False

    def end_block() -> None:
        if text:
            if words := html.unescape("".join(text)).split():
                keep = kept_out is None and (header is None or bool(article) and heading)
                blocks.append((" ".join(words), keep, bool(article)))
            text.clear()

    for m in parts:
        if m[4]:
            text.append(m[4])
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in BLOCKS or tag in NEVER:
            end_block()
        elif tag in ("br", "td", "th"):
            text.append(" ")
        if closing:
            for state in (kept_out, header):
                if state and state[0] == tag:
                    state[1] -= 1
            if kept_out and kept_out[1] == 0:
                end_block()
                kept_out = None
            if header and header[1] == 0:
                header = None
            if article_tags and article_tags[-1][0] == tag:
                article_tags[-1][1] -= 1
                if article_tags[-1][1] == 0:
                    article_tags.pop()
                    article -= 1
            if tag in HEADINGS:
                heading = False
            continue
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            continue
        out, is_header, main = _marks(tag, m[3])
        if kept_out and (kept_out[0] in OPEN_ENDED and tag in BLOCKS or kept_out[2] and tag in ("article", "main")):
            kept_out = None
        if kept_out:
            kept_out[1] += kept_out[0] == tag
        elif out and not (main and not is_header and tag in ("article", "main") and not article):
            end_block()
            never_closed = closes.get(tag, -1) < m.start()
            kept_out = [tag, 1, never_closed]
        if header:
            header[1] += header[0] == tag
        elif is_header:
            header = [tag, 1]
        if article_tags and article_tags[-1][0] == tag:
            article_tags[-1][1] += 1
        elif main and not kept_out:
            article += 1
            article_tags.append([tag, 1])
        if tag in HEADINGS:
            heading = True
    end_block()
    marked = any(keep and inside for _, keep, inside in blocks)
    return marked, [(t, keep and (inside or not marked), inside) for t, keep, inside in blocks]


class Suffixes:
    """The suffix array, through `run` tokens, of the token streams of distinct pages; runs are its groups of equal suffixes."""

    def __init__(self, pages: list[list[int]], run: int):
        self.run, self.lengths = run, [len(p) for p in pages]
        total = self.total = sum(self.lengths) + len(pages)
        stream = np.empty(total, np.int64)
        top = 1 + max((max(p) for p in pages if p), default=0)
        at, self.starts = 0, []
        for number, tokens in enumerate(pages):
            self.starts.append(at)
            stream[at : at + len(tokens)] = tokens
            stream[at + len(tokens)] = top + number  # separators differ, so no run crosses pages
            at += len(tokens) + 1
        self.owner = np.repeat(np.arange(len(pages)), np.array(self.lengths, np.int64) + 1)
        rank, covered = np.unique(stream, return_inverse=True)[1].astype(np.int64), 1
        while covered < run:  # suffixes are ordered through `covered` tokens; doubling stops at `run`
            step = min(covered, run - covered)
            ahead = np.full(total, -1)
            ahead[: max(0, total - step)] = rank[step:]
            rank = np.unique(rank * (total + 2) + ahead + 1, return_inverse=True)[1].astype(np.int64)
            covered += step
        self.rank = rank  # a suffix's run
        self.order = np.argsort(rank, kind="stable")
        equal, own = rank[self.order], self.owner[self.order]
        new = np.concatenate([[True], equal[1:] != equal[:-1]]) if total else np.zeros(0, bool)
        self.first = np.flatnonzero(new)
        other = new.copy()
        other[1:] |= own[1:] != own[:-1]  # in a run owners ascend
        ends = np.append(self.first[1:], total) - 1 if total else self.first
        self.least, self.most = own[self.first], own[ends]
        self.holders = np.add.reduceat(other.astype(np.int64), self.first) if total else self.first

    def covered(self, hit: np.ndarray) -> list[np.ndarray]:
        """For each stream which tokens lie in a run that starts at a place where hit."""
        change = np.zeros(self.total + self.run + 1, np.int64)
        change[: self.total] += hit
        change[self.run : self.run + self.total] -= hit
        cover = np.cumsum(change)[: self.total] > 0
        return [cover[a : a + n] for a, n in zip(self.starts, self.lengths)]


def shared_tokens(pages: list[list[int]], run: int) -> list[np.ndarray]:
    """For the token streams of distinct pages, which tokens lie in a run of `run` tokens that another stream holds too."""
    found = Suffixes(pages, run)
    return found.covered((found.holders > 1)[found.rank])


def _whole(cover: np.ndarray, blocks: list[str]) -> list[bool]:
    """Whether all tokens of a block are covered."""
    ends = np.cumsum([b.count(" ") + 1 for b in blocks])
    sums = np.append(0, np.cumsum(cover))
    return (sums[ends] - sums[np.append(0, ends[:-1])] == np.diff(ends, prepend=0)).tolist() if blocks else []


def _lost(blocks: list[str], kept: list[bool], gone: list[bool]) -> float:
    """The share of the kept tokens that go."""
    sizes = [b.count(" ") + 1 if keep else 0 for b, keep in zip(blocks, kept)]
    return sum(n for n, g in zip(sizes, gone) if g) / max(1, sum(sizes))


def _numbered(streams: list[list[str]]) -> list[list[int]]:
    """The tokens of each stream's blocks by number."""
    number: defaultdict = defaultdict(count().__next__)
    return [[number[w] for b in blocks for w in b.split(" ")] for blocks in streams]


def _articles(pages: list[list[str]], run: int) -> list[str]:
    """The text of each article of a host, given by its blocks, without what most of the distinct ones repeat."""
    place: dict[str, int] = {}
    texts = ["\n".join(blocks) for blocks in pages]
    at = [place.setdefault(t, len(place)) for t in texts]
    if len(place) < LEAST_ARTICLES:
        return texts
    distinct = [t.split("\n") for t in place]
    found = Suffixes(_numbered(distinct), run)
    often = 2 * found.holders > len(distinct)
    if often.any():
        own = list(place)
        for i, (blocks, cover) in enumerate(zip(distinct, found.covered(often[found.rank]))):
            own[i] = _article(blocks, cover)
        texts = [own[i] for i in at]
    return texts


def _article(blocks: list[str], cover: np.ndarray) -> str:
    """An article's text without the blocks whose tokens are all covered, unless it would lose too much."""
    gone = _whole(cover, blocks)
    stays = not any(gone) or _lost(blocks, [True] * len(blocks), gone) >= COPY
    return "\n".join(b for b, g in zip(blocks, gone) if stays or not g)


def _frequent(host: str, distinct: list[list[str]], run: int) -> list[tuple[bytes, int]]:
    """The runs that more than half of a part's distinct articles hold, and by how many halves more."""
    found = Suffixes(_numbered(distinct), run)
    often = 2 * found.holders > len(distinct)
    out = []
    for at, a, n in zip(found.order[found.first[often]].tolist(), found.least[often].tolist(), found.holders[often].tolist()):
        begin = at - found.starts[a]
        if begin + run <= found.lengths[a]:  # not over the end of an article
            tokens = [w.encode("utf-8", "surrogatepass") for b in distinct[a] for w in b.split(" ")][begin : begin + run]
            out.append((_windows(host.encode(), tokens, run)[0], 2 * n - len(distinct)))
    return out


def _streams(pages: list[tuple[int, list[str], list[bool], bool]], run: int) -> list[str | None]:
    """For each page of a host, given by its stream's hash, blocks, which of them its marks keep, and whether it is open (has no
    marked article): the text of an open one, None for others."""
    own: dict[int, list[str]] = {s: blocks for s, blocks, _, _ in pages}
    order = sorted(own)
    found = Suffixes(_numbered([own[s] for s in order]), run)
    shared = (found.holders > 1)[found.rank]
    every = dict(zip(order, found.covered(shared)))
    later = dict(zip(order, found.covered(shared & (found.least[found.rank] != found.owner))))
    out: list[str | None] = []
    for s, blocks, kept, is_open in pages:
        if not is_open:
            out.append(None)
            continue
        gone = _whole(every[s], blocks)
        if any(gone) and _lost(blocks, kept, gone) >= COPY:
            gone = _whole(later[s], blocks)
        out.append("\n".join(b for b, keep, g in zip(blocks, kept, gone) if keep and not g))
    return out


def _tokens(text: str) -> list[bytes]:
    return [w.encode("utf-8", "surrogatepass") for b in text.split("\n") for w in b.split(" ")]


def _windows(host: bytes, tokens: list[bytes], run: int) -> list[bytes]:
    """A hash of host and window for each window of the stream, in its order."""
    import xxhash

    head = host + b"\0"
    return [xxhash.xxh3_128_digest(head + b" ".join(tokens[i : i + run])) for i in range(len(tokens) - run + 1)]


def _left(host: str, blocks: list[str], kept: list[bool], shared: dict[bytes, bool], run: int) -> str:
    """The kept blocks but those that lie whole in shared windows. shared: window -> whether this stream is its least
    holder; a page that would lose COPY of its kept tokens keeps what it is the least holder of."""
    tokens = [w.encode() for b in blocks for w in b.split(" ")]
    windows = _windows(host.encode(), tokens, run) if shared else []

    def repeated(own: bool) -> list[bool]:
        cover = np.zeros(len(tokens), bool)
        for i, window in enumerate(windows):
            if window in shared and (own or not shared[window]):
                cover[i : i + run] = True
        return _whole(cover, blocks)

    gone = repeated(True)
    if any(gone) and _lost(blocks, kept, gone) >= COPY:
        gone = repeated(False)
    return "\n".join(b for b, keep, g in zip(blocks, kept, gone) if keep and not g)


def _packed(marked: bool, blocks: list[tuple[str, bool, bool]]) -> bytes:
    """A page's blocks with their marks, compressed; blocks hold no line feeds."""
    flags = bytes([marked, *(65 + keep + 2 * inside for _, keep, inside in blocks)])
    return zstandard.ZstdCompressor(level=3).compress(b"\n".join([flags, *(t.encode("utf-8", "surrogatepass") for t, _, _ in blocks)]))


def _unpacked(blob: bytes) -> tuple[bool, list[tuple[str, bool, bool]]]:
    flags, *texts = zstandard.ZstdDecompressor().decompress(blob).split(b"\n")
    return bool(flags[0]), [(t.decode("utf-8", "surrogatepass"), bool(f - 65 & 1), bool(f - 65 & 2)) for t, f in zip(texts, flags[1:])]


def _without_frequent(articles: DataFrame, parts: DataFrame, run: int) -> DataFrame:
    """page_id, url, text of articles (page_id, url, host, text, new), without what most distinct ones of a host of several parts
    repeat. new: whether a row is the first of equal articles; parts: host, number of distinct articles, runs that most hold."""
    odd = F.col("articles") % 2
    hosts = cut(parts.groupBy("host").agg(F.sum("articles").alias("n"), F.sum(odd).alias("odd")).where(F.col("n") >= LEAST_ARTICLES))  # at most a row for each PART_BYTES
    # in a part that doesn't name a run at most half of the articles hold it, less a half of one where their number is odd
    runs = parts.select("host", odd.alias("odd_"), F.explode("runs").alias("r")).groupBy("host", "r.w").agg(F.sum(F.col("r.more") + F.col("odd_")).alias("more"))
    asked = stored(runs.join(hosts, "host").where(F.col("more") > F.col("odd")).select("host", "w", "n"))
    whole = articles.select("page_id", "url", "text")
    if asked.isEmpty():
        return whole

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(list(set(_windows(host.encode(), _tokens(text), run))), pa.binary())], names=["w"])

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for host, text, often in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                often, tokens = set(often), _tokens(text)
                cover = np.zeros(len(tokens), bool)
                for i, window in enumerate(_windows(host.encode(), tokens, run)):
                    if window in often:
                        cover[i : i + run] = True
                texts.append(_article(text.split("\n"), cover))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    first = articles.where("new").join(asked.select("host").distinct(), "host", "left_semi").select("host", "text")
    counted = first.mapInArrow(lean(held), "w binary").join(asked, "w").groupBy("host", "w", "n").agg(F.count(F.lit(1)).alias("held"))
    often = stored(counted.where(2 * F.col("held") > F.col("n")).groupBy("host").agg(F.collect_list("w").alias("often")))
    # a page of another host, or of one of a single part, is done
    changed = articles.where("new is not null").join(often, "host").select("page_id", "url", "host", "text", "often")
    kinds = dict(articles.dtypes)
    settled = changed.mapInArrow(lean(without), f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return articles.join(often, "host", "left_anti").select("page_id", "url", "text").unionByName(settled)


def main_text(pages: DataFrame, run: int = RUN) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    import xxhash

    kinds = dict(pages.dtypes)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    parts = F.ceil(F.sum(F.octet_length("html")) / PART_BYTES).cast("int").alias("parts")
    large = cut(rows.groupBy("host").agg(parts).where("parts > 1"))  # at most a row for each PART_BYTES
    rows = rows.join(F.broadcast(large), "host", "left").select("page_id", "url", "html", "host", F.coalesce("parts", F.lit(1)).alias("parts"), F.xxhash64("page_id", "url", "html"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages with their parts. In a host of several parts an article's hash says its part; a task names each article once, and
        deals its copies, like pages without an article, by their rows."""
        named: set[bytes] = set()
        for batch in batches:
            blobs, articles, dealt = [], [], []
            for page, host_, parts, row in zip(batch.column(2), *(batch.column(i).to_pylist() for i in (3, 4, 5))):
                marked, blocks = blocks_of(page.as_py() or "")
                blobs.append(_packed(marked, blocks))
                article = None
                if parts > 1 and marked:
                    text = "\0".join([host_, "\n".join(t for t, keep, _ in blocks if keep)])
                    article = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
                    article = None if article in named else article
                    named.update([article] if article else [])
                articles.append(article)
                dealt.append((int.from_bytes(article) if article else row) % parts)
            columns = [pa.array(dealt, pa.int32()), pa.array(blobs, pa.binary()), pa.array(articles, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 3, 4)), *columns], names=["page_id", "url", "host", "parts", "part", "page", "article"])

    def decided(group: list[tuple], names: tuple[pa.DataType, pa.DataType], distinct: list[list[str]]) -> pa.RecordBatch:
        """The pages of a part, or of a host of several parts some pages of one. There open pages and articles wait: for these
        hosts streams are given back, texts are whole articles, and new ones, the first of those named, join `distinct`."""
        host_, several = group[0][2], group[0][3] > 1
        found = [_unpacked(page) for *_, page, _, _ in group]
        kept_ = [[t for t, keep, _ in blocks if keep] for marked, blocks in found if marked]
        articles = iter(["\n".join(blocks) for blocks in kept_] if several else _articles(kept_, run))
        texts = [next(articles) if marked else None for marked, _ in found]
        new = [x[7] for x in group] if several else [None] * len(group)
        distinct += [t.split("\n") for t, n in zip(texts, new) if n]
        others = [[(t, keep) for t, keep, inside in blocks if not (marked and inside)] for marked, blocks in found]
        blocks, kept = [[t for t, _ in x] for x in others], [[k for _, k in x] for x in others]
        streams: list = [None] * len(group)
        if several or None in texts:
            streams = [xxhash.xxh3_128_digest("\0".join([host_, " ".join(b)]).encode("utf-8", "surrogatepass")) for b in blocks]
        if not several:
            if None in texts:
                numbers = [int.from_bytes(s[:8], "little", signed=True) for s in streams]
                opened = _streams(list(zip(numbers, blocks, kept, (t is None for t in texts))), run)
                texts = [o if t is None else t for t, o in zip(texts, opened)]
            streams, blocks, kept = ([None] * len(group) for _ in range(3))
        columns = [pa.array([x[0] for x in group], names[0]), pa.array([x[1] for x in group], names[1]), pa.array([host_] * len(group), pa.string())]
        columns += [pa.array(texts, pa.string()), pa.array(streams, pa.binary()), pa.array(blocks, pa.list_(pa.string())), pa.array(kept, pa.list_(pa.bool_()))]
        return closed(columns, pa.array(new, pa.bool_()), [None] * len(group), [None] * len(group))

    def closed(columns: list[pa.Array], new: pa.Array, articles: list, runs: list) -> pa.RecordBatch:
        columns = [*columns, new, pa.array(articles, pa.int64()), pa.array(runs, pa.list_(pa.struct([("w", pa.binary()), ("more", pa.int64())])))]
        return pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "text", "stream", "blocks", "kept", "new", "articles", "runs"])

    def summary(host_: str, distinct: list[list[str]], names: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
        """A row for a part: the number of its distinct articles, and the runs that most of them hold."""
        columns = [*(pa.nulls(1, k) for k in names), pa.array([host_], pa.string()), *(pa.nulls(1, k) for k in (pa.string(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.bool_())))]
        return closed(columns, pa.nulls(1, pa.bool_()), [len(distinct)], [[{"w": w, "more": more} for w, more in _frequent(host_, distinct, run)]])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, names, article, distinct = None, [], (), None, []
        for batch in batches:
            names = batch.column(0).type, batch.column(1).type
            for row in zip(*batch.columns):
                row = tuple(x.as_py() for x in row)
                if now != (row[2], row[4]):
                    if group:
                        yield decided(group, names, distinct)
                    if distinct:
                        yield summary(now[0], distinct, names)
                    now, group, article, distinct = (row[2], row[4]), [], None, []
                group.append((*row, row[6] is not None and row[6] != article))
                article = row[6]
                if row[3] > 1 and len(group) == 100:  # copies of a page may be many more than a part
                    yield decided(group, names, distinct)
                    group = []
        if group:
            yield decided(group, names, distinct)
        if distinct:
            yield summary(now[0], distinct, names)

    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, host string, parts int, part int, page binary, article binary"
    met = rows.mapInArrow(lean(split), schema).repartition("host", "part").sortWithinPartitions("host", "part", "article")
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, host string, text string, stream binary, blocks array<string>, kept array<boolean>"
    all_ = stored(met.mapInArrow(lean(decide), f"{schema}, new boolean, articles long, runs array<struct<w binary, more long>>"), "zstd")
    parsed, parts_ = all_.where("articles is null"), all_.where("articles is not null")
    done = _without_frequent(parsed.where("text is not null").select("page_id", "url", "host", "text", "new"), parts_.select("host", "articles", "runs"), run)
    open_ = parsed.where("text is null")

    def rows_of(ids: list[bytes], *more: tuple[list, pa.DataType, str]) -> pa.RecordBatch:
        halves = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)
        columns = [pa.array(np.ascontiguousarray(halves[:, i])) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(x, k) for x, k, _ in more)], names=["w1", "w2", *(n for *_, n in more)])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct runs of a batch's streams by host, with their least and greatest holder."""
        for batch in batches:
            hosts_: defaultdict = defaultdict(dict)
            for host_, stream, blocks in zip(*(c.to_pylist() for c in batch.columns)):
                hosts_[host_][int.from_bytes(stream[:8], "little", signed=True)] = blocks
            for host_, own in hosts_.items():
                order = sorted(own)
                tokens = [[w.encode() for b in own[s] for w in b.split(" ")] for s in order]
                found = Suffixes(_numbered([own[s] for s in order]), run)
                ids, least, most = [], [], []
                for at, a, b in zip(found.order[found.first].tolist(), found.least.tolist(), found.most.tolist()):
                    begin = at - found.starts[a]
                    if begin + run <= found.lengths[a]:  # not over the end of a stream
                        ids += _windows(host_.encode(), tokens[a][begin : begin + run], run)
                        least.append(order[a])
                        most.append(order[b])
                yield rows_of(ids, (least, pa.int64(), "least"), (most, pa.int64(), "most"))

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host_, stream, blocks in zip(*(c.to_pylist() for c in batch.columns)):
                own = list(set(_windows(host_.encode(), [w.encode() for b in blocks for w in b.split(" ")], run)))
                s = int.from_bytes(stream[:8], "little", signed=True)
                yield rows_of(own, ([stream] * len(own), pa.binary(), "stream"), ([s] * len(own), pa.int64(), "s"))

    # only hosts of several parts that have a page without a marked article need their parts' runs
    hosts = cut(open_.select("host").distinct())
    needed = lookup(parsed.where("stream is not null").select("host", "stream", "blocks"), hosts, "host", F.col("stream"), "inner").select("host", "stream", "blocks")
    held = needed.sortWithinPartitions("host").mapInArrow(lean(windows), "w1 long, w2 long, least long, most long")
    shared = held.groupBy("w1", "w2").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least <> most")
    shared = cut(shared.select(F.struct("w1", "w2").alias("w"), "least"))
    asked = open_.select("host", "stream", "blocks").mapInArrow(lean(asks), "w1 long, w2 long, stream binary, s long")
    asked = asked.select(F.struct("w1", "w2").alias("w"), "stream", "s").distinct()
    found = lookup(asked, shared, "w", F.col("stream"), "inner").select("stream", F.struct("w.w1", "w.w2", (F.col("s") == F.col("least")).alias("own")).alias("w"))
    found = found.groupBy("stream").agg(F.collect_list("w").alias("shared"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for host_, blocks, kept, windows_ in zip(*(batch.column(i) for i in range(2, 6))):
                ids = {np.array([w["w1"], w["w2"]], np.int64).tobytes(): w["own"] for w in windows_.as_py() or ()}
                texts.append(_left(host_.as_py(), blocks.as_py(), kept.as_py(), ids, run))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = lookup(open_, cut(found), "stream", F.struct("page_id", "url")).select("page_id", "url", "host", "blocks", "kept", "shared")
    settled = rows.mapInArrow(lean(settle), f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return done.unionByName(settled).withColumn("n_chars", F.length("text").cast("long"))
