import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import html_extract, topk

SCHEMA = "vec_id long, embedding array<float>, label int, q string, v string, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k, every):
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in fine:
        if i % every == 0:
            queries[i] = min(v, queries.get(i, v))
    out = []
    for i, q in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i and len(v) == len(q))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_with_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 4)
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.5, -0.1, 0.0, 0.3, 0.9]) for _ in range(4)]) for i in range(120)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(200, 260)]
    rows += [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0]), (303, [float("nan"), 0.0, 0.0, 0.0]), (304, [float("inf"), 0.0, 0.0, 0.0]), (310, [1.0, 2.0]), (None, [1.0] * 4)]
    rows += [(400, [0.0] * 4), (401, [1e3] * 4), (320, [1.0, 2.0]), (330, [0.1, 0.2]), (10, [0.3] * 4)]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 10 == 0, k=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, 5, 10)


def test_top_k_of_few_and_no_rows(spark):
    rows = [(0, [1.0, 1.0]), (1, [1.0, 0.5]), (2, [1.0, 0.5])]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0, k=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, 5, 50)
    assert topk.top_k(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(vectors(spark, [(0, None)]), F.col("vec_id") % 50 == 0).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", "x") for i, u, h in rows], "page_id long, url string, html string, host string, blocks string, text string").repartition(2)


MENU = "<div><a>Home</a> <a>World</a> <a>Sports</a> <a>Tech</a> <a>About</a> <a>Us</a> <a>Mail</a></div>"


def test_main_text(spark):
    rows = [
        (1, "http://a/1", "<html><body><nav>menu</nav><div class='ad'>buy</div><article><h1>T &amp; t</h1><p>One\n two&nbsp;three<br>four<p><b>Five<form>f</form><aside>s</aside></article><footer>f</footer></body></html>"),
        (2, "http://a/2", None),
        (3, None, ""),
        (4, "http://b/1", MENU + "<div>Unique first story</div><div id='comments'>no</div>"),
        (5, "http://b/2", MENU + "<div>Another quite different story</div><script>var a='<p>x</p>';</script>"),
        (6, "http://b/3", MENU + "<div>Unique first story</div><div id='comments'>no</div>"),
        (7, "http://c/1", "<main><p>Kept</p><section class='comments'><article><p>nice</p></article></section></main><p>outside</p>"),
        (8, "http://c/2", "plain <b>text</b> only"),
        (8, "http://c/2", "plain <b>text</b> only"),
        (9, "http://c/3", "<body class='has-sidebar'><div style='overflow: hidden' data-id='ad'>shown</div><div hidden>not</div><!-- c --><style>p{}</style></body>"),
        (10, "http://d/1", "<article><p>" + "long text " * 20000 + "</p></article>"),
        (11, "http://d/2", "<nav>unclosed menu<article><p>still here</p></article>"),
    ]
    got = html_extract.main_text(pages(spark, rows)).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert texts[1] == "T & t\nOne two three four\nFive"
    assert texts[2] == texts[3] == ""
    assert texts[4] == texts[6] == "Unique first story" and texts[5] == "Another quite different story"
    assert texts[7] == "Kept" and texts[8] == "plain text only" and texts[9] == "shown"
    assert texts[10] == ("long text " * 20000).strip() and texts[11] == "still here"
    assert html_extract.main_text(pages(spark, [])).count() == 0


def test_runs_that_few_pages_of_a_large_host_share(spark):
    rare = "<div>one two three four five six seven eight</div>"
    rows = [(i, f"http://big/{i}", f"<div>{' '.join(f'w{i}x{j}' for j in range(8))}</div>" + (rare if i in (3, 1200) else "")) for i in range(1500)]
    texts = {r.page_id: r.text for r in html_extract.main_text(pages(spark, rows)).collect()}
    assert texts == {i: " ".join(f"w{i}x{j}" for j in range(8)) for i in range(1500)}


def test_articles_keep_phrases_and_near_copies_keep_one_text(spark):
    phrase = "at the end of the day we all know"
    story = lambda k: [" ".join(f"s{k}p{p}w{j}" for j in range(30)) for p in range(9)]
    body = lambda parts: MENU + "".join(f"<p>{p}</p>" for p in parts)
    copy, other = story(3), story(3)
    other[4] = other[4].replace("s3p4w7", "changed")
    rows = [
        (1, "http://a/1", body([f"first {phrase} one", *story(1)])),
        (2, "http://a/2", body([f"second {phrase} two", *story(2)])),
        (3, "http://a/3", body(copy)),
        (4, "http://a/4", body(other)),
    ]
    texts = {r.page_id: r.text for r in html_extract.main_text(pages(spark, rows)).collect()}
    assert texts[1] == "\n".join([f"first {phrase} one", *story(1)]) and texts[2] == "\n".join([f"second {phrase} two", *story(2)])
    assert any(all(p in texts[i].split("\n") for p in whole) for i, whole in ((3, copy), (4, other)))


def test_runs_that_most_articles_of_a_host_repeat(spark):
    """A line that most distinct articles repeat goes; copied articles, quotes and lines with tokens of their own stay."""
    line, quote = "read more of our best stories in the evening letter", "a quoted sentence of eight words or a few more"
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    article = lambda *parts: "<article>" + "".join(f"<p>{p}</p>" for p in parts) + "</article>"
    rows = [(i, f"http://a/{i}", article(own(i), line, *([quote] if i % 3 == 0 else [])) if i < 14 else article(own(i))) for i in range(20)]
    rows += [(20 + i, f"http://a/c{i}", article(own(0), line, quote)) for i in range(60)]  # copies count once
    rows += [(100 + i, f"http://b/{i}", article(own(i), line)) for i in range(3)]  # too few to tell
    rows += [(200 + i, f"http://c/{i}", article(own(7), own(8), f"only {i}")) for i in range(8)]  # near copies
    texts = {r.page_id: r.text for r in html_extract.main_text(pages(spark, rows)).collect()}
    for i in range(20):
        assert texts[i] == "\n".join([own(i), *([quote] if i % 3 == 0 and i < 14 else [])])
    assert all(texts[20 + i] == texts[0] for i in range(60)) and all(texts[100 + i] == f"{own(i)}\n{line}" for i in range(3))
    assert all(texts[200 + i] == f"{own(7)}\n{own(8)}\nonly {i}" for i in range(8))


def test_hosts_of_several_parts(spark, monkeypatch):
    """Runs of pages without a marked article are those of the whole host, whatever its parts."""
    rng = random.Random(1)
    shared = [" ".join(f"s{k}w{j}" for j in range(9)) for k in range(12)]
    rows = []
    for i in range(120):
        parts = [f"<p>{' '.join(f'p{i}w{j}' for j in range(12))}</p>", *(f"<div>{rng.choice(shared)}</div>" for _ in range(2))]
        body = "".join(parts) if i % 5 else f"<div>{rng.choice(shared)}</div><article><p>text of {i}</p></article>"
        rows.append((i, f"http://{'ab'[i % 2]}/{i}", body))
    rows += [(200, "http://a/0", rows[2][2]), (201, None, rows[3][2]), (202, "http://a/1", "")]
    whole = {r.page_id: r.text for r in html_extract.main_text(pages(spark, rows)).collect()}
    monkeypatch.setattr(html_extract, "PART_BYTES", 3000)
    assert {r.page_id: r.text for r in html_extract.main_text(pages(spark, rows)).collect()} == whole
    assert whole[1] == " ".join(f"p1w{j}" for j in range(12)) and whole[5] == "text of 5"


@pytest.mark.parametrize("size", [1, 700, 3000])
def test_runs_that_most_articles_of_a_host_of_several_parts_repeat(spark, monkeypatch, size):
    """Which lines most distinct articles repeat is decided by the whole host, whatever its parts, also of one article each."""
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    half, most = "a line that just half of all the articles repeat here", "read more of our best stories in the evening letter"
    article = lambda *parts: "<article>" + "".join(f"<p>{p}</p>" for p in parts) + "</article>"
    rows = [(i, f"http://a/{i}", "<div>menu</div>" * (i % 3) + article(own(i), *([half] if i < 10 else []), *([most] if i >= 9 else []))) for i in range(20)]
    rows += [(20 + i, f"http://a/c{i}", "<div>menu</div>" * (i % 2) + article(own(i % 2), half)) for i in range(40)]  # copies count once
    rows += [(100 + i, f"http://b/{i}", article(own(i), most)) for i in range(4)]  # too few to tell
    rows += [(200 + i, f"http://c/{i}", article(own(7), own(8), f"only {i}")) for i in range(12)]  # near copies
    monkeypatch.setattr(html_extract, "PART_BYTES", size)
    texts = {r.page_id: r.text for r in html_extract.main_text(pages(spark, rows)).collect()}
    assert len(texts) == len(rows)
    for i in range(20):
        assert texts[i] == "\n".join([own(i), *([half] if i < 10 else [])])
    assert all(texts[20 + i] == texts[i % 2] for i in range(40)) and all(texts[100 + i] == f"{own(i)}\n{most}" for i in range(4))
    assert all(texts[200 + i] == f"{own(7)}\n{own(8)}\nonly {i}" for i in range(12))


def test_shared_tokens_equal_brute_force():
    rng = random.Random(0)
    for _ in range(300):
        streams = [[rng.randint(0, 3) for _ in range(rng.randint(0, 15))] for _ in range(rng.randint(1, 5))]
        run = rng.randint(1, 5)
        got = html_extract.shared_tokens(streams, run)
        for a, own in enumerate(streams):
            expected = [False] * len(own)
            for s in range(len(own) - run + 1):
                if any(own[s : s + run] == other[x : x + run] for b, other in enumerate(streams) if b != a for x in range(len(other) - run + 1)):
                    expected[s : s + run] = [True] * run
            assert expected == got[a].tolist()


def test_pages_of_the_test_data(spark):
    """Every page there is one article; its text is the article's lines."""
    import html
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = {r.page_id: r.text for r in html_extract.main_text(rows).collect()}
    for r in rows.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        lines = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert texts[r.page_id] == "\n".join(x for x in lines if x)
