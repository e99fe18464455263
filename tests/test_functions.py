import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions import dates, nested, pages, score, text, vector


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "value, expected",
    [
        ("1684117800", dt.datetime(2023, 5, 15, 2, 30)),
        ("2023-05-15T02:30:00Z", dt.datetime(2023, 5, 15, 2, 30)),
        ("2023-05-15T10:30:00+08:00", dt.datetime(2023, 5, 15, 2, 30)),
        ("2023-05-15 10:30:00", dt.datetime(2023, 5, 15, 2, 30)),
        ("2023-12-31 23:30", dt.datetime(2023, 12, 31, 15, 30)),
        ("05/15/2023 10:30 AM", dt.datetime(2023, 5, 15, 2, 30)),
        ("15 May 2023", dt.datetime(2023, 5, 14, 16, 0)),
        ("2023年05月15日 10时30分00秒", dt.datetime(2023, 5, 15, 2, 30)),
        ("2023-05-15 10:30:00 CST", dt.datetime(2023, 5, 15, 2, 30)),
        ("20230515", dt.datetime(1970, 8, 23, 3, 35, 15)),
        ("InvalidTime", None),
        ("", None),
    ],
)
def test_times_from_text(spark, value, expected):
    got = one(spark, dates.parse_time(F.col("t"), "Asia/Shanghai").cast("timestamp_ntz"), t=value)
    assert got == expected


def test_times_from_digits(spark):
    assert one(spark, dates.from_digits(F.array(*map(F.lit, [2024, 2, 29, 1, 2, 3, 500]))).cast("timestamp_ntz")) == dt.datetime(2024, 2, 29, 1, 2, 3, 500000)
    assert one(spark, dates.from_digits(F.array(*map(F.lit, [2024, 13, 1, 0, 0, 0])))) is None
    assert one(spark, dates.from_digits(F.array(*map(F.lit, [2024, 1, 1])))) is None


def score_by_hand(rates, taxonomy, head, body, similar):
    c = score.ScoreConfig()
    if taxonomy == c.worthless:
        return 0.0
    rate = lambda k: min(10.0, max(0.0, float(rates.get(k, 0))))
    s = sum(rate(k) * w for k, w in c.weights.items()) / (10 * sum(c.weights.values())) * 10 * c.multipliers.get(taxonomy, 1.0)
    new, act, evo = rate(c.novelty), rate(c.action), rate(c.evolution)
    rules = [
        (any(k in head for k in c.recap), 0.35, 3), (any(k in head for k in c.stale), 0.5, 3), (similar >= 0.86 and new <= 3, 0.35, 2.5), (similar >= 0.92 and new <= 2, 0.25, 2),
        (sum(body.count(m) for m in c.markers) >= 5 and new <= 4, 0.55, 3.5), (act <= 2 and new <= 3, 1, 3), (new <= 2 and act <= 2 and evo <= 3, 1, 2),
    ]
    for hit, times, most in rules:
        if hit:
            s = min(s * times, most)
    return min(10.0, max(0.0, s))


def test_intelligence_score(spark):
    rng, c, rows = random.Random(0), score.ScoreConfig(), []
    for _ in range(200):
        rates = {k: rng.randint(-2, 12) for k in c.weights if rng.random() < 0.9}
        rows.append((rates, rng.choice([*c.multipliers, "其他"]), rng.choice(["年度回顾", "旧闻", "plain", ""]), rng.choice(["；；同时第一第二", "plain"]), rng.random()))
    df = spark.createDataFrame(rows, "r map<string,int>, t string, h string, b string, s double")
    got = df.select(score.intelligence_score(F.col("r"), F.col("t"), F.col("h"), F.col("b"), F.col("s"), digits=9)).collect()
    assert [r[0] for r in got] == pytest.approx([score_by_hand(*r) for r in rows])


def test_score_of_a_table_equals_the_expression(spark):
    """Also where the table has columns of any name, among them the score's own."""
    rows = [({"影响深度": 9, "新颖性与异常性": n % 11, "可行动性": n % 4, "演化与连锁潜力": n % 5}, "政治与安全", "plain" if n % 3 else "年度", "；；同时第一第二", n / 40) for n in range(40)]
    df = spark.createDataFrame(rows, "rates map<string,int>, tax string, h string, _score_r0 string, `a.b` double")
    args = [F.col("rates"), F.col("tax"), F.col("h"), F.col("_score_r0"), F.col("`a.b`")]
    got = score.with_intelligence_score(df.withColumn("Score", F.lit(1)), "score", *args, digits=9)
    assert got.columns == [*df.columns, "score"]
    want = df.select(score.intelligence_score(*args, digits=9).alias("score")).collect()
    assert [r.score for r in got.collect()] == [r.score for r in want] == pytest.approx([score_by_hand(*r) for r in rows])


def test_argmax_and_reduction(spark):
    m = F.create_map(*map(F.lit, ["b", 3.0, "a", 3.0, "c", 1.0, "z", 9.0]))
    assert tuple(one(spark, score.argmax(m, ["z"]))) == (3.0, "a")
    assert one(spark, score.argmax(m, ["a", "b", "c", "z"])) is None
    less, gone = score.reduced(m)
    assert one(spark, less) == {"b": 2.0, "a": 2.0, "c": 0.0, "z": 8.0} and one(spark, gone) is False


def test_text_functions(spark):
    assert one(spark, text.strip_think(F.lit("&lt;think&gt;x&lt;/think&gt;a <analysis>\n</analysis>b"))) == "a b"
    assert one(spark, text.strip_fence(F.lit("```json\n{}\n```"))) == "{}"
    assert one(spark, text.looks_foreign(F.lit("政府发表声明称将继续推进"))) is False and one(spark, text.looks_foreign(F.lit("plain words"))) is True
    assert one(spark, text.registrable_domain(F.lit("a.news.example.co.uk"))) == "example.co.uk"
    assert one(spark, text.rewrite_markdown_images(F.lit("![i](http://a/b/c.png)"), "f")) == "![i](f/c.png)"
    assert one(spark, text.is_feed(F.lit("<?xml?><rss>"))) is True


def test_sanitising():
    assert text.sanitize_value("  ﬁ️​x ", 0) == "fi​x"
    assert text.sanitize_value("  ﬁ️​x\U0001f600 ", 0, strict=True, allow_emoji=False) == "fix"
    assert text.sanitize_value(None) is None


def test_chunks():
    rng = random.Random(1)
    body = "\n\n".join(" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 60))) + ". end" for _ in range(20)) + "x" * 700
    pieces = text.chunks_of(body, 200, 30)
    assert all(0 < len(p) <= 200 for p in pieces) and "".join(pieces).count("x") >= 700
    assert set(body.split()) - {body.split()[-1]} <= {w for p in pieces for w in p.split()} | {""}
    assert text.chunks_of("", 10, 2) == [] and text.chunks_of("short", 10, 2) == ["short"]


def test_json(spark):
    for raw in ('{"a": 1}', 'x ```json\n{"a": 1}\n``` y', 'so {"a": 1} done'):
        assert one(spark, nested.json_ladder(F.lit(raw), "$.a")) == "1"
    assert one(spark, nested.json_ladder(F.lit("none"), "$.a")) is None
    assert nested.repaired_value("{a: 1, b: [1, 2,],}") == ('{"a": 1, "b": [1, 2]}', True)
    assert nested.repaired_value('{"a": 1}') == ('{"a": 1}', False) and nested.repaired_value("nothing") == (None, True)


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(1.0))
    assert one(spark, vector.cosine(a, b)) == pytest.approx(0.8) and one(spark, vector.l2(a, b)) == pytest.approx(18**0.5)
    assert one(spark, vector.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None


def test_pages():
    page = "<html><body><div class='header'>H</div><article><p>" + "long enough text " * 5 + "</p><p>short</p><div class='sidebar-x'>s</div></article><script>x</script></body></html>"
    assert pages.main_part(page) == ("long enough text " * 5).strip()
    assert pages.text_of("<p>a<b>b</b></p><style>c</style>") == "a b"
    assert pages.convert("<h2>T</h2><p>a <a href='u'>l</a></p>", [], [], True) == "## T\n\na [l](u)"
    assert pages.links_of("<ul class='b a'><li><a href='/x'>X</a><a href='#'>n</a></ul>", "http://h/") == [("http://h/x", "X", "li")]


def test_html_text_equals_its_sql_on_odd_pages(spark, tmp_path):
    """References without semicolons, comments and scripts that don't end, marks inside texts, white space of all kinds."""
    import random

    import duckdb

    from tidemill.plans import catalog

    parts = "<p>|</p>|<|>|a|b c|&quot|&quot;|&amp;|&amp|&ampquot;|&lt;|&lt|&amp;lt;|&copy;|&copy|&middot;|&#39;|&nbsp;|&|;|<!--|-->|<!-->|<script>|<SCRIPT x='>'>|</script>|</script\t>|<scripts>|<scriptä>|<ſcript>|</ſcript >|<style>|</STYLE>|<br/>|<a title='x > y'>| |\n|\t|\r|\f|\v|\x1c|\u00a0|\u0085|\u2028|ä|中|\U0001f600|token = &quot Are".split("|")
    rng = random.Random(4)
    rows = [(0, "<p>token = &quot Are</p>"), (1, None), (2, ""), (3, " <p> </p> "), (4, "<p>" + " " * 20000 + "x</p>"), (5, "a" + "<" * 20000)]
    rows += [(6 + i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))) for i in range(3000)]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        want = dict(db.execute(catalog.ORACLE["html_text"]).fetchall())
    got = {r.page_id: r.body for r in catalog.QUERIES["html_text"](spark, str(tmp_path)).collect()}
    assert {i: (rows[i][1], got[i], want[i]) for i in want if got[i] != want[i]} == {} and len(got) == len(rows)
    assert got[0] == "token = &quot Are" and got[1] is None


def test_texts_go_to_workers_a_few_at_a_time(spark):
    """Whole texts are not evaluated in Arrow batches of thousands, nor sent back by a judge."""
    from tidemill.plans import catalog

    for name in ("text_chunks", "unicode_sanitize", "judge_evaluation"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "Arrow" not in plan and "InPandas" not in plan, name
