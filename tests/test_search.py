import pytest
from pyspark.sql import functions as F

from tidemill.operators import search
from tidemill.plans import mql


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "active", "Ann", 5, ["a"]), (2, "idle", "Bo", None, None), (3, "active", "Cy", 9, ["b", "c"]), (4, None, "Di (x)", 7, [])]
    return spark.createDataFrame(rows, "id int, status string, name string, score int, tags array<string>").withColumn("author", F.struct("name"))


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.mark.parametrize(
    "spec, found",
    [
        ({}, [1, 2, 3, 4]),
        (None, [1, 2, 3, 4]),
        ({"status": "active"}, [1, 3]),
        ({"status": None}, [4]),
        ({"author.name": "Cy"}, [3]),
        ({"score": {"$gte": 5, "$lte": 7}}, [1, 4]),
        ({"score": {"$exists": False}}, [2]),
        ({"score": {"$ne": 5}}, [2, 3, 4]),
        ({"score": {"$ne": None}}, [1, 3, 4]),
        ({"status": {"$in": ["idle", None]}}, [2, 4]),
        ({"name": {"$regex": "^a", "$options": "i"}}, [1]),
        ({"tags": {"$type": "array"}}, [1, 3, 4]),
        ({"$or": [{"status": "idle"}, {"$and": [{"status": "active"}, {"score": {"$gt": 6}}]}]}, [2, 3]),
    ],
)
def test_filters(people, spec, found):
    assert ids(people.where(mql.compile_filter(spec))) == found


def test_combined_conditions():
    assert mql.combine({}) == {} and mql.combine({"": 1}) == {}
    assert mql.combine({"a": 1}) == {"a": 1}
    assert mql.combine({"a": 1, "b": None}, "or") == {"$or": [{"a": 1}, {"b": None}]}
    with pytest.raises(ValueError):
        mql.combine({"a": 1}, "xor")
    for bad in ({"a": {"$near": 1}}, {"$nor": []}):
        with pytest.raises(ValueError):
            mql.compile_filter(bad)


def test_pipeline_stages(people):
    out = mql.aggregate(people, [{"$unwind": "$tags"}, {"$group": {"_id": "$status", "n": {"$sum": 1}, "all": {"$push": "$tags"}}}, {"$sort": {"_id": 1}}]).collect()
    assert [(r._id, r.n, sorted(r["all"])) for r in out] == [("active", 3, ["a", "b", "c"])]
    assert mql.aggregate(people, [{"$project": {"name": 1}}, {"$limit": 2}]).columns == ["name"]
    with pytest.raises(ValueError):
        mql.aggregate(people, [{"$lookup": {}}])


def test_keywords(people):
    assert ids(people.where(search.keywords_any("ann CY", "name"))) == [1, 3]
    assert ids(people.where(search.keywords_all("di x", "name"))) == [4]
    assert ids(people.where(search.keywords_all("", "name"))) == [1, 2, 3, 4]
    assert ids(people.where(search.keywords_any("(x)", "name"))) == []  # no word boundary outside the brackets
    assert ids(people.where(search.any_of("tags", ["c", "a"]))) == [1, 3]


def test_page_limits(people):
    assert search.page(people, [F.col("id")], skip=0, limit=0).count() == 4
    row = search.page(people, [F.col("id").desc()], skip=1, limit=2).orderBy("pos").collect()
    assert [(r.id, r.pos, r.total) for r in row] == [(3, 2, 4), (2, 3, 4)]


def test_url_dates(spark):
    urls = {"a/2024-01-04.xml": True, "a/2025-November-1.xml": False, "a/2024.xml": True, "a/2023.xml": False, "a/x.xml": True, "a/2024-02-01": False}
    df = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("ok", search.url_date_in_range(F.col("url"), "2024-01-01", "2024-01-31"))
    assert {r.url: r.ok for r in df.collect()} == urls


def test_shell_text():
    assert mql.shell_text("archived", {"a": {"$gte": 1}}) == 'db.archived.find({"a": {"$gte": 1}})'


def test_filters_reach_the_scan(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    where = search.time_between("ts", "2024-01-05", "2024-01-20") & search.score_at_least(40, "value") & mql.compile_filter({"user_id": {"$in": [1, 2]}, "event_type": {"$ne": "view"}})
    plan = rows.where(where).select("event_id")._jdf.queryExecution().explainString(rows.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    for part in ("GreaterThanOrEqual(ts", "LessThanOrEqual(ts", "GreaterThanOrEqual(value", "In(user_id", "Not(EqualTo(event_type"):
        assert part in pushed
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan
