import duckdb
import pytest

from tidemill.llm import queries

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages labels".split()


def plain(df):
    return sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert plain(queries.QUERIES[name](spark, DATA).toPandas()) == plain(con.execute(queries.ORACLE[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES)))
def test_each_row_has_a_result(spark, name):
    table = "pages" if name.startswith("op7_") else "embeddings" if name.startswith(("op10_", "op12_")) else "documents"
    rows = queries.QUERIES[name](spark, DATA)
    if name.startswith("op10_"):
        assert rows.count() == 5 * spark.read.parquet(f"{DATA}/{table}.parquet").where("vec_id % 50 = 0").count()
    else:
        key = rows.columns[0]
        assert rows.select(key).distinct().count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


def test_stored_tables_can_be_cleared(spark):
    from tidemill.llm import common

    kept = common.stored(spark.range(3))
    assert kept.count() == 3
    common.clear_stored(spark)
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0]).count()
