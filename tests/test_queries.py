import duckdb
import pytest

import __spark_entry__ as entry
from loomlake.plans import queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_all_questions_are_answered(spark, duck):
    asked = {r[0] for r in duck.execute("SELECT item_id FROM benchmark").fetchall()}
    got = entry.queries()["qa_end_to_end"](spark, SF).collect()
    assert len(asked) > 5 and sorted(r.query_id for r in got) == sorted(asked) and all(1 <= r.n_docs <= 3 for r in got)


def test_fusion_has_two_routes_for_every_item(spark, duck):
    asked = {r[0] for r in duck.execute("SELECT item_id FROM benchmark").fetchall()}
    routes = queries._routes(spark, SF).groupBy("query_id").agg(F.countDistinct("route").alias("n")).collect()
    assert {r.query_id for r in routes} == asked and all(r.n == 2 for r in routes)
