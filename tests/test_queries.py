"""Each query against its SQL on the smallest tables, as the driver compares them."""

import os

import duckdb
import pytest

from tidelog.plans import catalogue

BASE = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("customer", "conversations", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if "datetime" in str(frame[c].dtype):
            frame[c] = frame[c].astype("datetime64[us]")
    return sorted(map(str, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, BASE).toPandas()
    want = duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", ["assignment_by_generation", "idle_members", "ownership_changes"])
def test_generations_are_not_joined_with_members(spark, name):
    plan = catalogue.QUERIES[name](spark, BASE)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_list_topics_asks_a_store(spark, monkeypatch):
    made = []
    create = catalogue.Store.create_topic
    monkeypatch.setattr(catalogue.Store, "create_topic", lambda self, *a: made.append(a) or create(self, *a))
    monkeypatch.setattr(catalogue.Store, "topics", lambda self: spark.createDataFrame([("x", sum(self.topics_by_name.values()))], "name string, partitions int"))
    assert [tuple(r) for r in catalogue.QUERIES["list_topics"](spark, BASE).collect()] == [("x", 29)] and made == catalogue.TOPICS


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, BASE).count() > 0
