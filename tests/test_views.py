"""The fixture views and the page checks at scale: each input is read, each view built and each value computed once."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cohortlake.plans import catalog, catalog_state
from cohortlake.sources import fixtures, pages

DAY = datetime(2001, 3, 4)


@pytest.fixture()
def tables(spark, tmp_dir):
    """Customer 1 has three orders, 2 has lines without a part, 3 has nothing; keys repeat and are null."""
    rows = {
        "customer": ([(1, "a", 5.0, "AUTO"), (2, "b", -1.0, "MACHINERY"), (3, "c", 0.0, None)], "c_custkey long, c_name string, c_acctbal double, c_mktsegment string"),
        "orders": ([(10, 1, 1000.0, DAY), (11, 1, 10.0, DAY), (12, 1, 5.0, None), (20, 2, 7.0, DAY), (30, None, 7.0, DAY)], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp"),
        "lineitem": (
            [(10, 100, 7, "O", DAY), (10, 101, 7, "F", DAY), (11, 100, 8, None, None), (12, 102, None, "F", DAY), (20, None, 9, "O", DAY), (20, 999, 9, "O", DAY), (30, 100, 1, "O", DAY), (77, 100, 1, "O", DAY)],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linestatus string, l_shipdate timestamp",
        ),
        "part": ([(100, "red nut"), (100, "red bolt"), (101, "blue"), (102, None), (None, "none")], "p_partkey long, p_name string"),
        "documents": ([(1, "Text")], "doc_id long, text string"),
        "events": ([(1, DAY, 0, "view", 2.5)], "event_id long, ts timestamp, user_id long, event_type string, value double"),
    }
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(os.path.join(tmp_dir, f"{name}.parquet"))
    return tmp_dir


@pytest.mark.parametrize("large", [50_000, 1])
def test_lines_meet_once_whatever_the_size_of_a_customer(spark, tables, monkeypatch, large):
    monkeypatch.setattr(fixtures, "LARGE_ORDERS", large, raising=False)
    view = fixtures.repos_view(spark, tables)
    plan = view._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linestatus#") > 0 and plan.count("Relation [l_orderkey#") == 1  # was read and joined twice
    got = {r["id"]: r for r in view.collect()}
    cols = ("forks", "open_issues", "closed_issues", "contributors_count", "topics")
    assert [got[1][c] for c in cols] == [4, 1, 2, 2, ["blue", "bolt", "nut", "red"]]
    assert [got[2][c] for c in cols] == [2, 2, 0, 1, None]
    assert [got[3][c] for c in cols] == [0, 0, 0, None, None]
    assert len(got) == 3


@pytest.mark.parametrize("name", ["run_counters", "apply_batch_snapshots", "light_update", "survivor_snapshots"])
def test_a_query_builds_each_view_once(spark, tables, monkeypatch, name):
    seen = []
    for view in ("repos_view", "snapshots_view"):
        build = getattr(catalog, view)
        monkeypatch.setattr(catalog, view, lambda *a, v=view, b=build: seen.append(v) or b(*a))
    catalog.queries()[name](spark, tables).collect()
    assert sorted(seen) == ["repos_view", "snapshots_view"]


def test_the_type_of_a_member_is_asked_for_once():
    for of in (pages._count, pages._flag, pages._time):
        assert str(of(F.col("v"))).count("schema_of_variant") == 1


def test_state_is_written_before_it_is_read_twice(spark, tables, monkeypatch):
    given = []
    apply_batch = catalog_state.st.apply_batch
    monkeypatch.setattr(catalog_state.st, "apply_batch", lambda state, *a, **kw: given.append(state) or apply_batch(state, *a, **kw))
    assert catalog.queries()["apply_batch"](spark, tables).count() == 2
    assert "Join" not in given[0]._jdf.queryExecution().optimizedPlan().toString()
