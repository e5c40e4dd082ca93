"""Plan hygiene of every registered query (formatted explain, public API)."""

import pytest
from pyspark.sql import DataFrameWriter

from cohortlake.plans import catalog

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")
#: The one operator with Python on the executors (history thinning).
PYTHON = ("MapInPandas", "MapInArrow", "FlatMapGroups")
NAMES = sorted(catalog.queries())


@pytest.fixture()
def plans(monkeypatch, capsys):
    """The formatted plans of a query: of every table that it writes on its way, and of its result."""
    write = DataFrameWriter.parquet

    def explained(self, path, *args, **kw):
        self._df.explain(mode="formatted")
        return write(self, path, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", explained)

    def of(df_of):
        capsys.readouterr()
        df_of().explain(mode="formatted")
        return capsys.readouterr().out

    return of


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_products_or_row_udfs(spark, plans, name):
    plan = plans(lambda: E.queries()[name](spark, SF))
    for op in FORBIDDEN + PYTHON:
        assert op not in plan, f"{name}: {op} in plan"


def test_written_stages_are_seen(spark, plans):
    plan = plans(lambda: E.queries()["score_all"](spark, SF))
    assert plan.count("== Physical Plan ==") >= 5 and "lineitem" in plan and "events" in plan


def test_momentum_is_a_hash_aggregate(spark, plans):
    plan = plans(lambda: E.queries()["momentum_7d"](spark, SF))
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_scans_are_column_pruned(spark, capsys):
    df = E.queries()["score_all"](spark, SF)
    capsys.readouterr()
    E.queries()["momentum_7d"](spark, SF).explain(mode="formatted")
    plan = capsys.readouterr().out
    # events has six columns; the momentum query needs four of them
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in plan
    assert df.columns
