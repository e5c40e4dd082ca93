import random

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import rank
from cohortlake.operators.rank import exact_percentiles, minmax_norm, percentile_ranks


def _data(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        cell = rnd.choice(["a", "b", "c"])
        hot = rnd.random() < 0.4
        v = 0.0 if hot else (None if rnd.random() < 0.05 else float(rnd.randint(-50, 400)) / 4)
        w = float(rnd.randint(0, 20))
        rows.append((i, cell, v, w))
    return spark.createDataFrame(rows, "id long, cell string, v double, w double")


def _ranks(df, metrics, cells, **kw):
    out = percentile_ranks(df, metrics, cells, **kw).collect()
    return sorted(tuple(repr(x) for x in r) for r in out)


@pytest.mark.parametrize("hot", [rank.HOT_VALUE_ROWS, 5])
@pytest.mark.parametrize("partitions", [1, 8, 40])
def test_ranged_equals_window(spark, monkeypatch, hot, partitions):
    monkeypatch.setattr(rank, "HOT_VALUE_ROWS", hot)
    df = _data(spark, 1500)
    metrics = {"pr_v": "v", "pr_w": "w"}
    assert _ranks(df, metrics, ["cell"], partitions=partitions) == _ranks(df, metrics, ["cell"], method="window")


def test_odd_distributions_and_keys(spark, monkeypatch):
    """Nine tenths zeros, one huge outlier, -0.0, repeated and NULL ids and cells: every row has its rank."""
    monkeypatch.setattr(rank, "HOT_VALUE_ROWS", 50)
    rnd = random.Random(4)
    rows = [(i % 300 if i % 7 else None, rnd.choice(["a", None]), 0.0 if rnd.random() < 0.9 else rnd.random()) for i in range(900)]
    rows += [(1, "a", 1e300), (1, "a", -1e300), (2, "a", -0.0), (2, "a", None), (None, None, None)]
    df = spark.createDataFrame(rows, "id long, cell string, v double")
    for parts in (1, 16):
        got = _ranks(df, {"pr": "v"}, ["cell"], partitions=parts)
        assert got == _ranks(df, {"pr": "v"}, ["cell"], method="window") and len(got) == len(rows)


def test_groups_span_several_ranges(spark):
    long = spark.range(1000).selectExpr("id % 2 AS g", "double(id) AS _v")
    pos = {(r["g"], r["_v"]): (r["_below"], r["_n"]) for r in rank.value_positions(long, ["g"], partitions=16).collect()}
    assert pos == {(i % 2, float(i)): (i // 2, 500) for i in range(1000)}


def test_rank_semantics(spark):
    df = spark.createDataFrame(
        [(1, "x", 10.0), (2, "x", 20.0), (3, "x", 20.0), (4, "x", 30.0), (5, "x", None), (6, "y", 5.0)],
        "id long, cell string, v double",
    )
    for method in ("window", "ranged"):
        out = {r["id"]: r["pr"] for r in percentile_ranks(df, {"pr": "v"}, ["cell"], method=method).collect()}
        # average rank on ties, denominator counts non-null values only
        assert out[1] == 0.0 and out[2] == out[3] == 0.5 and out[4] == 1.0
        assert out[5] == 0.0  # NULL -> 0
        assert out[6] == 0.0  # singleton cell -> 0


def test_full_cell_average_is_half(spark):
    df = _data(spark, 500, 3).where(F.col("v").isNotNull())
    out = percentile_ranks(df, {"pr": "v"}, ["cell"], partitions=4)
    for r in out.groupBy("cell").agg(F.avg("pr").alias("m")).collect():
        assert abs(r["m"] - 0.5) < 1e-9


def test_exact_percentiles_match_percentile(spark):
    df = _data(spark, 2000, 11)
    got = exact_percentiles(df, "v", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, ["cell"], partitions=8)
    ref = df.groupBy("cell").agg(*[F.percentile("v", p).alias(n) for n, p in [("p50", .5), ("p90", .9), ("p99", .99)]])
    g = {r["cell"]: r for r in got.collect()}
    for r in ref.collect():
        for n in ("p50", "p90", "p99"):
            assert abs(g[r["cell"]][n] - r[n]) < 1e-9


def test_minmax(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 6.0)], "id long, v double")
    out = {r["id"]: r["n"] for r in minmax_norm(df, "v", "n").collect()}
    assert out == {1: 0.0, 2: 0.5, 3: 1.0}


def test_exact_percentile_edges(spark):
    df = spark.createDataFrame(
        [("a", 3.0), ("a", 1.0), ("a", 2.0), ("a", None), ("b", 7.0)], "g string, v double"
    )
    got = {r["g"]: r for r in exact_percentiles(df, "v", {"p0": 0.0, "p50": 0.5, "p100": 1.0, "p25": 0.25}, ["g"]).collect()}
    assert (got["a"]["p0"], got["a"]["p50"], got["a"]["p100"], got["a"]["p25"]) == (1.0, 2.0, 3.0, 1.5)
    assert (got["b"]["p0"], got["b"]["p50"], got["b"]["p100"]) == (7.0, 7.0, 7.0)
