"""Reading old files, quarantined nodes, slices within the cap, approximate percentiles."""

import json
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.operators.rank import approx_percentiles, percentile_bounds
from cohortlake.operators.slices import SAFETY, slice_plan
from cohortlake.schemas import QUARANTINE_SCHEMA
from cohortlake.sources import pages as P
from cohortlake.sources.store import read_appended
from cohortlake.sources.tables import read_evolved, widens
from cohortlake.streaming.ingest import process_batch

DECLARED = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.DoubleType()), T.StructField("ok", T.BooleanType())])


def test_old_files_take_defaults_and_wider_types(spark, tmp_dir):
    spark.sql("SELECT 1 AS k, 5S AS n").write.parquet(f"{tmp_dir}/a")
    spark.sql("SELECT 2L AS k, CAST(NULL AS FLOAT) AS n, true AS ok, 'x' AS more").write.parquet(f"{tmp_dir}/b")
    # files of one folder are merged by name: the first lacks ok
    spark.sql("SELECT 3L AS k, 1.5D AS n").write.parquet(f"{tmp_dir}/c")
    spark.sql("SELECT 4L AS k, 2.5D AS n, false AS ok").write.mode("append").parquet(f"{tmp_dir}/c")
    folders = [f"{tmp_dir}/{x}" for x in "abc"]
    df = read_evolved(spark, folders, DECLARED, {"ok": True})
    assert df.schema.simpleString() == DECLARED.simpleString()
    # absent from a folder: the default; present or absent from a file: what mergeSchema reads
    assert sorted(tuple(r) for r in df.collect()) == [(1, 5.0, True), (2, None, True), (3, 1.5, None), (4, 2.5, False)]
    kept = {r["k"]: r["more"] for r in read_evolved(spark, folders, DECLARED, keep_extra=True).collect()}
    assert kept == {1: None, 2: "x", 3: None, 4: None}
    with pytest.raises(ValueError):
        read_evolved(spark, [], DECLARED)


def test_a_narrowed_type_is_an_error(spark, tmp_dir):
    spark.sql("SELECT 'one' AS k").write.parquet(f"{tmp_dir}/a")
    with pytest.raises(ValueError, match="k: string"):
        read_evolved(spark, [f"{tmp_dir}/a"], DECLARED)
    assert widens(T.DecimalType(5, 2), T.DecimalType(7, 3)) and not widens(T.DecimalType(5, 2), T.DecimalType(5, 3))
    assert widens(T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())) and not widens(T.LongType(), T.DoubleType())


def page(*nodes):
    return json.dumps({"data": {"search": {"nodes": list(nodes)}}})


GOOD = {"id": "a", "name": "b", "nameWithOwner": "c/b"}


def test_quarantine_names_every_failed_member(spark):
    bodies = [
        page(GOOD, {**GOOD, "id": 7, "isFork": "maybe"}, {"name": "b"}, 5, None),
        page({**GOOD, "primaryLanguage": 3, "licenseInfo": "MIT", "repositoryTopics": [1], "createdAt": "soon"}),
        page(),
        "no page",
        None,
    ]
    raw = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = sorted(tuple(sorted(r["reasons"])) for r in P.quarantine(raw).collect())
    assert got == sorted([
        ("id", "isFork"), ("id", "nameWithOwner"), ("id", "name", "nameWithOwner"), (P.NOT_JSON,),
        ("createdAt", "licenseInfo", "primaryLanguage", "repositoryTopics"), (P.NOT_A_PAGE,), (P.NOT_A_PAGE,),
    ])
    counts = {r["reason"]: r["nodes"] for r in P.quarantine_reasons(raw).collect()}
    assert counts["id"] == 3 and counts[P.NOT_A_PAGE] == 2 and "owner" not in counts
    assert P.quarantine(raw.where("false")).count() == 0
    # the two ways to tell good from bad agree
    assert P.flatten_pages(raw).count() == 1


def test_the_ingest_stores_malformed_nodes_once(spark, tmp_dir):
    bodies = [page(GOOD, {"id": "z"}), "no page"]
    raw = spark.createDataFrame([(b,) for b in bodies], "value string").withColumn("landed_at", F.lit("2024-01-01").cast("timestamp"))
    for _ in range(2):  # a replay writes the same
        process_batch(spark, raw, 0, tmp_dir)
    rows = read_appended(spark, tmp_dir, "quarantine", QUARANTINE_SCHEMA).collect()
    assert sorted((r["raw_node"], tuple(r["reasons"])) for r in rows) == [("no page", (P.NOT_A_PAGE,)), ('{"id":"z"}', ("name", "nameWithOwner"))]
    from cohortlake.operators.state import latest_runs
    from cohortlake.schemas import RUN_SCHEMA

    (run,) = latest_runs(read_appended(spark, tmp_dir, "runs", RUN_SCHEMA)).collect()
    assert (run["repos_new"], run["errors_count"], run["status"]) == (1, 2, "completed")


def plan_of(spark, counts, cap, **kw):
    days = spark.createDataFrame([(d, n) for d, n in counts.items()], "d date, n int")
    return sorted(slice_plan(days.select("d", F.explode(F.sequence(F.lit(1), "n"))), "d", cap, **kw).collect())


@pytest.mark.parametrize("seed", range(4))
def test_no_slice_of_more_than_a_day_is_over_the_cap(spark, seed):
    rnd, cap = random.Random(seed), (1, 7, 20, 100)[seed]
    counts = {date(2024, 1, 1) + timedelta(days=rnd.randrange(400)): rnd.choice([1, 2, 5, 13, 30, 150]) for _ in range(120)}
    got = plan_of(spark, counts, cap)
    assert [r["slice_id"] for r in got] == list(range(len(got)))
    assert got[0]["slice_start"] == min(counts) and got[-1]["slice_end"] == max(counts)
    for a, b in zip(got, got[1:]):
        assert a["slice_end"] + timedelta(days=1) == b["slice_start"]
    for r in got:
        own = {d: n for d, n in counts.items() if r["slice_start"] <= d <= r["slice_end"]}
        assert r["row_count"] == sum(own.values()) and r["over_cap"] == (r["row_count"] > cap)
        assert not r["over_cap"] or len(own) == 1
    assert len(got) <= 2 * sum(counts.values()) / max(1, int(cap * SAFETY)) + 1


def test_a_plan_keeps_to_its_bounds(spark):
    counts = {date(2024, 1, d): n for d, n in ((1, 50), (5, 4), (9, 3), (20, 9))}
    got = plan_of(spark, counts, 10, start="2024-01-02", end="2024-01-15")
    assert [(r["slice_start"], r["slice_end"], r["row_count"]) for r in got] == [(date(2024, 1, 2), date(2024, 1, 15), 7)]
    nulls = spark.createDataFrame([(None,), (None,)], "d date")
    assert slice_plan(nulls, "d").count() == 0


def test_approximate_percentiles_keep_their_bound(spark):
    rnd = random.Random(5)
    rows = [("a", rnd.gauss(0, 1)) for _ in range(6000)] + [(None, float(i // 50)) for i in range(3000)] + [("b", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    cuts = {"low": 0.1, "mid": 0.5, "top": 0.99}
    got = {r["g"]: r for r in approx_percentiles(df, "v", cuts, ["g"], 100).collect()}
    bounds = {r["g"]: r for r in percentile_bounds(df, "v", cuts, ["g"], 100).collect()}
    assert set(got) == {"a", None, "b"} and got["b"]["mid"] is None and set(bounds) == {"a", None}
    for g, b in bounds.items():
        values = sorted(v for k, v in rows if k == g)
        assert b["n"] == len(values)
        for c in cuts:
            assert b[f"{c}_lo"] <= got[g][c] <= b[f"{c}_hi"] and got[g][c] in values
            assert b[f"{c}_lo"] < b[f"{c}_hi"]
