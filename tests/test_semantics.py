
import os
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlake.operators import reports as R
from cohortlake.operators.momentum import trending
from cohortlake.operators.scoring import score_entities, write_scores
from cohortlake.operators.windows import keyed_running_totals
from cohortlake.schemas import ENTITY_SCHEMA, SNAPSHOT_SCHEMA
from cohortlake.sources import store
from cohortlake.sources.export import export
from helpers import AS_OF, entities, no_snapshots, repo


def test_score_100_lands_in_bucket_10(spark):
    df = spark.createDataFrame([(100.0, "Scale"), (99.99, "Seed"), (0.0, "Seed")], "potential_score double, maturity_tier string")
    got = {r["bucket"]: (r["label"], r["total_count"]) for r in R.score_distribution(df).collect()}
    assert got[10] == ("100–110", 1) and got[9][1] == 1 and got[0][1] == 1


def test_null_language_and_literal_unknown_are_two_groups(spark):
    df = spark.createDataFrame([(None, 1, 1.0, 1.0), ("Unknown", 3, 2.0, 2.0)],
                               "primary_language string, stars int, potential_score double, HG_score double")
    rows = R.language_distribution(df).collect()
    assert [r["language"] for r in rows] == ["Unknown", "Unknown"]


def test_median_ignores_null_scores_but_count_does_not(spark):
    base = dict(age_tier="Emerging", maturity_tier="Seed", primary_language="Go", created_at=datetime(2026, 1, 5))
    rows = [dict(base, potential_score=s) for s in (10.0, 20.0, None, 40.0)]
    df = spark.createDataFrame([(r["age_tier"], r["maturity_tier"], r["primary_language"], r["created_at"], r["potential_score"]) for r in rows],
                               "age_tier string, maturity_tier string, primary_language string, created_at timestamp, potential_score double")
    r = R.hidden_gems(df).collect()[0]
    assert r["repo_count"] == 4 and r["median_score"] == 20.0 and r["created_month"] == "2026-01"


def test_global_limit_before_per_tier_cut(spark):
    df = entities(spark, [repo(i, full_name=f"r{i}", potential_score=float(100 - i),
                                maturity_tier="Scale" if i < 3 else "Seed") for i in range(10)])
    top = R.top_potential(df, limit=4)
    cut = R.top_per_group(top, "maturity_tier", [F.col("potential_score").desc()], 20)
    assert sorted(r["full_name"] for r in cut.collect()) == ["r0", "r1", "r2", "r3"]


def test_trending_needs_a_snapshot_in_window(spark):
    scored = score_entities(entities(spark, [repo(1), repo(2)]), no_snapshots(spark), AS_OF)
    snaps = spark.createDataFrame(
        [("e-1", AS_OF - timedelta(days=2), 10, 0, 0), ("e-1", AS_OF - timedelta(days=1), 15, 0, 0),
         ("e-2", AS_OF - timedelta(days=30), 10, 0, 0)],
        "repo_id string, snapshot_at timestamp, stars int, forks int, open_issues int")
    rows = trending(scored, snaps, AS_OF).collect()
    assert [(r["full_name"], r["delta_stars"], r["current_stars"]) for r in rows] == [("shore/lake1", 5, 240)]


def test_write_scores_touches_only_scored_rows(spark):
    state = entities(spark, [repo(1, potential_score=1.0), repo(2, potential_score=2.0)])
    scored = score_entities(entities(spark, [repo(1)]), no_snapshots(spark), AS_OF)
    got = {r["id"]: r for r in write_scores(state, scored, AS_OF).collect()}
    assert got["e-2"]["potential_score"] == 2.0 and got["e-2"]["updated_in_db_at"] is None
    assert got["e-1"]["potential_score"] != 1.0 and got["e-1"]["updated_in_db_at"] == AS_OF


def test_running_totals_equal_plain_window(spark):
    t0 = datetime(2026, 1, 1)
    rows = [("hot", t0 + timedelta(minutes=7 * i), float(i % 13)) for i in range(2000)]
    rows += [(f"k{i % 17}", t0 + timedelta(minutes=11 * i), 1.5) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t timestamp, v double").withColumn("v", F.col("v").cast("decimal(18,2)"))
    got = keyed_running_totals(df, "k", "t", {"s": F.col("v"), "n": F.lit(1).cast("long")})
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("k", "t", F.sum("v").over(w).alias("s"), F.count(F.lit(1)).over(w).alias("n"))
    assert sorted(map(tuple, got.select("k", "t", "s", "n").collect())) == sorted(map(tuple, ref.collect()))


def test_export_suffix_rule(spark, tmp_dir):
    df = entities(spark, [repo(1, topics=["a", "b"], potential_score=None), repo(2, potential_score=5.0)])
    assert export(df.select("id", "topics", "potential_score"), os.path.join(tmp_dir, "x.parquet")) == "parquet"
    assert export(df.select("id", "topics", "potential_score"), os.path.join(tmp_dir, "x.txt")) == "csv"
    back = spark.read.option("header", True).csv(os.path.join(tmp_dir, "x.txt")).collect()
    assert back[0]["id"] == "e-2" and back[1]["topics"] == "a, b"  # NULL scores last; list joined
    assert spark.read.parquet(os.path.join(tmp_dir, "x.parquet")).count() == 2


def test_store_versions_and_uncommitted_batches(spark, tmp_dir):
    root = os.path.join(tmp_dir, "store")
    assert store.current_version(spark, root) is None
    s1 = entities(spark, [repo(1)])
    snap = spark.createDataFrame([("e-1", AS_OF, 1, 1, 1)], SNAPSHOT_SCHEMA)
    assert store.write_batch(spark, root, 0, s1, {"snapshots": snap}, AS_OF) == 1
    # a crashed batch: its snapshot folder exists but it never committed
    snap.write.parquet(os.path.join(root, "snapshots", "batch=5"))
    assert store.read_appended(spark, root, "snapshots", SNAPSHOT_SCHEMA).count() == 1
    store.write_batch(spark, root, 1, entities(spark, [repo(1), repo(2)]), {"snapshots": snap}, AS_OF)
    assert store.current_version(spark, root) == 2
    assert store.read_state(spark, root, ENTITY_SCHEMA, before_batch=1).count() == 1
    assert store.read_state(spark, root, ENTITY_SCHEMA).count() == 2
