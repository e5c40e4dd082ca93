from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cohortlake.operators import state as st
from cohortlake.schemas import ENTITY_DEFAULTS, ENTITY_SCHEMA, conform
from helpers import AS_OF, entities, no_snapshots, repo


def test_upsert_twice_one_row_new_value(spark):
    empty = entities(spark, [repo(1)]).where(F.lit(False))
    s1 = st.upsert_state(empty, entities(spark, [repo(1, stars=100)]).drop("scraped_at", "updated_in_db_at"), AS_OF)
    assert s1.select("is_new").collect()[0][0] is True
    later = AS_OF + timedelta(hours=1)
    s2 = st.upsert_state(s1.drop("is_new"), entities(spark, [repo(1, stars=150)]).drop("scraped_at", "updated_in_db_at"), later)
    rows = s2.collect()
    assert len(rows) == 1 and rows[0]["stars"] == 150 and rows[0]["is_new"] is False
    assert rows[0]["scraped_at"] == AS_OF and rows[0]["updated_in_db_at"] == later


def test_upsert_keeps_scores_and_replay_is_idempotent(spark):
    state = entities(spark, [repo(1, potential_score=42.0, scraped_at=AS_OF, updated_in_db_at=AS_OF)])
    batch = entities(spark, [repo(1, stars=7), repo(2)]).drop("scraped_at", "updated_in_db_at", "potential_score")
    once = st.upsert_state(state, batch, AS_OF).drop("is_new")
    twice = st.upsert_state(once, batch, AS_OF).drop("is_new")
    a = sorted(map(tuple, once.collect()))
    b = sorted(map(tuple, twice.collect()))
    assert a == b
    got = {r["id"]: r for r in once.collect()}
    assert got["e-1"]["potential_score"] == 42.0 and got["e-1"]["stars"] == 7 and got["e-2"]["potential_score"] is None


def test_closed_issues_saved_and_overwritten(spark):
    state = entities(spark, [repo(1, closed_issues=15)])
    out = st.upsert_state(state, entities(spark, [repo(1, closed_issues=99)]).drop("scraped_at", "updated_in_db_at"), AS_OF)
    assert out.collect()[0]["closed_issues"] == 99


def test_classify_refresh(spark):
    state = entities(spark, [
        repo(1, updated_in_db_at=AS_OF - timedelta(hours=2)),
        repo(2, updated_in_db_at=AS_OF - timedelta(hours=30)),
        repo(3, updated_in_db_at=None),
    ])
    batch = entities(spark, [repo(i) for i in (1, 2, 3, 4)])
    got = {r["id"]: r["refresh_class"] for r in st.classify_refresh(state, batch, AS_OF, 24).collect()}
    assert got == {"e-1": "SKIP", "e-2": "REFRESH", "e-3": "REFRESH", "e-4": "NEW"}
    forced = {r["id"]: r["refresh_class"] for r in st.classify_refresh(state, batch, AS_OF, 24, force=True).collect()}
    assert forced["e-1"] == "REFRESH" and forced["e-4"] == "NEW"


def test_light_update_changes_volatile_only(spark):
    state = entities(spark, [repo(1, stars=10, readme_length_chars=123, description="keep", potential_score=1.0)])
    batch = entities(spark, [repo(1, stars=20, readme_length_chars=999, description="new"), repo(9)])
    rows = st.light_update(state, batch, AS_OF).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r["stars"] == 20 and r["readme_length_chars"] == 123 and r["description"] == "keep"
    assert r["potential_score"] == 1.0 and r["updated_in_db_at"] == AS_OF


def test_snapshot_gate(spark):
    classified = entities(spark, [repo(1), repo(2), repo(3)]).withColumn("refresh_class", F.lit("SKIP"))
    snaps = spark.createDataFrame(
        [("e-2", AS_OF - timedelta(hours=1), 1, 1, 1), ("e-3", AS_OF - timedelta(hours=7), 1, 1, 1)],
        "repo_id string, snapshot_at timestamp, stars int, forks int, open_issues int",
    )
    got = {r["id"]: r["snapshot_due"] for r in st.snapshot_due(classified, snaps, AS_OF, 6).collect()}
    assert got == {"e-1": True, "e-2": False, "e-3": True}


def test_apply_batch_and_counters(spark):
    state = entities(spark, [repo(1, updated_in_db_at=AS_OF - timedelta(hours=1)),
                             repo(2, updated_in_db_at=AS_OF - timedelta(days=3))])
    batch = entities(spark, [repo(1, stars=501), repo(2, stars=502), repo(3)]).drop("scraped_at", "updated_in_db_at")
    new_state, snaps, gated = st.apply_batch(state, no_snapshots(spark), batch, AS_OF)
    assert new_state.count() == 3
    assert snaps.count() == 3  # new + refreshed + fresh without any snapshot yet
    run = st.run_counters(gated, "r1", AS_OF, AS_OF).collect()[0]
    assert (run["repos_found"], run["repos_new"], run["repos_refreshed"], run["repos_skipped_fresh"],
            run["snapshots_taken"], run["repos_updated"]) == (3, 1, 1, 1, 3, 0)


def test_thin_snapshots(spark):
    t0 = datetime(2026, 1, 1)
    rows = [("a", t0 + timedelta(hours=h), 1, 1, 1) for h in (0, 1, 5, 6, 7, 12, 13)]
    rows += [("b", t0, 1, 1, 1)]
    snaps = spark.createDataFrame(rows, "repo_id string, snapshot_at timestamp, stars int, forks int, open_issues int")
    kept = sorted((r["repo_id"], r["snapshot_at"]) for r in st.thin_snapshots(snaps, 6).collect())
    assert kept == [("a", t0), ("a", t0 + timedelta(hours=6)), ("a", t0 + timedelta(hours=12)), ("b", t0)]


def test_conform_adds_missing_columns(spark):
    old = spark.createDataFrame([("e-1", "n", "o/n", 5, 1, 2, "Growing", "Seed", AS_OF, AS_OF)],
                                "id string, name string, full_name string, stars int, forks int, open_issues int, "
                                "age_tier string, maturity_tier string, scraped_at timestamp, updated_in_db_at timestamp")
    out = conform(old, ENTITY_SCHEMA, ENTITY_DEFAULTS)
    r = out.collect()[0]
    assert out.columns == ENTITY_SCHEMA.fieldNames()
    assert r["closed_issues"] == 0 and r["HG_score"] is None and r["stars"] == 5


def test_dedupe_batch_latest_wins(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 3, "new"), ("a", 2, "mid"), ("b", 1, "x")],
                               "id string, t int, v string")
    got = {r["id"]: r["v"] for r in st.dedupe_batch(df, "id", "t").collect()}
    assert got == {"a": "new", "b": "x"}


def test_thin_snapshots_across_arrow_batches(spark):
    import random

    rnd = random.Random(5)
    t0 = datetime(2026, 1, 1)
    rows, expect = [], []
    for k in ("a", "b", "c"):
        t, last = t0, None
        for _ in range(200):
            t = t + timedelta(minutes=rnd.randint(1, 300))
            rows.append((k, t, 1, 1, 1))
            if last is None or t - last >= timedelta(hours=6):
                expect.append((k, t))
                last = t
    snaps = spark.createDataFrame(rows, "repo_id string, snapshot_at timestamp, stars int, forks int, open_issues int")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted((r["repo_id"], r["snapshot_at"]) for r in st.thin_snapshots(snaps.repartition(3), 6).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == sorted(expect)


def test_repeated_key_in_batch_is_applied_once(spark):
    state = entities(spark, [repo(1, stars=1)])
    batch = entities(spark, [repo(1, stars=5, updated_at=datetime(2026, 2, 1)),
                             repo(1, stars=9, updated_at=datetime(2026, 2, 2)), repo(2)]).drop("scraped_at", "updated_in_db_at")
    up = {r["id"]: r for r in st.upsert_state(state, batch, AS_OF, order_by="updated_at").collect()}
    assert len(up) == 2 and up["e-1"]["stars"] == 9
    new_state, snaps, gated = st.apply_batch(state, no_snapshots(spark), batch, AS_OF, order_by="updated_at")
    assert new_state.count() == 2 and gated.count() == 2
    assert {r["id"]: r["stars"] for r in new_state.collect()}["e-1"] == 9


def test_thin_snapshots_splits_a_hot_key_at_its_gaps(spark):
    """One key holds nine tenths of the rows, with long gaps, dense stretches over midnight and rows a TTL apart."""
    import random

    rnd = random.Random(8)
    rows, expect = [], []
    for k, n in (("hot", 900), ("b", 50), ("c", 50)):
        t, last = datetime(2026, 1, 1, 20), None
        for _ in range(n):
            t = t + timedelta(minutes=rnd.choice([1, 10, 30, 359, 360, 361, 3000]))
            rows.append((k, t, 1, 1, 1))
            if last is None or t - last >= timedelta(hours=6):
                expect.append((k, t))
                last = t
    snaps = spark.createDataFrame(rows, "repo_id string, snapshot_at timestamp, stars int, forks int, open_issues int")
    got = sorted((r["repo_id"], r["snapshot_at"]) for r in st.thin_snapshots(snaps, 6).collect())
    assert got == sorted(expect)


def test_thin_snapshots_of_one_endless_history(spark):
    """Nine tenths of the rows are one key's, never a TTL apart; null keys are a key, rows without a time stay."""
    import random

    rnd = random.Random(4)
    rows, expect = [], []
    for k, n in (("hot", 1800), (None, 150), ("b", 50)):
        t, last = datetime(2026, 1, 1), None
        for i in range(n):
            t = t + timedelta(minutes=rnd.randint(1, 200), microseconds=i)
            rows += [(k, t, 5, 1, 1), (k, t, 4, 1, 1)][: 1 + (i % 9 == 0)]
            if last is None or t - last >= timedelta(hours=6):
                expect.append((k, t, 4 if i % 9 == 0 else 5))
                last = t
    rows += [("hot", None, 1, 1, 1), (None, None, 2, 1, 1), (None, None, 2, 1, 1)]
    expect += [("hot", None, 1), (None, None, 2), (None, None, 2)]
    snaps = spark.createDataFrame(rows, "repo_id string, snapshot_at timestamp, stars int, forks int, open_issues int")
    got = [(r["repo_id"], r["snapshot_at"], r["stars"]) for r in st.thin_snapshots(snaps.repartition(5), 6).collect()]
    assert sorted(got, key=repr) == sorted(expect, key=repr)
    assert st.thin_snapshots(snaps.where("false"), 6).count() == 0 and st.thin_snapshots(snaps, 0).count() == len(rows)


def test_pivot_has_a_column_for_later_months(spark):
    from cohortlake.operators.reports import hidden_gems_pivot

    gems = spark.createDataFrame([("x", "2001-08", 1.0), ("x", "2001-09", 2.0), ("x", "2001-11", 3.0), ("y", "2001-09", 4.0)], "primary_language string, created_month string, median_score double")
    got = {r["primary_language"]: (r["2001-08"], r["later"]) for r in hidden_gems_pivot(gems, ["2001-07", "2001-08"]).collect()}
    assert got == {"x": (1.0, 3.0), "y": (None, 4.0)}


def test_recent_gate_agrees_with_the_full_one(spark):
    classified = entities(spark, [repo(i) for i in range(5)]).withColumn("refresh_class", F.when(F.col("id") == "e-4", "NEW").otherwise("SKIP"))
    snaps = spark.createDataFrame(
        [("e-1", AS_OF - timedelta(hours=1)), ("e-2", AS_OF - timedelta(hours=6)), ("e-3", AS_OF - timedelta(hours=9)),
         ("e-3", AS_OF - timedelta(hours=2)), ("e-4", AS_OF - timedelta(hours=1))], "repo_id string, snapshot_at timestamp")
    due = lambda df: {r["id"]: r["snapshot_due"] for r in df.collect()}
    got = due(st.recently_due(classified, snaps, AS_OF, 6))
    assert got == due(st.snapshot_due(classified, snaps, AS_OF, 6)) == {"e-0": True, "e-1": False, "e-2": True, "e-3": False, "e-4": True}
