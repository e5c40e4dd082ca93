from datetime import timedelta

from cohortlake.operators import maintenance as mt
from helpers import AS_OF, entities, repo


def setup(spark):
    state = entities(spark, [
        repo(1, potential_score=10.0, is_archived=True, primary_language="Go"),
        repo(2, potential_score=None, is_archived=True, primary_language=None),
        repo(3, potential_score=80.0, is_archived=True),
        repo(4, potential_score=5.0, is_archived=None),
    ])
    snaps = spark.createDataFrame(
        [(f"e-{i}", AS_OF - timedelta(hours=h), 1, 1, 1) for i in (1, 2, 3, 4, 9) for h in (1, 2)],
        "repo_id string, snapshot_at timestamp, stars int, forks int, open_issues int",
    )
    return state, snaps


def test_predicate_semantics(spark):
    state, _ = setup(spark)
    pred = mt.purge_predicate(score_below=50, archived=True)
    hit = {r["id"]: r["m"] for r in state.select("id", mt.matches(pred).alias("m")).collect()}
    assert hit == {"e-1": True, "e-2": True, "e-3": False, "e-4": False}  # NULL flag -> kept
    lang = mt.purge_predicate(language="gO")
    assert {r["id"] for r in state.where(mt.matches(lang)).collect()} == {"e-1"}
    assert mt.purge_predicate() is None


def test_no_filter_deletes_nothing_and_all_deletes_everything(spark):
    state, snaps = setup(spark)
    s, sn = mt.purge(state, snaps, None)
    assert s.count() == 4 and sn.count() == 10
    s, sn = mt.purge(state, snaps, mt.purge_predicate(archived=True), all_data=True)
    assert s.count() == 0 and sn.count() == 0 and s.columns == state.columns


def test_preview_versus_execution(spark):
    state, snaps = setup(spark)
    pred = mt.purge_predicate(score_below=50, archived=True)
    p = mt.purge_preview(state, snaps, pred).collect()[0]
    assert (p["repos_to_delete"], p["cascaded_snapshots"], p["orphan_snapshots"]) == (2, 4, 2)
    survivors, snaps_left = mt.purge(state, snaps, pred)
    assert survivors.count() == 2
    # execution also removes the two pre-existing orphans (R_9)
    assert snaps.count() - snaps_left.count() == 4 + 2
    assert mt.orphan_snapshots(snaps, state).count() == 2


def test_preview_of_everything_counts_orphans_as_cascaded(spark):
    state, snaps = setup(spark)
    p = mt.purge_preview(state, snaps, None, all_data=True).collect()[0]
    assert (p["repos_to_delete"], p["cascaded_snapshots"], p["orphan_snapshots"]) == (4, 10, 2)
    none = mt.purge_preview(state.where("false"), snaps.where("false"), None).collect()[0]
    assert tuple(none) == (0, 0, 0)


def test_filters_on_their_own(spark):
    state, _ = setup(spark)
    state = state.withColumns({"scraped_at": mt.ts_lit(AS_OF), "is_fork": state["id"] == "e-3"})
    hits = lambda **kw: sorted(r["id"] for r in state.where(mt.matches(mt.purge_predicate(**kw))).collect())
    assert hits(before=AS_OF) == [] and len(hits(before=AS_OF + timedelta(seconds=1))) == 4
    assert hits(forks=True) == ["e-3"]


def test_counts_of_a_purge(spark):
    state, snaps = setup(spark)
    runs = spark.range(3).selectExpr("cast(id as string) run_id")
    one = mt.purge_counts(state, snaps, runs, mt.purge_tables(state, snaps, runs, mt.purge_predicate(archived=True))).collect()[0]
    assert (one["entities_deleted"], one["snapshots_deleted"], one["runs_deleted"], one["snapshots_left"]) == (3, 8, 0, 2)
    all_ = mt.purge_counts(state, snaps, runs, mt.purge_tables(state, snaps, runs, None, all_data=True)).collect()[0]
    assert (all_["entities_left"], all_["snapshots_left"], all_["runs_left"], all_["runs_deleted"]) == (0, 0, 0, 3)
