from datetime import datetime, timedelta

from cohortlake.operators.scoring import score_entities
from helpers import AS_OF, entities, no_snapshots, repo


def score(spark, rows, method="ranged"):
    return {r["id"]: r for r in score_entities(entities(spark, rows), no_snapshots(spark), AS_OF, method=method).collect()}


def test_scores_in_range_and_not_null(spark):
    rows = [repo(i, stars=37 * 2**i, forks=9 + 4 * i, contributors_count=2 * i + 1) for i in range(5)]
    for method in ("ranged", "window"):
        out = score(spark, rows, method)
        assert len(out) == 5
        for r in out.values():
            for c in ("potential_score", "HG_score", "activity_score"):
                assert r[c] is not None
            assert 0.0 <= r["potential_score"] <= 100.0 and 0.0 <= r["HG_score"] <= 100.0


def test_higher_fork_ratio_higher_hidden_gem(spark):
    rows = [repo(1, stars=240, forks=190), repo(2, stars=240, forks=2)]
    out = score(spark, rows)
    assert out["e-1"]["HG_score"] > out["e-2"]["HG_score"]


def test_better_community_higher_hidden_gem(spark):
    # contributors and closed issues grow, open ones shrink: weakest to strongest community
    rows = [repo(i, contributors_count=3**i, closed_issues=7 * i * i, open_issues=60 - 11 * i) for i in range(1, 6)]
    out = score(spark, rows)
    assert all(r["HG_score"] is not None for r in out.values())
    assert out["e-5"]["HG_score"] > out["e-1"]["HG_score"]


def test_zero_stars_and_zero_issues(spark):
    rows = [repo(1, stars=0, forks=0), repo(2, open_issues=0, closed_issues=0), repo(3)]
    out = score(spark, rows)
    for r in out.values():
        assert 0.0 <= r["potential_score"] <= 100.0 and 0.0 <= r["HG_score"] <= 100.0


def test_tier_and_decay_boundaries(spark):
    rows = []
    for i, d in enumerate([90, 91, 179, 180, 730, 731]):
        rows.append(repo(i, created_at=AS_OF - timedelta(days=d)))
    for j, s in enumerate([99, 100, 1000, 1001], start=10):
        rows.append(repo(j, stars=s))
    rows.append(repo(20, created_at=None, stars=None))
    rows.append(repo(21, created_at=AS_OF + timedelta(days=3)))
    df = score_entities(entities(spark, rows), no_snapshots(spark), AS_OF)
    out = {r["id"]: r for r in df.select("id", "age_tier", "maturity_tier", "days_since_creation", "recency_decay").collect()}
    assert [out[f"e-{i}"]["age_tier"] for i in range(6)] == ["Emerging", "Emerging", "Emerging", "Growing", "Growing", "Established"]
    assert [out[f"e-{j}"]["maturity_tier"] for j in range(10, 14)] == ["Seed", "Traction", "Traction", "Scale"]
    assert out["e-0"]["recency_decay"] == 1.0 and out["e-1"]["recency_decay"] < 0.37
    assert out["e-20"]["days_since_creation"] == 1.0 and out["e-20"]["maturity_tier"] == "Scale"
    assert out["e-21"]["days_since_creation"] == 1.0


def test_momentum_from_snapshots(spark):
    from cohortlake.operators.momentum import momentum_7d

    snaps = spark.createDataFrame(
        [("a", datetime(2026, 2, 20), 100, 0, 0), ("a", datetime(2026, 2, 25), 110, 0, 0),
         ("a", datetime(2026, 2, 28), 150, 0, 0), ("b", datetime(2026, 2, 1), 50, 0, 0),
         ("c", datetime(2026, 2, 26), 0, 0, 0), ("c", datetime(2026, 2, 27), 5, 0, 0),
         ("d", datetime(2026, 2, 26), 10, 0, 0), ("d", datetime(2026, 2, 27), 4, 0, 0)],
        "repo_id string, snapshot_at timestamp, stars int, forks int, open_issues int",
    )
    out = {r["repo_id"]: r["momentum_7d"] for r in momentum_7d(snaps, AS_OF).collect()}
    assert abs(out["a"] - 150 / 110 + 1) < 1e-12  # earliest in window is 110
    assert out["b"] == 0.0  # none in window
    assert out["c"] == 0.0  # base 0
    assert out["d"] == -0.6  # negative momentum


def test_stored_momentum_kept_without_snapshots(spark):
    rows = [repo(1, momentum_7d=0.5), repo(2)]
    snaps = spark.createDataFrame([("e-2", datetime(2026, 2, 1), 1, 0, 0)],
                                  "repo_id string, snapshot_at timestamp, stars int, forks int, open_issues int")
    df = score_entities(entities(spark, rows), snaps, AS_OF).select("id", "momentum_7d")
    out = {r["id"]: r["momentum_7d"] for r in df.collect()}
    assert out == {"e-1": 0.5, "e-2": 0.0}
