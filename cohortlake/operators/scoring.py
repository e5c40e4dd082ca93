"""Feature columns, cohort tiers, percentile ranks and the two 0-100 scores.

``score_entities`` is the whole scoring run: snapshots -> momentum (one
aggregation) -> LEFT join onto entities -> feature projection -> cohort ranks ->
score projection. With the default rank method the featured table, the distinct
values and their ranks are written to the shared folder while the run is built
(a few counts reach the driver); the result reads them lazily.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions import features as fx
from cohortlake.operators.momentum import attach_momentum, momentum_7d
from cohortlake.operators.rank import percentile_ranks
from cohortlake.schemas import ENTITY_SCHEMA, SNAPSHOT_SCHEMA, conform
from cohortlake.session import scratch_scope
from cohortlake.sources import store

COHORT = ("age_tier", "maturity_tier")

# Score weights (terms are added in this order).
POTENTIAL_WEIGHTS = (
    ("pr_velocity", 0.35),
    ("recency_decay", 0.20),
    ("pr_activity", 0.20),
    ("pr_momentum", 0.15),
    ("readme_quality", 0.10),
)
HIDDEN_GEM_WEIGHTS = (
    ("pr_velocity", 0.28),
    ("pr_fork_engagement", 0.22),
    ("pr_activity", 0.18),
    ("readme_quality", 0.15),
    ("pr_health", 0.10),
    ("recency_decay", 0.07),
)

# Rank columns and the feature each one ranks.
RANKED_FEATURES = {
    "pr_velocity": "star_velocity",
    "pr_activity": "raw_activity",
    "pr_momentum": "momentum_7d",
    "pr_fork_engagement": "raw_fork_engagement",
    "pr_health": "raw_community_health",
}

SCORE_COLUMNS = (
    "star_velocity",
    "momentum_7d",
    "activity_score",
    "readme_quality",
    "potential_score",
    "HG_score",
    "age_tier",
    "maturity_tier",
)


def add_features(df: DataFrame, as_of: str | datetime) -> DataFrame:
    """Days, tiers and the raw features (one projection, no shuffle)."""
    days = fx.days_since("created_at", as_of)
    df = df.withColumn("days_since_creation", days)
    d = F.col("days_since_creation")
    return df.withColumns(
        {
            "age_tier": fx.age_tier(d),
            "maturity_tier": fx.maturity_tier("stars"),
            "star_velocity": fx.star_velocity("stars", d),
            "recency_decay": fx.recency_decay(d),
            "raw_fork_engagement": fx.fork_engagement("forks", "stars"),
            "raw_community_health": fx.community_health("contributors_count", "closed_issues", "open_issues"),
            "raw_activity": fx.raw_activity("forks", "open_issues", "contributors_count"),
            "readme_quality": fx.readme_quality(),
            "momentum_7d": F.coalesce(F.col("momentum_7d"), F.lit(0.0))
            if "momentum_7d" in df.columns
            else F.lit(0.0),
        }
    )


def weighted_score(weights: tuple[tuple[str, float], ...]) -> F.Column:
    total = None
    for col, w in weights:
        term = F.lit(w) * F.col(col)
        total = term if total is None else total + term
    return fx.clip(F.lit(100.0) * total, 0.0, 100.0)


def add_scores(
    featured: DataFrame,
    partition_by: tuple[str, ...] = COHORT,
    method: str = "ranged",
    partitions: int | None = None,
) -> DataFrame:
    """Cohort ranks of the five features, then the two scores and activity score."""
    ranked = percentile_ranks(featured, RANKED_FEATURES, list(partition_by), method, partitions)
    return ranked.withColumns(
        {
            "potential_score": weighted_score(POTENTIAL_WEIGHTS),
            "HG_score": weighted_score(HIDDEN_GEM_WEIGHTS),
            "activity_score": F.col("pr_activity"),
        }
    )


def score_entities(
    entities: DataFrame,
    snapshots: DataFrame,
    as_of: str | datetime,
    momentum_as_of: str | datetime | None = None,
    method: str = "ranged",
    key: str = "id",
    partitions: int | None = None,
) -> DataFrame:
    """The full scoring run. Returns every entity column plus features, ranks
    and scores (entities keep their stored momentum when they have no
    snapshot at all)."""
    m = momentum_7d(snapshots, momentum_as_of or as_of)
    df = attach_momentum(entities, m, id_col=key)
    df = add_features(df, as_of)
    return add_scores(df, method=method, partitions=partitions)


def write_scores(
    state: DataFrame,
    scored: DataFrame,
    as_of: str | datetime,
    key: str = "id",
    touch_updated_at: bool = True,
) -> DataFrame:
    """Write-back: the state table with score columns replaced by id.

    Rows of ``state`` without a scored match keep their values. With
    ``touch_updated_at`` the scored rows get ``updated_in_db_at = as_of``
    (the reference behaviour, which also resets the refresh TTL).
    """
    new = scored.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in SCORE_COLUMNS], F.lit(True).alias("_hit"))
    joined = state.join(new, key, "left")
    hit = F.col("_hit").isNotNull()
    cols = {c: F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c) if c in state.columns else F.lit(None)) for c in SCORE_COLUMNS}
    if touch_updated_at:
        old = F.col("updated_in_db_at") if "updated_in_db_at" in state.columns else F.lit(None).cast("timestamp")
        cols["updated_in_db_at"] = F.when(hit, fx.ts_lit(as_of)).otherwise(old)
    out = joined.withColumns(cols)
    return out.drop(*[f"_new_{c}" for c in SCORE_COLUMNS], "_hit")


def score_store(spark: SparkSession, root: str, batch: int, as_of: str | datetime, **kw) -> None:
    """Score the stored entities from the stored history and write the scored rows as those of ``batch``."""
    state = store.read_state(spark, root, ENTITY_SCHEMA, before_batch=batch)
    snaps = store.read_appended(spark, root, "snapshots", SNAPSHOT_SCHEMA, before_batch=batch)
    with scratch_scope(spark):
        scored = score_entities(state, snaps, as_of, **kw)
        store.write_batch(root, batch, conform(write_scores(state, scored, as_of), ENTITY_SCHEMA))
