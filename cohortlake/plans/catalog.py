"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` and their oracles.

Every query builds the fixture views from the driver's tables under
``sf_dir`` and runs one operator of the library on them, so its work grows
with the tables. Column names match the oracle SQL exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlake.operators import scoring
from cohortlake.operators.momentum import attach_momentum, momentum_7d, trending
from cohortlake.plans import oracle as O
from cohortlake.session import configure, freeze
from cohortlake.sources.fixtures import ENTITY_AS_OF, SNAPSHOT_AS_OF, repos_view, snapshots_view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


# ---------------------------------------------------------------- shared inputs


def _repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return repos_view(spark, sf_dir)


def _snaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return snapshots_view(spark, sf_dir)


def shared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The entities and snapshots for a query that reads them more than once: each view is computed once and written."""
    return freeze(_repos(spark, sf_dir)), freeze(_snaps(spark, sf_dir))


def scored(
    spark: SparkSession, sf_dir: str, method: str = "ranged", partitions: int | None = None, views: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """The scored entity table (flagship run) over the fixture views (``views``: those of :func:`shared`)."""
    repos, snaps = views or (_repos(spark, sf_dir), _snaps(spark, sf_dir))
    return scoring.score_entities(
        repos, snaps, ENTITY_AS_OF,
        momentum_as_of=SNAPSHOT_AS_OF, method=method, partitions=partitions,
    )


SCORE_OUT = [
    "id", "age_tier", "maturity_tier", "days_since_creation", "star_velocity", "momentum_7d",
    "activity_score", "readme_quality", "potential_score", "HG_score",
]


# ---------------------------------------------------------------- scoring (I, E, C1)


@register("score_all", O.scored_sql(f"SELECT {', '.join(SCORE_OUT)} FROM scored"))
def q_score_all(spark, sf_dir):
    return scored(spark, sf_dir).select(*SCORE_OUT)


@register("score_all_window", O.scored_sql(f"SELECT {', '.join(SCORE_OUT)} FROM scored"))
def q_score_all_window(spark, sf_dir):
    return scored(spark, sf_dir, method="window").select(*SCORE_OUT)


@register("score_all_bucketed", O.scored_sql(f"SELECT {', '.join(SCORE_OUT)} FROM scored"))
def q_score_all_bucketed(spark, sf_dir):
    """Several value ranges for every group, whatever the session's shuffle partitions."""
    return scored(spark, sf_dir, partitions=64).select(*SCORE_OUT)


@register(
    "momentum_7d",
    O.scored_sql("SELECT repo_id, momentum_7d FROM mom"),
)
def q_momentum(spark, sf_dir):
    return momentum_7d(_snaps(spark, sf_dir), SNAPSHOT_AS_OF)


@register(
    "momentum_enriched",
    O.scored_sql("SELECT id, momentum_7d FROM feat0"),
)
def q_momentum_enriched(spark, sf_dir):
    m = momentum_7d(_snaps(spark, sf_dir), SNAPSHOT_AS_OF)
    return attach_momentum(_repos(spark, sf_dir), m).select("id", "momentum_7d")


TOP_COLS = [
    "full_name", "primary_language", "stars", "forks", "open_issues", "contributors_count", "star_velocity",
    "momentum_7d", "readme_quality", "potential_score", "HG_score", "created_at", "url",
]


@register(
    "top_potential",
    O.scored_sql(
        f"SELECT {', '.join(TOP_COLS)}, COALESCE(maturity_tier, 'Unknown') AS maturity_tier FROM scored "
        "WHERE potential_score IS NOT NULL ORDER BY potential_score DESC, id LIMIT 150"
    ),
)
def q_top_potential(spark, sf_dir):
    from cohortlake.operators.reports import top_potential

    return top_potential(scored(spark, sf_dir))


@register("trending_7d", O.scored_sql("SELECT * EXCLUDE (id) FROM gains", O.GAINS))
def q_trending(spark, sf_dir):
    repos, snaps = shared(spark, sf_dir)
    return trending(scored(spark, sf_dir, views=(repos, snaps)), snaps, SNAPSHOT_AS_OF, limit=50).drop("id")


def queries() -> dict[str, Query]:
    # Import the modules that register further queries.
    from cohortlake.plans import catalog_ingest, catalog_maint, catalog_more, catalog_state  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
