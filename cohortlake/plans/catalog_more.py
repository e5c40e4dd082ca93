"""Further registered queries: features, ranks, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.operators import reports as R
from cohortlake.operators import scoring
from cohortlake.operators.momentum import attach_momentum, momentum_7d, trending
from cohortlake.operators.rank import approx_percentiles, minmax_norm, percentile_bounds, percentile_ranks
from cohortlake.plans import oracle as O
from cohortlake.plans.catalog import _repos, _snaps, register, scored
from cohortlake.session import freeze
from cohortlake.sources.fixtures import ENTITY_AS_OF, SNAPSHOT_AS_OF


def featured(spark, sf_dir):
    m = momentum_7d(_snaps(spark, sf_dir), SNAPSHOT_AS_OF)
    return scoring.add_features(attach_momentum(_repos(spark, sf_dir), m), ENTITY_AS_OF)


def _feature_query(name: str, cols: list[str]):
    register(name, O.scored_sql(f"SELECT id, {', '.join(cols)} FROM feat"))(
        lambda spark, sf_dir: featured(spark, sf_dir).select("id", *cols)
    )


# ---------------------------------------------------------------- I1-I9 feature columns

_feature_query("age_features", ["days_since_creation"])
_feature_query("tiers", ["age_tier", "maturity_tier"])
_feature_query("star_velocity", ["star_velocity"])
_feature_query("recency_decay", ["recency_decay"])
_feature_query("fork_engagement", ["raw_fork_engagement"])
_feature_query("community_health", ["raw_community_health"])
_feature_query("raw_activity", ["raw_activity"])
_feature_query("text_quality", ["readme_quality"])


def _score_query(name: str, cols: list[str]):
    register(name, O.scored_sql(f"SELECT id, {', '.join(cols)} FROM scored"))(
        lambda spark, sf_dir: scored(spark, sf_dir).select("id", *cols)
    )


_score_query("potential_score", ["potential_score"])
_score_query("hidden_gem_score", ["HG_score"])
_score_query("activity_score", ["activity_score"])

PR_COLS = list(scoring.RANKED_FEATURES)


@register("cohort_percentile_rank", O.scored_sql(f"SELECT id, {', '.join(PR_COLS)} FROM ranked"))
def q_cohort_rank(spark, sf_dir):
    # Many ranges, so that groups span several at test scale too.
    return percentile_ranks(
        featured(spark, sf_dir), scoring.RANKED_FEATURES, list(scoring.COHORT), partitions=96
    ).select("id", *PR_COLS)


@register("cohort_percentile_rank_window", O.scored_sql(f"SELECT id, {', '.join(PR_COLS)} FROM ranked"))
def q_cohort_rank_window(spark, sf_dir):
    return percentile_ranks(
        featured(spark, sf_dir), scoring.RANKED_FEATURES, list(scoring.COHORT), method="window"
    ).select("id", *PR_COLS)


@register(
    "minmax_norm",
    O.scored_sql(
        "SELECT id, (star_velocity - min(star_velocity) OVER ()) / "
        "greatest(max(star_velocity) OVER () - min(star_velocity) OVER (), 1e-9) AS velocity_norm FROM feat"
    ),
)
def q_minmax(spark, sf_dir):
    return minmax_norm(featured(spark, sf_dir), "star_velocity", "velocity_norm").select("id", "velocity_norm")


# ---------------------------------------------------------------- reports D1-D8, E5, F3, B5


MEANS = {
    "avg_score": "round(avg(potential_score), 2)", "avg_hg_score": "round(avg(HG_score), 2)",
    "avg_stars": "round(avg(stars), 1)", "avg_velocity": "round(avg(star_velocity), 4)",
}


def means_sql(key: str, source: str, *means: str) -> str:
    """Size and mean columns of every value of ``key``."""
    return f"SELECT {key}, count() AS repo_count, {', '.join(f'{MEANS[m]} AS {m}' for m in means)} FROM {source} GROUP BY ALL"


@register(
    "language_distribution",
    O.scored_sql(
        "SELECT * REPLACE (ifnull(language, 'Unknown') AS language) FROM by_language",
        f"by_language AS ({means_sql('primary_language AS language', 'scored', 'avg_stars', 'avg_score', 'avg_hg_score')})",
    ),
)
def q_language(spark, sf_dir):
    return R.language_distribution(scored(spark, sf_dir))


@register(
    "topic_heatmap",
    O.scored_sql(
        "FROM by_topic QUALIFY row_number() OVER (ORDER BY repo_count DESC, topic) <= 50",
        f"by_topic AS ({means_sql('topic', 'scored, unnest(scored.topics) AS each(topic)', 'avg_score', 'avg_hg_score')})",
    ),
)
def q_topics(spark, sf_dir):
    return R.topic_heatmap(scored(spark, sf_dir))


@register(
    "velocity_percentiles",
    O.scored_sql(
        "SELECT cut[1] AS p50, cut[2] AS p90, cut[3] AS p99 "
        "FROM (SELECT quantile_cont(star_velocity, [0.5, 0.9, 0.99]) AS cut FROM scored)"
    ),
)
def q_percentiles(spark, sf_dir):
    return R.velocity_percentiles(scored(spark, sf_dir), partitions=8)


CUTS, CUT_ACCURACY = {"p50": 0.5, "p90": 0.9, "p99": 0.99}, 1000


@register(
    "velocity_percentiles_approx",
    O.scored_sql(
        f"""SELECT maturity_tier, percentile, n, min(v) FILTER (WHERE r >= greatest(ceil(q * n) - ceil(n / {CUT_ACCURACY}.0), 1)) AS lo,
  min(v) FILTER (WHERE r >= least(ceil(q * n) + ceil(n / {CUT_ACCURACY}.0), n)) AS hi, true AS within_bound
FROM placed CROSS JOIN (VALUES {", ".join(f"('{k}', {p}::DOUBLE)" for k, p in CUTS.items())}) c(percentile, q)
GROUP BY maturity_tier, percentile, n""",
        "placed AS (SELECT maturity_tier, star_velocity AS v, row_number() OVER (PARTITION BY maturity_tier ORDER BY star_velocity) AS r, "
        "count(*) OVER (PARTITION BY maturity_tier) AS n FROM scored WHERE star_velocity IS NOT NULL)",
    ),
)
def q_percentiles_approx(spark, sf_dir):
    """The sketch's velocity percentiles by tier, each held against the exact values at the ranks that bound it."""
    rows = freeze(featured(spark, sf_dir).select("maturity_tier", "star_velocity"))
    approx = approx_percentiles(rows, "star_velocity", CUTS, ["maturity_tier"], CUT_ACCURACY)
    exact = percentile_bounds(rows, "star_velocity", CUTS, ["maturity_tier"], CUT_ACCURACY)
    exact = exact.withColumnRenamed("maturity_tier", "_tier")
    both = exact.join(approx, F.col("_tier").eqNullSafe(F.col("maturity_tier")))
    each = F.array(*[F.struct(F.lit(c).alias("percentile"), F.col(f"{c}_lo").alias("lo"), F.col(f"{c}_hi").alias("hi"), F.col(c).alias("v")) for c in CUTS])
    return both.select("maturity_tier", "n", F.explode(each).alias("e")).select(
        "maturity_tier", "e.percentile", "n", "e.lo", "e.hi", F.col("e.v").between(F.col("e.lo"), F.col("e.hi")).alias("within_bound")
    )


@register(
    "score_distribution",
    O.scored_sql(
        "SELECT tenth AS bucket, format('{}–{}', tenth * 10, tenth * 10 + 10) AS label, sum(n)::BIGINT AS total_count, "
        + ", ".join(f"coalesce(sum(n) FILTER (WHERE maturity_tier = '{t}'), 0)::BIGINT AS count_{t.lower()}" for t in ("Seed", "Traction", "Scale"))
        + " FROM tenths GROUP BY tenth",
        "tenths AS (SELECT floor(potential_score / 10)::INTEGER AS tenth, maturity_tier, count() AS n "
        "FROM scored GROUP BY ALL HAVING tenth IS NOT NULL)",
    ),
)
def q_score_dist(spark, sf_dir):
    return R.score_distribution(scored(spark, sf_dir))


@register(
    "maturity_summary",
    O.scored_sql(
        "SELECT * REPLACE (ifnull(tier, 'Unknown') AS tier), 4 - list_position(['Seed', 'Traction', 'Scale'], tier) AS tier_order FROM tiers",
        f"tiers AS ({means_sql('maturity_tier AS tier', 'scored', 'avg_score', 'avg_hg_score', 'avg_velocity', 'avg_stars')})",
    ),
)
def q_maturity(spark, sf_dir):
    return R.maturity_summary(scored(spark, sf_dir))


HG_CTES = (
    "hg_base AS (SELECT primary_language, strftime(created_at, '%Y-%m') AS created_month, potential_score "
    "FROM scored WHERE age_tier = 'Emerging' AND maturity_tier IN ('Seed', 'Traction') "
    "AND primary_language IS NOT NULL AND created_at IS NOT NULL), "
    "hg AS (SELECT primary_language, created_month, median(potential_score) AS median_score, "
    "COUNT(*) AS repo_count FROM hg_base GROUP BY 1, 2 HAVING COUNT(*) >= 3)"
)


@register("hidden_gems", O.scored_sql("SELECT * FROM hg", HG_CTES))
def q_hidden_gems(spark, sf_dir):
    return R.hidden_gems(scored(spark, sf_dir))


MONTHS = R.months_until(ENTITY_AS_OF, R.EMERGING_MONTHS)


@register(
    "hidden_gems_pivot",
    O.scored_sql(
        "SELECT primary_language, "
        + ", ".join(f"max(median_score) FILTER (WHERE created_month = '{m}') AS \"{m}\"" for m in MONTHS)
        + f", max(median_score) FILTER (WHERE created_month > '{max(MONTHS)}') AS later FROM hg GROUP BY primary_language",
        HG_CTES,
    ),
)
def q_hidden_gems_pivot(spark, sf_dir):
    return R.hidden_gems_pivot(R.hidden_gems(scored(spark, sf_dir)), MONTHS)


@register(
    "cohort_histogram",
    O.scored_sql(
        "SELECT age_tier, maturity_tier, CAST(floor(potential_score / 5.0) AS INTEGER) AS bin, COUNT(*) AS repo_count, "
        "CAST(CAST(floor(potential_score / 5.0) AS INTEGER) * 5.0 AS DOUBLE) AS bin_start "
        "FROM scored WHERE potential_score IS NOT NULL GROUP BY 1, 2, 3"
    ),
)
def q_cohort_hist(spark, sf_dir):
    return R.cohort_histogram(scored(spark, sf_dir))


@register(
    "segmented_leaderboard",
    O.scored_sql(
        "SELECT full_name, potential_score, star_velocity, stars, age_tier, maturity_tier FROM scored "
        "WHERE age_tier IN ('Emerging', 'Growing') AND maturity_tier IN ('Seed', 'Traction') "
        "AND potential_score IS NOT NULL ORDER BY potential_score DESC, id LIMIT 15"
    ),
)
def q_segmented(spark, sf_dir):
    return R.segmented_leaderboard(scored(spark, sf_dir))


@register(
    "breakout_points",
    O.scored_sql(
        "SELECT id, full_name, stars, log10(stars) AS log10_stars, momentum_7d, star_velocity, age_tier, maturity_tier, "
        "potential_score, forks FROM scored WHERE stars > 0 AND momentum_7d IS NOT NULL AND star_velocity IS NOT NULL"
    ),
)
def q_breakout(spark, sf_dir):
    return R.breakout_points(scored(spark, sf_dir))


@register(
    "top_per_tier",
    O.scored_sql(
        "SELECT full_name, potential_score, maturity_tier, rank_in_tier FROM ("
        "SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY maturity_tier ORDER BY potential_score DESC, id) AS INTEGER) AS rank_in_tier "
        "FROM (SELECT id, full_name, potential_score, COALESCE(maturity_tier, 'Unknown') AS maturity_tier "
        "FROM scored WHERE potential_score IS NOT NULL ORDER BY potential_score DESC, id LIMIT 150)) "
        "WHERE rank_in_tier <= 20"
    ),
)
def q_top_per_tier(spark, sf_dir):
    s = scored(spark, sf_dir)
    top = (
        s.where(F.col("potential_score").isNotNull())
        .orderBy(F.col("potential_score").desc(), F.col("id"))
        .limit(150)
        .select("id", "full_name", "potential_score", R.unknown("maturity_tier").alias("maturity_tier"))
    )
    return R.top_per_group(top, "maturity_tier", [F.col("potential_score").desc(), F.col("id")], 20).select(
        "full_name", "potential_score", "maturity_tier", "rank_in_tier"
    )


@register(
    "trending_per_tier",
    O.scored_sql(
        "SELECT full_name, delta_stars, momentum_7d, maturity_tier, "
        "(row_number() OVER (PARTITION BY maturity_tier ORDER BY delta_stars DESC, id))::INTEGER AS rank_in_tier "
        "FROM gains QUALIFY rank_in_tier <= 5",
        O.GAINS,
    ),
)
def q_trending_per_tier(spark, sf_dir):
    t = trending(scored(spark, sf_dir), _snaps(spark, sf_dir), SNAPSHOT_AS_OF, limit=50)
    return R.top_per_group(t, "maturity_tier", [F.col("delta_stars").desc(), F.col("id")], 5).select(
        "full_name", "delta_stars", "momentum_7d", "maturity_tier", "rank_in_tier"
    )
