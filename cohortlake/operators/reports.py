"""Canned reports over the scored entity table.

Top-k reports use ``orderBy(...).limit(k)``, which Spark plans as
``TakeOrderedAndProject``: every partition keeps its own k best rows and only
those reach the final merge, so no full sort and no single-task funnel.
Ties are broken by ``id`` so results are deterministic.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP_POTENTIAL_COLUMNS = (
    "full_name", "primary_language", "stars", "forks", "open_issues", "contributors_count", "star_velocity",
    "momentum_7d", "readme_quality", "potential_score", "HG_score", "created_at", "url",
)


def unknown(col: str) -> F.Column:
    return F.coalesce(F.col(col), F.lit("Unknown"))


def top_potential(scored: DataFrame, limit: int = 150, id_col: str = "id") -> DataFrame:
    """Highest potential scores (scored rows only), 14 report columns."""
    return (
        scored.where(F.col("potential_score").isNotNull())
        .orderBy(F.col("potential_score").desc(), F.col(id_col))
        .limit(limit)
        .select(*TOP_POTENTIAL_COLUMNS, unknown("maturity_tier").alias("maturity_tier"))
    )


def language_distribution(scored: DataFrame, lang: str = "primary_language") -> DataFrame:
    """Per raw language value (NULL and a literal 'Unknown' stay two groups)."""
    return (
        scored.groupBy(lang)
        .agg(
            F.count(F.lit(1)).alias("repo_count"),
            F.round(F.avg("stars"), 1).alias("avg_stars"),
            F.round(F.avg("potential_score"), 2).alias("avg_score"),
            F.round(F.avg("HG_score"), 2).alias("avg_hg_score"),
        )
        .select(unknown(lang).alias("language"), "repo_count", "avg_stars", "avg_score", "avg_hg_score")
        .orderBy(F.col("repo_count").desc(), F.col("language"))
    )


def topic_heatmap(scored: DataFrame, limit: int | None = 50) -> DataFrame:
    """Topic counts and average scores; ``explode`` drops NULL/empty lists."""
    out = (
        scored.where(F.col("topics").isNotNull())
        .select(F.explode("topics").alias("topic"), "potential_score", "HG_score")
        .groupBy("topic")
        .agg(
            F.count(F.lit(1)).alias("repo_count"),
            F.round(F.avg("potential_score"), 2).alias("avg_score"),
            F.round(F.avg("HG_score"), 2).alias("avg_hg_score"),
        )
        .orderBy(F.col("repo_count").desc(), F.col("topic"))
    )
    return out.limit(limit) if limit is not None else out


def velocity_percentiles(scored: DataFrame, value: str = "star_velocity", **kw) -> DataFrame:
    """Exact p50 / p90 / p99 (interpolated), distributed (see exact_percentiles)."""
    from cohortlake.operators.rank import exact_percentiles

    return exact_percentiles(scored, value, {"p50": 0.50, "p90": 0.90, "p99": 0.99}, **kw)


def score_distribution(scored: DataFrame, score: str = "potential_score", width: float = 10.0) -> DataFrame:
    """Histogram of scores in buckets of ``width`` with per-tier counts
    (a score of 100 lands in bucket 10)."""
    tier = F.col("maturity_tier")
    return (
        scored.where(F.col(score).isNotNull())
        .groupBy(F.floor(F.col(score) / F.lit(width)).cast("int").alias("bucket"))
        .agg(
            F.count(F.lit(1)).alias("total_count"),
            F.count_if(tier == "Seed").alias("count_seed"),
            F.count_if(tier == "Traction").alias("count_traction"),
            F.count_if(tier == "Scale").alias("count_scale"),
        )
        .select(
            "bucket",
            F.concat(
                (F.col("bucket") * F.lit(int(width))).cast("string"), F.lit("–"),
                ((F.col("bucket") + 1) * F.lit(int(width))).cast("string"),
            ).alias("label"),
            "total_count",
            "count_seed",
            "count_traction",
            "count_scale",
        )
        .orderBy("bucket")
    )


# Report order of the maturity tiers.
TIER_ORDER = ("Scale", "Traction", "Seed")


def tier_order(col: str) -> F.Column:
    c = F.col(col)
    expr = F.when(c == TIER_ORDER[0], 1)
    for i, t in enumerate(TIER_ORDER[1:], start=2):
        expr = expr.when(c == t, i)
    return expr.otherwise(len(TIER_ORDER) + 1)


def maturity_summary(scored: DataFrame) -> DataFrame:
    return (
        scored.where(F.col("potential_score").isNotNull())
        .groupBy("maturity_tier")
        .agg(
            F.count(F.lit(1)).alias("repo_count"),
            F.round(F.avg("potential_score"), 2).alias("avg_score"),
            F.round(F.avg("HG_score"), 2).alias("avg_hg_score"),
            F.round(F.avg("star_velocity"), 4).alias("avg_velocity"),
            F.round(F.avg("stars"), 1).alias("avg_stars"),
        )
        .orderBy(tier_order("maturity_tier"))
        .select(unknown("maturity_tier").alias("tier"), "repo_count", "avg_score", "avg_hg_score",
                "avg_velocity", "avg_stars", tier_order("maturity_tier").alias("tier_order"))
    )


def cohort_filter(df: DataFrame, ages=None, maturities=None, require: tuple[str, ...] = ()) -> DataFrame:
    """Cohort membership (``age_tier IN``, ``maturity_tier IN``, not-NULL columns)."""
    cond = F.lit(True)
    if ages:
        cond = cond & F.col("age_tier").isin(*ages)
    if maturities:
        cond = cond & F.col("maturity_tier").isin(*maturities)
    for c in require:
        cond = cond & F.col(c).isNotNull()
    return df.where(cond)


def hidden_gems(scored: DataFrame, min_count: int = 3, **kw) -> DataFrame:
    """Median score and count per (language, creation month) among young,
    small entities; groups under ``min_count`` rows are dropped. The median
    ignores NULL scores, the count does not."""
    from cohortlake.operators.rank import exact_percentiles

    cohort = cohort_filter(scored, ["Emerging"], ["Seed", "Traction"], ("primary_language", "created_at")).select(
        "primary_language", F.date_format("created_at", "yyyy-MM").alias("created_month"), "potential_score"
    )
    keys = ["primary_language", "created_month"]
    counts = cohort.groupBy(*keys).agg(F.count(F.lit(1)).alias("repo_count")).where(F.col("repo_count") >= min_count)
    medians = exact_percentiles(cohort, "potential_score", {"median_score": 0.5}, keys, **kw)
    return counts.join(medians, keys, "left").select(*keys, "median_score", "repo_count")


# An Emerging entity is younger than 180 days, so its creation month is one of
# the last seven, or the as-of month itself; later ones are dated ahead.
EMERGING_MONTHS = 7


def months_until(as_of: str | datetime, back: int) -> list[str]:
    """``yyyy-MM`` of the as-of month and the ``back`` months before it, oldest first."""
    day = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    last = day.year * 12 + day.month - 1
    return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(last - back, last + 1)]


def hidden_gems_pivot(gems: DataFrame, months: list[str]) -> DataFrame:
    """Languages as rows, the given months as columns, median score as values.

    The months are an argument, so no job has to find them; ``months_until``
    gives all that the cohort can have up to as-of. Entities dated ahead have the
    column ``later``: the best median of the months after the last one given.
    """
    month = F.when(F.col("created_month") > max(months), "later").otherwise(F.col("created_month"))
    return gems.withColumn("created_month", month).groupBy("primary_language").pivot("created_month", [*months, "later"]).agg(F.max("median_score"))


def cohort_histogram(scored: DataFrame, width: float = 5.0, score: str = "potential_score") -> DataFrame:
    """Score histogram per (age tier, maturity tier) cell."""
    return (
        scored.where(F.col(score).isNotNull())
        .groupBy("age_tier", "maturity_tier", F.floor(F.col(score) / F.lit(width)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("repo_count"))
        .withColumn("bin_start", F.col("bin") * F.lit(width))
    )


def segmented_leaderboard(scored: DataFrame, limit: int = 15, id_col: str = "id") -> DataFrame:
    return (
        cohort_filter(scored, ["Emerging", "Growing"], ["Seed", "Traction"], ("potential_score",))
        .orderBy(F.col("potential_score").desc(), F.col(id_col))
        .limit(limit)
        .select("full_name", "potential_score", "star_velocity", "stars", "age_tier", "maturity_tier")
    )


def breakout_points(scored: DataFrame) -> DataFrame:
    """Points of the stars-vs-momentum scatter."""
    return scored.where(
        (F.col("stars") > 0) & F.col("momentum_7d").isNotNull() & F.col("star_velocity").isNotNull()
    ).select("id", "full_name", "stars", F.log10("stars").alias("log10_stars"), "momentum_7d", "star_velocity",
             "age_tier", "maturity_tier", "potential_score", "forks")


def top_per_group(df: DataFrame, group_col: str, order_cols: list[F.Column], n: int) -> DataFrame:
    """First ``n`` rows per group of an (already limited) list."""
    from pyspark.sql import Window

    w = Window.partitionBy(group_col).orderBy(*order_cols)
    return df.withColumn("rank_in_tier", F.row_number().over(w)).where(F.col("rank_in_tier") <= n)
