"""Per-entity scoring features as column expressions.

All expressions are built-ins; the caller adds them with one ``select`` so
they evaluate in a single codegen stage with no shuffle.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tier labels and thresholds.
AGE_TIERS = ("Emerging", "Growing", "Established")
MATURITY_TIERS = ("Seed", "Traction", "Scale")
EMERGING_BELOW_DAYS = 180
GROWING_MAX_DAYS = 730
SEED_BELOW_STARS = 100
TRACTION_MAX_STARS = 1000
RECENCY_FULL_DAYS = 90
RECENCY_SCALE_DAYS = 90.0
README_MIN_CHARS = 500
README_MIN_SECTIONS = 3
README_CHECK_WEIGHT = 0.2


def ts_lit(value: str | datetime | Column) -> Column:
    """A timestamp literal. Strings and naive datetimes are UTC wherever the driver runs."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        value = value.astimezone(timezone.utc).replace(tzinfo=None).isoformat(sep=" ") if value.tzinfo else value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp")


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def days_since(created: str | Column, as_of: str | datetime | Column) -> Column:
    """Whole days from ``created`` to ``as_of`` (truncated), at least 1; NULL -> 1.0."""
    days = F.timestamp_diff("DAY", _c(created), ts_lit(as_of))
    return F.when(_c(created).isNotNull(), F.greatest(days, F.lit(1)).cast("double")).otherwise(F.lit(1.0))


def age_tier(days: str | Column) -> Column:
    d = _c(days)
    return (
        F.when(d < EMERGING_BELOW_DAYS, F.lit(AGE_TIERS[0]))
        .when(d <= GROWING_MAX_DAYS, F.lit(AGE_TIERS[1]))
        .otherwise(F.lit(AGE_TIERS[2]))
    )


def maturity_tier(stars: str | Column) -> Column:
    """Seed / Traction / Scale; NULL stars fall through to Scale."""
    s = _c(stars)
    return (
        F.when(s < SEED_BELOW_STARS, F.lit(MATURITY_TIERS[0]))
        .when(s <= TRACTION_MAX_STARS, F.lit(MATURITY_TIERS[1]))
        .otherwise(F.lit(MATURITY_TIERS[2]))
    )


def star_velocity(stars: str | Column, days: str | Column) -> Column:
    return _c(stars).cast("double") / F.greatest(_c(days), F.lit(1.0))


def recency_decay(days: str | Column) -> Column:
    d = _c(days)
    return F.when(d <= RECENCY_FULL_DAYS, F.lit(1.0)).otherwise(F.exp(-d / F.lit(RECENCY_SCALE_DAYS)))


def fork_engagement(forks: str | Column, stars: str | Column) -> Column:
    s = _c(stars)
    return _c(forks).cast("double") / F.when(s > 0, s.cast("double")).otherwise(F.lit(1.0))


def community_health(contributors: str | Column, closed: str | Column, open_: str | Column) -> Column:
    c0 = F.coalesce(_c(contributors), F.lit(0)).cast("double")
    closed0 = F.coalesce(_c(closed), F.lit(0))
    open0 = F.coalesce(_c(open_), F.lit(0))
    total = open0 + closed0
    return c0 + closed0.cast("double") / F.when(total > 0, total.cast("double")).otherwise(F.lit(1.0))


def raw_activity(forks: str | Column, open_: str | Column, contributors: str | Column) -> Column:
    """``log1p(forks + open_issues + contributors)``; only contributors NULL -> 0."""
    return F.log1p(
        _c(forks).cast("double") + _c(open_).cast("double") + F.coalesce(_c(contributors), F.lit(0)).cast("double")
    )


def readme_quality(
    length: str | Column = "readme_length_chars",
    sections: str | Column = "readme_h2_sections",
    badges: str | Column = "readme_has_badges",
    demo: str | Column = "readme_has_demo_gif",
    install: str | Column = "readme_has_install",
) -> Column:
    """Five checks worth 0.2 each (added left to right)."""
    w = F.lit(README_CHECK_WEIGHT)
    checks = [
        F.coalesce(_c(length), F.lit(0)) > README_MIN_CHARS,
        F.coalesce(_c(sections), F.lit(0)) > README_MIN_SECTIONS,
        F.coalesce(_c(badges), F.lit(False)),
        F.coalesce(_c(demo), F.lit(False)),
        F.coalesce(_c(install), F.lit(False)),
    ]
    total = checks[0].cast("double") * w
    for chk in checks[1:]:
        total = total + chk.cast("double") * w
    return total


def clip(col: Column, lower: float, upper: float) -> Column:
    """Clamp to [lower, upper]; NULL stays NULL (coalesce first if needed)."""
    return F.when(col.isNull(), col).otherwise(F.least(F.greatest(col, F.lit(lower)), F.lit(upper)))
