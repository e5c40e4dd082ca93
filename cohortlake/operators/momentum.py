"""Snapshot-history operators: latest / earliest-in-window values and momentum.

Both ends of the window come out of one ``groupBy`` per key (``max_by`` /
``min_by`` of the value by time), so there is one shuffle, a hash aggregate with
map-side combine and no self-join or correlated subquery. ``(key, time)`` is the
key of a snapshot history, so there are no ties to break.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.features import ts_lit

# Fixed value: the momentum window.
MOMENTUM_DAYS = 7


def snapshot_ends(
    snaps: DataFrame,
    as_of: str | datetime,
    days: int = MOMENTUM_DAYS,
    key: str = "repo_id",
    ts: str = "snapshot_at",
    value: str = "stars",
) -> DataFrame:
    """Per key: value at the latest snapshot and at the earliest one inside
    ``[as_of - days, +inf)`` (NULL when none is inside)."""
    lo = ts_lit(as_of) - F.make_dt_interval(F.lit(days))
    inside = F.col(ts) >= lo
    return snaps.groupBy(key).agg(
        F.max_by(value, ts).alias("cur_value"),
        F.min_by(value, F.when(inside, F.col(ts))).alias("old_value"),
        F.max(F.when(inside, F.lit(True))).isNotNull().alias("has_window"),
    )


def momentum_expr(cur: str = "cur_value", old: str = "old_value") -> F.Column:
    """``(cur - old) / old`` when ``old > 0`` else ``0.0``."""
    o = F.col(old)
    return F.when(o.isNotNull() & (o > 0), (F.col(cur) - o).cast("double") / o.cast("double")).otherwise(F.lit(0.0))


def momentum_7d(
    snaps: DataFrame,
    as_of: str | datetime,
    days: int = MOMENTUM_DAYS,
    key: str = "repo_id",
    ts: str = "snapshot_at",
    value: str = "stars",
) -> DataFrame:
    """One row per key with snapshots: ``(key, momentum_7d)``."""
    ends = snapshot_ends(snaps, as_of, days, key, ts, value)
    return ends.select(key, momentum_expr().alias("momentum_7d"))


def attach_momentum(
    entities: DataFrame,
    momentum: DataFrame,
    id_col: str = "id",
    key: str = "repo_id",
    out: str = "momentum_7d",
) -> DataFrame:
    """LEFT join momentum onto entities; the new value wins over the stored one."""
    m = momentum.select(F.col(key).alias(id_col), F.col("momentum_7d").alias("_m_new"))
    joined = entities.join(m, id_col, "left")
    stored = F.col(out) if out in entities.columns else F.lit(None).cast("double")
    return joined.withColumn(out, F.coalesce(F.col("_m_new"), stored)).drop("_m_new")


def trending(
    scored: DataFrame,
    snaps: DataFrame,
    as_of: str | datetime,
    limit: int | None = 50,
    days: int = MOMENTUM_DAYS,
    id_col: str = "id",
    key: str = "repo_id",
) -> DataFrame:
    """Entities ranked by star gain over the window (inner joins: an entity
    needs a snapshot inside the window). Ties are broken by id."""
    ends = snapshot_ends(snaps, as_of, days, key).where(F.col("has_window"))
    joined = ends.join(scored, F.col(key) == F.col(id_col))
    out = joined.select(
        F.col(id_col),
        F.col("full_name"),
        F.coalesce(F.col("maturity_tier"), F.lit("Unknown")).alias("maturity_tier"),
        F.col("stars").alias("current_stars"),
        F.col("old_value").alias("stars_7d_ago"),
        (F.col("cur_value") - F.col("old_value")).alias("delta_stars"),
        F.when(F.col("old_value") > 0, (F.col("cur_value") - F.col("old_value")).cast("double") / F.col("old_value"))
        .otherwise(F.lit(0.0))
        .alias("momentum_7d"),
        F.col("potential_score"),
        F.col("HG_score"),
        F.col("url"),
    )
    out = out.orderBy(F.col("delta_stars").desc(), F.col(id_col))
    if limit is not None:
        out = out.limit(limit)
    return out
