"""Keyed state maintenance: refresh classification, upsert, light update,
snapshot gate, whole-batch apply, run counters and history thinning.

All operators are pure: ``(old state, batch) -> new DataFrames``. Nothing is
looked up per row; each step is one set-based join of the whole batch
against the state. Writing what a batch changed is the store's job
(:mod:`cohortlake.sources.store`).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions.features import ts_lit
from cohortlake.session import freeze

# Refresh classes and default TTLs (hours).
NEW, REFRESH, SKIP = "NEW", "REFRESH", "SKIP"
REFRESH_TTL_HOURS = 24
SNAPSHOT_TTL_HOURS = 6

# Columns an enrichment upsert writes (everything the ingest produces).
CRAWL_COLUMNS = (
    "name", "full_name", "owner_login", "owner_type", "description", "url", "homepage_url", "primary_language",
    "topics", "license_spdx", "is_archived", "is_fork", "is_template", "stars", "forks", "watchers",
    "open_issues", "closed_issues", "created_at", "updated_at", "pushed_at", "disk_usage_kb",
    "readme_length_chars", "readme_h2_sections", "readme_has_badges", "readme_has_demo_gif",
    "readme_has_install", "contributors_count", "releases_count", "latest_release_tag", "latest_release_at",
)
# Columns a light update writes (volatile counters and times).
VOLATILE_COLUMNS = ("stars", "forks", "open_issues", "closed_issues", "pushed_at", "updated_at")


def age_hours(ts: str | Column, as_of: str | datetime) -> Column:
    """Hours from ``ts`` to ``as_of`` as a double."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return (F.unix_micros(ts_lit(as_of)) - F.unix_micros(c)).cast("double") / F.lit(3.6e9)


def dedupe_batch(batch: DataFrame, key: str = "id", order_by: str | None = None) -> DataFrame:
    """One row per key; with ``order_by`` the row with the largest value wins
    (then the largest remaining columns, so the choice never depends on task
    order and a recomputed partition picks the same row).

    A ``groupBy`` with a max over a struct: partial aggregation runs before
    the shuffle, so a key repeated many times costs one row per partition.
    """
    if order_by is None:
        others = [c for c in batch.columns if c != key]
        packed = F.max(F.struct(*[F.col(c) for c in others])).alias("_w")
        return batch.groupBy(key).agg(packed).select(key, *[F.col(f"_w.{c}").alias(c) for c in others]).select(
            *batch.columns
        )
    others = [c for c in batch.columns if c not in (key, order_by)]
    packed = F.max(F.struct(F.col(order_by), *[F.col(c) for c in others])).alias("_w")
    return batch.groupBy(key).agg(packed).select(key, *[F.col(f"_w.{c}").alias(c) for c in [order_by] + others]).select(
        *batch.columns
    )


def classify_refresh(
    state: DataFrame,
    batch: DataFrame,
    as_of: str | datetime,
    ttl_hours: float = REFRESH_TTL_HOURS,
    force: bool = False,
    key: str = "id",
) -> DataFrame:
    """Batch rows plus ``refresh_class``: NEW (unknown key), REFRESH (forced,
    last update unknown, or older than the TTL) or SKIP (fresh)."""
    known = state.select(
        F.col(key), F.col("updated_in_db_at").alias("_state_updated"), F.lit(True).alias("_known")
    )
    joined = batch.join(known, key, "left")
    stale = F.col("_state_updated").isNull() | (age_hours("_state_updated", as_of) >= F.lit(float(ttl_hours)))
    cls = (
        F.when(F.col("_known").isNull(), F.lit(NEW))
        .when(F.lit(bool(force)) | stale, F.lit(REFRESH))
        .otherwise(F.lit(SKIP))
    )
    return joined.withColumn("refresh_class", cls).drop("_state_updated", "_known")


def latest_snapshot(snaps: DataFrame, key: str = "repo_id", ts: str = "snapshot_at") -> DataFrame:
    """Grouped MAX: latest snapshot time per key."""
    return snaps.groupBy(key).agg(F.max(ts).alias("last_snapshot_at"))


def snapshot_due(
    classified: DataFrame,
    snaps: DataFrame,
    as_of: str | datetime,
    ttl_hours: float = SNAPSHOT_TTL_HOURS,
    key: str = "id",
    snap_key: str = "repo_id",
) -> DataFrame:
    """Adds ``snapshot_due``: always for NEW/REFRESH; for SKIP when there is
    no snapshot yet or the latest is at least ``ttl_hours`` old."""
    last = latest_snapshot(snaps, snap_key).withColumnRenamed(snap_key, key)
    joined = classified.join(last, key, "left")
    gate = F.col("last_snapshot_at").isNull() | (age_hours("last_snapshot_at", as_of) >= F.lit(float(ttl_hours)))
    due = F.col("refresh_class").isin(NEW, REFRESH) | gate
    return joined.withColumn("snapshot_due", due)


def recently_due(
    classified: DataFrame,
    snaps: DataFrame,
    as_of: str | datetime,
    ttl_hours: float = SNAPSHOT_TTL_HOURS,
    key: str = "id",
    snap_key: str = "repo_id",
) -> DataFrame:
    """Adds ``snapshot_due`` as :func:`snapshot_due` does, from recent history only.

    A key is due unless it has a snapshot younger than the TTL, so older
    snapshots are filtered out before anything is grouped or joined (a
    date-pruned ``snaps`` need not even read them).
    """
    young = snaps.where(age_hours("snapshot_at", as_of) < F.lit(float(ttl_hours)))
    young = young.select(F.col(snap_key).alias(key)).distinct().withColumn("_young", F.lit(True))
    due = F.col("refresh_class").isin(NEW, REFRESH) | F.col("_young").isNull()
    return classified.join(young, key, "left").withColumn("snapshot_due", due).drop("_young")


def make_snapshots(batch: DataFrame, as_of: str | datetime, key: str = "id") -> DataFrame:
    """Snapshot rows ``(repo_id, snapshot_at, stars, forks, open_issues)``."""
    return batch.select(
        F.col(key).alias("repo_id"),
        ts_lit(as_of).alias("snapshot_at"),
        F.col("stars").cast("int").alias("stars"),
        F.col("forks").cast("int").alias("forks"),
        F.col("open_issues").cast("int").alias("open_issues"),
    )


def _merge(
    state: DataFrame,
    classified: DataFrame,
    as_of: str | datetime,
    key: str,
    keep_old_when_null: bool,
    only_if: dict[str, str] | None = None,
) -> DataFrame:
    """One full outer join applies both kinds of change.

    Rows of the batch classed NEW/REFRESH replace the crawl columns (first
    seen time kept, last update set); SKIP rows change only the volatile
    columns. Columns the batch does not carry (scores, tiers) keep the
    state's value. State rows without a batch row are unchanged. ``only_if``
    names, for some columns, a boolean batch column without which they keep the
    state's value too.
    """
    only_if = only_if or {}
    batch_cols = [c for c in classified.columns if c not in (key, "refresh_class")]
    b = classified.select(
        F.col(key), F.col("refresh_class").alias("_cls"), *[F.col(c).alias(f"_b_{c}") for c in batch_cols]
    )
    s = state.withColumn("_in_state", F.lit(True))
    j = s.join(b, key, "full_outer")
    cls = F.col("_cls")
    enrich = cls.isin(NEW, REFRESH)
    light = cls == SKIP
    now = ts_lit(as_of)

    out_cols = list(state.columns)
    for c in batch_cols:
        if c not in out_cols and c not in ("scraped_at", "updated_in_db_at", *only_if.values()):
            out_cols.append(c)

    exprs = []
    for c in out_cols:
        old = F.col(c) if c in state.columns else F.lit(None)
        if c == key:
            exprs.append(F.col(key))
            continue
        if c == "scraped_at":
            exprs.append(F.when(enrich, F.coalesce(old, now)).otherwise(old).alias(c))
            continue
        if c == "updated_in_db_at":
            exprs.append(F.when(enrich | light, now).otherwise(old).alias(c))
            continue
        if c in batch_cols:
            new = F.col(f"_b_{c}")
            if keep_old_when_null:
                new = F.coalesce(new, old)
            writes_light = c in VOLATILE_COLUMNS
            has = F.col(f"_b_{only_if[c]}") if c in only_if else F.lit(True)
            expr = F.when(enrich & F.coalesce(has, F.lit(False)), new)
            if writes_light:
                expr = expr.when(light, new)
            exprs.append(expr.otherwise(old).alias(c))
        else:
            exprs.append(old.alias(c))
    result = j.select(*exprs, cls.alias("refresh_class"), F.col("_in_state"))
    return result


def upsert_state(
    state: DataFrame,
    batch: DataFrame,
    as_of: str | datetime,
    key: str = "id",
    keep_old_when_null: bool = False,
    order_by: str | None = None,
) -> DataFrame:
    """Insert-or-replace every batch row by key; adds ``is_new``. A key
    repeated in the batch is applied once (latest ``order_by`` wins)."""
    classified = dedupe_batch(batch, key, order_by).withColumn("refresh_class", F.lit(REFRESH))
    merged = _merge(state, classified, as_of, key, keep_old_when_null)
    return merged.withColumn(
        "is_new", F.when(F.col("refresh_class").isNotNull(), F.col("_in_state").isNull())
    ).drop("refresh_class", "_in_state")


def light_update(
    state: DataFrame, batch: DataFrame, as_of: str | datetime, key: str = "id", order_by: str | None = None
) -> DataFrame:
    """Update only the volatile columns of matched keys; unknown keys are ignored."""
    classified = dedupe_batch(batch, key, order_by).withColumn("refresh_class", F.lit(SKIP))
    merged = _merge(state, classified, as_of, key, keep_old_when_null=False)
    return merged.where(F.col("_in_state").isNotNull()).drop("refresh_class", "_in_state")


def apply_batch(
    state: DataFrame,
    snaps: DataFrame,
    batch: DataFrame,
    as_of: str | datetime,
    refresh_ttl_hours: float = REFRESH_TTL_HOURS,
    snapshot_ttl_hours: float = SNAPSHOT_TTL_HOURS,
    force: bool = False,
    key: str = "id",
    keep_old_when_null: bool = False,
    snapshot_as_of: str | datetime | None = None,
    order_by: str | None = None,
    only_if: dict[str, str] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Whole batch step: classify -> upsert/light update -> snapshots.

    Returns ``(new_state, new_snapshot_rows, classified)``; ``classified``
    carries ``refresh_class`` and ``snapshot_due`` per batch row, which
    :func:`run_counters` turns into the run record. ``snapshot_as_of``
    (default ``as_of``) is the clock of the snapshot gate and the time
    stamped on new snapshots. The gate looks at snapshots younger than its TTL
    only. ``only_if``: see :func:`_merge`.
    """
    snap_time = snapshot_as_of or as_of
    # The classified batch feeds the snapshot gate and the merge; it is
    # batch-sized, so materialise it once instead of re-running the batch's
    # parsing and the classification join for each consumer.
    batch = dedupe_batch(batch, key, order_by)
    classified = freeze(classify_refresh(state, batch, as_of, refresh_ttl_hours, force, key))
    gated = recently_due(classified, snaps, snap_time, snapshot_ttl_hours, key)
    merged = _merge(state, classified, as_of, key, keep_old_when_null, only_if).drop("refresh_class", "_in_state")
    new_snaps = make_snapshots(gated.where(F.col("snapshot_due")), snap_time, key)
    return merged, new_snaps, gated


def run_counters(
    gated: DataFrame,
    run_id: str,
    started_at: str | datetime,
    finished_at: str | datetime,
    errors: DataFrame | int | None = None,
    query_string: str | None = None,
    status: str = "completed",
) -> DataFrame:
    """The run record as a one-row DataFrame (one aggregation over the batch).

    ``errors`` are the malformed rows of the ingest split, or their number
    where the write that kept them has counted them; it becomes ``errors_count``. ``repos_updated`` is kept and is 0.
    """
    counts = gated.agg(
        F.count(F.lit(1)).cast("int").alias("repos_found"),
        F.count_if(F.col("refresh_class") == NEW).cast("int").alias("repos_new"),
        F.count_if(F.col("refresh_class") == REFRESH).cast("int").alias("repos_refreshed"),
        F.count_if(F.col("refresh_class") == SKIP).cast("int").alias("repos_skipped_fresh"),
        F.count_if(F.col("snapshot_due")).cast("int").alias("snapshots_taken"),
    )
    n_err = errors.agg(F.count(F.lit(1)).cast("int")).scalar() if isinstance(errors, DataFrame) else F.lit(errors or 0).cast("int")
    return counts.select(
        F.lit(run_id).alias("run_id"),
        F.lit(query_string).cast("string").alias("query_string"),
        ts_lit(started_at).alias("started_at"),
        ts_lit(finished_at).alias("finished_at"),
        "repos_found",
        "repos_new",
        F.lit(0).alias("repos_updated"),
        "repos_refreshed",
        "repos_skipped_fresh",
        "snapshots_taken",
        n_err.alias("errors_count"),
        F.lit(status).alias("status"),
    )


def started_run(run: DataFrame) -> DataFrame:
    """The record that a run writes when it starts: running, nothing counted yet."""
    counters = [c for c in run.columns if c.startswith(("repos_", "snapshots_", "errors_"))]
    return run.withColumns(
        {c: F.lit(0) for c in counters} | {"finished_at": F.lit(None).cast("timestamp"), "status": F.lit("running")}
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """Run records are appended (start, then end or failed); the last one per run wins.

    At the same time an end record comes after a failed one, and that after the start.
    """
    stage = F.when(F.col("status") == "running", 0).when(F.col("status") == "failed", 1).otherwise(2)
    order = F.struct(F.coalesce(F.col("finished_at"), F.col("started_at")).alias("at"), stage.alias("stage"))
    return dedupe_batch(runs.withColumn("_order", order), "run_id", "_order").drop("_order")


# ---------------------------------------------------------------- history thinning


def thin_snapshots(
    snaps: DataFrame,
    ttl_hours: float = SNAPSHOT_TTL_HOURS,
    key: str = "repo_id",
    ts: str = "snapshot_at",
) -> DataFrame:
    """Keep a snapshot only if it is at least ``ttl_hours`` after the last
    kept one of its key (the first is always kept) - the history the
    snapshot gate would have produced.

    The rule looks sequential, but every time has one successor whatever came
    before: the first time of its key at least a TTL later. Successors come from
    one sorted merge of times and times-plus-TTL, day by day, with a small table
    of each day's first time for what lies beyond the day. What the first time of a
    key reaches is then marked by pointer doubling: in round k the marked times mark
    those 2**k successors on, and links are joined with themselves, so a chain
    of n kept rows takes log2(n) rounds of equi-joins on (key, time), however long a
    history goes on without a pause. Links are written between rounds.

    Null keys are a key. A row without a time has no place in the history and is
    kept. Of rows equal in key and time one is kept, the least in the other columns.
    """
    ttl_us = int(round(float(ttl_hours) * 3600 * 1_000_000))
    if ttl_us <= 0:
        return snaps
    others = [c for c in snaps.columns if c not in (key, ts)]
    timed = snaps.where(F.col(ts).isNotNull())
    one = timed.groupBy(key, ts).agg(F.min(F.struct(F.lit(0).alias("_"), *others)).alias("_row"))
    one = freeze(one.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))))

    links = freeze(_successors(one.select(F.col(key).alias("k"), F.col("_t").alias("t")), ttl_us))
    marked = one.groupBy(F.col(key).alias("k")).agg(F.min("_t").alias("t"))
    while not links.isEmpty():
        marked = freeze(marked)
        ahead = marked.join(links.toDF("k2", "t2", "to"), F.col("k").eqNullSafe(F.col("k2")) & (F.col("t") == F.col("t2")))
        marked = marked.unionByName(ahead.select("k", F.col("to").alias("t"))).distinct()
        twice = links.alias("a").join(links.alias("b"), F.col("a.k").eqNullSafe(F.col("b.k")) & (F.col("a.to") == F.col("b.t")))
        links = freeze(twice.select("a.k", "a.t", F.col("b.to").alias("to")))
    kept = one.join(marked, F.col(key).eqNullSafe(F.col("k")) & (F.col("_t") == F.col("t")))
    kept = kept.select(*[F.col(c) if c in (key, ts) else F.col(f"_row.{c}").alias(c) for c in snaps.columns])
    return kept.unionByName(snaps.where(F.col(ts).isNull()))


_DAY_US = 86_400_000_000


def _successors(times: DataFrame, ttl_us: int) -> DataFrame:
    """(k, t, to): for each distinct (k, t) the least time of the same key from t + ttl_us on; rows without one go."""
    row = times.select("k", F.col("t").alias("at"), F.lit(1).alias("is_row"), F.col("t").alias("found"), F.lit(None).cast("long").alias("t"))
    ask = times.select("k", (F.col("t") + ttl_us).alias("at"), F.lit(0).alias("is_row"), F.lit(None).cast("long").alias("found"), "t")
    both = row.unionByName(ask).withColumn("day", F.expr(f"floor(at / {_DAY_US})"))
    # a question stands before a row of the same time, so the rows from it on answer it
    rest = Window.partitionBy("k", "day").orderBy("at", "is_row").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    later = Window.partitionBy("k").orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    days = both.groupBy("k", "day").agg(F.min("found").alias("first"))
    days = days.select(F.col("k").alias("k2"), F.col("day").alias("day2"), F.min("first").over(later).alias("next"))
    asked = both.withColumn("found", F.min("found").over(rest)).where("is_row = 0")
    asked = asked.join(days, F.col("k").eqNullSafe(F.col("k2")) & (F.col("day") == F.col("day2")))
    return asked.select("k", "t", F.coalesce("found", "next").alias("to")).where("to IS NOT NULL")
