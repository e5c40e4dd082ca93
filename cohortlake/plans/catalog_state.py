"""Registered queries for the state operators (FIXTURES.md 2.4).

Old state: the scored entities with a known language. Incoming batch: the
entities that are not archived, with their four counters raised by one; so there
are batch rows without a state row and state rows without a batch row. Classification runs at the
entity as-of with a TTL of 180 days, so NEW, REFRESH and SKIP all occur; the
snapshot gate runs at the snapshot as-of.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.operators import state as st
from cohortlake.plans import oracle as O
from cohortlake.plans.catalog import _repos, _snaps, register, scored, shared
from cohortlake.plans.catalog_ingest import landed_pages
from cohortlake.session import freeze
from cohortlake.sources.fixtures import ENTITY_AS_OF, SNAPSHOT_AS_OF
from cohortlake.sources.pages import parse_pages, split_valid

TTL_H = 24 * 180
SNAP_TTL_H = 6
RUN_ID = "run0000000001"

STATE_CTES = f"""state_v AS (SELECT * FROM scored WHERE primary_language IS NOT NULL),
batch_v AS (SELECT * REPLACE (stars + 1 AS stars, forks + 1 AS forks, open_issues + 1 AS open_issues,
                              closed_issues + 1 AS closed_issues) FROM repos_v WHERE NOT is_archived),
classified AS (
  SELECT b.*, CASE WHEN s.id IS NULL THEN 'NEW'
                   WHEN s.updated_in_db_at IS NULL
                        OR (epoch_us({O.E_ASOF}) - epoch_us(s.updated_in_db_at)) / 3600000000.0 >= {TTL_H}
                   THEN 'REFRESH' ELSE 'SKIP' END AS refresh_class
  FROM batch_v b LEFT JOIN state_v s ON s.id = b.id
),
last_snap AS (SELECT repo_id, max(snapshot_at) AS last_snapshot_at FROM snaps_v GROUP BY repo_id),
gated AS (
  SELECT c.*, l.last_snapshot_at,
         c.refresh_class IN ('NEW', 'REFRESH') OR l.last_snapshot_at IS NULL
         OR (epoch_us({O.S_ASOF}) - epoch_us(l.last_snapshot_at)) / 3600000000.0 >= {SNAP_TTL_H} AS snapshot_due
  FROM classified c LEFT JOIN last_snap l ON l.repo_id = c.id
)"""


def state_and_batch(spark, sf_dir, views=None):
    repos, snaps = views = views or (freeze(_repos(spark, sf_dir)), _snaps(spark, sf_dir))
    state = scored(spark, sf_dir, views=views).where(F.col("primary_language").isNotNull())
    batch = repos.where(~F.col("is_archived")).withColumns(
        {c: F.col(c) + 1 for c in ("stars", "forks", "open_issues", "closed_issues")}
    )
    return state, batch


def state_sql(body: str) -> str:
    return O.scored_sql(body, STATE_CTES)


@register("classify_refresh", state_sql("SELECT id, refresh_class FROM classified"))
def q_classify(spark, sf_dir):
    state, batch = state_and_batch(spark, sf_dir)
    return st.classify_refresh(state, batch, ENTITY_AS_OF, TTL_H).select("id", "refresh_class")


@register(
    "snapshot_due",
    state_sql("SELECT id, refresh_class, last_snapshot_at, snapshot_due FROM gated"),
)
def q_snapshot_due(spark, sf_dir):
    views = shared(spark, sf_dir)
    state, batch = state_and_batch(spark, sf_dir, views)
    classified = st.classify_refresh(state, batch, ENTITY_AS_OF, TTL_H)
    return st.snapshot_due(classified, views[1], SNAPSHOT_AS_OF, SNAP_TTL_H).select(
        "id", "refresh_class", "last_snapshot_at", "snapshot_due"
    )


UPSERT_COLS = "id, stars, forks, open_issues, closed_issues, scraped_at, updated_in_db_at, potential_score"


@register(
    "upsert_state",
    state_sql(
        f"""SELECT coalesce(b.id, s.id) AS id,
  CASE WHEN b.id IS NOT NULL THEN b.stars ELSE s.stars END AS stars,
  CASE WHEN b.id IS NOT NULL THEN b.forks ELSE s.forks END AS forks,
  CASE WHEN b.id IS NOT NULL THEN b.open_issues ELSE s.open_issues END AS open_issues,
  CASE WHEN b.id IS NOT NULL THEN b.closed_issues ELSE s.closed_issues END AS closed_issues,
  CASE WHEN b.id IS NOT NULL THEN coalesce(s.scraped_at, {O.E_ASOF}) ELSE s.scraped_at END AS scraped_at,
  CASE WHEN b.id IS NOT NULL THEN {O.E_ASOF} ELSE s.updated_in_db_at END AS updated_in_db_at,
  s.potential_score,
  CASE WHEN b.id IS NOT NULL THEN s.id IS NULL END AS is_new
FROM state_v s FULL OUTER JOIN batch_v b ON s.id = b.id"""
    ),
)
def q_upsert(spark, sf_dir):
    state, batch = state_and_batch(spark, sf_dir)
    return st.upsert_state(state, batch, ENTITY_AS_OF).select(*UPSERT_COLS.split(", "), "is_new")


@register(
    "light_update",
    state_sql(
        f"""SELECT s.id,
  CASE WHEN b.id IS NOT NULL THEN b.stars ELSE s.stars END AS stars,
  CASE WHEN b.id IS NOT NULL THEN b.forks ELSE s.forks END AS forks,
  CASE WHEN b.id IS NOT NULL THEN b.open_issues ELSE s.open_issues END AS open_issues,
  CASE WHEN b.id IS NOT NULL THEN b.closed_issues ELSE s.closed_issues END AS closed_issues,
  s.scraped_at,
  CASE WHEN b.id IS NOT NULL THEN {O.E_ASOF} ELSE s.updated_in_db_at END AS updated_in_db_at,
  s.potential_score
FROM state_v s LEFT JOIN batch_v b ON s.id = b.id"""
    ),
)
def q_light(spark, sf_dir):
    state, batch = state_and_batch(spark, sf_dir)
    return st.light_update(state, batch, ENTITY_AS_OF).select(*UPSERT_COLS.split(", "))


APPLY_SQL = f"""SELECT coalesce(s.id, c.id) AS id,
  CASE WHEN c.refresh_class IS NOT NULL THEN c.stars ELSE s.stars END AS stars,
  CASE WHEN c.refresh_class IN ('NEW', 'REFRESH') THEN c.topics ELSE s.topics END AS topics,
  CASE WHEN c.refresh_class IN ('NEW', 'REFRESH') THEN c.readme_length_chars ELSE s.readme_length_chars END
    AS readme_length_chars,
  CASE WHEN c.refresh_class IN ('NEW', 'REFRESH') THEN coalesce(s.scraped_at, {O.E_ASOF}) ELSE s.scraped_at END
    AS scraped_at,
  CASE WHEN c.refresh_class IS NOT NULL THEN {O.E_ASOF} ELSE s.updated_in_db_at END AS updated_in_db_at,
  s.potential_score
FROM state_v s FULL OUTER JOIN classified c ON s.id = c.id"""


def _apply(spark, sf_dir, views=None):
    """The batch step; the state is read twice (to classify, to merge), so it is written once."""
    views = views or shared(spark, sf_dir)
    state, batch = state_and_batch(spark, sf_dir, views)
    return st.apply_batch(
        freeze(state), views[1], batch, ENTITY_AS_OF, TTL_H, SNAP_TTL_H, snapshot_as_of=SNAPSHOT_AS_OF
    )


@register("apply_batch", state_sql(APPLY_SQL))
def q_apply(spark, sf_dir):
    new_state, _, _ = _apply(spark, sf_dir)
    return new_state.select(
        "id", "stars", "topics", "readme_length_chars", "scraped_at", "updated_in_db_at", "potential_score"
    )


@register(
    "apply_batch_snapshots",
    state_sql(
        f"SELECT id AS repo_id, {O.S_ASOF} AS snapshot_at, stars, forks, open_issues FROM gated WHERE snapshot_due"
    ),
)
def q_apply_snaps(spark, sf_dir):
    _, snaps, _ = _apply(spark, sf_dir)
    return snaps


@register(
    "run_counters",
    state_sql(
        f"""SELECT '{RUN_ID}' AS run_id, CAST(NULL AS VARCHAR) AS query_string,
  {O.E_ASOF} AS started_at, {O.E_ASOF} + INTERVAL 1 HOUR AS finished_at,
  CAST(count(*) AS INTEGER) AS repos_found,
  CAST(count(*) FILTER (WHERE refresh_class = 'NEW') AS INTEGER) AS repos_new,
  0 AS repos_updated,
  CAST(count(*) FILTER (WHERE refresh_class = 'REFRESH') AS INTEGER) AS repos_refreshed,
  CAST(count(*) FILTER (WHERE refresh_class = 'SKIP') AS INTEGER) AS repos_skipped_fresh,
  CAST(count(*) FILTER (WHERE snapshot_due) AS INTEGER) AS snapshots_taken,
  CAST((SELECT count(*) FROM repos_v WHERE is_archived) AS INTEGER) AS errors_count,
  'completed' AS status
FROM gated"""
    ),
)
def q_run_counters(spark, sf_dir):
    from cohortlake.functions.features import ts_lit

    views = shared(spark, sf_dir)
    _, _, gated = _apply(spark, sf_dir, views)
    _, errors = split_valid(parse_pages(landed_pages(spark, sf_dir, views[0])))
    run = st.run_counters(gated, RUN_ID, ENTITY_AS_OF, "2001-08-02 01:00:00", errors=errors)
    return run.withColumn("finished_at", ts_lit("2001-08-02 01:00:00"))


@register(
    "append_snapshots",
    state_sql(
        f"""SELECT repo_id, snapshot_at, stars, forks, open_issues FROM snaps_v
UNION ALL SELECT id AS repo_id, {O.E_ASOF} AS snapshot_at, stars, forks, open_issues FROM batch_v"""
    ),
)
def q_append(spark, sf_dir):
    views = shared(spark, sf_dir)
    _, batch = state_and_batch(spark, sf_dir, views)
    return views[1].unionByName(st.make_snapshots(batch, ENTITY_AS_OF))


@register(
    "thin_snapshots",
    O.with_ctes(
        f"""chain AS (
  SELECT repo_id, min(snapshot_at) AS kept FROM snaps_v GROUP BY repo_id
  UNION ALL
  SELECT c.repo_id, (SELECT min(s.snapshot_at) FROM snaps_v s
                     WHERE s.repo_id = c.repo_id AND s.snapshot_at >= c.kept + INTERVAL {SNAP_TTL_H} HOUR)
  FROM chain c WHERE c.kept IS NOT NULL
)""".replace("chain AS", "RECURSIVE_PLACEHOLDER chain AS"),
        body="SELECT s.* FROM snaps_v s JOIN chain c ON s.repo_id = c.repo_id AND s.snapshot_at = c.kept",
    ).replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_PLACEHOLDER ", ""),
)
def q_thin(spark, sf_dir):
    return st.thin_snapshots(_snaps(spark, sf_dir), SNAP_TTL_H)


@register(
    "run_record",
    state_sql(
        f"""SELECT '{RUN_ID}' AS run_id, {O.E_ASOF} AS started_at, {O.E_ASOF} + INTERVAL 1 HOUR AS finished_at,
  CAST(count(*) AS INTEGER) AS repos_found, CAST(count(*) FILTER (WHERE snapshot_due) AS INTEGER) AS snapshots_taken,
  'completed' AS status
FROM gated"""
    ),
)
def q_run_record(spark, sf_dir):
    """A run is recorded twice (start: running, end: completed); the latest
    record per run id wins on read."""
    from cohortlake.functions.features import ts_lit

    _, _, gated = _apply(spark, sf_dir)
    end = st.run_counters(gated, RUN_ID, ENTITY_AS_OF, "2001-08-02 01:00:00")
    runs = st.started_run(end).unionByName(end.withColumn("finished_at", ts_lit("2001-08-02 01:00:00")))
    return st.latest_runs(runs).select(
        "run_id", "started_at", "finished_at", "repos_found", "snapshots_taken", "status"
    )
