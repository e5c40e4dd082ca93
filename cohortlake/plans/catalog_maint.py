"""Registered queries for maintenance, schema evolution, write-back and export.

The store for these is the scored entities with a known language (so the
snapshots of entities without one are orphans) and the full snapshot view.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.operators import maintenance as mt
from cohortlake.operators.scoring import write_scores
from cohortlake.plans import oracle as O
from cohortlake.plans.catalog import _repos, _snaps, register, scored, shared
from cohortlake.schemas import ENTITY_DEFAULTS, ENTITY_SCHEMA, conform
from cohortlake.session import freeze, scratch_dir
from cohortlake.sources.export import export, read_csv
from cohortlake.sources.fixtures import ENTITY_AS_OF
from cohortlake.sources.tables import driver_table

FILTERS = {"score_below": 40.0, "archived": True}
FILTER_SQL = "((potential_score < 40.0 OR potential_score IS NULL) AND is_archived = true)"
STORE_CTE = "store AS (SELECT * FROM scored WHERE primary_language IS NOT NULL)"


def store(spark, sf_dir, views=None):
    return scored(spark, sf_dir, views=views).where(F.col("primary_language").isNotNull())


def maint_sql(body: str) -> str:
    return O.scored_sql(body, STORE_CTE)


@register("purge_match", maint_sql(f"SELECT id, coalesce({FILTER_SQL}, false) AS purge_match FROM store"))
def q_purge_match(spark, sf_dir):
    return store(spark, sf_dir).select("id", mt.matches(mt.purge_predicate(**FILTERS)).alias("purge_match"))


@register(
    "purge_preview",
    maint_sql(
        f"""SELECT (SELECT count(*) FROM store WHERE {FILTER_SQL}) AS repos_to_delete,
  (SELECT count(*) FROM snaps_v WHERE repo_id IN (SELECT id FROM store WHERE {FILTER_SQL})) AS cascaded_snapshots,
  (SELECT count(*) FROM snaps_v WHERE repo_id NOT IN (SELECT id FROM store)) AS orphan_snapshots"""
    ),
)
def q_purge_preview(spark, sf_dir):
    views = shared(spark, sf_dir)
    return mt.purge_preview(store(spark, sf_dir, views), views[1], mt.purge_predicate(**FILTERS))


@register("purge_survivors", maint_sql(f"SELECT id, potential_score FROM store WHERE NOT coalesce({FILTER_SQL}, false)"))
def q_purge_survivors(spark, sf_dir):
    views = shared(spark, sf_dir)
    survivors, _ = mt.purge(store(spark, sf_dir, views), views[1], mt.purge_predicate(**FILTERS))
    return survivors.select("id", "potential_score")


@register(
    "survivor_snapshots",
    maint_sql(
        f"SELECT * FROM snaps_v WHERE repo_id IN (SELECT id FROM store WHERE NOT coalesce({FILTER_SQL}, false))"
    ),
)
def q_survivor_snaps(spark, sf_dir):
    views = shared(spark, sf_dir)
    _, snaps = mt.purge(store(spark, sf_dir, views), views[1], mt.purge_predicate(**FILTERS))
    return snaps


@register("orphan_snapshots", maint_sql("SELECT * FROM snaps_v WHERE repo_id NOT IN (SELECT id FROM store)"))
def q_orphans(spark, sf_dir):
    views = shared(spark, sf_dir)
    return mt.orphan_snapshots(views[1], store(spark, sf_dir, views))


@register(
    "conform_schema",
    O.scored_sql(
        "SELECT CAST(id AS VARCHAR) AS id, name, stars, 0 AS closed_issues, CAST(NULL AS DOUBLE) AS HG_score, "
        "0 AS watchers, false AS is_template, CAST(NULL AS VARCHAR[]) AS topics, age_tier, scraped_at FROM scored"
    ),
)
def q_conform(spark, sf_dir):
    old = scored(spark, sf_dir).select(
        "id", "name", "full_name", "stars", "forks", "open_issues", "age_tier", "maturity_tier", "scraped_at",
        "updated_in_db_at",
    )
    return conform(old, ENTITY_SCHEMA, ENTITY_DEFAULTS).select(
        "id", "name", "stars", "closed_issues", "HG_score", "watchers", "is_template", "topics", "age_tier",
        "scraped_at",
    )


@register(
    "score_writeback",
    O.scored_sql(
        f"SELECT id, stars, potential_score, HG_score, activity_score, age_tier, maturity_tier, "
        f"{O.E_ASOF} AS updated_in_db_at FROM scored"
    ),
)
def q_writeback(spark, sf_dir):
    state, snaps = freeze(_repos(spark, sf_dir)), _snaps(spark, sf_dir)
    out = write_scores(state, scored(spark, sf_dir, views=(state, snaps)), ENTITY_AS_OF)
    return out.select(
        "id", "stars", "potential_score", "HG_score", "activity_score", "age_tier", "maturity_tier", "updated_in_db_at"
    )


EXPORT_COLS = ["id", "full_name", "topics", "potential_score", "HG_score"]


@register("export_parquet", O.scored_sql(f"SELECT {', '.join(EXPORT_COLS)} FROM scored"))
def q_export_parquet(spark, sf_dir):
    path = scratch_dir(spark, "scores") + ".parquet"
    export(scored(spark, sf_dir).select(*EXPORT_COLS), path)
    return spark.read.parquet(path)


CSV_SCHEMA = "id long, full_name string, topics string, potential_score double, HG_score double, note string"


@register(
    "export_csv_rows",
    O.scored_sql(
        """SELECT id, full_name, '"' || full_name || '", ' || chr(10) || 'said "' || id || '"' AS note,
  array_to_string(topics, ', ') AS topics, potential_score, HG_score FROM scored"""
    ),
)
def q_export_csv(spark, sf_dir):
    """Names in quotes and line breaks too, written and read back."""
    path = scratch_dir(spark, "scores") + ".csv"
    note = F.concat(F.lit('"'), "full_name", F.lit('", \nsaid "'), F.col("id").cast("string"), F.lit('"'))
    export(scored(spark, sf_dir).select(*EXPORT_COLS, note.alias("note")), path)
    return read_csv(spark, path, CSV_SCHEMA)


# A run record for each month of orders.
RUNS_CTE = "runs_v AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS run_id FROM orders)"


def run_records(spark, sf_dir):
    return driver_table(spark, sf_dir, "orders", ["o_orderdate"]).select(F.date_format("o_orderdate", "yyyy-MM").alias("run_id")).distinct()


def _purged(spark, sf_dir, pred, all_data=False):
    views = shared(spark, sf_dir)
    state, snaps, runs = freeze(store(spark, sf_dir, views)), views[1], run_records(spark, sf_dir)
    return mt.purge_counts(state, snaps, runs, mt.purge_tables(state, snaps, runs, pred, all_data))


COUNTS_SQL = """SELECT {e} AS entities_before, {s} AS snapshots_before, {r} AS runs_before, {ed} AS entities_deleted,
  {sd} AS snapshots_deleted, {rd} AS runs_deleted, {e} - {ed} AS entities_left, {s} - {sd} AS snapshots_left, {r} - {rd} AS runs_left"""
ALL_ROWS = {"e": "(SELECT count() FROM store)", "s": "(SELECT count() FROM snaps_v)", "r": "(SELECT count() FROM runs_v)"}


@register(
    "purge_all",
    O.scored_sql(COUNTS_SQL.format(**ALL_ROWS, ed=ALL_ROWS["e"], sd=ALL_ROWS["s"], rd=ALL_ROWS["r"]), STORE_CTE, RUNS_CTE),
)
def q_purge_all(spark, sf_dir):
    """Everything goes: the counts of all three tables before, deleted and left."""
    return _purged(spark, sf_dir, mt.purge_predicate(), all_data=True)


@register(
    "purge_filtered_counts",
    O.scored_sql(
        COUNTS_SQL.format(
            **ALL_ROWS,
            ed=f"(SELECT count() FROM store WHERE {FILTER_SQL})",
            sd=f"(SELECT count() FROM snaps_v ANTI JOIN (SELECT id AS repo_id FROM store WHERE NOT coalesce({FILTER_SQL}, false)) USING (repo_id))",
            rd="CAST(0 AS BIGINT)",
        ),
        STORE_CTE,
        RUNS_CTE,
    ),
)
def q_purge_filtered(spark, sf_dir):
    return _purged(spark, sf_dir, mt.purge_predicate(**FILTERS))


@register(
    "purge_preview_all",
    maint_sql(
        "SELECT (SELECT count() FROM store) AS repos_to_delete, (SELECT count() FROM snaps_v) AS cascaded_snapshots, "
        "(SELECT count() FROM snaps_v ANTI JOIN (SELECT id AS repo_id FROM store) USING (repo_id)) AS orphan_snapshots"
    ),
)
def q_preview_all(spark, sf_dir):
    views = shared(spark, sf_dir)
    return mt.purge_preview(store(spark, sf_dir, views), views[1], None, all_data=True)


SINGLE_FILTERS = {"before": "2000-06-01", "forks": True, "language": "buIlding"}


@register(
    "purge_single_filters",
    maint_sql(
        "SELECT id, coalesce(scraped_at < TIMESTAMP '2000-06-01', false) AS by_before, coalesce(is_fork, false) AS by_forks, "
        "coalesce(lower(primary_language) = 'building', false) AS by_language FROM store"
    ),
)
def q_single_filters(spark, sf_dir):
    hits = [mt.matches(mt.purge_predicate(**{k: v})).alias(f"by_{k}") for k, v in SINGLE_FILTERS.items()]
    return store(spark, sf_dir).select("id", *hits)
