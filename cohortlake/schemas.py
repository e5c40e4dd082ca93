"""Declared table schemas, column defaults and additive schema evolution.

The three stored tables are the entity state (one row per id), the append-only
counter snapshots (one row per id and time) and the ingest-run records.
Parquet has neither primary keys nor column defaults, so keys are enforced by
the state operators and defaults by :func:`conform`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, I, B, D, TS = T.StringType(), T.IntegerType(), T.BooleanType(), T.DoubleType(), T.TimestampType()

ENTITY_SCHEMA = T.StructType(
    [
        T.StructField("id", S, False),
        T.StructField("name", S, False),
        T.StructField("full_name", S, False),
        T.StructField("owner_login", S),
        T.StructField("owner_type", S),
        T.StructField("description", S),
        T.StructField("url", S),
        T.StructField("homepage_url", S),
        T.StructField("primary_language", S),
        T.StructField("topics", T.ArrayType(S)),
        T.StructField("license_spdx", S),
        T.StructField("is_archived", B),
        T.StructField("is_fork", B),
        T.StructField("is_template", B),
        T.StructField("stars", I),
        T.StructField("forks", I),
        T.StructField("watchers", I),
        T.StructField("open_issues", I),
        T.StructField("closed_issues", I),
        T.StructField("created_at", TS),
        T.StructField("updated_at", TS),
        T.StructField("pushed_at", TS),
        T.StructField("disk_usage_kb", I),
        T.StructField("readme_length_chars", I),
        T.StructField("readme_h2_sections", I),
        T.StructField("readme_has_badges", B),
        T.StructField("readme_has_demo_gif", B),
        T.StructField("readme_has_install", B),
        T.StructField("contributors_count", I),
        T.StructField("releases_count", I),
        T.StructField("latest_release_tag", S),
        T.StructField("latest_release_at", TS),
        T.StructField("star_velocity", D),
        T.StructField("momentum_7d", D),
        T.StructField("activity_score", D),
        T.StructField("readme_quality", D),
        T.StructField("potential_score", D),
        T.StructField("HG_score", D),
        T.StructField("age_tier", S),
        T.StructField("maturity_tier", S),
        T.StructField("scraped_at", TS),
        T.StructField("updated_in_db_at", TS),
    ]
)

SNAPSHOT_SCHEMA = T.StructType(
    [
        T.StructField("repo_id", S, False),
        T.StructField("snapshot_at", TS, False),
        T.StructField("stars", I),
        T.StructField("forks", I),
        T.StructField("open_issues", I),
    ]
)

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", S, False),
        T.StructField("query_string", S),
        T.StructField("started_at", TS),
        T.StructField("finished_at", TS),
        T.StructField("repos_found", I),
        T.StructField("repos_new", I),
        T.StructField("repos_updated", I),
        T.StructField("repos_refreshed", I),
        T.StructField("repos_skipped_fresh", I),
        T.StructField("snapshots_taken", I),
        T.StructField("errors_count", I),
        T.StructField("status", S),
    ]
)

QUARANTINE_SCHEMA = T.StructType([T.StructField("raw_node", S), T.StructField("reasons", T.ArrayType(S))])

# Column defaults of the stored tables (a default applies when a
# column is absent; present NULLs stay NULL).
ENTITY_DEFAULTS = {
    "is_archived": False,
    "is_fork": False,
    "is_template": False,
    "stars": 0,
    "forks": 0,
    "watchers": 0,
    "open_issues": 0,
    "closed_issues": 0,
    "readme_has_badges": False,
    "readme_has_demo_gif": False,
    "readme_has_install": False,
}
RUN_DEFAULTS = {
    "repos_found": 0,
    "repos_new": 0,
    "repos_updated": 0,
    "repos_refreshed": 0,
    "repos_skipped_fresh": 0,
    "snapshots_taken": 0,
    "errors_count": 0,
}

def conform(
    df: DataFrame,
    schema: T.StructType,
    defaults: dict | None = None,
    keep_extra: bool = False,
) -> DataFrame:
    """Additive schema evolution: add missing columns with their typed default.

    Columns present in ``df`` are cast to the declared type; absent columns
    are added as ``default`` (or NULL) of the declared type. The output has the
    declared column order; columns not in ``schema`` are dropped unless
    ``keep_extra``. A pure projection: no shuffle, no scan of extra columns.
    """
    defaults = defaults or {}
    present = set(df.columns)
    cols: list[Column] = []
    for field in schema.fields:
        if field.name in present:
            cols.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            value = defaults.get(field.name)
            cols.append(F.lit(value).cast(field.dataType).alias(field.name))
    if keep_extra:
        known = {f.name for f in schema.fields}
        cols.extend(F.col(c) for c in df.columns if c not in known)
    return df.select(*cols)
