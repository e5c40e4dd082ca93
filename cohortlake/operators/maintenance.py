"""Predicate-driven purge with cascade, dry-run preview and orphan handling.

Deletes are complements: survivors are the rows the predicate does not
match, snapshots survive by a semi join on surviving keys. Every count is a
distributed aggregate; previews come out as one-row DataFrames.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions.features import ts_lit
from cohortlake.schemas import ENTITY_SCHEMA, SNAPSHOT_SCHEMA
from cohortlake.session import freeze, scratch_scope
from cohortlake.sources import store


def purge_predicate(
    before: str | datetime | None = None,
    score_below: float | None = None,
    archived: bool = False,
    forks: bool = False,
    language: str | None = None,
) -> Column | None:
    """AND of the active filters; ``None`` when no filter is active.

    ``before``: ``scraped_at < before``; ``score_below``: score below the
    value or NULL; ``archived`` / ``forks``: flag is true; ``language``:
    case-insensitive equality.
    """
    conds = []
    if before:
        conds.append(F.col("scraped_at") < ts_lit(before))
    if score_below is not None:
        conds.append((F.col("potential_score") < F.lit(float(score_below))) | F.col("potential_score").isNull())
    if archived:
        conds.append(F.col("is_archived") == F.lit(True))
    if forks:
        conds.append(F.col("is_fork") == F.lit(True))
    if language:
        conds.append(F.lower(F.col("primary_language")) == F.lower(F.lit(language)))
    if not conds:
        return None
    return reduce(lambda a, b: a & b, conds)


def matches(pred: Column | None) -> Column:
    """NULL-safe match: no filter matches nothing; NULL counts as no match."""
    return F.lit(False) if pred is None else F.coalesce(pred, F.lit(False))


def orphan_snapshots(snaps: DataFrame, state: DataFrame, key: str = "id", snap_key: str = "repo_id") -> DataFrame:
    """Snapshots whose key has no entity (keys are non-NULL, so this equals NOT IN)."""
    return snaps.join(state.select(F.col(key).alias(snap_key)), snap_key, "left_anti")


def surviving_snapshots(snaps: DataFrame, state: DataFrame, key: str = "id", snap_key: str = "repo_id") -> DataFrame:
    return snaps.join(state.select(F.col(key).alias(snap_key)), snap_key, "left_semi")


def purge(
    state: DataFrame,
    snaps: DataFrame,
    pred: Column | None,
    all_data: bool = False,
    key: str = "id",
) -> tuple[DataFrame, DataFrame]:
    """Filtered delete with cascade: ``(surviving state, surviving snapshots)``.

    The cascade drops every snapshot without a surviving entity, including
    orphans that existed before. ``all_data`` empties both tables (same
    schemas). No active filter deletes nothing.
    """
    if all_data:
        return state.where(F.lit(False)), snaps.where(F.lit(False))
    if pred is None:
        return state, snaps
    survivors = state.where(~matches(pred))
    return survivors, surviving_snapshots(snaps, survivors, key)


def purge_counts(state: DataFrame, snaps: DataFrame, runs: DataFrame, purged: tuple[DataFrame, ...]) -> DataFrame:
    """What a purge deleted, as one row: entities, snapshots and run records before, deleted and left."""
    sizes = [df.agg(F.count(F.lit(1)).alias("n")).scalar() for df in (state, snaps, runs, *purged)]
    names = ("entities", "snapshots", "runs")
    row = state.sparkSession.range(1)
    return row.select(
        *[sizes[i].alias(f"{n}_before") for i, n in enumerate(names)],
        *[(sizes[i] - sizes[i + 3]).alias(f"{n}_deleted") for i, n in enumerate(names)],
        *[sizes[i + 3].alias(f"{n}_left") for i, n in enumerate(names)],
    )


def purge_tables(
    state: DataFrame, snaps: DataFrame, runs: DataFrame, pred: Column | None, all_data: bool = False, key: str = "id"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`purge` of all three tables; run records go with ``all_data`` only."""
    survivors, kept = purge(state, snaps, pred, all_data, key)
    return survivors, kept, runs.where(F.lit(False)) if all_data else runs


def purge_store(spark: SparkSession, root: str, pred: Column | None = None, all_data: bool = False) -> tuple[int, int]:
    """Purge the stored tables in place: (deleted entities, deleted snapshots).

    An entity goes with its rows of all batches, and so do its snapshots and those
    without an entity. Only partitions that hold such rows are rewritten; no active
    filter deletes nothing. With ``all_data`` the tables' folders go.
    """
    if pred is None and not all_data:
        return 0, 0
    with scratch_scope(spark):
        state = store.read_state(spark, root, ENTITY_SCHEMA)
        snaps = store.read_appended(spark, root, "snapshots", SNAPSHOT_SCHEMA)
        if all_data:
            counts = state.count(), snaps.count()
            for table in store.PARTITIONED:
                store.drop(spark, store.path_of(root, table))
            return counts
        hit = matches(pred)
        gone = freeze(state.where(hit).select("id"))
        kept = freeze(state.where(~hit).select(F.col("id").alias("repo_id")))
        n_snaps = 0
        for table, schema, stays in (("state", ENTITY_SCHEMA, lambda r: r.join(gone, "id", "left_anti")), ("snapshots", SNAPSHOT_SCHEMA, lambda r: r.join(kept, "repo_id", "left_semi"))):
            rows = store.read_rows(spark, root, table, schema)
            names = [f.name for f in store.PARTITIONED[table]]
            before, after = (x.groupBy(*names).count() for x in (rows, stays(rows)))
            sizes = before.withColumnRenamed("count", "n").join(after, names, "left").where("count IS NULL OR count < n")
            touched = freeze(sizes.select(*names, (F.col("n") - F.coalesce("count", F.lit(0))).alias("n")))
            n_snaps = touched.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
            left = freeze(stays(rows.join(touched.select(*names), names, "left_semi")))
            store.replace_rows(spark, root, table, touched.select(*names), left.select(*rows.columns))
        return gone.count(), n_snaps


def purge_preview(
    state: DataFrame,
    snaps: DataFrame,
    pred: Column | None,
    all_data: bool = False,
    key: str = "id",
    snap_key: str = "repo_id",
) -> DataFrame:
    """Dry-run counts as one row: entities to delete, snapshots of those
    entities (cascade) and orphan snapshots.

    Snapshots are first counted per key (partial aggregation, so a key with
    a huge history is one row), then one full outer join with the per-entity
    match flag and one global aggregate give all three counts: each input is
    read once. With ``all_data`` every snapshot goes, so all count as cascaded.
    """
    hit = F.lit(True) if all_data else matches(pred)
    flags = state.select(F.col(key).alias(snap_key), hit.alias("_hit"), F.lit(True).alias("_entity"))
    per_key = snaps.groupBy(snap_key).agg(F.count(F.lit(1)).alias("_n"))
    joined = flags.join(per_key, snap_key, "full_outer")
    n = F.coalesce(F.col("_n"), F.lit(0))

    def total(which: Column) -> Column:
        return F.coalesce(F.sum(F.when(which, n)), F.lit(0)).cast("long")

    return joined.agg(
        F.count_if(F.col("_entity") & F.col("_hit")).alias("repos_to_delete"),
        total(F.lit(True) if all_data else F.col("_entity") & F.col("_hit")).alias("cascaded_snapshots"),
        total(F.col("_entity").isNull()).alias("orphan_snapshots"),
    )
