"""Continuous ingest of landed search-result pages (Structured Streaming).

``readStream`` picks up new page files; each micro-batch is parsed and split
(malformed nodes stored with their reasons and counted), de-duplicated by key, enriched from landed responses,
applied to the stored rows of its keys with :func:`cohortlake.operators.state.apply_batch`
and appended to the stored tables (:mod:`cohortlake.sources.store`). The run's start
record is written before the work, its end or failed record after. ``foreachBatch``
is at-least-once; everything is partitioned by batch id and a batch reads earlier
batches only, so a replayed batch replaces exactly what it wrote before.

The batch's as-of time is when its newest file landed, but always later than
the last batch's: a replay computes the same, clocks never run back and
no two batches write a snapshot of the same key and time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cohortlake.operators import state as st
from cohortlake.schemas import ENTITY_DEFAULTS, ENTITY_SCHEMA, RUN_DEFAULTS, RUN_SCHEMA, SNAPSHOT_SCHEMA, conform
from cohortlake.session import freeze, scratch_scope
from cohortlake.sources import store
from cohortlake.sources.pages import flat_columns, node_valid, parse_all, reasons_of

PAGE_TEXT, LANDED_AT = "value", "landed_at"

#: Gives the landed enrichment, one row per ``id`` (see sources.landed.enrichment).
Enrichment = Callable[[SparkSession], DataFrame]


def batch_time(pages: DataFrame, last: datetime | None) -> datetime:
    """When the newest file landed, later than ``last`` in any case."""
    landed = pages.agg(F.unix_micros(F.max(LANDED_AT)).alias("us")).head()["us"]
    times = [datetime(1970, 1, 1)]
    times += [store.utc(landed)] if landed is not None else []
    times += [last + timedelta(microseconds=1)] if last is not None else []
    return max(times)


def process_batch(
    spark: SparkSession,
    pages: DataFrame,
    batch_id: int,
    root: str,
    refresh_ttl_hours: float = st.REFRESH_TTL_HOURS,
    snapshot_ttl_hours: float = st.SNAPSHOT_TTL_HOURS,
    force: bool = False,
    enrichment: Enrichment | None = None,
) -> None:
    """Apply one batch of raw pages (columns ``value`` and ``landed_at``) to the store.

    A column that the batch does not carry keeps its stored value, and so do the
    enrichment columns of entities for which no response has landed. If the work
    fails, a failed run record is left, and the error goes on to the stream, which
    tries the batch again.
    """
    last = store.read_rows(spark, root, "runs", RUN_SCHEMA, before_batch=batch_id).agg(F.unix_micros(F.max("started_at"))).head()[0]
    as_of = batch_time(pages, store.utc(last) if last is not None else None)
    run_id = f"batch-{batch_id:012d}"
    with scratch_scope(spark), _recorded(spark, root, batch_id, run_id, as_of):
        # each page is parsed once: the flat rows and the bad nodes are a table, counted as it is written
        parsed = parse_all(pages, PAGE_TEXT).withColumn("ok", F.col("page_ok") & node_valid())
        bad = [F.when(~F.col("ok"), c).alias(n) for n, c in (("raw_node", F.col("raw_node")), ("reasons", reasons_of()))]
        seen = Observation()
        nodes = freeze(parsed.select("ok", *bad, *flat_columns()).observe(seen, F.count_if(~F.col("ok")).alias("errors")))
        errors = seen.get["errors"]
        good = nodes.where("ok").drop("ok", "raw_node", "reasons")
        # only what earlier batches wrote, never this batch's own output, and only of this batch's keys
        state = store.read_state(spark, root, ENTITY_SCHEMA, before_batch=batch_id, keys=good)
        young = as_of - timedelta(hours=snapshot_ttl_hours)
        snaps = store.read_appended(spark, root, "snapshots", SNAPSHOT_SCHEMA, before_batch=batch_id, since=young)
        only_if = {}
        if enrichment is not None:
            landed = enrichment(spark)
            only_if = {c: "_enriched" for c in landed.columns if c != "id"}
            good = good.join(landed.withColumn("_enriched", F.lit(True)), "id", "left")
        # apply_batch keeps one row per key (the latest updated_at wins)
        new_state, new_snaps, gated = st.apply_batch(
            state, snaps, good, as_of, refresh_ttl_hours, snapshot_ttl_hours, force, order_by="updated_at", only_if=only_if
        )
        flags = [c for c, v in ENTITY_DEFAULTS.items() if v is False]
        changed = conform(new_state, ENTITY_SCHEMA).na.fill(False, flags)
        store.write_batch(root, batch_id, changed, conform(new_snaps, SNAPSHOT_SCHEMA))
        if errors:
            malformed = nodes.where("NOT ok").select("raw_node", "reasons")
            store.write(malformed.withColumn("batch", F.lit(int(batch_id))), root, "quarantine")
        run = conform(st.run_counters(gated, run_id, as_of, as_of, errors=errors), RUN_SCHEMA)
        _record(run, root, batch_id, "ended")


def _record(run: DataFrame, root: str, batch_id: int, record: str) -> None:
    store.write(run.withColumn("batch", F.lit(int(batch_id))).withColumn("record", F.lit(record)), root, "runs")


@contextmanager
def _recorded(spark: SparkSession, root: str, batch_id: int, run_id: str, as_of: datetime) -> Iterator[None]:
    """Writes the start record, and a failed one if the work within fails; the error goes on."""

    def bare(status: str) -> DataFrame:
        row = spark.range(1).select(F.lit(run_id).alias("run_id"), st.ts_lit(as_of).alias("started_at"), F.lit(status).alias("status"))
        return conform(row, RUN_SCHEMA, RUN_DEFAULTS)

    _record(bare("running"), root, batch_id, "started")
    try:
        yield
    except Exception:
        _record(bare("failed"), root, batch_id, "failed")
        raise


def start_ingest(
    spark: SparkSession,
    landing_dir: str,
    root: str,
    checkpoint_location: str,
    available_now: bool = False,
    processing_time: str | None = None,
    one_page_per_file: bool = False,
    max_files: int | None = 1000,
    **kwargs,
) -> StreamingQuery:
    """Start the stream over ``landing_dir``: JSON lines (one page per
    line, many pages per file) or, with ``one_page_per_file``, whole files.
    A backlog is taken ``max_files`` at a time, oldest first."""
    reader = spark.readStream.format("text").option("wholetext", bool(one_page_per_file))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    pages = reader.load(landing_dir).select(PAGE_TEXT, F.col("_metadata.file_modification_time").alias(LANDED_AT))
    writer = pages.writeStream.foreachBatch(
        lambda df, batch_id: process_batch(spark, df, batch_id, root, **kwargs)
    ).option("checkpointLocation", checkpoint_location)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
