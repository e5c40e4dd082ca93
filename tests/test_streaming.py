import base64
import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import maintenance as mt
from cohortlake.operators.scoring import score_store
from cohortlake.operators.state import latest_runs
from cohortlake.schemas import ENTITY_SCHEMA, RUN_SCHEMA, SNAPSHOT_SCHEMA
from cohortlake.session import scratch_dir
from cohortlake.sources import store
from cohortlake.sources.landed import enrichment
from cohortlake.streaming.ingest import process_batch, start_ingest
from test_ingest_text import node

T0 = datetime(2026, 3, 1)


def page(nodes):
    return json.dumps({"data": {"search": {"repositoryCount": len(nodes), "pageInfo": {}, "nodes": nodes}}})


def pages(spark, nodes, hours=0):
    at = F.lit((T0 + timedelta(hours=hours)).isoformat()).cast("timestamp").alias("landed_at")
    return spark.createDataFrame([(page(nodes),)], "value string").select("value", at)


def state_of(spark, root):
    return {r["id"]: r for r in store.read_state(spark, root, ENTITY_SCHEMA).collect()}


def runs_of(spark, root):
    rows = store.read_appended(spark, root, "runs", RUN_SCHEMA).where("status <> 'running'").collect()
    return {r["run_id"][-1]: (r["repos_new"], r["repos_refreshed"], r["repos_skipped_fresh"], r["snapshots_taken"], r["errors_count"]) for r in rows}


def responses(spark):
    text = "# T\n## a\n## b\n[![x](y)]"
    bodies = spark.createDataFrame([("a", base64.encodebytes(text.encode()).decode())], "id string, content_b64 string")
    link = '<https://x?per_page=1&page=9>; rel="last"'
    listed = spark.createDataFrame([("a", link, "[{}]")], "id string, link string, body string")
    return enrichment(bodies, listed, listed.withColumn("body", F.lit('[{"tag_name": "v3", "published_at": "2026-01-02T00:00:00Z"}]')))


def test_stream_and_replay(spark, tmp_dir):
    landing, root, ckpt = (os.path.join(tmp_dir, x) for x in ("landing", "store", "ckpt"))
    os.makedirs(landing)

    def land(name, text):
        with open(os.path.join(landing, name), "w") as f:
            f.write(text)

    def run(**kw):
        start_ingest(spark, landing, root, ckpt, available_now=True, one_page_per_file=True, **kw).awaitTermination(300)

    land("p0.json", "{truncated")
    land("p1.json", page([node(id="a"), node(id="b", stargazerCount=20), node(owner=None)]))
    run()
    assert sorted(state_of(spark, root)) == ["a", "b"]
    assert runs_of(spark, root) == {"0": (2, 0, 0, 2, 2)}
    assert store.read_appended(spark, root, "snapshots", SNAPSHOT_SCHEMA).count() == 2

    # the same batch again rewrites the same folders: nothing is duplicated
    again = spark.read.format("text").option("wholetext", True).load(landing).select("value", F.col("_metadata.file_modification_time").alias("landed_at"))
    process_batch(spark, again, 0, root)
    assert store.read_appended(spark, root, "snapshots", SNAPSHOT_SCHEMA).count() == 2

    land("p2.json", page([node(id="b", stargazerCount=25), node(id="c")]))
    run(max_files=1)
    state = state_of(spark, root)
    assert sorted(state) == ["a", "b", "c"] and state["b"]["stars"] == 25
    assert runs_of(spark, root)["1"] == (1, 0, 1, 1, 0)


def test_batches_without_times_or_valid_nodes_are_committed(spark, tmp_dir):
    process_batch(spark, pages(spark, [node(id="a", updatedAt="ABSENT")]), 0, tmp_dir)
    process_batch(spark, pages(spark, [node(id="ABSENT"), 5], 1), 1, tmp_dir)
    process_batch(spark, pages(spark, [], 2), 2, tmp_dir)
    assert list(state_of(spark, tmp_dir)) == ["a"]
    assert runs_of(spark, tmp_dir) == {"0": (1, 0, 0, 1, 0), "1": (0, 0, 0, 0, 2), "2": (0, 0, 0, 0, 0)}
    started = store.read_appended(spark, tmp_dir, "runs", RUN_SCHEMA).where("status = 'running'").collect()
    assert len(started) == 3 and all(r["finished_at"] is None and r["repos_found"] == 0 for r in started)


def test_a_refresh_keeps_what_it_does_not_carry(spark, tmp_dir):
    process_batch(spark, pages(spark, [node(id="a"), node(id="b")]), 0, tmp_dir, enrichment=responses)
    first = state_of(spark, tmp_dir)
    assert (first["a"]["readme_length_chars"], first["a"]["readme_h2_sections"], first["a"]["readme_has_badges"]) == (23, 2, True)
    assert (first["a"]["contributors_count"], first["a"]["releases_count"], first["a"]["latest_release_tag"]) == (9, 9, "v3")
    assert first["b"]["readme_length_chars"] is None and first["b"]["readme_has_badges"] is False
    none = lambda s: responses(s).where("false")
    for batch, landed in ((1, None), (2, none)):
        process_batch(spark, pages(spark, [node(id="a", stargazerCount=50 + batch)], 30 * batch), batch, tmp_dir, force=True, enrichment=landed)
        now = state_of(spark, tmp_dir)["a"]
        assert now["stars"] == 50 + batch
        same = ("readme_length_chars", "readme_has_badges", "contributors_count", "releases_count", "latest_release_at", "scraped_at")
        assert all(now[c] == first["a"][c] for c in same)


def test_the_clock_never_runs_back(spark, tmp_dir):
    for batch, hours in enumerate((10, 2, 10)):
        process_batch(spark, pages(spark, [node(id="a")], hours), batch, tmp_dir, force=True)
    times = [r["snapshot_at"] for r in store.read_appended(spark, tmp_dir, "snapshots", SNAPSHOT_SCHEMA).orderBy("snapshot_at").collect()]
    assert len(times) == len(set(times)) == 3 and times[0] == T0 + timedelta(hours=10)
    assert state_of(spark, tmp_dir)["a"]["updated_in_db_at"] == times[-1]


def test_the_gate_reads_recent_batches_only(spark, tmp_dir):
    for batch, hours in enumerate((0, 1, 7, 8)):
        process_batch(spark, pages(spark, [node(id="a")], hours), batch, tmp_dir)
    assert [runs_of(spark, tmp_dir)[str(b)][3] for b in range(4)] == [1, 0, 1, 0]
    since = T0 + timedelta(hours=2)
    assert store.read_appended(spark, tmp_dir, "snapshots", SNAPSHOT_SCHEMA, since=since).count() == 1
    assert store.read_appended(spark, tmp_dir, "snapshots", SNAPSHOT_SCHEMA, since=T0 + timedelta(days=9)).count() == 0


def test_a_store_that_cannot_be_read_is_an_error(spark, tmp_dir):
    process_batch(spark, pages(spark, [node(id="a")]), 0, tmp_dir)
    for folder, _, files in os.walk(os.path.join(tmp_dir, "state")):
        for f in files:
            if f.endswith(".parquet"):
                with open(os.path.join(folder, f), "wb") as out:
                    out.write(b"broken")
    with pytest.raises(Exception):  # noqa: B017
        process_batch(spark, pages(spark, [node(id="a")], 1), 1, tmp_dir)


def test_failed_runs_leave_a_record(spark, tmp_dir):
    def broken(_):
        raise OSError("no responses")

    with pytest.raises(OSError):
        process_batch(spark, pages(spark, [node(id="a")]), 0, tmp_dir, enrichment=broken)
    records = lambda: store.read_appended(spark, tmp_dir, "runs", RUN_SCHEMA)
    assert not state_of(spark, tmp_dir) and sorted(r["status"] for r in records().collect()) == ["failed", "running"]
    assert [r["status"] for r in latest_runs(records()).collect()] == ["failed"]
    process_batch(spark, pages(spark, [node(id="a")]), 0, tmp_dir)
    assert [(r["status"], r["repos_new"]) for r in latest_runs(records()).collect()] == [("completed", 1)] and records().count() == 3


def test_a_batch_reads_the_partitions_of_its_keys(spark, tmp_dir, capsys):
    process_batch(spark, pages(spark, [node(id=f"n{i}") for i in range(300)]), 0, tmp_dir)
    rows = store.read_rows(spark, tmp_dir, "state", ENTITY_SCHEMA)
    assert rows.select("part").distinct().count() > store.PARTS // 2 and rows.where(F.col("part") != store.part_of("id")).count() == 0
    files = {f: os.stat(f).st_mtime_ns for f in rows.inputFiles() for f in [f.removeprefix("file://")]}
    one = spark.createDataFrame([("n7",)], "id string")
    store.read_state(spark, tmp_dir, ENTITY_SCHEMA, keys=one).explain("formatted")
    assert "part#" in capsys.readouterr().out.split("PartitionFilters")[1][:100]
    store.read_appended(spark, tmp_dir, "snapshots", SNAPSHOT_SCHEMA, since=T0).explain("formatted")
    assert "day#" in capsys.readouterr().out.split("PartitionFilters")[1][:100]
    process_batch(spark, pages(spark, [node(id="n7", stargazerCount=77)], 30), 1, tmp_dir, force=True)
    assert store.read_rows(spark, tmp_dir, "state", ENTITY_SCHEMA).where("batch = 1").count() == 1
    assert all(os.stat(f).st_mtime_ns == t for f, t in files.items())  # what was stored is not touched
    assert state_of(spark, tmp_dir)["n7"]["stars"] == 77 and len(state_of(spark, tmp_dir)) == 300


def test_a_purge_rewrites_what_it_touches(spark, tmp_dir):
    nodes = [node(id=f"n{i}", isArchived=i == 7) for i in range(300)]
    process_batch(spark, pages(spark, nodes), 0, tmp_dir)
    process_batch(spark, pages(spark, nodes[5:9], 30), 1, tmp_dir, force=True)
    files = {f: os.stat(f).st_mtime_ns for f in (f.removeprefix("file://") for f in store.read_rows(spark, tmp_dir, "state", ENTITY_SCHEMA).inputFiles())}
    assert mt.purge_store(spark, tmp_dir, mt.purge_predicate(archived=True)) == (1, 2)
    assert "n7" not in state_of(spark, tmp_dir) and len(state_of(spark, tmp_dir)) == 299
    assert sum(os.path.exists(f) and os.stat(f).st_mtime_ns == t for f, t in files.items()) >= len(files) - 2


def test_scores_and_purges_of_the_stored_tables(spark, tmp_dir):
    process_batch(spark, pages(spark, [node(id="a", isArchived=True), node(id="b", stargazerCount=900), node(id="c")]), 0, tmp_dir)
    score_store(spark, tmp_dir, 1, T0)
    scored = state_of(spark, tmp_dir)
    assert all(r["potential_score"] is not None and r["age_tier"] for r in scored.values()) and len(scored) == 3
    assert mt.purge_store(spark, tmp_dir, mt.purge_predicate()) == (0, 0)
    assert mt.purge_store(spark, tmp_dir, mt.purge_predicate(archived=True)) == (1, 1)
    assert sorted(state_of(spark, tmp_dir)) == ["b", "c"]
    assert store.read_appended(spark, tmp_dir, "snapshots", SNAPSHOT_SCHEMA).count() == 2
    assert len(runs_of(spark, tmp_dir)) == 1
    assert mt.purge_store(spark, tmp_dir, all_data=True) == (2, 2)
    assert not state_of(spark, tmp_dir) and not runs_of(spark, tmp_dir)
    process_batch(spark, pages(spark, [node(id="z")], 1), 4, tmp_dir)
    assert list(state_of(spark, tmp_dir)) == ["z"]


def test_scratch_tables_of_a_batch_are_dropped(spark, tmp_dir):
    scratch = os.path.dirname(scratch_dir(spark, "x")).removeprefix("file:")
    before = set(os.listdir(scratch)) if os.path.isdir(scratch) else set()
    process_batch(spark, pages(spark, [node(id="a")]), 0, tmp_dir)
    score_store(spark, tmp_dir, 1, T0)
    assert set(os.listdir(scratch)) - before == set()
    assert state_of(spark, tmp_dir)["a"]["potential_score"] is not None
