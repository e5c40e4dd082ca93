import re
import zlib
from collections import Counter

import pytest
from brute import SF
from cohortlake.llm import sharding as S
from cohortlake.llm.queries import QUERIES
from pyspark.sql import functions as F


def brute_force(rows, n_shards):
    """(key, shard, slot) from the rule itself; rows are (stratum, order key)."""
    strata = {}
    for r in sorted(rows, key=lambda r: r[1:]):
        strata.setdefault(r[0], []).append(r)
    line = sorted(((i + 0.5) / len(own), "s" + s if s is not None else "null", r[1:], r) for s, own in strata.items() for i, r in enumerate(own))
    total, out = len(line), []
    for position, (*_, r) in enumerate(line):
        shard = next(s for s in range(n_shards) if s * total // n_shards <= position < (s + 1) * total // n_shards)
        out.append((r, shard, position - shard * total // n_shards))
    return out


@pytest.mark.parametrize("bucket, run", [(5_000, 1024), (7, 3)])
def test_matches_brute_force(spark, monkeypatch, bucket, run):
    monkeypatch.setattr(S, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(S, "RUN_KEYS", run)
    rows = [("hot", i) for i in range(90)] + [("b", i) for i in range(31)] + [(None, i) for i in range(9)] + [("null", 0), ("c", 1)]
    df = spark.createDataFrame(rows, "source string, doc_id long")
    hashes = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.xxhash64(F.lit(3), "doc_id").alias("h")).collect()}
    got = S.stratified_shards(df, "source", ["doc_id"], 5, 3).collect()
    want = brute_force([(s, hashes[d], d) for s, d in rows], 5)
    key = lambda x: str(x)
    assert sorted((((r["source"], hashes[r["doc_id"]], r["doc_id"]), r["shard"], r["slot"]) for r in got), key=key) == sorted(want, key=key)


@pytest.fixture(scope="module")
def sharded(spark):
    return QUERIES["op6_sharding"](spark, SF.replace("0.001", "0.01")).collect()


def test_shards_are_equal_and_match_the_mixture(sharded):
    shards = Counter(r["shard"] for r in sharded)
    assert set(shards) == set(range(24)) and max(shards.values()) - min(shards.values()) <= 1
    for s in shards:
        assert sorted(r["slot"] for r in sharded if r["shard"] == s) == list(range(shards[s]))
    for source, n in Counter(r["source"] for r in sharded).items():
        own = Counter(r["shard"] for r in sharded if r["source"] == source)
        assert all(abs(own[s] - n / 24) <= 2 for s in shards)


def test_digests(spark, sharded):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").collect()}
    assert {r["doc_id"] for r in sharded} == set(texts)
    for r in sharded:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


def test_hard_rows(hard_docs):
    df = hard_docs.drop("shard").withColumn("source", F.when(F.col("doc_id") > 5, "a"))
    out = S.stratified_shards(df, "source", ["doc_id", "text"], 4, 1).collect()
    sizes = Counter(r["shard"] for r in out)
    assert len(out) == 13 and sorted(sizes.values()) == [3, 3, 3, 4]
    assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    assert S.stratified_shards(df.where("false"), "source", ["doc_id"], 4, 1).count() == 0


def test_clashing_columns_are_kept(spark):
    taken = ["Shard", "slot", "_h", "_stratum", "_bucket", "_rank", "_fraction", "_slot", "_position", "_before", "_of", "_s", "_b", "_p", "n", "run", "before"]
    df = spark.range(40).withColumns({c: F.concat(F.lit(c), F.col("id").cast("string")) for c in taken}).withColumn("source", F.lit("a"))
    out = S.stratified_shards(df, "source", ["id"], 4, 1)
    assert out.columns == [*df.columns, "_shard", "__slot"]
    rows = out.collect()
    assert len(rows) == 40 and all(r[c] == f"{c}{r['id']}" for r in rows for c in taken)
    plain = {r["id"]: (r["shard"], r["slot"]) for r in S.stratified_shards(spark.range(40).withColumn("source", F.lit("a")), "source", ["id"], 4, 1).collect()}
    assert plain == {r["id"]: (r["_shard"], r["__slot"]) for r in rows}


def test_native_plan(spark, capsys):
    QUERIES["op6_sharding"](spark, SF).explain("formatted")
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", capsys.readouterr().out)
