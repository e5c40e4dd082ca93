"""The queries that SQL can express, against DuckDB; and what all of them register."""

import re

import duckdb
import pytest
from brute import SF
from cohortlake.llm.queries import ORACLES, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    sf = SF.replace("0.001", "0.01")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = QUERIES[name](spark, sf)
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(rows, key=repr) == sorted(want.fetchall(), key=repr)


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name, columns", [
    ("op2", "vec_id n_links component_id kept"), ("op3", "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars"),
    ("op6", "doc_id size text_crc32 law shard slot grown_shard"), ("op7", "page_id host path rule verdict"),
    ("op8", "doc_id start length ids_crc32 doc_tokens sequence_id offset"), ("op9", "doc_id held_out score predicted"),
    ("op11", "doc_id leaf subroot root proof_sha256 folded_root verified"), ("op12", "doc_id size source_size target taken"),
    ("op13", "anchor_id positive_id rank negative_id positive_score negative_score"),
    ("op10", "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"),
])
def test_contract_columns(spark, name, columns):
    df = next(QUERIES[n] for n in QUERIES if n.startswith(name + "_"))(spark, SF)
    want = columns.split()
    assert df.columns[: len(want)] == want
    types = dict(df.dtypes)
    for c in want:
        kind = "boolean" if c in ("kept", "held_out", "base_failed", "verified") else "double" if c in ("score", "target") else None
        kind = kind or ("int" if c in ("shard", "grown_shard", "predicted", "rank") else "string" if c in "leaf subroot root proof_sha256 folded_root turns_sha256 loss_sha256 host path rule verdict law".split() else "bigint")
        assert types[c] == kind, c
