import re
import zlib
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
from brute import SF
from cohortlake.llm import quality as Q
from cohortlake.llm import stages
from cohortlake.llm import toxicity as X
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E


def test_registered():
    names = set(E.queries())
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} <= {re.match(r"(op\d+_|)", n)[0].rstrip("_") or n for n in names}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "minhash", "packing"]


def test_against_brute_force(spark):
    """Stage by stage on what the stage before kept; the two fitted models are taken from their operators."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    stats, stat = Q.with_stats(docs.select("doc_id", "text"))
    good = {r["doc_id"]: r["q"] for r in stats.select("doc_id", Q.posterior(Q.learn(stats, stat), stat).alias("q")).collect()}
    left = set()
    for d, t in texts.items():
        n, *_, repeat = brute.stats(t)
        if n >= 20 and 100 * repeat <= 30 * n and good[d] >= 0.5:
            left.add(d)
    kept = stages.quality_stage(spark, docs, SF)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == left

    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~X.held_out("doc_id"))
    now = docs.where(F.col("doc_id").isin(sorted(left)))
    index = X.learn(now.select("doc_id", "text"), labels)
    left = {r["doc_id"] for r in X.score(now.select("doc_id", "text"), index)[0].collect() if r["score"] < 0.7}
    kept = stages.toxicity_stage(spark, now, SF)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == left

    now = docs.where(F.col("doc_id").isin(sorted(left)))
    left = set(brute.classes([(d, texts[d]) for d in sorted(left)]).values())
    kept = stages.minhash_stage(spark, now, SF)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == left

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == left
    for d in left:
        ids, at = np.array([*tokenizer.encode(texts[d] or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_hard_rows_pass_every_stage(spark, hard_docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, hard_docs, SF)
        assert out.columns == hard_docs.columns
        assert not Counter(map(tuple, out.collect())) - Counter(map(tuple, hard_docs.collect()))
        assert stage(spark, hard_docs.where("false"), SF).count() == 0
    assert stages.packing_stage(spark, hard_docs.where("false"), SF).count() == 0
