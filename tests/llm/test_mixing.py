import hashlib
import re
from fractions import Fraction

import pytest
from brute import SF, words
from cohortlake.llm import mixing as M
from cohortlake.llm.queries import QUERIES
from pyspark.sql import functions as F


def water(sizes, weights, budget, most):
    """Targets by dealing again and again, exactly."""
    left, full = Fraction(budget) * sum(sizes.values()), {}
    while True:
        open_ = {s: w for s, w in weights.items() if s not in full}
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return {**full, **share}
        for s in over:
            full[s] = Fraction(most * sizes[s])
            left -= full[s]


@pytest.mark.parametrize("budget, sizes", [
    (1.5, {"a": 10, "b": 0, "c": 700, None: 31}), (1.5, {"a": 100}), (2, {"a": 5, "b": 50, "c": 500}), (0.1, {"a": 5, "b": 5}), (5, {"a": 5, "b": 7}),
    (1.5, {f"s{i:03}": (i * 7919) % 1009 for i in range(100)}), (0, {"a": 3}), (1.5, {"a": 0, None: 0}),
])
def test_targets(spark, budget, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    weighted = M.weighted(df, (5, 2, 1))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    assert {r["source"]: r["weight"] for r in weighted.collect()} == weights
    got = {r["source"]: r["target"] for r in M.targets(weighted, budget, 2).collect()}
    want = water(sizes, weights, budget, 2) if budget <= 2 else {s: 2 * n for s, n in sizes.items()}
    assert got == {s: pytest.approx(float(t), rel=1e-12) for s, t in want.items()}


def test_copies(spark):
    sf = SF.replace("0.001", "0.1")
    rows = QUERIES["op12_source_mixing"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    spread = {}
    for r in rows[::17]:
        raw = f"{M.SEED}:{len(str(r['doc_id']))}:{r['doc_id']}{len(texts[r['doc_id']].encode())}:{texts[r['doc_id']]}"
        number, rate = int(hashlib.md5(raw.encode()).hexdigest()[:13], 16) / 2**52, r["target"] / r["source_size"]
        assert r["size"] == len(words(texts[r["doc_id"]])) and r["taken"] == r["size"] * (int(rate) + (number < rate - int(rate)))
    for r in rows:
        own = spread.setdefault(r["source"], [0, 0.0, r["target"]])
        rate = r["target"] / r["source_size"]
        assert r["taken"] <= 2 * r["size"]
        own[0] += r["taken"]
        own[1] += r["size"] ** 2 * (rate % 1) * (1 - rate % 1)
    # the draws are independent, so a source's words are within a few deviations of its target
    assert all(abs(taken - target) <= 4 * var**0.5 + 1e-6 for taken, var, target in spread.values())
    total = sum(r["size"] for r in rows)
    assert abs(sum(t for *_, t in spread.values()) - 1.5 * total) < 1e-6 * total


def test_reruns_agree_on_other_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = [sorted((r["doc_id"], r["copies"]) for r in M.mixture(M.measured(d)[0])[0].collect()) for d in (docs, docs.repartition(7), docs.coalesce(1))]
    assert taken[0] == taken[1] == taken[2]


def test_hard_rows(hard_docs):
    docs = hard_docs.withColumn("size", F.lit("x")).withColumn("target", F.lit(1)).withColumn("source", F.when(F.col("doc_id") > 5, "a"))
    measured, size, number = M.measured(docs)
    mixed, names = M.mixture(measured, "source", size, number)
    rows = mixed.collect()
    assert len(rows) == 13 and set(mixed.columns) == {*docs.columns, size, number, *names.values()} and {r["target"] for r in rows} == {1}
    assert all(r[size] == len(words(r["text"])) for r in rows)
    out, copy = M.emitted(mixed, names["copies"])
    assert out.count() == sum(r[names["copies"]] for r in rows) and out.agg(F.min(copy)).first()[0] == 1
    assert M.mixture(measured.where("false"), "source", size, number)[0].count() == 0


def test_native_plan(spark, capsys):
    QUERIES["op12_source_mixing"](spark, SF).explain("formatted")
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", capsys.readouterr().out)
