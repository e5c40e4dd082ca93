import brute
import numpy as np
from cohortlake.llm import quality as Q
from brute import SF
from pyspark.sql import functions as F

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def check(rows, texts):
    got = {(r["doc_id"], i): r for i, r in enumerate(rows)}
    assert len(got) == len(texts)
    for r, (doc, text) in zip(rows, texts):
        assert r["doc_id"] == doc
        assert tuple(r[c] for c in COUNTS) == brute.stats(text)
        n, repeat = r["n_words"], r["n_repeat_words"]
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n)
        assert not (r["kept"] and r["base_failed"])


def test_counts_match_brute_force(documents):
    rows = Q.quality_table(documents.orderBy("doc_id").coalesce(1)).collect()
    texts = documents.orderBy("doc_id").select("doc_id", "text").collect()
    check(rows, [tuple(t) for t in texts])


def test_hard_rows(hard_docs):
    one = hard_docs.coalesce(1)
    check(Q.quality_table(one).collect(), [tuple(t) for t in one.select("doc_id", "text").collect()])
    judged, names = Q.quality(hard_docs)
    assert judged.columns[: len(hard_docs.columns)] == hard_docs.columns
    assert judged.count() == hard_docs.count()
    assert names["n_words"] == "_n_words" and names["n_lines"] == "_n_lines" and names["kept"] == "_kept"


def test_repeated_windows_and_lines(spark):
    phrase = "a b c d e f g h"
    texts = [f"{phrase} x {phrase}", "\n".join(["same line"] * 3 + ["other"]), "x " * 30, "a\r\na\r\na", "\n\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    check(Q.quality_table(df).collect(), list(enumerate(texts)))


def test_empty_table(no_docs):
    assert Q.quality_table(no_docs).count() == 0
    assert Q.quality(no_docs)[0].count() == 0


def test_verdicts_agree_with_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.quality_table(docs).where("NOT base_failed").join(labels.select("doc_id", F.col("quality").alias("good")), "doc_id")
    agree = rows.groupBy("good").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["good"]: r["kept"] for r in agree}
    assert kept[1] >= 0.99 and kept[0] <= 0.1


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    n = 20_000
    cause = rng.choice(len(Q.CAUSES) + 1, n, p=[0.8, *[0.2 / len(Q.CAUSES)] * len(Q.CAUSES)])
    votes = np.empty((n, len(Q.RULES)), int)
    for k, rule in enumerate(Q.RULES):
        own = cause == 1 + Q.CAUSES.index(rule.cause)
        votes[:, k] = np.where(own, rng.random(n) > 0.9, rng.random(n) > 0.02)
        votes[rng.random(n) < 0.1, k] = 2
    patterns, counts = np.unique(votes @ 3 ** np.arange(len(Q.RULES)), return_counts=True)
    model = Q.fit_label_model(patterns, counts.astype(float))
    assert abs(model.priors[0] - 0.8) < 0.05
    good = model.posterior(votes @ 3 ** np.arange(len(Q.RULES)))[:, 0] >= 0.5
    assert (good == (cause == 0)).mean() > 0.95


def test_posterior_expression_is_the_model(documents):
    stats, stat = Q.with_stats(documents)
    model = Q.learn(stats, stat)
    rows = stats.select(Q.vote_pattern(stat).alias("p"), Q.posterior(model, stat).alias("q")).collect()
    want = model.posterior(np.array([r["p"] for r in rows]))[:, 0]
    assert np.allclose([r["q"] for r in rows], want)
