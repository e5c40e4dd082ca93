import math
import random
import re
import tracemalloc
import weakref
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import SF
from cohortlake.llm import toxicity as X
from cohortlake.llm.queries import QUERIES
from cohortlake.llm.text import Texts
from pyspark.sql import functions as F


def plain_terms(text):
    out = Counter()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        out["=" + w] += 1
        for n in X.BEGINNINGS:
            if len(w) >= n:
                out[w[:n]] += 1
    return out


def test_terms_match_brute_force():
    texts = ["Réeux the THE Thesis ÀÉÎ x", "", "one1two three-three", "ünïcode ünïcoded", "\n"]
    docs, hashes, counts = X.terms(Texts.of(texts))
    assert len(set(zip(docs.tolist(), hashes.tolist()))) == len(docs)
    for i, t in enumerate(texts):
        assert sorted(counts[docs == i].tolist()) == sorted(plain_terms(t).values())
    same = lambda a, b: np.array_equal(*(X.terms(Texts.of([t]))[1] for t in (a, b)))
    assert same("ÉTÉ Thé", "été thé") and not same("été", "eté")


def index_of(rng, n_examples, n_terms):
    vocabulary = np.sort(np.array([rng.getrandbits(63) for _ in range(n_terms)], np.uint64))
    rows = [{vocabulary[rng.randrange(n_terms)]: rng.randrange(1, 5) for _ in range(rng.randrange(12))} for _ in range(n_examples)]
    toxic = np.array([float(rng.random() < 0.3) for _ in rows])
    flat = [(i, h, c) for i, r in enumerate(rows) for h, c in sorted(r.items())]
    docs, hashes, counts = (np.array(x) for x in zip(*flat))
    df = np.array([sum(h in r for r in rows) for h in vocabulary], float)
    factor = np.where(np.arange(n_terms) % 3 == 0, 1.0, 0.3)
    bounds = np.searchsorted(docs, np.arange(n_examples + 1))
    index = X.build_index(vocabulary, df, n_examples, np.arange(n_examples) * 10, toxic, bounds, np.searchsorted(vocabulary, hashes).astype(np.int32), counts, factor)
    weight = {h: math.log((n_examples + 1) / (d + 1)) * f for h, d, f in zip(vocabulary, df, factor)}
    return index, rows, weight, vocabulary


def test_index_is_the_same_in_pieces(monkeypatch):
    whole = index_of(random.Random(5), 300, 60)[0]
    term, owner = whole.term, np.repeat(np.arange(300), np.diff(whole.bounds))
    factor = X._factor(term, owner, whole.toxic, 60)
    monkeypatch.setattr(X, "PIECE", 7)
    cut = index_of(random.Random(5), 300, 60)[0]
    for k in ("number", "idf", "light", "term", "weight"):
        assert np.array_equal(getattr(whole, k), getattr(cut, k))
    assert np.array_equal(factor, X._factor(term, owner, whole.toxic, 60))


def test_driver_holds_little_more_than_the_index():
    size, per, terms = 4096, 500, 1000
    rng = np.random.default_rng(1)
    term, counts = rng.integers(0, terms, size * per).astype(np.int32), rng.integers(1, 9, size * per).astype(np.int32)
    toxic, bounds, owner = np.arange(size) % 4.0 < 1, np.arange(size + 1) * per, np.repeat(np.arange(size, dtype=np.int32), per)
    tracemalloc.start()
    try:
        factor = X._factor(term, owner, toxic.astype(float), terms)
        X.build_index(np.arange(terms, dtype=np.uint64), np.ones(terms), size, np.arange(size), toxic, bounds, term, counts, factor)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 20 * size * per  # 8 bytes a term stay


def test_inverted_index_goes_with_its_broadcast():
    class Held:
        value = {k: v for k, v in index_of(random.Random(5), 30, 20)[0].__dict__.items()}

    index = X._index(Held)
    assert X._index(Held) is index and index.lists() is index.lists()
    gone = weakref.ref(index.lists())
    Held.value = None
    del index
    assert gone() is None


@pytest.mark.parametrize("dense, rare", [(16, 16), (5, 8), (1, 10_000), (10_000, 0)])
def test_block_max_search_is_exact(monkeypatch, dense, rare):
    monkeypatch.setattr(X, "DENSE", dense)
    monkeypatch.setattr(X, "RARE", rare)
    rng = random.Random(3)
    index, rows, weight, vocabulary = index_of(rng, 700, 90)
    lists = X.Lists(index)

    def unit(row):
        v = {h: (1 + math.log(c)) * weight[h] for h, c in row.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {h: x / size for h, x in v.items()} if size else {}

    units = [unit(r) for r in rows]
    queries = [{vocabulary[rng.randrange(90)]: rng.randrange(1, 4) for _ in range(rng.randrange(8))} for _ in range(150)]
    docs, hashes, counts = (np.array(x) for x in zip(*((i, h, q[h]) for i, q in enumerate(queries) for h in sorted(q))))
    for own, (hit, cosine) in enumerate(lists.nearest(*index.vectors(docs, hashes, counts, 150), X.NEIGHBOURS, np.arange(150) % 7 - 1)):
        u = unit(queries[own])
        every = sorted(((-sum(x * e.get(h, 0) for h, x in u.items()), i) for i, e in enumerate(units) if i != own % 7 - 1))
        want = [(i, -s) for s, i in every[: X.NEIGHBOURS] if s < 0]
        assert np.allclose(cosine, [s for _, s in want], atol=1e-6)  # weights are kept in single precision
        score = {i: -s for s, i in every}
        assert len(hit) == len(want) and np.allclose([score[i] for i in hit], cosine, atol=1e-6)
        want = [(i, score[i]) for i in hit]
        mass = [s * s for _, s in want]
        assert math.isclose(index.vote(hit, cosine), sum(m * index.toxic[i] for m, (i, _) in zip(mass, want)) / sum(mass) if want else 0.0, abs_tol=1e-5)


def test_isotonic():
    steps, rates = X.isotonic(np.array([0.0, 0.1, 0.2, 0.2, 0.9, 1.0]), np.array([0, 1, 0, 0, 1, 1.0]))
    assert (np.diff(rates) >= 0).all() and (np.diff(steps) > 0).all() and rates[0] < 0.5 < rates[-1]


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    rows = QUERIES["op9_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r["toxic"] == 1], [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    assert sum(r["predicted"] for r in toxic) >= 0.6 * len(toxic)
    ranks = [(a["score"] > b["score"]) + 0.5 * (a["score"] == b["score"]) for a in toxic for b in clean]
    assert sum(ranks) / len(ranks) >= 0.85


def test_held_out_is_the_checksum(spark):
    rows = spark.range(200).union(spark.createDataFrame([(None,)], "id long")).select("id", X.held_out("id").alias("h")).collect()
    assert all(r["h"] == (r["id"] is not None and zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)


def test_labels_of_held_out_rows_do_not_matter(spark):
    sf = SF
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    other = labels.withColumn("toxic", F.when(X.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    found = [sorted(map(tuple, X.score(docs, X.learn(docs, x.where(~X.held_out("doc_id"))))[0].select("doc_id", "score").collect())) for x in (labels, other)]
    assert found[0] == found[1] and all(0 <= s <= 1 for _, s in found[0])


def test_terms_are_counted_over_all_documents(spark, monkeypatch):
    monkeypatch.setattr(X, "OTHER", 1.0)
    docs = spark.createDataFrame([(i, f"common word{i} " + "often" * (i % 2)) for i in range(40)], "doc_id long, text string")
    index = X.learn(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    for text, df in (("common", 40), ("often", 20)):  # a word and its beginnings, as far as it has them
        _, h, _ = X.terms(Texts.of([text]))
        assert set(h) <= set(index.vocabulary)
        assert np.allclose(index.idf[index.number[np.searchsorted(index.vocabulary, h)]], math.log(41 / (df + 1)))


def test_rare_words_find_a_twin(spark):
    """Words of one example only are terms too: the twin of an example has it as its first evidence."""
    rng = random.Random(1)
    texts = ["the same common words " + " ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(5)) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), *((100 + i, t) for i, t in enumerate(texts))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 20 == 0)) for i in range(60)], "doc_id long, toxic int")
    for r in X.score(docs, X.learn(docs, labels))[0].collect():
        assert r["evidence"][0] == r["doc_id"] % 100 and math.isclose(r["similarity"][0], 1, rel_tol=1e-6)


def test_rare_label_is_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(X, "MAX_EXAMPLES", 40)
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('some text ', id) AS text")
    index = X.learn(docs, docs.selectExpr("doc_id", "int(doc_id IN (7, 400)) AS toxic"))
    assert len(index.examples) == 40 and {7, 400} <= set(index.examples.tolist()) and index.toxic.sum() == 2
    index = X.learn(docs, docs.selectExpr("doc_id", "int(doc_id < 30) AS toxic"))
    assert len(index.examples) == 40 and index.toxic.sum() == 10


def test_labels_of_absent_documents_take_no_places(spark, monkeypatch):
    monkeypatch.setattr(X, "MAX_EXAMPLES", 40)
    docs = spark.range(50).selectExpr("id AS doc_id", "concat('some text ', id) AS text")
    index = X.learn(docs, spark.range(5000).selectExpr("id AS doc_id", "int(id % 3 = 0) AS toxic"))
    assert len(index.examples) == 40 and index.examples.max() < 50


def test_hard_rows(spark, hard_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (9, 0), (None, 1), (7, None), (10, 1), (77, 1)], "doc_id long, toxic int")
    index = X.learn(hard_docs.select("doc_id", "text"), labels)
    assert sorted(index.examples.tolist()) == [1, 2, 9, 10]
    scored, names = X.score(hard_docs, index)
    assert names["score"] == "_score" and scored.columns[: len(hard_docs.columns)] == hard_docs.columns
    rows = scored.collect()
    assert len(rows) == 13 and all(0 <= r["_score"] <= 1 for r in rows)
    for other in (X.learn(no_docs.select("doc_id", "text"), labels), X.learn(hard_docs.select("doc_id", "text"), labels.where("false"))):
        assert {r["_score"] for r in X.score(hard_docs, other)[0].collect()} == {0.1}
    assert X.score(no_docs, index)[0].count() == 0
