from collections import Counter

import brute
import numpy as np
import pytest
from brute import SF
from cohortlake.llm import common as C
from cohortlake.llm import minhash as M
from cohortlake.llm.common import connected_components, table
from cohortlake.llm.text import Texts


def signature(weights, k):
    h = np.array([x for x, _ in weights], np.uint64)
    return M.dart_signatures(h, np.zeros(len(h), int), np.array([w for _, w in weights], float), 1, k)[0]


@pytest.mark.parametrize("seed", range(3))
def test_darts_estimate_weighted_jaccard(seed):
    rng = np.random.default_rng(seed)
    hashes = rng.integers(0, 2**63, 300, dtype=np.uint64)
    wa, wb = rng.integers(0, 6, 300), rng.integers(0, 6, 300)
    wb = np.where(rng.random(300) < 0.5, wa, wb)
    a = [(h, w) for h, w in zip(hashes, wa) if w]
    b = [(h, w) for h, w in zip(hashes, wb) if w]
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    k = 4000
    got = (signature(a, k) == signature(b, k)).mean()
    assert abs(got - want) < 4 * (want * (1 - want) / k) ** 0.5


def test_signature_depends_on_the_set_alone():
    rng = np.random.default_rng(0)
    a = [(int(h), 1.0 + i % 3) for i, h in enumerate(rng.integers(0, 2**63, 50))]
    alone = signature(a, 64)
    many = a + [(h + 1, 1.0) for h, _ in a]
    h = np.array([x for x, _ in many], np.uint64)
    both = M.dart_signatures(h, np.repeat([0, 1], 50), np.array([w for _, w in many]), 2, 64)
    assert (both[0] == alone).all() and (alone != 0).all()
    assert (M.dart_signatures(h[:0], np.zeros(0, int), np.zeros(0), 2, 8) == 0).all()


def test_shingles_are_bags_of_words():
    texts = ["a b c d e f", "a  b\tc\nd e f", "a b c d e", "x y", "x y x y x y x y x y", "", " "]
    h, owner = M.shingles(Texts.of(texts))
    got = [Counter(h[owner == i].tolist()) for i in range(len(texts))]
    want = [brute.bag(t) for t in texts]
    for i in range(len(texts)):
        assert sorted(got[i].values()) == sorted(want[i].values())
        for j in range(len(texts)):
            assert sum((got[i] & got[j]).values()) == sum((want[i] & want[j]).values())


def classes_of(df):
    return {r["doc_id"]: r["component_id"] for r in df.collect()}


@pytest.mark.parametrize("small, block, run", [(M.SMALL_BUCKET, M.BLOCK_ROWS, M.STAR_ROWS), (2, 3, 2)])
def test_classes_match_brute_force(spark, monkeypatch, small, block, run):
    for name, value in (("SMALL_BUCKET", small), ("BLOCK_ROWS", block), ("STAR_ROWS", run)):
        monkeypatch.setattr(M, name, value)
    docs = table(spark, SF.replace("0.001", "0.01"), "documents").select("doc_id", "text")
    rows = M.near_duplicates(docs).collect()
    want = brute.classes([tuple(r) for r in docs.collect()])
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    assert {r["component_id"]: r["n_members"] for r in rows} == Counter(want.values())


def test_a_group_of_near_copies_without_a_hub(spark, monkeypatch):
    """Chains and stars of edits, some pairs below the threshold: links decide, however they are found."""
    monkeypatch.setattr(M, "SMALL_BUCKET", 4)
    monkeypatch.setattr(M, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(i % 6):
            words[rng.integers(len(words))] = f"v{rng.integers(10**9)}"
        rows.append((i, " ".join(words)))
    for i in range(30):  # a chain: each is near the next only
        rows.append((100 + i, " ".join(f"c{j}" for j in range(4 * i, 4 * i + 100))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert classes_of(M.near_duplicates(df)) == brute.classes(rows)


def test_hard_rows(spark, hard_docs):
    rows = {r["doc_id"]: r for r in M.near_duplicates(hard_docs).where("doc_id IS NOT NULL").collect()}
    assert {d: r["component_id"] for d, r in rows.items()} == {1: 1, 2: 1, 3: 3, 8: 3, 4: 4, 5: 5, 6: 6, 7: 7, 9: 9, 10: 10}
    assert rows[1]["n_members"] == 3 and rows[2]["n_rows"] == 2 and not rows[2]["kept"]
    nulls = M.near_duplicates(hard_docs).where("doc_id IS NULL").collect()
    assert len(nulls) == 2 and all(r["component_id"] is None and r["kept"] for r in nulls)


def test_without_duplicates_keeps_columns_and_one_row_of_a_class(hard_docs):
    out = M.without_duplicates(hard_docs)
    assert out.columns == hard_docs.columns
    left = sorted((r["doc_id"] for r in out.collect()), key=str)
    assert left == sorted([1, 3, 4, 5, 6, 7, 9, 10, None, None], key=str)


def test_repeated_rows_of_a_kept_document(spark):
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (2, "other text")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in M.without_duplicates(df).collect()) == [1, 2]


def test_different_texts_under_one_id(spark):
    """Two sources that both number from 0: every text counts for itself, a null or empty one too."""
    words = lambda x: " ".join(f"{x}{i}" for i in range(60))
    near = words("a") + " more"
    rows = [(0, words("a")), (1, words("b")), (2, near), (0, words("c")), (1, None), (2, ""), (0, None), (0, None), (3, words("c"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(map(tuple, M.without_duplicates(df).collect()), key=str)
    assert left == sorted([(0, words("a")), (1, words("b")), (0, words("c")), (1, None), (2, ""), (0, None)], key=str)
    got = sorted(tuple(r)[:4] for r in M.near_duplicates(df).select("doc_id", "component_id", "n_members", "kept").collect())
    want = [(0, 0, 2, True)] * 3 + [(1, 1, 1, True)] * 2 + [(2, 0, 2, False), (2, 2, 1, True), (3, 0, 2, False)]
    assert got == sorted(want)


def test_empty_bag_is_like_none():
    one, many = np.zeros(0, np.uint64), np.array([1, 2], np.uint64)
    assert not M.similar(one, many, np.array([2, 0]), 0.8).any() and not M.similar(many, one, np.array([0]), 0.8).any()


def test_sketches_rule_out_pairs_that_are_far_apart(spark):
    """Pairs around the threshold all stay for the exact comparison, those far below it go."""
    rng = np.random.default_rng(3)
    docs, same = [], {}
    for i in range(60):
        words = [f"w{i}x{j}" for j in range(300)]
        docs.append((2 * i, " ".join(words)))
        cut = (30, 55, 200)[i % 3]  # similarity about 0.8 or more, 0.69, 0.2
        docs.append((2 * i + 1, " ".join(words[:-cut] + [f"v{rng.integers(10**9)}" for _ in range(cut)])))
        same[2 * i] = cut
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sig = M.freeze(M.signatures(df))
    ids = {r["doc_id"]: r["node"] for r in sig.select("doc_id", "node").collect()}
    pairs = spark.createDataFrame([(ids[i + 1], ids[i]) for i in same], "a long, b long")
    left = {r["b"] for r in M._likely_pairs(pairs, sig.select("node", "sketch"), M.THRESHOLD).collect()}
    assert all(ids[i] in left for i, cut in same.items() if cut == 30)
    assert not any(ids[i] in left for i, cut in same.items() if cut == 200)
    exact = {r["b"] for r in M._similar_pairs(pairs, sig, M.THRESHOLD).collect()}
    assert exact == {ids[i] for i, cut in same.items() if cut == 30}


def test_bags_that_no_pair_needs_are_not_shuffled(spark):
    """The scan of the bags has a filter of the wanted nodes before its exchange, at any size; settings come back."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    sig = M.freeze(spark.range(1000).selectExpr("id AS node", "CAST(id AS string) AS bag"))
    with M._bloom_joins(spark):
        out = M._with(sig, spark.range(0, 1000, 100).withColumnRenamed("id", "node"), "bag")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert out.count() == 10
    assert spark.conf.get(key) == before
    made_of = plan[plan.index("bloom_filter_agg") :].split("Relation")[0]
    assert "might_contain" in plan and "wanted" in made_of  # a filter of the wanted rows, not one of all bags


def test_stars_are_told(spark):
    stars = lambda rows: C._stars(spark.createDataFrame(rows, "a long, b long"))
    assert stars([]) and stars([(2, 1), (3, 1), (9, 7)])
    assert not stars([(2, 1), (3, 2)]) and not stars([(3, 1), (3, 2)])


def test_empty_table(no_docs):
    assert M.near_duplicates(no_docs).count() == 0
    assert M.without_duplicates(no_docs).count() == 0


def test_connected_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(300 + i, 301 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    for a, b in edges:
        parent.setdefault(a, a), parent.setdefault(b, b)
    for _ in range(400):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: c for n, c in parent.items() if n not in alone}
