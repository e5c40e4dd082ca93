from hashlib import sha256

import numpy as np
import pytest
from cohortlake.llm import merkle as M
from pyspark.sql import functions as F


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(*fields):
    return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels_of(digests, fan=8):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + fan])) for i in range(0, len(out[-1]), fan)])
    return out


def siblings(levels, at, fan=8):
    out = []
    for own in levels[:-1]:
        run = at // fan * fan
        out.append((own[run:at], own[at + 1 : run + fan]))
        at //= fan
    return out


def brute_force(rows):
    """(id, leaf, subroot, root, proof, fold) of rows (id, group, leaf, claim)."""
    groups = sorted({g for _, g, *_ in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: sorted((r for r in rows if r[1] == g), key=lambda r: (r[0] is not None, r[0] or 0, r[2])) for g in groups}
    built = {g: levels_of([r[2] for r in own]) for g, own in trees.items()}
    top = levels_of([built[g][-1][0] for g in groups])
    out = []
    for at, g in enumerate(groups):
        for i, (id_, _, own, claim) in enumerate(trees[g]):
            steps = siblings(built[g], i) + siblings(top, at)
            fold = claim
            for before, after in steps:
                fold = h("".join([*before, fold, *after]))
            out.append((id_, own, built[g][-1][0], top[-1][0], h("".join(x for s in steps for x in s[0] + s[1])), fold))
    return sorted(out, key=repr)


def rows_of(spark, sizes):
    rows = [(i, g, h(f"{g}{i}"), h(f"{g}{i}") if i % 3 else h(f"x{i}")) for g, n in sizes.items() for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, g string, leaf string, claim string").repartition(5)


COLUMNS = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]


@pytest.mark.parametrize("levels", [1, 4])
@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8, "b": 9}, {None: 65, "": 64, "é": 1, "z": 513, **{f"g{i}": 2 for i in range(9)}}])
def test_matches_brute_force(spark, monkeypatch, sizes, levels):
    monkeypatch.setattr(M, "CHUNK_LEVELS", levels)
    monkeypatch.setattr(M, "CHUNK", 8**levels)
    rows, df = rows_of(spark, sizes)
    tree = M.build(df, "g", "id", "leaf")
    out, names = M.prove(tree, claim="claim")
    got = sorted((tuple(r) for r in out.select(*COLUMNS).collect()), key=repr)
    assert got == brute_force(rows) and tree.root == got[0][3]


def test_proofs_of_some_rows(spark):
    """Partitions that want a few leaves fetch what these cannot derive, and no more."""
    rows, df = rows_of(spark, {"a": 700, "b": 3})
    tree = M.build(df, "g", "id", "leaf")
    out, names = M.prove(tree, tree.leaves.where("id IN (0, 1, 9, 699) AND g = 'a'"), with_siblings=True)
    want = {r[0]: r for r in brute_force([(i, g, d, d) for i, g, d, _ in rows]) if r[1] in {h(f"a{i}") for i in (0, 1, 9, 699)}}
    got = out.collect()
    assert len(got) == 4
    for r in got:
        assert r["proof_sha256"] == want[r["id"]][4] == h(bytes(r["siblings"]).hex()) and r["folded_root"] == tree.root


def test_least_union_of_coordinates():
    for wanted in ([0], [0, 1, 2, 3, 4, 5, 6, 7], [3, 100], list(range(0, 130, 7)), list(range(130))):
        n, own, at = 130, set(wanted), M.missing(np.array(wanted), 130)
        for level in at:
            need = {p for o in own for p in range(o // 8 * 8, min(o // 8 * 8 + 8, n))}
            assert set(level.tolist()) == need - own
            own, n = {o // 8 for o in own}, -(-n // 8)
    assert all(len(x) == 0 for x in M.missing(np.arange(130), 130))


def test_hard_rows(hard_docs):
    fields = ["doc_id", "text"]
    df = hard_docs.withColumn("tree", F.lit(1)).withColumn("g", F.when(F.col("doc_id") > 4, "é")).withColumn("digest", M.leaf([F.col(c) for c in fields]))
    rows = [(r["doc_id"], r["g"], leaf(r["doc_id"], r["text"]), leaf(r["doc_id"], r["text"])) for r in df.collect()]
    assert sorted(r["digest"] for r in df.collect()) == sorted(r[2] for r in rows)
    out, names = M.prove(M.build(df, "g", "doc_id", "digest"))
    assert set(out.columns) == {*df.columns, *names.values()} and out.count() == 13
    got = sorted((tuple(r) for r in out.select("doc_id", "digest", *(names[k] for k in COLUMNS[2:])).collect()), key=repr)
    assert got == brute_force(rows)
    empty = M.build(df.where("false"), "g", "doc_id", "digest")
    assert empty.root is None and M.prove(empty)[0].count() == 0
