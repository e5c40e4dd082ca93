import math

import brute
import numpy as np
import pytest
from brute import SF
from cohortlake.llm import embedding as E


def want_of(rows, threshold=0.98):
    ok = [i for i, (v, l, x) in enumerate(rows) if v is not None and l is not None and x and all(c is not None and math.isfinite(c) for c in x) and any(x)]
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i != j and rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]) and brute.cosine(rows[i][2], rows[j][2]) >= threshold:
                links[i].add(j)
    out = []
    for i, (v, _, _) in enumerate(rows):
        reached, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - reached
            reached |= new
            todo += new
        out.append((v, len(links[i]), min((rows[j][0] for j in reached), default=None) if v is not None else None))
    return sorted(out, key=str)


def got_of(df):
    rows = df.collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in rows), key=str)


@pytest.mark.parametrize("block", [4, 512])
def test_links_match_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows, number = [], 0
    for label in (0, 1, None):
        for _ in range(6):
            centre = rng.normal(size=16)
            for _ in range(7):
                x = centre * rng.uniform(0.1, 10) + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.3])
                rows.append((number, label, [float(c) for c in x]))
                number += 1
    rows += [(900 + i, 1, rows[50][2]) for i in range(5)]  # equal vectors
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert got_of(E.linked_vectors(df, block_rows=block)) == want_of(rows)


def test_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "label", "embedding").collect()]
    assert got_of(E.linked_vectors(df)) == want_of(rows)


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    x = [1.0, 2.0, 3.0]
    rows = [
        (1, 0, x), (2, 0, [2.0, 4.0, 6.0]), (3, None, x), (4, 0, None), (5, 0, [0.0, 0.0, 0.0]), (6, 0, [nan, 1.0, 1.0]), (7, 0, [inf, 1.0, 1.0]),
        (8, 0, [1.0, None, 3.0]), (9, 0, []), (10, 0, [1.0, 2.0]), (11, 0, [2.0, 4.0]), (None, 0, x), (12, 0, [1e-300, 2e-300, 3e-300]), (13, 0, [1e300, 2e300, 3e300]), (14, 1, x),
    ]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 AS node", "2 AS size", "3 AS c0", "4 AS raw")
    got = {v: (n, c) for v, n, c in got_of(E.linked_vectors(df))}
    linked = {1, 2, 12, 13}
    for v in got:
        assert got[v] == ((3, 1) if v in linked else (1, 10) if v in (10, 11) else (0, v))
    assert len(got) == len(rows)


def test_empty_table(spark):
    assert E.linked_vectors(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_join_skips_only_what_is_apart():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = x[np.argsort(x[:, 0])]
    block = (np.arange(300), x, x[:, :3])
    eps = math.sqrt(2 - 2 * 0.9)
    r, c = E.ego_join(block, block, eps, 0.9, leaf=8)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if x[i] @ x[j] >= 0.9}
    assert set(zip(r.tolist(), c.tolist())) == want and len(r) == len(want)
    other = (np.arange(100), x[100:200], x[100:200, :3])
    r, c = E.ego_join(block, other, eps, 0.9, leaf=8)
    assert set(zip(r.tolist(), c.tolist())) == {(i, j) for i in range(300) for j in range(100) if x[i] @ x[100 + j] >= 0.9}


@pytest.mark.parametrize("span", [1, 4, 1000])
def test_block_pairs_match_brute_force(spark, monkeypatch, span):
    """Blocks of one to many cells, also in one coordinate only."""
    monkeypatch.setattr(E, "SPAN", span)
    rng, eps, rows = np.random.default_rng(5), 0.2, []
    for i in range(120):
        low = rng.uniform(-1, 1, 2)
        high = low + rng.choice([0.0, 0.05, 0.3, 1.5], 2)
        cells = list(range(math.floor(low[0] / eps), math.floor(high[0] / eps) + 1))
        rows.append((i, i % 2, 2, cells, low.tolist(), high.tolist()))
    df = spark.createDataFrame(rows, "block long, label long, dim int, cells array<long>, low array<double>, high array<double>")
    got = [tuple(r) for r in E._near_blocks(df, 2, eps).collect()]

    def gap(a, b):
        return sum(max(0, a[4][i] - b[5][i], b[4][i] - a[5][i]) ** 2 for i in range(2))

    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and gap(a, b) <= eps * eps}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_one_label_without_structure_in_many_runs(spark, monkeypatch):
    monkeypatch.setattr(E, "RUN_BLOCKS", 3)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2500, 4)).astype(np.float32)
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    want = (unit @ unit.T >= 0.98).sum(1) - 1
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in E.linked_vectors(df, block_rows=32).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist()
