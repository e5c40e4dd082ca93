import math
import random

import numpy as np
import pytest
from cohortlake.llm import hardneg as H
from pyspark.sql import functions as F

SCHEMA = "vec_id long, label int, embedding array<double>, score string"


def brute_force(rows, positives=5, negatives=10, low=30, high=90, scale=256):
    def fine(label, x):
        return label is not None and x and all(c is not None and math.isfinite(c) for c in x)

    rows = [(i, id_, label, [math.floor(scale * c) for c in x]) for i, (id_, label, x, _) in enumerate(rows) if fine(label, x)]
    out = []
    for i, id_, label, a in rows:
        if id_ is None or id_ % 10:
            continue
        scored = [(-sum(p * q for p, q in zip(a, x)), o is None, o or 0, o, own == label) for j, o, own, x in rows if j != i and len(x) == len(a)]
        for p, *_, pos, own in sorted((s for s in scored if s[4]), key=lambda s: s[:3])[:positives]:
            fit = sorted((s for s in scored if not s[4] and low * -p <= 100 * -s[0] <= high * -p), key=lambda s: s[:3])
            out += [(id_, pos, k, s[3], -p, -s[0]) for k, s in enumerate(fit[:negatives], 1)]
    return sorted(out, key=repr)


def both(spark, rows, **args):
    df = spark.createDataFrame(rows, SCHEMA)
    got = H.hard_negatives(df, F.col("vec_id") % 10 == 0, **args).collect()
    return sorted((tuple(r) for r in got), key=repr), brute_force(rows, **args)


def vectors(n, dim, labels, seed, spread=1.0):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(dim)] for _ in range(labels)]
    out = []
    for i in range(n):
        label = 0 if i % 3 == 0 else draw.randrange(labels)  # a hot label
        out.append((i, label, [c * 0.5 + spread * draw.gauss(0, 1) for c in centres[label]], "x"))
    return out


@pytest.mark.parametrize("n, dim, labels, block", [(400, 16, 4, 64), (300, 3, 60, 50), (250, 64, 2, 1 << 16), (200, 1, 3, 20)])
def test_matches_brute_force(spark, monkeypatch, n, dim, labels, block):
    monkeypatch.setattr(H, "BLOCK_ROWS", block)
    monkeypatch.setattr(H, "GROUP", 7)
    monkeypatch.setattr(H, "RUN", 2)
    got, want = both(spark, vectors(n, dim, labels, n))
    assert got == want and want


def test_other_parameters(spark):
    got, want = both(spark, vectors(200, 8, 3, 5), positives=2, negatives=3, low=-50, high=100, scale=16)
    assert got == want and want


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(60, 4, 2, 9)
    rows += [(70, 0, None, ""), (80, None, [1.0] * 4, ""), (90, 0, [nan, 1.0, 1.0, 1.0], ""), (100, 0, [inf, 1.0, 1.0, 1.0], None), (110, 0, [None, 1.0, 1.0, 1.0], "")]
    rows += [(120, 1, [], ""), (130, 1, [0.0] * 4, ""), (140, 1, [1.0, 2.0], ""), (150, 0, [1.0, 2.0], ""), (151, 0, [0.5, 2.0], ""), (152, 1, [0.5, 0.5], "")]
    rows += [(None, 0, [0.7] * 4, ""), (None, 1, [0.3] * 4, ""), (200, 0, [0.9] * 4, ""), (200, 0, [0.9] * 4, ""), (201, 1, [0.4] * 4, ""), (201, 1, [0.4] * 4, "")]
    rows += [(210 + i, i % 2, [0.25] * 4, "") for i in range(30)]  # ties
    rows += [(300, 0, [1000.0, -3000.0, 5.0, 0.1], ""), (301, 0, [4e4, 4e4, 4e4, 4e4], ""), (302, 1, [9e3, 9e3, 9e3, 9e3], "")]
    got, want = both(spark, rows)
    assert got == want and want
    assert both(spark, rows[:0])[0] == [] and both(spark, [(10, 1, [1.0], "")])[0] == []


def test_scan_keeps_the_best_and_drops_others():
    draw = np.random.default_rng(3)
    x = draw.normal(0, 40, (32, 500)).astype(np.int32) * np.linspace(4, 0.05, 32).astype(np.float32)[:, None]
    x = np.floor(x).astype(np.int32)
    row = {"rows": np.arange(500).tobytes(), "ids": np.arange(500).tobytes(), "nulls": np.zeros(500, bool).tobytes(), "cells": x.astype("<i4").tobytes(), "kind": "<i4", "dim": 32, "labels": ["a", "b"], "starts": [0, 100]}
    block, anchor = H.Block(row), x[:, 3].astype(np.int64)
    scores = anchor @ x.astype(np.int64)
    for windows in ([(-np.inf, np.inf)], [(1000, 5000), (-200, 900)]):
        at, got = H.bond(block, anchor, block.runs["a"], False, windows, 10)
        assert (got == scores[at]).all() and (at >= 100).all() and len(at) < 300
        for w0, w1 in windows:
            fit = [s for s in scores[100:] if w0 <= s <= w1]
            assert sorted(s for s in got if w0 <= s <= w1)[-10:] == sorted(fit)[-10:]


def test_long_products_stay_exact(spark):
    """Beyond 2 ** 53 sums are taken in integers."""
    big = 2.0**21
    rows = [(i, i % 2, [(big + i) / (1 + i % 2), (big - 7 * i) / (1 + i % 2), 3.0 * i, big / (1 + i % 2)], "") for i in range(40)]
    got, want = both(spark, rows)
    assert got == want and want and max(r[4] for r in want) > 2**53
