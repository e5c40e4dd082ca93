"""How the weights of ``toxicity`` were chosen: by cross-validation over learnt rows alone.

    python -m cohortlake.llm.toxicity_choice /root/testdata/sf0.1

Takes a sample as ``learn`` does, from labels that are not held out, deals it into
five folds by hash, and lets the neighbours in four of them vote on the fifth,
with the terms' weights made from the four alone. Prints the average precision of
the votes for each setting, and the one that is taken. Labels of held-out rows are never read.
"""

from __future__ import annotations

import itertools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortlake.llm import toxicity as X
from cohortlake.llm.common import table
from cohortlake.llm.text import slices
from cohortlake.session import get_spark

FOLDS = 5
OTHERS, CHI2S, DFS, COMMONS = (0.01, 0.03), (10.0, 30.0, 100.0), (5,), (0, 100)
#: Settings this close to the best count as equal; of them the largest OTHER is taken, so that all words say something.
EQUAL = 0.001


def average_precision(score: np.ndarray, label: np.ndarray) -> float:
    """Mean precision at the positives; ties count as if spread evenly."""
    values, at = np.unique(-score, return_inverse=True)
    hits, sizes = np.bincount(at, label, len(values)), np.bincount(at, minlength=len(values))
    return float((hits * np.cumsum(hits) / np.cumsum(sizes)).sum() / max(label.sum(), 1))


def main(sf_dir: str) -> None:
    spark = get_spark("toxicity choice", "local[4]", 8)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~X.held_out("doc_id")).where("toxic IS NOT NULL").join(docs.select("doc_id"), "doc_id", "left_semi")
    sample, _ = X._sample(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    rows = docs.join(sample, "doc_id").dropDuplicates(["doc_id"]).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS))).orderBy("toxic", "doc_id").toArrow().combine_chunks()
    toxic, fold, ids = (rows[c].to_numpy() for c in ("toxic", "fold", "doc_id"))
    parts = [(at + d, h, c) for at, t in slices(rows["text"].combine_chunks().cast(pa.string())) for d, h, c in [X.terms(t)]]
    owner, hashes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    vocabulary = np.unique(hashes)
    term = np.searchsorted(vocabulary, hashes).astype(np.int32)
    n, df = X._document_counts(docs, vocabulary)
    found = []
    for X.OTHER, X.MIN_CHI2, X.MIN_DF, X.COMMON in itertools.product(OTHERS, CHI2S, DFS, COMMONS):
        votes = np.zeros(len(ids))
        for f in range(FOLDS):
            inside = fold != f
            number = np.cumsum(inside) - 1
            own = inside[owner]
            of, y = number[owner[own]], toxic[inside].astype(float)
            factor = X._factor(term[own], of, y, len(vocabulary))
            bounds = np.searchsorted(of, np.arange(inside.sum() + 1))
            index = X.build_index(vocabulary, df, n, ids[inside], y, bounds, term[own], counts[own], factor)
            there = np.flatnonzero(~inside)
            query = index.vectors(np.searchsorted(there, owner[~own]), hashes[~own], counts[~own], len(there))
            votes[there] = [index.vote(*x) for x in X.Lists(index).nearest(*query, X.NEIGHBOURS)]
        found.append((average_precision(votes, toxic), X.OTHER, X.MIN_CHI2, X.MIN_DF, X.COMMON))
        print("%.4f OTHER=%g MIN_CHI2=%g MIN_DF=%d COMMON=%d" % found[-1], flush=True)
    best = max(found)[0]
    print("chosen: %.4f OTHER=%g MIN_CHI2=%g MIN_DF=%d COMMON=%d" % max((x for x in found if x[0] >= best - EQUAL), key=lambda x: (x[1], x[0])))


if __name__ == "__main__":
    main(sys.argv[1])
