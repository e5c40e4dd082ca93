"""Hard negatives for contrastive training, by a BOND vertical scan.

For each anchor the best rows of its own label are its positives; for each
positive, the best rows of other labels whose score lies within two shares of the
positive's are its hard negatives. Scores are exact integer inner products.

Rows lie in blocks, a block as columns: one array for each dimension, with its
least and largest value. An anchor reads the dimensions in descending order of its
own magnitude, a few at a time. After each step the least and most that the
dimensions still unread can add bound every candidate's score; a candidate leaves
the bitmap when its interval misses all windows, or when k others surely lie in a
window and surely score more. What is left after the last dimension has exact
scores (BOND, de Vries et al., 2002).

Scale: all anchors meet all blocks, that is the task; the rest is kept linear.
Blocks hold rows in label order, so positives read only the blocks of their label.
Anchors travel in groups. A task holds one block and streams the groups past it;
groups go in runs, and a block is repeated for each run, so no task gets all
anchors. Each block sends the k best of a window at most, and Spark merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlake.llm.common import arrow_rows, freeze

#: Fixed by the contract.
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: Numbers in a block at most, rows in a block at most, anchors in a group, groups in a run.
BLOCK_CELLS, BLOCK_ROWS, GROUP, RUN = 1 << 22, 1 << 16, 256, 64
#: Blocks for each core that there should be at least, and rows that a block then still has.
BLOCKS_PER_CORE, LEAST_ROWS = 3, 1024
#: Dimensions read before the bounds are looked at again; rows of blocks and groups in an Arrow batch.
STEP, PAIR_ROWS = 8, 2


def quantised(embedding: str, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, as longs."""
    return F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * scale))


def usable(embedding: str, scale: int = SCALE) -> Column:
    """Whether a vector takes part: not null or empty, all components finite and with products that a long holds."""
    x = F.col(embedding)
    largest = F.least(F.sqrt(F.lit(2.0**62) / F.size(x)), F.lit(2.0**31 - 1))
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double") * scale) <= largest - 1), F.lit(False)))
    return F.coalesce(F.when(F.size(x) > 0, fine), F.lit(False))


# Blocks (no scores) and groups of anchors (no starts, ids, nulls) have one schema, so that they can stream together.
_PARTS = "labels array<string>, starts array<int>, rows binary, ids binary, nulls binary, cells binary, kind string, scores array<array<long>>"
_FIELDS = [
    ("number", pa.int64()), ("dim", pa.int32()), ("labels", pa.list_(pa.string())), ("starts", pa.list_(pa.int32())), ("rows", pa.binary()),
    ("ids", pa.binary()), ("nulls", pa.binary()), ("cells", pa.binary()), ("kind", pa.string()), ("scores", pa.list_(pa.list_(pa.int64()))),
]


def _smallest(x: np.ndarray) -> str:
    most = int(np.abs(x).max()) if x.size else 0
    return "<i1" if most < 1 << 7 else "<i2" if most < 1 << 15 else "<i4"


def _packed(size: int, cells: int, anchors: bool):
    """Runs of consecutive rows of one dimension as blocks, or as groups of anchors."""
    from pyspark import TaskContext

    def whole(number: int, dim: int, held: list[pa.RecordBatch]) -> dict:
        t = pa.Table.from_batches(held).combine_chunks()
        x = t["vector"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        labels, kind = t["label"].to_pylist(), _smallest(x)
        out = {"number": number, "dim": dim, "rows": t["row"].to_numpy().astype("<i8").tobytes(), "kind": kind}
        if anchors:
            return {**out, "labels": labels, "cells": x.astype(kind).tobytes(), "scores": t["scores"].to_pylist() if "scores" in t.column_names else None}
        starts = [i for i, own in enumerate(labels) if i == 0 or own != labels[i - 1]]
        ids = t["id"].combine_chunks()
        return {
            **out, "labels": [labels[i] for i in starts], "starts": starts, "ids": ids.fill_null(0).to_numpy().astype("<i8").tobytes(),
            "nulls": ids.is_null().to_numpy(zero_copy_only=False).tobytes(), "cells": np.ascontiguousarray(x.T).astype(kind).tobytes(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n, dim = TaskContext.get().partitionId() << 32, [], 0, 0
        schema = pa.schema(_FIELDS)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            at = 0
            while at < len(dims):
                if n and (dims[at] != dim or n >= min(size, max(1, cells // dim))):
                    yield pa.RecordBatch.from_pylist([whole(number, dim, held)], schema)
                    number, held, n = number + 1, [], 0
                dim = int(dims[at])
                same = int(np.argmax(np.append(dims[at:], -1) != dim))  # rows ahead of this dimension
                take = min(same, min(size, max(1, cells // dim)) - n)
                held.append(batch.slice(at, take))
                at, n = at + take, n + take
        if n:
            yield pa.RecordBatch.from_pylist([whole(number, dim, held)], schema)

    return run


def _pack(rows: DataFrame, order: list[str], size: int, anchors: bool) -> DataFrame:
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return freeze(dealt.mapInArrow(_packed(size, BLOCK_CELLS, anchors), f"number long, dim int, {_PARTS}"))


class Block:
    """Rows as columns: a row of ``x`` is a dimension."""

    def __init__(self, row: dict):
        self.rows, self.ids = np.frombuffer(row["rows"], "<i8"), np.frombuffer(row["ids"], "<i8")
        self.null = np.frombuffer(row["nulls"], bool)
        self.x = np.frombuffer(row["cells"], row["kind"]).reshape(row["dim"], -1)
        ends = [*row["starts"][1:], len(self.rows)]
        self.runs = {label: slice(a, b) for label, a, b in zip(row["labels"], row["starts"], ends, strict=True)}
        self.low, self.high = self.x.min(1).astype(np.int64), self.x.max(1).astype(np.int64)
        self.most = int(max(-int(self.low.min()), int(self.high.max())))
        self._as: dict = {}

    def columns(self, kind: type) -> np.ndarray:
        if kind not in self._as:
            self._as = {kind: self.x.astype(kind)}
        return self._as[kind]

    def best(self, scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """Which of ``at`` are the k first: by score, then id (null last), then row."""
        return np.lexsort((self.rows[at], self.ids[at], self.null[at], -scores))[:k]


def bond(block: Block, anchor: np.ndarray, own: slice, inside: bool, windows: list[tuple[float, float]], k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of all candidates that are among the k best of any window, and few others.

    Candidates are the rows in the slice ``own`` (``inside``) or outside of it, without the row number ``skip``.
    """
    size = len(anchor) * block.most * int(np.abs(anchor).max())
    kind = np.float32 if size < 1 << 24 else np.float64 if size < 1 << 53 else np.int64  # exact for such sums
    a = anchor.astype(kind)
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = np.sort(np.stack((anchor * block.low, anchor * block.high)), 0)[:, order]
    least, most = (np.append(np.cumsum(e[::-1])[::-1], 0) for e in ends)  # of all dimensions from a place in the order on
    if not any(most[0] >= w0 and least[0] <= w1 for w0, w1 in windows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, at = block.columns(kind), np.arange(len(block.rows))
    live = np.full(len(at), not inside)
    live[own] = inside
    live &= block.rows != skip
    if inside:
        x, at, live = x[:, own], at[own], live[own]
    sums = np.zeros(len(at), kind)
    for read in range(0, len(order), STEP):
        dims = order[read : read + STEP]
        sums += a[dims] @ x[dims]
        done = min(read + STEP, len(order))
        low, high = sums + kind(least[done]), sums + kind(most[done])
        may = np.zeros(len(at), bool)
        for w0, w1 in windows:
            reach = live & (high >= w0) & (low <= w1)
            sure = low[reach & (low >= w0) & (high <= w1)]
            if len(sure) >= k:
                reach &= high >= np.partition(sure, -k)[-k]
            may |= reach
        left = int(may.sum())
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if left < 0.7 * len(at):  # read on for the candidates only
            x, at, sums, live = x[:, may], at[may], sums[may], np.ones(left, bool)
        else:
            live = may
    return at[live], sums[live].astype(np.int64)


def window_of(positive: int, low: int, high: int) -> tuple[int, int]:
    """The scores s with low * positive <= 100 * s <= high * positive; empty where the first is larger."""
    return -(-low * positive // 100), high * positive // 100


def _scanned(k: int, low: int, high: int):
    """The k best of every block for every anchor (and positive): rows (anchor, positive, row, id, score)."""
    nothing = slice(0, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["ids"] is not None:
                    block = Block(row)
                    continue
                anchors, vectors = np.frombuffer(row["rows"], "<i8"), np.frombuffer(row["cells"], row["kind"]).reshape(-1, row["dim"])
                found: list[tuple] = []
                for g, (number, label, vector) in enumerate(zip(anchors, row["labels"], vectors, strict=True)):
                    vector, own = vector.astype(np.int64), block.runs.get(label, nothing)
                    first = row["scores"] is None  # positives, of the own label
                    windows = [(-np.inf, np.inf)] if first else [window_of(s, low, high) for s in row["scores"][g]]
                    if first and own is nothing:
                        continue
                    at, scores = bond(block, vector, own, first, windows, k, number if first else -1)
                    for j, (w0, w1) in enumerate(windows):
                        use = np.flatnonzero((scores >= w0) & (scores <= w1))
                        use = use[block.best(scores[use], at[use], k)]
                        if len(use):
                            found.append((np.full(len(use), number), np.full(len(use), j, np.int32), at[use], scores[use]))
                if found:
                    number, j, at, scores = (np.concatenate(x) for x in zip(*found, strict=True))
                    columns = [pa.array(number), pa.array(j), pa.array(block.rows[at]), pa.array(block.ids[at], mask=block.null[at]), pa.array(scores)]
                    yield pa.RecordBatch.from_arrays(columns, names=["anchor", "positive", "row", "id", "score"])

    return run


def _met(pairs: DataFrame, blocks: DataFrame, groups: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """The k best of every window over all blocks, for (group, block) pairs: (anchor, positive, row, id, score, rank)."""
    runs = max(1, -(-groups.count() // RUN))
    pairs = freeze(pairs.withColumn("run", F.pmod(F.xxhash64("group"), F.lit(runs))))
    parts = [x.split()[0] for x in _PARTS.split(", ")]
    held = pairs.select("block", "run").distinct().join(blocks.withColumnRenamed("number", "block"), "block").select("block", "run", F.lit(0).alias("order"), "dim", *parts)
    past = pairs.join(groups.withColumnRenamed("number", "group"), "group").select("block", "run", F.lit(1).alias("order"), "dim", *parts)
    met = held.unionByName(past).repartition("block", "run").sortWithinPartitions("block", "run", "order")
    with arrow_rows(blocks.sparkSession, PAIR_ROWS):
        found = freeze(met.mapInArrow(_scanned(k, low, high), "anchor long, positive int, row long, id long, score long"))
    rank = F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
    vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows that ``anchors`` picks.

    An anchor's positives are the ``positives`` other rows of its label with the
    largest inner product of floor(scale * x); the negatives of each are the
    ``negatives`` first rows of other labels with low * positive_score <= 100 *
    score <= high * positive_score. Ties go to the smaller id, a null id is last.
    Rows that repeat an id are rows of their own, also as anchors. No part take
    rows with a null label, with a null or empty vector or a null or non-finite
    component, and those whose products with their like a long could not hold
    (a component beyond about 2 ** 31 / scale / sqrt(dimension)). Vectors of different length do not
    meet. An anchor without positives, and a positive without negatives, give no
    rows; an empty table gives an empty result; other columns are not looked at.
    """
    valid = rows.where(F.col(label).isNotNull() & usable(embedding, scale))
    vector = quantised(embedding, scale).cast("array<int>")
    ready = valid.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), vector.alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    ready = freeze(ready.withColumn("dim", F.size("vector")).withColumn("row", F.monotonically_increasing_id()))
    cores = ready.sparkSession.sparkContext.defaultParallelism
    size = min(BLOCK_ROWS, max(LEAST_ROWS, -(-ready.count() // (BLOCKS_PER_CORE * cores))))
    order = ["dim", "label", "row"]
    blocks = _pack(ready.select("row", "id", "label", "dim", "vector"), order, size, anchors=False)
    chosen = ready.where("anchor").select("row", "id", "label", "dim", "vector")

    groups = _pack(chosen.drop("id"), order, GROUP, anchors=True)
    labels = lambda df, name: df.select(F.col("number").alias(name), "dim", F.explode(F.array_distinct("labels")).alias("label"))
    pairs = labels(groups, "group").join(labels(blocks, "block"), ["dim", "label"]).select("group", "block").distinct()
    best = freeze(_met(pairs, blocks, groups, positives, low, high).select("anchor", "row", F.col("id").alias("positive_id"), "score", "rank"))

    scores = best.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda s: s["score"]).alias("scores"))
    groups = _pack(chosen.drop("id").join(scores, F.col("row") == F.col("anchor")).drop("anchor"), order, GROUP, anchors=True)
    pairs = groups.select(F.col("number").alias("group"), "dim").join(blocks.select(F.col("number").alias("block"), "dim"), "dim").select("group", "block")
    found = _met(pairs, blocks, groups, negatives, low, high).select("anchor", F.col("positive") + 1, "rank", "id", "score")
    found = found.toDF("anchor", "place", "rank", "negative_id", "negative_score")
    own = best.join(chosen.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    own = own.select("anchor", F.col("rank").alias("place"), "anchor_id", "positive_id", F.col("score").alias("positive_score"))
    return own.join(found, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
