"""Near-duplicate embeddings by the epsilon grid order.

Two vectors of the same label are linked when their cosine reaches the threshold.
Unit vectors with cosine >= t lie within epsilon = sqrt(2 - 2 t) of each other,
and so do their projections on any orthonormal directions. The vectors of a label
are sorted by the cells, epsilon wide, of their leading principal coordinates;
runs of that sequence are blocks. Two blocks can only share links if the boxes of
their coordinates come within epsilon of each other; the join of two blocks
splits both in half again and again, skips halves that are provably apart, and
compares what is left by cosine in double precision.

Scale: equal vectors count once, with a multiplicity. A block has at most
BLOCK_ROWS vectors whatever a label's share, so hot labels and cells are many
blocks; the block pairs of a label meet in an equi-join on (label, cells of the
first two coordinates), and the blocks that span many cells on those of the first.
A block is streamed with a run of its partners, one at a time, so the partners of
one block are spread over tasks. A pair of blocks gives at most a row per vector:
its number of links and a spanning edge, never the links themselves.
Components come from large-star/small-star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.llm.common import arrow_rows, connected_components, freeze
from cohortlake.llm.text import least_reached

THRESHOLD = 0.98
#: Leading principal directions of the grid, vectors of a block, and the join's smallest intervals.
DIRECTIONS, BLOCK_ROWS, LEAF = 6, 512, 64
#: Blocks in an Arrow batch, and about so many partners of a block in a run.
PAIR_ROWS, RUN_BLOCKS = 32, 64
#: Blocks that span more cells of the first or second coordinate meet others by the first alone.
SPAN = 4
_SLACK = 1e-9


def _linkable() -> Column:
    """Whether a row of (vec_id, label, embedding) can have links; never null."""
    inf = float("inf")
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (x < inf) & (x > -inf), F.lit(False)))
    nonzero = F.exists("embedding", lambda x: x != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & nonzero, F.lit(False))


def _raws(rows: DataFrame) -> DataFrame:
    """(vec_id, label, dim, raw): ``raw`` is the vector's components as they are, little-endian."""
    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("dim", T.IntegerType()), T.StructField("raw", T.BinaryType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [x.values.to_numpy(zero_copy_only=False) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(v) for v in vectors], pa.int32()), pa.array([v.tobytes() for v in vectors], pa.binary())], names=schema.names)

    return rows.mapInArrow(each, schema)


def unit_rows(raw: bytes, dim: int, kind: str) -> np.ndarray:
    """Vectors on end (``kind``: <f4 or <f8) as unit vectors in double precision."""
    x = np.frombuffer(raw, kind).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # very small and very large vectors keep their direction
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_directions(classes: DataFrame, n: int, kind: str) -> dict[int, np.ndarray]:
    """For each dimension of the vectors, the n leading directions of their second moments.

    Tasks send one d x d sum for each dimension that they meet; the driver adds them up.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            dims, raws = b.column(0).to_pylist(), b.column(1).to_pylist()
            for d in set(dims):
                x = unit_rows(b"".join(r for r, own in zip(raws, dims, strict=True) if own == d), d, kind)
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            at = np.arange(d * d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d), pa.int32()), pa.array(at, pa.int32()), pa.array(m.ravel())], names=["dim", "at", "m"])

    parts = classes.select("dim", "raw").mapInArrow(moments, "dim int, at int, m double").groupBy("dim", "at").agg(F.sum("m").alias("m")).toPandas()
    out = {}
    for d, cells in parts.groupby("dim"):
        m = np.zeros(d * d)
        m[cells["at"]] = cells["m"]
        _, directions = np.linalg.eigh(m.reshape(d, d))
        out[int(d)] = np.ascontiguousarray(directions[:, ::-1][:, :n])
    return out


BLOCK = "block long, label long, dim int, cells array<long>, low array<double>, high array<double>, ids binary, sizes binary, raws binary, places binary"


def _placed(classes: DataFrame, directions: dict[int, np.ndarray], n: int, epsilon: float, kind: str) -> DataFrame:
    """``classes`` with their grid cells c0.. and their principal coordinates."""
    fields = [T.StructField("place", T.BinaryType()), *(T.StructField(f"c{i}", T.LongType()) for i in range(n))]
    schema = T.StructType([*classes.schema.fields, *fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = np.zeros((b.num_rows, n))
            dims, raws = (b.column(b.schema.get_field_index(k)).to_pylist() for k in ("dim", "raw"))
            for d in set(dims):
                at = [i for i, own in enumerate(dims) if own == d]
                places[at, : directions[d].shape[1]] = unit_rows(b"".join(raws[i] for i in at), d, kind) @ directions[d]
            cells = np.floor(places / epsilon).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([p.tobytes() for p in places], pa.binary()), *(pa.array(cells[:, i]) for i in range(n))], names=schema.names)

    return classes.mapInArrow(each, schema)


def _blocks(n: int, size: int, epsilon: float):
    """Runs of at most ``size`` vectors of one label in grid order, from sorted partitions."""
    from pyspark import TaskContext

    def block(number: int, rows: list[dict]) -> dict:
        places = np.frombuffer(b"".join(r["place"] for r in rows), "<f8").reshape(-1, n)
        low, high = places.min(0), places.max(0)
        first = np.floor((np.array([low[0], high[0]])) / epsilon).astype(int)
        return {
            "block": number, "label": rows[0]["label"], "dim": rows[0]["dim"], "cells": list(range(first[0], first[1] + 1)), "low": low, "high": high,
            "ids": np.array([r["node"] for r in rows], "<i8").tobytes(), "sizes": np.array([r["size"] for r in rows], "<i8").tobytes(), "raws": b"".join(r["raw"] for r in rows), "places": places.tobytes(),
        }

    floats = pa.list_(pa.float64())
    schema = pa.schema([("block", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("cells", pa.list_(pa.int64())), ("low", floats), ("high", floats), *((k, pa.binary()) for k in ("ids", "sizes", "raws", "places"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, done = TaskContext.get().partitionId() << 40, [], []
        for b in batches:
            for row in b.to_pylist():
                if held and (len(held) == size or (held[0]["label"], held[0]["dim"]) != (row["label"], row["dim"])):
                    done.append(block(number, held))
                    number, held = number + 1, []
                held.append(row)
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
        if held:
            yield pa.RecordBatch.from_pylist([block(number, held)], schema)

    return run


def ego_join(a, b, epsilon: float, threshold: float, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """The link matrix of two blocks as (rows, columns) of links, self-links and mirrored ones left out.

    A block is (ids, units, places). The intervals are halved until they are
    small; a pair of intervals whose boxes are more than epsilon apart is skipped.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    same = a is b

    def apart(i: slice, j: slice) -> bool:
        low_i, high_i, low_j, high_j = a[2][i].min(0), a[2][i].max(0), b[2][j].min(0), b[2][j].max(0)
        gap = np.maximum(0, np.maximum(low_i - high_j, low_j - high_i))
        return float((gap * gap).sum()) > (epsilon + _SLACK) ** 2

    def join(i0: int, i1: int, j0: int, j1: int) -> None:
        if (same and j1 <= i0) or apart(slice(i0, i1), slice(j0, j1)):
            return
        if i1 - i0 <= leaf and j1 - j0 <= leaf:
            hit = a[1][i0:i1] @ b[1][j0:j1].T >= threshold
            r, c = np.nonzero(hit)
            r, c = r + i0, c + j0
            if same:
                r, c = r[c > r], c[c > r]
            found.append((r, c))
            return
        im, jm = (i0 + i1 + 1) // 2, (j0 + j1 + 1) // 2
        for x0, x1 in ((i0, im), (im, i1)) if i1 - i0 > leaf else ((i0, i1),):
            for y0, y1 in ((j0, jm), (jm, j1)) if j1 - j0 > leaf else ((j0, j1),):
                join(x0, x1, y0, y1)

    join(0, len(a[0]), 0, len(b[0]))
    return np.concatenate([r for r, _ in found] or [np.zeros(0, int)]), np.concatenate([c for _, c in found] or [np.zeros(0, int)])


def _joined(epsilon: float, threshold: float, kind: str):
    """Rows (node, weight of its links, a node of its component) from blocks and their partners.

    In every run a block comes first, then those that it is joined with: a block and
    a partner are held at a time. Run 0 joins the block with itself.
    """

    def read(row: dict):
        ids = np.frombuffer(row["ids"], "<i8")
        units, places = unit_rows(row["raws"], row["dim"], kind), np.frombuffer(row["places"], "<f8").reshape(len(ids), -1)
        return ids, units, places, np.frombuffer(row["sizes"], "<i8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                b = read(row)
                if row["partner"] is None:
                    a = b
                    if row["run"]:
                        continue
                r, c = ego_join(a, b, epsilon, threshold)
                if not len(r):
                    continue
                if a is b:
                    ids, sizes = a[0], a[3]
                else:
                    ids, sizes, c = np.concatenate((a[0], b[0])), np.concatenate((a[3], b[3])), c + len(a[0])
                links = np.bincount(r, sizes[c], len(ids)) + np.bincount(c, sizes[r], len(ids))
                hit = np.flatnonzero(links)
                root = least_reached(len(ids), r, c)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit].astype(np.int64)), pa.array(ids[root[hit]])], names=["node", "links", "root"])

    return run


def linked_vectors(
    rows: DataFrame, threshold: float = THRESHOLD, directions: int = DIRECTIONS, block_rows: int = BLOCK_ROWS,
    vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    n_links counts the other rows of the same label with a cosine of at least
    ``threshold``; component_id is the least vec_id that links reach; kept marks it.
    Rows without a label, or with a null, zero or non-finite vector, have no
    links; neither have vectors of different length with each other. Rows that
    repeat a vec_id are vectors of their own. A null vec_id has no links and a
    null component. An empty table gives an empty result; other columns are not
    looked at.
    """
    spark = rows.sparkSession
    floats = rows.schema[embedding].dataType == T.ArrayType(T.FloatType())
    vector, kind = (F.col(embedding), "<f4") if floats else (F.col(embedding).cast("array<double>"), "<f8")
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), vector.alias("embedding"))
    epsilon = max(1e-6, float(np.sqrt(max(0.0, 2 - 2 * threshold))))
    valid = freeze(_raws(rows.where(_linkable())))
    key = ["label", "dim", "raw"]  # equal vectors of a label are one class
    classes = freeze(valid.groupBy(*key).agg(F.count("*").alias("size")).withColumn("node", F.monotonically_increasing_id()))
    members = freeze(valid.join(classes, key).select("vec_id", "node", "size"))

    cells = [f"c{i}" for i in range(directions)]
    order = ["label", "dim", *cells, "node"]
    placed = freeze(_placed(classes, principal_directions(classes, directions, kind), directions, epsilon, kind))
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = freeze(ordered.mapInArrow(_blocks(directions, block_rows, epsilon), BLOCK))
    pairs = freeze(_near_blocks(blocks, directions, epsilon))
    data = ("dim", "ids", "sizes", "raws", "places")
    runs = freeze(pairs.groupBy("a_block").agg(F.ceil(F.count("*") / RUN_BLOCKS).cast("int").alias("runs")))
    columns = ("a_block", "run", "partner", *data)
    alone = blocks.withColumnRenamed("block", "a_block").withColumn("partner", F.lit(None).cast("long"))
    more = runs.where("runs > 1").select("a_block", F.explode(F.sequence(F.lit(1), F.col("runs") - 1)).alias("run"))
    met = pairs.join(runs, "a_block").withColumn("run", F.pmod(F.xxhash64("b_block"), "runs").cast("int")).drop("runs")
    partners = met.join(blocks.withColumnRenamed("block", "b_block"), "b_block").withColumnRenamed("b_block", "partner")
    with arrow_rows(spark, PAIR_ROWS):
        joined = alone.withColumn("run", F.lit(0)).select(*columns).unionByName(alone.join(more, "a_block").select(*columns)).unionByName(partners.select(*columns))
        joined = joined.repartition("a_block", "run").sortWithinPartitions("a_block", "run", F.asc_nulls_first("partner"))
        links = freeze(joined.mapInArrow(_joined(epsilon, threshold, kind), "node long, links long, root long"))

    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    comps = connected_components(links, "node", "root")
    linked = members.join(counts, "node", "left").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    linked = freeze(linked.select("vec_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component"))
    least = freeze(linked.groupBy("component").agg(F.min("vec_id").alias("component_id")))
    out = linked.join(least, "component").select("vec_id", "n_links", "component_id")
    single = rows.where(~_linkable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(single).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _near_blocks(blocks: DataFrame, n: int, epsilon: float) -> DataFrame:
    """(a_block, b_block), a < b, of one label whose boxes come within epsilon of each other.

    Blocks of few cells meet on cells of the first two coordinates, others meet all
    on cells of the first. One side's cells are widened by one; a pair is taken at
    the first cells that both have, so once.
    """
    box = blocks.select("block", "label", "dim", "low", "high", F.element_at("cells", 1).alias("first0"), F.element_at("cells", -1).alias("last0"))
    if n > 1:
        cell = lambda x: F.floor(x / epsilon).cast("long")
        box = box.withColumns({"first1": cell(F.col("low")[1] - _SLACK), "last1": cell(F.col("high")[1] + _SLACK)})
        wide = (F.col("last0") - F.col("first0") >= SPAN) | (F.col("last1") - F.col("first1") >= SPAN)
    else:
        wide = F.lit(True)
    box = box.withColumn("wide", wide)

    def side(rows: DataFrame, name: str, axes: list[int], more: int) -> DataFrame:
        kept = [c for c in rows.columns if c not in ("label", "dim")]
        out = rows.select("label", "dim", *(F.col(c).alias(f"{name}_{c}") for c in kept))
        for i in axes:
            out = out.withColumn(f"cell{i}", F.explode(F.sequence(F.col(f"{name}_first{i}") - more, F.col(f"{name}_last{i}") + more)))
        return out

    def near(a: DataFrame, b: DataFrame, axes: list[int]) -> DataFrame:
        both = side(a, "a", axes, 0).join(side(b, "b", axes, 1), ["label", "dim", *(f"cell{i}" for i in axes)])
        for i in axes:
            both = both.where(F.col(f"cell{i}") == F.greatest(f"a_first{i}", F.col(f"b_first{i}") - 1))
        # unordered pairs once: widening one side is symmetric, so a < b loses none
        both = both.where((F.col("a_wide") != F.col("b_wide")) | (F.col("a_block") < F.col("b_block")))
        gap = sum((F.pow(F.greatest(F.lit(0.0), F.col("a_low")[i] - F.col("b_high")[i], F.col("b_low")[i] - F.col("a_high")[i]), F.lit(2.0)) for i in range(n)), F.lit(0.0))
        return both.where(gap <= (epsilon + _SLACK) ** 2).select(F.least("a_block", "b_block").alias("a_block"), F.greatest("a_block", "b_block").alias("b_block"))

    pairs = near(box.where("wide"), box, [0])
    if n > 1:
        pairs = pairs.unionByName(near(box.where("NOT wide"), box.where("NOT wide"), [0, 1]))
    return pairs
