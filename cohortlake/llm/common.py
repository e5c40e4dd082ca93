"""Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cohortlake.session import configure, freeze

__all__ = ["append_columns", "arrow_rows", "connected_components", "fresh", "freeze", "map_arrow", "null_safe", "ranked", "setup", "table", "union_all"]

#: Rows of an Arrow batch; texts are long, so a batch stays at a few MB.
ARROW_ROWS = 1000


def setup(spark: SparkSession) -> SparkSession:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return setup(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores in front until no taken name equals it (in any case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``fn`` over every Arrow batch, as a narrow step; it may give any number of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def append_columns(
    df: DataFrame, text: str, fn: Callable[[pa.Array], list[pa.Array]], fields: list[tuple[str, T.DataType]]
) -> tuple[DataFrame, list[str]]:
    """All rows and columns of ``df`` and what ``fn`` gives for its text column; the new columns' names.

    A new name that an existing column has (in any case) gets underscores in front.
    """
    names: list[str] = []
    for name, _ in fields:
        names.append(fresh([*df.columns, *names], name))
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, (_, t) in zip(names, fields, strict=True))])
    at = df.columns.index(text)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([*batch.columns, *fn(batch.column(at))], names=schema.names)

    return map_arrow(df, each, schema), names


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """So many rows in an Arrow batch, for jobs that run within; for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def null_safe(left: list[str], right: list[str]) -> Column:
    """Equality of two lists of columns, null equal to null; an equi-join condition."""
    return reduce(lambda x, y: x & y, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)))


#: Dealt partitions whose totals one window adds up at a time.
PARTS_IN_WINDOW = 1024


def ranked(df: DataFrame, within: list[str], order: list[str], sums: dict[str, str], count: str | None = None) -> DataFrame:
    """``df`` written in the order (``within``, ``order``), with exact running sums.

    ``sums`` maps a new column to a numeric one: its sum over the rows before in the
    same ``within`` group (nulls are a group); ``count`` names a column for the
    number of rows before. Rows that are equal in all of ``order`` stand in any order.

    The rows are dealt by a range exchange and written once; windows run inside a
    written partition, over the totals of PARTS_IN_WINDOW partitions, and over the
    totals of those, so no group is ever in one task.
    """
    part, at, top = (fresh([*df.columns, *sums], n) for n in ("part", "at", "top"))
    one = fresh([*df.columns, *sums, part, at, top], "one")
    values = {**sums, **({count: one} if count else {})}
    inner = {n: fresh(df.columns, f"{n}_in") for n in values}
    outer = {n: fresh(df.columns, f"{n}_o") for n in [*within, part, *values]}
    dealt = df.withColumn(one, F.lit(1).cast("long")).repartitionByRange(*within, *order).sortWithinPartitions(*within, *order)
    placed = freeze(dealt.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33)).withColumn(top, F.expr(f"div({part}, {PARTS_IN_WINDOW})")))

    def before(rows: DataFrame, by: list[str], by_order: str, names: list[str]) -> list[Column]:
        window = Window.partitionBy(*by).orderBy(by_order).rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(n).over(window), F.lit(0)).alias(f"{n}_before") for n in names]

    totals = placed.groupBy(*within, top, part).agg(*(F.sum(v).alias(f"{n}_all") for n, v in values.items()))
    tops = totals.groupBy(*within, top).agg(*(F.sum(f"{n}_all").alias(f"{n}_top") for n in values))
    tops = tops.select(*(F.col(c).alias(f"{c}_t") for c in [*within, top]), *before(tops, within, top, [f"{n}_top" for n in values]))
    offsets = totals.select(*within, top, part, *before(totals, [*within, top], part, [f"{n}_all" for n in values]))
    key = [*within, top]
    offsets = offsets.join(tops, null_safe(key, [f"{c}_t" for c in key]))
    offsets = offsets.select(*(F.col(c).alias(outer[c]) for c in [*within, part]), *((F.col(f"{n}_all_before") + F.col(f"{n}_top_before")).alias(outer[n]) for n in values))
    offsets = freeze(offsets)

    window = Window.partitionBy(*within, part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.select("*", *(F.coalesce(F.sum(v).over(window), F.lit(0)).alias(inner[n]) for n, v in values.items()))
    key = [*within, part]
    out = inside.join(offsets, null_safe(key, [outer[c] for c in key]))
    return out.select(*df.columns, *((F.col(inner[n]) + F.col(outer[n])).alias(n) for n in values))


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge and is no smaller end: stars around the least node of each component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 OR up = 1 AND down = 1").agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame, a: str | Column = "a", b: str | Column = "b") -> DataFrame:
    """(node, component): the least node that links reach, for every node of an edge.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until the
    edges are stars around each component's least node: a logarithmic number of
    rounds, each two groupBys with map-side combine and equi-joins. What is joined
    is written to the shared folder first, so both sides have an exchange of their
    own and AQE can split a node with very many edges. The driver sees a count. Self-loops
    and null ends are dropped.
    """
    edges = edges.select(F.col(a).alias("x") if isinstance(a, str) else a.alias("x"), F.col(b).alias("y") if isinstance(b, str) else b.alias("y"))
    edges = edges.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    edges = freeze(edges)
    while not _stars(edges):
        # large star: every larger neighbour of a node joins the node's least neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = freeze(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the smaller neighbours of a node and the node join the least of them
        large = freeze(large)
        least = freeze(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = freeze(small.select("e.a", "e.b").where("a <> b").distinct())
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
