"""Shards that all match the mixture of sources, by proportional stratified interleaving.

Within each source the rows are put in a seeded random order; the row at rank r
of n gets the fractional rank (r - 1/2) / n. All rows sorted by that number
interleave the sources in proportion, and equal cuts of the order are the shards:
sizes differ by one row at most, and a shard holds each source's share to within
a row or two.

Ranks never need a whole source in one task. The shuffle key is a uniform hash,
so its high bits cut a source into buckets in order; a row's rank is its rank in
(source, bucket) plus the sizes of the buckets before, from a small table. The
global position comes the same way from slots of the fractional rank. Only ids,
sizes and digests are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlake.llm.common import freeze, fresh

#: Rows that one window partition holds on average, whatever the table's size.
BUCKET_ROWS = 5_000
#: Buckets whose sizes one window adds up at a time; the totals of such runs follow in a second.
RUN_KEYS = 1024


def _before(counts: DataFrame, key: str, by: list[str]) -> DataFrame:
    """``counts`` (``by``, ``key`` from 0, ``n``) with ``before``: the sum of ``n`` over smaller keys of the same ``by``.

    Windows run inside a run of RUN_KEYS keys and over the totals of the runs.
    """
    run = fresh(counts.columns, "run")
    counts = counts.withColumn(run, F.expr(f"div({key}, {RUN_KEYS}L)"))
    runs = counts.groupBy(*by, run).agg(F.sum("n").alias("n"))
    earlier = lambda part, order: F.coalesce(F.sum("n").over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("offset", earlier(by or [F.lit(0)], run)).drop("n")
    inside = counts.withColumn("inside", earlier([*by, run], key))
    return inside.join(runs, [*by, run]).withColumn("before", F.col("inside") + F.col("offset")).drop(run, "inside", "offset")


def _spread(h: Column, buckets: int) -> Column:
    """The bucket of a uniform 64-bit hash; increases with the hash."""
    return F.floor((h.cast("double") / 2.0**64 + 0.5) * buckets).cast("long")


def stratified_shards(rows: DataFrame, stratum: str, key: list[str], n_shards: int, seed: int) -> DataFrame:
    """``rows`` with shard and slot (its place in the shard, gapless from 0).

    ``key`` are the columns that give a row its random place; rows that are equal
    in all of them are interchangeable. Null strata are a stratum, null keys are
    values. An empty table gives an empty result. All columns of ``rows`` stay as
    they are; where one is called shard or slot (in any case), the new column gets
    underscores in front.
    """
    group, hashed, bucket, rank, fraction, place, position = (
        fresh(rows.columns, n) for n in ("_stratum", "_h", "_bucket", "_rank", "_fraction", "_slot", "_position")
    )
    of_group, of_bucket, of_place, before, of = (fresh(rows.columns, n) for n in ("_s", "_b", "_p", "_before", "_of"))
    shard, slot = fresh(rows.columns, "shard"), fresh(rows.columns, "slot")
    named = F.coalesce(F.concat(F.lit("s"), F.col(stratum)), F.lit("null"))
    placed = freeze(rows.withColumns({group: named, hashed: F.xxhash64(F.lit(seed), *key)}))
    total = placed.count()
    buckets = max(1, -(-total // BUCKET_ROWS))

    placed = placed.withColumn(bucket, _spread(F.col(hashed), buckets))
    sizes = placed.groupBy(F.col(group).alias("s"), F.col(bucket).alias("b")).agg(F.count("*").alias("n"))
    of_stratum = sizes.groupBy("s").agg(F.sum("n").alias("of"))
    offsets = _before(sizes, "b", ["s"]).join(of_stratum, "s")
    offsets = freeze(offsets.select(F.col("s").alias(of_group), F.col("b").alias(of_bucket), F.col("before").alias(before), F.col("of").alias(of)))
    order = Window.partitionBy(group, bucket).orderBy(hashed, *key)
    ranked = placed.withColumn(rank, F.row_number().over(order)).join(offsets, (F.col(group) == F.col(of_group)) & (F.col(bucket) == F.col(of_bucket)))
    ranked = ranked.withColumn(fraction, (F.col(rank) + F.col(before) - 0.5) / F.col(of))
    ranked = ranked.withColumn(place, F.floor(F.col(fraction) * buckets).cast("long"))
    ranked = freeze(ranked.select(*rows.columns, group, hashed, fraction, place))

    places = ranked.groupBy(F.col(place).alias("p")).agg(F.count("*").alias("n"))
    starts = freeze(_before(places, "p", []).select(F.col("p").alias(of_place), F.col("before").alias(before)))
    order = Window.partitionBy(place).orderBy(fraction, group, hashed, *key)
    out = ranked.withColumn(position, F.row_number().over(order) - 1).join(starts, F.col(place) == F.col(of_place))
    out = out.withColumn(position, F.col(position) + F.col(before))
    # shard s holds positions from floor(s * total / n) on
    out = out.withColumn(shard, F.expr(f"div(({position} + 1) * {n_shards}L - 1, {max(total, 1)}L)").cast("int"))
    out = out.withColumn(slot, F.col(position) - F.expr(f"div({shard} * {total}L, {n_shards}L)"))
    return out.select(*rows.columns, shard, slot)
