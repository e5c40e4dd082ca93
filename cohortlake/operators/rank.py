"""Cohort percentile rank and min-max normalisation.

``pr(v) = (avg_rank(v) - 1) / max(n - 1, 1e-9)`` inside a cohort cell, where
``avg_rank`` gives tied values the mean of their positions and ``n`` counts
the cell's non-NULL values; NULL values get 0 and the result is clamped to
[0, 1]. (``percent_rank()`` is not this: it gives ties the lowest rank.)

Two physical forms with identical results:

* ``ranged`` - the default. Values are melted to ``(row, cell, metric, v)`` and
  collapsed to distinct ``(cell, metric, v)`` counts. That table is dealt out in
  value order by a range exchange and written with its partition numbers;
  partition totals (a row per group and partition) give offsets, and a window
  inside each partition the running count. Nothing depends on the shape of the
  distribution, and no partition is larger than its share of distinct values.
  Ranks go back to the rows by value: the few values that very many rows hold are
  broadcast, the others meet by shuffle.
* ``window`` - three window functions, only when named. Every row of a cell goes
  through one task, so with 9 cells at most 9 tasks do the work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.session import freeze

# Fixed value: the floor of the rank denominator.
MIN_DENOMINATOR = 1e-9


def _pr_from_parts(rank_minus_one: Column, n_nonnull: Column) -> Column:
    pr = rank_minus_one / F.greatest(n_nonnull.cast("double") - F.lit(1.0), F.lit(MIN_DENOMINATOR))
    return F.least(F.greatest(pr, F.lit(0.0)), F.lit(1.0))


def percentile_rank_window(df: DataFrame, value: str, partition_by: list[str] | tuple[str, ...], out: str) -> DataFrame:
    """Window form: adds ``out`` to ``df``.

    One window spec per metric (one exchange and one sort): ``rank()``, the
    number of tied peers (RANGE frame on the current value) and the cell's
    non-NULL count (whole frame) all come from the same ordered partition.
    NULLs sit in their own partition so they take no rank positions.
    """
    v = F.col(value)
    cell = [F.col(c) for c in partition_by]
    spec = Window.partitionBy(*cell, v.isNull()).orderBy(v)
    peers = spec.rangeBetween(Window.currentRow, Window.currentRow)
    whole = spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank_m1 = (F.rank().over(spec) - 1).cast("double") + (F.count(F.lit(1)).over(peers) - 1).cast("double") / 2.0
    pr = _pr_from_parts(rank_m1, F.count(v).over(whole))
    return df.withColumn(out, F.when(v.isNull(), F.lit(0.0)).otherwise(pr))


# A value that more rows hold than this is joined back by broadcast. There are
# at most rows / HOT_VALUE_ROWS of them, so their table is small at any size;
# beyond BROADCAST_MAX_ROWS of them they are joined like all others.
HOT_VALUE_ROWS = 100_000
BROADCAST_MAX_ROWS = 1_000_000


def value_positions(
    long: DataFrame, group_cols: list[str], value: str = "_v", partitions: int | None = None
) -> DataFrame:
    """Sorted positions of every distinct value, computed without a global sort.

    ``long`` has one row per observation with ``group_cols`` and a non-NULL
    double ``value``. Returns one row per distinct ``(group_cols, value)``
    with ``_c`` (rows with that value), ``_below`` (rows of the group with a
    smaller value) and ``_n`` (rows of the group).

    ``partitions`` (default: the session's shuffle partitions) is the number of
    value ranges over all groups. The ranges come from Spark's sampling; the
    placed table is written once, so later reads and retries see the same ones.
    """
    g = list(group_cols)
    if not g:
        raise ValueError("value_positions needs at least one group column (use a constant one)")
    n = partitions or int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written first: the range exchange reads its input twice (sample, deal).
    counts = freeze(long.groupBy(*g, value).agg(F.count(F.lit(1)).alias("_c")))
    placed = freeze(counts.repartitionByRange(n, *g, value).withColumn("_part", F.spark_partition_id()))

    totals = placed.groupBy(*g, "_part").agg(F.sum("_c").alias("_pc"))
    by_group = Window.partitionBy(*g)
    earlier = by_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *g, "_part", F.coalesce(F.sum("_pc").over(earlier), F.lit(0)).alias("_off"), F.sum("_pc").over(by_group).alias("_n")
    )
    local = Window.partitionBy(*g, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("_in", F.coalesce(F.sum("_c").over(local), F.lit(0)))
    # group columns may be NULL (an entity without a tier): null-safe join
    right = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in [*g, "_part"]], "_off", "_n")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in [*g, "_part"]])
    return inside.join(right, same).select(*g, value, "_c", (F.col("_off") + F.col("_in")).alias("_below"), "_n")


def value_ranks(
    long: DataFrame,
    group_cols: list[str],
    value: str = "_v",
    partitions: int | None = None,
) -> DataFrame:
    """Average-rank percentile per distinct ``(group_cols, value)`` as ``_pr``, with its rows ``_c``."""
    pos = value_positions(long, group_cols, value, partitions)
    rank_m1 = F.col("_below").cast("double") + (F.col("_c") - 1).cast("double") / 2.0
    return pos.select(*group_cols, value, "_c", _pr_from_parts(rank_m1, F.col("_n")).alias("_pr"))


def join_on_values(rows: DataFrame, ranks: DataFrame, on: list[str]) -> DataFrame:
    """Inner null-safe join of rows with their values' ``_pr``, without a hot value's rows in one task."""
    ranks = freeze(ranks)
    hot = ranks.where(F.col("_c") > HOT_VALUE_ROWS)
    n_hot = hot.count()

    def meet(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], "_pr")
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
        return left.join(F.broadcast(right) if how != "plain" else right, same, "left_anti" if how == "anti" else "inner")

    if not 0 < n_hot <= BROADCAST_MAX_ROWS:
        return meet(rows, ranks, "plain").select(*rows.columns, "_pr")
    cold = meet(meet(rows, hot, "anti"), ranks.where(F.col("_c") <= HOT_VALUE_ROWS), "plain")
    return meet(rows, hot, "hot").select(*rows.columns, "_pr").unionByName(cold.select(*rows.columns, "_pr"))


def exact_percentiles(
    df: DataFrame,
    value: str,
    percentiles: dict[str, float],
    group_by: list[str] | tuple[str, ...] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Exact interpolated percentiles (``PERCENTILE_CONT``) per group.

    Built on :func:`value_positions`, then one grouped aggregation: the
    values at sorted positions ``floor(h)`` and ``floor(h) + 1`` with
    ``h = p * (n - 1)`` are the smallest values whose cumulative count passes
    those positions. No group's values are ever held by one task (unlike
    ``percentile``/``median``, which buffer a whole group). NULLs are ignored.
    """
    g = list(group_by)
    # A constant group column stands in for "no grouping" (one group).
    keys = g or [F.lit(0).alias("_g0")]
    long = df.select(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias("_v")).where(F.col("_v").isNotNull())
    pos = value_positions(long, g or ["_g0"], "_v", partitions)
    cum = F.col("_below") + F.col("_c")
    aggs = []
    for name, p in percentiles.items():
        h = F.lit(float(p)) * (F.col("_n") - 1).cast("double")
        k = F.floor(h)
        k1 = F.least(k + 1, F.col("_n") - 1)
        aggs += [
            F.min(F.when(cum > k, F.col("_v"))).alias(f"_lo_{name}"),
            F.min(F.when(cum > k1, F.col("_v"))).alias(f"_hi_{name}"),
            F.max(h - k).alias(f"_d_{name}"),
        ]
    out = pos.groupBy(*(g or ["_g0"])).agg(*aggs)
    return out.select(
        *g,
        *[
            (F.col(f"_lo_{n}") + F.col(f"_d_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n)
            for n in percentiles
        ],
    )


def approx_percentiles(
    df: DataFrame,
    value: str,
    percentiles: dict[str, float],
    group_by: list[str] | tuple[str, ...] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """Percentiles per group from a mergeable sketch, as an explicit choice over :func:`exact_percentiles`.

    One aggregate with map-side sketches of about ``accuracy`` entries: what is
    shuffled does not grow with the rows. Each result is a value of the column whose
    rank is at most ``n / accuracy`` away from ``ceil(p * n)``, for the group's ``n``
    non-NULL values. NULLs are ignored; a group without values has NULL percentiles.
    """
    names = list(percentiles)
    cuts = F.percentile_approx(F.col(value).cast("double"), [float(percentiles[n]) for n in names], accuracy)
    out = df.groupBy(*group_by).agg(cuts.alias("_cuts"))
    return out.select(*group_by, *[F.col("_cuts")[i].alias(n) for i, n in enumerate(names)])


def percentile_bounds(
    df: DataFrame,
    value: str,
    percentiles: dict[str, float],
    group_by: list[str],
    accuracy: int,
    partitions: int | None = None,
) -> DataFrame:
    """Per group ``n`` and, for each percentile, the exact values ``<name>_lo`` and ``<name>_hi`` at the
    ranks between which :func:`approx_percentiles` may answer (same positions as the exact form)."""
    g = list(group_by)
    long = df.select(*g, (F.col(value).cast("double") + F.lit(0.0)).alias("_v")).where(F.col("_v").isNotNull())
    pos = value_positions(long, g, "_v", partitions)
    through, n = F.col("_below") + F.col("_c"), F.col("_n")
    slack = F.ceil(n / F.lit(float(accuracy)))
    aggs = [F.max("_n").alias("n")]
    for name, p in percentiles.items():
        rank = F.ceil(F.lit(float(p)) * n.cast("double"))
        aggs.append(F.min(F.when(through >= F.greatest(rank - slack, F.lit(1)), F.col("_v"))).alias(f"{name}_lo"))
        aggs.append(F.min(F.when(through >= F.least(rank + slack, n), F.col("_v"))).alias(f"{name}_hi"))
    return pos.groupBy(*g).agg(*aggs)


def percentile_ranks(
    df: DataFrame,
    metrics: dict[str, str],
    partition_by: list[str] | tuple[str, ...],
    method: str = "ranged",
    partitions: int | None = None,
) -> DataFrame:
    """Add one percentile-rank column per metric (``{out_col: value_col}``).

    ``method`` is ``"ranged"`` or ``"window"``; both give every row the same
    ranks, rows that repeat a key and rows without one included.
    """
    parts = list(partition_by)
    if method == "window":
        out = df
        for name, col in metrics.items():
            out = percentile_rank_window(out, col, parts, name)
        return out
    if method != "ranged":
        raise ValueError(f"unknown rank method {method!r}")

    names = list(metrics)
    # The input is read twice (melt, final join): written once, with row numbers
    # that stay what they are when it is read again.
    df = freeze(df.withColumn("_row", F.monotonically_increasing_id()))
    # Melt the metrics so all ranks share one pass. ``+ 0.0`` turns -0.0 into
    # 0.0 so both zeros are one value.
    stacked = F.explode(
        F.array(*[F.struct(F.lit(n).alias("_metric"), F.col(c).cast("double").alias("_v")) for n, c in metrics.items()])
    ).alias("_s")
    long = (
        df.select("_row", *parts, stacked)
        .select("_row", *parts, F.col("_s._metric").alias("_metric"), (F.col("_s._v") + F.lit(0.0)).alias("_v"))
        .where(F.col("_v").isNotNull())
    )
    g = parts + ["_metric"]
    per_row = join_on_values(long, value_ranks(long, g, "_v", partitions), [*g, "_v"])
    wide = per_row.groupBy("_row").pivot("_metric", names).agg(F.max("_pr"))
    out = df.join(wide, "_row", "left").drop("_row")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in names})


def minmax_norm(df: DataFrame, value: str, out: str) -> DataFrame:
    """``(v - min) / max(max - min, 1e-9)`` over the whole table.

    The bounds are scalar subqueries over a global aggregate (partial
    aggregation on every partition, one value each), evaluated once and used
    as constants: no unpartitioned window, no single-task sort, no join.
    """
    # One subquery (reused for both fields) computes both bounds.
    bounds = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    lo, hi = bounds["lo"], bounds["hi"]
    expr = (F.col(value) - lo) / F.greatest(hi - lo, F.lit(MIN_DENOMINATOR))
    return df.withColumn(out, expr)
