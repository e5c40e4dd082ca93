"""Running totals per key that do not funnel a hot key through one task.

A plain ``sum(...) over (partition by key order by t)`` sends every row of
a key to one task, so a key with a third of all rows is a third of the job
in one task. Here the key's rows are split by a time bucket: running totals
inside each ``(key, bucket)`` partition, plus an offset per bucket from a
small table of bucket totals (one row per key and bucket), joined back.
The result equals the plain window exactly (sums are added in the same
exact types).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_running_totals(
    df: DataFrame,
    key: str,
    order_col: str | list[str],
    sums: dict[str, Column],
    bucket: Column | None = None,
) -> DataFrame:
    """Adds one running-total column per entry of ``sums`` (``name -> value``
    expression), per ``key`` in ``order_col`` order (rows frame, current row
    included; further order columns break ties). ``bucket`` must be monotone in the
    first of ``order_col`` (default: the hour of the timestamp)."""
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    b = bucket if bucket is not None else F.date_trunc("hour", F.col(order[0]))
    parts = df.select("*", b.alias("_bucket"), *[e.alias(f"_val_{n}") for n, e in sums.items()])
    local_w = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.select(
        *df.columns, "_bucket", *[F.sum(f"_val_{n}").over(local_w).alias(f"_loc_{n}") for n in sums]
    )
    totals = parts.groupBy(key, "_bucket").agg(*[F.sum(f"_val_{n}").alias(f"_tot_{n}") for n in sums])
    prior = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        key, "_bucket", *[F.sum(f"_tot_{n}").over(prior).alias(f"_off_{n}") for n in sums]
    )
    joined = local.join(offsets, [key, "_bucket"])
    return joined.select(
        *df.columns,
        *[(F.coalesce(F.col(f"_off_{n}"), F.lit(0)) + F.col(f"_loc_{n}")).alias(n) for n in sums],
    )
