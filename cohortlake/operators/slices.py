"""Backfill plan: cut a date range into near-equal slices sized for a
per-request row cap, count the table's rows per slice and flag slices over
the cap.

Slice rule: when ``total <= cap`` one slice; else ``n = max(2, int(total /
(cap * 0.7)))`` slices of ``chunk = max(days // n, 1)`` days, the last one cut
at the end date. Bounds and sizes are scalar subqueries (one global
aggregate each); rows are counted per slice id with a distributed
``groupBy`` and right-joined to the generated slices so empty slices show.

:func:`slice_plan` cuts by rows instead of days: no slice is over the cap unless
it is a single day that no cut can make smaller.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The per-request result cap and the safety margin.
RESULT_CAP = 1000
SAFETY = 0.7


def slice_counts(
    df: DataFrame,
    date_col: str,
    cap: int = RESULT_CAP,
    start: str | date | None = None,
    end: str | date | None = None,
) -> DataFrame:
    d = F.to_date(F.col(date_col))
    dates = df.select(d.alias("_d"))
    # One global aggregate (reused wherever its fields appear).
    stats = dates.agg(
        F.struct(F.min("_d").alias("lo"), F.max("_d").alias("hi"), F.count(F.lit(1)).alias("n"))
    ).scalar()
    s = F.lit(start).cast("date") if start else stats["lo"]
    e = F.lit(end).cast("date") if end else stats["hi"]
    total = stats["n"]
    days = F.datediff(e, s)
    n = F.greatest(F.lit(2), F.floor(total / F.lit(float(cap) * SAFETY)).cast("long"))
    one_slice = (total <= F.lit(cap)) | (days <= 0)
    chunk = F.when(one_slice, days + 1).otherwise(F.greatest(F.floor(days / n).cast("int"), F.lit(1))).cast("int")

    counted = (
        dates.where((F.col("_d") >= s) & (F.col("_d") <= e))
        .groupBy(F.floor(F.datediff(F.col("_d"), s) / chunk).cast("int").alias("slice_id"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    slices = dates.agg(F.lit(1).alias("_one")).select(
        F.posexplode(F.sequence(s, e, F.make_dt_interval(chunk))).alias("slice_id", "slice_start")
    )
    out = slices.join(counted, "slice_id", "left").select(
        "slice_id",
        "slice_start",
        F.least(F.date_add("slice_start", chunk - 1), e).alias("slice_end"),
        F.coalesce(F.col("row_count"), F.lit(0)).alias("row_count"),
    )
    return out.withColumn("over_cap", F.col("row_count") > F.lit(cap))


def slice_plan(
    df: DataFrame,
    date_col: str,
    cap: int = RESULT_CAP,
    start: str | date | None = None,
    end: str | date | None = None,
) -> DataFrame:
    """Slices of whole days that fit the cap, from running totals of the daily counts.

    With a target of ``w = SAFETY * cap`` rows, a day belongs to the step of ``w`` rows
    that its last row falls in, and the days of a step are a slice. A day that begins in
    an earlier step brings more rows than the step has: with at most ``cap - w`` rows it
    stays in its slice, which so keeps to the cap, else it is a slice of its own. So a
    slice over the cap is a single day (``over_cap``), and there are no more than about
    two slices for each ``w`` rows.

    Slices follow one another without gaps from ``start`` to ``end`` (the first and last
    day with rows, if not given); days without rows go to the slice before them. Rows
    without a date are in no slice; a table without dated rows gives no slices. The rows
    are counted by day in one aggregate; the running totals go over a row for each day.
    """
    width = max(1, int(cap * SAFETY))
    days = df.select(F.to_date(F.col(date_col)).alias("_d")).where(F.col("_d").isNotNull())
    for bound, keep in ((start, F.col("_d") >= F.lit(start).cast("date")), (end, F.col("_d") <= F.lit(end).cast("date"))):
        days = days.where(keep) if bound else days
    days = days.groupBy("_d").agg(F.count(F.lit(1)).alias("_n"))
    line = Window.orderBy("_d")
    so_far = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    days = days.withColumn("_through", F.sum("_n").over(so_far))
    days = days.withColumn("_step", F.expr(f"div(_through - 1, {width}L)"))
    begins_before = F.expr(f"div(_through - _n, {width}L)") < F.col("_step")
    days = days.withColumn("_alone", begins_before & (F.col("_n") > cap - width))
    cut = F.col("_alone") | F.lag("_alone", 1, True).over(line) | (F.col("_step") != F.lag("_step").over(line))
    days = days.withColumn("_slice", F.sum(cut.cast("int")).over(so_far) - 1)

    slices = days.groupBy(F.col("_slice").cast("int").alias("slice_id")).agg(
        F.min("_d").alias("_first"), F.max("_d").alias("_last"), F.sum("_n").alias("row_count")
    )
    order = Window.orderBy("slice_id")
    first = F.when(F.col("slice_id") == 0, F.lit(start).cast("date")) if start else F.lit(None).cast("date")
    last = F.lit(end).cast("date") if end else F.col("_last")
    return slices.select(
        "slice_id",
        F.coalesce(first, F.col("_first")).alias("slice_start"),
        F.coalesce(F.date_sub(F.lead("_first").over(order), 1), last).alias("slice_end"),
        "row_count",
        (F.col("row_count") > cap).alias("over_cap"),
    )
