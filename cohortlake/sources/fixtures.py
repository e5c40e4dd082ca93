"""Entity and snapshot views over the driver's tables (see FIXTURES.md 2).

``repos_view`` gives one entity per customer, ``snapshots_view`` a counter
history per key derived from ``events``. Both are lazy DataFrames whose work
grows with the underlying tables: every aggregate is a distributed
``groupBy`` (partial aggregation before the shuffle), every lookup a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions.text import DOCUMENT_PATTERNS, text_feature_columns
from cohortlake.operators.windows import keyed_running_totals
from cohortlake.sources.tables import driver_table

# The as-of instants of the fixture views (just past the last
# order date and the last event at every scale factor).
ENTITY_AS_OF = "2001-08-02 00:00:00"
SNAPSHOT_AS_OF = "2024-01-31 00:00:00"

#: A customer with more orders than this has its lines dealt into LINE_GROUPS groups.
LARGE_ORDERS = 50_000
LINE_GROUPS = 64


def repos_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity row per customer with counters, times, topics and text features."""
    cust = driver_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])
    orders = driver_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"])
    lines = driver_table(
        spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linestatus", "l_shipdate"]
    )
    part = driver_table(spark, sf_dir, "part", ["p_partkey", "p_name"])
    docs = driver_table(spark, sf_dir, "documents", ["doc_id", "text"])

    order_side = orders.groupBy(F.col("o_custkey").alias("id")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("_price"),
        F.max("o_orderdate").alias("_last_order"),
    )
    # Every line meets its order, then the name of its part, once. Names are put
    # together per key, so that a key that comes twice does not double a line.
    names = part.where("p_name IS NOT NULL").groupBy("p_partkey").agg(F.concat_ws(" ", F.collect_set("p_name")).alias("_name"))
    # A customer's lines meet in one task, those of the few very large ones in LINE_GROUPS
    # groups by supplier, whose counts of suppliers add up. Few lines of a customer lie in
    # one task before, so they are dealt out as they are, not combined first.
    large = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LARGE_ORDERS)
    buyers = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("id")).where("id IS NOT NULL")
    buyers = buyers.join(F.broadcast(large.select("id", F.lit(LINE_GROUPS).alias("_groups"))), "id", "left")
    owned = lines.join(buyers, "l_orderkey").withColumnRenamed("l_partkey", "p_partkey").join(names, "p_partkey", "left")
    group = F.when(F.col("_groups").isNotNull(), F.pmod(F.xxhash64("l_suppkey"), F.col("_groups")).cast("int")).otherwise(0)
    dealt = owned.select("id", group.alias("_group"), "l_suppkey", "l_linestatus", "l_shipdate", "_name").repartition("id", "_group")
    words = F.array_distinct(F.flatten(F.transform(F.collect_set("_name"), lambda n: F.split(n, " "))))
    grouped = dealt.groupBy("id", "_group").agg(
        F.count(F.lit(1)).alias("_lines"),
        F.count_if(F.col("l_linestatus") == "O").alias("_open"),
        F.count_if(F.col("l_linestatus") == "F").alias("_closed"),
        F.size(F.collect_set("l_suppkey")).alias("_suppliers"),
        F.max("l_shipdate").alias("_last_ship"),
        words.alias("_words"),
    )
    # Topics: distinct words of the names of ordered parts; a list never holds more than their vocabulary.
    topics = F.array_sort(F.array_distinct(F.flatten(F.collect_list("_words"))))
    line_side = grouped.groupBy("id").agg(
        *[F.sum(c).alias(c) for c in ("_lines", "_open", "_closed", "_suppliers")],
        F.max("_last_ship").alias("_last_ship"),
        topics.alias("_topics"),
    )
    doc_side = docs.select(F.col("doc_id").alias("id"), *[
        c.alias(n) for n, c in text_feature_columns("text", DOCUMENT_PATTERNS).items()
    ])

    m = F.col("_price").cast("double") / F.lit(1e6)
    return (
        cust.withColumnRenamed("c_custkey", "id")
        .join(order_side, "id", "left")
        .join(line_side, "id", "left")
        .join(doc_side, "id", "left")
        .select(
            "id",
            F.col("c_name").alias("name"),
            F.col("c_name").alias("full_name"),
            F.concat(F.lit("https://repos.example/"), F.col("c_name")).alias("url"),
            F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("primary_language"),
            F.when(F.size("_topics") > 0, F.col("_topics")).alias("topics"),
            (F.col("c_acctbal") < 0).alias("is_archived"),
            (F.col("id") % 7 == 0).alias("is_fork"),
            F.coalesce(F.floor(F.lit(30.0) * m * m * m).cast("int"), F.lit(0)).alias("stars"),
            F.coalesce(F.col("_lines").cast("int"), F.lit(0)).alias("forks"),
            F.coalesce(F.col("_open").cast("int"), F.lit(0)).alias("open_issues"),
            F.coalesce(F.col("_closed").cast("int"), F.lit(0)).alias("closed_issues"),
            F.when(F.col("_suppliers") > 0, F.col("_suppliers").cast("int")).alias("contributors_count"),
            F.col("_last_order").alias("created_at"),
            "readme_length_chars",
            "readme_h2_sections",
            "readme_has_badges",
            "readme_has_demo_gif",
            "readme_has_install",
            F.lit(None).cast("double").alias("momentum_7d"),
            F.col("_last_ship").alias("scraped_at"),
            F.col("_last_order").alias("updated_in_db_at"),
        )
    )


def snapshots_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter history: running totals of ``events`` per derived key.

    Running totals are two-level prefix sums (see
    :func:`cohortlake.operators.windows.keyed_running_totals`), so a key
    with a large share of all events is still spread over many tasks.
    """
    ev = driver_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    ev = ev.select(
        (F.col("user_id") * 10 + F.col("event_id") % 10).alias("repo_id"),
        F.col("ts").alias("snapshot_at"),
        "event_id",
        F.col("value").cast("decimal(18,2)").alias("_value"),
        (F.col("event_type") == "error").cast("long").alias("_error"),
    )
    run = keyed_running_totals(
        ev,
        "repo_id",
        ["snapshot_at", "event_id"],
        {"_stars": F.col("_value"), "_forks": F.lit(1).cast("long"), "_errors": F.col("_error")},
    )
    return run.select(
        "repo_id",
        "snapshot_at",
        F.floor(F.col("_stars")).cast("int").alias("stars"),
        F.col("_forks").cast("int").alias("forks"),
        F.col("_errors").cast("int").alias("open_issues"),
    )
