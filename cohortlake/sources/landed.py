"""Landed REST responses, as tables derived from the driver's data.

The reference fetches a README body (base64), and list endpoints with
``per_page=1`` whose ``Link`` header names the last page. Here those
responses are landed tables; these builders derive them from the driver's
tables so every query reads data whose size grows with them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions.text import README_PATTERNS, TextPatterns, decode_base64_text, text_feature_columns, total_count
from cohortlake.sources.pages import ISO
from cohortlake.sources.tables import driver_table

API = "https://api.example.test/repos"


def readme_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, content_b64)``: each document as a line-wrapped base64 body,
    with one invalid UTF-8 byte appended to exercise byte replacement."""
    docs = driver_table(spark, sf_dir, "documents", ["doc_id", "text"])
    raw = F.concat(F.encode(F.col("text"), "UTF-8"), F.unhex(F.lit("FF")))
    return docs.select(F.col("doc_id").alias("id"), F.base64(raw).alias("content_b64"))


def release_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, link, body)`` per customer: a one-item page of the newest
    order as a release and, when there is more than one, a ``Link`` header
    whose last page is the order count."""
    cust = driver_table(spark, sf_dir, "customer", ["c_custkey"])
    orders = driver_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    per_cust = orders.groupBy(F.col("o_custkey").alias("id")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.struct("o_orderdate", "o_orderkey")).alias("_latest"),
    )
    joined = cust.select(F.col("c_custkey").alias("id")).join(per_cust, "id", "left")
    url = lambda page: F.concat(
        F.lit(f"<{API}/"), F.col("id").cast("string"), F.lit("/releases?per_page=1&page="), page.cast("string"), F.lit(">")
    )
    link = F.when(
        F.col("_n") > 1,
        F.concat(url(F.lit(2)), F.lit('; rel="next", '), url(F.col("_n")), F.lit('; rel="last"')),
    )
    item = F.struct(
        F.concat(F.lit("v"), F.col("_latest.o_orderkey").cast("string")).alias("tag_name"),
        F.date_format("_latest.o_orderdate", ISO).alias("published_at"),
    )
    body = F.when(F.col("_n") > 0, F.to_json(F.array(item))).otherwise(F.lit("[]"))
    return joined.select("id", link.alias("link"), body.alias("body"))


RELEASES = "array<struct<tag_name:string,published_at:string>>"


def latest_release(items: Column) -> tuple[Column, Column]:
    """Tag and publish time of the first release of a parsed list; NULLs for an empty one."""
    first = F.when(F.size(items) > 0, F.element_at(items, 1))
    return first["tag_name"], F.try_to_timestamp(first["published_at"])


def enrichment(
    bodies: DataFrame | None = None,
    contributors: DataFrame | None = None,
    releases: DataFrame | None = None,
    patterns: TextPatterns = README_PATTERNS,
) -> DataFrame:
    """One row per ``id`` (text) with the enrichment columns of the landed responses given.

    ``bodies``: (id, content_b64); ``contributors`` and ``releases``: (id, link, body).
    An entity with some responses has NULL for what did not land. Each input has
    one row per id.
    """
    parts = []
    if bodies is not None:
        text = bodies.select(F.col("id").cast("string"), decode_base64_text("content_b64").alias("_t"))
        parts.append(text.select("id", *[c.alias(n) for n, c in text_feature_columns("_t", patterns).items()]))
    if contributors is not None:
        n = total_count("link", F.from_json("body", "array<struct<login:string>>"))
        parts.append(contributors.select(F.col("id").cast("string"), n.alias("contributors_count")))
    if releases is not None:
        items = F.from_json("body", RELEASES)
        tag, at = latest_release(items)
        parts.append(
            releases.select(
                F.col("id").cast("string"), total_count("link", items).alias("releases_count"),
                tag.alias("latest_release_tag"), at.alias("latest_release_at"),
            )
        )
    return reduce(lambda a, b: a.join(b, "id", "full_outer"), parts)
