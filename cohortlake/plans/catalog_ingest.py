"""Registered queries for ingest, text features and date slices."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.functions.text import DOCUMENT_PATTERNS, decode_base64_text, text_feature_columns, total_count
from cohortlake.operators.slices import slice_counts, slice_plan
from cohortlake.operators.state import latest_runs
from cohortlake.plans import oracle as O
from cohortlake.plans.catalog import _repos, register
from cohortlake.schemas import ENTITY_SCHEMA, RUN_SCHEMA, SNAPSHOT_SCHEMA
from cohortlake.session import freeze, scratch_dir
from cohortlake.sources import pages as P
from cohortlake.sources.landed import RELEASES, readme_bodies, release_responses
from cohortlake.sources.landed import enrichment as landed_enrichment
from cohortlake.sources.landed import latest_release as latest_release_of
from cohortlake.sources.store import read_appended, read_state
from cohortlake.sources.tables import driver_table, read_evolved
from cohortlake.streaming.ingest import start_ingest


def landed_pages(spark, sf_dir, repos=None):
    # Archived entities are the malformed nodes, in several ways.
    repos = _repos(spark, sf_dir) if repos is None else repos
    return P.land_pages(P.entity_nodes(repos, malformed=F.col("is_archived")))


FLAT_COLS = [
    "id", "name", "full_name", "owner_login", "owner_type", "description", "url", "homepage_url", "primary_language",
    "topics", "license_spdx", "is_archived", "is_fork", "is_template", "stars", "forks", "watchers", "open_issues",
    "closed_issues", "created_at", "updated_at", "pushed_at", "disk_usage_kb",
]
FLAT_SQL = """CAST(id AS VARCHAR) AS id, name, full_name, name AS owner_login, 'Organization' AS owner_type,
  concat_ws(' ', name, primary_language) AS description, url,
  CASE WHEN is_fork THEN url || '/home' END AS homepage_url, primary_language,
  coalesce(topics, []::VARCHAR[]) AS topics, CASE WHEN readme_has_demo_gif THEN 'MIT' END AS license_spdx,
  is_archived, is_fork, stars > 100 AS is_template, stars, forks, coalesce(contributors_count, 0) AS watchers,
  open_issues, closed_issues, created_at, scraped_at AS updated_at, scraped_at AS pushed_at,
  readme_length_chars AS disk_usage_kb"""


@register(
    "flatten_pages",
    O.with_ctes(body=f"SELECT {FLAT_SQL} FROM repos_v WHERE NOT is_archived"),
)
def q_flatten(spark, sf_dir):
    return P.flatten_pages(landed_pages(spark, sf_dir)).select(*FLAT_COLS)


@register(
    "quarantine_counts",
    O.with_ctes(
        body="""SELECT count(DISTINCT floor(id / 100)) AS pages, CAST(0 AS BIGINT) AS pages_unparsed,
  count(*) AS nodes_total,
  count(*) FILTER (WHERE NOT is_archived) AS nodes_valid, count(*) FILTER (WHERE is_archived) AS nodes_malformed
FROM repos_v"""
    ),
)
def q_quarantine(spark, sf_dir):
    return P.quarantine_counts(landed_pages(spark, sf_dir))


@register(
    "quarantine_reasons",
    O.with_ctes(
        body="""SELECT CASE id % 5 WHEN 1 THEN 'stargazerCount' WHEN 2 THEN 'issues' WHEN 3 THEN 'owner' ELSE 'id' END AS reason,
  count(*) AS nodes
FROM repos_v WHERE is_archived GROUP BY reason"""
    ),
)
def q_quarantine_reasons(spark, sf_dir):
    return P.quarantine_reasons(landed_pages(spark, sf_dir))


DOC_FEATURES_SQL = """CAST(length(text) AS INTEGER) AS readme_length_chars,
  CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[A-Z]'))) AS INTEGER)
    AS readme_h2_sections,
  contains(text, '@') AS readme_has_badges, contains(lower(text), 'license') AS readme_has_demo_gif,
  contains(text, chr(10)) AS readme_has_install"""


@register("text_features", f"SELECT doc_id, {DOC_FEATURES_SQL} FROM documents")
def q_text_features(spark, sf_dir):
    docs = driver_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return docs.select("doc_id", *[c.alias(n) for n, c in text_feature_columns("text", DOCUMENT_PATTERNS).items()])


@register(
    "decode_bodies",
    "SELECT doc_id AS id, CAST(length(text) + 1 AS INTEGER) AS decoded_chars, md5(text || chr(65533)) AS decoded_md5, "
    "contains(lower(text), 'license') AS readme_has_demo_gif FROM documents",
)
def q_decode(spark, sf_dir):
    bodies = readme_bodies(spark, sf_dir).select("id", decode_base64_text("content_b64").alias("text"))
    feats = text_feature_columns("text", DOCUMENT_PATTERNS)
    return bodies.select(
        "id",
        feats["readme_length_chars"].alias("decoded_chars"),
        F.md5("text").alias("decoded_md5"),
        feats["readme_has_demo_gif"].alias("readme_has_demo_gif"),
    )


RELEASE_CTES = """per_cust AS (
  SELECT c.c_custkey AS id, count(o.o_orderkey) AS n,
         arg_max(o.o_orderkey, (o.o_orderdate, o.o_orderkey)) AS latest_key,
         max(o.o_orderdate) AS latest_at
  FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey
)"""


@register(
    "link_counts",
    O.with_ctes(RELEASE_CTES, body="SELECT id, CAST(n AS INTEGER) AS releases_count FROM per_cust"),
)
def q_link_counts(spark, sf_dir):
    resp = release_responses(spark, sf_dir)
    return resp.select("id", total_count("link", F.from_json("body", RELEASES)).alias("releases_count"))


@register(
    "latest_release",
    O.with_ctes(
        RELEASE_CTES,
        body="SELECT id, CASE WHEN n > 0 THEN 'v' || CAST(latest_key AS VARCHAR) END AS latest_release_tag, "
        "latest_at AS latest_release_at FROM per_cust",
    ),
)
def q_latest_release(spark, sf_dir):
    resp = release_responses(spark, sf_dir)
    tag, at = latest_release_of(F.from_json("body", RELEASES))
    return resp.select("id", tag.alias("latest_release_tag"), at.alias("latest_release_at"))


SLICE_SQL = """WITH st AS (
  SELECT min(CAST(o_orderdate AS DATE)) AS s, max(CAST(o_orderdate AS DATE)) AS e, count(*) AS total FROM orders
), p AS (
  SELECT s, e, total, CAST(CASE WHEN total <= 1000 OR (e - s) <= 0 THEN (e - s) + 1
      ELSE greatest((e - s) // greatest(2, CAST(floor(total / 700.0) AS BIGINT)), 1) END AS INTEGER) AS chunk
  FROM st
), sl AS (
  SELECT CAST(k AS INTEGER) AS slice_id, s + CAST(k * chunk AS INTEGER) AS slice_start,
         least(s + CAST(k * chunk + chunk - 1 AS INTEGER), e) AS slice_end
  FROM p, range(0, CAST(ceil(((e - s) + 1) / chunk) AS BIGINT)) t(k)
), cnt AS (
  SELECT CAST(floor((CAST(o_orderdate AS DATE) - p.s) / p.chunk) AS INTEGER) AS slice_id, count(*) AS row_count
  FROM orders, p GROUP BY 1
)
SELECT sl.slice_id, sl.slice_start, sl.slice_end, coalesce(cnt.row_count, 0) AS row_count,
       coalesce(cnt.row_count, 0) > 1000 AS over_cap
FROM sl LEFT JOIN cnt ON cnt.slice_id = sl.slice_id"""


@register("slice_counts", SLICE_SQL)
def q_slices(spark, sf_dir):
    orders = driver_table(spark, sf_dir, "orders", ["o_orderdate"])
    return slice_counts(orders, "o_orderdate", cap=1000)


PLAN_CAP = 1000
PLAN_SQL = f"""WITH days AS (
  SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1
), totals AS (
  SELECT d, n, sum(n) OVER (ORDER BY d) AS through FROM days
), steps AS (
  SELECT d, n, (through - 1) // 700 AS step, (through - n) // 700 < (through - 1) // 700 AND n > {PLAN_CAP} - 700 AS alone FROM totals
), cuts AS (
  SELECT d, n, alone OR lag(alone, 1, true) OVER (ORDER BY d) OR step <> lag(step) OVER (ORDER BY d) AS cut FROM steps
), numbered AS (
  SELECT d, n, sum(cut::INTEGER) OVER (ORDER BY d) - 1 AS slice FROM cuts
), slices AS (
  SELECT slice::INTEGER AS slice_id, min(d) AS first_day, max(d) AS last_day, sum(n)::BIGINT AS row_count FROM numbered GROUP BY slice
)
SELECT slice_id, first_day AS slice_start, coalesce(lead(first_day) OVER (ORDER BY slice_id) - 1, last_day) AS slice_end, row_count,
       row_count > {PLAN_CAP} AS over_cap
FROM slices"""


@register("slice_plan", PLAN_SQL)
def q_slice_plan(spark, sf_dir):
    """Slices that fit the cap, from the daily counts of orders."""
    return slice_plan(driver_table(spark, sf_dir, "orders", ["o_orderdate"]), "o_orderdate", cap=PLAN_CAP)


# Three landed batches: every entity (the archived ones malformed), a refresh of
# the forks with raised counters and landed responses, and a batch without a
# single well-formed node.
STREAM_CTES = f"""valid AS (SELECT * FROM repos_v WHERE NOT is_archived),
{RELEASE_CTES},
streamed AS (
  SELECT v.*, is_fork AS again, CASE WHEN is_fork THEN d.n_chars + 1 END AS body_chars,
         CASE WHEN is_fork THEN p.n END AS releases, CASE WHEN is_fork AND p.n > 0 THEN 'v' || p.latest_key END AS tag
  FROM valid v LEFT JOIN (SELECT doc_id, length(text) AS n_chars FROM documents) d ON d.doc_id = v.id
  LEFT JOIN per_cust p ON p.id = v.id
)"""


def run_stream(spark, sf_dir) -> str:
    """Land the three batches one after the other, each run to completion; the store's folder.

    The second fails once for want of its responses, and the stream takes it again.
    """
    base = scratch_dir(spark, "stream")
    repos = freeze(_repos(spark, sf_dir))
    again = repos.where(F.col("is_fork")).withColumns({c: F.col(c) + 1 for c in ("stars", "forks")})
    bodies, releases = freeze(readme_bodies(spark, sf_dir)), freeze(release_responses(spark, sf_dir))
    responses = lambda _: landed_enrichment(bodies, None, releases, DOCUMENT_PATTERNS)
    batches = [
        (P.entity_nodes(repos, malformed=F.col("is_archived")), None),
        (P.entity_nodes(again, malformed=F.col("is_archived")), responses),
        (P.entity_nodes(repos, malformed=F.lit(True)), responses),
    ]

    def absent(_):
        raise OSError("no responses yet")

    def run(landed) -> None:
        start_ingest(
            spark, f"{base}/landing", f"{base}/store", f"{base}/checkpoint",
            available_now=True, max_files=None, force=True, enrichment=landed,
        ).awaitTermination()

    for i, (nodes, landed) in enumerate(batches):
        P.land_pages(nodes).select("body").write.mode("append").text(f"{base}/landing")
        if i == 1:
            try:
                run(absent)
            except StreamingQueryException:
                pass
        run(landed)
    return f"{base}/store"


@register(
    "stream_ingest",
    O.with_ctes(
        STREAM_CTES,
        body="""SELECT CAST(id AS VARCHAR) AS id, stars + again::INTEGER AS stars, forks + again::INTEGER AS forks, open_issues,
  closed_issues, coalesce(topics, []::VARCHAR[]) AS topics, created_at, scraped_at AS updated_at,
  CAST(body_chars AS INTEGER) AS readme_length_chars,
  again AND coalesce(readme_has_demo_gif, false) AS readme_has_demo_gif, CAST(releases AS INTEGER) AS releases_count,
  tag AS latest_release_tag, again AS refreshed, CAST(1 + again::INTEGER AS BIGINT) AS n_snapshots,
  stars + again::INTEGER AS last_stars
FROM streamed""",
    ),
)
def q_stream_ingest(spark, sf_dir):
    """Structured Streaming ingest (M1) over three batches, one of which fails once: the stored state and each key's snapshots."""
    root = run_stream(spark, sf_dir)
    state = read_state(spark, root, ENTITY_SCHEMA)
    snaps = read_appended(spark, root, "snapshots", SNAPSHOT_SCHEMA).groupBy(F.col("repo_id").alias("id")).agg(
        F.countDistinct("snapshot_at").alias("n_snapshots"), F.max_by("stars", "snapshot_at").alias("last_stars")
    )
    return state.join(snaps, "id", "left").select(
        "id", "stars", "forks", "open_issues", "closed_issues", "topics", "created_at", "updated_at", "readme_length_chars",
        "readme_has_demo_gif", "releases_count", "latest_release_tag",
        (F.col("updated_in_db_at") > F.col("scraped_at")).alias("refreshed"), "n_snapshots", "last_stars",
    )


@register(
    "stream_ingest_runs",
    O.with_ctes(
        body="""SELECT * FROM (
  SELECT 'batch-000000000000' AS run_id, count() FILTER (WHERE NOT is_archived)::INTEGER AS repos_new, 0 AS repos_refreshed,
         count() FILTER (WHERE is_archived)::INTEGER AS errors_count FROM repos_v
  UNION ALL
  SELECT 'batch-000000000001', 0, count() FILTER (WHERE NOT is_archived)::INTEGER,
         count() FILTER (WHERE is_archived)::INTEGER FROM repos_v WHERE is_fork
  UNION ALL
  SELECT 'batch-000000000002', 0, 0, count()::INTEGER FROM repos_v
) r CROSS JOIN (VALUES ('completed')) t(status) JOIN (VALUES ('batch-000000000000', 2::BIGINT), ('batch-000000000001', 3), ('batch-000000000002', 2)) n(run_id, n_records) USING (run_id)""",
    ),
)
def q_stream_runs(spark, sf_dir):
    """Start, end and failed records of the same ingest; the end record wins, also after a failure."""
    runs = read_appended(spark, run_stream(spark, sf_dir), "runs", RUN_SCHEMA)
    n = runs.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_records"))
    return latest_runs(runs).join(n, "run_id").select("run_id", "repos_new", "repos_refreshed", "errors_count", "n_records", "status")


# What the entity table looked like at three times; the declared schema is the last one.
EVOLVED_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("full_name", T.StringType()),
        T.StructField("stars", T.LongType()),
        T.StructField("forks", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("is_template", T.BooleanType()),
        T.StructField("topics", T.ArrayType(T.StringType())),
    ]
)
EVOLVED_DEFAULTS = {"forks": 0, "is_template": False}


@register(
    "evolved_read",
    O.with_ctes(
        body="""SELECT id, full_name, stars::BIGINT AS stars, CASE WHEN is_archived THEN 0 ELSE forks END::BIGINT AS forks,
  CASE WHEN NOT is_archived THEN CASE WHEN is_fork THEN CAST(created_at AS DATE)::TIMESTAMP ELSE created_at END END AS created_at,
  NOT is_archived AND NOT is_fork AND stars > 100 AS is_template, CASE WHEN NOT is_archived AND NOT is_fork THEN topics END AS topics
FROM repos_v"""
    ),
)
def q_evolved(spark, sf_dir):
    """Three Parquet folders of growing schema and widening types, read as the declared table."""
    repos = freeze(_repos(spark, sf_dir))
    base = scratch_dir(spark, "evolved")
    first = repos.where("is_archived").select("id", "full_name", F.col("stars").cast("int"))
    second = repos.where("NOT is_archived AND is_fork").select("id", "full_name", F.col("stars").cast("int"), F.col("forks").cast("int"), F.to_date("created_at").alias("created_at"))
    third = repos.where("NOT is_archived AND NOT is_fork").select(
        "id", "full_name", F.col("stars").cast("long"), F.col("forks").cast("long"), "created_at", (F.col("stars") > 100).alias("is_template"), "topics"
    )
    folders = []
    for i, rows in enumerate((first, second, third)):
        folders.append(f"{base}/v{i}")
        rows.write.parquet(folders[-1])
    return read_evolved(spark, folders, EVOLVED_SCHEMA, EVOLVED_DEFAULTS)
