"""Landed search-result pages (nested JSON) -> flat typed entity rows.

A page is one JSON document ``{data: {search: {repositoryCount, pageInfo,
nodes: [...]}}, rateLimit: {...}}``. Pages are parsed with a declared schema
(no inference); each node is parsed once as a VARIANT, which keeps the JSON
type of every member, so an absent key (take the default), an explicit null, a
number and a string of digits can be told apart at any depth. Malformed nodes
are split off and counted, never silently dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, I, B, L = T.StringType(), T.IntegerType(), T.BooleanType(), T.LongType()
INT_MAX = 2**31 - 1


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


# Nodes stay raw JSON strings here; they are parsed per node below.
PAGE_SCHEMA = _struct(
    ("data", _struct(("search", _struct(
        ("repositoryCount", L),
        ("pageInfo", _struct(("endCursor", S), ("hasNextPage", B))),
        ("nodes", T.ArrayType(S)),
    )))),
    ("rateLimit", _struct(("remaining", I), ("resetAt", S), ("cost", I))),
)

# The members of a node and what they may be.
REQUIRED_STRINGS = ("id", "name", "nameWithOwner")
OPTIONAL_STRINGS = ("description", "url", "homepageUrl", "owner.login", "owner.__typename", "licenseInfo.spdxId")
FLAGS = ("isArchived", "isFork", "isTemplate")
COUNTERS = ("stargazerCount", "forkCount", "watchers.totalCount", "issues.totalCount", "closedIssues.totalCount")
OBJECTS = ("owner", "repositoryTopics", "watchers", "issues", "closedIssues")
TIMES = ("createdAt", "updatedAt", "pushedAt")
# Texts that count as a flag.
TRUE_TEXTS = ("1", "on", "t", "true", "y", "yes")
FALSE_TEXTS = ("0", "off", "f", "false", "n", "no")
# Reasons beside the names of members.
NOT_JSON, NOT_A_PAGE = "(not JSON)", "(not a page)"
NUMBER_KIND = "^(BIGINT|DOUBLE|DECIMAL)"
INTEGER_TEXT = r"^\s*[+-]?\d+(\.0*)?\s*$"


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def _kind(v: Column) -> Column:
    """JSON type of a variant: OBJECT..., ARRAY..., STRING, BOOLEAN, BIGINT, DOUBLE, DECIMAL..., VOID (null); NULL if absent."""
    return F.schema_of_variant(v)


def _is(v: Column, *kinds: str) -> Column:
    return F.coalesce(_kind(v).rlike(f"^({'|'.join(kinds)})"), F.lit(False))


def _may_be(v: Column, *kinds: str) -> Column:
    """Absent, or of one of the kinds."""
    return F.coalesce(_kind(v).rlike(f"^({'|'.join(kinds)})"), F.lit(True))


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it.

    (Spark computes what stands in several branches of a condition again in each.)
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _probed(v: Column, use: Callable[[Column, Column, Column], Column]) -> Column:
    """``use`` of a variant, its JSON type and its text, each computed once."""
    probe = _once(v, lambda x: F.struct(x.alias("v"), _kind(x).alias("kind"), _text(x).alias("text")))
    return _once(probe, lambda p: use(p["v"], p["kind"], p["text"]))


def _flag(v: Column) -> Column:
    """A flag, or what stands for one (0, 1, usual words); NULL for anything else."""

    def of(_, kind, text):
        word = F.lower(F.trim(F.regexp_replace(text, r"^([01])\.0+$", "$1")))
        plain = _once(word, lambda w: F.when(w.isin(*TRUE_TEXTS), F.lit(True)).when(w.isin(*FALSE_TEXTS), F.lit(False)))
        number = _once(word, lambda w: F.when(w.isin("0", "1"), w == "1"))
        return F.when(kind == "BOOLEAN", text == "true").when(kind == "STRING", plain).when(kind.rlike(NUMBER_KIND), number)

    return _probed(v, of)


def _count(v: Column) -> Column:
    """A whole number of 32 bits, also as text, as 12.0 or as a flag; NULL for anything else."""

    def of(x, kind, text):
        exact = F.when(kind == "BOOLEAN", (text == "true").cast("decimal(38,6)")).when(
            kind.rlike(NUMBER_KIND) | ((kind == "STRING") & text.rlike(INTEGER_TEXT)), F.trim(text).try_cast("decimal(38,6)")
        )
        other = _once(exact, lambda e: F.when((e == F.floor(e)) & F.abs(e).between(0, INT_MAX), e.cast("int")))
        whole = _once(F.try_variant_get(x, "$", "long"), lambda n: F.when(n.between(-INT_MAX, INT_MAX), n.cast("int")))
        return F.when(kind == "BIGINT", whole).otherwise(other)

    return _probed(v, of)


def _time(v: Column) -> Column:
    """A time from ISO text, or from seconds (milliseconds if very large) since 1970; NULL for anything else."""

    def of(x, kind, text):
        given = F.try_variant_get(x, "$", "double")
        seconds = _once(given, lambda s: F.when(F.abs(s) > 2e10, s / 1000).otherwise(s))
        instant = _once(seconds, lambda s: F.when(F.abs(s) < 2e11, F.timestamp_micros((s * 1e6).cast("long"))))
        return F.when(kind == "STRING", F.try_to_timestamp(text)).when(kind.rlike(NUMBER_KIND), instant)

    return _probed(v, of)


def _falsy(v: Column) -> Column:
    """Absent, null, false, zero, empty text, object or list."""
    text, items = _text(v), F.try_variant_get(v, "$", "array<variant>")
    zero = _is(v, "BOOLEAN", "BIGINT", "DOUBLE", "DECIMAL") & (F.coalesce(text.try_cast("double"), F.lit(0.0)) == 0) & (text != "true")
    return _may_be(v, "VOID", "OBJECT<>") | F.coalesce(F.size(items) == 0, F.lit(False)) | (_is(v, "STRING") & (text == "")) | zero


def _topics(v: Column) -> Column:
    return F.try_variant_get(v, "$.repositoryTopics.nodes", "array<variant>")


def node_checks(v: Column) -> list[tuple[str, Column]]:
    """(member, whether it is absent or what it may be), for every member at any depth.

    An explicit null is no value for a flag, a counter or an object.
    """
    absent = lambda p: _kind(_at(v, p)).isNull()
    checks = [(p, _is(_at(v, p), "STRING")) for p in REQUIRED_STRINGS]  # so it is an object
    checks += [(p, _may_be(_at(v, p), "VOID", "STRING")) for p in OPTIONAL_STRINGS]
    checks += [(p, _may_be(_at(v, p), "OBJECT")) for p in OBJECTS if p != "repositoryTopics"]
    checks += [(p, absent(p) | _flag(_at(v, p)).isNotNull()) for p in FLAGS]
    checks += [(p, absent(p) | _count(_at(v, p)).isNotNull()) for p in COUNTERS]
    checks += [(p, _time(_at(v, p)).isNotNull() | _may_be(_at(v, p), "VOID")) for p in TIMES]
    checks.append(("diskUsage", _count(_at(v, "diskUsage")).isNotNull() | _may_be(_at(v, "diskUsage"), "VOID")))
    language, license_ = _at(v, "primaryLanguage"), _at(v, "licenseInfo")
    named = _is(language, "OBJECT") & _is(_at(v, "primaryLanguage.name"), "STRING", "VOID")
    checks.append(("primaryLanguage", named | _falsy(language)))
    checks.append(("licenseInfo", _is(license_, "OBJECT") | _falsy(license_)))
    # a list of named topics, or no list in an object, or nothing; the type of a whole list is never asked for
    named = F.forall(_topics(v), lambda t: _is(_at(t, "topic.name"), "STRING") | (_is(t, "OBJECT") & _falsy(_at(t, "topic"))))
    bare = _may_be(_at(v, "repositoryTopics"), "OBJECT") & absent("repositoryTopics.nodes")
    checks.append(("repositoryTopics", F.coalesce(named, bare)))
    return checks


def node_valid(v: str | Column = "v") -> Column:
    """True when a parsed node is well-formed: all of :func:`node_checks` hold."""
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce(reduce(lambda a, b: a & b, [ok for _, ok in node_checks(v)]), F.lit(False))


def failed_checks(v: str | Column = "v") -> Column:
    """The members of a parsed node that are not what they may be; NOT_JSON for a node that does not parse."""
    v = F.col(v) if isinstance(v, str) else v
    failed = [F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in node_checks(v)]
    return F.when(v.isNull(), F.array(F.lit(NOT_JSON))).otherwise(F.array_distinct(F.array_compact(F.array(*failed))))


def parse_pages(raw: DataFrame, body: str = "body") -> DataFrame:
    """One row per node: ``raw_node`` text and the node as variant ``v`` (NULL if it does not parse).

    Each node is parsed inside its page's array, before the explode, so the
    parse runs once per node.
    """
    pages = raw.select(F.from_json(F.col(body), PAGE_SCHEMA).alias("_p"))
    parsed = _parsed_nodes(F.col("_p.data.search.nodes"))
    return pages.select(F.explode(parsed).alias("_e")).select("_e.raw_node", "_e.v")


def _parsed_nodes(nodes: Column) -> Column:
    """Array of ``struct(raw_node, v)``: each node parsed once."""
    return F.transform(nodes, lambda x: F.struct(x.alias("raw_node"), F.try_parse_json(x).alias("v")))


def parse_all(raw: DataFrame, body: str = "body") -> DataFrame:
    """Like :func:`parse_pages`, and a row for each page without a node list: ``page_ok`` false, its body as ``raw_node``."""
    pages = raw.select(F.col(body).alias("_body"), F.from_json(F.col(body), PAGE_SCHEMA)["data"]["search"]["nodes"].alias("_nodes"))
    # the body of such a page is no node, whatever it parses as
    whole = F.array(F.struct(F.col("_body").alias("raw_node"), F.try_parse_json(F.lit(None).cast("string")).alias("v")))
    entries = F.when(F.col("_nodes").isNull(), whole).otherwise(_parsed_nodes(F.col("_nodes")))
    return pages.select(F.col("_nodes").isNotNull().alias("page_ok"), F.explode(entries).alias("_e")).select("page_ok", "_e.raw_node", "_e.v")


def reasons_of(v: str = "v", page_ok: str = "page_ok") -> Column:
    """Why a row of :func:`parse_all` is malformed; empty for a well-formed node."""
    return F.when(F.col(page_ok), failed_checks(v)).otherwise(F.array(F.lit(NOT_A_PAGE)))


def quarantine(raw: DataFrame, body: str = "body") -> DataFrame:
    """``(raw_node, reasons)`` of every malformed node and page, from one pass over the pages.

    ``reasons`` are asked for only where a node fails, so good nodes cost no more.
    """
    bad = parse_all(raw, body).where(~(F.col("page_ok") & node_valid()))
    return bad.select("raw_node", reasons_of().alias("reasons"))


def quarantine_reasons(raw: DataFrame, body: str = "body") -> DataFrame:
    """``(reason, nodes)``: how many malformed nodes fail for each reason (a node can for several)."""
    return quarantine(raw, body).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("nodes"))


def flat_columns(v: str = "v") -> list[Column]:
    """Field mapping node -> entity columns (absent keys take defaults)."""
    at = lambda path: _at(F.col(v), path)
    text = lambda path: F.try_variant_get(F.col(v), f"$.{path}", "string")
    topics = F.transform(
        F.filter(_topics(F.col(v)), lambda t: _is(_at(t, "topic.name"), "STRING")),
        lambda t: F.try_variant_get(t, "$.topic.name", "string"),
    )
    return [
        text("id").alias("id"),
        text("name").alias("name"),
        text("nameWithOwner").alias("full_name"),
        text("owner.login").alias("owner_login"),
        text("owner.__typename").alias("owner_type"),
        text("description").alias("description"),
        text("url").alias("url"),
        text("homepageUrl").alias("homepage_url"),
        text("primaryLanguage.name").alias("primary_language"),
        F.coalesce(topics, F.array().cast("array<string>")).alias("topics"),
        text("licenseInfo.spdxId").alias("license_spdx"),
        F.coalesce(_flag(at("isArchived")), F.lit(False)).alias("is_archived"),
        F.coalesce(_flag(at("isFork")), F.lit(False)).alias("is_fork"),
        F.coalesce(_flag(at("isTemplate")), F.lit(False)).alias("is_template"),
        F.coalesce(_count(at("stargazerCount")), F.lit(0)).alias("stars"),
        F.coalesce(_count(at("forkCount")), F.lit(0)).alias("forks"),
        F.coalesce(_count(at("watchers.totalCount")), F.lit(0)).alias("watchers"),
        F.coalesce(_count(at("issues.totalCount")), F.lit(0)).alias("open_issues"),
        F.coalesce(_count(at("closedIssues.totalCount")), F.lit(0)).alias("closed_issues"),
        _time(at("createdAt")).alias("created_at"),
        _time(at("updatedAt")).alias("updated_at"),
        _time(at("pushedAt")).alias("pushed_at"),
        _count(at("diskUsage")).alias("disk_usage_kb"),
    ]


def unparsed_pages(raw: DataFrame, body: str = "body") -> DataFrame:
    """Pages whose body is not a search-result document (bad JSON or no
    node list): they would vanish in the explode, so they are split off."""
    nodes = F.from_json(F.col(body), PAGE_SCHEMA)["data"]["search"]["nodes"]
    return raw.where(nodes.isNull()).select(F.col(body).alias("raw_node"))


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good flat rows, malformed raw nodes)``; both are lazy and one pass
    each, so the caller can count the bad ones without collecting them."""
    flagged = parsed.withColumn("_ok", node_valid())
    good = flagged.where(F.col("_ok")).select(*flat_columns())
    bad = flagged.where(~F.col("_ok")).select("raw_node")
    return good, bad


def flatten_pages(raw: DataFrame, body: str = "body") -> DataFrame:
    """Landed pages -> well-formed flat rows."""
    good, _ = split_valid(parse_pages(raw, body))
    return good


def quarantine_counts(raw: DataFrame, body: str = "body") -> DataFrame:
    """One row: pages, unparseable pages, nodes, valid nodes, malformed nodes.

    Nodes are parsed once and validated inside each page's array (no
    explode), so the pages are read once and one global aggregate gives all
    the counts.
    """
    parsed_nodes = F.from_json(F.col(body), PAGE_SCHEMA)["data"]["search"]["nodes"]
    per_page = raw.select(
        parsed_nodes.isNull().alias("_bad_page"),
        F.coalesce(parsed_nodes, F.array().cast("array<string>")).alias("_nodes"),
    ).select(
        "_bad_page",
        F.size("_nodes").alias("_k"),
        F.aggregate(
            _parsed_nodes(F.col("_nodes")),
            F.lit(0),
            lambda acc, e: acc + F.when(node_valid(e["v"]), 1).otherwise(0),
        ).alias("_ok"),
    )
    return per_page.agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if("_bad_page").alias("pages_unparsed"),
        F.sum("_k").cast("long").alias("nodes_total"),
        F.sum("_ok").cast("long").alias("nodes_valid"),
        (F.sum("_k") - F.sum("_ok")).cast("long").alias("nodes_malformed"),
    )


# ---------------------------------------------------------------- landing pages from entities


ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


# Ways in which a landed node can be malformed (an id digit picks one): a
# pattern on its JSON text and what takes its place.
BREAKAGES = (
    (r'"id":"[^"]*",', ""),
    (r'"stargazerCount":\d+', '"stargazerCount":"many"'),
    (r'"issues":\{[^}]*\}', '"issues":5'),
    (r'"owner":\{[^}]*\}', '"owner":"x"'),
    (r'"id":"([^"]*)"', '"id":$1'),
)


def entity_nodes(entities: DataFrame, malformed: Column | None = None) -> DataFrame:
    """``(_key, node)``: entity rows as search-result nodes in JSON (the inverse
    of the flat mapping). Rows where ``malformed`` holds are broken in one of the
    BREAKAGES. What the entities do not have is derived from what they do."""
    topics = F.transform(F.col("topics"), lambda t: F.struct(F.struct(t.alias("name")).alias("topic")))
    count = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("totalCount")))
    node = F.to_json(
        F.struct(
            F.col("id").cast("string").alias("id"),
            F.col("name").alias("name"),
            F.col("full_name").alias("nameWithOwner"),
            F.struct(F.col("name").alias("login"), F.lit("Organization").alias("__typename")).alias("owner"),
            F.concat_ws(" ", "name", "primary_language").alias("description"),
            F.col("url").alias("url"),
            F.when(F.col("is_fork"), F.concat("url", F.lit("/home"))).alias("homepageUrl"),
            F.when(F.col("primary_language").isNotNull(), F.struct(F.col("primary_language").alias("name")))
            .alias("primaryLanguage"),
            F.when(F.col("topics").isNotNull(), F.struct(topics.alias("nodes"))).alias("repositoryTopics"),
            F.when(F.col("readme_has_demo_gif"), F.struct(F.lit("MIT").alias("spdxId"))).alias("licenseInfo"),
            F.col("is_archived").alias("isArchived"),
            F.col("is_fork").alias("isFork"),
            (F.col("stars") > 100).alias("isTemplate"),
            F.col("stars").alias("stargazerCount"),
            F.col("forks").alias("forkCount"),
            count("contributors_count").alias("watchers"),
            count("open_issues").alias("issues"),
            count("closed_issues").alias("closedIssues"),
            F.date_format("created_at", ISO).alias("createdAt"),
            F.date_format("scraped_at", ISO).alias("updatedAt"),
            F.date_format("scraped_at", ISO).alias("pushedAt"),
            F.col("readme_length_chars").alias("diskUsage"),
        )
    )
    if malformed is not None:
        way = F.pmod(F.col("id").cast("long"), F.lit(len(BREAKAGES)))
        for i, (pattern, to) in enumerate(BREAKAGES):
            broken = F.coalesce(malformed, F.lit(False)) & (way == i)
            node = F.when(broken, F.regexp_replace(node, pattern, to)).otherwise(node)
    return entities.select(F.col("id").alias("_key"), node.alias("node"))


def land_pages(nodes: DataFrame, page_size: int = 100) -> DataFrame:
    """Group nodes into pages of consecutive keys (``key div page_size``), so
    a page never holds more than ``page_size`` nodes, and write each page as a
    JSON body."""
    page = F.floor(F.col("_key") / F.lit(page_size))
    grouped = nodes.groupBy(page.alias("page")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_key"), F.col("node")))).alias("_rows"),
    )
    body = F.concat(
        F.lit('{"data":{"search":{"repositoryCount":'), F.size("_rows").cast("string"),
        F.lit(',"pageInfo":{"endCursor":"'), F.col("page").cast("string"), F.lit('","hasNextPage":true},"nodes":['),
        F.array_join(F.transform("_rows", lambda r: r["node"]), ","),
        F.lit(']}},"rateLimit":{"remaining":5000,"cost":1}}'),
    )
    return grouped.select("page", body.alias("body"))
