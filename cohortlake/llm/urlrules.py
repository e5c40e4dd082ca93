"""URL filter: pattern rules that are found by their rarest literal token.

A rule is a pattern on a URL's key (lower-cased host, then path) with literal
tokens that every matching key holds as whole tokens. Each rule is filed under
the one of its tokens that the fewest URLs hold, counted over all URLs. A URL's
distinct tokens fetch the rules filed under them by an equi-join, and only these
run their regular expression on it. Of the rules that match, the longest wins.

DataFrame functions only. The rule table is the caller's list, so its size is
known before it is broadcast; what is shuffled are row numbers, hosts and paths.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.llm.common import freeze

#: A rule list beyond this many tokens is joined without a broadcast.
BROADCAST_TOKENS = 100_000

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str  # for a search in host + path
    tokens: tuple[str, ...]  # whole lower-case alphanumeric runs of every key that matches
    site: bool  # site rules win over the method's own; among equals the longest name wins


def site_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host with its subdomains and all paths that start with ``path`` (from / on)."""
    if not path.startswith("/"):
        raise ValueError(f"a path starts with /: {path!r}")
    name = host + path
    # the last run of the path may go on in the URL, so it is no whole token
    whole = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", (host + path).lower())
    return Rule(name, verdict, rf"^([^/]*\.)?{_quoted(name)}", tuple(dict.fromkeys(whole)), True)


def host_pattern(name: str, pattern: str, *tokens: str, verdict: str = BLOCK) -> Rule:
    """A rule of the method's own: ranks below every site rule."""
    return Rule(name, verdict, pattern, tokens, False)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/])", r"\\\1", text)


SITE_RULES = [
    site_rule("net", "/", BLOCK),
    site_rule("example.net", "/en/", ALLOW),
    site_rule("example.com", "/de/", BLOCK),
    site_rule("org", "/fr/", ALLOW),
]

#: Spam and advertising hosts that site rules leave open.
PATTERN_RULES = [
    host_pattern("casino", r"^([^/]*[.-])?casino[.-][^/]*", "casino"),
    host_pattern("pills", r"^([^/]*[.-])?(cheap|online|diet)-pills[.-][^/]*", "pills"),
    host_pattern("bets", r"^([^/]*[.-])?free-bets?[.-][^/]*", "free"),
    host_pattern("spam", r"^([^/]*[.-])?spam[.-][^/]*", "spam"),
    host_pattern("tracking", r"^([^/]*[.-])?ads-track[.-][^/]*", "ads", "track"),
    host_pattern("admin", r"^[^/]*/([^/]*/)*wp-admin/", "wp", "admin"),
]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or no ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _tokens(key: Column) -> Column:
    """Distinct lower-case alphanumeric runs."""
    return F.array_distinct(F.split(F.translate(key, UPPER, LOWER), "[^a-z0-9]+"))


def rule_index(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """(name, verdict, pattern, site, token): every rule under its rarest token among ``urls.tokens``."""
    spark = urls.sparkSession
    fields = [T.StructField(n, T.StringType()) for n in ("name", "verdict", "pattern", "token")]
    schema = T.StructType([*fields, T.StructField("site", T.BooleanType())])
    rows = [(r.name, r.verdict, r.pattern, t, r.site) for r in rules for t in r.tokens]
    if any(not r.tokens for r in rules):
        raise ValueError("every rule needs a literal token")
    table = spark.createDataFrame(rows, schema)
    held = urls.select(F.explode("tokens").alias("token")).join(_small(table.select("token").distinct(), len(rows)), "token")
    df = held.groupBy("token").agg(F.count("*").alias("df"))
    rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))
    index = table.join(df, "token", "left").groupBy("name", "verdict", "pattern", "site").agg(rarest.alias("least"))
    return index.select("name", "verdict", "pattern", "site", "least.token")


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_TOKENS else df


def judge_urls(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", default: str = ALLOW) -> DataFrame:
    """(page_id, host, path, rule, verdict, matched) of every row.

    ``matched`` is the winning rule, ``rule`` the same if it is a site rule.

    Null URLs and those without :// have empty host and path and match nothing, so
    they get ``default`` and a null rule. Repeated rows and null ids are rows of
    their own; an empty table gives an empty result; other columns are not looked at.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    key = F.concat("host", "path")
    # ids and tokens are a table: two passes follow, and both see the same row numbers
    rows = freeze(rows.withColumn("tokens", _tokens(key)).withColumn("row", F.monotonically_increasing_id()))
    index = freeze(rule_index(rows, rules))
    asked = rows.select("row", key.alias("key"), F.explode("tokens").alias("token"))
    found = asked.join(_small(index, len(rules)), "token").where("key RLIKE pattern")
    best = F.max_by(F.struct("name", "verdict", "site"), F.struct("site", F.length("name"), "name"))
    won = found.groupBy("row").agg(best.alias("won")).select("row", "won.name", F.col("won.verdict").alias("ruled"), "won.site")
    return rows.join(won, "row", "left").select(
        "page_id", "host", "path", F.when(F.col("site"), F.col("name")).alias("rule"), F.coalesce("ruled", F.lit(default)).alias("verdict"), F.col("name").alias("matched")
    )
