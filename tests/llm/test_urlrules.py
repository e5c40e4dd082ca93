import re

import pytest
from brute import SF
from cohortlake.llm import urlrules as U

RULES = [*U.SITE_RULES, *U.PATTERN_RULES]


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if c in U.UPPER else c for c in m[1]), m[2]) if m else ("", "")


def want_of(url, rules=RULES):
    host, path = parts(url)
    if not host + path:
        return host, path, None, "allow"
    hits = [r for r in rules if re.search(r.pattern, host + path)]
    best = max(hits, key=lambda r: (r.site, len(r.name), r.name), default=None)
    return host, path, best.name if best and best.site else None, best.verdict if best else "allow"


HARD = [
    None, "", "no scheme", "://", "http://", "http://Example.NET/en/x", "http://example.net", "http://example.net/EN/x", "http://notexample.net/en/", "http://a.b.example.com/de/?q",
    "http://example.com?x=/de/", "http://x.org/fr/#a", "http://x.org#/fr/", "ftp://org/fr/1", "http://net/", "http://a.net", "http://ÀÉ.net/é", "x://y://z.net/", "http://casino.example.com/",
    "http://my-casino.example.com/x", "http://casinos.example.com/", "http://a.com/x/wp-admin/", "http://a.com/wp-adminx/", "http://a.net/wp-admin/", "http://" + "a." * 5000 + "net/" + "x/" * 5000, "http://\n.net/\n",
]


def test_site_rules_by_hand():
    got = {u: want_of(u)[2:] for u in HARD}
    assert got["http://Example.NET/en/x"] == ("example.net/en/", "allow")
    assert got["http://example.net"] == (None, "allow") and got["http://example.net/EN/x"] == ("net/", "block")
    assert got["http://notexample.net/en/"] == ("net/", "block") and got["http://a.b.example.com/de/?q"] == ("example.com/de/", "block")
    assert got["http://x.org/fr/#a"] == got["ftp://org/fr/1"] == ("org/fr/", "allow") and got["http://x.org#/fr/"] == (None, "allow")
    assert got["http://casinos.example.com/"] == (None, "allow") and got["http://my-casino.example.com/x"] == (None, "block")
    assert got["http://a.com/wp-adminx/"] == (None, "allow") and got["http://a.com/x/wp-admin/"] == (None, "block")


def test_hard_rows(spark):
    rows = [(i, u) for i, u in enumerate(HARD)] + [(None, HARD[5]), (5, HARD[5])]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS row", "2 AS token", "3 AS host", "4 AS name")
    got = U.judge_urls(df, RULES).collect()
    key = lambda r: str(tuple(r))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(((i, *want_of(u)) for i, u in rows), key=key)
    assert U.judge_urls(df.where("false"), RULES).count() == 0


def test_the_table_and_no_rules(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    urls = {r["page_id"]: r["url"] for r in df.select("page_id", "url").collect()}
    for rules in (RULES, []):
        got = {r["page_id"]: tuple(r)[1:5] for r in U.judge_urls(df, rules).collect()}
        assert got == {i: want_of(u, rules) for i, u in urls.items()}


def test_rules_are_filed_under_their_rarest_token(spark):
    df = spark.createDataFrame([(["example", "com", "de"],), (["example", "net", "en"],), (["x", "net", "en"],)], "tokens array<string>")
    got = {r["name"]: r["token"] for r in U.rule_index(df, U.SITE_RULES).collect()}
    assert got == {"net/": "net", "example.net/en/": "en", "example.com/de/": "com", "org/fr/": "fr"}


def test_native_plan(spark, capsys):
    U.judge_urls(spark.read.parquet(f"{SF}/pages.parquet"), RULES).explain("formatted")
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", capsys.readouterr().out)


def test_a_rule_needs_a_token(spark):
    df = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    with pytest.raises(ValueError, match="token"):
        U.judge_urls(df, [U.host_pattern("any", ".*")])
