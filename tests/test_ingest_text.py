import base64
import json
from datetime import date, datetime

from pyspark.sql import functions as F

from cohortlake.functions.text import README_PATTERNS, decode_base64_text, text_feature_columns, total_count
from cohortlake.operators.slices import slice_counts
from cohortlake.sources.pages import flatten_pages, parse_pages, quarantine_counts, split_valid, unparsed_pages


def node(**kw):
    base = {
        "id": "n-7", "name": "tarn", "nameWithOwner": "fell/tarn",
        "owner": {"login": "fell", "__typename": "Organization"},
        "description": "a small lake", "url": "https://fell.example/tarn", "homepageUrl": None,
        "primaryLanguage": {"name": "Scala"},
        "repositoryTopics": {"nodes": [{"topic": {"name": "water"}}, {"topic": None}, {"topic": {"name": "stone"}}]},
        "licenseInfo": None, "isArchived": False, "isFork": False, "isTemplate": False,
        "stargazerCount": 31, "forkCount": 8, "watchers": {"totalCount": 6}, "issues": {"totalCount": 9},
        "closedIssues": {"totalCount": 14}, "createdAt": "2025-11-21T06:00:00Z", "updatedAt": "2026-02-14T12:30:00Z",
        "pushedAt": None, "diskUsage": 77,
    }
    for k, v in kw.items():
        if v == "ABSENT":
            base.pop(k)
        else:
            base[k] = v
    return base


def pages_df(spark, *page_nodes):
    bodies = [json.dumps({"data": {"search": {"repositoryCount": len(n), "pageInfo": {"endCursor": "c", "hasNextPage": False},
                                              "nodes": n}}}) for n in page_nodes]
    return spark.createDataFrame([(b,) for b in bodies], "body string")


def test_flatten_defaults_and_topics(spark):
    df = pages_df(spark, [node(closedIssues="ABSENT", watchers="ABSENT", isFork="ABSENT", primaryLanguage=None)])
    r = flatten_pages(df).collect()[0]
    assert r["closed_issues"] == 0 and r["watchers"] == 0 and r["is_fork"] is False
    assert r["primary_language"] is None and r["topics"] == ["water", "stone"]
    assert r["full_name"] == "fell/tarn" and r["owner_type"] == "Organization"
    assert r["created_at"] == datetime(2025, 11, 21, 6) and r["stars"] == 31


def test_malformed_split_and_counts(spark):
    good = [node(id=f"R_{i}") for i in range(3)]
    bad = [node(id="ABSENT"), node(owner=None), node(stargazerCount=None), node(issues={"totalCount": None}),
           node(repositoryTopics=None), node(stargazerCount="many"), node(createdAt="yesterday")]
    df = pages_df(spark, good + bad[:3], bad[3:]).union(spark.createDataFrame([("{not json",)], "body string"))
    ok, malformed = split_valid(parse_pages(df))
    assert ok.count() == 3 and malformed.count() == len(bad)
    assert unparsed_pages(df).count() == 1
    q = quarantine_counts(df).collect()[0]
    assert (q["pages"], q["pages_unparsed"], q["nodes_total"], q["nodes_valid"], q["nodes_malformed"]) == (3, 1, 10, 3, 7)


MALFORMED = {
    "missing id": {"id": "ABSENT"}, "number as id": {"id": 7}, "null id": {"id": None}, "null name": {"name": None},
    "null owner": {"owner": None}, "text as owner": {"owner": "x"}, "number as login": {"owner": {"login": 5}},
    "text as count": {"watchers": {"totalCount": "many"}}, "number as object": {"issues": 5}, "null count": {"issues": {"totalCount": None}},
    "null object": {"closedIssues": None}, "list as object": {"watchers": []}, "topic without name": {"repositoryTopics": {"nodes": [{"topic": {}}]}},
    "null topic name": {"repositoryTopics": {"nodes": [{"topic": {"name": None}}]}}, "null topic node": {"repositoryTopics": {"nodes": [None]}},
    "null topics": {"repositoryTopics": {"nodes": None}}, "number as topics": {"repositoryTopics": {"nodes": 3}}, "text as topic": {"repositoryTopics": {"nodes": [{"topic": "x"}]}},
    "language without name": {"primaryLanguage": {"color": "red"}}, "text as language": {"primaryLanguage": "Go"}, "list as language": {"primaryLanguage": ["Go"]},
    "text as license": {"licenseInfo": "MIT"}, "number as license": {"licenseInfo": {"spdxId": 1}}, "null flag": {"isFork": None}, "word as flag": {"isFork": "maybe"},
    "half a star": {"stargazerCount": 1.5}, "too many stars": {"stargazerCount": 2**31}, "null stars": {"stargazerCount": None}, "bad time": {"createdAt": "yesterday"},
    "object as time": {"pushedAt": {}}, "text as size": {"diskUsage": "big"}, "number as url": {"url": 1},
}
ACCEPTED = {
    "digits as stars": ({"stargazerCount": "12"}, "stars", 12), "12.0 stars": ({"stargazerCount": 12.0}, "stars", 12), "true stars": ({"stargazerCount": True}, "stars", 1),
    "digits deep down": ({"issues": {"totalCount": " 7 "}}, "open_issues", 7), "no count": ({"issues": {}}, "open_issues", 0), "word as flag": ({"isFork": "Yes"}, "is_fork", True),
    "one as flag": ({"isArchived": 1}, "is_archived", True), "zero as flag": ({"isArchived": 0.0}, "is_archived", False), "empty language": ({"primaryLanguage": {}}, "primary_language", None),
    "null language name": ({"primaryLanguage": {"name": None}}, "primary_language", None), "false language": ({"primaryLanguage": False}, "primary_language", None),
    "empty license": ({"licenseInfo": {}}, "license_spdx", None), "empty owner": ({"owner": {}}, "owner_login", None), "false topic": ({"repositoryTopics": {"nodes": [{"topic": {}}, {}]}}, "topics", []) ,
    "no topics": ({"repositoryTopics": {}}, "topics", []), "seconds": ({"pushedAt": 86400}, "pushed_at", datetime(1970, 1, 2)), "no size": ({"diskUsage": None}, "disk_usage_kb", None),
    "more members": ({"surprise": [1, {"a": None}]}, "stars", 31),
}
del MALFORMED["topic without name"]  # an empty topic is skipped like a null one: see "false topic"


def test_every_nested_member_is_checked(spark):
    cases = [node(**{**kw, "description": name}) for name, kw in MALFORMED.items()]
    bad = split_valid(parse_pages(pages_df(spark, cases)))[1].collect()
    assert sorted(json.loads(r["raw_node"])["description"] for r in bad) == sorted(MALFORMED)


def test_values_that_stand_for_others(spark):
    cases = [node(**{**kw, "description": name}) for name, (kw, _, _) in ACCEPTED.items()]
    rows = {r["description"]: r for r in flatten_pages(pages_df(spark, cases)).collect()}
    assert {n: rows[n][c] if n in rows else "rejected" for n, (_, c, _) in ACCEPTED.items()} == {n: v for n, (_, _, v) in ACCEPTED.items()}


def test_nodes_that_are_no_objects(spark):
    df = pages_df(spark, [None, 5, "x", [], {}, node()])
    good, bad = split_valid(parse_pages(df))
    assert good.count() == 1 and bad.count() == 5
    q = quarantine_counts(df).collect()[0]
    assert (q["nodes_total"], q["nodes_valid"], q["nodes_malformed"]) == (6, 1, 5)


def test_readme_features(spark):
    text = "# T\n## Install\n## Usage\r\n## Demo\n## API\n[![ci](x)]\npip install foo\nSee demo.GIF\n" + "x" * 500
    df = spark.createDataFrame([(text,), ("## only\r## not a line start",), (None,)], "t string")
    rows = df.select(*[c.alias(n) for n, c in text_feature_columns("t", README_PATTERNS).items()]).collect()
    r = rows[0]
    assert r["readme_h2_sections"] == 4 and r["readme_length_chars"] == len(text)
    assert r["readme_has_badges"] and r["readme_has_demo_gif"] and r["readme_has_install"]
    assert rows[1]["readme_h2_sections"] == 1  # "\r" alone does not start a line
    assert rows[2]["readme_length_chars"] is None


def test_decode_wrapped_base64_with_bad_bytes(spark):
    raw = ("héllo " * 40).encode() + b"\xff"
    wrapped = base64.encodebytes(raw).decode()  # 76-char lines
    r = spark.createDataFrame([(wrapped,)], "b string").select(decode_base64_text("b").alias("t")).collect()[0]
    assert r["t"] == raw.decode("utf-8", errors="replace")


def test_link_header_counts(spark):
    last = '<https://api.x/r?per_page=1&page=2>; rel="next", <https://api.x/r?per_page=1&page=57>; rel="last"'
    df = spark.createDataFrame([(last, "[{}]"), (None, "[{}]"), ("", "[]"), (None, None)], "link string, body string")
    items = F.from_json("body", "array<map<string,string>>")
    got = [r[0] for r in df.select(total_count("link", items)).collect()]
    assert got == [57, 1, 0, 0]


def test_slices_readme_example(spark):
    # 13,000 rows over 426 days -> 18 slices of 23 days plus a remainder slice
    start = date(2023, 1, 1)
    days = 426
    rows = [(date.fromordinal(start.toordinal() + (i * days) // 13000),) for i in range(13000)]
    df = spark.createDataFrame(rows, "d date")
    out = slice_counts(df, "d", cap=1000).orderBy("slice_id").collect()
    assert len(out) == 19
    assert sum(r["row_count"] for r in out) == 13000
    assert (out[0]["slice_end"] - out[0]["slice_start"]).days == 22


def test_single_slice_under_cap(spark):
    df = spark.createDataFrame([(date(2024, 1, d),) for d in range(1, 11)], "d date")
    out = slice_counts(df, "d", cap=1000).collect()
    assert len(out) == 1 and out[0]["row_count"] == 10 and not out[0]["over_cap"]
