import duckdb
import pytest
from brute import SF
from cohortlake.llm import licenses as L
from cohortlake.llm.licenses_known import NOTICES, TEXTS
from cohortlake.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["license_id"], r["notices"]) for r in L.scan(df).orderBy("doc_id").collect()]


def test_known_texts_in_other_clothes(spark):
    texts = []
    for text in TEXTS.values():
        texts += [text, "(C) 2001 A. N. Other\n# © Acme\nCopyright (c) 1999 X\nAll rights reserved.\nCopyright: <year> <name>\n" + text.upper(), "  " + text.replace(" ", "\n\n  * ").replace('"', "“"), text.replace("license", "licence").replace("acknowledgment", "acknowledgement")]
    assert [i for i, _ in scan(spark, texts)] == [name for name in TEXTS for _ in range(4)]


def test_other_texts_match_nothing(spark):
    mit = TEXTS["MIT"]
    assert scan(spark, [mit + " More.", mit[:-10], "", None, "...", "\n", "Permission", mit + mit]) == [(None, "")] * 8


def test_usual_licence_files(spark):
    mit, bsd, apache, gpl = (TEXTS[k] for k in ("MIT", "BSD-3-Clause", "Apache-2.0", "GPL-3.0"))
    texts = ["MIT License\n\nCopyright (c) 2020 A\n\n" + mit, "The MIT License (MIT)\n\n" + mit, "BSD 3-Clause License\n\nCopyright (c) 2020, A\nAll rights reserved.\n\n" + bsd]
    texts += ["ISC License\n\n" + TEXTS["ISC"], "zlib License\n\n(C) 2001 B\n" + TEXTS["Zlib"], apache[: apache.index("APPENDIX")], gpl, TEXTS["MPL-2.0"], TEXTS["Unlicense"]]
    want = ["MIT", "MIT", "BSD-3-Clause", "ISC", "Zlib", "Apache-2.0", "GPL-3.0", "MPL-2.0", "Unlicense"]
    assert [i for i, _ in scan(spark, texts)] == want


def test_other_wordings_and_versions(spark):
    lines = ["This project is licensed under the Apache License 2.0.", "SPDX-License-Identifier: GPL-2.0-or-later", "Distributed under the Mozilla Public License 2.0."]
    assert [n for _, n in scan(spark, lines)] == ["Apache-2.0", "GPL-2.0", "MPL-2.0"]


def test_notices_of_lines(spark):
    lines = [t for own in NOTICES.values() for t in own]
    texts = [*lines, "Some text.\n# " + lines[0].upper() + "\n\nmore", "\n".join(lines), "x " + lines[0]]
    names = [name for name, own in NOTICES.items() for _ in own]
    assert scan(spark, texts) == [(None, n) for n in [*names, names[0], ",".join(sorted(NOTICES)), ""]]


def test_known_texts_have_digests_of_their_own(spark):
    table, longest = L._known(spark, {k: [v] for k, v in TEXTS.items()})
    assert {r["license_id"] for r in table.collect()} == set(TEXTS) and longest >= 2 * max(map(len, TEXTS.values()))


@pytest.mark.parametrize("text, form", [("Sub-License, non commercial!", "sublicense noncommercial"), ("AUTHORISED organisation colour", "authorized organization color"), ("whilst 5 per cent of https", "while 5 percent of http")])
def test_equivalent_spellings(spark, text, form):
    assert spark.range(1).select(L.canonical(F.lit(text))).first()[0] == spark.range(1).select(L.canonical(F.lit(form))).first()[0]


def test_query_matches_duckdb(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF.replace('0.001', '0.01')}/documents.parquet')")
    want = con.execute(ORACLES["op5_license_scan"]).fetchall()
    got = [tuple(r) for r in QUERIES["op5_license_scan"](spark, SF.replace("0.001", "0.01")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(n for *_, n in got)


def test_hard_rows(hard_docs, no_docs):
    got = L.scan(hard_docs).collect()
    assert len(got) == 13 and {(r["license_id"], r["notices"]) for r in got} == {(None, "")}
    assert L.scan(no_docs).count() == 0
