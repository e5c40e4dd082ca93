"""Licence scan by canonical digests.

A text is put into a canonical form: small letters, no copyright lines, runs of
anything but letters and digits as one space, and equivalent spellings alike. The
MD5 of the whole canonical text is hash-joined to the digests of known licences,
made by the same expression. The lines of a text are looked up in the same way
among known notices, so that a document which only states its licence is seen.

Scale: DataFrame functions only. One pass over the texts leaves their digests, a
narrow table; texts and lines longer than any known text need none. Only digests
that equal a known one are shuffled. The known texts are the caller's list, so
their number is known before they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import freeze
from cohortlake.llm.licenses_known import NOTICES, VARIANTS

#: Known texts beyond this number are joined without a broadcast.
BROADCAST_ROWS = 100_000

#: Patterns on lower-case text and what replaces them, in order; for Java's and RE2's regular expressions.
#: A copyright line says whose and since when: licence texts have lines that begin with "copyright holder" or "(c) you".
COPYRIGHT_LINE = (r"(?m)^[^\p{L}\p{N}\n(©]*(copyright[ \t:]*(\(c\)|[©0-9<\[{])|\(c\)[ \t]*([0-9]|copyright)|©|all rights reserved)[^\n]*$", " ")
PUNCTUATION = (r"[^\p{L}\p{N}]+", " ")
#: Spellings that stand for one another; both sides of a comparison get the same one.
SPELLINGS = [
    (r"\b(sub|non) (licen|commercial|infring)", "$1$2"),
    (r"licenc", "licens"),
    (r"([a-z])is(e|ed|er|es|ing|ation|ations)\b", "$1iz$2"),
    (r"\b(fav|col|hon)our", "$1or"),
    (r"\bcopyright (owner|proprietor)", "copyright holder"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\b(program|analog)(me|ue)\b", "$1"),
    (r"\bwhilst\b", "while"),
    (r"\bper cent\b", "percent"),
    (r"\bfulfil\b", "fulfill"),
    (r"\bhttps\b", "http"),
]


def plain(text: Column) -> Column:
    """Small letters without copyright lines and punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), *COPYRIGHT_LINE), *PUNCTUATION))


def canonical(text: Column) -> Column:
    """The canonical form; empty for a text without letters and digits, null for null."""
    out = plain(text)
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to)
    return out


def head(short: Column) -> Column:
    """The first three words of the canonical form; each comes from two words of the plain form at most."""
    return F.substring_index(canonical(F.substring_index(short, " ", 8)), " ", 3)


def digest(text: Column, longest: int, heads: list[str] | None = None) -> Column:
    """MD5 of the canonical form; null if that is empty, or sure to be longer than ``longest`` or to begin otherwise than ``heads``.

    A spelling's replacement is at least half as long as what it replaces.
    """
    short = plain(text)
    able = (short != "") & (F.length(short) <= 2 * longest)
    return F.when(able if heads is None else able & head(short).isin(heads), F.md5(canonical(text)))


def _known(spark: SparkSession, texts: dict[str, list[str]]) -> tuple[DataFrame, int]:
    """(digest, license_id) of the known texts (of equal ones the least id), and the longest's length."""
    rows = [(name, text) for name, own in texts.items() for text in own]
    table = spark.createDataFrame(rows, "license_id string, text string")
    known = freeze(table.groupBy(F.md5(canonical(F.col("text"))).alias("digest")).agg(F.min("license_id").alias("license_id")))
    return (F.broadcast(known) if len(rows) <= BROADCAST_ROWS else known), max((2 * len(text) for _, text in rows), default=0)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", texts: dict[str, str | list[str]] = VARIANTS, notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """(doc_id, license_id, notices) of every row.

    license_id is the licence that the whole text is, else null; notices are the
    identifiers of the notices among its lines, sorted, joined by commas. Null and
    empty texts match nothing. Repeated rows and null ids are rows of their own; an
    empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    texts = {k: [v] if isinstance(v, str) else v for k, v in texts.items()}
    licences, longest = _known(spark, texts)
    forms = spark.createDataFrame([(t,) for own in texts.values() for t in own], "text string")
    heads = [r[0] for r in forms.select(head(plain(F.col("text")))).distinct().collect()]  # one for each known text at most
    lines, longest_line = _known(spark, notices)
    body = F.col(text)
    own = F.filter(F.transform(F.split(body, "\n"), lambda line: digest(line, longest_line)), lambda d: d.isNotNull())
    rows = docs.select(F.col(doc_id).alias("doc_id"), digest(body, longest, heads).alias("whole"), F.array_distinct(own).alias("lines"))
    rows = freeze(rows.withColumn("row", F.monotonically_increasing_id()))
    named = rows.select("row", F.explode("lines").alias("digest")).join(lines, "digest")
    named = named.groupBy("row").agg(F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("notices"))  # at most the known identifiers
    out = rows.join(licences, F.col("whole") == F.col("digest"), "left").join(named, "row", "left")
    return out.select("doc_id", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))
