"""Document and response features as column expressions (no Python UDFs).

All functions return :class:`Column` objects built from Spark built-ins, so
they run inside whole-stage codegen on the executors that hold the text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TextPatterns:
    """What the quality checks look for.

    ``sections`` is a Java regex whose matches are counted. Each flag check
    is a tuple of substrings (any one suffices) and whether the text is
    lower-cased before the search.
    """

    sections: str
    badges: tuple[str, ...]
    badges_lower: bool
    demo: tuple[str, ...]
    demo_lower: bool
    install: tuple[str, ...]
    install_lower: bool


# The README checks. ``(?md)`` makes ``^`` match after "\n"
# only, which is how Python's re.MULTILINE treats line starts.
README_PATTERNS = TextPatterns(
    sections=r"(?md)^## ",
    badges=("[![",),
    badges_lower=False,
    demo=(".gif", "demo"),
    demo_lower=True,
    install=("pip install", "conda install"),
    install_lower=True,
)

# Checks used on the driver's `documents` table, whose prose
# has no markdown (see FIXTURES.md 2.3).
DOCUMENT_PATTERNS = TextPatterns(
    sections=r"(?md)^[A-Z]",
    badges=("@",),
    badges_lower=False,
    demo=("license",),
    demo_lower=True,
    install=("\n",),
    install_lower=False,
)


def _contains_any(text: Column, needles: tuple[str, ...], lower: bool) -> Column:
    subject = F.lower(text) if lower else text
    return reduce(lambda a, b: a | b, [subject.contains(n) for n in needles])


def text_feature_columns(text: str | Column, patterns: TextPatterns = README_PATTERNS) -> dict[str, Column]:
    """The five README features of ``text`` (NULL text gives NULL features)."""
    t = F.col(text) if isinstance(text, str) else text
    return {
        "readme_length_chars": F.length(t).cast("int"),
        "readme_h2_sections": F.regexp_count(t, F.lit(patterns.sections)).cast("int"),
        "readme_has_badges": _contains_any(t, patterns.badges, patterns.badges_lower),
        "readme_has_demo_gif": _contains_any(t, patterns.demo, patterns.demo_lower),
        "readme_has_install": _contains_any(t, patterns.install, patterns.install_lower),
    }


def decode_base64_text(col: str | Column) -> Column:
    """Base64 body to text; invalid UTF-8 bytes become U+FFFD.

    ``unbase64`` accepts line-wrapped input (as served by REST APIs), and
    ``make_valid_utf8`` replaces bad byte sequences instead of failing.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.make_valid_utf8(F.unbase64(c).cast("string"))


# Fixed value: how a paging Link header names its last page.
LAST_PAGE_PATTERN = r'[&?]page=(\d+)[^>]*>;\s*rel="last"'


def last_page_number(link: str | Column) -> Column:
    """Last page number from a paging ``Link`` header, 0 when absent."""
    c = F.col(link) if isinstance(link, str) else link
    found = F.regexp_extract(F.coalesce(c, F.lit("")), LAST_PAGE_PATTERN, 1)
    return F.when(found == "", F.lit(0)).otherwise(found.cast("int"))


def total_count(link: str | Column, items: str | Column) -> Column:
    """Total item count: last page from ``link``; when 0, the item count."""
    n = last_page_number(link)
    arr = F.col(items) if isinstance(items, str) else items
    n_items = F.when(arr.isNull(), F.lit(0)).otherwise(F.size(arr))
    return F.when(n == 0, n_items).otherwise(n)
