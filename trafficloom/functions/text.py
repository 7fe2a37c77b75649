"""String expressions: whitespace, search patterns, export escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as whitespace in a log line.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
WHITESPACE_CLASS = (
    "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
)


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def contains_ci(value: Column, needle: str) -> Column:
    """Case-insensitive contains; ``%`` and ``_`` in the needle stay wildcards."""
    return value.ilike(f"%{needle.strip()}%")


def is_blank(text: str | None) -> bool:
    return text is None or not text.strip()


def escape_formula(value: Column) -> Column:
    """Prefix a quote where a spreadsheet would read the text as a formula."""
    return F.when(value.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), value)).otherwise(value)
