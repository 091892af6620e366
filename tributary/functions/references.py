"""Column expressions for issue references and hunk headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tributary.fixed_values import HUNK_HEADINGS_PER_FILE
from tributary.functions.text import strip

# Patterns of references and headings.
CLOSING_WORDS = r"\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?|implement[sd]?|address(?:e[sd])?)\b"
CLOSING_REFERENCE = r"(?iU)" + CLOSING_WORDS + r"\s*:?\s+(?:#|gh-)(\d+)"
ISSUE_URL = r"(?iU)https?://github\.com/[\w.-]+/[\w.-]+/issues/(\d+)"
BARE_REFERENCE = r"(?U)(?<![\w/])#(\d+)\b"
HUNK_HEADING = r"(?md)^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@\s*(.+)$"


def numbers(text: Column, pattern: str) -> Column:
    """All captured numbers in order, repeats included."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1)
    return F.filter(F.transform(found, lambda n: n.try_cast("long")), lambda n: n.isNotNull())


def closing_references(text: Column) -> Column:
    """Numbers named by a closing keyword, then by an issue address; distinct, in order."""
    return F.array_distinct(F.concat(numbers(text, CLOSING_REFERENCE), numbers(text, ISSUE_URL)))


def mentioned_references(text: Column) -> Column:
    """Bare ``#n`` numbers that no closing reference names; distinct, in order."""
    return F.array_except(F.array_distinct(numbers(text, BARE_REFERENCE)), closing_references(text))


def best_references(text: Column) -> Column:
    closing = closing_references(text)
    return F.when(F.size(closing) > 0, closing).otherwise(mentioned_references(text))


def hunk_headings(patch: Column, limit: int = HUNK_HEADINGS_PER_FILE) -> Column:
    """Distinct texts after the second ``@@`` of the hunk headers, the first few."""
    found = F.regexp_extract_all(F.coalesce(patch, F.lit("")), F.lit(HUNK_HEADING), 1)
    return F.slice(F.array_distinct(F.filter(F.transform(found, strip), lambda h: h != "")), 1, limit)
