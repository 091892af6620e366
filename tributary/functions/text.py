"""Column expressions over plain text and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as a Unicode-aware reader sees it.
SPACE = r"(?U)\s+"
LINE_BREAK = "\r\n|[\n\x0b\f\r\x1c\x1d\x1e\u0085  ]"
OTHER_BREAK = "[\x0b\f\r\x1c\x1d\x1e\u0085  ]"


def chars(text: Column) -> Column:
    """Length in characters, 0 for null."""
    return F.coalesce(F.length(text), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """Number of whitespace-separated words, 0 for null or empty."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
    return F.size(parts).cast("long")


def strip(text: Column) -> Column:
    """Without leading and trailing whitespace of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def one_line_break(text: Column) -> Column:
    """Every line break as a newline; those that are one already are left where they are."""
    return F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), OTHER_BREAK, "\n")


def lines(text: Column) -> Column:
    """Split at every line break; a final break starts no further line."""
    return F.split(F.regexp_replace(one_line_break(text), r"\n\z", ""), "\n")


def truncate(text: Column, limit: int, marker: str, right_trim: bool = False) -> Column:
    """Cut to ``limit`` characters and append ``marker`` when something was cut."""
    head = F.substring(text, 1, limit)
    if right_trim:
        head = rstrip(head)
    return F.when(F.length(text) > limit, F.concat(head, F.lit(marker))).otherwise(text)


def directory(path: Column) -> Column:
    """Folder of a path, ``(repo root)`` when it has none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"(?s)^(.*)/", 1)).otherwise(
        F.lit("(repo root)")
    )


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def or_placeholder(text: Column, placeholder: str) -> Column:
    """Stripped text, or the placeholder when nothing is left."""
    return F.coalesce(F.nullif(strip(text), F.lit("")), F.lit(placeholder))


def churn(additions: Column, deletions: Column) -> Column:
    return additions + deletions


def net_change(additions: Column, deletions: Column) -> Column:
    return additions - deletions


def churn_per_file(additions: Column, deletions: Column, files: Column) -> Column:
    return (additions + deletions).cast("double") / F.greatest(files, F.lit(1)).cast("double")


def added_share(additions: Column, deletions: Column) -> Column:
    return additions.cast("double") / (additions + deletions + 1).cast("double")


def log_count(value: Column) -> Column:
    """log(1 + x) with negative values taken as 0."""
    return F.log1p(F.greatest(value.cast("double"), F.lit(0.0)))


def signed_log(value: Column) -> Column:
    number = value.cast("double")
    return F.signum(number) * F.log1p(F.abs(number))


def iso_instant(text: Column) -> Column:
    """An ISO-8601 text as a timestamp in the session zone (UTC), null when it is not one."""
    return F.try_to_timestamp(text)


def class_label(outcome: Column) -> Column:
    return F.when(outcome == 1, F.lit("MERGE")).otherwise(F.lit("CLOSE"))


def project_phrase(repo: Column) -> Column:
    """How a prompt names the project."""
    named = F.concat(F.lit("the "), repo, F.lit(" project"))
    return F.when(F.coalesce(repo, F.lit("")) != "", named).otherwise(F.lit("a large open-source project"))


def standing(probability: Column, base_rate: Column, tolerance: float) -> Column:
    """A probability read against the base rate."""
    delta = probability - base_rate
    return (
        F.when(F.abs(delta) <= tolerance, F.lit("level with"))
        .when(delta > 0, F.lit("above"))
        .otherwise(F.lit("below"))
    )


def inline_label(text: Column, limit: int) -> Column:
    """One line of at most ``limit`` characters, an ellipsis marking the cut."""
    flat = strip(F.regexp_replace(text, SPACE, " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)
