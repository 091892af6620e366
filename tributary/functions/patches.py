"""Column expressions over diff patches.  Everything stays inside the row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tributary.fixed_values import CSHARP_EXTENSIONS, PYTHON_EXTENSIONS, TYPESCRIPT_EXTENSIONS

HUNK_STARTS = r"(?md)(?=^@@)"
HUNK_HEADER = r"(?md)^@@"

# Keyword counts that stand in for a syntax tree, per language.
DECISION_WORDS = {
    "python": r"\b(?:if|elif|for|while|except|case)\b",
    "typescript": r"\b(?:if|for|while|do|case|default|catch)\b",
    "csharp": r"\b(?:if|for|foreach|while|do|case|default|catch)\b",
}
FUNCTION_WORDS = {
    "python": r"\bdef\s",
    "typescript": r"\bfunction\b|=>",
    "csharp": r"=>|\b(?:public|private|protected|internal|static)\s[^;=(]*\(",
}
# What is no first sign of a token: a token is a word or a mark.
NO_TOKEN_START = r"\s+|(?<=\w)\w+"
INDENT_UNIT = 4


def hunk_count(patch: Column) -> Column:
    """Lines that start with ``@@``; 0 for a missing patch."""
    return F.coalesce(F.regexp_count(patch, F.lit(HUNK_HEADER)), F.lit(0)).cast("long")


def language(filename: Column) -> Column:
    """python, typescript, csharp or null, by file extension."""
    extension = F.when(
        F.contains(filename, F.lit(".")), F.lower(F.substring_index(filename, ".", -1))
    )
    return (
        F.when(extension.isin(*PYTHON_EXTENSIONS), F.lit("python"))
        .when(extension.isin(*TYPESCRIPT_EXTENSIONS), F.lit("typescript"))
        .when(extension.isin(*CSHARP_EXTENSIONS), F.lit("csharp"))
    )


def post_images(patch: Column) -> Column:
    """For each hunk the text after the change: context and added lines, empty hunks left out."""
    hunks = F.filter(
        F.split(F.coalesce(patch, F.lit("")), HUNK_STARTS), lambda h: F.startswith(h, F.lit("@@"))
    )

    def after(hunk: Column) -> Column:
        kept = F.filter(
            F.split(hunk, "\n"),
            lambda l, i: (i > 0) & (l != "") & ~F.startswith(l, F.lit("-")) & ~F.startswith(l, F.lit("\\")),
        )
        marked = lambda l: F.startswith(l, F.lit("+")) | F.startswith(l, F.lit(" "))
        return F.transform(kept, lambda l: F.when(marked(l), F.substr(l, F.lit(2))).otherwise(l))

    images = F.filter(F.transform(hunks, after), lambda lines: F.size(lines) > 0)
    return F.transform(images, lambda lines: F.array_join(lines, "\n"))


def _by_language(lang: Column, text: Column, patterns: dict[str, str]) -> Column:
    count = F.lit(0)
    for name, pattern in patterns.items():
        count = F.when(lang == name, F.regexp_count(text, F.lit(pattern))).otherwise(count)
    return count.cast("long")


def hunk_decisions(lang: Column, text: Column) -> Column:
    return _by_language(lang, text, DECISION_WORDS)


def hunk_functions(lang: Column, text: Column) -> Column:
    return _by_language(lang, text, FUNCTION_WORDS)


def hunk_tokens(text: Column) -> Column:
    """Words and punctuation marks, standing in for tree nodes."""
    return F.length(F.regexp_replace(text, NO_TOKEN_START, "")).cast("long")


def hunk_depth(text: Column) -> Column:
    """One plus the deepest indentation, in units of four spaces (a tab is one unit)."""
    def width(line: Column) -> Column:
        indent = F.substr(line, F.lit(1), F.length(line) - F.length(F.ltrim(line, F.lit(" \t"))))
        return F.length(F.replace(indent, F.lit("\t"), F.lit(" " * INDENT_UNIT)))

    widths = F.transform(F.split(text, "\n"), width)
    return (F.lit(1) + F.floor(F.array_max(widths) / INDENT_UNIT)).cast("long")


def hunk_balanced(text: Column) -> Column:
    """Whether every kind of bracket opens as often as it closes, standing in for a clean parse."""

    def same(opening: str, closing: str) -> Column:
        without = (F.length(F.replace(text, F.lit(sign), F.lit(""))) for sign in (opening, closing))
        return next(without) == next(without)

    return same("(", ")") & same("[", "]") & same("{", "}")
