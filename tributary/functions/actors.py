"""Column expressions that classify accounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tributary import fixed_values as fixed
from tributary.functions.text import strip

# Fixed value: the no-reply address pattern.
NO_REPLY = r"(?i)^(?:\d+\+)?([^@]+)@users\.noreply\.github\.com$"


def normalize_login(login: Column) -> Column:
    """Trimmed, lower case, without one trailing ``[bot]``; null becomes empty."""
    return F.regexp_replace(F.lower(strip(F.coalesce(login, F.lit("")))), r"\[bot\]$", "")


def email_login(email: Column) -> Column:
    """Normalised login inside a GitHub no-reply address, empty for any other address."""
    return normalize_login(F.regexp_extract(strip(F.coalesce(email, F.lit(""))), NO_REPLY, 1))


def is_coding_agent(normalized: Column) -> Column:
    return normalized.isin(*fixed.CODING_AGENT_LOGINS)


def is_review_bot(normalized: Column) -> Column:
    return normalized.isin(*fixed.REVIEW_BOT_LOGINS)


def classify_actor(login: Column, kind: Column) -> Column:
    """``category, confidence, method`` of an account; the first rule that applies wins."""
    name = normalize_login(login)
    bot = F.coalesce(kind == "Bot", F.lit(False))
    user = F.coalesce(kind == "User", F.lit(False))

    def verdict(category: str, confidence: float, method: str) -> Column:
        return F.struct(
            F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method")
        )

    return (
        F.when((name == "") & (F.coalesce(kind, F.lit("")) == ""), verdict("unknown", fixed.CONFIDENCE_UNKNOWN, "no_actor"))
        .when(is_coding_agent(name) & bot, verdict("ai_coding_agent", fixed.CONFIDENCE_LISTED_BOT, "allowlist_coding_agent+bot"))
        .when(is_coding_agent(name), verdict("ai_coding_agent", fixed.CONFIDENCE_LISTED_USER, "allowlist_coding_agent+user"))
        .when(is_review_bot(name) & bot, verdict("ai_review_bot", fixed.CONFIDENCE_LISTED_BOT, "allowlist_review_bot+bot"))
        .when(is_review_bot(name), verdict("ai_review_bot", fixed.CONFIDENCE_LISTED_USER, "allowlist_review_bot+user"))
        .when(bot & name.isin(*fixed.AUTOMATION_LOGINS),
              verdict("other_bot", fixed.CONFIDENCE_OTHER_BOT, "typename_bot_known_automation"))
        .when(bot, verdict("other_bot", fixed.CONFIDENCE_OTHER_BOT, "typename_bot_other"))
        .when(user, verdict("human", fixed.CONFIDENCE_HUMAN, "typename_user"))
        .otherwise(verdict("unknown", fixed.CONFIDENCE_UNKNOWN, "no_typename"))
    )


def is_human_author(login: Column, name_patterns: bool = True) -> Column:
    """Whether a comment author counts as human.

    Listed accounts and ``[bot]`` names never do; with ``name_patterns`` neither
    do names that end in ``-bot`` or start with ``bot-``.
    """
    name = F.lower(F.coalesce(login, F.lit("")))
    pattern = r"\[bot\]|-bot$|^bot-" if name_patterns else r"\[bot\]"
    return ~name.isin(*fixed.NON_HUMAN_COMMENT_AUTHORS) & ~name.rlike(pattern)
