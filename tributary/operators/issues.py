"""Linked issues: references in a pull request resolved to issue text.

References are found text by text and reduced with partial aggregates; the texts
of a pull request are never gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.fixed_values import AUGMENTED_SECTION_BUDGET, SECTION_MARKER
from tributary.functions import references as refs
from tributary.functions import text
from tributary.session import cut_lineage

BUCKET = 1000


def _texts(pull_requests: DataFrame, commits: DataFrame) -> DataFrame:
    """``pr_id, repo, ord, text`` of bodies (``ord`` -1, with the repository) and commit messages."""
    body = pull_requests.select(F.col("id").alias("pr_id"), "repo", F.lit(-1).cast("long").alias("ord"), F.col("body").alias("text"))
    messages = commits.select("pr_id", F.lit(None).cast("string").alias("repo"), F.col("commit_ord").alias("ord"), F.col("message").alias("text"))
    return body.unionByName(messages)


def _read_texts(texts: DataFrame) -> DataFrame:
    """Every text read once: ``pr_id, repo, ord``, whether it is blank, its ``head`` and ``tail`` for references across texts, and ``found``, those inside.

    The rows hold no text, so writing them costs little, and all that follows reads them.
    """
    start = r"(?iU)^\s*:?\s*(?:#|gh-)\d+"
    end = r"(?iU)" + refs.CLOSING_WORDS + r"\s*:?\s*$"
    kinds = [refs.CLOSING_REFERENCE, refs.ISSUE_URL, refs.BARE_REFERENCE]

    def of_kind(kind: int, pattern: str):
        return F.transform(
            refs.numbers(F.col("text"), pattern),
            lambda n, i: F.struct(F.lit(kind).alias("kind"), i.alias("idx"), n.alias("number")),
        )

    found = F.concat(*[of_kind(kind, pattern) for kind, pattern in enumerate(kinds)])
    hinted = F.contains("text", F.lit("#")) | F.contains(F.lower("text"), F.lit("gh-")) | F.contains(F.lower("text"), F.lit("/issues/"))
    blank = F.coalesce(text.strip(F.col("text")) == "", F.lit(True))
    return cut_lineage(texts.select(
        "pr_id", "repo", "ord", blank.alias("blank"), F.regexp_extract("text", start, 0).alias("head"), F.regexp_extract("text", end, 0).alias("tail"),
        F.when(hinted, found).alias("found")))


def _across_texts(read: DataFrame) -> DataFrame:
    """Closing references whose keyword ends one text and whose number starts the next.

    Neighbours are found inside buckets of the text order, and through the first text of the next bucket.
    """
    pieces = read.where("NOT blank").select("pr_id", "ord", F.floor(F.col("ord") / BUCKET).alias("_bucket"), "head", "tail")
    firsts = pieces.groupBy("pr_id", "_bucket").agg(F.min_by("head", "ord").alias("_first"))
    following = firsts.select(
        "pr_id", "_bucket", F.lead("_first").over(Window.partitionBy("pr_id").orderBy("_bucket")).alias("_next_first")
    )
    inside = Window.partitionBy("pr_id", "_bucket").orderBy("ord")
    joined = (
        pieces.join(following, ["pr_id", "_bucket"])
        .withColumn("_next", F.coalesce(F.lead("head").over(inside), F.col("_next_first")))
        .where((F.col("tail") != "") & (F.col("_next") != ""))
    )
    pair = F.concat(F.col("tail"), F.lit("\n"), F.col("_next"))
    return joined.select(
        "pr_id", "ord", F.lit(0).alias("kind"), F.lit(1 << 30).alias("idx"),
        F.explode(refs.numbers(pair, refs.CLOSING_REFERENCE)).alias("number"),
    )


def references_by_pr(pull_requests: DataFrame, commits: DataFrame) -> DataFrame:
    """``pr_id, number, rank, tier``: distinct references of body and commit messages.

    Tier 0 is closing (keyword, then address), tier 1 a bare mention; ``rank``
    sorts in order of preference.
    """
    return _references(_read_texts(_texts(pull_requests, commits)))


def _references(read: DataFrame) -> DataFrame:
    rows = read.select("pr_id", "ord", F.explode("found").alias("_r")).select("pr_id", "ord", "_r.*")
    every = rows.unionByName(_across_texts(read))
    return every.groupBy("pr_id", "number").agg(F.min(F.struct("kind", "ord", "idx")).alias("rank")).withColumn(
        "tier", F.when(F.col("rank.kind") < 2, 0).otherwise(1)
    )


def linked_issue_text(
    pull_requests: DataFrame, commits: DataFrame, issues: DataFrame, limit: int = AUGMENTED_SECTION_BUDGET
) -> DataFrame:
    """``pr_id, number, issue_text``: the first usable issue among the best references.

    Closing references are tried first, mentions only when there is none; numbers
    that are unknown or name a pull request are skipped.
    """
    read = _read_texts(_texts(pull_requests, commits))
    found = _references(read).join(read.where(F.col("ord") == -1).select("pr_id", "repo"), "pr_id")
    body = F.concat(
        F.lit("Issue #"), F.col("number"), F.lit(": "), text.strip(F.coalesce("title", F.lit(""))),
        F.lit("\n\n"), text.strip(F.coalesce("body", F.lit(""))),
    )
    usable = issues.where(~F.col("not_found") & ~F.col("is_pull_request")).select(
        "repo", "number", text.truncate(text.strip(body), limit, SECTION_MARKER, right_trim=True).alias("_text")
    )
    picked = (
        found.join(usable, ["repo", "number"], "left")
        .groupBy("pr_id")
        .agg(
            F.min("tier").alias("_best"),
            F.min(F.when(F.col("_text").isNotNull(), F.struct("tier", "rank", "number", "_text"))).alias("_hit"),
        )
    )
    return picked.where(F.col("_hit.tier") == F.col("_best")).select(
        "pr_id", "_hit.number", F.col("_hit._text").alias("issue_text")
    )
