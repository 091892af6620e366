"""Leakage-safe feature tables of pull requests.

Every block is one aggregate by ``pr_id`` with map-side partial sums, so a pull
request with very many files or comments costs one row per task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.fixed_values import CARRIER_COLUMNS, STRUCTURE_COLUMNS, VARIANT_COLUMNS
from tributary.functions import patches, text
from tributary.operators.ordering import day_bucket, prefix_sums
from tributary.operators.stats import pooled_sums, share


def is_human_closed() -> Column:
    return ~F.col("is_ai_authored") & F.col("state").isin("MERGED", "CLOSED")


def restrict_to(table: DataFrame, population: DataFrame, key: str = "pr_id") -> DataFrame:
    """Rows of a child table whose key is in the population."""
    return table.join(population.select(key), key, "left_semi")


def human_closed(pull_requests: DataFrame) -> DataFrame:
    """Human-written, closed pull requests: ``pr_id, repo, author_login, created_at, y, labels``."""
    return pull_requests.where(is_human_closed()).select(
        F.col("id").alias("pr_id"), "repo", "author_login", "created_at",
        F.col("is_merged").cast("long").alias("y"), "labels",
    )


def ai_labelled(pull_requests: DataFrame) -> DataFrame:
    """AI-authored pull requests with a known outcome: ``pr_id, repo, y, created_at``."""
    return pull_requests.where(F.col("is_ai_authored") & F.col("is_merged").isNotNull()).select(
        F.col("id").alias("pr_id"), "repo", F.col("is_merged").cast("long").alias("y"), "created_at"
    )


STATUSES = ["added", "modified", "removed", "renamed"]
FILE_COUNTS = ["m_num_hunks", *[f"m_files_{s}" for s in STATUSES]]
MESSAGE_LENGTHS = ["t_commit_msg_len_first", "t_commit_msg_len_mean", "t_commit_msg_len_total"]
REVIEW_COUNTS = ["p_num_reviews", "p_has_changes_requested", "p_has_approved", "p_num_reviewers"]


def own_modification_columns() -> list[Column]:
    """Size and churn columns that the pull request row itself carries."""
    added, deleted, files = F.col("additions"), F.col("deletions"), F.col("changed_files")
    return [
        added.alias("m_additions"), deleted.alias("m_deletions"),
        text.churn(added, deleted).alias("m_churn"),
        text.net_change(added, deleted).alias("m_net_change"),
        files.alias("m_changed_files"),
        text.churn_per_file(added, deleted, files).alias("m_avg_file_churn"),
        text.added_share(added, deleted).alias("m_frac_added"),
    ]


def own_text_columns() -> list[Column]:
    """Lengths of title and body."""
    title, body = F.col("title"), F.col("body")
    return [
        text.chars(title).alias("t_title_len"), text.words(title).alias("t_title_wordcount"),
        text.chars(body).alias("t_body_len"), text.words(body).alias("t_body_wordcount"),
        (text.chars(body) == 0).cast("long").alias("t_body_is_empty"),
    ]


def own_process_columns() -> list[Column]:
    """Label and AI-review columns of the pull request row."""
    return [
        F.greatest(F.size("labels"), F.lit(0)).cast("long").alias("num_labels"),
        F.col("is_ai_reviewed").cast("long").alias("p_is_ai_reviewed"),
        F.col("n_ai_reviewers").cast("long").alias("p_n_ai_reviewers"),
    ]


def file_count_columns(markers: Column) -> list[Column]:
    """Aggregates over changed files: hunks and files by status."""
    return [
        F.sum(markers).alias("m_num_hunks"),
        *[F.count_if(F.col("status") == s).alias(f"m_files_{s}") for s in STATUSES],
    ]


def commit_columns() -> list[Column]:
    """Aggregates over commits: their number, and first (in stored order), mean and total message length."""
    size = F.length("message").cast("long")
    known = F.col("message").isNotNull()
    return [
        F.count(F.lit(1)).alias("m_num_commits"),
        F.min_by(size, F.when(known, F.col("commit_ord"))).cast("double").alias("t_commit_msg_len_first"),
        F.avg(size).alias("t_commit_msg_len_mean"),
        F.sum(size).cast("double").alias("t_commit_msg_len_total"),
    ]


def review_columns() -> list[Column]:
    """Aggregates over formal reviews."""
    return [
        F.count(F.lit(1)).alias("p_num_reviews"),
        F.max((F.col("state") == "CHANGES_REQUESTED").cast("long")).alias("p_has_changes_requested"),
        F.max((F.col("state") == "APPROVED").cast("long")).alias("p_has_approved"),
        F.count_distinct("reviewer_login").alias("p_num_reviewers"),
    ]


def count_by_pr(table: DataFrame, name: str) -> DataFrame:
    return table.groupBy("pr_id").agg(F.count(F.lit(1)).alias(name))


def modification_features(pull_requests: DataFrame, files_changed: DataFrame, commits: DataFrame) -> DataFrame:
    """Size, churn, hunk, file-status and commit counts per pull request."""
    base = pull_requests.select(F.col("id").alias("pr_id"), *own_modification_columns())
    per_file = files_changed.groupBy("pr_id").agg(*file_count_columns(patches.hunk_count(F.col("patch"))))
    return (
        base.join(per_file, "pr_id", "left")
        .join(count_by_pr(commits, "m_num_commits"), "pr_id", "left")
        .fillna(0, [*FILE_COUNTS, "m_num_commits"])
    )


def text_features(pull_requests: DataFrame, commits: DataFrame) -> DataFrame:
    """Title, body and commit message lengths."""
    base = pull_requests.select(F.col("id").alias("pr_id"), *own_text_columns())
    lengths = commits.groupBy("pr_id").agg(*commit_columns()).drop("m_num_commits")
    return base.join(lengths, "pr_id", "left").fillna(0.0, MESSAGE_LENGTHS)


def structure_features(population: DataFrame, structure: DataFrame) -> DataFrame:
    """Structure columns for the whole population, 0 for pull requests without changed files."""
    return (
        population.select("pr_id")
        .join(structure.select("pr_id", *STRUCTURE_COLUMNS), "pr_id", "left")
        .fillna(0, STRUCTURE_COLUMNS)
    )


def process_features(
    pull_requests: DataFrame, reviews: DataFrame, review_comments: DataFrame, issue_comments: DataFrame
) -> DataFrame:
    """Review-process columns; known only after review, so only for the ablation table."""
    base = pull_requests.select(F.col("id").alias("pr_id"), *own_process_columns())
    return (
        base.join(reviews.groupBy("pr_id").agg(*review_columns()), "pr_id", "left")
        .join(count_by_pr(review_comments, "p_num_review_comments"), "pr_id", "left")
        .join(count_by_pr(issue_comments, "p_num_issue_comments"), "pr_id", "left")
        .fillna(0, [*REVIEW_COUNTS, "p_num_review_comments", "p_num_issue_comments"])
    )


def author_history(population: DataFrame, pull_requests: DataFrame, clock: str = "created_at") -> DataFrame:
    """Count and merge rate of the author's strictly earlier pull requests in the same repository.

    Computed over all pull requests, whatever the population.  Outcomes are first
    summed per (repository, author, instant), so equal instants exclude each other
    and a busy account is a prefix sum over days, not one long window.
    """
    known = pull_requests.where(F.col("author_login").isNotNull())
    instants = known.groupBy("repo", "author_login", F.col(clock).alias("_at")).agg(
        F.count(F.lit(1)).alias("prs"), F.count_if("is_merged").alias("merged")
    )
    history = prefix_sums(
        instants.where(F.col("_at").isNotNull()), ["repo", "author_login"], ["_at"], ["prs", "merged"], day_bucket("_at")
    ).select(
        "repo", "author_login", F.col("_at").alias("created_at"),
        F.try_divide(F.col("before_merged").cast("double"), F.col("before_prs").cast("double"))
        .alias("author_prior_merge_rate"),
        F.col("before_prs").alias("author_prior_pr_count"),
    )
    named = population.where(F.col("author_login").isNotNull()).join(
        history, ["repo", "author_login", "created_at"], "left"
    )
    # Rows without an author all share one key; they skip the join.
    nameless = population.where(F.col("author_login").isNull()).select(
        "pr_id",
        F.lit(None).cast("double").alias("author_prior_merge_rate"),
        F.lit(0).cast("long").alias("author_prior_pr_count"),
    )
    return named.select(
        "pr_id", "author_prior_merge_rate", F.coalesce("author_prior_pr_count", F.lit(0)).alias("author_prior_pr_count")
    ).unionByName(nameless)


def join_blocks(population: DataFrame, *blocks: DataFrame) -> DataFrame:
    """Left-join feature blocks onto the population by ``pr_id``."""
    joined = population.select(*CARRIER_COLUMNS)
    for block in blocks:
        joined = joined.join(block, "pr_id", "left")
    return joined


def variant(full: DataFrame, name: str) -> DataFrame:
    """Carrier columns and the feature columns of ``v0``, ``v1`` or ``v2``."""
    return full.select(*CARRIER_COLUMNS, *VARIANT_COLUMNS[name])


def feature_summary(features: DataFrame) -> DataFrame:
    """Size, merge rate, analysable share, and author-history gaps, per repository and pooled."""
    sums = pooled_sums(
        features, "repo",
        n=F.lit(1), n_merged=F.col("y"), parseable=F.col("s_has_parseable_code"),
        no_history=(F.col("author_prior_pr_count") == 0).cast("long"),
        author_prior_merge_rate_nulls=F.col("author_prior_merge_rate").isNull().cast("long"),
    )
    return sums.select(
        "repo", "n", "n_merged",
        share(F.col("n_merged"), F.col("n")).alias("merge_rate"),
        share(F.col("parseable"), F.col("n")).alias("s_has_parseable_code_rate"),
        share(F.col("no_history"), F.col("n")).alias("author_prior_pr_count_zero_rate"),
        "author_prior_merge_rate_nulls",
    )
