"""The augmented context of a pull request: all components, once per request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary import fixed_values as fixed
from tributary.functions import text
from tributary.operators import contexts
from tributary.operators.issues import linked_issue_text
from tributary.operators.similar import historical_comments, similar_comments
from tributary.session import cut_lineage


def augmented_context(
    queries: DataFrame, pull_requests: DataFrame, files_changed: DataFrame, commits: DataFrame,
    review_comments: DataFrame, train_pool: DataFrame, issues: DataFrame | None = None,
    diff_budget: int = fixed.AUGMENTED_DIFF_BUDGET, file_limit: int = fixed.AUGMENTED_FILE_BUDGET,
    section_limit: int = fixed.AUGMENTED_SECTION_BUDGET, history_k: int = fixed.HISTORY_COMMENTS,
    comment_limit: int = fixed.HISTORY_COMMENT_BUDGET,
) -> DataFrame:
    """One row per query request; a component that has no content is null.

    ``train_pool`` is the only source of past comments.  Without ``issues`` no
    linked issue is looked up.
    """
    ids = cut_lineage(queries.select("pr_id"))

    def mine(table: DataFrame) -> DataFrame:
        return table.join(ids, "pr_id", "left_semi")

    requests = pull_requests.join(ids.withColumnRenamed("pr_id", "id"), "id", "left_semi")
    files, messages = mine(files_changed), mine(commits)
    similar = similar_comments(
        requests.select(F.col("id").alias("pr_id"), "repo"), train_pool, files_changed, review_comments, history_k)
    cut = {"limit": section_limit, "marker": fixed.SECTION_MARKER, "right_trim": True}
    view = contexts.repo_context(files, fixed.AUGMENTED_REPO_FILES).select(
        "pr_id", text.truncate(text.strip(F.col("repo_context")), **cut).alias("repo_context"))
    rows = (
        requests.select(F.col("id").alias("pr_id"), "repo", "title", "body")
        .join(contexts.diff_text(files, diff_budget, file_limit), "pr_id", "left")
        .join(contexts.commit_text(messages, section_limit), "pr_id", "left")
        .join(view, "pr_id", "left")
        .join(historical_comments(similar, pull_requests, comment_limit), "pr_id", "left")
    )
    if issues is None:
        rows = rows.withColumn("issue_text", F.lit(None).cast("string"))
    else:
        rows = rows.join(linked_issue_text(requests, messages, issues, section_limit).drop("number"), "pr_id", "left")
    description = text.truncate(text.strip(F.coalesce("body", F.lit(""))), **cut)
    return rows.select(
        "pr_id", "repo", "title", F.coalesce("diff", F.lit(contexts.NO_DIFF)).alias("diff"),
        F.nullif(description, F.lit("")).alias("pr_description"),
        F.coalesce("commit_message", F.lit("(no commit messages available)")).alias("commit_message"),
        "repo_context", "issue_text", "historical_comments",
    )
