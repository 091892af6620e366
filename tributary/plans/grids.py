"""The prompt grids: contexts, demonstrations, one prompt per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary import fixed_values as fixed
from tributary.functions.text import class_label
from tributary.operators import contexts, prompts
from tributary.operators.sampling import balanced_sample, comment_sample
from tributary.plans.augmented import augmented_context
from tributary.session import cut_lineage


def demonstration_rows(
    train_pool: DataFrame, review_comments: DataFrame, k: int = fixed.DEMO_COUNT, seed: int = fixed.SEED
) -> DataFrame:
    """``task, pr_id, repo, position, target``: k demonstrations per task, from the training side only."""
    merge = balanced_sample(train_pool.select("pr_id", "repo", "y"), k, seed=seed).select(
        F.lit("merge_prediction").alias("task"), "pr_id", "repo", "position", class_label(F.col("y")).alias("target"))
    review = comment_sample(train_pool.select("pr_id", "repo"), review_comments, k, seed).select(
        F.lit("review_comment").alias("task"), "pr_id", "repo", "position", F.col("target_comment").alias("target"))
    return merge.unionByName(review)


def _demonstrations(rows: DataFrame, texts: DataFrame) -> DataFrame:
    return prompts.demonstration_blocks(rows.select("task", "pr_id", "position", "target").join(
        texts.select("pr_id", "context_kind", "context_text"), "pr_id"))


def _only(table: DataFrame, ids: DataFrame, key: str = "pr_id") -> DataFrame:
    return table.join(ids.select(F.col("pr_id").alias(key)), key, "left_semi")


def prompt_grid(
    queries: DataFrame, train_pool: DataFrame, pull_requests: DataFrame, files_changed: DataFrame,
    commits: DataFrame, review_comments: DataFrame, k: int = fixed.DEMO_COUNT, context_limit: int | None = None,
    budget: int = fixed.DIFF_BUDGET,
) -> DataFrame:
    """One prompt per (request, context kind, task, strategy).

    The parts of the queries and of the demonstrations come from one pass over the
    tables, restricted to those requests.
    """
    demos = cut_lineage(demonstration_rows(train_pool, review_comments, k))
    ids = cut_lineage(queries.select("pr_id").unionByName(demos.select("pr_id")).distinct())
    parts = cut_lineage(contexts.context_parts(
        _only(pull_requests, ids, "id"), _only(files_changed, ids), _only(commits, ids), budget))
    shown = contexts.context_kinds(_only(parts, demos), context_limit)
    asked = contexts.context_kinds(_only(parts, queries), context_limit)
    cells = prompts.grid_cells(asked, fixed.TASKS, fixed.STRATEGIES)
    return prompts.single_prompts(
        prompts.require_demonstrations(prompts.with_demonstrations(cells, _demonstrations(demos, shown))))


def tier_grid(
    queries: DataFrame, train_pool: DataFrame, pull_requests: DataFrame, files_changed: DataFrame,
    commits: DataFrame, review_comments: DataFrame, issues: DataFrame | None = None, k: int = fixed.DEMO_COUNT,
) -> DataFrame:
    """One conversation per (request, tier, task, strategy); demonstrations never look up issues."""
    demos = cut_lineage(demonstration_rows(train_pool, review_comments, k))
    ids = cut_lineage(queries.select("pr_id").unionByName(demos.select("pr_id")).distinct())
    rows = cut_lineage(augmented_context(
        ids, pull_requests, files_changed, commits, review_comments, train_pool.select("pr_id", "repo"), issues))
    shown = contexts.tier_contexts(_only(rows, demos).withColumn("issue_text", F.lit(None).cast("string")))
    cells = prompts.grid_cells(contexts.tier_contexts(_only(rows, queries)), fixed.TASKS, fixed.AUGMENTED_STRATEGIES)
    return prompts.conversations(
        prompts.require_demonstrations(prompts.with_demonstrations(cells, _demonstrations(demos, shown))))
