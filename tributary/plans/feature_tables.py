"""From the relational tables to the three feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.fixed_values import CARRIER_COLUMNS, STRUCTURE_COLUMNS
from tributary.operators import features
from tributary.operators.structure import file_structure, structure_columns


def assemble_features(
    pull_requests: DataFrame,
    files_changed: DataFrame,
    commits: DataFrame,
    reviews: DataFrame,
    review_comments: DataFrame,
    issue_comments: DataFrame,
) -> DataFrame:
    """All feature columns of the human-written, closed pull requests; cut with ``features.variant``.

    The pull requests are read once for all their own columns.  Each child table
    is reduced to one row per ``pr_id`` before it is joined: patches and texts
    turn into counts in the scan, so no text is shuffled.
    """
    population = features.human_closed(pull_requests)
    own = pull_requests.where(features.is_human_closed()).select(
        F.col("id").alias("pr_id"), F.col("is_merged").cast("long").alias("y"), "created_at", "repo",
        *features.own_modification_columns(), *features.own_text_columns(), *features.own_process_columns(),
    )
    per_file = file_structure(files_changed).groupBy("pr_id").agg(
        *features.file_count_columns(F.col("n_markers")), *structure_columns()
    )
    return (
        own.join(per_file, "pr_id", "left")
        .join(commits.groupBy("pr_id").agg(*features.commit_columns()), "pr_id", "left")
        .join(reviews.groupBy("pr_id").agg(*features.review_columns()), "pr_id", "left")
        .join(features.count_by_pr(review_comments, "p_num_review_comments"), "pr_id", "left")
        .join(features.count_by_pr(issue_comments, "p_num_issue_comments"), "pr_id", "left")
        .join(features.author_history(population, pull_requests), "pr_id", "left")
        .fillna(0, [
            *features.FILE_COUNTS, *STRUCTURE_COLUMNS, "m_num_commits", *features.REVIEW_COUNTS,
            "p_num_review_comments", "p_num_issue_comments",
        ])
        .fillna(0.0, features.MESSAGE_LENGTHS)
    )


def feature_table(full: DataFrame, name: str) -> DataFrame:
    """One of the three variants."""
    assert set(CARRIER_COLUMNS) <= set(full.columns)
    return features.variant(full, name)
