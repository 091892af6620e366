"""Per-repository and pooled statistics of pull requests.

Additive counts are summed per repository first; the pooled row is built from
those sums, so the input is read and shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators.ordering import POOLED, distribution, quantiles, value_counts, with_pool
from tributary.session import cut_lineage


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """``part / whole`` rounded, null when the whole is 0."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def pooled_sums(frame: DataFrame, key: str, **sums: Column) -> DataFrame:
    """Sums per group and over all groups."""
    per_group = frame.groupBy(key).agg(*[F.sum(c).cast("long").alias(n) for n, c in sums.items()])
    both = per_group.withColumn(key, F.explode(F.array(F.col(key), F.lit(POOLED))))
    return both.groupBy(key).agg(*[F.sum(n).alias(n) for n in sums])


def _as_int(flag: Column) -> Column:
    return F.when(flag, 1).otherwise(0)


def merge_status(pull_requests: DataFrame) -> DataFrame:
    """Merged, not merged, total and merge rate."""
    return merge_status_of(pooled_sums(pull_requests, "repo", merged=_as_int(F.col("is_merged")), total=F.lit(1)))


def merge_status_of(sums: DataFrame) -> DataFrame:
    return sums.select(
        "repo",
        "merged",
        (F.col("total") - F.col("merged")).alias("not_merged"),
        "total",
        share(F.col("merged"), F.col("total")).alias("merge_rate"),
    )


def authorship_mix(pull_requests: DataFrame) -> DataFrame:
    """AI-authored and human-authored counts and the AI share."""
    return authorship_mix_of(pooled_sums(pull_requests, "repo", ai_authored=_as_int(F.col("is_ai_authored")), total=F.lit(1)))


def authorship_mix_of(sums: DataFrame) -> DataFrame:
    return sums.select(
        "repo",
        "ai_authored",
        (F.col("total") - F.col("ai_authored")).alias("human_authored"),
        "total",
        share(F.col("ai_authored"), F.col("total")).alias("ai_share"),
    )


def ai_review_presence(pull_requests: DataFrame) -> DataFrame:
    """Pull requests with and without an AI reviewer."""
    return ai_review_presence_of(pooled_sums(pull_requests, "repo", ai_reviewed=_as_int(F.col("is_ai_reviewed")), total=F.lit(1)))


def ai_review_presence_of(sums: DataFrame) -> DataFrame:
    return sums.select(
        "repo",
        "ai_reviewed",
        (F.col("total") - F.col("ai_reviewed")).alias("not_ai_reviewed"),
        "total",
        share(F.col("ai_reviewed"), F.col("total")).alias("share"),
    )


def merge_rate_by_authorship(pull_requests: DataFrame) -> DataFrame:
    """Size and merge rate of the AI-authored and the human-authored group; an empty group has no rate."""
    ai, merged = F.col("is_ai_authored"), F.col("is_merged")
    return merge_rate_by_authorship_of(pooled_sums(
        pull_requests, "repo",
        n_ai=_as_int(ai), merged_ai=_as_int(ai & merged),
        n_human=_as_int(~ai), merged_human=_as_int(~ai & merged),
    ))


def merge_rate_by_authorship_of(sums: DataFrame) -> DataFrame:
    return sums.select(
        "repo",
        "n_ai",
        share(F.col("merged_ai"), F.col("n_ai")).alias("merge_rate_ai"),
        "n_human",
        share(F.col("merged_human"), F.col("n_human")).alias("merge_rate_human"),
    )


def pr_length(pull_requests: DataFrame) -> DataFrame:
    """``id, repo, pr_length``: added plus deleted lines, missing counts as 0."""
    zero = F.lit(0).cast("long")
    return pull_requests.select(
        "id", "repo", (F.coalesce("additions", zero) + F.coalesce("deletions", zero)).alias("pr_length")
    )


def review_comments_per_pr(pull_requests: DataFrame, review_comments: DataFrame) -> DataFrame:
    """``id, repo, n_review_comments``, 0 for pull requests without comments."""
    counts = review_comments.groupBy(F.col("pr_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_review_comments")
    )
    return pull_requests.select("id", "repo").join(counts, "id", "left").fillna(0, ["n_review_comments"])


def reviewers_per_pr(pull_requests: DataFrame, reviews: DataFrame) -> DataFrame:
    """``id, repo, n_reviewers``: distinct non-null reviewer logins."""
    counts = reviews.groupBy(F.col("pr_id").alias("id")).agg(
        F.count_distinct("reviewer_login").alias("n_reviewers")
    )
    return pull_requests.select("id", "repo").join(counts, "id", "left").fillna(0, ["n_reviewers"])


def describe_by_repo(per_pr: DataFrame, value: str) -> DataFrame:
    """Distribution of a per-request value, per repository and pooled."""
    return distribution(pooled_value_counts(per_pr, value), ["repo"], value)


def pooled_value_counts(per_pr: DataFrame, value: str) -> DataFrame:
    """``repo, value, n``, per repository and pooled, written once: several branches read it, the input is read for it alone."""
    return cut_lineage(with_pool(value_counts(per_pr, ["repo"], value), "repo", value))


def clipped_histogram(
    per_pr: DataFrame, value: str, bins: int = 30, clip_at: float = 0.98
) -> DataFrame:
    """Counts in equal bins over each panel's own range, after clipping at the pooled quantile.

    One panel per repository and one pooled.  The clip is never below 1; the last
    bin includes its upper edge; a panel with a single value spreads half a unit
    to each side.  Empty bins are left out.
    """
    both = pooled_value_counts(per_pr, value)
    clip = quantiles(both.where(F.col("repo") == POOLED), ["repo"], value, {"q": clip_at}).select(
        F.greatest(F.col("q"), F.lit(1.0)).alias("clip")
    )
    clipped = both.select("repo", F.least(F.col(value).cast("double"), clip.scalar()).alias("v"), "n")
    edges = clipped.groupBy("repo").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    edges = edges.select(
        "repo",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    position = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    return (
        clipped.join(edges, "repo")
        .withColumn("bin", F.least(position, F.lit(bins - 1)).cast("long"))
        .groupBy("repo", "bin")
        .agg(F.sum("n").alias("n"))
    )


def dataset_header(pull_requests: DataFrame) -> DataFrame:
    """Pull requests per repository and in total."""
    return pooled_sums(pull_requests, "repo", n_prs=F.lit(1))


def label_counts(pull_requests: DataFrame) -> DataFrame:
    """``repo, label, n`` over non-empty labels, per repository and pooled."""
    exploded = pull_requests.select("repo", F.explode("labels").alias("label")).where(F.col("label") != "")
    return with_pool(value_counts(exploded, ["repo"], "label"), "repo", "label")


def top_labels(pull_requests: DataFrame, pooled_k: int = 20, repo_k: int = 8) -> DataFrame:
    """Most frequent labels, ties broken by label text, with rank."""
    return most_frequent(label_counts(pull_requests), pooled_k, repo_k)


def most_frequent(counts: DataFrame, pooled_k: int = 20, repo_k: int = 8) -> DataFrame:
    """The first labels of ``repo, label, n`` in each repository, with rank."""
    by_count = Window.partitionBy("repo").orderBy(F.desc("n"), "label")
    limit = max(pooled_k, repo_k)
    ranked = counts.withColumn("rank", F.row_number().over(by_count).cast("long"))
    return ranked.where(F.col("rank") <= limit).where(
        F.col("rank") <= F.when(F.col("repo") == POOLED, pooled_k).otherwise(repo_k)
    )


def labelled_totals(pull_requests: DataFrame) -> DataFrame:
    """Pull requests that carry at least one label, and all of them."""
    return pull_requests.agg(
        F.count_if(F.size("labels") > 0).alias("total_labeled_prs"),
        F.count(F.lit(1)).alias("total_prs"),
    )


def detection_mix(signals: DataFrame) -> DataFrame:
    """Flagged pull requests by kind, method and confidence, with their share of all flagged."""
    flagged = signals.where("is_ai_authored")
    counts = flagged.groupBy("ai_authored_kind", "ai_authored_method", "ai_authored_confidence").agg(
        F.count(F.lit(1)).alias("n")
    )
    total = counts.agg(F.sum("n").alias("total"))
    return counts.select(
        "ai_authored_kind", "ai_authored_method", "ai_authored_confidence", "n",
        share(F.col("n"), total.scalar()).alias("share"),
    )
