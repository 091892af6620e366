"""The whole statistics document as one long table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators import stats
from tributary.operators.ordering import POOLED, distribution
from tributary.session import cut_lineage

NUMBERS = ("review_comment_count", "reviewer_count", "pr_length")
FLAGS = ("is_merged", "is_ai_authored", "is_ai_reviewed")


def _long(metric: str, wide: DataFrame) -> DataFrame:
    """``metric, repo, stat, value`` rows of a table with one row per repository."""
    columns = [c for c in wide.columns if c != "repo"]
    pairs = F.array(
        *[F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    return wide.select(F.lit(metric).alias("metric"), "repo", F.explode(pairs).alias("_p")).select(
        "metric", "repo", "_p.stat", "_p.value"
    )


def value_table(pull_requests: DataFrame, reviews: DataFrame, review_comments: DataFrame) -> DataFrame:
    """``metric, repo, value, label, n``: how often each value of each metric occurs, per repository and pooled.

    Every statistic of the document follows from these counts, and counts of parts of the data add up.  Each request gives one row for each
    metric: its numbers, its state (a bit for each flag) and its labels; so the tables are read once, and shuffled once as counts.
    """
    comments = review_comments.groupBy(F.col("pr_id").alias("id")).agg(F.count(F.lit(1)).alias("review_comment_count"))
    reviewers = reviews.groupBy(F.col("pr_id").alias("id")).agg(F.count_distinct("reviewer_login").alias("reviewer_count"))
    zero = F.lit(0).cast("long")
    state = sum((F.when(F.col(flag), 1 << i).otherwise(0) for i, flag in enumerate(FLAGS)), F.lit(0))
    per_pr = pull_requests.select(
        "id", "repo", "labels", state.cast("long").alias("state"), (F.coalesce("additions", zero) + F.coalesce("deletions", zero)).alias("pr_length")
    ).join(comments, "id", "left").join(reviewers, "id", "left").fillna(0, ["review_comment_count", "reviewer_count"])

    def value(metric: str, number, label) -> Column:
        return F.struct(F.lit(metric).alias("metric"), number.cast("long").alias("value"), label.cast("string").alias("label"))

    numbers = F.array(*[value(metric, F.col(metric), F.lit(None)) for metric in (*NUMBERS, "state")])
    labels = F.transform(F.filter("labels", lambda x: x != ""), lambda x: value("labels", F.lit(None), x))
    counts = per_pr.select("repo", F.explode(F.concat(numbers, F.coalesce(labels, F.filter(numbers, lambda x: F.lit(False))))).alias("v")).groupBy(
        "v.metric", "repo", "v.value", "v.label").agg(F.count(F.lit(1)).alias("n"))
    both = counts.withColumn("repo", F.explode(F.array("repo", F.lit(POOLED))))
    return cut_lineage(both.groupBy("metric", "repo", "value", "label").agg(F.sum("n").alias("n")))


def summary_document(
    pull_requests: DataFrame, reviews: DataFrame, review_comments: DataFrame
) -> DataFrame:
    """Every statistic of the dataset as ``metric, repo, stat, value``, all from one table of value counts."""
    counts = value_table(pull_requests, reviews, review_comments)
    described = distribution(counts.where(F.col("metric").isin(*NUMBERS)), ["metric", "repo"], "value")
    stat_columns = [c for c in described.columns if c not in ("metric", "repo")]
    pairs = F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("value")) for c in stat_columns])
    distributions = described.select("metric", "repo", F.explode(pairs).alias("_p")).select("metric", "repo", "_p.stat", "_p.value")
    labels = stats.most_frequent(counts.where("metric = 'labels'")).select(
        F.lit("labels").alias("metric"), "repo", F.col("label").alias("stat"), F.col("n").cast("double").alias("value"))
    merged, ai, reviewed = ((F.col("value").bitwiseAND(1 << i) > 0) for i in range(len(FLAGS)))

    def number(condition) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    sums = counts.where("metric = 'state'").groupBy("repo").agg(
        F.sum("n").alias("total"), F.sum("n").alias("n_prs"), number(merged).alias("merged"), number(ai).alias("ai_authored"), number(reviewed).alias("ai_reviewed"),
        number(ai).alias("n_ai"), number(ai & merged).alias("merged_ai"), number(~ai).alias("n_human"), number(~ai & merged).alias("merged_human"))
    parts = [
        _long("dataset", sums.select("repo", "n_prs")), _long("merge_status", stats.merge_status_of(sums)), distributions, labels,
        _long("ai_vs_human", stats.authorship_mix_of(sums)), _long("ai_reviewer_presence", stats.ai_review_presence_of(sums)),
        _long("merge_rate_by_authorship", stats.merge_rate_by_authorship_of(sums)),
    ]
    return reduce(DataFrame.unionByName, parts)
