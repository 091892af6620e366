"""Queries over the statistics operators."""

from __future__ import annotations

from tributary.catalog.registry import query
from tributary.operators import stats
from tributary.operators.ordering import POOLED
from tributary.plans.summary import summary_document

SCOPED = f"SELECT * FROM pull_requests UNION ALL SELECT * REPLACE ('{POOLED}' AS repo) FROM pull_requests"

MERGE_STATUS = """SELECT repo, CAST(count(*) FILTER (is_merged) AS BIGINT) AS merged,
    CAST(count(*) FILTER (NOT is_merged) AS BIGINT) AS not_merged, count(*) AS total,
    round(count(*) FILTER (is_merged) / count(*), 4) AS merge_rate FROM scoped GROUP BY repo"""
AUTHORSHIP = """SELECT repo, count(*) FILTER (is_ai_authored) AS ai_authored,
    count(*) FILTER (NOT is_ai_authored) AS human_authored, count(*) AS total,
    round(count(*) FILTER (is_ai_authored) / count(*), 4) AS ai_share FROM scoped GROUP BY repo"""
AI_REVIEW = """SELECT repo, count(*) FILTER (is_ai_reviewed) AS ai_reviewed,
    count(*) FILTER (NOT is_ai_reviewed) AS not_ai_reviewed, count(*) AS total,
    round(count(*) FILTER (is_ai_reviewed) / count(*), 4) AS share FROM scoped GROUP BY repo"""
RATE_BY_AUTHORSHIP = """SELECT repo, count(*) FILTER (is_ai_authored) AS n_ai,
    round(avg(CASE WHEN is_merged THEN 1.0 ELSE 0.0 END) FILTER (is_ai_authored), 4) AS merge_rate_ai,
    count(*) FILTER (NOT is_ai_authored) AS n_human,
    round(avg(CASE WHEN is_merged THEN 1.0 ELSE 0.0 END) FILTER (NOT is_ai_authored), 4) AS merge_rate_human
    FROM scoped GROUP BY repo"""


def describe_sql(values: str) -> str:
    """Distribution of ``value`` per repo of the step named ``values``."""
    return f"""SELECT repo, count(*) AS n, round(avg(value), 3) AS mean, round(CAST(median(value) AS DOUBLE), 6) AS median,
        round(coalesce(stddev_samp(value), 0), 3) AS std, CAST(min(value) AS DOUBLE) AS min,
        CAST(max(value) AS DOUBLE) AS max, round(quantile_cont(CAST(value AS DOUBLE), 0.9), 6) AS p90,
        round(quantile_cont(CAST(value AS DOUBLE), 0.99), 6) AS p99, count(*) FILTER (value = 0) AS zero_count
        FROM {values} GROUP BY repo"""


COMMENT_VALUES = """SELECT p.repo, coalesce(c.n, 0) AS value FROM scoped p
    LEFT JOIN (SELECT pr_id, count(*) AS n FROM review_comments GROUP BY pr_id) c ON c.pr_id = p.id"""
REVIEWER_VALUES = """SELECT p.repo, coalesce(c.n, 0) AS value FROM scoped p
    LEFT JOIN (SELECT pr_id, count(DISTINCT reviewer_login) AS n FROM reviews GROUP BY pr_id) c ON c.pr_id = p.id"""
LENGTH_VALUES = "SELECT repo, coalesce(additions, 0) + coalesce(deletions, 0) AS value FROM scoped"
TOP_LABELS = f"""SELECT * FROM (
    SELECT repo, label, count(*) AS n, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, label) AS rank
    FROM (SELECT repo, unnest(labels) AS label FROM scoped) AS l WHERE label <> '' GROUP BY repo, label) AS r
    WHERE rank <= CASE WHEN repo = '{POOLED}' THEN 20 ELSE 8 END"""
HEADER = "SELECT repo, count(*) AS n_prs FROM scoped GROUP BY repo"
STEPS = {"scoped": SCOPED}

query("AGG1_merge_status", "pull_requests", steps=STEPS, sql=MERGE_STATUS)(stats.merge_status)
query("AGG2_authorship_mix", "pull_requests", steps=STEPS, sql=AUTHORSHIP)(stats.authorship_mix)
query("AGG3_ai_review_presence", "pull_requests", steps=STEPS, sql=AI_REVIEW)(stats.ai_review_presence)
query("AGG4_merge_rate_by_authorship", "pull_requests", steps=STEPS, sql=RATE_BY_AUTHORSHIP)(
    stats.merge_rate_by_authorship
)
query("AGG27_dataset_header", "pull_requests", steps=STEPS, sql=HEADER)(stats.dataset_header)
query("TOP1_label_frequency", "pull_requests", steps=STEPS, sql=TOP_LABELS)(stats.top_labels)


@query(
    "TOP1_labelled_totals", "pull_requests",
    sql="SELECT count(*) FILTER (len(labels) > 0) AS total_labeled_prs, count(*) AS total_prs FROM pull_requests",
)
def labelled(pull_requests):
    return stats.labelled_totals(pull_requests)


@query(
    "AGG5_distribution_of_file_churn", "files_changed",
    steps={"v": f"SELECT status AS repo, additions AS value FROM files_changed WHERE additions IS NOT NULL "
                f"UNION ALL SELECT '{POOLED}', additions FROM files_changed WHERE additions IS NOT NULL"},
    sql=describe_sql("v"),
)
def file_churn(files_changed):
    return stats.describe_by_repo(files_changed.withColumnRenamed("status", "repo"), "additions")


@query(
    "AGG6_review_comments_per_pr", "pull_requests", "review_comments",
    steps={**STEPS, "v": COMMENT_VALUES}, sql=describe_sql("v"),
)
def comments_per_pr(pull_requests, review_comments):
    return stats.describe_by_repo(
        stats.review_comments_per_pr(pull_requests, review_comments), "n_review_comments"
    )


@query(
    "AGG7_reviewers_per_pr", "pull_requests", "reviews",
    steps={**STEPS, "v": REVIEWER_VALUES}, sql=describe_sql("v"),
)
def reviewers_per_pr(pull_requests, reviews):
    return stats.describe_by_repo(stats.reviewers_per_pr(pull_requests, reviews), "n_reviewers")


@query(
    "JOI2_zero_filled_counts", "pull_requests", "review_comments",
    sql="""SELECT p.id, p.repo, coalesce(c.n, 0) AS n_review_comments FROM pull_requests p
           LEFT JOIN (SELECT pr_id, count(*) AS n FROM review_comments GROUP BY pr_id) c ON c.pr_id = p.id""",
)
def zero_filled(pull_requests, review_comments):
    return stats.review_comments_per_pr(pull_requests, review_comments)


@query("AGG11_pr_length", "pull_requests", steps={**STEPS, "v": LENGTH_VALUES}, sql=describe_sql("v"))
def length_distribution(pull_requests):
    return stats.describe_by_repo(stats.pr_length(pull_requests), "pr_length")


@query(
    "AGG26_clipped_histogram", "pull_requests",
    steps={
        **STEPS,
        "v": LENGTH_VALUES,
        "c": f"SELECT greatest(quantile_cont(CAST(value AS DOUBLE), 0.98), 1.0) AS clip FROM v WHERE repo = '{POOLED}'",
        "w": "SELECT repo, least(CAST(value AS DOUBLE), (SELECT clip FROM c)) AS value FROM v",
        "e": "SELECT repo, min(value) AS lo, max(value) AS hi FROM w GROUP BY repo",
    },
    sql="""SELECT repo, CAST(least(floor((value - lo) / (hi - lo) * 30), 29) AS BIGINT) AS bin, count(*) AS n
           FROM w JOIN (SELECT repo, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo,
                        CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM e) AS b USING (repo) GROUP BY 1, 2""",
)
def histogram(pull_requests):
    return stats.clipped_histogram(stats.pr_length(pull_requests), "pr_length")


def _long_sql(metric: str, columns: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{metric}' AS metric, repo, '{c}' AS stat, CAST({c} AS DOUBLE) AS value FROM {source}" for c in columns
    )


DESCRIBED = ["n", "mean", "median", "std", "min", "max", "p90", "p99", "zero_count"]


@query(
    "AGG28_summary_document", "pull_requests", "reviews", "review_comments",
    steps={
        **STEPS,
        "vc": COMMENT_VALUES, "vr": REVIEWER_VALUES, "vl": LENGTH_VALUES,
        "s_header": HEADER, "s_merge": MERGE_STATUS, "s_ai": AUTHORSHIP, "s_rev": AI_REVIEW,
        "s_rate": RATE_BY_AUTHORSHIP, "s_labels": TOP_LABELS,
        "d_comments": describe_sql("vc"), "d_reviewers": describe_sql("vr"), "d_length": describe_sql("vl"),
    },
    sql=" UNION ALL ".join([
        _long_sql("dataset", ["n_prs"], "s_header"),
        _long_sql("merge_status", ["merged", "not_merged", "total", "merge_rate"], "s_merge"),
        _long_sql("review_comment_count", DESCRIBED, "d_comments"),
        _long_sql("reviewer_count", DESCRIBED, "d_reviewers"),
        _long_sql("pr_length", DESCRIBED, "d_length"),
        "SELECT 'labels', repo, label, CAST(n AS DOUBLE) FROM s_labels",
        _long_sql("ai_vs_human", ["ai_authored", "human_authored", "total", "ai_share"], "s_ai"),
        _long_sql("ai_reviewer_presence", ["ai_reviewed", "not_ai_reviewed", "total", "share"], "s_rev"),
        _long_sql("merge_rate_by_authorship", ["n_ai", "merge_rate_ai", "n_human", "merge_rate_human"], "s_rate"),
    ]),
)
def document(pull_requests, reviews, review_comments):
    return summary_document(pull_requests, reviews, review_comments)
