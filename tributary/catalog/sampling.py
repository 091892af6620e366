"""Queries over sampling and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.catalog.detection import human_sql
from tributary.catalog.features import HUMAN
from tributary.catalog.registry import query
from tributary.operators import features, sampling, splits

SPLIT_SQL = """SELECT *, CASE WHEN rn <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS side
    FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY created_at, pr_id) AS rn,
          count(*) OVER (PARTITION BY repo) AS n FROM {0}) AS r"""
AI = "SELECT id AS pr_id, repo, CAST(is_merged AS BIGINT) AS y, created_at FROM pull_requests WHERE is_ai_authored AND is_merged IS NOT NULL"
SPLIT_STEPS = {"pop": HUMAN, "split": SPLIT_SQL.format("pop")}
AI_SPLIT_STEPS = {"ai_pop": AI, "ai_split": SPLIT_SQL.format("ai_pop")}
CUTOFFS = """SELECT repo, count(*) FILTER (side = 'train') AS n_train, count(*) FILTER (side = 'test') AS n_test,
    max(created_at) FILTER (side = 'train') AS train_max_created_at,
    min(created_at) FILTER (side = 'test') AS test_min_created_at FROM split GROUP BY repo"""
BEST_COMMENT = f"""SELECT pr_id, comment_id, body, CAST(length(body) AS BIGINT) AS chars FROM review_comments
    WHERE length(body) >= 40 AND {human_sql('author_login')}
    QUALIFY row_number() OVER (PARTITION BY pr_id ORDER BY length(body) DESC, comment_id) = 1"""


def split_of(pull_requests):
    return splits.time_split(features.human_closed(pull_requests))


def train_of(pull_requests):
    return split_of(pull_requests).where("side = 'train'")


@query("WIN2_time_split", "pull_requests", steps=SPLIT_STEPS, sql="SELECT pr_id, repo, created_at, y, side FROM split")
def split(pull_requests):
    return split_of(pull_requests).select("pr_id", "repo", "created_at", "y", "side")


@query("WIN2_missing_times", "pull_requests", sql="""
    SELECT id AS pr_id, repo, created_at, CASE WHEN nth <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS side FROM (
        SELECT *, row_number() OVER (PARTITION BY repo ORDER BY created_at NULLS LAST, id) AS nth, count(*) OVER (PARTITION BY repo) AS n
        FROM (SELECT id, CASE WHEN id % 89 <> 0 THEN repo END AS repo, CASE WHEN id % 5 <> 0 THEN created_at END AS created_at FROM pull_requests))
    WHERE repo IS NOT NULL""")
def split_with_missing_times(pull_requests):
    holes = pull_requests.select(F.col("id").alias("pr_id"), F.when(F.col("id") % 89 != 0, F.col("repo")).alias("repo"),
                                 F.when(F.col("id") % 5 != 0, F.col("created_at")).alias("created_at"))
    return splits.time_split(holes)


@query("WIN2_split_cutoffs", "pull_requests", steps={**SPLIT_STEPS, "cut": CUTOFFS}, sql="SELECT * FROM cut")
def cutoffs(pull_requests):
    return splits.split_cutoffs(split_of(pull_requests))


@query("SET1_stacked_parts", "pull_requests", steps=SPLIT_STEPS,
       sql="SELECT 'train' AS part, pr_id, y FROM split WHERE side = 'train' "
           "UNION ALL SELECT 'test', pr_id, y FROM split WHERE side = 'test'")
def stacked(pull_requests):
    return split_of(pull_requests).select(F.col("side").alias("part"), "pr_id", "y")


@query("SET5_split_check", "pull_requests", steps={
    **AI_SPLIT_STEPS,
    "train_ids": "SELECT pr_id FROM ai_split WHERE side = 'train'", "test_ids": "SELECT pr_id FROM ai_split WHERE side = 'test'"},
    sql="""SELECT (SELECT count(*) FROM (SELECT * FROM train_ids INTERSECT SELECT * FROM test_ids) AS b) AS n_on_both_sides,
    (SELECT count(*) FROM (SELECT pr_id FROM ai_pop EXCEPT (SELECT * FROM train_ids UNION SELECT * FROM test_ids)) AS m) AS n_missing,
    (SELECT count(*) FROM ((SELECT * FROM train_ids UNION SELECT * FROM test_ids) EXCEPT SELECT pr_id FROM ai_pop) AS e) AS n_extra""")
def check(pull_requests):
    pool = features.ai_labelled(pull_requests)
    return splits.split_check(splits.time_split(pool), pool)


@query("MLP6_stratified_folds", "pull_requests", steps=SPLIT_STEPS,
       sql="""SELECT pr_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5(concat('42:', pr_id)), pr_id) - 1) % 5 AS INTEGER) AS fold
       FROM split WHERE side = 'train'""")
def folds(pull_requests):
    return splits.stratified_folds(train_of(pull_requests)).select("pr_id", "y", "fold")


@query("SMP1_quota_fill", "pull_requests", steps={
    "priority": """SELECT repo, number, row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, id) AS rn
        FROM pull_requests WHERE is_ai_authored AND state <> 'OPEN'""",
    "taken": "SELECT repo, number, rn FROM priority WHERE rn <= 100",
    "sizes": "SELECT repo, count(*) AS n FROM taken GROUP BY repo",
    "fill": """SELECT p.repo, p.number, row_number() OVER (PARTITION BY p.repo ORDER BY created_at DESC, id) AS rn
        FROM pull_requests p LEFT JOIN taken t ON t.repo = p.repo AND t.number = p.number
        WHERE state <> 'OPEN' AND t.number IS NULL"""},
    sql="""SELECT repo, number, true AS from_priority, rn AS position FROM taken
       UNION ALL SELECT f.repo, f.number, false, f.rn + coalesce(s.n, 0) FROM fill f LEFT JOIN sizes s ON s.repo = f.repo
       WHERE f.rn <= 300 - coalesce(s.n, 0)""")
def quota(pull_requests):
    recent = F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("a"), F.col("id").alias("b"))
    closed = pull_requests.where("state <> 'OPEN'")
    columns = ["repo", "number", recent.alias("ord")]
    return sampling.quota_fill(
        closed.where("is_ai_authored").select(*columns), closed.select(*columns))


@query("SMP2_distinct_in_order", "events", sql_views=[],
       sql="SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def distinct(events):
    return sampling.distinct_in_order(events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


ROUNDS = """SELECT pr_id, repo, row_number() OVER (PARTITION BY repo ORDER BY created_at, pr_id) AS turn
    FROM split WHERE side = 'test'"""


@query("SMP3_rounds", "pull_requests", steps=SPLIT_STEPS, sql=ROUNDS)
def all_rounds(pull_requests):
    return sampling.rounds(split_of(pull_requests).where("side = 'test'")).select("pr_id", "repo", "turn")


@query("SMP3_rounds_prefix", "pull_requests", steps={**SPLIT_STEPS, "r": ROUNDS},
       sql="SELECT * FROM r ORDER BY turn, repo LIMIT 60")
def first_rounds(pull_requests):
    return sampling.rounds(split_of(pull_requests).where("side = 'test'"), limit=60).select("pr_id", "repo", "turn")


@query("SMP4_seeded_sample", "pull_requests", steps={"pop": HUMAN},
       sql="SELECT pr_id, repo, y FROM pop ORDER BY md5(concat('42:', pr_id)), pr_id LIMIT 100")
def sample(pull_requests):
    return sampling.seeded_sample(features.human_closed(pull_requests), 100, "pr_id").select("pr_id", "repo", "y")


DRAWN = """SELECT pr_id, repo, y, row_number() OVER (PARTITION BY y ORDER BY md5(concat('42:', pr_id)), pr_id) AS turn
    FROM split WHERE side = 'train'"""


@query("SMP5_balanced_sample", "pull_requests", steps={**SPLIT_STEPS, "d": DRAWN},
       sql="""SELECT pr_id, repo, y, row_number() OVER (ORDER BY turn, y DESC) AS position FROM d
       WHERE turn <= CASE WHEN y = 1 THEN 4 ELSE 3 END""")
def balanced(pull_requests):
    return sampling.balanced_sample(train_of(pull_requests), 7).select("pr_id", "repo", "y", "position")


@query("SMP5_unbalanced_sample", "pull_requests", steps=SPLIT_STEPS,
       sql="""SELECT pr_id, repo, y, row_number() OVER (ORDER BY md5(concat('42:', pr_id)), pr_id) AS position
       FROM split WHERE side = 'train' QUALIFY position <= 7""")
def unbalanced(pull_requests):
    return sampling.balanced_sample(train_of(pull_requests), 7, balanced=False).select("pr_id", "repo", "y", "position")


@query("SMP6_comment_sample", "pull_requests", "review_comments", steps={**SPLIT_STEPS, "best": BEST_COMMENT},
       sql=r"""SELECT pr_id, repo, comment_id, row_number() OVER (ORDER BY md5(concat('42:', pr_id)), pr_id) AS position,
       CASE WHEN length(regexp_replace(body, '^\s+|\s+$', '', 'g')) > 600
            THEN concat(regexp_replace(substr(regexp_replace(body, '^\s+|\s+$', '', 'g'), 1, 600), '\s+$', ''), ' ...')
            ELSE regexp_replace(body, '^\s+|\s+$', '', 'g') END AS target_comment
       FROM split JOIN best USING (pr_id) WHERE side = 'train' QUALIFY position <= 20""")
def comments(pull_requests, review_comments):
    return sampling.comment_sample(train_of(pull_requests), review_comments, 20)


@query("WIN4_longest_comment", "review_comments", steps={"best": BEST_COMMENT}, sql="SELECT * FROM best")
def longest(review_comments):
    return sampling.longest_human_comment(review_comments)
