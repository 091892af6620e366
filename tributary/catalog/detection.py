"""Queries over account classification and AI detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary import fixed_values as fixed
from tributary.catalog.registry import query
from tributary.functions import actors
from tributary.operators import detection, sampling, stats


def listed(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


AGENTS, BOTS, AUTOMATION = (
    listed(fixed.CODING_AGENT_LOGINS), listed(fixed.REVIEW_BOT_LOGINS), listed(fixed.AUTOMATION_LOGINS))


def norm_sql(column: str) -> str:
    return f"regexp_replace(lower(trim(coalesce({column}, ''))), '\\[bot\\]$', '')"


def email_sql(column: str) -> str:
    pattern = r"(?i)^(?:\d+\+)?([^@]+)@users\.noreply\.github\.com$"
    return norm_sql(f"regexp_extract(trim(coalesce({column}, '')), '{pattern}', 1)")


def human_sql(column: str, pattern: str = r"\[bot\]|-bot$|^bot-") -> str:
    name = f"lower(coalesce({column}, ''))"
    return f"({name} NOT IN {listed(fixed.NON_HUMAN_COMMENT_AUTHORS)} AND NOT regexp_matches({name}, '{pattern}'))"


def actor_sql(login: str, kind: str, source: str) -> str:
    return f"""SELECT *, CASE WHEN nm = '' AND coalesce({kind}, '') = '' THEN 'unknown'
        WHEN nm IN {AGENTS} THEN 'ai_coding_agent' WHEN nm IN {BOTS} THEN 'ai_review_bot'
        WHEN {kind} = 'Bot' THEN 'other_bot' WHEN {kind} = 'User' THEN 'human' ELSE 'unknown' END AS category,
        CASE WHEN nm = '' AND coalesce({kind}, '') = '' THEN 'no_actor'
        WHEN nm IN {AGENTS} THEN CASE WHEN {kind} = 'Bot' THEN 'allowlist_coding_agent+bot' ELSE 'allowlist_coding_agent+user' END
        WHEN nm IN {BOTS} THEN CASE WHEN {kind} = 'Bot' THEN 'allowlist_review_bot+bot' ELSE 'allowlist_review_bot+user' END
        WHEN {kind} = 'Bot' THEN CASE WHEN nm IN {AUTOMATION} THEN 'typename_bot_known_automation' ELSE 'typename_bot_other' END
        WHEN {kind} = 'User' THEN 'typename_user' ELSE 'no_typename' END AS method,
        CAST(CASE WHEN nm = '' AND coalesce({kind}, '') = '' THEN 0.0
        WHEN nm IN {AGENTS} OR nm IN {BOTS} THEN CASE WHEN {kind} = 'Bot' THEN 0.95 ELSE 0.9 END
        WHEN {kind} = 'Bot' THEN 0.95 WHEN {kind} = 'User' THEN 0.9 ELSE 0.0 END AS DOUBLE) AS confidence
        FROM (SELECT *, {norm_sql(login)} AS nm FROM {source}) AS src"""


EVIDENCE_STEPS = {
    "named": f"""SELECT pr_id, commit_ord, sha, message,
        CASE WHEN {norm_sql('author_login')} IN {AGENTS} THEN {norm_sql('author_login')}
             WHEN {norm_sql('author_name')} IN {AGENTS} THEN {norm_sql('author_name')}
             WHEN {email_sql('author_email')} IN {AGENTS} THEN {email_sql('author_email')} END AS agent FROM commits""",
    "first_hit": "SELECT * FROM named WHERE agent IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pr_id ORDER BY commit_ord) = 1",
    "plans": "SELECT pr_id FROM named WHERE commit_ord = 0 AND starts_with(lower(trim(coalesce(message, ''))), 'initial plan')",
    "evidence": """SELECT pr_id, 'commit_agent_identity' AS method, CAST(0.8 AS DOUBLE) AS confidence, agent AS login,
        concat('commit ', left(sha, 10), ' authored by agent identity ''', agent, '''') AS evidence FROM first_hit
        UNION ALL SELECT pr_id, 'commit_initial_plan', 0.7, 'copilot-swe-agent',
        'first commit message is Copilot''s ''Initial plan'' placeholder' FROM plans WHERE pr_id NOT IN (SELECT pr_id FROM first_hit)""",
    "actors": actor_sql("author_login", "author_type", "pull_requests"),
    "author_verdict": """SELECT a.id AS pr_id, a.author_login, a.author_type, a.category AS author_category,
        a.category = 'ai_coding_agent' OR (a.category IN ('human', 'unknown') AND e.method IS NOT NULL) AS is_ai_authored,
        CASE WHEN a.category = 'ai_coding_agent' THEN 'agent_authored'
             WHEN a.category IN ('human', 'unknown') AND e.method IS NOT NULL THEN 'human_opened_ai_assisted' END AS ai_authored_kind,
        CASE WHEN a.category IN ('human', 'unknown') THEN coalesce(e.method, a.method) ELSE a.method END AS ai_authored_method,
        CASE WHEN a.category IN ('human', 'unknown') THEN coalesce(e.confidence, a.confidence) ELSE a.confidence END AS ai_authored_confidence,
        CASE WHEN a.category = 'ai_coding_agent' THEN concat('PR author ''', a.author_login, ''' is an allowlisted coding agent')
             WHEN a.category IN ('human', 'unknown') THEN e.evidence END AS ai_authored_evidence
        FROM actors a LEFT JOIN evidence e ON e.pr_id = a.id""",
}
REVIEWER_STEPS = {
    "seen": """SELECT pr_id, reviewer_login AS login, 'review' AS source FROM reviews
        UNION ALL SELECT pr_id, author_login, 'review_comment' FROM review_comments
        UNION ALL SELECT pr_id, author_login, 'issue_comment' FROM issue_comments""",
    "reviewers": f"""SELECT pr_id, string_agg(DISTINCT login, ',' ORDER BY login) AS logins, count(DISTINCT login) AS n,
        string_agg(DISTINCT source, ',' ORDER BY source) AS sources
        FROM seen WHERE {norm_sql('login')} IN {BOTS} GROUP BY pr_id""",
}
VERDICT_STEPS = {
    **EVIDENCE_STEPS, **REVIEWER_STEPS,
    "verdict": """SELECT v.*, coalesce(r.n, 0) > 0 AS is_ai_reviewed, coalesce(r.logins, '') AS ai_reviewer_logins_str,
        coalesce(r.sources, '') AS ai_reviewer_sources, coalesce(r.n, 0) AS n_ai_reviewers
        FROM author_verdict v LEFT JOIN reviewers r USING (pr_id)""",
}


@query("DET1_normalize_login", "commits",
       sql=f"SELECT author_name, author_login, {norm_sql('author_name')} AS name, {norm_sql('author_login')} AS login, "
           "count(*) AS n FROM commits GROUP BY ALL")
def normalized(commits):
    return commits.groupBy(
        "author_name", "author_login", actors.normalize_login(F.col("author_name")).alias("name"),
        actors.normalize_login(F.col("author_login")).alias("login")).agg(F.count(F.lit(1)).alias("n"))


@query("DET2_classify_actor", "pull_requests",
       steps={"actors": actor_sql("author_login", "author_type", "pull_requests")},
       sql="SELECT author_login, author_type, category, confidence, method, count(*) AS n FROM actors GROUP BY ALL")
def classified(pull_requests):
    actor = actors.classify_actor(F.col("author_login"), F.col("author_type"))
    return pull_requests.groupBy("author_login", "author_type").agg(F.count(F.lit(1)).alias("n")).select(
        "author_login", "author_type", "n", actor["category"].alias("category"),
        actor["confidence"].alias("confidence"), actor["method"].alias("method"))


@query("DET3_email_login", "commits",
       sql=f"SELECT author_email, {email_sql('author_email')} AS login, count(*) AS n FROM commits GROUP BY ALL")
def email_logins(commits):
    return commits.groupBy("author_email", actors.email_login(F.col("author_email")).alias("login")).agg(
        F.count(F.lit(1)).alias("n"))


query("DET4_commit_evidence", "commits", steps={k: EVIDENCE_STEPS[k] for k in ("named", "first_hit", "plans", "evidence")},
      sql="SELECT * FROM evidence")(detection.commit_evidence)
query("DET5_authorship", "pull_requests", "commits", steps=EVIDENCE_STEPS, sql="SELECT * FROM author_verdict")(
    detection.authorship)


@query("DET6_ai_reviewers", "reviews", "review_comments", "issue_comments", steps=REVIEWER_STEPS,
       sql="SELECT pr_id, logins, sources, n FROM reviewers")
def reviewers(*tables):
    return detection.ai_reviewers(*tables).select(
        "pr_id", F.array_join("ai_reviewer_logins", ",").alias("logins"),
        F.array_join("ai_reviewer_sources", ",").alias("sources"), F.size("ai_reviewer_logins").cast("long").alias("n"))


SOURCES = ["pull_requests", "commits", "reviews", "review_comments", "issue_comments"]


@query("DET7_detect", *SOURCES, steps=VERDICT_STEPS, sql="SELECT * FROM verdict")
def verdicts(*tables):
    return detection.detect(*tables).drop("ai_reviewer_logins").withColumn(
        "ai_reviewer_sources", F.array_join("ai_reviewer_sources", ","))


@query("DET8_human_comments", "review_comments",
       sql=f"""SELECT author_login, {human_sql('author_login')} AS is_human,
       {human_sql('author_login', chr(92) + '[bot' + chr(92) + ']')} AS is_human_short, count(*) AS n
       FROM review_comments GROUP BY ALL""")
def human_flags(review_comments):
    login = F.col("author_login")
    return review_comments.groupBy(
        "author_login", actors.is_human_author(login).alias("is_human"),
        actors.is_human_author(login, name_patterns=False).alias("is_human_short")).agg(F.count(F.lit(1)).alias("n"))


@query("AGG32_detection_mix", *SOURCES, steps=VERDICT_STEPS,
       sql="""SELECT ai_authored_kind, ai_authored_method, ai_authored_confidence, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (), 4) AS share FROM verdict WHERE is_ai_authored GROUP BY 1, 2, 3""")
def mix(*tables):
    return stats.detection_mix(detection.detect(*tables))


@query("SMP7_audit_sample", *SOURCES, steps=VERDICT_STEPS,
       sql="""SELECT pr_id, is_ai_authored, ai_authored_method, is_ai_reviewed, ai_reviewer_logins_str,
       CAST(1 AS DOUBLE) - CAST(3 AS DOUBLE) / 40 AS precision_lower_bound
       FROM verdict WHERE is_ai_authored OR is_ai_reviewed ORDER BY md5(concat('42:', pr_id)), pr_id LIMIT 40""")
def audit(*tables):
    return sampling.audit_sample(detection.detect(*tables)).select(
        "pr_id", "is_ai_authored", "ai_authored_method", "is_ai_reviewed", "ai_reviewer_logins_str", "precision_lower_bound")
