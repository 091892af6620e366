"""Which pull requests were written or reviewed by a model.

All evidence is reduced with partial aggregates: only commits and comments that
are evidence reach the shuffle, and one row per pull request leaves each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary import fixed_values as fixed
from tributary.functions.actors import (
    classify_actor,
    email_login,
    is_coding_agent,
    is_review_bot,
    normalize_login,
)
from tributary.functions.text import strip


def agent_login(login: Column, name: Column, email: Column) -> Column:
    """The coding agent that a commit's account, name or address names, in this order; else null."""
    candidates = [normalize_login(login), normalize_login(name), email_login(email)]
    return F.coalesce(*[F.when(is_coding_agent(c), c) for c in candidates])


def is_placeholder(message: Column) -> Column:
    return F.startswith(F.lower(strip(F.coalesce(message, F.lit("")))), F.lit(fixed.INITIAL_PLAN))


def evidence_columns(named: Column, agent: Column, sha: Column) -> list[Column]:
    """``method, confidence, login, evidence``: of the named agent's commit, else of the placeholder."""
    return [
        F.when(named, "commit_agent_identity").otherwise("commit_initial_plan").alias("method"),
        F.when(named, fixed.CONFIDENCE_COMMIT_IDENTITY).otherwise(fixed.CONFIDENCE_INITIAL_PLAN).alias("confidence"),
        F.when(named, agent).otherwise(fixed.INITIAL_PLAN_LOGIN).alias("login"),
        F.when(named, F.concat(F.lit("commit "), F.substring(sha, 1, 10), F.lit(" authored by agent identity '"), agent, F.lit("'")))
        .otherwise("first commit message is Copilot's 'Initial plan' placeholder").alias("evidence"),
    ]


def commit_evidence(commits: DataFrame) -> DataFrame:
    """``pr_id, method, confidence, login, evidence`` for requests whose commits point to an agent.

    The earliest commit with an agent identity wins (account, then name, then
    address); otherwise a first commit with the placeholder message counts.
    """
    agent = agent_login(F.col("author_login"), F.col("author_name"), F.col("author_email"))
    placeholder = (F.col("commit_ord") == 0) & is_placeholder(F.col("message"))
    hits = (
        commits.select("pr_id", "commit_ord", F.coalesce("sha", F.lit("")).alias("sha"), agent.alias("_agent"),
                       placeholder.alias("_plan"))
        .where(F.col("_agent").isNotNull() | F.col("_plan"))
        .groupBy("pr_id")
        .agg(F.min_by(F.struct("_agent", "sha"), F.when(F.col("_agent").isNotNull(), F.col("commit_ord"))).alias("_hit"))
    )
    return hits.select("pr_id", *evidence_columns(F.col("_hit").isNotNull(), F.col("_hit._agent"), F.col("_hit.sha")))


def authorship(pull_requests: DataFrame, commits: DataFrame) -> DataFrame:
    """Author category and the AI-authorship verdict per pull request."""
    evidence = commit_evidence(commits).select(
        F.col("pr_id"), F.col("method").alias("_method"), F.col("confidence").alias("_confidence"),
        F.col("evidence").alias("_evidence"),
    )
    rows = (
        pull_requests.select(
            F.col("id").alias("pr_id"), "author_login", "author_type",
            classify_actor(F.col("author_login"), F.col("author_type")).alias("_actor"),
        )
        .join(evidence, "pr_id", "left")
    )
    return rows.select("pr_id", "author_login", "author_type", *authorship_columns())


def authorship_columns() -> list[Column]:
    """Category and verdict from ``_actor``, ``author_login`` and the evidence ``_method, _confidence, _evidence``, null without any."""
    agent = F.col("_actor.category") == "ai_coding_agent"
    bot = F.col("_actor.category").isin("ai_review_bot", "other_bot")
    assisted = ~agent & ~bot & F.col("_method").isNotNull()
    return [
        F.col("_actor.category").alias("author_category"),
        (agent | assisted).alias("is_ai_authored"),
        F.when(agent, "agent_authored").when(assisted, "human_opened_ai_assisted").alias("ai_authored_kind"),
        F.when(assisted, F.col("_method")).otherwise(F.col("_actor.method")).alias("ai_authored_method"),
        F.when(assisted, F.col("_confidence")).otherwise(F.col("_actor.confidence")).alias("ai_authored_confidence"),
        F.when(agent, F.concat(F.lit("PR author '"), F.col("author_login"), F.lit("' is an allowlisted coding agent")))
        .when(assisted, F.col("_evidence")).alias("ai_authored_evidence"),
    ]


def ai_reviewers(reviews: DataFrame, review_comments: DataFrame, issue_comments: DataFrame) -> DataFrame:
    """Distinct review-bot logins (as written) and where they appeared, per pull request."""
    seen = [
        (reviews, "reviewer_login", "review"),
        (review_comments, "author_login", "review_comment"),
        (issue_comments, "author_login", "issue_comment"),
    ]
    parts = [
        table.select("pr_id", F.col(column).alias("login"), F.lit(source).alias("source"))
        .where(is_review_bot(normalize_login(F.col("login"))))
        for table, column, source in seen
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # Spellings of the listed accounts: a handful of values per request.
    return every.groupBy("pr_id").agg(
        F.array_sort(F.collect_set("login")).alias("ai_reviewer_logins"),
        F.array_sort(F.collect_set("source")).alias("ai_reviewer_sources"),
    )


def detect(
    pull_requests: DataFrame, commits: DataFrame, reviews: DataFrame,
    review_comments: DataFrame, issue_comments: DataFrame,
) -> DataFrame:
    """One verdict row per pull request: authorship and review."""
    found = ai_reviewers(reviews, review_comments, issue_comments)
    none = F.array().cast("array<string>")
    logins = F.coalesce(F.col("ai_reviewer_logins"), none)
    return authorship(pull_requests, commits).join(found, "pr_id", "left").select(
        "pr_id", "author_login", "author_type", "author_category", "is_ai_authored", "ai_authored_kind",
        "ai_authored_method", "ai_authored_confidence", "ai_authored_evidence",
        *reviewer_columns(logins, F.coalesce(F.col("ai_reviewer_sources"), none)),
    )


def reviewer_columns(logins: Column, sources: Column) -> list[Column]:
    return [
        (F.size(logins) > 0).alias("is_ai_reviewed"),
        logins.alias("ai_reviewer_logins"),
        F.array_join(logins, ",").alias("ai_reviewer_logins_str"),
        sources.alias("ai_reviewer_sources"),
        F.size(logins).cast("long").alias("n_ai_reviewers"),
    ]


def detect_in_row(rows: DataFrame, pr_id: Column, login: Column, kind: Column, commits: Column, reviewers: dict[str, Column]) -> DataFrame:
    """``rows`` with the columns of :func:`detect`, all from the row's own arrays: no shuffle, and nothing is exploded.

    ``commits``: structs ``login, name, email, message, sha`` in order, null if there are none; ``reviewers``: by source the logins that appeared.
    """
    none = F.array().cast("array<string>")
    bots = {source: F.filter(F.coalesce(logins, none), lambda x: is_review_bot(normalize_login(x))) for source, logins in reviewers.items()}
    agents = F.filter(
        F.transform(commits, lambda c: F.struct(agent_login(c["login"], c["name"], c["email"]).alias("agent"), F.coalesce(c["sha"], F.lit("")).alias("sha"))),
        lambda c: c["agent"].isNotNull())
    # each step names what the next one uses more than once, so that it is computed once
    rows = rows.withColumns({
        "pr_id": pr_id, "author_login": login, "author_type": kind, "_actor": classify_actor(login, kind), "_agent": F.get(agents, F.lit(0)),
        "_plan": F.coalesce(is_placeholder(F.get(commits, F.lit(0))["message"]), F.lit(False)) & (F.size(commits) > 0),
        **{f"_bots_{source}": logins for source, logins in bots.items()}})
    named = F.col("_agent").isNotNull()
    evidence = F.when(named | F.col("_plan"), F.struct(*evidence_columns(named, F.col("_agent.agent"), F.col("_agent.sha"))))
    rows = rows.withColumn("_found", evidence).withColumns(
        {"_method": F.col("_found.method"), "_confidence": F.col("_found.confidence"), "_evidence": F.col("_found.evidence")})
    logins = F.array_sort(F.array_distinct(F.concat(*[F.col(f"_bots_{source}") for source in bots])))
    sources = F.filter(F.array(*[F.when(F.size(f"_bots_{source}") > 0, F.lit(source)) for source in sorted(bots)]), lambda x: x.isNotNull())
    return rows.withColumn("_logins", logins).select("*", *authorship_columns(), *reviewer_columns(F.col("_logins"), sources))
