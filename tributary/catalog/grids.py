"""Queries over prompt grids, replay of stored answers, and resuming."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary import fixed_prompts as texts
from tributary import fixed_values as fixed
from tributary.catalog.registry import query
from tributary.catalog.sampling import BEST_COMMENT, SPLIT_STEPS, split_of, train_of
from tributary.catalog.texts import (
    AUGMENTED, META_STEPS, TIER_STEPS, build_augmented, commit_steps, diff_steps, strip_sql, cut_sql,
)
from tributary.operators import contexts, features, prompts, replay, splits
from tributary.plans import grids
from tributary.plans.run_grid import run_grid
from tributary.session import cut_lineage, scratch_path

KEYS = "pr_id, context_kind, strategy, task"


def lit(value: str) -> str:
    quoted = value.replace("'", "''")
    return " || chr(10) || ".join(f"'{part}'" for part in quoted.split("\n"))


def fill_sql(template: str, slots: dict[str, str]) -> str:
    pieces = prompts.SLOT.split(template)
    return "concat(" + ", ".join(slots[p] if i % 2 else lit(p) for i, p in enumerate(pieces) if p or i % 2) + ")"


def choose_sql(templates: dict[tuple[str, str], str], slots: dict[str, str]) -> str:
    arms = " ".join(f"WHEN task = '{t}' AND strategy = '{s}' THEN {fill_sql(v, slots)}" for (t, s), v in templates.items())
    return f"CASE {arms} END"


PROJECT = "CASE WHEN coalesce(repo, '') <> '' THEN concat('the ', repo, ' project') ELSE 'a large open-source project' END"


def content_sql(context: str) -> str:
    return (f"concat(CASE WHEN coalesce(title, '') <> '' THEN concat('PR title: ', title, chr(10)) ELSE '' END, "
            f"'Pull request content:', chr(10), {strip_sql(context)})")


# The axes of the first grid, exploded.
AXES = ("(SELECT unnest(['merge_prediction', 'review_comment']) AS task) AS a1, "
        "(SELECT unnest(['zero_shot', 'few_shot', 'cot', 'role_based']) AS strategy) AS a2")
TIER_AXES = ("(SELECT unnest(['merge_prediction', 'review_comment']) AS task) AS a1, "
             "(SELECT unnest(['role_based', 'few_shot', 'cot', 'self_reflection', 'multi_turn']) AS strategy) AS a2")
LIMIT = 2500
KIND_STEPS = {
    **diff_steps(LIMIT, 4000), **commit_steps(4000), **META_STEPS,
    "parts": f"""SELECT p.id AS pr_id, p.repo, p.title, coalesce(nullif({strip_sql('p.body')}, ''), '(no PR description provided)') AS body,
        concat('Diff:', chr(10), coalesce(d.diff, '(no file diff available)')) AS diff,
        coalesce(c.commit_message, '(no commit messages available)') AS msgs, m.metadata FROM pull_requests p
        LEFT JOIN diff d ON d.pr_id = p.id LEFT JOIN cmsg c ON c.pr_id = p.id LEFT JOIN meta m ON m.pr_id = p.id""",
    "raw_kinds": """SELECT pr_id, repo, title, 'diff_only' AS context_kind, diff AS t FROM parts
        UNION ALL SELECT pr_id, repo, title, 'diff_description', concat('PR description:', chr(10), body, chr(10), chr(10), diff) FROM parts
        UNION ALL SELECT pr_id, repo, title, 'diff_commit_message', concat('Commit messages:', chr(10), msgs, chr(10), chr(10), diff) FROM parts
        UNION ALL SELECT pr_id, repo, title, 'diff_metadata', concat(metadata, chr(10), chr(10), diff) FROM parts""",
    "kinds": f"""SELECT pr_id, repo, title, context_kind, CASE WHEN length(t) > {LIMIT} THEN concat(substr(t, 1, {LIMIT}), chr(10),
        '... [context truncated to fit the LLM token budget]') ELSE t END AS context_text FROM raw_kinds""",
}


def demo_steps(split: str, contexts_from: str) -> dict[str, str]:
    block = f"""CASE WHEN task = 'merge_prediction' THEN {fill_sql(texts.DEMONSTRATIONS['merge_prediction'],
        {'i': 'position', 'context': strip_sql('context_text'), 'target': 'target'})}
        ELSE {fill_sql(texts.DEMONSTRATIONS['review_comment'], {'i': 'position', 'context': strip_sql('context_text'), 'target': 'target'})} END"""
    return {
        "best_c": BEST_COMMENT,
        "demo_rows": f"""SELECT 'merge_prediction' AS task, pr_id, CASE WHEN y = 1 THEN 1 ELSE 2 END AS position,
            CASE WHEN y = 1 THEN 'MERGE' ELSE 'CLOSE' END AS target FROM (SELECT pr_id, y, row_number() OVER (PARTITION BY y
            ORDER BY md5(concat('42:', pr_id)), pr_id) AS turn FROM {split} WHERE side = 'train') AS d WHERE turn = 1
            UNION ALL SELECT 'review_comment', pr_id, row_number() OVER (ORDER BY md5(concat('42:', pr_id)), pr_id) AS position,
            {cut_sql(strip_sql('body'), 600, ' ...')} FROM {split} JOIN best_c USING (pr_id) WHERE side = 'train' QUALIFY position <= 2""",
        "demo_blocks": f"""SELECT task, context_kind, string_agg(block, chr(10) || chr(10) ORDER BY position) AS demos, count(*) AS n_demos
            FROM (SELECT task, context_kind, position, {block} AS block FROM demo_rows JOIN {contexts_from} USING (pr_id)) AS b GROUP BY ALL""",
    }


SLOT_SQL = {"project": PROJECT, "content": content_sql("context_text"), "demos": "coalesce(demos, '')",
            "n_demos": "coalesce(n_demos, 0)"}
PROMPT_STEPS = {
    **SPLIT_STEPS, **KIND_STEPS, **demo_steps("split", "kinds"),
    "cells": f"SELECT k.*, a1.task, a2.strategy FROM kinds k JOIN split s ON s.pr_id = k.pr_id AND s.side = 'test', {AXES}",
    "shown": """SELECT c.*, CASE WHEN strategy = 'few_shot' THEN demos END AS demos, CASE WHEN strategy = 'few_shot' THEN n_demos END AS n_demos
        FROM cells c LEFT JOIN demo_blocks b ON b.task = c.task AND b.context_kind = c.context_kind""",
    "prompts": f"""SELECT {KEYS}, title, repo, context_text, {choose_sql(texts.SYSTEMS, SLOT_SQL)} AS system, {choose_sql(texts.USERS, SLOT_SQL)} AS "user" FROM shown""",
}


def prompt_rows(pull_requests, files_changed, commits, review_comments):
    split = cut_lineage(split_of(pull_requests))
    return grids.prompt_grid(
        split.where("side = 'test'"), split.where("side = 'train'"), pull_requests, files_changed, commits, review_comments,
        context_limit=LIMIT, budget=LIMIT)


GRID_TABLES = ["pull_requests", "files_changed", "commits", "review_comments"]


@query("PRM1_PRM5_prompt_grid", *GRID_TABLES, steps=PROMPT_STEPS,
       sql=f"""SELECT {KEYS}, CAST(length(system) AS BIGINT) AS system_chars, CAST(length("user") AS BIGINT) AS user_chars,
       md5(concat(system, chr(10), "user")) AS prompt_md5 FROM prompts""")
def prompt_grid(*tables):
    return prompt_rows(*tables).select(
        *replay.CELL, F.length("system").cast("long").alias("system_chars"), F.length("user").cast("long").alias("user_chars"),
        F.md5(F.concat("system", F.lit("\n"), "user")).alias("prompt_md5"))


@query("PRM2_demonstration_blocks", *GRID_TABLES, steps=PROMPT_STEPS, sql="SELECT task, context_kind, demos, n_demos FROM demo_blocks")
def demonstrations(pull_requests, files_changed, commits, review_comments):
    demos = grids.demonstration_rows(train_of(pull_requests), review_comments)
    ids = demos.select("pr_id").distinct()
    kinds = contexts.pr_contexts(
        pull_requests.join(ids.withColumnRenamed("pr_id", "id"), "id", "left_semi"),
        features.restrict_to(files_changed, ids), features.restrict_to(commits, ids), LIMIT, context_limit=LIMIT)
    return prompts.demonstration_blocks(demos.join(kinds.select("pr_id", "context_kind", "context_text"), "pr_id"))


@query("PRM3_demonstration_check", *GRID_TABLES, steps=PROMPT_STEPS,
       sql="""SELECT strategy, count(*) AS n, count(*) FILTER (coalesce(n_demos, 0) > 0) AS n_with_demonstrations FROM shown GROUP BY strategy""")
def demonstration_check(*tables):
    return prompts.require_demonstrations(prompt_rows(*tables).drop("system", "user", "contract")).groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("n_demos", F.lit(0)) > 0).alias("n_with_demonstrations"))


@query("PRM8_message_list", "answers", sql="""SELECT pr_id, CASE WHEN pr_id % 3 = 0 THEN '' ELSE 'system,' END || 'user' AS roles,
       CAST(length(text) + CASE WHEN pr_id % 3 = 0 THEN 0 ELSE 8 END AS BIGINT) AS chars FROM answers""")
def message_list(answers):
    system = F.when(F.col("pr_id") % 3 == 0, "").otherwise("be brief")
    listed = prompts.messages(system, F.array("text"))
    return answers.select("pr_id", listed.alias("m")).select(
        "pr_id", F.array_join(F.transform("m", lambda m: m["role"]), ",").alias("roles"),
        F.aggregate("m", F.lit(0).cast("long"), lambda a, m: a + F.length(m["content"])).alias("chars"))


FIRST_TURNS = {(t, s): texts.USERS[t, "zero_shot"] for t in fixed.TASKS for s in ("self_reflection",)}
TURN_STEPS = {
    **TIER_STEPS,
    "tcells": f"SELECT t.*, a1.task, a2.strategy FROM tiers t, {TIER_AXES} WHERE NOT (a2.strategy = 'multi_turn' AND second_text IS NULL)",
}


@query("PRM4_two_turn_conversations", *AUGMENTED, steps={
    **TURN_STEPS,
    "turns": f"""SELECT {KEYS}, {choose_sql({(t, s): texts.SYSTEMS[t, 'zero_shot'] for t in fixed.TASKS for s in ('self_reflection', 'multi_turn')}, {'project': PROJECT})} AS system,
        CASE WHEN strategy = 'self_reflection'
             THEN {choose_sql(FIRST_TURNS, {'project': PROJECT, 'content': content_sql('context_text')})}
             ELSE {choose_sql({(t, 'multi_turn'): texts.USERS[t, 'zero_shot'] for t in fixed.TASKS}, {'project': PROJECT, 'content': content_sql('first_text')})} END AS first,
        {choose_sql(texts.SECOND_TURNS, {'project': PROJECT, 'second': "coalesce(second_text, '')"})} AS second FROM tcells
        WHERE strategy IN ('self_reflection', 'multi_turn')"""},
    sql=f"""SELECT {KEYS}, md5(system) AS system_md5, md5(first) AS first_md5, md5(second) AS second_md5,
    CAST(length(first) + length(second) AS BIGINT) AS chars FROM turns""")
def two_turns(*tables):
    cells = prompts.grid_cells(contexts.tier_contexts(build_augmented(*tables)), fixed.TASKS, ["self_reflection", "multi_turn"])
    empty = cells.withColumn("demos", F.lit(None).cast("string")).withColumn("n_demos", F.lit(None).cast("long"))
    turns = prompts.conversations(empty)
    return turns.select(
        *replay.CELL, F.md5("system").alias("system_md5"), F.md5(F.col("turns")[0]).alias("first_md5"),
        F.md5(F.col("turns")[1]).alias("second_md5"), (F.length(F.col("turns")[0]) + F.length(F.col("turns")[1])).cast("long").alias("chars"))


@query("PRM5_tier_grid", *AUGMENTED, steps=TURN_STEPS,
       sql="SELECT context_kind, task, strategy, count(*) AS n, CASE WHEN strategy IN ('self_reflection', 'multi_turn') THEN 2 ELSE 1 END AS turns FROM tcells GROUP BY ALL")
def tier_prompts(pull_requests, files_changed, commits, review_comments, issue_table):
    split = cut_lineage(splits.time_split(features.ai_labelled(pull_requests)))
    grid = grids.tier_grid(
        split.where("side = 'test'"), split.where("side = 'train'"), pull_requests, files_changed, commits, review_comments, issue_table)
    return grid.groupBy("context_kind", "task", "strategy").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("turns")).alias("turns"))


@query("JOI6_grid_cells", "pull_requests", steps=SPLIT_STEPS,
       sql=f"SELECT s.pr_id, k.context_kind, a1.task, a2.strategy FROM split s, (SELECT unnest({fixed.CONTEXT_KINDS}) AS context_kind) AS k, {AXES} WHERE s.side = 'test'")
def cells(pull_requests):
    kinds = F.explode(F.array(*[F.lit(k) for k in fixed.CONTEXT_KINDS])).alias("context_kind")
    return prompts.grid_cells(
        split_of(pull_requests).where("side = 'test'").select("pr_id", kinds), fixed.TASKS, fixed.STRATEGIES)


MISSING = f"SELECT {KEYS} FROM grid_cells ANTI JOIN (SELECT * FROM grid WHERE latency_ms IS NOT NULL) AS r USING ({KEYS})"


@query("JOI4_missing_cells", "grid_cells", "grid", sql=MISSING)
def missing(grid_cells, grid):
    return replay.missing_cells(grid_cells.select(*replay.CELL), grid.where("latency_ms IS NOT NULL"))


@query("TOP7_budgeted_cells", "grid_cells", "grid", steps={"m": MISSING}, sql=f"SELECT * FROM m ORDER BY {KEYS} LIMIT 50")
def budgeted(grid_cells, grid):
    return replay.budgeted(missing(grid_cells, grid), 50)


@query("AGG25_run_counters", "grid_cells", "grid", steps={
    "c": f"""SELECT {KEYS}, latency_ms IS NOT NULL AS done, total_time IS NOT NULL AND latency_ms IS NULL AS now, error FROM grid"""},
    sql="""SELECT count(*) AS total_cells, count(*) FILTER (done) AS n_skipped_already_done, count(*) FILTER (now) AS n_written_this_run,
    count(*) FILTER (now AND error IS NOT NULL) AS n_recorded_failures,
    count(*) FILTER (now AND error IS NULL AND pr_id % 2 = 1) AS n_new_api_calls,
    count(*) FILTER (NOT done AND NOT now) AS n_cache_misses_skipped FROM c""")
def counters(grid_cells, grid):
    """The second of two runs against one log: the first answers some cells, this one finds them recorded."""
    log = scratch_path(grid.sparkSession, "run-log")
    run_grid(grid_cells, log, _answers_where(grid, "latency_ms IS NOT NULL"))
    return run_grid(grid_cells, log, _answers_where(grid, "total_time IS NOT NULL AND latency_ms IS NULL")).drop("stopped_reason")


def _answers_where(grid, condition: str):
    """A responder that knows the answers of the grid rows that fit ``condition``."""
    known = grid.where(condition).select(
        F.col("pr_id").cast("string").alias("pr_id"), "repo", *replay.CELL[1:], "response_text", "error",
        (F.col("pr_id") % 2 == 0).alias("from_cache"), "latency_ms")
    return lambda pending: known.join(pending.select(*replay.CELL), replay.CELL, "left_semi")


@query("AGG25_budgeted_run", "grid_cells", "grid", steps={
    "m": MISSING, "b": f"SELECT *, row_number() OVER (ORDER BY CAST(pr_id AS VARCHAR), {', '.join(replay.CELL[1:])}) <= 50 AS asked FROM m",
    "w": f"SELECT b.asked, g.error, g.pr_id IS NOT NULL AS wrote, b.pr_id % 2 = 1 AS live FROM b "
         f"LEFT JOIN (SELECT * FROM grid WHERE total_time IS NOT NULL) AS g USING ({KEYS})"},
    sql="""SELECT (SELECT count(*) FROM grid_cells) AS total_cells, (SELECT count(*) FROM grid_cells) - count(*) AS n_skipped_already_done,
    count(*) FILTER (asked AND wrote) AS n_written_this_run, count(*) FILTER (asked AND wrote AND error IS NOT NULL) AS n_recorded_failures,
    count(*) FILTER (asked AND wrote AND error IS NULL AND live) AS n_new_api_calls,
    count(*) FILTER (asked AND NOT wrote) AS n_cache_misses_skipped,
    CASE WHEN count(*) > 50 THEN 'max_new_calls reached' END AS stopped_reason FROM w""")
def budgeted_run(grid_cells, grid):
    log = scratch_path(grid.sparkSession, "run-log")
    run_grid(grid_cells, log, _answers_where(grid, "latency_ms IS NOT NULL"))
    return run_grid(grid_cells, log, _answers_where(grid, "total_time IS NOT NULL"), max_new=50)



def _settings():
    return F.lit("model-8b"), F.lit(0.2), F.lit(512)


KEY_SQL = """sha256(concat('{{"max_output_tokens": 512, "model": "model-8b", "system": ', to_json({0}), ', "temperature": 0.2, "user": ', to_json({1}), '}}'))"""


def turn_key_sql(messages: list[tuple[str, str]]) -> str:
    listed = ", ', ', ".join(f"""'{{"content": ', to_json({content}), ', "role": "{role}"}}'""" for role, content in messages)
    return (f"""sha256(concat('{{"max_output_tokens": 512, "messages": [', {listed}, '], "model": "model-8b", "system": "be brief", '"""
            f""", '"temperature": 0.2}}'))""")


@query("SRC7_FUN12_response_keys", "answers", sql=f"SELECT pr_id, {KEY_SQL.format(repr('be brief'), 'text')} AS prompt_key FROM answers")
def response_keys(answers):
    model, temperature, tokens = _settings()
    return answers.select("pr_id", replay.prompt_key(model, F.lit("be brief"), F.col("text"), temperature, tokens).alias("prompt_key"))


def _stored(answers):
    keyed = response_keys(answers)
    return keyed, keyed.where("pr_id % 3 <> 0").select(
        "prompt_key", F.concat(F.lit("reply "), F.col("pr_id")).alias("response_text")).groupBy("prompt_key").agg(
        F.min("response_text").alias("response_text"))


REPLAY_STEPS = {
    "keyed": f"SELECT pr_id, {KEY_SQL.format(repr('be brief'), 'text')} AS prompt_key FROM answers",
    "stored": "SELECT prompt_key, min(concat('reply ', pr_id)) AS response_text FROM keyed WHERE pr_id % 3 <> 0 GROUP BY prompt_key",
}


@query("PRM6_replay", "answers", steps=REPLAY_STEPS, sql="SELECT pr_id, prompt_key, response_text FROM keyed LEFT JOIN stored USING (prompt_key)")
def replayed(answers):
    return replay.replay(*_stored(answers))


@query("PRM6_pending", "answers", steps=REPLAY_STEPS, sql="SELECT pr_id, prompt_key FROM keyed ANTI JOIN stored USING (prompt_key)")
def pending(answers):
    return replay.pending(*_stored(answers))


SECOND = "concat('Revise ', pr_id)"
TALK_STEPS = {
    "talk": f"""SELECT pr_id, text AS first, {SECOND} AS second, {turn_key_sql([('user', 'text')])} AS k1 FROM answers""",
    "s1": "SELECT k1, min(concat('draft ', pr_id)) AS reply_1 FROM talk WHERE pr_id % 3 <> 0 GROUP BY k1",
    "t1": "SELECT * FROM talk LEFT JOIN s1 USING (k1)",
    "t2": f"SELECT *, {turn_key_sql([('user', 'first'), ('assistant', 'reply_1'), ('user', 'second')])} AS k2 FROM t1",
    "s2": "SELECT k2, min(concat('final ', pr_id)) AS reply_2 FROM t2 WHERE pr_id % 4 <> 0 AND reply_1 IS NOT NULL GROUP BY k2",
}


@query("PRM6_replay_conversation", "answers", steps=TALK_STEPS,
       sql="""SELECT pr_id, reply_1, CASE WHEN reply_1 IS NOT NULL THEN reply_2 END AS reply_2, reply_1 IS NOT NULL AND reply_2 IS NOT NULL AS available
       FROM t2 LEFT JOIN s2 USING (k2)""")
def replayed_conversation(answers):
    model, temperature, tokens = _settings()
    system = F.lit("be brief")
    talks = answers.select("pr_id", system.alias("system"), F.array(F.col("text"), F.concat(F.lit("Revise "), F.col("pr_id"))).alias("turns"))
    opening = talks.withColumn("prompt_key", replay.transcript_key(model, system, [("user", F.col("turns")[0])], temperature, tokens))
    first = opening.where("pr_id % 3 <> 0").groupBy("prompt_key").agg(F.min(F.concat(F.lit("draft "), F.col("pr_id"))).alias("response_text"))
    history = [("user", F.col("turns")[0]), ("assistant", F.col("response_text")), ("user", F.col("turns")[1])]
    second = (
        opening.join(first, "prompt_key")
        .where("pr_id % 4 <> 0")
        .withColumn("prompt_key", replay.transcript_key(model, system, history, temperature, tokens))
        .groupBy("prompt_key")
        .agg(F.min(F.concat(F.lit("final "), F.col("pr_id"))).alias("response_text"))
    )
    return replay.replay_conversation(talks, first.unionByName(second), model, temperature, tokens).select(
        "pr_id", "reply_1", "reply_2", "available")


@query("PRM7_response_rows", "tier_grid", sql=f"""SELECT {KEYS}, repo, response_text, is_conversational,
       CASE WHEN is_conversational THEN pr_id % 2 = 0 AND pr_id % 3 = 0 ELSE pr_id % 3 = 0 END AS from_cache,
       coalesce(latency_ms, 0) + CASE WHEN is_conversational THEN 10.0 ELSE 0.0 END AS latency_ms,
       CASE WHEN is_conversational THEN md5(first_text) END AS first_md5,
       CAST(CASE WHEN is_conversational AND pr_id % 2 <> 0 THEN 1 ELSE 0 END + CASE WHEN pr_id % 3 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS n_live_calls
       FROM tier_grid WHERE response_text IS NOT NULL""")
def response_rows(tier_grid):
    def turn(text_column, ms, cached, time_column):
        return F.struct(F.col(text_column).alias("text"), ms.alias("latency_ms"), cached.alias("from_cache"),
                        F.col(time_column).alias("total_time"), F.lit("model-8b").alias("model"))

    last = turn("response_text", F.coalesce("latency_ms", F.lit(0.0)), F.col("pr_id") % 3 == 0, "total_time")
    first = turn("first_text", F.lit(10.0), F.col("pr_id") % 2 == 0, "first_time")
    rows = tier_grid.where("response_text IS NOT NULL").withColumn(
        "turns", F.when(F.col("is_conversational"), F.array(first, last)).otherwise(F.array(last)))
    return replay.response_rows(rows).select(
        *replay.CELL, "repo", "response_text", "is_conversational", "from_cache", "latency_ms",
        F.md5(F.col("turn_texts")[0]).alias("first_md5"), "n_live_calls")


def _echo(batches):
    for batch in batches:
        yield batch.assign(response_text="echo " + batch["text"].str.len().astype(str))[["pr_id", "response_text"]]


@query("UDF2_injected_responder", "answers", sql="SELECT pr_id, concat('echo ', length(text)) AS response_text FROM answers")
def responder(answers):
    return replay.ask(answers.select("pr_id", "text"), _echo, "pr_id long, response_text string")


@query("UDF1_demonstration_renderer", "pull_requests", "files_changed", "commits", steps={**SPLIT_STEPS, **KIND_STEPS},
       sql="SELECT k.pr_id, md5(k.context_text) AS text_key FROM kinds k JOIN split s ON s.pr_id = k.pr_id AND s.side = 'train' WHERE context_kind = 'diff_metadata'")
def renderer(pull_requests, files_changed, commits):
    def render(ids):
        keep = pull_requests.join(ids.withColumnRenamed("pr_id", "id"), "id", "left_semi")
        kinds = contexts.pr_contexts(keep, files_changed, commits, LIMIT, context_limit=LIMIT)
        return kinds.where("context_kind = 'diff_metadata'").select("pr_id", "context_text")

    return render(train_of(pull_requests).select("pr_id")).select("pr_id", F.md5("context_text").alias("text_key"))
