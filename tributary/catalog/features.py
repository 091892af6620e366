"""Queries over the feature operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.catalog.registry import query
from tributary.fixed_values import CARRIER_COLUMNS, V0_COLUMNS, V1_COLUMNS, V2_COLUMNS
from tributary.functions import patches, text
from tributary.operators import features, structure
from tributary.operators.stats import share
from tributary.plans.feature_tables import assemble_features, feature_table

ALL = ["pull_requests", "files_changed", "commits", "reviews", "review_comments", "issue_comments"]

HUMAN = """SELECT id AS pr_id, repo, author_login, created_at, CAST(is_merged AS BIGINT) AS y, labels
    FROM pull_requests WHERE NOT is_ai_authored AND state IN ('MERGED', 'CLOSED')"""
# Whitespace that the reader of words skips, spelled out for RE2.
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def words_sql(column: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array(coalesce({column}, ''), '{BLANK}'), lambda w: w <> '')) AS BIGINT)"


HUNKS = "CAST(len(list_filter(string_split(coalesce(patch, ''), chr(10)), lambda l: starts_with(l, '@@'))) AS BIGINT)"

MODIFICATION = f"""SELECT p.id AS pr_id, p.additions AS m_additions, p.deletions AS m_deletions,
    p.additions + p.deletions AS m_churn, p.additions - p.deletions AS m_net_change, p.changed_files AS m_changed_files,
    (p.additions + p.deletions) / greatest(p.changed_files, 1) AS m_avg_file_churn,
    p.additions / (p.additions + p.deletions + 1) AS m_frac_added,
    CAST(coalesce(f.hunks, 0) AS BIGINT) AS m_num_hunks, coalesce(f.a, 0) AS m_files_added, coalesce(f.m, 0) AS m_files_modified,
    coalesce(f.r, 0) AS m_files_removed, coalesce(f.n, 0) AS m_files_renamed, coalesce(c.n, 0) AS m_num_commits
    FROM pull_requests p
    LEFT JOIN (SELECT pr_id, sum({HUNKS}) AS hunks, count(*) FILTER (status = 'added') AS a,
               count(*) FILTER (status = 'modified') AS m, count(*) FILTER (status = 'removed') AS r,
               count(*) FILTER (status = 'renamed') AS n FROM files_changed GROUP BY pr_id) f ON f.pr_id = p.id
    LEFT JOIN (SELECT pr_id, count(*) AS n FROM commits GROUP BY pr_id) c ON c.pr_id = p.id"""
TEXT = f"""SELECT p.id AS pr_id, CAST(length(coalesce(title, '')) AS BIGINT) AS t_title_len, {words_sql('title')} AS t_title_wordcount,
    CAST(length(coalesce(body, '')) AS BIGINT) AS t_body_len, {words_sql('body')} AS t_body_wordcount,
    CAST(length(coalesce(body, '')) = 0 AS BIGINT) AS t_body_is_empty,
    CAST(coalesce(c.f, 0) AS DOUBLE) AS t_commit_msg_len_first, coalesce(c.a, 0.0) AS t_commit_msg_len_mean,
    CAST(coalesce(c.t, 0) AS DOUBLE) AS t_commit_msg_len_total
    FROM pull_requests p
    LEFT JOIN (SELECT pr_id, arg_min(length(message), commit_ord) FILTER (message IS NOT NULL) AS f,
               avg(length(message)) AS a, sum(length(message)) AS t FROM commits GROUP BY pr_id) c ON c.pr_id = p.id"""
PROCESS = """SELECT p.id AS pr_id, CAST(len(labels) AS BIGINT) AS num_labels, CAST(is_ai_reviewed AS BIGINT) AS p_is_ai_reviewed,
    n_ai_reviewers AS p_n_ai_reviewers, coalesce(r.n, 0) AS p_num_reviews, coalesce(r.who, 0) AS p_num_reviewers,
    CAST(coalesce(r.cr, 0) AS BIGINT) AS p_has_changes_requested, CAST(coalesce(r.ap, 0) AS BIGINT) AS p_has_approved,
    coalesce(c.n, 0) AS p_num_review_comments, coalesce(i.n, 0) AS p_num_issue_comments
    FROM pull_requests p
    LEFT JOIN (SELECT pr_id, count(*) AS n, count(DISTINCT reviewer_login) AS who,
               max(CASE WHEN state = 'CHANGES_REQUESTED' THEN 1 ELSE 0 END) AS cr,
               max(CASE WHEN state = 'APPROVED' THEN 1 ELSE 0 END) AS ap FROM reviews GROUP BY pr_id) r ON r.pr_id = p.id
    LEFT JOIN (SELECT pr_id, count(*) AS n FROM review_comments GROUP BY pr_id) c ON c.pr_id = p.id
    LEFT JOIN (SELECT pr_id, count(*) AS n FROM issue_comments GROUP BY pr_id) i ON i.pr_id = p.id"""
HISTORY = """SELECT pr_id,
    CASE WHEN author_login IS NULL THEN NULL ELSE merged / nullif(prs, 0) END AS author_prior_merge_rate,
    CASE WHEN author_login IS NULL THEN 0 ELSE prs END AS author_prior_pr_count
    FROM (SELECT id AS pr_id, author_login, is_ai_authored, state,
                 count(*) OVER w AS prs, coalesce(sum(CAST(is_merged AS BIGINT)) OVER w, 0) AS merged
          FROM pull_requests
          WINDOW w AS (PARTITION BY repo, author_login ORDER BY epoch_us(created_at)
                       RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS h
    WHERE NOT is_ai_authored AND state IN ('MERGED', 'CLOSED')"""

EXT = "CASE WHEN contains(filename, '.') THEN lower(regexp_extract(filename, '\\.([^.]*)$', 1)) END"
LANGUAGE = f"""CASE WHEN {EXT} = 'py' THEN 'python' WHEN {EXT} IN ('ts', 'js', 'mjs', 'cjs', 'tsx', 'jsx') THEN 'typescript'
    WHEN {EXT} = 'cs' THEN 'csharp' END"""
LINES = """SELECT pr_id, file_ord, filename, status, language, patch, i,
    string_split(patch, chr(10))[i] AS line FROM (SELECT *, unnest(range(1, len(string_split(patch, chr(10))) + 1)) AS i
    FROM typed WHERE language IS NOT NULL AND patch IS NOT NULL) AS t"""
MARKED = """SELECT *, sum(CASE WHEN starts_with(line, '@@') THEN 1 ELSE 0 END)
    OVER (PARTITION BY pr_id, file_ord ORDER BY i) AS block FROM plines"""
HUNK_TEXT = """SELECT pr_id, file_ord, filename, language, block,
    string_agg(CASE WHEN left(line, 1) IN ('+', ' ') THEN substr(line, 2) ELSE line END, chr(10) ORDER BY i) AS text
    FROM marked WHERE block > 0 AND line <> '' AND NOT starts_with(line, '@@') AND NOT starts_with(line, '-')
      AND NOT starts_with(line, chr(92)) GROUP BY ALL"""


def _count_sql(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))"


def _case_sql(patterns: dict[str, str]) -> str:
    arms = " ".join(f"WHEN '{lang}' THEN {_count_sql(p)}" for lang, p in patterns.items())
    return f"CAST(CASE language {arms} ELSE 0 END AS BIGINT)"


def _same(a: str, b: str) -> str:
    return f"{_count_sql(a)} = {_count_sql(b)}"


DEPTH = ("CAST(1 + floor(list_max(list_transform(string_split(text, chr(10)), "
         "lambda l: length(replace(regexp_extract(l, '^[ \\t]*'), chr(9), '    ')))) / 4) AS BIGINT)")
BALANCED = " AND ".join([_same(r"\(", r"\)"), _same(r"\[", r"\]"), _same(r"\{", r"\}")])
HUNK_COUNTS = f"""SELECT pr_id, file_ord, filename, language, block, text, {_case_sql(patches.DECISION_WORDS)} AS decisions,
    {_case_sql(patches.FUNCTION_WORDS)} AS functions, CAST({_count_sql('[A-Za-z0-9_]+|[^ \\t\\nA-Za-z0-9_]')} AS BIGINT) AS tokens,
    {DEPTH} AS depth, {BALANCED} AS balanced FROM hunk_text"""
FILE_TABLE = """SELECT t.pr_id, t.file_ord, t.filename, t.language, coalesce(h.n, 0) AS n_hunks,
    coalesce(h.parsed, 0) AS n_hunks_parsed,
    CASE WHEN t.language = 'python' THEN coalesce(h.parsed, 0) ELSE coalesce(h.n, 0) END AS n_hunks_cfg_ok,
    CAST(coalesce(h.tokens, 0) AS BIGINT) AS ast_node_count, coalesce(h.depth, 0) AS ast_max_depth,
    CAST(coalesce(h.decisions + h.n, 0) AS BIGINT) AS cfg_node_count, CAST(coalesce(2 * h.decisions, 0) AS BIGINT) AS cfg_edge_count,
    CAST(coalesce(h.decisions + h.n, 0) AS BIGINT) AS cyclomatic_proxy, CAST(coalesce(h.functions, 0) AS BIGINT) AS num_functions
    FROM typed t LEFT JOIN (SELECT pr_id, file_ord, count(*) AS n, count(*) FILTER (balanced) AS parsed,
        sum(tokens) AS tokens, max(depth) AS depth, sum(decisions) AS decisions, sum(functions) AS functions
        FROM hunk_counts GROUP BY ALL) h USING (pr_id, file_ord)"""
STRUCTURE_STEPS = {
    "typed": f"SELECT *, {LANGUAGE} AS language FROM files_changed",
    "plines": LINES, "marked": MARKED, "hunk_text": HUNK_TEXT, "hunk_counts": HUNK_COUNTS, "file_table": FILE_TABLE,
}
STRUCTURE = """SELECT pr_id, CAST(sum(ast_node_count) AS BIGINT) AS s_ast_node_count, max(ast_max_depth) AS s_ast_max_depth,
    CAST(sum(cfg_node_count) AS BIGINT) AS s_cfg_node_count, CAST(sum(cfg_edge_count) AS BIGINT) AS s_cfg_edge_count,
    CAST(sum(cyclomatic_proxy) AS BIGINT) AS s_cyclomatic_proxy, CAST(sum(num_functions) AS BIGINT) AS s_num_functions_touched,
    max(CASE WHEN language IS NULL THEN 0 ELSE 1 END)::BIGINT AS s_has_parseable_code,
    CAST(sum(n_hunks) AS BIGINT) AS diag_n_hunks_attempted, CAST(sum(n_hunks_parsed) AS BIGINT) AS diag_n_hunks_parsed,
    CAST(sum(n_hunks_cfg_ok) AS BIGINT) AS diag_n_hunks_cfg_ok,
    sum(n_hunks_parsed) / nullif(sum(n_hunks), 0) AS diag_parse_rate FROM file_table GROUP BY pr_id"""
FIDELITY = """SELECT coalesce(language, 'unsupported') AS language, count(*) AS n_files,
    count(*) FILTER (n_hunks > 0) AS n_files_with_patch, count(*) FILTER (n_hunks = 0) AS n_files_no_patch,
    CAST(sum(n_hunks) AS BIGINT) AS n_hunks_attempted, CAST(sum(n_hunks_parsed) AS BIGINT) AS n_hunks_parsed_ok,
    round(sum(n_hunks_parsed) / nullif(sum(n_hunks), 0), 4) AS hunk_parse_rate,
    CAST(CASE WHEN language = 'python' THEN sum(n_hunks_cfg_ok) END AS BIGINT) AS n_hunks_cfg_ok,
    CASE WHEN language = 'python' THEN round(sum(n_hunks_cfg_ok) / nullif(sum(n_hunks_parsed), 0), 4) END AS cfg_success_rate_given_parsed
    FROM file_table GROUP BY language"""

FEATURE_STEPS = {
    **STRUCTURE_STEPS,
    "pop": HUMAN, "f_m": MODIFICATION, "f_t": TEXT, "f_p": PROCESS, "f_s": STRUCTURE, "f_h": HISTORY,
    "full_features": """SELECT pop.y, pop.created_at, pop.repo, f_m.*, f_t.* EXCLUDE (pr_id), f_p.* EXCLUDE (pr_id),
        f_h.* EXCLUDE (pr_id), coalesce(s_ast_node_count, 0) AS s_ast_node_count, coalesce(s_ast_max_depth, 0) AS s_ast_max_depth,
        coalesce(s_cfg_node_count, 0) AS s_cfg_node_count, coalesce(s_cfg_edge_count, 0) AS s_cfg_edge_count,
        coalesce(s_cyclomatic_proxy, 0) AS s_cyclomatic_proxy, coalesce(s_num_functions_touched, 0) AS s_num_functions_touched,
        coalesce(s_has_parseable_code, 0) AS s_has_parseable_code
        FROM pop JOIN f_m USING (pr_id) JOIN f_t USING (pr_id) JOIN f_p USING (pr_id) JOIN f_h USING (pr_id)
        LEFT JOIN f_s USING (pr_id)""",
}


def variant_sql(columns: list[str]) -> str:
    return f"SELECT {', '.join(CARRIER_COLUMNS + columns)} FROM full_features"


@query("FIL1_human_closed", "pull_requests", steps={"pop": HUMAN},
       sql="SELECT pr_id, repo, author_login, created_at, y, CAST(len(labels) AS BIGINT) AS n_labels FROM pop")
def population(pull_requests):
    return features.human_closed(pull_requests).select(
        "pr_id", "repo", "author_login", "created_at", "y", F.size("labels").cast("long").alias("n_labels"))


@query("FIL2_ai_labelled", "pull_requests", sql="""SELECT id AS pr_id, repo, CAST(is_merged AS BIGINT) AS y, created_at
       FROM pull_requests WHERE is_ai_authored AND is_merged IS NOT NULL""")
def ai_population(pull_requests):
    return features.ai_labelled(pull_requests)


query("AGG12_modification_features", "pull_requests", "files_changed", "commits", sql=MODIFICATION)(
    features.modification_features)
query("AGG13_text_features", "pull_requests", "commits", sql=TEXT)(features.text_features)
query("AGG14_process_features", "pull_requests", "reviews", "review_comments", "issue_comments", sql=PROCESS)(
    features.process_features)


@query("WIN1_author_history", "pull_requests", sql=HISTORY)
def history(pull_requests):
    return features.author_history(features.human_closed(pull_requests), pull_requests)


@query("JOI5_author_history_by_close_time", "pull_requests", steps={
    "done": "SELECT *, created_at + to_days(CAST(id % 30 AS INTEGER)) AS closed_at FROM pull_requests"},
    sql="""SELECT id AS pr_id,
    CASE WHEN author_login IS NULL THEN NULL ELSE merged / nullif(prs, 0) END AS author_prior_merge_rate,
    CASE WHEN author_login IS NULL THEN 0 ELSE prs END AS author_prior_pr_count
    FROM (SELECT id, author_login, is_ai_authored, state,
                 count(*) OVER w AS prs, coalesce(sum(CAST(is_merged AS BIGINT)) OVER w, 0) AS merged
          FROM done WINDOW w AS (PARTITION BY repo, author_login ORDER BY epoch_us(closed_at)
                       RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS h
    WHERE NOT is_ai_authored AND state IN ('MERGED', 'CLOSED')""")
def history_by_close(pull_requests):
    done = pull_requests.withColumn("closed_at", F.expr("created_at + make_dt_interval(int(id % 30))"))
    rows = features.human_closed(done.withColumn("created_at", F.col("closed_at")))
    return features.author_history(rows, done, clock="closed_at")


@query("WIN3_first_commit_message", "commits", sql="""SELECT pr_id,
       CAST(arg_min(length(message), commit_ord) FILTER (message IS NOT NULL) AS DOUBLE) AS t_commit_msg_len_first
       FROM commits GROUP BY pr_id""")
def first_commit(commits):
    return commits.groupBy("pr_id").agg(*features.commit_columns()).select("pr_id", "t_commit_msg_len_first")


@query("JOI3_restrict_to_population", "commits", "pull_requests", steps={"pop": HUMAN},
       sql="SELECT sha, pr_id FROM commits WHERE pr_id IN (SELECT pr_id FROM pop)")
def restricted(commits, pull_requests):
    return features.restrict_to(commits, features.human_closed(pull_requests)).select("sha", "pr_id")


@query("FIL6_language_class", "files_changed", sql=f"""SELECT filename, {LANGUAGE} AS language, count(*) AS n
       FROM files_changed GROUP BY ALL""")
def languages(files_changed):
    return files_changed.groupBy("filename", patches.language(F.col("filename")).alias("language")).agg(
        F.count(F.lit(1)).alias("n"))


@query("FUN3_hunk_markers", "files_changed", sql=f"SELECT pr_id, file_ord, {HUNKS} AS n_hunks FROM files_changed")
def markers(files_changed):
    return files_changed.select("pr_id", "file_ord", patches.hunk_count(F.col("patch")).alias("n_hunks"))


@query("PAR7_post_image_hunks", "files_changed", steps=STRUCTURE_STEPS,
       sql="SELECT pr_id, file_ord, filename, language, row_number() OVER (PARTITION BY pr_id, file_ord ORDER BY block) - 1 AS hunk, "
           "text FROM hunk_text")
def post_image(files_changed):
    return structure.hunk_structure(files_changed).select("pr_id", "file_ord", "filename", "language", "hunk", "text")


@query("PAR9_control_flow_counts", "files_changed", steps=STRUCTURE_STEPS, sql="SELECT * FROM file_table")
def file_counts(files_changed):
    return structure.file_structure(files_changed).drop("status", "n_markers")


@query("AGG15_structure_by_pr", "files_changed", steps=STRUCTURE_STEPS, sql=STRUCTURE)
def by_pr(files_changed):
    return structure.structure_by_pr(structure.file_structure(files_changed))


@query("AGG16_fidelity_by_language", "files_changed", steps=STRUCTURE_STEPS, sql=FIDELITY)
def fidelity(files_changed):
    return structure.fidelity_report(structure.file_structure(files_changed))


@query("JOI1_join_feature_blocks", *ALL, steps=FEATURE_STEPS, sql=variant_sql(V1_COLUMNS))
def blocks(pull_requests, files_changed, commits, *_):
    rows = features.human_closed(pull_requests)
    table = structure.structure_by_pr(structure.file_structure(files_changed))
    joined = features.join_blocks(
        rows, features.modification_features(pull_requests, files_changed, commits),
        features.structure_features(rows, table), features.text_features(pull_requests, commits))
    return features.variant(joined, "v1")


@query("FIL5_features_v0", *ALL, steps=FEATURE_STEPS, sql=variant_sql(V0_COLUMNS))
def v0(*tables):
    return feature_table(assemble_features(*tables), "v0")


@query("FIL5_features_v1", *ALL, steps=FEATURE_STEPS, sql=variant_sql(V1_COLUMNS))
def v1(*tables):
    return feature_table(assemble_features(*tables), "v1")


@query("FIL5_features_v2", *ALL, steps=FEATURE_STEPS, sql=variant_sql(V2_COLUMNS))
def v2(*tables):
    return feature_table(assemble_features(*tables), "v2")


@query("AGG21_feature_summary", *ALL, steps={
    **FEATURE_STEPS,
    "scoped": "SELECT * FROM full_features UNION ALL SELECT * REPLACE ('All repos (pooled)' AS repo) FROM full_features"},
    sql="""SELECT repo, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_merged, round(avg(y), 4) AS merge_rate,
    round(avg(s_has_parseable_code), 4) AS s_has_parseable_code_rate,
    round(avg(CASE WHEN author_prior_pr_count = 0 THEN 1 ELSE 0 END), 4) AS author_prior_pr_count_zero_rate,
    count(*) FILTER (author_prior_merge_rate IS NULL) AS author_prior_merge_rate_nulls FROM scoped GROUP BY repo""")
def summary(*tables):
    return features.feature_summary(assemble_features(*tables))


@query("FUN1_2_text_lengths", "documents", sql_views=[], sql=f"""SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars,
       {words_sql('text')} AS n_words FROM documents""")
def lengths(documents):
    return documents.select("doc_id", text.chars(F.col("text")).alias("n_chars"), text.words(F.col("text")).alias("n_words"))


@query("FUN4_5_ratios_and_logs", "pull_requests", sql="""SELECT id, additions + deletions AS churn, additions - deletions AS net,
       round((additions + deletions) / greatest(changed_files, 1), 6) AS per_file, round(additions / (additions + deletions + 1), 6) AS added_share,
       round(ln(1 + greatest(additions, 0)), 6) AS log_additions,
       round(sign(additions - deletions) * ln(1 + abs(additions - deletions)), 6) AS signed_log_net FROM pull_requests""")
def ratios(pull_requests):
    added, deleted, files = F.col("additions"), F.col("deletions"), F.col("changed_files")
    net = text.net_change(added, deleted)
    return pull_requests.select(
        "id", text.churn(added, deleted).alias("churn"), net.alias("net"),
        F.round(text.churn_per_file(added, deleted, files), 6).alias("per_file"),
        F.round(text.added_share(added, deleted), 6).alias("added_share"),
        F.round(text.log_count(added), 6).alias("log_additions"), F.round(text.signed_log(net), 6).alias("signed_log_net"))


@query("FUN9_shares", "pull_requests", sql="""SELECT repo, round(count(*) FILTER (is_merged) / nullif(count(*) FILTER (state <> 'OPEN'), 0), 4) AS merged_share,
       round(count(*) FILTER (is_merged) / nullif(count(*) FILTER (state = 'NONE'), 0), 4) AS no_share FROM pull_requests GROUP BY repo""")
def shares(pull_requests):
    merged = F.count_if("is_merged")
    return pull_requests.groupBy("repo").agg(
        share(merged, F.count_if(F.col("state") != "OPEN")).alias("merged_share"), share(merged, F.count_if(F.col("state") == "NONE")).alias("no_share"))


@query("FUN11_placeholders", "commits", sql="""SELECT pr_id, commit_ord,
       coalesce(nullif(regexp_replace(regexp_replace(message, '^\\s+', ''), '\\s+$', ''), ''), '(no message)') AS message FROM commits""")
def placeholders(commits):
    return commits.select("pr_id", "commit_ord", text.or_placeholder(F.col("message"), "(no message)").alias("message"))


@query("FUN7_directories", "files_changed", sql="""SELECT filename,
       CASE WHEN contains(filename, '/') THEN regexp_extract(filename, '^(.*)/', 1) ELSE '(repo root)' END AS directory,
       regexp_extract(filename, '[^/]*$') AS base_name, count(*) AS n FROM files_changed GROUP BY ALL""")
def paths(files_changed):
    name = F.col("filename")
    return files_changed.groupBy(
        "filename", text.directory(name).alias("directory"), text.base_name(name).alias("base_name")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("UDF3_generated_rows", "pull_requests", sql="""
    SELECT id, CAST(ord - 1 AS INTEGER) AS ord, label, CAST(length(label) AS INTEGER) AS chars FROM (
        SELECT id, unnest(labels) AS label, generate_subscripts(labels, 1) AS ord FROM pull_requests WHERE len(labels) > 0
        UNION ALL SELECT id, NULL, NULL FROM pull_requests WHERE labels IS NULL OR len(labels) = 0)""")
def generated_rows(pull_requests):
    """One row to many by a lateral join with a generator; a request without labels keeps a row."""
    spark = pull_requests.sparkSession
    rows = pull_requests.select("id", "labels").lateralJoin(
        spark.tvf.posexplode_outer(F.col("labels").outer()).toDF("ord", "label"))
    return rows.select("id", "ord", "label", F.length("label").alias("chars"))
