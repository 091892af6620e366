"""Pull-request tables derived from a star-schema dataset.

Each view is one SQL text that Spark and DuckDB both accept, up to the three
``$`` words below, so the operators and the SQL that checks them start from the
same rows.  Every view keeps its grain growing with its source table: no view
groups, and the size of one pull request does not grow with the dataset.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

SPARK_WORDS = {
    "$EXPLODE": "explode",
    "$KEEP_NAMED(": "filter(",
    "$LAMBDA x:": "x ->",
}
DUCKDB_WORDS = {
    "$EXPLODE": "unnest",
    "$KEEP_NAMED(": "list_filter(",
    "$LAMBDA x:": "lambda x:",
}

VIEWS = {
    "pull_requests": """
        SELECT o_orderkey AS id,
               concat('org/', lower(n_name)) AS repo,
               'org' AS owner,
               lower(n_name) AS repo_name,
               o_orderkey + 1 AS number,
               CASE WHEN o_orderkey % 43 = 0 THEN NULL
                    ELSE concat('Change ', o_orderkey, ' for ', lower(c_mktsegment)) END AS title,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL
                    WHEN o_orderkey % 17 = 0 THEN ''
                    WHEN o_orderkey % 19 = 0 THEN '   '
                    WHEN o_orderkey % 5 = 0 THEN concat('Update for ', c_name, '. Fixes #',
                         (o_orderkey % 40) * 25 + c_nationkey, ' and see #', o_orderkey % 4000)
                    WHEN o_orderkey % 7 = 0 THEN concat('Part of ', c_name, ', see #',
                         (o_orderkey % 4000) * 25 + c_nationkey, ' and #', (o_orderkey % 30) * 25 + c_nationkey)
                    WHEN o_orderkey % 11 = 0 THEN concat('See https://github.com/org/',
                         lower(n_name), '/issues/', (o_orderkey % 20) * 25 + c_nationkey, ' closes: gh-',
                         o_orderkey % 900, ' but not a/b#77 or #', o_orderkey % 900)
                    ELSE concat('Rework of ', c_name, chr(10), chr(10), 'No issue here.') END AS body,
               CASE WHEN o_custkey % 50 = 0 THEN NULL
                    WHEN o_custkey % 31 = 0 THEN 'Copilot-SWE-Agent[bot]'
                    WHEN o_custkey % 37 = 0 THEN 'dependabot'
                    WHEN o_custkey % 41 = 0 THEN 'coderabbitai'
                    WHEN o_custkey % 47 = 0 THEN 'build-bot'
                    ELSE c_name END AS author_login,
               CASE WHEN o_custkey % 50 = 0 THEN NULL
                    WHEN o_custkey % 31 = 0 OR o_custkey % 37 = 0 THEN 'Bot'
                    WHEN o_custkey % 41 = 0 THEN 'User'
                    WHEN o_custkey % 47 = 0 THEN 'Bot'
                    WHEN o_custkey % 53 = 0 THEN NULL
                    ELSE 'User' END AS author_type,
               o_orderdate AS created_at,
               CASE o_orderstatus WHEN 'F' THEN 'MERGED' WHEN 'O' THEN 'CLOSED' ELSE 'OPEN' END AS state,
               o_orderstatus = 'F' AS is_merged,
               CAST(CAST(floor(o_totalprice) AS BIGINT) % 500 AS BIGINT) AS additions,
               CAST(CAST(floor(o_totalprice) AS BIGINT) % 71 AS BIGINT) AS deletions,
               CAST(o_orderkey % 8 AS BIGINT) AS changed_files,
               $KEEP_NAMED(split(CASE WHEN o_orderkey % 3 = 0 THEN ''
                                WHEN o_orderkey % 4 = 0 THEN concat(lower(o_orderpriority), ';area-', o_custkey % 40)
                                ELSE lower(o_orderpriority) END, ';'), $LAMBDA x: x <> '') AS labels,
               o_orderpriority = '1-URGENT' AS is_ai_authored,
               o_orderkey % 3 = 0 AS is_ai_reviewed,
               CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 + o_orderkey % 2 ELSE 0 END AS BIGINT) AS n_ai_reviewers
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
    """,
    "files_changed": """
        SELECT l_orderkey AS pr_id,
               l_linenumber * 100000000000000000 + l_partkey * 1000000 + l_suppkey % 1000000 AS file_ord,
               concat(CASE WHEN p_size % 9 = 0 THEN ''
                           WHEN p_size % 4 = 0 THEN concat(lower(p_type), '/')
                           ELSE concat(lower(p_type), '/', lower(replace(p_brand, '#', '_')), '/') END,
                      replace(p_name, ' ', '_'),
                      CASE p_size % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.cs'
                                      WHEN 3 THEN '.MD' WHEN 4 THEN '.tsx' ELSE '' END) AS filename,
               CASE WHEN l_returnflag = 'A' THEN 'added'
                    WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'removed'
                    WHEN l_returnflag = 'R' THEN 'renamed' ELSE 'modified' END AS status,
               CASE WHEN p_size % 23 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS additions,
               CAST(round(l_discount * 100) AS BIGINT) AS deletions,
               CASE WHEN p_size % 11 = 0 THEN NULL
                    ELSE concat('@@ -1,2 +', l_linenumber * 10, ',4 @@ class ', replace(p_brand, '#', ''), chr(10),
                         '+if (', replace(p_name, ' ', '_'), ' && x) {{ return call(', l_quantity, '); }}', chr(10),
                         '-old ', p_type, chr(10), '     while (ready) step();', chr(10),
                         CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE concat(
                         '@@ -20,3 +40,3 @@ def ', lower(p_type), '(self)', chr(10),
                         '+    for item in items:', chr(10), '+        def inner(a): pass', chr(10),
                         '-    gone', chr(10), ' context (', chr(10)) END,
                         CASE WHEN l_linenumber % 3 = 0 THEN concat(chr(92), ' No newline at end of file') ELSE '' END)
                    END AS patch
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
    """,
    "commits": """
        SELECT CAST(floor(event_id / 4) AS BIGINT) AS pr_id,
               CAST(event_id % 4 AS BIGINT) AS commit_ord,
               concat('c', event_id) AS sha,
               CASE WHEN event_id % 97 = 0 THEN NULL
                    WHEN event_id % 53 = 0 THEN '  '
                    WHEN event_id % 41 = 0 THEN concat('Initial plan ', event_id)
                    WHEN event_id % 29 = 0 THEN concat(event_type, ' closes')
                    WHEN event_id % 29 = 1 THEN concat('  #', user_id, ' after a break')
                    ELSE concat(event_type, ': ', props, ' Fixes #', user_id) END AS message,
               CASE WHEN user_id % 17 = 0 THEN 'copilot-swe-agent[bot]' ELSE concat('dev', user_id) END AS author_name,
               CASE WHEN user_id % 13 = 0 THEN concat(user_id, '+Copilot@users.noreply.github.com')
                    WHEN user_id % 11 = 0 THEN concat('dev', user_id, '@users.noreply.github.com')
                    ELSE concat('dev', user_id, '@example.com') END AS author_email,
               CASE WHEN user_id % 5 = 0 THEN concat('dev', user_id)
                    WHEN user_id % 19 = 0 THEN 'Devin-AI-Integration[bot]' ELSE NULL END AS author_login,
               CAST(floor(value) AS BIGINT) AS additions,
               CAST(event_id % 9 AS BIGINT) AS deletions
        FROM {events}
    """,
    "reviews": """
        SELECT l_orderkey AS pr_id,
               concat('r', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS review_id,
               CASE WHEN s_suppkey % 7 = 0 THEN 'coderabbitai[bot]' WHEN s_suppkey % 23 = 0 THEN NULL
                    WHEN s_suppkey % 29 = 0 THEN 'Copilot-Pull-Request-Reviewer' ELSE s_name END AS reviewer_login,
               CASE WHEN s_suppkey % 7 = 0 THEN 'Bot' WHEN s_suppkey % 23 = 0 THEN NULL ELSE 'User' END AS reviewer_type,
               CASE l_returnflag WHEN 'A' THEN 'APPROVED' WHEN 'R' THEN 'CHANGES_REQUESTED' ELSE 'COMMENTED' END AS state,
               l_shipdate AS submitted_at
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey
    """,
    "review_comments": """
        SELECT CAST(floor(doc_id / 3) AS BIGINT) AS pr_id,
               doc_id AS comment_id,
               CASE WHEN doc_id % 11 = 0 THEN 'GitHub-Actions' WHEN doc_id % 13 = 0 THEN 'stale[bot]'
                    WHEN doc_id % 17 = 0 THEN 'bot-nightly' WHEN doc_id % 23 = 0 THEN 'release-bot'
                    WHEN doc_id % 29 = 0 THEN 'sourcery-ai[bot]'
                    WHEN doc_id % 19 = 0 THEN NULL ELSE source END AS author_login,
               CASE WHEN doc_id % 29 = 1 THEN 'LGTM'
                    WHEN doc_id % 31 = 1 THEN concat('```suggestion', chr(10), 'x = 1', chr(10), '```')
                    WHEN doc_id % 37 = 1 THEN NULL
                    ELSE text END AS body,
               'src/main.py' AS path
        FROM {documents}
    """,
    "issue_comments": """
        SELECT conv_id AS pr_id,
               conv_id * 1000 + turn AS comment_id,
               CASE WHEN conv_id % 6 = 0 THEN 'gemini-code-assist[bot]' WHEN conv_id % 5 = 0 THEN 'codecov'
                    ELSE concat('user', conv_id) END AS author_login,
               text AS body
        FROM {conversations} WHERE role = 'user'
    """,
    "issues": """
        SELECT concat('org/nation_', doc_id % 25) AS repo,
               doc_id AS number,
               CASE WHEN doc_id % 21 = 0 THEN NULL ELSE concat('Issue from ', source, ' ') END AS title,
               text AS body,
               doc_id % 9 = 0 AS is_pull_request,
               doc_id % 16 = 0 AS not_found
        FROM {documents}
    """,
    "answers": """
        SELECT conv_id * 8 + turn AS pr_id, conv_id, turn, text
        FROM {conversations} WHERE role = 'assistant'
    """,
    "grid_cells": """
        SELECT pr_id, conv_id, turn, text, context_kind, task, $EXPLODE(split('zero_shot,few_shot,cot,role_based', ',')) AS strategy
        FROM (SELECT pr_id, conv_id, turn, text, context_kind, $EXPLODE(split('merge_prediction,review_comment', ',')) AS task
              FROM (SELECT pr_id, conv_id, turn, text,
                           $EXPLODE(split('diff_only,diff_description,diff_commit_message,diff_metadata', ',')) AS context_kind
                    FROM {answers}) AS by_kind) AS by_task
    """,
    "grid": """
        SELECT pr_id, concat('org/nation_', pr_id % 25) AS repo, context_kind, task, strategy,
               CASE WHEN h % 41 = 0 THEN NULL
                    WHEN task = 'merge_prediction' THEN
                      CASE WHEN h % 9 = 0 THEN text
                           WHEN h % 9 = 1 THEN concat(text, chr(10), 'It may well merge.', chr(10),
                                'DECISION: will not merge, so CLOSE', chr(10), 'CONFIDENCE: ', h % 100, '%')
                           WHEN h % 9 = 2 THEN concat('I think it should be rejected.', chr(10), text, chr(10),
                                '**Decision = no**', chr(10), 'Confidence: .', h % 10)
                           WHEN h % 9 = 3 THEN concat(text, chr(10), 'Therefore it will be closed.', chr(10), '  ')
                           WHEN h % 9 = 4 THEN concat('DECISION: CLOSE', chr(10), text, chr(10),
                                'decision:', chr(10), ' Approved', chr(10), 'confidence: 1.7')
                           ELSE concat(text, chr(10), 'DECISION: MERGE', chr(10), 'CONFIDENCE: 0.', 50 + h % 50) END
                    ELSE
                      CASE WHEN h % 7 = 0 THEN text
                           WHEN h % 7 = 1 THEN concat('Preamble', chr(10), '<Review>', chr(10), '- ', text)
                           ELSE concat('Thinking.', chr(10), '<review>', chr(10), '1. Check the edge case ', h,
                                chr(10), '* ', text, chr(10), chr(10), '  2) Add a test', chr(10), '</review> bye') END
               END AS response_text,
               CASE WHEN h % 23 = 0 THEN 'api error' WHEN h % 29 = 0 THEN '' ELSE NULL END AS error,
               CASE WHEN h % 31 = 0 THEN NULL ELSE CAST(100 + h % 57 AS DOUBLE) END AS latency_ms,
               CASE WHEN h % 3 = 0 THEN NULL ELSE CAST(h % 40 AS DOUBLE) / 16 END AS total_time
        FROM (SELECT c.*, conv_id * 31 + turn * 7 + length(context_kind) * 3 + length(task) + length(strategy) * 5 AS h
              FROM {grid_cells} AS c) AS g
    """,
    "tier_cells": """
        SELECT * FROM (
        SELECT pr_id, conv_id, turn, text, context_kind, task,
               $EXPLODE(split('role_based,few_shot,cot,self_reflection,multi_turn', ',')) AS strategy
        FROM (SELECT pr_id, conv_id, turn, text, context_kind, $EXPLODE(split('merge_prediction,review_comment', ',')) AS task
              FROM (SELECT pr_id, conv_id, turn, text,
                           $EXPLODE(split('diff,diff_pr_description,diff_repo_context,diff_issue,complete_se_context', ',')) AS context_kind
                    FROM {answers}) AS by_kind) AS by_task) AS cells
        WHERE NOT (context_kind = 'diff' AND strategy = 'multi_turn')
    """,
    "tier_grid": """
        SELECT pr_id, concat('org/nation_', pr_id % 25) AS repo, context_kind, task, strategy,
               strategy IN ('self_reflection', 'multi_turn') AS is_conversational,
               concat('<review>', chr(10), '- draft ', h, chr(10), '- ', text, chr(10), '</review>') AS first_text,
               CASE WHEN h % 41 = 0 THEN NULL
                    WHEN task = 'merge_prediction' THEN
                      CASE WHEN h % 9 = 0 THEN text
                           WHEN h % 9 < 4 THEN concat(text, chr(10), 'DECISION: CLOSE', chr(10), 'CONFIDENCE: ', h % 100, '%')
                           ELSE concat(text, chr(10), 'DECISION: MERGE', chr(10), 'CONFIDENCE: 0.', 50 + h % 50) END
                    WHEN h % 7 = 1 THEN concat('Preamble', chr(10), '<review>', chr(10), '- ', text)
                    ELSE concat('<review>', chr(10), '- Check case ', h, chr(10), '- ', text, chr(10), '</review>') END AS response_text,
               CASE WHEN h % 23 = 0 THEN 'api error' WHEN h % 29 = 0 THEN '' ELSE NULL END AS error,
               CASE WHEN h % 31 = 0 THEN NULL ELSE CAST(100 + h % 57 AS DOUBLE) END AS latency_ms,
               CASE WHEN h % 3 = 0 THEN NULL ELSE CAST(h % 40 AS DOUBLE) / 16 END AS total_time,
               CASE WHEN h % 4 = 0 THEN NULL ELSE CAST(h % 25 AS DOUBLE) / 16 END AS first_time
        FROM (SELECT c.*, conv_id * 31 + turn * 7 + length(context_kind) * 3 + length(task) + length(strategy) * 5 AS h
              FROM {tier_cells} AS c) AS g
    """,
    "diffs": """
        SELECT o_orderkey AS diff_id,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('Change for ', c_name) END AS title,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('Touches ', lower(c_mktsegment), ' only') END AS description,
               CASE WHEN o_orderkey % 19 = 0 THEN concat('no diff here, only prose about ', c_name)
                    WHEN o_orderkey % 23 = 0 THEN ' '
                    WHEN o_orderkey % 29 = 0 THEN concat('--- a/src/bare_', o_custkey, '.py', chr(9), '2024-01-01', chr(10),
                         '+++ b/src/bare_', o_custkey, '.py  ', chr(10), '@@ -3,2 +', 3 + o_orderkey % 40, ',2 @@', chr(10),
                         '+value = ', o_custkey, chr(10), ' same', chr(10))
                    WHEN o_orderkey % 31 = 0 THEN concat('--- a/src/dropped_', o_custkey, '.ts', chr(10),
                         '+++ /dev/null', chr(10), '@@ -1,2 +0,0 @@', chr(10), '-gone one', chr(10), '-gone two')
                    ELSE concat('diff --git a/', lower(n_name), '/mod_', o_custkey % 50, '.py b/', lower(n_name), '/mod_', o_custkey % 50, '.py', chr(10),
                         'index 12..34 100644', chr(10),
                         '--- a/', lower(n_name), '/mod_', o_custkey % 50, '.py', chr(10),
                         '+++ b/', lower(n_name), '/mod_', o_custkey % 50, '.py', chr(10),
                         '@@ -1,3 +', 1 + o_orderkey % 90, ',4 @@ def outer_', o_custkey % 50, chr(10),
                         ' def helper_', o_custkey % 50, '(x):', chr(10),
                         '+    if x > ', o_orderkey % 90, ': return compute_total(x)', chr(10),
                         '-    return 0', chr(10), '+    for y in x: pass', chr(10), ' tail = 1', chr(10),
                         CASE WHEN o_orderkey % 3 = 0 THEN concat('@@ -40 +', 140 + o_orderkey % 9, ' @@', chr(10),
                              '--- was a comment', chr(10), '+unique_', o_orderkey, ' = 1', chr(10), chr(92), ' No newline at end of file', chr(10)) ELSE '' END,
                         CASE WHEN o_orderkey % 4 = 0 THEN concat('diff --git a/docs/new.md b/docs/new.md', chr(10),
                              'new file mode 100644', chr(10), '--- /dev/null', chr(10), '+++ b/docs/new.md', chr(10),
                              '@@ -0,0 +1,2 @@', chr(10), '+first ', c_name, chr(10), '+compute_total explained', chr(10)) ELSE '' END,
                         CASE WHEN o_orderkey % 6 = 0 THEN concat('diff --git a/web/old.ts b/web/new.ts', chr(10),
                              'similarity index 100%', chr(10), 'rename from web/old.ts', chr(10), 'rename to web/new.ts', chr(10)) ELSE '' END,
                         CASE WHEN o_orderkey % 10 = 0 THEN concat('diff --git a/api/Gone.cs b/api/Gone.cs', chr(10),
                              'deleted file mode 100644', chr(10), '--- a/api/Gone.cs', chr(10), '+++ /dev/null', chr(10),
                              '@@ -1,2 +0,0 @@', chr(10), '-class Gone {{ }}', chr(10), '-// end', chr(10)) ELSE '' END,
                         CASE WHEN o_orderkey % 14 = 0 THEN concat('diff --git a/img/a.png b/img/a.png', chr(10),
                              'Binary files a/img/a.png and b/img/a.png differ', chr(10)) ELSE '' END)
               END AS diff,
               CASE o_orderkey % 8
                    WHEN 0 THEN concat('In `mod_', o_custkey % 50, '.py` line ', 2 + o_orderkey % 90, ' the bound is odd.')
                    WHEN 1 THEN concat('`helper_', o_custkey % 50, '` in ', lower(n_name), '/mod_', o_custkey % 50, '.py. needs a test')
                    WHEN 2 THEN 'The call to `compute_total` may overflow'
                    WHEN 3 THEN concat('lines 999 of ./docs/new.md and `unique_', o_orderkey, '`')
                    WHEN 4 THEN 'Looks fine to me'
                    WHEN 5 THEN concat('Rename `x` in mod_', o_custkey % 50, '.py or `tail`')
                    WHEN 6 THEN concat('`unique_', o_orderkey, '` is never read; `first` neither')
                    ELSE 'See `web/new.ts`, it has no test' END AS comment
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
    """,
}


def _dependencies(name: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}", VIEWS[name])))


SPREAD_SPLITS = 16
TEXT_TABLES = ("lineitem", "orders", "events", "documents", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table.

    A table of fewer splits than the session has cores would be parsed by a few tasks only, so such a small table is
    spread first.  Tables of ``SPREAD_SPLITS`` splits or more are read as they are, on any number of cores: so what is shuffled
    for it is bounded.
    """
    table = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_TABLES and table.rdd.getNumPartitions() < min(cores, SPREAD_SPLITS):
        return table.repartition(min(cores, SPREAD_SPLITS))
    return table


def corpus_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view as a lazily built DataFrame."""
    if name in BASE_TABLES:
        return read_table(spark, sf_dir, name)
    text = VIEWS[name]
    for word, spelling in SPARK_WORDS.items():
        text = text.replace(word, spelling)
    inputs = {dep: corpus_view(spark, sf_dir, dep) for dep in _dependencies(name)}
    return spark.sql(text, **inputs)


def _with_parents(names: list[str]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in BASE_TABLES or name in ordered:
            return
        for dep in _dependencies(name):
            visit(dep)
        ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def check_sql(views: list[str], body: str, steps: dict[str, str] | None = None) -> str:
    """``WITH`` the named views (and further named steps) followed by ``body``, for DuckDB."""
    parts = []
    for name in _with_parents(views):
        text = VIEWS[name]
        for word, spelling in DUCKDB_WORDS.items():
            text = text.replace(word, spelling)
        text = text.format(**{dep: dep for dep in _dependencies(name)})
        parts.append(f"{name} AS ({text})")
    for name, text in (steps or {}).items():
        parts.append(f"{name} AS ({text})")
    prefix = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    return prefix + body
