"""Queries over answer parsing, references and contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.catalog.detection import human_sql
from tributary.catalog.features import HUMAN
from tributary.catalog.registry import query
from tributary.catalog.sampling import AI_SPLIT_STEPS, BEST_COMMENT
from tributary.functions import answers, references, text
from tributary.operators import contexts, features, issues, similar, splits
from tributary.plans.augmented import augmented_context
from tributary.session import cut_lineage


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def rstrip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '\s+$', '')"


def cut_sql(x: str, limit: int, marker: str) -> str:
    return f"CASE WHEN length({x}) > {limit} THEN concat({rstrip_sql(f'substr({x}, 1, {limit})')}, '{marker}') ELSE {x} END"


ALL_TOKENS = "merged|merge|accepted|accept|approved|approve|closed|close|rejected|reject|declined|decline"


def token_sql(x: str, tokens: str) -> str:
    last = rf"lower(regexp_extract({x}, '(?is)^.*\b({tokens})\b', 1))"
    return f"""CASE WHEN {last} IN ('merged','merge','accepted','accept','approved','approve','yes') THEN 'MERGE'
        WHEN {last} IN ('closed','close','rejected','reject','declined','decline','no') THEN 'CLOSE' END"""


STATED = r"regexp_extract_all(response_text, '(?i)decision\s*[:=]\s*(.+)', 1)"
TAIL = rf"list_filter(string_split(response_text, chr(10)), lambda l: regexp_matches(l, '\S'))[-1]"
CONF = r"regexp_extract(response_text, '(?i)confidence\s*[:=]\s*([0-9]*\.?[0-9]+)\s*(%?)', {})"
LABEL = f"""CASE WHEN regexp_matches(response_text, '\\S') THEN CASE WHEN len({STATED}) > 0
    THEN {token_sql(STATED + '[-1]', ALL_TOKENS + '|yes|no')} ELSE {token_sql(TAIL, ALL_TOKENS)} END END"""
CONFIDENCE = f"""CASE WHEN regexp_matches(response_text, '\\S') AND TRY_CAST({CONF.format(1)} AS DOUBLE) IS NOT NULL THEN greatest(0.0, least(1.0,
    TRY_CAST({CONF.format(1)} AS DOUBLE) / CASE WHEN {CONF.format(2)} = '%' THEN 100 ELSE 1 END)) END"""
BLOCK = r"""CASE WHEN regexp_matches(response_text, '(?is)<review>\s*(.*?)\s*</review>')
    THEN regexp_extract(response_text, '(?is)<review>\s*(.*?)\s*</review>', 1)
    WHEN regexp_matches(response_text, '(?is)<review>\s*(.*)') THEN regexp_extract(response_text, '(?is)<review>\s*(.*)', 1)
    ELSE response_text END"""
ITEMS = (f"list_filter(list_transform(string_split({BLOCK}, chr(10)), lambda l: "
         + strip_sql(r"regexp_replace(" + strip_sql("l") + r", '^([-*•]|[0-9]+[.)])\s+', '')") + "), lambda l: l <> '')")
PARSED = f"""SELECT pr_id, context_kind, task, strategy, {LABEL} AS label, {CONFIDENCE} AS confidence FROM grid"""
REVIEWS = f"""SELECT pr_id, context_kind, task, strategy,
    CASE WHEN regexp_matches(response_text, '\\S') THEN {ITEMS} ELSE [] END AS items FROM grid"""


@query("PAR1_merge_decision", "grid", sql=PARSED + " WHERE task = 'merge_prediction'")
def decisions(grid):
    raw = F.col("response_text")
    return grid.where("task = 'merge_prediction'").select(
        "pr_id", "context_kind", "task", "strategy", answers.decision(raw).alias("label"),
        answers.confidence(raw).alias("confidence"))


@query("PAR2_review_block", "grid", steps={"r": REVIEWS},
       sql="""SELECT pr_id, context_kind, strategy, CAST(len(items) AS BIGINT) AS n_comments,
       md5(array_to_string(items, chr(10))) AS text_key, CAST(length(array_to_string(items, chr(10))) AS BIGINT) AS chars
       FROM r WHERE task = 'review_comment'""")
def review_blocks(grid):
    items = answers.review_comments(F.col("response_text"))
    return grid.where("task = 'review_comment'").select("pr_id", "context_kind", "strategy", items.alias("items")).select(
        "pr_id", "context_kind", "strategy", F.size("items").cast("long").alias("n_comments"),
        F.md5(F.array_join("items", "\n")).alias("text_key"), F.length(F.array_join("items", "\n")).cast("long").alias("chars"))


TRUTH = strip_sql("replace(replace(" + strip_sql("body") + ", '```suggestion', ''), '```', '')")


@query("FIL3_substantive_comments", "review_comments",
       sql=f"SELECT comment_id, pr_id, md5({strip_sql('body')}) AS text_key FROM review_comments WHERE length({TRUTH}) >= 12")
def substantive(review_comments):
    return review_comments.select("comment_id", "pr_id", answers.substantive_comment(F.col("body")).alias("t")).where(
        "t IS NOT NULL").select("comment_id", "pr_id", F.md5("t").alias("text_key"))


CLOSING = r"(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?|implement[sd]?|address(?:e[sd])?)\b\s*:?\s+(?:#|gh-)(\d+)"
URL = r"(?i)https?://github\.com/[\w.-]+/[\w.-]+/issues/(\d+)"
BARE = r"(?:^|[^\w/])#(\d+)\b"


def numbers_sql(x: str, pattern: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), '{pattern}', 1), lambda n: CAST(n AS BIGINT))"


def ordered_distinct_sql(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


CLOSING_LIST = f"list_concat({numbers_sql('body', CLOSING)}, {numbers_sql('body', URL)})"


@query("PAR3_issue_references", "pull_requests", steps={
    "c": f"SELECT id, {CLOSING_LIST} AS closing, {numbers_sql('body', BARE)} AS bare FROM pull_requests",
    "d": f"""SELECT id, {ordered_distinct_sql('closing')} AS closing, {ordered_distinct_sql('bare')} AS bare FROM c""",
    "e": "SELECT id, closing, list_filter(bare, lambda b: NOT list_contains(closing, b)) AS mentioned FROM d"},
    sql="""SELECT id, array_to_string(closing, ',') AS closing, array_to_string(mentioned, ',') AS mentioned,
    array_to_string(CASE WHEN len(closing) > 0 THEN closing ELSE mentioned END, ',') AS best FROM e""")
def issue_references(pull_requests):
    body = F.col("body")

    def joined(column):
        return F.array_join(column.cast("array<string>"), ",")

    return pull_requests.select(
        "id", joined(references.closing_references(body)).alias("closing"),
        joined(references.mentioned_references(body)).alias("mentioned"), joined(references.best_references(body)).alias("best"))


@query("SET4_mentioned_minus_closing", "pull_requests", steps={
    "c": f"SELECT id, {CLOSING_LIST} AS closing, {numbers_sql('body', BARE)} AS bare FROM pull_requests"},
    sql="""SELECT id, CAST(len(list_distinct(bare)) AS BIGINT) AS n_bare,
    CAST(len(list_filter(list_distinct(bare), lambda b: NOT list_contains(closing, b))) AS BIGINT) AS n_mentioned FROM c""")
def minus(pull_requests):
    body = F.col("body")
    return pull_requests.select(
        "id", F.size(F.array_distinct(references.numbers(body, references.BARE_REFERENCE))).cast("long").alias("n_bare"),
        F.size(references.mentioned_references(body)).cast("long").alias("n_mentioned"))


ISSUE_STEPS = {
    "msgs": """SELECT pr_id, string_agg(message, chr(10) ORDER BY commit_ord) AS blob FROM commits
        WHERE message IS NOT NULL GROUP BY pr_id""",
    "blobs": """SELECT p.id AS pr_id, p.repo, concat_ws(chr(10), nullif(p.body, ''), nullif(m.blob, '')) AS body
        FROM pull_requests p LEFT JOIN msgs m ON m.pr_id = p.id""",
    "c": f"SELECT pr_id, repo, {CLOSING_LIST} AS closing, {numbers_sql('body', BARE)} AS bare FROM blobs",
    "best": "SELECT pr_id, repo, CASE WHEN len(closing) > 0 THEN closing ELSE bare END AS nums FROM c",
    "tried": "SELECT pr_id, repo, unnest(nums) AS number, unnest(range(1, len(nums) + 1)) AS i FROM best",
    "linked": f"""SELECT pr_id, number, {cut_sql('txt', 600, ' ... [truncated for length]')} AS issue_text FROM (
        SELECT t.pr_id, t.number, {strip_sql("concat('Issue #', t.number, ': ', " + strip_sql("coalesce(s.title, '')") + ", chr(10), chr(10), " + strip_sql("coalesce(s.body, '')") + ")")} AS txt
        FROM tried t JOIN issues s ON s.repo = t.repo AND s.number = t.number
        WHERE NOT s.not_found AND NOT s.is_pull_request
        QUALIFY row_number() OVER (PARTITION BY t.pr_id ORDER BY t.i) = 1) AS x""",
}


@query("SRC8_linked_issue", "pull_requests", "commits", "issues", steps=ISSUE_STEPS, sql="SELECT * FROM linked")
def linked_issue(pull_requests, commits, issue_table):
    return issues.linked_issue_text(pull_requests, commits, issue_table)


HEAD = r"^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@\s*(.+)$"
HEADINGS_RAW = (f"list_filter(list_transform(regexp_extract_all(coalesce(patch, ''), '(?m){HEAD}', 1), "
                f"lambda h: {strip_sql('h')}), lambda h: h <> '')")
HEADINGS = f"list_slice(list_filter({HEADINGS_RAW}, lambda v, i: list_position({HEADINGS_RAW}, v) = i), 1, 5)"


@query("PAR4_hunk_headings", "files_changed",
       sql=f"SELECT pr_id, file_ord, array_to_string({HEADINGS}, '; ') AS headings FROM files_changed")
def headings(files_changed):
    return files_changed.select("pr_id", "file_ord", F.array_join(references.hunk_headings(F.col("patch")), "; ").alias("headings"))


@query("TOP2_files_by_churn", "files_changed",
       sql="""SELECT pr_id, file_ord, filename, row_number() OVER (PARTITION BY pr_id
       ORDER BY coalesce(additions, 0) + coalesce(deletions, 0) DESC, file_ord) AS position FROM files_changed QUALIFY position <= 20""")
def by_churn(files_changed):
    from tributary.operators.sampling import first_k

    size = F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0))
    return first_k(files_changed, ["pr_id"], [F.desc(size), "file_ord"], 20).select("pr_id", "file_ord", "filename", "position")


@query("FUN6_truncation", "documents", sql_views=[],
       sql=f"""SELECT doc_id, CASE WHEN length(text) > 500 THEN concat(substr(text, 1, 500), chr(10), '... [file diff truncated]') ELSE text END AS plain,
       {cut_sql(strip_sql('text'), 600, ' ... [truncated for length]')} AS trimmed FROM documents""")
def truncated(documents):
    from tributary import fixed_values as fixed

    return documents.select(
        "doc_id", text.truncate(F.col("text"), 500, fixed.FILE_MARKER).alias("plain"),
        text.truncate(text.strip(F.col("text")), 600, fixed.SECTION_MARKER, right_trim=True).alias("trimmed"))


@query("FUN10_13_14_15_readings", "pull_requests", steps={"r": "SELECT avg(CAST(is_merged AS INTEGER)) AS base FROM pull_requests"},
       sql="""SELECT id, CASE WHEN is_merged THEN 'MERGE' ELSE 'CLOSE' END AS label,
       CASE WHEN coalesce(repo, '') <> '' THEN concat('the ', repo, ' project') ELSE 'a large open-source project' END AS project,
       CASE WHEN abs((id % 1000) / 1000 - (SELECT base FROM r)) <= 0.02 THEN 'level with'
            WHEN (id % 1000) / 1000 > (SELECT base FROM r) THEN 'above' ELSE 'below' END AS standing,
       CASE WHEN length(trim(regexp_replace(body, '\\s+', ' ', 'g'))) > 60
            THEN concat(substr(trim(regexp_replace(body, '\\s+', ' ', 'g')), 1, 59), '…')
            ELSE trim(regexp_replace(body, '\\s+', ' ', 'g')) END AS inline
       FROM pull_requests""")
def readings(pull_requests):
    base = pull_requests.agg(F.avg(F.col("is_merged").cast("int")))
    probability = (F.col("id") % 1000).cast("double") / 1000
    return pull_requests.select(
        "id", text.class_label(F.col("is_merged").cast("int")).alias("label"), text.project_phrase(F.col("repo")).alias("project"),
        text.standing(probability, base.scalar(), 0.02).alias("standing"), text.inline_label(F.col("body"), 60).alias("inline"))


@query("FUN8_iso_timestamps", "pull_requests",
       sql="""SELECT id, created_at AS instant, CAST(NULL AS TIMESTAMP) AS bad FROM pull_requests""")
def iso(pull_requests):
    written = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return pull_requests.select(
        "id", text.iso_instant(written).cast("timestamp_ntz").alias("instant"),
        text.iso_instant(F.concat(F.lit("not "), written)).cast("timestamp_ntz").alias("bad"))


# Greedy packing as a recursion over the blocks of a request.
def pack_steps(source: str, name: str, budget: int) -> dict[str, str]:
    return {
        f"{name}_n": f"SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY o1, o2) AS i FROM {source}",
        f"{name}_f": f"""SELECT pr_id, i, total, keep FROM (
            WITH RECURSIVE walk AS (
                SELECT pr_id, i, CASE WHEN length(block) <= {budget} THEN length(block) ELSE 0 END AS total,
                       length(block) <= {budget} AS keep FROM {name}_n WHERE i = 1
                UNION ALL
                SELECT n.pr_id, n.i, CASE WHEN w.total + length(n.block) <= {budget} THEN w.total + length(n.block) ELSE w.total END,
                       w.total + length(n.block) <= {budget}
                FROM walk w JOIN {name}_n n ON n.pr_id = w.pr_id AND n.i = w.i + 1)
            SELECT * FROM walk) AS r""",
    }


def diff_steps(budget: int, file_limit: int, files: str = "files_changed", prefix: str = "") -> dict[str, str]:
    return {
        f"{prefix}fblocks": f"""SELECT pr_id, -(coalesce(additions, 0) + coalesce(deletions, 0)) AS o1, file_ord AS o2,
            CASE WHEN coalesce(patch, '') <> '' THEN concat('--- ', filename, ' (', status, ')', chr(10),
                 CASE WHEN length(patch) > {file_limit} THEN concat(substr(patch, 1, {file_limit}), chr(10), '... [file diff truncated]') ELSE patch END)
                 ELSE concat('--- ', filename, ' (', status, ', no textual diff)') END AS block FROM {files}""",
        **pack_steps(f"{prefix}fblocks", f"{prefix}fb", budget),
        f"{prefix}diff": f"""SELECT pr_id, concat(coalesce(string_agg(block, chr(10) || chr(10) ORDER BY i) FILTER (keep), ''),
            CASE WHEN count(*) FILTER (NOT keep) > 0 THEN concat(chr(10), chr(10), '... [', count(*) FILTER (NOT keep),
            ' additional changed file(s) omitted for length]') ELSE '' END) AS diff
            FROM {prefix}fb_n JOIN {prefix}fb_f USING (pr_id, i) GROUP BY pr_id""",
    }


def commit_steps(budget: int, commits: str = "commits", prefix: str = "") -> dict[str, str]:
    return {
        f"{prefix}cblocks": f"""SELECT pr_id, commit_ord AS o1, 0 AS o2, concat(commit_ord + 1, '. ', {strip_sql('message')}) AS block
            FROM {commits} WHERE regexp_matches(coalesce(message, ''), '\\S')""",
        **pack_steps(f"{prefix}cblocks", f"{prefix}cb", budget),
        f"{prefix}cpacked": f"""SELECT pr_id, string_agg(block, chr(10) ORDER BY i) FILTER (keep) AS txt, count(*) FILTER (NOT keep) AS left_out
            FROM {prefix}cb_n JOIN {prefix}cb_f USING (pr_id, i) GROUP BY pr_id""",
        f"{prefix}cmsg": f"""SELECT pr_id, CASE WHEN txt IS NULL THEN '(no non-empty commit messages)' ELSE concat(txt,
            CASE WHEN left_out > 0 THEN concat(chr(10), '... [', left_out, ' additional commit message(s) omitted for length]') ELSE '' END)
            END AS commit_message FROM (SELECT DISTINCT pr_id FROM {commits}) LEFT JOIN {prefix}cpacked USING (pr_id)""",
    }


META_STEPS = {
    "flist": """SELECT pr_id, count(*) AS n, string_agg(concat('  - ', filename, ' (', status, ')'), chr(10) ORDER BY file_ord)
        FILTER (pos <= 30) AS names FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY file_ord) AS pos FROM files_changed) AS f
        GROUP BY pr_id""",
    "meta": """SELECT id AS pr_id, concat_ws(chr(10), concat('Labels: ', CASE WHEN len(labels) > 0 THEN array_to_string(labels, ', ') ELSE '(none)' END),
        concat('Size: ', coalesce(n, 0), ' file(s) changed, +', coalesce(additions, 0), '/-', coalesce(deletions, 0), ' lines'),
        'Changed files:', names, CASE WHEN n > 30 THEN concat('  ... and ', n - 30, ' more file(s)') END) AS metadata
        FROM pull_requests LEFT JOIN flist ON flist.pr_id = pull_requests.id""",
}


@query("WIN7_packed_diffs", "files_changed", steps=diff_steps(160, 90), sql="SELECT * FROM diff")
def packed(files_changed):
    return contexts.diff_text(files_changed, 160, 90)


EQUAL_BLOCKS = """SELECT pr_id % 7 AS part, pr_id, file_ord,
    concat('--- ', lpad(CAST(pr_id AS VARCHAR), 9, '0'), lpad(CAST(file_ord AS VARCHAR), 4, '0')) AS block FROM files_changed"""


@query("WIN7_large_budget", "files_changed", steps={"blocks": EQUAL_BLOCKS}, sql="""
    SELECT part, string_agg(block, chr(10) ORDER BY pr_id, file_ord) FILTER (nth <= 200000 // 17) AS text,
        least(count(*), 200000 // 17) AS n_kept, count(*) AS n_blocks
    FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY pr_id, file_ord) AS nth FROM blocks) GROUP BY part""")
def packed_large(files_changed):
    """Thousands of blocks of one length, and a budget for nearly twelve thousand."""
    number = lambda name, width: F.lpad(F.col(name).cast("string"), width, "0")
    blocks = files_changed.select((F.col("pr_id") % 7).alias("part"), "pr_id", "file_ord",
                                  F.concat(F.lit("--- "), number("pr_id", 9), number("file_ord", 4)).alias("block"))
    return contexts.pack(blocks, "part", ["pr_id", "file_ord"], 200_000, "\n", shortest=4)


@query("CTX1_diff_text", "files_changed", steps=diff_steps(16000, 4000), sql="SELECT * FROM diff")
def diffs(files_changed):
    return contexts.diff_text(files_changed)


@query("CTX2_commit_messages", "commits", steps=commit_steps(60), sql="SELECT * FROM cmsg")
def commit_messages(commits):
    return contexts.commit_text(commits, 60)


@query("CTX3_TOP5_metadata", "pull_requests", "files_changed", steps=META_STEPS, sql="SELECT pr_id, metadata FROM meta")
def metadata(pull_requests, files_changed):
    return contexts.metadata_text(pull_requests, files_changed)


CONTEXT_STEPS = {
    **diff_steps(16000, 4000), **commit_steps(4000), **META_STEPS,
    "parts": f"""SELECT p.id AS pr_id, coalesce(nullif({strip_sql('p.body')}, ''), '(no PR description provided)') AS body,
        concat('Diff:', chr(10), coalesce(d.diff, '(no file diff available)')) AS diff,
        coalesce(c.commit_message, '(no commit messages available)') AS msgs, m.metadata FROM pull_requests p
        LEFT JOIN diff d ON d.pr_id = p.id LEFT JOIN cmsg c ON c.pr_id = p.id LEFT JOIN meta m ON m.pr_id = p.id""",
    "kinds": """SELECT pr_id, 'diff_only' AS context_kind, diff AS t FROM parts
        UNION ALL SELECT pr_id, 'diff_description', concat('PR description:', chr(10), body, chr(10), chr(10), diff) FROM parts
        UNION ALL SELECT pr_id, 'diff_commit_message', concat('Commit messages:', chr(10), msgs, chr(10), chr(10), diff) FROM parts
        UNION ALL SELECT pr_id, 'diff_metadata', concat(metadata, chr(10), chr(10), diff) FROM parts""",
}


@query("CTX4_whole_contexts", "pull_requests", "files_changed", "commits", steps=CONTEXT_STEPS,
       sql="SELECT pr_id, context_kind, CAST(length(t) AS BIGINT) AS chars, md5(t) AS text_key FROM kinds")
def whole_kinds(*tables):
    return contexts.pr_contexts(*tables).select(
        "pr_id", "context_kind", F.length("context_text").cast("long").alias("chars"), F.md5("context_text").alias("text_key"))


@query("CTX4_context_kinds", "pull_requests", "files_changed", "commits", steps=CONTEXT_STEPS,
       sql="""SELECT pr_id, context_kind, CAST(length(c) AS BIGINT) AS chars, md5(c) AS text_key FROM (SELECT pr_id, context_kind,
       CASE WHEN length(t) > 700 THEN concat(substr(t, 1, 700), chr(10), '... [context truncated to fit the LLM token budget]') ELSE t END AS c
       FROM kinds) AS k""")
def kinds(*tables):
    return contexts.pr_contexts(*tables, context_limit=700).select(
        "pr_id", "context_kind", F.length("context_text").cast("long").alias("chars"), F.md5("context_text").alias("text_key"))


def repo_steps(max_files: int, files: str = "files_changed") -> dict[str, str]:
    return {
        "rfiles": f"""SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY coalesce(additions, 0) + coalesce(deletions, 0) DESC, file_ord) AS pos,
            CASE WHEN contains(filename, '/') THEN regexp_extract(filename, '^(.*)/', 1) ELSE '(repo root)' END AS folder,
            array_to_string({HEADINGS}, '; ') AS heads FROM {files} QUALIFY pos <= {max_files}""",
        "rdirs": """SELECT pr_id, string_agg(concat('- ', folder, '/  (', n, ' file(s))'), chr(10) ORDER BY first) AS spans, count(*) AS k
            FROM (SELECT pr_id, folder, count(*) AS n, min(pos) AS first FROM rfiles GROUP BY pr_id, folder) AS g GROUP BY pr_id""",
        "rview": """SELECT f.pr_id, concat_ws(chr(10), 'Files touched by this change (repository-level view):',
            string_agg(concat('- ', filename, ' (', status, ')', CASE WHEN heads <> '' THEN concat(chr(10),
            '    enclosing region(s) (git hunk headings): ', heads) ELSE '' END), chr(10) ORDER BY pos),
            CASE WHEN any_value(k) > 1 THEN concat(chr(10), 'Directories spanned:', chr(10), any_value(spans)) END,
            concat(chr(10), '(Approximate: derived from the diff''s own file list and git hunk headings, not from fetched file bodies or a call graph.)'))
            AS repo_context FROM rfiles f JOIN rdirs d ON d.pr_id = f.pr_id GROUP BY f.pr_id""",
    }


@query("CTX5_repository_context", "files_changed", steps=repo_steps(20), sql="SELECT * FROM rview")
def repository(files_changed):
    return contexts.repo_context(files_changed)


SIMILAR_STEPS = {
    **AI_SPLIT_STEPS, "best_comment": BEST_COMMENT,
    "folders": """SELECT DISTINCT pr_id, CASE WHEN contains(filename, '/') THEN regexp_extract(filename, '^(.*)/', 1) ELSE '(repo root)' END AS folder
        FROM files_changed""",
    "fsize": "SELECT pr_id, count(*) AS n FROM folders GROUP BY pr_id",
    "pairs": """SELECT q.pr_id, c.pr_id AS past_pr_id, b.chars, b.comment_id, b.body, q.repo FROM ai_split q
        JOIN ai_split c ON c.repo = q.repo AND c.side = 'train' AND c.pr_id <> q.pr_id JOIN best_comment b ON b.pr_id = c.pr_id
        WHERE q.side = 'test'""",
    "shared": """SELECT p.pr_id, p.past_pr_id, count(*) AS k FROM pairs p JOIN folders a ON a.pr_id = p.pr_id
        JOIN folders b ON b.pr_id = p.past_pr_id AND b.folder = a.folder GROUP BY 1, 2""",
    "sim_rows": """SELECT p.pr_id, p.past_pr_id, p.chars, p.comment_id, p.body, p.repo,
        coalesce(CAST(s.k AS DOUBLE) / (coalesce(fa.n, 0) + coalesce(fb.n, 0) - s.k), 0.0) AS similarity,
        row_number() OVER (PARTITION BY p.pr_id ORDER BY
            coalesce(CAST(s.k AS DOUBLE) / (coalesce(fa.n, 0) + coalesce(fb.n, 0) - s.k), 0.0) DESC, p.chars DESC, p.past_pr_id) AS rank
        FROM pairs p LEFT JOIN shared s USING (pr_id, past_pr_id) LEFT JOIN fsize fa ON fa.pr_id = p.pr_id
        LEFT JOIN fsize fb ON fb.pr_id = p.past_pr_id QUALIFY rank <= 3""",
}


def _ai_split(pull_requests):
    return cut_lineage(splits.time_split(features.ai_labelled(pull_requests)))


def _similar(pull_requests, files_changed, review_comments, busy=5, k=3):
    split = _ai_split(pull_requests)
    return similar.similar_comments(
        split.where("side = 'test'"), split.where("side = 'train'"), files_changed, review_comments, k, busy)


@query("JOI7_TOP3_similar_past_comments", "pull_requests", "files_changed", "review_comments", steps=SIMILAR_STEPS,
       sql="SELECT pr_id, rank, past_pr_id, round(similarity, 9) AS similarity, chars, comment_id FROM sim_rows")
def similar_rows(*tables):
    return _similar(*tables).select(
        "pr_id", "rank", "past_pr_id", F.round("similarity", 9).alias("similarity"), "chars", "comment_id")


@query("CTX6_historical_comments", "pull_requests", "files_changed", "review_comments", steps=SIMILAR_STEPS,
       sql=f"""SELECT s.pr_id, string_agg(concat('On a past PR in ', s.repo, ' ("', coalesce(nullif({strip_sql('p.title')}, ''), '(no title)'),
       '"), a reviewer commented:', chr(10), '"', {cut_sql(strip_sql('s.body'), 350, ' ...')}, '"'), chr(10) || chr(10) ORDER BY rank) AS historical_comments
       FROM sim_rows s JOIN pull_requests p ON p.id = s.past_pr_id GROUP BY s.pr_id""")
def historical(pull_requests, files_changed, review_comments):
    return similar.historical_comments(_similar(pull_requests, files_changed, review_comments), pull_requests)


@query("SET2_folder_sets", "files_changed", steps={
    "f": """SELECT pr_id, status, CASE WHEN contains(filename, '/') THEN regexp_extract(filename, '^(.*)/', 1) ELSE '(repo root)' END AS folder
        FROM files_changed""",
    "a": "SELECT pr_id, list(DISTINCT folder) AS l FROM f WHERE status = 'added' GROUP BY pr_id",
    "m": "SELECT pr_id, list(DISTINCT folder) AS l FROM f WHERE status = 'modified' GROUP BY pr_id"},
    sql="""SELECT pr_id, CAST(len(a.l) AS BIGINT) AS n_left, CAST(len(m.l) AS BIGINT) AS n_right,
    CAST(len(list_intersect(a.l, m.l)) AS BIGINT) AS n_shared, CAST(len(list_distinct(list_concat(a.l, m.l))) AS BIGINT) AS n_united,
    round(len(list_intersect(a.l, m.l)) / len(list_distinct(list_concat(a.l, m.l))), 6) AS jaccard FROM a JOIN m USING (pr_id)""")
def folder_sets(files_changed):
    def of(status, name):
        return similar.changed_folders(files_changed.where(F.col("status") == status)).groupBy("pr_id").agg(
            F.collect_set("folder").alias(name))

    return similar.folder_overlap(of("added", "left_folders"), of("modified", "right_folders"))


@query("CTX10_demonstration_context", "pull_requests", "files_changed", steps={
    "d": """SELECT pr_id, string_agg(concat('--- ', filename, chr(10), patch), chr(10) ORDER BY file_ord) AS diff
        FROM files_changed WHERE coalesce(patch, '') <> '' GROUP BY pr_id"""},
    sql="""SELECT p.id AS pr_id, concat(CASE WHEN coalesce(p.title, '') <> '' THEN concat('Title: ', p.title, chr(10)) ELSE '' END,
    CASE WHEN d.diff IS NULL THEN '(no file diff available)' ELSE concat('Diff:', chr(10), CASE WHEN length(d.diff) > 1500
    THEN concat(substr(d.diff, 1, 1500), chr(10), '... [diff truncated]') ELSE d.diff END) END) AS context_text
    FROM pull_requests p LEFT JOIN d ON d.pr_id = p.id""")
def demonstration(pull_requests, files_changed):
    return contexts.demonstration_context(pull_requests, files_changed)


CAPS = [50, 100, 150, 200, 400, 800]


@query("AGG30_cap_coverage", "files_changed", steps={
    "s": "SELECT pr_id, sum(length(coalesce(patch, ''))) AS size FROM files_changed GROUP BY pr_id"},
    sql=" UNION ALL ".join(
        f"SELECT CAST({c} AS BIGINT) AS cap, count(*) FILTER (size <= {c}) AS n_fit, count(*) AS n, "
        f"round(count(*) FILTER (size <= {c}) / count(*), 4) AS share FROM s" for c in CAPS))
def coverage(files_changed):
    sizes = files_changed.groupBy("pr_id").agg(F.sum(text.chars(F.col("patch"))).alias("size"))
    return contexts.cap_coverage(sizes, "size", CAPS)


SLOTS = "pr_description commit_message repo_context issue_text historical_comments".split()
AUGMENTED_STEPS = {
    **SIMILAR_STEPS,
    "asked": "SELECT pr_id FROM ai_split WHERE side = 'test'",
    "afiles": "SELECT * FROM files_changed WHERE pr_id IN (SELECT pr_id FROM asked)",
    "acommits": "SELECT * FROM commits WHERE pr_id IN (SELECT pr_id FROM asked)",
    **diff_steps(1200, 500, "afiles", "a"), **commit_steps(600, "acommits", "a"), **repo_steps(8, "afiles"), **ISSUE_STEPS,
    "hist": f"""SELECT s.pr_id, string_agg(concat('On a past PR in ', s.repo, ' ("', coalesce(nullif({strip_sql('p.title')}, ''), '(no title)'),
        '"), a reviewer commented:', chr(10), '"', {cut_sql(strip_sql('s.body'), 350, ' ...')}, '"'), chr(10) || chr(10) ORDER BY rank) AS historical_comments
        FROM sim_rows s JOIN pull_requests p ON p.id = s.past_pr_id WHERE rank <= 2 GROUP BY s.pr_id""",
    "augmented": f"""SELECT p.id AS pr_id, p.repo, p.title, coalesce(adiff.diff, '(no file diff available)') AS diff,
        nullif({cut_sql(strip_sql("coalesce(p.body, '')"), 600, ' ... [truncated for length]')}, '') AS pr_description,
        coalesce(acmsg.commit_message, '(no commit messages available)') AS commit_message,
        {cut_sql(strip_sql('rview.repo_context'), 600, ' ... [truncated for length]')} AS repo_context, linked.issue_text, hist.historical_comments
        FROM asked JOIN pull_requests p ON p.id = asked.pr_id LEFT JOIN adiff ON adiff.pr_id = p.id LEFT JOIN acmsg ON acmsg.pr_id = p.id
        LEFT JOIN rview ON rview.pr_id = p.id LEFT JOIN linked ON linked.pr_id = p.id LEFT JOIN hist ON hist.pr_id = p.id""",
}
AUGMENTED = ["pull_requests", "files_changed", "commits", "review_comments", "issues"]


def build_augmented(pull_requests, files_changed, commits, review_comments, issue_table):
    split = _ai_split(pull_requests)
    return augmented_context(
        split.where("side = 'test'"), pull_requests, files_changed, commits, review_comments,
        split.where("side = 'train'"), issue_table)


@query("CTX9_augmented_context", *AUGMENTED, steps=AUGMENTED_STEPS, sql="SELECT * FROM augmented")
def augmented(*tables):
    return build_augmented(*tables)


@query("AGG31_slot_availability", *AUGMENTED, steps=AUGMENTED_STEPS,
       sql="SELECT count(*) AS n_prs, " + ", ".join(
           f"round(avg(CASE WHEN regexp_matches(coalesce({s}, ''), '\\S') THEN 1 ELSE 0 END), 4) AS {s}" for s in SLOTS) + " FROM augmented")
def availability(*tables):
    return contexts.slot_availability(build_augmented(*tables))


def section_sql(heading, column, note):
    return f"concat('{heading}:', chr(10), coalesce(nullif({strip_sql(column)}, ''), '({note})'))"


def tier_sql() -> str:
    from tributary import fixed_values as fixed

    parts = []
    diff = f"concat('Diff:', chr(10), coalesce(nullif({strip_sql('diff')}, ''), '(no file diff available)'))"
    for tier in fixed.TIERS:
        added = [section_sql(*s) for s in fixed.TIER_SECTIONS[tier]]
        whole = f"concat_ws(chr(10) || chr(10), {', '.join([*added, diff])})"
        second = f"concat_ws(chr(10) || chr(10), {', '.join(added)})" if added else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT pr_id, repo, title, '{tier}' AS context_kind, {whole} AS context_text, {diff} AS first_text, {second} AS second_text FROM augmented")
    return " UNION ALL ".join(parts)


TIER_STEPS = {**AUGMENTED_STEPS, "tiers": tier_sql()}


@query("CTX7_tiers", *AUGMENTED, steps=TIER_STEPS, sql="SELECT pr_id, context_kind, context_text FROM tiers")
def tiers(*tables):
    return contexts.tier_contexts(build_augmented(*tables)).select("pr_id", "context_kind", "context_text")


@query("CTX8_two_turn_split", *AUGMENTED, steps=TIER_STEPS,
       sql="SELECT pr_id, context_kind, first_text, second_text FROM tiers WHERE second_text IS NOT NULL")
def two_turn(*tables):
    return contexts.tier_contexts(build_augmented(*tables)).where("second_text IS NOT NULL").select(
        "pr_id", "context_kind", "first_text", "second_text")
