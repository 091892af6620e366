"""Queries over scores of recorded answers."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tributary.catalog.detection import human_sql
from tributary.catalog.features import HUMAN
from tributary.catalog.registry import query
from tributary.catalog.sampling import AI
from tributary.catalog.texts import ITEMS, LABEL, TRUTH, strip_sql
from tributary.operators import features, scoring, textmetrics

ERR = "coalesce(error, '') = ''"
REF_HUMAN = human_sql("author_login", r"\[bot\]")
REFS = f"SELECT pr_id, comment_id, {strip_sql('body')} AS text FROM review_comments WHERE {REF_HUMAN} AND length({TRUTH}) >= 12"


def pred_steps(grid: str, labels: str) -> dict[str, str]:
    return {
        "preds": f"""SELECT g.pr_id, context_kind, strategy, l.y, CASE WHEN {LABEL} = 'MERGE' THEN 1 ELSE 0 END AS pred,
            CASE WHEN {LABEL} IS NULL THEN 1 ELSE 0 END AS abstained FROM {grid} g JOIN {labels} l ON l.pr_id = g.pr_id
            WHERE task = 'merge_prediction' AND {ERR}""",
        "spread": """SELECT 'cell' AS scope, context_kind, strategy, y, pred, abstained FROM preds
            UNION ALL SELECT 'context', context_kind, '*', y, pred, abstained FROM preds
            UNION ALL SELECT 'strategy', '*', strategy, y, pred, abstained FROM preds
            UNION ALL SELECT 'pooled', '*', '*', y, pred, abstained FROM preds""",
        "conf": """SELECT scope, context_kind, strategy, count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp,
            count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 1 AND pred = 0) AS fn,
            CAST(sum(abstained) AS BIGINT) AS abstentions FROM spread GROUP BY ALL""",
        "scores": f"SELECT scope, context_kind, strategy, {METRIC_SQL}, abstentions FROM conf",
    }


METRIC_SQL = """tp + fp + tn + fn AS n, tp + fn AS n_merged, fp + tn AS n_not_merged,
    round(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0), 4) AS accuracy,
    round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision_merged, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall_merged,
    round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1_merged,
    round(coalesce(tn / nullif(tn + fn, 0), 0), 4) AS precision_not_merged, round(coalesce(tn / nullif(tn + fp, 0), 0), 4) AS recall_not_merged,
    round(coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0), 4) AS f1_not_merged,
    round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 4) AS macro_f1,
    tp, fp, tn, fn"""

HUMAN_STEPS = {"pop": HUMAN, **pred_steps("grid", "pop")}
AI_STEPS = {"ai_pop": AI, **pred_steps("tier_grid", "ai_pop")}


@query("FIL4_rows_to_score", "grid", "pull_requests", steps=HUMAN_STEPS,
       sql="SELECT pr_id, context_kind, strategy, y, CAST(pred AS BIGINT) AS pred, CAST(abstained AS BIGINT) AS abstained FROM preds")
def rows_to_score(grid, pull_requests):
    return scoring.predictions(grid, scoring.human_closed_labels(pull_requests))


@query("JOI8_labelled_grid_rows", "grid", "pull_requests",
       sql="SELECT g.pr_id, g.context_kind, g.strategy, g.task, p.title, p.repo FROM grid g LEFT JOIN pull_requests p ON p.id = g.pr_id")
def lookups(grid, pull_requests):
    titles = pull_requests.select(F.col("id").alias("pr_id"), "title", "repo")
    return grid.select("pr_id", "context_kind", "strategy", "task").join(titles, "pr_id", "left")


@query("AGG8_binary_metrics", "labels", sql_views=[], steps={
    "conf": """SELECT 'toxic' AS model, count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp,
        count(*) FILTER (quality = 0 AND toxic = 0) AS tn, count(*) FILTER (quality = 1 AND toxic = 0) AS fn FROM labels"""},
    sql=f"SELECT model, {METRIC_SQL} FROM conf")
def binary(labels):
    rows = labels.select(F.lit("toxic").alias("model"), F.col("quality").alias("y"), F.col("toxic").alias("pred"))
    return scoring.metrics(scoring.confusion(rows, ["model"])).drop("abstentions")


@query("AGG9_grid_scores", "grid", "pull_requests", steps=HUMAN_STEPS, sql="SELECT * FROM scores")
def grid_scores(grid, pull_requests):
    return scoring.merge_scores(grid, scoring.human_closed_labels(pull_requests))


def tier_scores(tier_grid, pull_requests):
    return scoring.merge_scores(tier_grid, features.ai_labelled(pull_requests))


query("AGG9_tier_scores", "tier_grid", "pull_requests", steps=AI_STEPS, sql="SELECT * FROM scores")(tier_scores)

MEANS = """SELECT strategy, round(avg(accuracy), 4) AS accuracy, round(avg(recall_not_merged), 4) AS not_merged_recall,
    round(avg(macro_f1), 4) AS macro_f1 FROM scores WHERE scope = 'cell' GROUP BY strategy"""


@query("AGG22_strategy_means", "grid", "pull_requests", steps=HUMAN_STEPS, sql=MEANS)
def means(grid, pull_requests):
    return scoring.strategy_means(grid_scores(grid, pull_requests))


@query("AGG23_headlines", "tier_grid", "pull_requests", steps=AI_STEPS,
       sql="""SELECT scope AS axis, CASE WHEN scope = 'context' THEN context_kind ELSE strategy END AS name, accuracy,
       recall_not_merged AS not_merged_recall, recall_not_merged > 0 AS catches_not_merged FROM scores WHERE scope IN ('context', 'strategy')""")
def headline(tier_grid, pull_requests):
    return scoring.headlines(tier_scores(tier_grid, pull_requests))


_FIRST = {("h_" + k if k in ("preds", "spread", "conf", "scores") else k): v for k, v in HUMAN_STEPS.items()}
_FIRST["h_spread"] = _FIRST["h_spread"].replace("FROM preds", "FROM h_preds")
_FIRST["h_conf"] = _FIRST["h_conf"].replace("FROM spread", "FROM h_spread")
_FIRST["h_scores"] = _FIRST["h_scores"].replace("FROM conf", "FROM h_conf")


@query("JOI10_shared_strategies", "grid", "tier_grid", "pull_requests",
       steps={**_FIRST, **AI_STEPS, "m": MEANS.replace("FROM scores", "FROM h_scores")},
       sql="""SELECT m.strategy, m.accuracy AS accuracy_first, m.not_merged_recall AS recall_first, m.macro_f1 AS macro_f1_first,
       s.accuracy AS accuracy_second, s.recall_not_merged AS recall_second, s.macro_f1 AS macro_f1_second,
       round(s.accuracy - m.accuracy, 4) AS delta_accuracy FROM m JOIN scores s ON s.scope = 'strategy' AND s.strategy = m.strategy
       WHERE m.strategy IN ('role_based', 'few_shot', 'cot')""")
def shared(grid, tier_grid, pull_requests):
    return scoring.compare_shared(means(grid, pull_requests), tier_scores(tier_grid, pull_requests))


# A score for every labelled request that needs no model: parts of its own columns.
SCORED = """SELECT repo AS model, pr_id, y, probability, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS pred FROM (
    SELECT id AS pr_id, repo, CAST(is_merged AS BIGINT) AS y, CAST((additions * 7 + number) % 97 AS DOUBLE) / 96 AS probability
    FROM pull_requests WHERE state <> 'OPEN') AS s"""
AUC = """SELECT model, round(sum(CASE WHEN y = 1 THEN r END) / nullif(sum(y) * sum(1 - y), 0)
    - (sum(y) + 1) / 2 / nullif(sum(1 - y), 0), 4) AS roc_auc FROM (SELECT model, y,
    rank() OVER (PARTITION BY model ORDER BY probability) + (count(*) OVER (PARTITION BY model, probability) - 1) / 2 AS r FROM scored) AS t
    GROUP BY model"""


def scored(pull_requests):
    probability = ((F.col("additions") * 7 + F.col("number")) % 97).cast("double") / 96
    return pull_requests.where("state <> 'OPEN'").select(
        F.col("repo").alias("model"), F.col("id").alias("pr_id"), F.col("is_merged").cast("long").alias("y"),
        probability.alias("probability"), (probability >= 0.5).cast("long").alias("pred"))


@query("WIN8_roc_auc", "pull_requests", steps={"scored": SCORED}, sql=AUC)
def auc(pull_requests):
    return scoring.roc_auc(scored(pull_requests), ["model"], "probability")


CONF_MODELS = """SELECT model, count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp,
    count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 1 AND pred = 0) AS fn FROM {} GROUP BY model"""


@query("AGG10_model_metrics", "pull_requests", steps={
    "scored": SCORED, "conf": CONF_MODELS.format("scored"), "auc": AUC, "base": f"SELECT model, {METRIC_SQL} FROM conf"},
    sql="SELECT * FROM base JOIN auc USING (model)")
def model_metrics(pull_requests):
    return scoring.model_metrics(scored(pull_requests))


@query("JOI9_same_rows", "pull_requests", "grid", steps={
    "scored": SCORED, "same": "SELECT * FROM scored WHERE pr_id IN (SELECT pr_id FROM grid)", "conf": CONF_MODELS.format("same")},
    sql=f"SELECT model, {METRIC_SQL} FROM conf")
def same_rows(pull_requests, grid):
    return scoring.same_rows(scored(pull_requests), grid)


MS = "coalesce(total_time * 1000, latency_ms)"


@query("AGG17_inference_times", "grid", sql=f"""SELECT task, context_kind, strategy, count(*) AS n, round(avg({MS}), 1) AS mean_ms,
       round(median({MS}), 1) AS median_ms FROM grid WHERE {ERR} AND {MS} IS NOT NULL GROUP BY ALL""")
def times(grid):
    return scoring.inference_times(grid)


TIER_MS = """CASE WHEN is_conversational THEN coalesce((CASE WHEN first_time IS NULL AND total_time IS NULL THEN NULL
    ELSE coalesce(first_time, 0) + coalesce(total_time, 0) END) * 1000, latency_ms) ELSE coalesce(total_time * 1000, latency_ms) END"""


def tier_rows(tier_grid):
    conv = F.col("is_conversational")
    return tier_grid.withColumn("turn_times", F.when(conv, F.array("first_time", "total_time"))).withColumn(
        "turn_texts", F.when(conv, F.array("first_text", "response_text")))


@query("AGG17_conversation_times", "tier_grid", sql=f"""SELECT task, context_kind, strategy, count(*) AS n, round(avg({TIER_MS}), 1) AS mean_ms,
       round(median({TIER_MS}), 1) AS median_ms, round(avg(CASE WHEN is_conversational THEN 2 ELSE 1 END), 2) AS mean_calls
       FROM tier_grid WHERE {ERR} AND {TIER_MS} IS NOT NULL GROUP BY ALL""")
def conversation_times(tier_grid):
    return scoring.inference_times(tier_rows(tier_grid), conversational=True)


@query("AGG18_review_verbosity", "tier_grid", steps={
    "r": f"""SELECT context_kind, strategy, CASE WHEN regexp_matches(response_text, '\\S') THEN {ITEMS} ELSE [] END AS items
        FROM tier_grid WHERE task = 'review_comment' AND {ERR} AND coalesce(response_text, '') <> ''""",
    "a": "SELECT 'context' AS axis, context_kind AS name, items FROM r UNION ALL SELECT 'strategy', strategy, items FROM r"},
    sql="""SELECT axis, name, count(*) AS n, round(avg(len(items)), 2) AS mean_n_comments,
    round(avg(length(array_to_string(items, chr(10)))), 1) AS mean_chars FROM a GROUP BY axis, name""")
def verbosity(tier_grid):
    return scoring.review_shape(tier_grid)


def completeness_sql(grid: str, labels: str, cells: int) -> str:
    return f"""SELECT count(*) AS n_prs_covered, count(*) FILTER (n = {cells}) AS n_prs_complete,
        count(*) FILTER (n = {cells} AND y = 1) AS complete_merged, count(*) FILTER (n = {cells} AND coalesce(y, 0) <> 1) AS complete_not_merged,
        CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(f) AS BIGINT) AS n_failures FROM (
        SELECT g.pr_id, any_value(l.y) AS y, count(*) AS n, count(*) FILTER (NOT {ERR}) AS f FROM {grid} g
        LEFT JOIN {labels} l ON l.pr_id = g.pr_id GROUP BY g.pr_id) AS t"""


@query("AGG20_grid_completeness", "grid", "pull_requests", steps={"pop": HUMAN}, sql=completeness_sql("grid", "pop", 32))
def complete(grid, pull_requests):
    return scoring.completeness(grid, scoring.human_closed_labels(pull_requests), 32)


@query("AGG20_tier_completeness", "tier_grid", "pull_requests", steps={"ai_pop": AI}, sql=completeness_sql("tier_grid", "ai_pop", 48))
def tier_complete(tier_grid, pull_requests):
    return scoring.completeness(tier_grid, features.ai_labelled(pull_requests), 48)


@query("TOP6_side_by_side", "grid", "review_comments", steps={
    "refs": REFS,
    "cell": f"""SELECT pr_id, repo, CASE WHEN regexp_matches(response_text, '\\S') THEN {ITEMS} ELSE [] END AS items FROM grid
        WHERE task = 'review_comment' AND {ERR} AND strategy = 'role_based' AND context_kind = 'diff_metadata'
        AND pr_id IN (SELECT pr_id FROM refs) ORDER BY pr_id LIMIT 8""",
    "h": """SELECT pr_id, string_agg(text, ' | ' ORDER BY comment_id) AS human FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY comment_id) AS i
        FROM refs) AS r WHERE i <= 4 GROUP BY pr_id"""},
    sql="SELECT pr_id, repo, array_to_string(list_slice(items, 1, 4), ' | ') AS generated, human FROM cell JOIN h USING (pr_id)")
def side_by_side(grid, review_comments):
    return scoring.side_by_side(grid, scoring.reference_comments(review_comments)).select(
        "pr_id", "repo", F.array_join("generated", " | ").alias("generated"), F.array_join("human", " | ").alias("human"))


def items_sql(column: str) -> str:
    return f"CASE WHEN regexp_matches({column}, '\\S') THEN {ITEMS.replace('response_text', column)} ELSE [] END"


@query("TOP6_turn_examples", "tier_grid", sql=f"""SELECT 'self_reflection' AS kind, pr_id, repo, context_kind AS tier,
       array_to_string(list_slice({items_sql('first_text')}, 1, 4), ' | ') AS first,
       array_to_string(list_slice({items_sql('response_text')}, 1, 4), ' | ') AS second FROM tier_grid
       WHERE task = 'review_comment' AND {ERR} AND strategy = 'self_reflection' ORDER BY pr_id, context_kind LIMIT 3""")
def turns(tier_grid):
    return scoring.turn_examples(tier_rows(tier_grid), "self_reflection").withColumn(
        "first", F.array_join("first", " | ")).withColumn("second", F.array_join("second", " | "))


# Text similarity.
HYP = f"""SELECT pr_id, context_kind, strategy, array_to_string(CASE WHEN regexp_matches(response_text, '\\S') THEN {ITEMS} ELSE [] END, chr(10)) AS hyp
    FROM grid WHERE task = 'review_comment' AND {ERR} AND pr_id IN (SELECT pr_id FROM refs)"""
MARKS = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(concat(' ', replace(replace(replace(replace(replace(replace(replace("
         "{0}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), ' '), "
         r"'([\{{-\~\[-\x60 -\&\(-\+\:-\@\/])', ' \1 ', 'g'), '([^0-9])([\.,])', '\1 \2 ', 'g'), '([\.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g')")


def gram_steps(tokens: str, max_n: int) -> dict[str, str]:
    def grams(source: str, keys: str) -> str:
        return " UNION ALL ".join(
            f"SELECT {keys}, {n} AS n, unnest(list_transform(range(1, len(tokens) - {n - 2}), lambda i: array_to_string(list_slice(tokens, i, i + {n - 1}), ' '))) AS gram FROM {source}"
            for n in range(1, max_n + 1))

    return {
        "refs": REFS,
        "ref_text": "SELECT pr_id, string_agg(text, ' ' ORDER BY comment_id) AS ref FROM refs GROUP BY pr_id",
        "hyps": HYP,
        "ref_tok": f"SELECT pr_id, {tokens.replace('{x}', 'ref')} AS tokens FROM ref_text",
        "hyp_tok": f"SELECT pr_id, context_kind, strategy, {tokens.replace('{x}', 'hyp')} AS tokens FROM hyps",
        "ref_g": f"SELECT pr_id, n, gram, count(*) AS rc FROM ({grams('ref_tok', 'pr_id')}) AS g GROUP BY ALL",
        "hyp_g": f"SELECT pr_id, context_kind, strategy, n, gram, count(*) AS hc FROM ({grams('hyp_tok', 'pr_id, context_kind, strategy')}) AS g GROUP BY ALL",
        "hits": """SELECT h.pr_id, h.context_kind, h.strategy, h.n, sum(least(hc, coalesce(rc, 0))) AS m, sum(hc) AS th FROM hyp_g h
            LEFT JOIN ref_g r ON r.pr_id = h.pr_id AND r.n = h.n AND r.gram = h.gram GROUP BY ALL""",
        "ref_n": "SELECT pr_id, n, sum(rc) AS tr FROM ref_g GROUP BY ALL",
    }


WORDS = "list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"
MARK_TOKENS = f"list_filter(regexp_split_to_array({MARKS.format('{x}')}, '\\s+'), lambda t: t <> '')"
ROUGE = """SELECT y.pr_id, y.context_kind, y.strategy,
    round(coalesce(max(CASE WHEN h.n = 1 THEN 2.0 * m / (th + tr) END), 0), 4)::DOUBLE AS rouge1,
    round(coalesce(max(CASE WHEN h.n = 2 THEN 2.0 * m / (th + coalesce(tr, 0)) END), 0), 4)::DOUBLE AS rouge2
    FROM hyps y LEFT JOIN hits h USING (pr_id, context_kind, strategy) LEFT JOIN ref_n r ON r.pr_id = h.pr_id AND r.n = h.n GROUP BY ALL"""
BLEU_WIDE = """SELECT y.pr_id, y.context_kind, y.strategy, """ + ", ".join(
    f"coalesce(max(m) FILTER (h.n = {n}), 0)::DOUBLE AS c{n}, coalesce(max(th) FILTER (h.n = {n}), 0)::DOUBLE AS t{n}" for n in range(1, 5)) + """,
    (SELECT coalesce(max(tr), 0) FROM ref_n r WHERE r.pr_id = y.pr_id AND r.n = 1)::DOUBLE AS rl
    FROM hyps y LEFT JOIN hits h USING (pr_id, context_kind, strategy) GROUP BY ALL"""


def _smooth(n: int) -> str:
    return " * ".join(f"CASE WHEN c{k} = 0 AND t{k} > 0 THEN 2.0 ELSE 1.0 END" for k in range(1, n + 1))


BLEU = f"""SELECT pr_id, context_kind, strategy, round(CASE WHEN greatest(c1, c2, c3, c4) > 0 THEN
    (CASE WHEN t1 < rl THEN exp(1 - rl / t1) ELSE 1.0 END) * exp(({" + ".join(
        f"CASE WHEN t{n} = 0 THEN 0.0 WHEN c{n} = 0 THEN ln(100.0 / ({_smooth(n)} * t{n})) ELSE ln(100.0 * c{n} / t{n}) END" for n in range(1, 5))})
    / ({" + ".join(f"CASE WHEN t{n} > 0 THEN 1 ELSE 0 END" for n in range(1, 5))})) ELSE 0.0 END, 3) AS bleu FROM wide"""


def _sides(grid, review_comments, tokenizer):
    from tributary.functions import answers

    references = scoring.reference_comments(review_comments)
    generated = scoring.usable_rows(grid, "review_comment").join(references.select("pr_id").distinct(), "pr_id", "left_semi")
    return (
        generated.select(*textmetrics.CELL, tokenizer(answers.review_text(F.col("response_text"))).alias("tokens")),
        references.select("pr_id", "comment_id", tokenizer(F.col("text")).alias("tokens")))


@query("MET1_rouge_1_2", "grid", "review_comments", steps={**gram_steps(WORDS, 2), "rg": ROUGE},
       sql="SELECT * FROM rg WHERE (pr_id, context_kind, strategy) IN (SELECT pr_id, context_kind, strategy FROM hyp_tok WHERE len(tokens) > 0)")
def rouge(grid, review_comments):
    return textmetrics.rouge_n(*_sides(grid, review_comments, textmetrics.word_tokens))


# The longest common subsequence: positions in the hypothesis of the reference's tokens, the later ones first for each token; the
# longest rising run of them, by the least last position of a run of each length.
LCS_STEPS = {
    "hyp_at": "SELECT pr_id, context_kind, strategy, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS j FROM hyp_tok",
    "ref_at": "SELECT pr_id, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS i FROM ref_tok",
    "met": """SELECT pr_id, context_kind, strategy, list([j] ORDER BY i, j DESC) AS js FROM hyp_at JOIN ref_at USING (pr_id, t) GROUP BY ALL""",
    "rising": """SELECT pr_id, context_kind, strategy, len(list_reduce(list_prepend(CAST([] AS BIGINT[]), js),
        lambda tails, x: tails[1:len(list_filter(tails, lambda y: y < x[1]))] || x || tails[len(list_filter(tails, lambda y: y < x[1])) + 2:])) AS lcs FROM met""",
    "rl": """SELECT h.pr_id, h.context_kind, h.strategy, round(CASE WHEN coalesce(lcs, 0) > 0 THEN 2.0 * lcs / (len(h.tokens) + len(r.tokens)) ELSE 0 END, 4)::DOUBLE AS "rougeL"
        FROM hyp_tok h JOIN ref_tok r USING (pr_id) LEFT JOIN rising USING (pr_id, context_kind, strategy)""",
}


@query("MET2_rouge_l", "grid", "review_comments", steps={**gram_steps(WORDS, 1), **LCS_STEPS}, sql="SELECT * FROM rl")
def rouge_l(grid, review_comments):
    return textmetrics.rouge_l(*_sides(grid, review_comments, textmetrics.word_tokens))


@query("MET3_bleu", "grid", "review_comments", steps={**gram_steps(MARK_TOKENS, 4), "wide": BLEU_WIDE, "bl": BLEU},
       sql="SELECT * FROM bl WHERE (pr_id, context_kind, strategy) IN (SELECT pr_id, context_kind, strategy FROM hyp_tok WHERE len(tokens) > 0)")
def bleu(grid, review_comments):
    return textmetrics.bleu(*_sides(grid, review_comments, textmetrics.mteval_tokens))


def renamed(steps: dict[str, str], ending: str) -> dict[str, str]:
    """The steps under names of their own."""
    names = re.compile(rf"\b({'|'.join(steps)})\b")
    return {f"{name}{ending}": names.sub(rf"\g<1>{ending}", text) for name, text in steps.items()}


TEXT_STEPS = {**renamed({**gram_steps(WORDS, 2), "rg": ROUGE, **LCS_STEPS}, "_w"), **renamed({**gram_steps(MARK_TOKENS, 4), "wide": BLEU_WIDE, "bl": BLEU}, "_m")}


@query("AGG19_mean_text_scores", "grid", "review_comments", steps=TEXT_STEPS, sql="""
    SELECT context_kind, strategy, count(*) AS n, count(DISTINCT pr_id) AS n_prs_with_ground_truth, round(avg(coalesce(bleu, 0)), 3) AS bleu,
        round(avg(coalesce(rouge1, 0)), 4) AS rouge1, round(avg(coalesce(rouge2, 0)), 4) AS rouge2, round(avg(coalesce("rougeL", 0)), 4) AS "rougeL"
    FROM hyps_w LEFT JOIN bl_m USING (pr_id, context_kind, strategy) LEFT JOIN rg_w USING (pr_id, context_kind, strategy)
    LEFT JOIN rl_w USING (pr_id, context_kind, strategy) GROUP BY ALL""")
def mean_scores(grid, review_comments):
    return textmetrics.mean_text_scores(textmetrics.text_scores(grid, scoring.reference_comments(review_comments)))
