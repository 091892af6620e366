"""Scores of recorded model answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary import fixed_values as fixed
from tributary.functions import answers
from tributary.functions.actors import is_human_author
from tributary.operators.ordering import prefix_sums, quantiles, unit_bucket, value_counts

ANY = "*"
COUNTS = ["tp", "fp", "tn", "fn", "abstentions"]
METRICS = [
    "n", "n_merged", "n_not_merged", "accuracy", "precision_merged", "recall_merged", "f1_merged",
    "precision_not_merged", "recall_not_merged", "f1_not_merged", "macro_f1", "tp", "fp", "tn", "fn",
]


def no_error(error: Column) -> Column:
    """An empty error text counts as none."""
    return F.coalesce(error, F.lit("")) == ""


def usable_rows(rows: DataFrame, task: str) -> DataFrame:
    """Rows of a task that ran without an error."""
    return rows.where((F.col("task") == task) & no_error(F.col("error")))


def human_closed_labels(pull_requests: DataFrame) -> DataFrame:
    from tributary.operators.features import human_closed

    return human_closed(pull_requests).select("pr_id", "y")


def predictions(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Parsed merge answers with their label; an answer without a decision predicts 0 and is an abstention."""
    parsed = usable_rows(rows, "merge_prediction").select(
        "pr_id", "context_kind", "strategy", answers.decision(F.col("response_text")).alias("_label"))
    return parsed.join(labels.select("pr_id", "y"), "pr_id").select(
        "pr_id", "context_kind", "strategy", "y",
        F.when(F.col("_label") == "MERGE", 1).otherwise(0).cast("long").alias("pred"),
        F.col("_label").isNull().cast("long").alias("abstained"),
    )


def confusion(frame: DataFrame, keys: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Confusion counts per group."""
    actual, guessed = F.col(y), F.col(pred)
    abstained = F.col("abstained") if "abstained" in frame.columns else F.lit(0)
    return frame.groupBy(*keys).agg(
        F.count_if((actual == 1) & (guessed == 1)).alias("tp"),
        F.count_if((actual == 0) & (guessed == 1)).alias("fp"),
        F.count_if((actual == 0) & (guessed == 0)).alias("tn"),
        F.count_if((actual == 1) & (guessed == 0)).alias("fn"),
        F.sum(abstained).cast("long").alias("abstentions"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, per-class and macro scores from confusion counts; an empty denominator gives 0."""
    tp, fp, tn, fn = (F.col(c) for c in COUNTS[:4])
    f1_merged, f1_not = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    keys = [c for c in counts.columns if c not in COUNTS]
    return counts.select(
        *keys,
        (tp + fp + tn + fn).alias("n"), (tp + fn).alias("n_merged"), (fp + tn).alias("n_not_merged"),
        F.round(_ratio(tp + tn, tp + fp + tn + fn), 4).alias("accuracy"),
        F.round(_ratio(tp, tp + fp), 4).alias("precision_merged"),
        F.round(_ratio(tp, tp + fn), 4).alias("recall_merged"),
        F.round(f1_merged, 4).alias("f1_merged"),
        F.round(_ratio(tn, tn + fn), 4).alias("precision_not_merged"),
        F.round(_ratio(tn, tn + fp), 4).alias("recall_not_merged"),
        F.round(f1_not, 4).alias("f1_not_merged"),
        F.round((f1_merged + f1_not) / 2, 4).alias("macro_f1"),
        *COUNTS,
    )


def merge_scores(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Metrics per cell, per context, per strategy and pooled.

    ``*`` marks a pooled axis.  The rows are counted once per cell; the coarser
    scopes add up those few counts.
    """
    cells = confusion(predictions(rows, labels), ["context_kind", "strategy"])
    scopes = F.array(*[
        F.struct(F.lit(scope).alias("scope"), context.alias("context_kind"), strategy.alias("strategy"))
        for scope, context, strategy in [
            ("cell", F.col("context_kind"), F.col("strategy")),
            ("context", F.col("context_kind"), F.lit(ANY)),
            ("strategy", F.lit(ANY), F.col("strategy")),
            ("pooled", F.lit(ANY), F.lit(ANY)),
        ]
    ])
    spread = cells.select(F.explode(scopes).alias("_s"), *COUNTS).select("_s.*", *COUNTS)
    return metrics(spread.groupBy("scope", "context_kind", "strategy").agg(*[F.sum(c).alias(c) for c in COUNTS]))


def roc_auc(frame: DataFrame, keys: Sequence[str], score: str, y: str = "y", digits: int | None = 4) -> DataFrame:
    """Area under the ROC curve per group, equal scores counted half.

    Equal scores collapse to one row before anything is ordered; the negatives
    below a score are a prefix sum over score buckets.  Scores lie in [0, 1]; rows
    without a score are left out.
    """
    counts = frame.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    ranked = prefix_sums(counts, list(keys), [score], ["neg"], unit_bucket(score))
    won = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    area = F.try_divide(won, pairs)
    return ranked.groupBy(*keys).agg((area if digits is None else F.round(area, digits)).alias("roc_auc"))


def model_metrics(scored: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Test metrics with ROC-AUC per model, from ``y, pred, probability``."""
    keys = list(keys)
    return metrics(confusion(scored, keys)).drop("abstentions").join(roc_auc(scored, keys, "probability"), keys)


def completeness(rows: DataFrame, labels: DataFrame, cells_per_pr: int) -> DataFrame:
    """Requests covered and complete (exactly the full number of cells), outcomes among complete, failures."""
    per_pr = rows.groupBy("pr_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~no_error(F.col("error"))).alias("failed"))
    joined = per_pr.join(labels.select("pr_id", "y"), "pr_id", "left")
    complete = F.col("n") == cells_per_pr
    merged = F.count_if(complete & (F.coalesce("y", F.lit(0)) == 1))
    return joined.agg(
        F.count(F.lit(1)).alias("n_prs_covered"),
        F.count_if(complete).alias("n_prs_complete"),
        merged.alias("complete_merged"),
        (F.count_if(complete) - merged).alias("complete_not_merged"),
        F.sum("n").alias("n_rows"),
        F.sum("failed").alias("n_failures"),
    )


def server_ms() -> Column:
    """Server time of a one-turn answer in ms, wall clock when the server gave none."""
    return F.coalesce(F.col("total_time") * 1000.0, F.col("latency_ms"))


def conversation_ms() -> Column:
    """Server time over all turns that report one, wall clock when none does."""
    known = F.filter("turn_times", lambda t: t.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, t: a + t) * 1000.0
    in_turns = F.coalesce(F.col("is_conversational") & (F.size("turn_times") > 0), F.lit(False))
    return F.when(in_turns, F.when(F.size(known) > 0, total).otherwise(F.col("latency_ms"))).otherwise(server_ms())


def inference_times(rows: DataFrame, conversational: bool = False) -> DataFrame:
    """Mean and median time per (task, context, strategy); with conversations also the mean number of calls."""
    keys = ["task", "context_kind", "strategy"]
    ms = conversation_ms() if conversational else server_ms()
    in_turns = F.coalesce(F.col("is_conversational") & (F.size("turn_times") > 0), F.lit(False)) if conversational else F.lit(False)
    calls = F.when(in_turns, F.size("turn_times")).otherwise(1) if conversational else F.lit(1)
    timed = rows.where(no_error(F.col("error"))).select(*keys, ms.alias("ms"), calls.alias("calls")).where("ms IS NOT NULL")
    means = timed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("ms"), 1).alias("mean_ms"), F.round(F.avg("calls"), 2).alias("mean_calls"))
    medians = quantiles(value_counts(timed, keys, "ms"), keys, "ms", {"median_ms": 0.5})
    joined = means.join(medians.withColumn("median_ms", F.round("median_ms", 1)), keys)
    return joined if conversational else joined.drop("mean_calls")


def review_shape(rows: DataFrame) -> DataFrame:
    """Mean number of comments and characters of generated reviews, by context and by strategy."""
    shaped = usable_rows(rows, "review_comment").where(F.coalesce("response_text", F.lit("")) != "").select(
        "context_kind", "strategy", answers.review_comments(F.col("response_text")).alias("_c")
    ).select(
        "context_kind", "strategy", F.size("_c").alias("n_comments"), F.length(F.array_join("_c", "\n")).alias("chars"))
    cells = shaped.groupBy("context_kind", "strategy").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_comments").alias("n_comments"), F.sum("chars").alias("chars"))
    axes = F.array(
        F.struct(F.lit("context").alias("axis"), F.col("context_kind").alias("name")),
        F.struct(F.lit("strategy").alias("axis"), F.col("strategy").alias("name")))
    spread = cells.select(F.explode(axes).alias("_a"), "n", "n_comments", "chars").select("_a.*", "n", "n_comments", "chars")
    total = F.sum("n")
    return spread.groupBy("axis", "name").agg(
        total.alias("n"),
        F.round(F.sum("n_comments") / total, 2).alias("mean_n_comments"),
        F.round(F.sum("chars") / total, 1).alias("mean_chars"))


def strategy_means(scores: DataFrame) -> DataFrame:
    """Mean over contexts of the per-cell metrics of each strategy (a mean of means)."""
    return scores.where(F.col("scope") == "cell").groupBy("strategy").agg(*[
        F.round(F.avg(c), 4).alias(name)
        for c, name in [("accuracy", "accuracy"), ("recall_not_merged", "not_merged_recall"), ("macro_f1", "macro_f1")]
    ])


def compare_shared(first: DataFrame, second: DataFrame, shared: Sequence[str] = fixed.SHARED_STRATEGIES) -> DataFrame:
    """Metrics of two grids side by side for the strategies both ran, with the accuracy difference.

    ``first`` are strategy means, ``second`` merge scores of the other grid.
    """
    left = first.select(
        "strategy", F.col("accuracy").alias("accuracy_first"), F.col("not_merged_recall").alias("recall_first"),
        F.col("macro_f1").alias("macro_f1_first"))
    right = second.where(F.col("scope") == "strategy").select(
        "strategy", F.col("accuracy").alias("accuracy_second"), F.col("recall_not_merged").alias("recall_second"),
        F.col("macro_f1").alias("macro_f1_second"))
    return left.where(F.col("strategy").isin(list(shared))).join(right, "strategy").withColumn(
        "delta_accuracy", F.round(F.col("accuracy_second") - F.col("accuracy_first"), 4))


def headlines(scores: DataFrame) -> DataFrame:
    """Accuracy and minority recall along each axis, and whether the minority class is ever caught."""
    return scores.where(F.col("scope").isin("context", "strategy")).select(
        F.col("scope").alias("axis"),
        F.when(F.col("scope") == "context", F.col("context_kind")).otherwise(F.col("strategy")).alias("name"),
        "accuracy", F.col("recall_not_merged").alias("not_merged_recall"),
        (F.col("recall_not_merged") > 0).alias("catches_not_merged"))


def same_rows(scored: DataFrame, covered: DataFrame) -> DataFrame:
    """Metrics of models on only the requests that another run covered."""
    return metrics(confusion(scored.join(covered.select("pr_id").distinct(), "pr_id", "left_semi"), ["model"])).drop("abstentions")


def reference_comments(review_comments: DataFrame) -> DataFrame:
    """``pr_id, comment_id, text``: substantive human comments, the truth for generated reviews."""
    human = review_comments.where(is_human_author(F.col("author_login"), name_patterns=False))
    return human.select("pr_id", "comment_id", answers.substantive_comment(F.col("body")).alias("text")).where("text IS NOT NULL")


def side_by_side(
    rows: DataFrame, references: DataFrame, strategy: str = "role_based", context_kind: str = "diff_metadata",
    limit: int = 8, shown: int = 4,
) -> DataFrame:
    """The first generated reviews of one cell with human comments of the same request."""
    cell = usable_rows(rows, "review_comment").where(
        (F.col("strategy") == strategy) & (F.col("context_kind") == context_kind))
    with_truth = cell.join(references.select("pr_id").distinct(), "pr_id", "left_semi")
    chosen = with_truth.orderBy("pr_id").limit(limit).select(
        "pr_id", "repo", F.slice(answers.review_comments(F.col("response_text")), 1, shown).alias("generated"))
    from tributary.operators.sampling import first_k

    human = first_k(references.join(chosen.select("pr_id"), "pr_id", "left_semi"), ["pr_id"], ["comment_id"], shown)
    gathered = human.groupBy("pr_id").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("_h"))
    return chosen.join(gathered, "pr_id").select(
        "pr_id", "repo", "generated", F.transform("_h", lambda h: h["text"]).alias("human"))


def turn_examples(rows: DataFrame, strategy: str, limit: int = 3, shown: int = 4) -> DataFrame:
    """The first two-turn reviews of a strategy: comments of the first and of the second turn."""
    texts = F.col("turn_texts")
    return (
        usable_rows(rows, "review_comment")
        .where((F.col("strategy") == strategy) & (F.size(texts) >= 2))
        .orderBy("pr_id", "context_kind")
        .limit(limit)
        .select(
            F.lit(strategy).alias("kind"), "pr_id", "repo", F.col("context_kind").alias("tier"),
            F.slice(answers.review_comments(texts[0]), 1, shown).alias("first"),
            F.slice(answers.review_comments(texts[1]), 1, shown).alias("second"))
    )
