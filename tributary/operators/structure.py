"""Approximate code structure of changed files, rolled up per pull request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions import patches
from tributary.operators.stats import share

def hunk_structure(files_changed: DataFrame) -> DataFrame:
    """One row per hunk of a file in an analysed language, with the counts over its text after the change."""
    lang, text = F.col("language"), F.col("text")
    exploded = (
        files_changed.select("pr_id", "file_ord", "filename", "patch", patches.language(F.col("filename")).alias("language"))
        .where(lang.isNotNull())
        .select("pr_id", "file_ord", "filename", "language",
                F.posexplode(patches.post_images(F.col("patch"))).alias("hunk", "text"))
    )
    return exploded.select(
        "pr_id", "file_ord", "filename", "language", F.col("hunk").cast("long").alias("hunk"), "text",
        patches.hunk_decisions(lang, text).alias("decisions"),
        patches.hunk_functions(lang, text).alias("functions"),
        patches.hunk_tokens(text).alias("tokens"),
        patches.hunk_depth(text).alias("depth"),
        patches.hunk_balanced(text).alias("balanced"),
    )


def _file_struct():
    """Counts of one file, folded over its hunks inside the row."""
    lang = F.col("language")
    images = F.when(lang.isNotNull(), patches.post_images(F.col("patch"))).otherwise(F.array().cast("array<string>"))
    per_hunk = F.transform(
        images,
        lambda t: F.struct(
            patches.hunk_balanced(t).cast("long").alias("parsed"),
            patches.hunk_tokens(t).alias("tokens"),
            patches.hunk_depth(t).alias("depth"),
            patches.hunk_decisions(lang, t).alias("decisions"),
            patches.hunk_functions(lang, t).alias("functions"),
        ),
    )
    return per_hunk


def _sum(field: str):
    return F.aggregate(F.col("_hunks"), F.lit(0).cast("long"), lambda acc, h: acc + h[field])


def file_structure(files_changed: DataFrame, *kept: str) -> DataFrame:
    """One row per changed file: language and structure counts, 0 where nothing was analysed; the ``kept`` columns stay beside them."""
    zero = F.lit(0).cast("long")
    hunks = (
        files_changed.withColumn("language", patches.language(F.col("filename")))
        .withColumn("_hunks", _file_struct())
        .withColumn("n_hunks", F.size("_hunks").cast("long"))
        .withColumn("n_hunks_parsed", _sum("parsed"))
        .withColumn("_decisions", _sum("decisions"))
    )
    return hunks.select(
        "pr_id", "file_ord", "filename", "status", *kept, "language",
        patches.hunk_count(F.col("patch")).alias("n_markers"),
        "n_hunks", "n_hunks_parsed",
        F.when(F.col("language") == "python", F.col("n_hunks_parsed")).otherwise(F.col("n_hunks")).alias("n_hunks_cfg_ok"),
        _sum("tokens").alias("ast_node_count"),
        F.coalesce(F.array_max(F.transform("_hunks", lambda h: h["depth"])), zero).alias("ast_max_depth"),
        (F.col("_decisions") + F.col("n_hunks")).alias("cfg_node_count"),
        (F.col("_decisions") * 2).alias("cfg_edge_count"),
        (F.col("_decisions") + F.col("n_hunks")).alias("cyclomatic_proxy"),
        _sum("functions").alias("num_functions"),
    )


def structure_columns() -> list[Column]:
    """Aggregates over the per-file structure rows of a pull request."""
    return [
        F.sum("ast_node_count").alias("s_ast_node_count"),
        F.max("ast_max_depth").alias("s_ast_max_depth"),
        F.sum("cfg_node_count").alias("s_cfg_node_count"),
        F.sum("cfg_edge_count").alias("s_cfg_edge_count"),
        F.sum("cyclomatic_proxy").alias("s_cyclomatic_proxy"),
        F.sum("num_functions").alias("s_num_functions_touched"),
        F.max(F.col("language").isNotNull().cast("long")).alias("s_has_parseable_code"),
    ]


def structure_by_pr(file_table: DataFrame) -> DataFrame:
    """Sums, deepest nesting, whether any file was analysable, and the parse rate (null without hunks)."""
    return file_table.groupBy("pr_id").agg(
        *structure_columns(),
        F.sum("n_hunks").alias("diag_n_hunks_attempted"),
        F.sum("n_hunks_parsed").alias("diag_n_hunks_parsed"),
        F.sum("n_hunks_cfg_ok").alias("diag_n_hunks_cfg_ok"),
        F.try_divide(F.sum("n_hunks_parsed").cast("double"), F.sum("n_hunks").cast("double")).alias("diag_parse_rate"),
    )


def fidelity_report(file_table: DataFrame) -> DataFrame:
    """Files, patches, hunks and rates per language; files of other languages under ``unsupported``."""
    counts = file_table.groupBy(F.coalesce("language", F.lit("unsupported")).alias("language")).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(F.col("n_hunks") > 0).alias("n_files_with_patch"),
        F.sum("n_hunks").alias("n_hunks_attempted"),
        F.sum("n_hunks_parsed").alias("n_hunks_parsed_ok"),
        F.sum("n_hunks_cfg_ok").alias("n_hunks_cfg_ok"),
    )
    return counts.select(
        "language", "n_files", "n_files_with_patch",
        (F.col("n_files") - F.col("n_files_with_patch")).alias("n_files_no_patch"),
        "n_hunks_attempted", "n_hunks_parsed_ok",
        share(F.col("n_hunks_parsed_ok"), F.col("n_hunks_attempted")).alias("hunk_parse_rate"),
        F.when(F.col("language") == "python", F.col("n_hunks_cfg_ok")).alias("n_hunks_cfg_ok"),
        F.when(F.col("language") == "python", share(F.col("n_hunks_cfg_ok"), F.col("n_hunks_parsed_ok")))
        .alias("cfg_success_rate_given_parsed"),
    )
