"""Time splits per repository, and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary import fixed_values as fixed
from tributary.operators.ordering import day_bucket, ordinal
from tributary.operators.sampling import draw_order


def time_split(frame: DataFrame, fraction: float = fixed.TRAIN_FRACTION) -> DataFrame:
    """Add ``side``: the oldest ``int(n * fraction)`` rows of each repository are ``train``, the rest ``test``.

    Equal timestamps are ordered by id, missing ones come last; rows without a repository are left out.
    """
    placed = ordinal(frame.where(F.col("repo").isNotNull()), ["repo"], ["created_at", "pr_id"], day_bucket("created_at"), "_place")
    cut = F.floor(F.col("_place_of") * F.lit(fraction))
    return placed.withColumn("side", F.when(F.col("_place") <= cut, "train").otherwise("test")).drop("_place", "_place_of")


def split_cutoffs(split: DataFrame) -> DataFrame:
    """Sizes and boundary timestamps of the split of each repository."""
    train, test = F.col("side") == "train", F.col("side") == "test"
    return split.groupBy("repo").agg(
        F.count_if(train).alias("n_train"),
        F.count_if(test).alias("n_test"),
        F.max(F.when(train, F.col("created_at"))).alias("train_max_created_at"),
        F.min(F.when(test, F.col("created_at"))).alias("test_min_created_at"),
    )


def split_check(split: DataFrame, whole: DataFrame) -> DataFrame:
    """Ids on both sides, ids missing from the split, and ids the whole does not have; all 0 for a right split."""
    sides = split.groupBy("pr_id").agg(F.count_distinct("side").alias("sides"))
    both = whole.select("pr_id", F.lit(1).alias("_whole")).join(sides, "pr_id", "full")
    return both.agg(
        F.count_if(F.col("sides") > 1).alias("n_on_both_sides"),
        F.count_if(F.col("sides").isNull()).alias("n_missing"),
        F.count_if(F.col("_whole").isNull()).alias("n_extra"),
    )


def stratified_folds(frame: DataFrame, folds: int = fixed.FOLDS, seed: int = fixed.SEED) -> DataFrame:
    """Add ``fold``: each class dealt out in seeded order, so folds hold equal shares of it.

    Rows without a class are left out.
    """
    shuffled = frame.where(F.col("y").isNotNull()).withColumn("_draw", draw_order(F.col("pr_id"), seed))
    dealt = ordinal(shuffled, ["y"], ["_draw", "pr_id"], F.substring("_draw", 1, 3), "_turn")
    return dealt.withColumn("fold", ((F.col("_turn") - 1) % folds).cast("int")).drop("_draw", "_turn", "_turn_of")
