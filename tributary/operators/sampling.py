"""Deterministic selection: quotas, rounds, seeded and balanced draws.

Selections that keep k rows per group filter on ``row_number() <= k`` with a
constant k, which Spark applies inside every map task before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary import fixed_values as fixed
from tributary.functions import text
from tributary.functions.actors import is_human_author
from tributary.operators.ordering import day_bucket, ordinal


def draw_order(key: Column, seed: int) -> Column:
    """A reproducible shuffle: rows sorted by this value are in seeded random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


#: Up to this k Spark prunes inside the map tasks by itself, whatever the session sets.
PRUNED_BY_SPARK = 1000
PARTS = 64


def first_k(frame: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, name: str = "position") -> DataFrame:
    """The first ``k`` rows of each group with their position.

    For a large k the rows of a group are cut into parts by hash, and only the first k of each part meet.
    """
    if k > PRUNED_BY_SPARK:
        part = F.pmod(F.xxhash64(*[c for c, kind in frame.dtypes if not kind.startswith("map")]), F.lit(PARTS))
        inside = Window.partitionBy(*keys, "__part").orderBy(*order)
        frame = frame.withColumn("__part", part).withColumn("__nth", F.row_number().over(inside)).where(F.col("__nth") <= k).drop("__part", "__nth")
    window = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn(name, F.row_number().over(window).cast("long")).where(F.col(name) <= k)


def distinct_in_order(frame: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key by ``order``; copies collapse before the shuffle."""
    keys = list(keys)
    rest = [c for c in frame.columns if c not in keys]
    return (
        frame.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*frame.columns)
    )


def quota_fill(
    priority: DataFrame, recency: DataFrame,
    target: int = fixed.TARGET_PER_REPO, cap: int = fixed.PRIORITY_CAP,
) -> DataFrame:
    """Up to ``cap`` numbers per repository from the priority list, filled to ``target`` from the recency list.

    Both lists are ``repo, number, ord``.  Result: ``repo, number, from_priority,
    position`` in fetch order.
    """
    limit = min(cap, target)
    head = first_k(priority, ["repo"], ["ord"], limit).drop("position")
    taken = first_k(distinct_in_order(head, ["repo", "number"], "ord"), ["repo"], ["ord"], limit)
    counts = taken.groupBy("repo").agg(F.count(F.lit(1)).alias("_taken"))
    # The fill can only come from the first target + cap distinct entries.
    pool = first_k(distinct_in_order(recency, ["repo", "number"], "ord"), ["repo"], ["ord"], target + limit)
    fresh = pool.drop("position").join(taken.select("repo", "number"), ["repo", "number"], "left_anti")
    fill = (
        first_k(fresh, ["repo"], ["ord"], target)
        .join(counts, "repo", "left")
        .withColumn("_taken", F.coalesce("_taken", F.lit(0)))
        .where(F.col("position") <= target - F.col("_taken"))
        .select("repo", "number", F.lit(False).alias("from_priority"), (F.col("position") + F.col("_taken")).alias("position"))
    )
    return taken.select("repo", "number", F.lit(True).alias("from_priority"), "position").unionByName(fill)


def rounds(frame: DataFrame, limit: int | None = None) -> DataFrame:
    """Order in rounds: the i-th oldest of every repository, repositories by name.

    Adds ``turn``.  With ``limit`` the first rows of that order are returned, and
    a larger limit contains a smaller one.
    """
    order = ["created_at", "pr_id"]
    if limit is None:
        return ordinal(frame, ["repo"], order, day_bucket("created_at"), "turn").drop("turn_of")
    return first_k(frame, ["repo"], order, limit, "turn").orderBy("turn", "repo").limit(limit)


def seeded_sample(frame: DataFrame, n: int, key: str, seed: int = fixed.SEED) -> DataFrame:
    """Up to ``n`` rows in seeded random order: a distributed top-n."""
    return frame.orderBy(draw_order(F.col(key), seed), key).limit(n)


def balanced_sample(
    pool: DataFrame, k: int, balanced: bool = True, seed: int = fixed.SEED
) -> DataFrame:
    """``k`` labelled rows; balanced draws alternate merged and closed.  Adds ``position``."""
    known = pool.where(F.col("y").isNotNull())
    draw = [draw_order(F.col("pr_id"), seed), "pr_id"]
    if not balanced:
        order = Window.orderBy("_draw", "pr_id")
        drawn = known.withColumn("_draw", draw[0]).orderBy("_draw", "pr_id").limit(k)
        return drawn.withColumn("position", F.row_number().over(order).cast("long")).drop("_draw")
    quota = F.when(F.col("y") == 1, math.ceil(k / 2)).otherwise(k // 2)
    chosen = first_k(known, ["y"], draw, math.ceil(k / 2), "_turn").where(F.col("_turn") <= quota)
    order = Window.orderBy("_turn", F.desc("y"))  # at most k rows
    return chosen.withColumn("position", F.row_number().over(order).cast("long")).drop("_turn")


def longest_human_comment(review_comments: DataFrame, min_chars: int = fixed.MIN_DEMO_COMMENT_CHARS) -> DataFrame:
    """``pr_id, comment_id, body, chars``: the longest human comment of each pull request, ties by id."""
    size = F.length("body").cast("long")
    human = review_comments.where(is_human_author(F.col("author_login")) & (size >= min_chars))
    best = human.groupBy("pr_id").agg(
        F.min_by(F.struct("comment_id", "body", size.alias("chars")), F.struct(-size, F.col("comment_id"))).alias("_best")
    )
    return best.select("pr_id", "_best.comment_id", "_best.body", "_best.chars")


def comment_sample(
    train_pool: DataFrame, review_comments: DataFrame, k: int,
    seed: int = fixed.SEED, min_chars: int = fixed.MIN_DEMO_COMMENT_CHARS,
) -> DataFrame:
    """``k`` training pull requests, each with its longest human comment, capped.  Adds ``position``."""
    best = longest_human_comment(review_comments, min_chars)
    eligible = train_pool.select("pr_id", "repo").join(best, "pr_id")
    drawn = eligible.withColumn("_draw", draw_order(F.col("pr_id"), seed)).orderBy("_draw", "pr_id").limit(k)
    order = Window.orderBy("_draw", "pr_id")  # at most k rows
    comment = text.truncate(text.strip(F.col("body")), fixed.DEMO_COMMENT_BUDGET, fixed.COMMENT_MARKER, right_trim=True)
    return drawn.withColumn("position", F.row_number().over(order).cast("long")).select(
        "pr_id", "repo", "position", "comment_id", comment.alias("target_comment")
    )


def audit_sample(signals: DataFrame, n: int = fixed.AUDIT_SIZE, seed: int = fixed.SEED) -> DataFrame:
    """Flagged pull requests drawn for checking by hand, with the rule-of-three precision bound."""
    flagged = signals.where(F.col("is_ai_authored") | F.col("is_ai_reviewed"))
    return seeded_sample(flagged, n, "pr_id", seed).withColumn("precision_lower_bound", F.lit(1 - 3.0 / n))
