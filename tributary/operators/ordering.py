"""Ordered prefix sums, ranks and quantiles for groups of any size.

A plain window puts a whole group into one task, and one repository can hold a
third of all rows.  These operators cut every group into buckets by a monotone
function of the sort key, sum the buckets first (one row per group and bucket),
and run the row-level window inside one bucket only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POOLED = "All repos (pooled)"


def day_bucket(column: str) -> Column:
    """Bucket of a timestamp or date: its calendar day."""
    return F.to_date(F.col(column))


def value_bucket(column: str) -> Column:
    """Bucket of a number: logarithmic steps of 1/64, so any spread gives few thousand buckets."""
    value = F.col(column).cast("double")
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * 64).cast("long")


def unit_bucket(column: str, parts: int = 4096) -> Column:
    """Bucket of a number in [0, 1]."""
    return F.floor(F.col(column).cast("double") * parts).cast("long")


def prefix_sums(
    frame: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str], bucket: Column
) -> DataFrame:
    """Add ``before_<s>``: the sum of ``s`` over the rows of the group that sort earlier.

    ``bucket`` must be a non-decreasing function of ``order``, and ``order`` unique
    within a group.  Null keys form a group of their own; null order values sort last.
    """
    bucketed, per_bucket_of, inside = _slots(frame, keys, order, bucket)
    per_bucket = per_bucket_of(*[F.sum(s).alias(s) for s in sums])
    earlier = _earlier(keys)
    offsets = per_bucket.select(
        "_slot", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_offset_{s}") for s in sums]
    )
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    return bucketed.join(offsets, "_slot").select(
        *frame.columns,
        *[
            (F.col(f"_offset_{s}") + F.coalesce(F.sum(s).over(before), F.lit(0))).alias(f"before_{s}")
            for s in sums
        ],
    )


def _slots(frame: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column):
    """The rows with their slot (keys and bucket as one struct, whose null fields join as equal),
    the aggregation by slot, and the window inside a slot."""
    bucketed = frame.withColumn("_slot", F.struct(*keys, bucket.alias("_bucket")))
    inside = Window.partitionBy("_slot").orderBy(*[F.col(o).asc_nulls_last() for o in order])
    return bucketed, lambda *aggregates: bucketed.groupBy("_slot").agg(*aggregates), inside


def _group(keys: Sequence[str]):
    return Window.partitionBy(*[F.col("_slot")[k] for k in keys])


def _earlier(keys: Sequence[str]):
    return _group(keys).orderBy(F.col("_slot._bucket").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)


def ordinal(
    frame: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = "ordinal"
) -> DataFrame:
    """Add the 1-based position of each row in its group, and the group size ``<name>_of``.

    Nulls count as in :func:`prefix_sums`: a group of null keys, null order values last.
    """
    bucketed, per_bucket_of, inside = _slots(frame, keys, order, bucket)
    offsets = per_bucket_of(F.count(F.lit(1)).alias("_n")).select(
        "_slot",
        F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0)).alias("_offset"),
        F.sum("_n").over(_group(keys)).alias("_size"),
    )
    return bucketed.join(offsets, "_slot").select(
        *frame.columns,
        (F.col("_offset") + F.row_number().over(inside)).alias(name),
        F.col("_size").alias(f"{name}_of"),
    )


def value_counts(frame: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, value, n``: non-null values with their counts."""
    return frame.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def with_pool(counts: DataFrame, key: str, value: str) -> DataFrame:
    """Counts per group plus the same counts over all groups, under the pooled label."""
    both = counts.withColumn(key, F.explode(F.array(F.col(key), F.lit(POOLED))))
    return both.groupBy(key, value).agg(F.sum("n").alias("n"))


def quantiles(
    counts: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Exact linear-interpolated quantiles per group from value counts, one row per group.

    The positions that a quantile needs are first located by bucket; only the
    values of those buckets are ranked.
    """
    keys = list(keys)
    bucketed = counts.withColumn("_bucket", value_bucket(value))
    per_bucket = bucketed.groupBy(*keys, "_bucket").agg(F.sum("n").alias("_n"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    spans = per_bucket.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_from"),
        "_n",
        F.sum("_n").over(group).alias("_size"),
    )
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("_size") - 1)).alias("position"))
            for name, p in probabilities.items()
        ]
    )
    low_high = F.explode(F.array(F.floor("_q.position"), F.ceil("_q.position")))
    targets = (
        spans.withColumn("_q", F.explode(wanted))
        .withColumn("_row", low_high)
        .where((F.col("_row") >= F.col("_from")) & (F.col("_row") < F.col("_from") + F.col("_n")))
        .groupBy(*keys, "_bucket", "_from")
        .agg(F.collect_set(F.struct("_q.name", "_q.position", "_row")).alias("_targets"))
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = bucketed.join(targets, [*keys, "_bucket"]).withColumn(
        "_start", F.col("_from") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    )
    hits = ranked.withColumn("_t", F.explode("_targets")).where(
        (F.col("_t._row") >= F.col("_start")) & (F.col("_t._row") < F.col("_start") + F.col("n"))
    )
    number = F.col(value).cast("double")
    parts = []
    for name in probabilities:
        mine = F.col("_t.name") == name
        low = F.min(F.when(mine, number))
        high = F.max(F.when(mine, number))
        share = F.max(F.when(mine, F.col("_t.position") - F.floor("_t.position")))
        parts.append((low + (high - low) * share).alias(name))
    return hits.groupBy(*keys).agg(*parts)


def distribution(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, median, std, min, max, p90, p99 and zero count per group, from value counts.

    Deviations are taken from the mean in a second pass over the distinct values,
    so large means lose no digits.
    """
    keys, number = list(keys), F.col(value).cast("double")
    totals = counts.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum(number * F.col("n")) / F.sum("n")).alias("mean"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
        F.coalesce(F.sum(F.when(number == 0, F.col("n"))), F.lit(0)).alias("zero_count"),
    )
    spread = (
        counts.join(totals.select(*keys, "mean"), keys)
        .groupBy(*keys)
        .agg(F.sum(F.col("n") * (number - F.col("mean")) * (number - F.col("mean"))).alias("_m2"))
    )
    marks = quantiles(counts, keys, value, {"median": 0.5, "p90": 0.9, "p99": 0.99})
    return (
        totals.join(spread, keys)
        .join(marks, keys)
        .select(
            *keys,
            "n",
            F.round("mean", 3).alias("mean"),
            F.round("median", 6).alias("median"),
            F.when(F.col("n") > 1, F.round(F.sqrt(F.col("_m2") / (F.col("n") - 1)), 3))
            .otherwise(F.lit(0.0))
            .alias("std"),
            "min",
            "max",
            F.round("p90", 6).alias("p90"),
            F.round("p99", 6).alias("p99"),
            "zero_count",
        )
    )
