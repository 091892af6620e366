"""Streaming versions of ingest, de-duplication, scoring and resuming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tributary.operators.diffs import diff_features
from tributary.operators.forest_search import Forest, score
from tributary.operators.ml import labelled
from tributary.operators.replay import CELL, missing_cells
from tributary.session import scratch_path
from tributary.sources import records


def _start(frame: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        frame.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_records(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """New record documents as they land: one document a file, or one a line."""
    raw = (
        spark.readStream.schema(f"{records.RECORD_SCHEMA}, {records.CORRUPT} string")
        .option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", records.CORRUPT).json(path)
    )
    return raw.where(F.col(records.CORRUPT).isNull() & F.col("pull_request").isNotNull()).drop(records.CORRUPT)


def ingest(stream: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Flatten arriving records into the seven tables.

    Each batch writes its own partition ``batch_id``, replaced when the batch is
    replayed after a failure, so no row is written twice.  A batch is parsed once: what the tables are
    written from is its tagged rows, not the nested records, which would have to be kept; those of a table go when it is written.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fanned = scratch_path(spark, "fanned")
        schema = records.fan_out(batch, fanned)
        for name in records.TABLES:
            records.fanned_table(spark, fanned, name, schema).write.mode("overwrite").parquet(f"{output}/{name}/batch_id={batch_id}")
            records.drop_fanned(fanned, name)

    return _start(stream, each, checkpoint)


def distinct_records(stream: DataFrame, keys: list[str], clock: str, delay: str = "1 hour") -> DataFrame:
    """Records seen once within the watermark; state older than the delay is dropped."""
    return stream.withWatermark(clock, delay).dropDuplicatesWithinWatermark(keys)


def accept_on_time(stream: DataFrame, keys: list[str], clock: str, delay_seconds: int, folder: str, checkpoint: str) -> StreamingQuery:
    """Each key once, and every row that is not taken in a table of its own.

    Below ``folder``: ``accepted``, and ``rejected`` with the ``reason``: ``late`` (older than the newest time of earlier batches less the
    delay), ``repeated`` or ``no time``.  What is kept between batches is ``state``: the newest time, and the keys accepted within the delay; older
    ones cannot come back but as late rows.  Each batch writes tables of its own number, and reads those of the one before, so a replayed batch gives the same.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in batch.select(*keys, clock).schema)}"
        earlier = batch_id > 0
        newest = spark.read.parquet(f"{folder}/state/clock/{batch_id - 1}").first()[0] if earlier else None
        recent = spark.read.parquet(f"{folder}/state/keys/{batch_id - 1}") if earlier else spark.createDataFrame([], schema)
        batch.persist()
        try:
            late = F.lit(False) if newest is None else F.col(clock).cast("timestamp") < F.lit(newest) - F.make_dt_interval(secs=F.lit(delay_seconds))
            judged = batch.withColumn("reason", F.when(F.col(clock).isNull(), "no time").when(late, "late"))
            # copies of a key share an order, whichever task reads them first
            nth = F.row_number().over(Window.partitionBy(*keys).orderBy(clock, F.xxhash64(*batch.columns)))
            timely = judged.where("reason IS NULL").drop("reason").withColumn("_nth", nth).join(recent.select(*keys, F.lit(True).alias("_seen")).distinct(), keys, "left")
            fresh = F.col("_seen").isNull() & (F.col("_nth") == 1)
            timely.where(fresh).select(batch.columns).write.mode("overwrite").parquet(f"{folder}/accepted/batch_id={batch_id}")
            rejected = judged.where("reason IS NOT NULL").unionByName(timely.where(~fresh).select(*batch.columns, F.lit("repeated").alias("reason")))
            rejected.write.mode("overwrite").parquet(f"{folder}/rejected/batch_id={batch_id}")
            taken = spark.read.parquet(f"{folder}/accepted/batch_id={batch_id}").select(*keys, clock)
            now = taken.agg(F.greatest(F.max(F.col(clock).cast("timestamp")), F.lit(newest).cast("timestamp")).alias("newest"))
            now.write.mode("overwrite").parquet(f"{folder}/state/clock/{batch_id}")
            newest = spark.read.parquet(f"{folder}/state/clock/{batch_id}").first()[0]
            edge = F.lit(newest).cast("timestamp") - F.make_dt_interval(secs=F.lit(delay_seconds))
            recent.select(*keys, clock).unionByName(taken).where(F.col(clock).cast("timestamp") >= edge).write.mode("overwrite").parquet(f"{folder}/state/keys/{batch_id}")
        finally:
            batch.unpersist()

    return _start(stream, each, checkpoint)


def score_diffs(stream: DataFrame, forests: dict[str, Forest], output: str, refused: str, checkpoint: str) -> StreamingQuery:
    """Score arriving diffs; diffs without files go to the refused table."""
    from tributary.operators.diffs import unparseable

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            scored = labelled(score(forests, diff_features(batch), ["diff_id"])).select("model", "diff_id", "probability", "prediction")
            scored.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")
            unparseable(batch).select("diff_id").write.mode("overwrite").parquet(f"{refused}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return _start(stream, each, checkpoint)


def resume_grid(
    stream: DataFrame, recorded: Callable[[], DataFrame], answer: Callable[[DataFrame], DataFrame], output: str, checkpoint: str
) -> StreamingQuery:
    """Answer only cells that the log does not hold yet.

    ``recorded`` reads the log anew for every batch, and may read ``output`` itself: a batch that is replayed after a
    failure does not take its own rows for earlier ones.  ``answer`` maps pending cells to rows.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        before = recorded()
        if "batch_id" in before.columns:
            before = before.where(F.col("batch_id") != batch_id)
        pending = missing_cells(batch.dropDuplicates(CELL), before)
        answer(pending).write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    return _start(stream, each, checkpoint)
