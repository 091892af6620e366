"""One run of a prompt grid against its answer log: skip, budget, ask, append, count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators.replay import CELL, budgeted, missing_cells, run_counters
from tributary.session import cut_lineage
from tributary.sources import logs

BUDGET_REACHED = "max_new_calls reached"


def open_log(cells: DataFrame, path: str) -> None:
    """Make an empty log where none is, so that a first run reads like any other."""
    spark = cells.sparkSession
    logs.append_log(spark.createDataFrame([], logs.LOG_SCHEMA), path)


def run_grid(
    cells: DataFrame, log_path: str, respond: Callable[[DataFrame], DataFrame], max_new: int | None = None
) -> DataFrame:
    """Answer the cells that the log does not hold, append them, and return the counters of this run.

    ``cells`` has the cell columns and whatever ``respond`` needs; ``respond`` maps pending cells to rows of the log
    (``logs.LOG_SCHEMA``), a failed call with its ``error``.  A cell that it leaves out is a miss and stays pending.  At
    most ``max_new`` pending cells, in cell order, are asked; ``stopped_reason`` tells whether that left some out.

    The ids recorded before and the rows of this run are checkpointed: the log grows between their uses, and a call
    must not be made twice because an executor was lost.
    """
    open_log(cells, log_path)
    wanted = cells.withColumn("pr_id", F.col("pr_id").cast("string"))
    recorded = cut_lineage(logs.read_log(cells.sparkSession, log_path).select(*CELL).distinct())
    pending = missing_cells(wanted, recorded)
    asked = pending if max_new is None else cut_lineage(budgeted(pending, max_new))
    written = cut_lineage(respond(asked))
    logs.append_log(written, log_path)
    counters = run_counters(wanted, recorded, written, asked)
    left_out = F.lit(False) if max_new is None else F.col("total_cells") - F.col("n_skipped_already_done") > F.lit(max_new)
    return counters.withColumn("stopped_reason", F.when(left_out, F.lit(BUDGET_REACHED)))
