from pyspark.sql import functions as F

from tributary.plans.run_grid import run_grid
from tributary.sources import logs


def grid(spark, n):
    return spark.range(n).select(
        F.col("id").alias("pr_id"), F.lit("o/r").alias("repo"), F.lit("diff_only").alias("context_kind"),
        F.lit("zero_shot").alias("strategy"), F.lit("merge_prediction").alias("task"))


def answer(pending):
    """Nothing stored for 3, a failure for 5, an answer from the cache for even ids."""
    number = F.col("pr_id").cast("long")
    return pending.where(number != 3).withColumn("error", F.when(number == 5, "refused")).withColumn(
        "from_cache", number % 2 == 0).withColumn("response_text", F.concat(F.lit("answer "), "pr_id"))


def test_a_run_goes_on_where_the_last_one_stopped(spark, tmp_path):
    path, cells = str(tmp_path / "log"), grid(spark, 8)
    first = run_grid(cells, path, answer, max_new=5).first()
    assert (first.total_cells, first.n_skipped_already_done, first.n_written_this_run) == (8, 0, 4)
    assert (first.n_cache_misses_skipped, first.n_new_api_calls, first.n_recorded_failures) == (1, 1, 0)
    assert first.stopped_reason == "max_new_calls reached"
    second = run_grid(cells, path, answer).first()
    assert (second.n_skipped_already_done, second.n_written_this_run, second.n_recorded_failures) == (4, 3, 1)
    assert (second.n_cache_misses_skipped, second.n_new_api_calls, second.stopped_reason) == (1, 1, None)
    third = run_grid(cells, path, answer).first()
    assert (third.n_skipped_already_done, third.n_written_this_run) == (7, 0)
    rows = logs.read_log(spark, path).collect()
    assert sorted(r.pr_id for r in rows) == list("0124567")
    assert [r.error for r in rows if r.error] == ["refused"]
