import datetime

import pytest

from tributary.operators import contexts, scoring, splits


def test_missing_times_sort_last_and_keep_their_row(spark):
    day = lambda n: datetime.datetime(2024, 1, 1 + n)
    rows = [(f"p{i}", "r", day(i)) for i in range(9)] + [("none", "r", None), ("lost", None, day(3))]
    sides = {r.pr_id: r.side for r in splits.time_split(spark.createDataFrame(rows, "pr_id string, repo string, created_at timestamp")).collect()}
    assert len(sides) == 10 and "lost" not in sides
    assert sorted(k for k, side in sides.items() if side == "test") == ["none", "p8"]


def test_folds_and_auc_leave_out_what_they_name(spark):
    frame = spark.createDataFrame([("a", 1), ("b", 0), ("c", None)], "pr_id string, y int")
    assert sorted(r.pr_id for r in splits.stratified_folds(frame).collect()) == ["a", "b"]
    scored = spark.createDataFrame([("m", 0.9, 1), ("m", 0.1, 0), ("m", None, 0), (None, 0.2, 1), (None, 0.4, 0)], "model string, p double, y int")
    assert {r.model: r.roc_auc for r in scoring.roc_auc(scored, ["model"], "p").collect()} == {"m": 1.0, None: 0.0}


@pytest.mark.parametrize("budget, kept", [(16_000, 457), (64_000, 1828), (200_000, 3000)])
def test_every_block_that_fits_is_kept(spark, budget, kept):
    blocks = spark.range(3000).selectExpr("id % 1 AS pr_id", "id AS n", "rpad(cast(id AS string), 35, '.') AS block")
    row = contexts.pack(blocks, "pr_id", ["n"], budget, "\n", shortest=9).first()
    assert (row.n_kept, row.n_blocks) == (kept, 3000)


def test_a_block_shorter_than_stated_is_an_error(spark):
    blocks = spark.createDataFrame([(1, 1, "abc")], "pr_id int, n int, block string")
    with pytest.raises(Exception, match="shorter than 9"):
        contexts.pack(blocks, "pr_id", ["n"], 100, "\n", shortest=9).collect()
