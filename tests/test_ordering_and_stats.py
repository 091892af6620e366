import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.operators import features, ordering, sampling, scoring, splits, stats


def test_quantiles_match_numpy_with_one_hot_group(spark):
    rng = random.Random(1)
    values = {"hot": [rng.choice([0, 1, 2, 500, 10_000]) for _ in range(900)], "b": [rng.random() * 9 - 4 for _ in range(101)], "c": [7.0]}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs]
    frame = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in ordering.quantiles(ordering.value_counts(frame, ["k"], "v"), ["k"], "v", {"m": 0.5, "p": 0.9, "q": 0.99}).collect()}
    for key, vs in values.items():
        for name, p in (("m", 0.5), ("p", 0.9), ("q", 0.99)):
            assert got[key][name] == pytest.approx(np.quantile(vs, p))


def test_distribution_of_one_value_has_std_zero(spark):
    frame = spark.createDataFrame([("a", 4)], "repo string, v long")
    rows = {r["repo"]: r for r in stats.describe_by_repo(frame, "v").collect()}
    assert rows["a"]["std"] == 0.0 and rows["a"]["p99"] == 4.0 and rows[ordering.POOLED]["n"] == 1


def test_ordinal_matches_row_number_across_buckets(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("r" if i % 3 else "s", start + dt.timedelta(hours=7 * (i % 50)), i) for i in range(300)]
    frame = spark.createDataFrame(rows, "repo string, created_at timestamp, pr_id long")
    got = ordering.ordinal(frame, ["repo"], ["created_at", "pr_id"], ordering.day_bucket("created_at"), "n").collect()
    for repo in ("r", "s"):
        mine = sorted((r["created_at"], r["pr_id"], r["n"]) for r in got if r["repo"] == repo)
        assert [m[2] for m in mine] == list(range(1, len(mine) + 1))


def test_missing_lines_count_as_zero(spark):
    frame = spark.createDataFrame([(1, "a", None, 3), (2, "a", 4, None)], "id long, repo string, additions long, deletions long")
    assert sorted(r["pr_length"] for r in stats.pr_length(frame).collect()) == [3, 4]


def test_empty_authorship_group_has_no_rate(spark):
    frame = spark.createDataFrame([("a", False, True)], "repo string, is_ai_authored boolean, is_merged boolean")
    row = stats.merge_rate_by_authorship(frame).where("repo = 'a'").first()
    assert row["n_ai"] == 0 and row["merge_rate_ai"] is None and row["merge_rate_human"] == 1.0


def test_history_is_strict_and_skips_missing_authors(spark):
    day = dt.datetime(2024, 5, 1)
    rows = [
        (1, "r", "ann", day, True), (2, "r", "ann", day, False), (3, "r", "ann", day + dt.timedelta(days=2), True),
        (4, "s", "ann", day + dt.timedelta(days=3), True), (5, "r", None, day + dt.timedelta(days=4), True),
    ]
    pulls = spark.createDataFrame(rows, "id long, repo string, author_login string, created_at timestamp, is_merged boolean")
    population = pulls.withColumnRenamed("id", "pr_id")
    got = {r["pr_id"]: (r["author_prior_merge_rate"], r["author_prior_pr_count"]) for r in features.author_history(population, pulls).collect()}
    assert got == {1: (None, 0), 2: (None, 0), 3: (0.5, 2), 4: (None, 0), 5: (None, 0)}


def _population(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"a{i}", "r/a", start + dt.timedelta(days=i), i % 2) for i in range(10)]
    rows += [(f"b{i}", "r/b", start + dt.timedelta(days=i), i % 2) for i in range(20)]
    return spark.createDataFrame(rows, "pr_id string, repo string, created_at timestamp, y int")


def test_split_is_by_time_and_complete(spark):
    population = _population(spark)
    split = splits.time_split(population)
    cut = {r["repo"]: (r["n_train"], r["n_test"], r["train_max_created_at"] < r["test_min_created_at"]) for r in splits.split_cutoffs(split).collect()}
    assert cut == {"r/a": (8, 2, True), "r/b": (16, 4, True)}
    assert splits.split_check(split, population).first() == (0, 0, 0)


def test_folds_hold_equal_shares_of_each_class(spark):
    counts = splits.stratified_folds(_population(spark)).groupBy("fold", "y").count().collect()
    assert {r["count"] for r in counts} == {3} and len(counts) == 10


def test_round_prefixes_are_nested(spark):
    population = _population(spark)
    small = {r["pr_id"] for r in sampling.rounds(population, 5).collect()}
    large = {r["pr_id"] for r in sampling.rounds(population, 9).collect()}
    assert len(small) == 5 and small < large


def test_balanced_sample_alternates(spark):
    rows = sampling.balanced_sample(_population(spark), 5).orderBy("position").collect()
    assert [r["y"] for r in rows] == [1, 0, 1, 0, 1]


def test_quota_fill_tops_up_and_drops_repeats(spark):
    priority = spark.createDataFrame([("r", 5, 1), ("r", 5, 2), ("r", 6, 3), ("r", 7, 4)], "repo string, number long, ord long")
    recency = spark.createDataFrame([("r", n, i) for i, n in enumerate([9, 5, 8, 9, 7, 4])], "repo string, number long, ord long")
    rows = sampling.quota_fill(priority, recency, target=5, cap=3).orderBy("position").collect()
    assert [(r["number"], r["from_priority"]) for r in rows] == [(5, True), (6, True), (9, False), (8, False), (7, False)]


def test_auc_counts_ties_half(spark):
    frame = spark.createDataFrame([("m", 0.9, 1), ("m", 0.5, 1), ("m", 0.5, 0), ("m", 0.1, 0)], "model string, s double, y int")
    assert scoring.roc_auc(frame, ["model"], "s").first()["roc_auc"] == 0.875


def test_zero_division_gives_zero(spark):
    frame = spark.createDataFrame([(1, 1), (1, 1)], "y int, pred int").withColumn("model", F.lit("m"))
    row = scoring.metrics(scoring.confusion(frame, ["model"])).first()
    assert row["recall_not_merged"] == 0.0 and row["accuracy"] == 1.0 and row["macro_f1"] == 0.5
