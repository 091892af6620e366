import json
import time

from pyspark.sql import functions as F

from tributary import session
from tributary.catalog import sources
from tributary.operators import detection
from tributary.sources import logs, records
from tributary.streaming import jobs

RECORD = {
    "owner": "o", "repo": "r", "number": 7,
    "pull_request": {
        "id": "PR1", "number": 7, "title": "T", "body": None, "state": "MERGED", "merged": True, "createdAt": "2024-01-01T00:00:00Z",
        "additions": 3, "deletions": 1, "changedFiles": 1, "author": {"login": "ann", "__typename": "User"},
        "labels": {"nodes": [{"name": "bug"}, None]},
        "commits": {"totalCount": 3, "nodes": [
            {"commit": {"oid": "abc", "message": "Initial plan", "author": {"name": "ann", "email": "a@x.org", "user": None}}},
            {"commit": {"oid": "0123456789abc", "message": "work", "author": {"name": "x", "email": "1+Copilot@users.noreply.github.com"}}}]},
        "reviews": {"nodes": [{"id": "R1", "state": "APPROVED", "author": {"login": "coderabbitai", "__typename": "Bot"},
                               "comments": {"nodes": [{"id": "C1", "body": "b", "author": None}]}}]},
        "comments": {"nodes": [{"id": "I1", "body": "hi", "author": {"login": "greptile[bot]", "__typename": "Bot"}}]},
    },
    "files": [{"filename": "a.py", "status": "added", "additions": 3, "deletions": 0, "patch": None}],
}


def land(folder):
    folder.mkdir()
    (folder / "good.json").write_text(json.dumps(RECORD, indent=1))
    (folder / "bad.json").write_text("{ not json")
    return str(folder)


def test_records_flatten_and_corrupt_files_are_missing(spark, tmp_path):
    rows = records.read_records(spark, land(tmp_path / "in"))
    tables = records.build_tables(rows)
    request = tables["pull_requests"].collect()
    assert len(request) == 1
    pr = request[0]
    assert pr["labels"] == ["bug"] and pr["repo"] == "o/r" and pr["ai_authored_kind"] == "human_opened_ai_assisted"
    assert pr["ai_authored_evidence"] == "commit 0123456789 authored by agent identity 'copilot'"
    assert pr["ai_reviewer_logins_str"] == "coderabbitai,greptile[bot]" and pr["n_ai_reviewers"] == 2
    assert [r["commit_ord"] for r in tables["commits"].orderBy("commit_ord").collect()] == [0, 1]
    assert tables["review_comments"].first()["review_id"] == "R1"
    cut = records.truncated_connections(rows).collect()
    assert [(r["connection"], r["total"], r["fetched"]) for r in cut] == [("commits", 3, 2)]


def test_initial_plan_only_on_the_first_commit(spark):
    schema = "pr_id string, commit_ord long, sha string, message string, author_name string, author_email string, author_login string"
    rows = [("a", 0, "1", " INITIAL PLAN x", None, None, None), ("b", 0, "1", "x", None, None, None), ("b", 1, "2", "Initial plan", None, None, None)]
    got = [(r["pr_id"], r["method"]) for r in detection.commit_evidence(spark.createDataFrame(rows, schema)).collect()]
    assert got == [("a", "commit_initial_plan")]


def test_streamed_ingest_writes_each_table_once(spark, tmp_path):
    source = land(tmp_path / "in")
    for _ in range(2):
        jobs.ingest(jobs.stream_records(spark, source), str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "commits")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out" / "pull_requests")).count() == 1


def test_landed_documents_are_compressed(spark, tmp_path):
    land(tmp_path / "in")
    rows = records.read_records(spark, str(tmp_path / "in"))
    records.land(rows, str(tmp_path / "landed"))
    assert {p.name.rsplit(".", 1)[1] for p in (tmp_path / "landed").glob("part-*")} == {"gz"}
    assert records.read_records(spark, str(tmp_path / "landed"), multi_line=False).collect() == rows.collect()


def test_ingest_keeps_no_copy_of_the_records(spark, tmp_path, monkeypatch):
    bare = {"owner": "o", "repo": "r", "number": 9, "pull_request": {"id": "PR3"}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "bare.json").write_text(json.dumps(bare))

    def persist(*_):
        raise AssertionError("the nested records are kept")

    monkeypatch.setattr(type(spark.range(1)), "persist", persist)
    jobs.ingest(jobs.stream_records(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    tables = records.build_tables(records.read_records(spark, str(tmp_path / "in")))
    for name, table in tables.items():  # tables without rows are there too
        written = spark.read.parquet(str(tmp_path / "out" / name)).drop("batch_id")
        assert written.columns == table.columns and written.collect() == table.collect(), name


def test_log_skips_blank_lines_and_appends(spark, tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    (path / "a.json").write_text('{"pr_id": "p", "task": "t"}\n\n{"pr_id": "q", "task": "t"}\n')
    rows = logs.read_log(spark, str(path))
    assert rows.count() == 2
    logs.append_log(rows, str(tmp_path / "copy"))
    logs.append_log(rows, str(tmp_path / "copy"))
    assert logs.read_log(spark, str(tmp_path / "copy")).count() == 4


def test_cut_log_lines_are_rejected(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"pr_id": "p", "task": "t"}\n{"pr_id": "q", "ta')
    assert [r.pr_id for r in logs.read_log(spark, str(tmp_path)).collect()] == ["p"]
    assert logs.read_log(spark, str(tmp_path)).count() == 1
    assert [r.line for r in logs.rejected_log_lines(spark, str(tmp_path)).collect()] == ['{"pr_id": "q", "ta']


def test_one_pass_writes_the_tables_that_projections_give(spark, tmp_path):
    second = json.loads(json.dumps(RECORD))
    second["pull_request"] |= {"id": "PR2", "commits": None, "reviews": {"nodes": [None, {"id": "R2", "state": "X", "author": None, "comments": None}]},
                               "comments": {"nodes": []}, "author": {"login": "Copilot", "__typename": "Bot"}}
    third = {"owner": "o", "repo": "r", "number": 9, "pull_request": {"id": "PR3", "commits": {"nodes": [None, {"commit": {"oid": "z", "message": "Initial plan"}}]}}}
    again = json.loads(json.dumps(RECORD))  # the same request landed twice
    folder = tmp_path / "in"
    folder.mkdir()
    for i, record in enumerate((RECORD, second, third, again)):
        (folder / f"{i}.json").write_text(json.dumps(record, indent=1))
    rows = records.read_records(spark, str(folder))
    records.fan_out(rows, str(tmp_path / "out"))
    for name, table in records.build_tables(rows).items():
        written = records.fanned_table(spark, str(tmp_path / "out"), name)
        assert written.columns == table.columns
        assert sorted(map(str, written.collect())) == sorted(map(str, table.collect())), name
    assert records.fanned_table(spark, str(tmp_path / "out"), "pull_requests").count() == 4
    plan = records.pull_requests(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan json") == 1 and "Exchange" not in plan


def test_detection_in_the_row_equals_detection_by_joins(spark, tmp_path):
    land(tmp_path / "in")
    rows = records.read_records(spark, str(tmp_path / "in"))
    requests = rows.selectExpr("pull_request.id AS id", "pull_request.author.login AS author_login", "pull_request.author.__typename AS author_type")
    joined = detection.detect(requests, records.commits(rows), records.reviews(rows), records.review_comments(rows), records.issue_comments(rows))
    in_row = records._detected(rows).select(joined.columns)
    assert in_row.collect() == joined.collect()


def test_a_file_that_is_no_record_costs_itself_only(spark, tmp_path):
    land(tmp_path / "in")
    (tmp_path / "in" / "empty.json").write_text("  \n")
    (tmp_path / "in" / "other.json").write_text('{"a": 1}')
    good, bad = records.read_documents(spark, str(tmp_path / "in"))
    assert [r.number for r in good.collect()] == [7] and records.build_tables(good)["commits"].count() == 2
    assert sorted((r.path.rsplit("/", 1)[1], r.reason) for r in bad.collect()) == [("bad.json", "not a record"), ("empty.json", "empty"), ("other.json", "no pull request")]


def test_late_and_repeated_rows_have_a_table_and_state_stays_small(spark, tmp_path):
    folder, source = str(tmp_path / "out"), tmp_path / "in"
    schema = "k long, at timestamp, v string"
    batches = [
        [(1, "2024-01-01 10:00:00", "a"), (1, "2024-01-01 10:00:00", "a"), (2, "2024-01-01 10:05:00", "b"), (3, None, "c")],
        [(1, "2024-01-01 10:00:00", "a"), (4, "2024-01-01 10:20:00", "d"), (2, "2024-01-01 10:06:00", "again")],
        [(5, "2024-01-01 10:09:00", "old"), (2, "2024-01-01 10:05:00", "b"), (6, "2024-01-01 10:11:00", "e")],
    ]
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, "k long, at string, v string").selectExpr("k", "to_timestamp(at) AS at", "v").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        jobs.accept_on_time(stream, ["k"], "at", 600, folder, str(tmp_path / "progress")).awaitTermination()
        seen.append(sorted((r.k, r.v) for r in spark.read.parquet(f"{folder}/accepted").collect()))
    assert seen == [[(1, "a"), (2, "b")], [(1, "a"), (2, "b"), (4, "d")], [(1, "a"), (2, "b"), (4, "d"), (6, "e")]]
    reasons = sorted((r.k, r.reason) for r in spark.read.parquet(f"{folder}/rejected").collect())
    assert reasons == [(1, "repeated"), (1, "repeated"), (2, "late"), (2, "repeated"), (3, "no time"), (5, "late")]
    state = {n: sorted(r.k for r in spark.read.parquet(f"{folder}/state/keys/{n}").collect()) for n in range(3)}
    assert state == {0: [1, 2], 1: [4], 2: [4, 6]}  # keys of the last ten minutes


def numbered_records(spark, numbers):
    texts = [(json.dumps(RECORD | {"number": n, "pull_request": RECORD["pull_request"] | {"id": None if n is None else str(n)}}),) for n in numbers]
    rows = spark.createDataFrame(texts, "value string").repartition(3)
    return rows.select(F.from_json("value", records.RECORD_SCHEMA).alias("r")).select("r.*")


def test_every_document_is_landed_and_judged(spark, monkeypatch):
    """None is left out by its id; a repeated request is a file each, and one without an id is a file too."""
    numbers = [*range(1, 61), 8, 8, None]
    monkeypatch.setattr(sources, "nested", lambda *_: numbered_records(spark, numbers))
    got = sources.whole_documents(spark, sources.landed_documents(spark, "")).collect()
    want = [(None if n is None else str(n), "rejected", None, None) if n is not None and n % 7 in (3, 5) else (None if n is None else str(n), "read", "o", n) for n in numbers]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert "id % 50" not in sources.ORACLES["SRC2_whole_documents"]


def test_whole_files_are_read_below_folders_and_beside_them(spark, tmp_path):
    (tmp_path / "in" / "a" / "b").mkdir(parents=True)
    for name in ("one", "a/two", "a/b/three", "a/_hidden", ".hidden", "a/b/_k=v"):
        (tmp_path / "in" / name).write_text(f"text of\n{name}")
    (tmp_path / "in" / "bad").write_bytes(b"\xff\xfe")
    rows = records.whole_files(spark, str(tmp_path / "in")).collect()
    old = spark.read.text(str(tmp_path / "in"), wholetext=True, recursiveFileLookup=True).select("_metadata.file_path").collect()
    assert sorted(r.path for r in rows) == sorted(r.file_path for r in old) and len(rows) == 5
    assert {r.path.rsplit("/in/")[1]: r.value for r in rows if not r.path.endswith("bad")} == {n: f"text of\n{n}" for n in ("one", "a/two", "a/b/three", "a/b/_k=v")}
    (tmp_path / "none").mkdir()
    assert records.whole_files(spark, str(tmp_path / "none")).count() == 0


def test_ingest_leaves_no_second_copy_of_its_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "scratch_path", lambda _, name: str(tmp_path / name))
    source = land(tmp_path / "in")
    jobs.ingest(jobs.stream_records(spark, source), str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "commits")).count() == 2 and (tmp_path / "fanned").is_dir()
    assert not list((tmp_path / "fanned").glob("table=*/*.parquet"))


def test_landing_leaves_no_shuffle_files(spark, tmp_path):
    def shuffle_files():
        files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before, rows = shuffle_files(), numbered_records(spark, range(20))
    kept = spark.conf.get(session.SHUFFLE_CLEANUP_KEY)
    records.land(rows, str(tmp_path / "landed"))
    until = time.time() + 10  # files go in the background
    while shuffle_files() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files() - before and spark.conf.get(session.SHUFFLE_CLEANUP_KEY) == kept
    rows.write.parquet(str(tmp_path / "plain"))
    assert shuffle_files() - before
