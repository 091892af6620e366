"""Queries over sources, sinks, flattening and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tributary.catalog.detection import VERDICT_STEPS
from tributary.catalog.diffs import FILE_STEPS
from tributary.catalog.registry import QUERIES, query
from tributary.operators import replay, stats
from tributary.session import scratch_path
from tributary.sources import logs, records
from tributary.sources.corpus import check_sql, corpus_view
from tributary.catalog.registry import ORACLES
from tributary.catalog.stats import MERGE_STATUS, STEPS
from tributary.streaming import jobs

CHILDREN = ["pull_requests", "commits", "files_changed", "reviews", "review_comments", "issue_comments"]


@query("SRC1_pruned_scan", "orders", sql_views=[],
       sql="SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 100000")
def pruned(orders):
    return orders.where("o_totalprice > 100000").select("o_orderkey", "o_orderstatus")


def nested(spark: SparkSession, sf_dir: str):
    return records.nest(*[corpus_view(spark, sf_dir, v) for v in CHILDREN])


def landed(spark: SparkSession, sf_dir: str):
    """Records written as JSON documents and read back, as ingest sees them."""
    path = scratch_path(spark, "records")
    records.land(nested(spark, sf_dir), path)
    return records.read_records(spark, path, multi_line=False)


def register(name: str, views: list[str], sql: str, build, steps=None):
    QUERIES[name] = build
    ORACLES[name] = check_sql(views, sql, steps)


register("SRC2_record_scan", ["pull_requests"], "SELECT owner, repo_name AS repo, number, CAST(id AS VARCHAR) AS id FROM pull_requests",
         lambda s, d: landed(s, d).select("owner", "repo", "number", "pull_request.id"))
register("FLT2_commits", ["commits", "pull_requests"],
         "SELECT CAST(pr_id AS VARCHAR) AS pr_id, commit_ord, sha, message, author_name, author_email, author_login, additions, deletions "
         "FROM commits WHERE pr_id IN (SELECT id FROM pull_requests)", lambda s, d: records.commits(landed(s, d)))
register("FLT3_files", ["files_changed", "pull_requests"],
         "SELECT CAST(pr_id AS VARCHAR) AS pr_id, row_number() OVER (PARTITION BY pr_id ORDER BY file_ord) - 1 AS file_ord, filename, status, "
         "additions, deletions, patch FROM files_changed WHERE pr_id IN (SELECT id FROM pull_requests)",
         lambda s, d: records.files_changed(nested(s, d)))
register("FLT4_reviews", ["reviews", "pull_requests"],
         "SELECT CAST(pr_id AS VARCHAR) AS pr_id, review_id, reviewer_login, CASE WHEN reviewer_login IS NULL THEN NULL ELSE reviewer_type END AS reviewer_type, state "
         "FROM reviews WHERE pr_id IN (SELECT id FROM pull_requests)",
         lambda s, d: records.reviews(nested(s, d)).where("state IS NOT NULL").drop("submitted_at"))
register("FLT5_review_comments", ["review_comments", "pull_requests"],
         "SELECT CAST(pr_id AS VARCHAR) AS pr_id, concat('inline-', pr_id) AS review_id, CAST(comment_id AS VARCHAR) AS comment_id, author_login, body, path "
         "FROM review_comments WHERE pr_id IN (SELECT id FROM pull_requests)",
         lambda s, d: records.review_comments(landed(s, d)).drop("position", "created_at"))
register("FLT6_issue_comments", ["issue_comments", "pull_requests"],
         "SELECT CAST(pr_id AS VARCHAR) AS pr_id, CAST(comment_id AS VARCHAR) AS comment_id, author_login, body FROM issue_comments "
         "WHERE pr_id IN (SELECT id FROM pull_requests)", lambda s, d: records.issue_comments(landed(s, d)).drop("created_at"))
register("FLT7_labels", ["pull_requests"], "SELECT CAST(id AS VARCHAR) AS id, array_to_string(labels, ';') AS labels FROM pull_requests",
         lambda s, d: nested(s, d).select("pull_request.id", F.array_join(records.label_names(F.col("pull_request.labels.nodes")), ";").alias("labels")))
register("FLT1_FLT8_pull_requests", ["pull_requests", "commits", "reviews", "review_comments", "issue_comments"],
         "SELECT CAST(p.id AS VARCHAR) AS id, p.repo, p.owner, p.repo_name, p.number, p.title, p.body, p.author_login, "
         "CASE WHEN p.author_login IS NULL THEN NULL ELSE p.author_type END AS author_type, p.state, p.is_merged, "
         "p.additions, p.deletions, p.changed_files, v.author_category, v.is_ai_authored, v.ai_authored_kind, v.ai_authored_method, v.ai_authored_confidence, "
         "v.is_ai_reviewed, v.ai_reviewer_logins_str, v.n_ai_reviewers FROM pull_requests p JOIN verdict v ON v.pr_id = p.id",
         lambda s, d: records.build_tables(landed(s, d))["pull_requests"].drop("created_at", "closed_at", "merged_at", "labels", "ai_authored_evidence"),
         VERDICT_STEPS)
register("FLT9_truncated_connections", ["commits", "pull_requests"],
         "SELECT CAST(pr_id AS VARCHAR) AS pr_id, 'commits' AS connection, count(*) AS total, count(*) - 1 AS fetched FROM commits "
         "WHERE pr_id IN (SELECT id FROM pull_requests) GROUP BY pr_id",
         lambda s, d: records.truncated_connections(landed(s, d).withColumn("pull_request", F.col("pull_request").withField(
             "commits.nodes", F.expr("slice(pull_request.commits.nodes, 1, greatest(size(pull_request.commits.nodes) - 1, 0))")))))


def fanned_out(spark: SparkSession, sf_dir: str):
    path = scratch_path(spark, "tables")
    records.fan_out(landed(spark, sf_dir), path)
    return counted({name: records.fanned_table(spark, path, name) for name in records.TABLES})


def counted(tables: dict):
    """Name and number of rows of each table."""
    parts = [table.agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name)) for name, table in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


TABLE_COUNTS = (
    "SELECT 'pull_requests' AS name, count(*) AS n FROM pull_requests UNION ALL SELECT 'ai_signals', count(*) FROM pull_requests "
    "UNION ALL SELECT 'commits', count(*) FROM commits WHERE pr_id IN (SELECT id FROM pull_requests) "
    "UNION ALL SELECT 'files_changed', count(*) FROM files_changed WHERE pr_id IN (SELECT id FROM pull_requests) "
    "UNION ALL SELECT 'reviews', (SELECT count(*) FROM reviews WHERE pr_id IN (SELECT id FROM pull_requests)) + "
    "(SELECT count(DISTINCT pr_id) FROM review_comments WHERE pr_id IN (SELECT id FROM pull_requests)) "
    "UNION ALL SELECT 'review_comments', count(*) FROM review_comments WHERE pr_id IN (SELECT id FROM pull_requests) "
    "UNION ALL SELECT 'issue_comments', count(*) FROM issue_comments WHERE pr_id IN (SELECT id FROM pull_requests)")

register("SRC4_FLT8_fan_out", CHILDREN, TABLE_COUNTS, fanned_out)


def fanned_commits(spark: SparkSession, sf_dir: str):
    path = scratch_path(spark, "tables")
    records.fan_out(landed(spark, sf_dir), path)
    return records.fanned_table(spark, path, "commits")


register("SRC4_fanned_commits", ["commits", "pull_requests"], ORACLES["FLT2_commits"].removeprefix(check_sql(["commits", "pull_requests"], "")), fanned_commits)


def landed_documents(spark: SparkSession, sf_dir: str) -> str:
    """A folder of record files, one indented document each, beside files that are cut off, empty, or hold another document."""
    path = scratch_path(spark, "documents")
    rows = nested(spark, sf_dir).withColumn("n", F.col("number") % 7)
    text = F.to_json(F.struct("owner", "repo", "number", "pull_request", "files"), {"pretty": "true"})
    broken = F.when(F.col("n") == 3, F.expr("substring(value, 1, cast(length(value) / 2 as int))")).when(F.col("n") == 5, "[1, 2]").otherwise(F.col("value"))
    records.land_documents(rows.select(F.col("pull_request.id").alias("document"), "n", text.alias("value")).select("document", broken.alias("value")), path)
    return path


register("SRC2_whole_documents", ["pull_requests"], """SELECT CAST(id AS VARCHAR) AS document, CASE WHEN number % 7 IN (3, 5) THEN 'rejected' ELSE 'read' END AS outcome,
             CASE WHEN number % 7 NOT IN (3, 5) THEN owner END AS owner, CASE WHEN number % 7 NOT IN (3, 5) THEN number END AS number FROM pull_requests""",
         lambda s, d: whole_documents(s, landed_documents(s, d)))


def whole_documents(spark: SparkSession, path: str):
    good, bad = records.read_documents(spark, path)
    name = F.nullif(F.regexp_extract("path", "document=([^/]+)", 1), F.lit("")).alias("document")
    return good.select(name, F.lit("read").alias("outcome"), "owner", "number").unionByName(
        bad.select(name, F.lit("rejected").alias("outcome")), allowMissingColumns=True)


def logged(spark: SparkSession, sf_dir: str):
    """Two appends to one log and a line that a killed run cut off, read back."""
    path = scratch_path(spark, "log")
    grid = corpus_view(spark, sf_dir, "grid")
    rows = grid.select(F.col("pr_id").cast("string").alias("pr_id"), "repo", *replay.CELL[1:], "response_text", "error", "latency_ms",
                       F.struct("total_time").alias("usage"))
    logs.append_log(rows.where("task = 'merge_prediction'"), path)
    logs.append_log(rows.where("task = 'review_comment'"), path)
    cut = rows.limit(1).select(F.expr("substring(to_json(struct(*)), 1, 60)").alias("value"))
    cut.write.mode("append").text(path)
    return logs.read_log(spark, path).select(*replay.CELL, F.md5("response_text").alias("text_key"), "error", "latency_ms",
                                             F.col("usage.total_time").alias("total_time"))


register("SRC3_SRC5_answer_log", ["grid"],
         "SELECT CAST(pr_id AS VARCHAR) AS pr_id, context_kind, strategy, task, md5(response_text) AS text_key, error, latency_ms, total_time FROM grid", logged)


def small_file(spark: SparkSession, sf_dir: str):
    path = scratch_path(spark, "summary")
    logs.write_small(stats.merge_status(corpus_view(spark, sf_dir, "pull_requests")), path, "csv")
    return spark.read.option("header", True).schema("repo string, merged long, not_merged long, total long, merge_rate double").csv(path)


register("SRC6_small_result_file", ["pull_requests"], MERGE_STATUS, small_file, STEPS)


# Streams, run until all given input is used.
def streamed_ingest(spark: SparkSession, sf_dir: str):
    path, output = scratch_path(spark, "arriving"), scratch_path(spark, "ingested")
    records.land(nested(spark, sf_dir), path)
    jobs.ingest(jobs.stream_records(spark, path, multi_line=False), output, scratch_path(spark, "progress")).awaitTermination()
    return output


register("STR1_streamed_ingest", ["commits", "pull_requests"],
         "SELECT CAST(pr_id AS VARCHAR) AS pr_id, commit_ord, sha, message, author_name, author_email, author_login, additions, deletions "
         "FROM commits WHERE pr_id IN (SELECT id FROM pull_requests)",
         lambda s, d: s.read.parquet(f"{streamed_ingest(s, d)}/commits").drop("batch_id"))


def streamed_tables(spark: SparkSession, sf_dir: str):
    output = streamed_ingest(spark, sf_dir)
    return counted({name: spark.read.parquet(f"{output}/{name}") for name in records.TABLES})


register("STR1_streamed_tables", CHILDREN, TABLE_COUNTS, streamed_tables)


def streamed_distinct(spark: SparkSession, sf_dir: str):
    path, output = scratch_path(spark, "twice"), scratch_path(spark, "once")
    events = corpus_view(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.unionByName(events).write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    once = jobs.distinct_records(stream, ["event_id"], "ts", "365 days")
    once.writeStream.format("parquet").option("path", output).option("checkpointLocation", scratch_path(spark, "progress")).outputMode(
        "append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(output).select("event_id", "event_type")


register("STR2_distinct_within_watermark", [], "SELECT event_id, event_type FROM events", streamed_distinct)


DELIVERIES = 6
SLOT_SQL = """WITH span AS (SELECT min(epoch_s) AS lo, max(epoch_s) AS hi FROM (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS epoch_s FROM events)),
    placed AS (SELECT event_id, (CAST(floor(epoch(ts)) AS BIGINT) - lo) * 6 // (hi - lo + 1) AS slot FROM events, span)"""


def deliveries(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """Events in six deliveries by time, and the delay that is allowed, one and a half of them.

    Some events come twice in one delivery, some again in the next one, and some only three deliveries late.
    """
    events = corpus_view(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    at = F.unix_timestamp("ts")
    low, high = events.agg(F.min(at), F.max(at)).first()
    slot = F.floor((at - low) * DELIVERIES / (high - low + 1)).cast("int")
    once = F.when(F.col("event_id") % 97 == 0, F.array(slot + 3)).when(F.col("event_id") % 10 == 0, F.array(slot, slot)).when(
        F.col("event_id") % 10 == 1, F.array(slot, slot + 1)).otherwise(F.array(slot))
    sent = events.withColumn("delivery", F.explode(once)).where(F.col("delivery") < DELIVERIES)
    path = scratch_path(spark, "deliveries")
    for number in range(DELIVERIES):  # a file each, in the order of arrival
        sent.where(F.col("delivery") == number).drop("delivery").coalesce(1).write.mode("append").parquet(path)
    return path, (high - low + 1) * 3 // (2 * DELIVERIES)


def late_rows(spark: SparkSession, sf_dir: str):
    path, delay = deliveries(spark, sf_dir)
    folder = scratch_path(spark, "on-time")
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(path)
    jobs.accept_on_time(stream, ["event_id"], "ts", delay, folder, scratch_path(spark, "progress")).awaitTermination()
    accepted = spark.read.parquet(f"{folder}/accepted").select("event_id", F.lit("accepted").alias("outcome"))
    return accepted.unionByName(spark.read.parquet(f"{folder}/rejected").select("event_id", F.col("reason").alias("outcome")))


register("STR2_late_and_repeated", [], f"""{SLOT_SQL}
    SELECT event_id, 'accepted' AS outcome FROM placed WHERE event_id % 97 <> 0
    UNION ALL SELECT event_id, 'late' FROM placed WHERE event_id % 97 = 0 AND slot + 3 < {DELIVERIES}
    UNION ALL SELECT event_id, 'repeated' FROM placed WHERE event_id % 97 <> 0 AND (event_id % 10 = 0 OR event_id % 10 = 1 AND slot + 1 < {DELIVERIES})""", late_rows)


def streamed_resume(spark: SparkSession, sf_dir: str):
    path, output = scratch_path(spark, "wanted"), scratch_path(spark, "answered")
    cells = corpus_view(spark, sf_dir, "grid_cells").select(*replay.CELL)
    done = corpus_view(spark, sf_dir, "grid").where("latency_ms IS NOT NULL").select(*replay.CELL, F.lit("earlier").alias("response_text"))
    done.write.parquet(f"{output}/batch_id=-1")
    progress = scratch_path(spark, "progress")
    # some cells arrive first; then all do, and those that the first run answered are found in what it wrote
    for arriving in (cells.where("pr_id % 2 = 0"), cells):
        arriving.write.mode("append").parquet(path)
        jobs.resume_grid(
            spark.readStream.schema(cells.schema).parquet(path), lambda: spark.read.parquet(output),
            lambda pending: pending.withColumn("response_text", F.lit("answered")), output, progress).awaitTermination()
    return spark.read.parquet(output).where("batch_id >= 0").drop("batch_id")


register("STR4_resumed_grid", ["grid_cells", "grid"],
         "SELECT pr_id, context_kind, strategy, task, 'answered' AS response_text FROM grid_cells "
         "ANTI JOIN (SELECT * FROM grid WHERE latency_ms IS NOT NULL) AS r USING (pr_id, context_kind, strategy, task)", streamed_resume)


def streamed_scores(spark: SparkSession, sf_dir: str):
    """Arriving diffs scored with the forest of the search; a diff is in one of the two tables."""
    from tributary.catalog.features import ALL
    from tributary.catalog.models import diff_forest, sound

    forests = diff_forest([corpus_view(spark, sf_dir, v) for v in ALL])
    path, output, refused = (scratch_path(spark, n) for n in ("diffs", "scored", "refused"))
    diffs = corpus_view(spark, sf_dir, "diffs").drop("comment")
    diffs.write.parquet(path)
    stream = spark.readStream.schema(diffs.schema).parquet(path)
    jobs.score_diffs(stream, forests, output, refused, scratch_path(spark, "progress")).awaitTermination()
    scored = spark.read.parquet(output)
    return scored.select("diff_id", F.lit("scored").alias("outcome"), sound("probability", "prediction").alias("is_sound")).unionByName(
        spark.read.parquet(refused).select("diff_id", F.lit("refused").alias("outcome"), F.lit(True).alias("is_sound")))


QUERIES["STR3_streamed_scores"] = streamed_scores
ORACLES["STR3_streamed_scores"] = check_sql(
    ["diffs"], "SELECT diff_id, CASE WHEN diff_id IN (SELECT diff_id FROM pfiles) THEN 'scored' ELSE 'refused' END AS outcome, true AS is_sound FROM diffs", FILE_STEPS)
