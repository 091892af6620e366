"""Nested pull-request records and their flattening into relational tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tributary.operators.detection import detect_in_row
from tributary.session import opened, shuffles_dropped

ACTOR = "struct<login:string,__typename:string>"
COMMENT = f"struct<id:string,body:string,path:string,position:bigint,createdAt:string,author:{ACTOR}>"
RECORD_SCHEMA = f"""
    owner string, repo string, number bigint, fetched_at string,
    pull_request struct<
        id:string, number:bigint, title:string, body:string, state:string, merged:boolean,
        createdAt:string, closedAt:string, mergedAt:string, additions:bigint, deletions:bigint, changedFiles:bigint,
        author:{ACTOR},
        labels:struct<totalCount:bigint,nodes:array<struct<name:string>>>,
        commits:struct<totalCount:bigint,nodes:array<struct<commit:struct<oid:string,message:string,additions:bigint,
            deletions:bigint,author:struct<name:string,email:string,user:{ACTOR}>>>>>,
        reviews:struct<totalCount:bigint,nodes:array<struct<id:string,state:string,submittedAt:string,body:string,author:{ACTOR},
            comments:struct<totalCount:bigint,nodes:array<{COMMENT}>>>>>,
        comments:struct<totalCount:bigint,nodes:array<struct<id:string,body:string,createdAt:string,author:{ACTOR}>>>>,
    files array<struct<filename:string,status:string,additions:bigint,deletions:bigint,patch:string>>
"""
TABLES = ("pull_requests", "commits", "files_changed", "reviews", "review_comments", "issue_comments", "ai_signals")
CORRUPT = "_corrupt_record"
#: Bytes and number of whole files that travel as one batch.
WHOLE_BYTES = 1 << 20
WHOLE_FILES = 500


def read_records(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per record document; a document that cannot be read counts as missing."""
    reader = spark.read.schema(f"{RECORD_SCHEMA}, {CORRUPT} string").option("mode", "PERMISSIVE")
    raw = reader.option("multiLine", multi_line).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return raw.where(F.col(CORRUPT).isNull() & F.col("pull_request").isNotNull()).drop(CORRUPT)


def land(nested: DataFrame, path: str) -> None:
    """Nested records as JSON documents, one a line; compressed, as their field names and patches repeat in every record.  What made them is shuffled no more."""
    with shuffles_dropped(nested.sparkSession):
        nested.select("*").write.option("compression", "gzip").json(path)


def _is_hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``value`` of every file below ``path``, each read once, as a whole.

    The driver lists the top folder only.  What lies in it is dealt to tasks, and a folder is listed by the task that reads it: files are many and
    small, and one listing of all of them would be the driver's.
    """
    system, top = opened(path)
    prefix = "file:" if isinstance(system, fs.LocalFileSystem) else path.removesuffix(top)
    entries = [(info.path, info.type == fs.FileType.Directory) for info in system.get_file_info(fs.FileSelector(top)) if not _is_hidden(info.base_name)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(path)
        paths, values, size = [], [], 0
        for batch in batches:
            for entry, is_folder in zip(batch.column("entry").to_pylist(), batch.column("is_folder").to_pylist()):
                found = [i.path for i in system.get_file_info(fs.FileSelector(entry, recursive=True)) if i.is_file] if is_folder else [entry]
                for name in found:
                    if any(map(_is_hidden, name[len(top):].strip("/").split("/"))):
                        continue
                    with system.open_input_stream(name, compression="detect") as file:
                        data = file.read()
                    paths.append(prefix + name)
                    values.append(data.decode("utf-8", "replace"))
                    size += len(data)
                    if size > WHOLE_BYTES or len(paths) >= WHOLE_FILES:
                        yield pa.RecordBatch.from_pydict({"path": paths, "value": values})
                        paths, values, size = [], [], 0
        if paths:
            yield pa.RecordBatch.from_pydict({"path": paths, "value": values})

    # files are dealt in runs, folders one by one
    several = max(1, min(len(entries), max(spark.sparkContext.defaultParallelism, sum(is_folder for _, is_folder in entries))))
    dealt = spark.sparkContext.parallelize(entries, several).toDF("entry string, is_folder boolean")
    return dealt.mapInArrow(read, "path string, value string")


def land_documents(documents: DataFrame, path: str) -> None:
    """Each ``value`` in a file of its own below ``path``, named by its place among equal ``document`` ids and the id.

    Every task fills one folder, so a listing opens a folder for each task, not for each document.  A task that is repeated writes the same names.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(path)
        folder, last, place = f"{top}/part-{TaskContext.get().partitionId():05d}", None, 0
        system.create_dir(folder)
        for batch in batches:
            for document, value in zip(batch.column("document").to_pylist(), batch.column("value").to_pylist()):
                place, last = (place + 1 if document == last else 0), document
                with system.open_output_stream(f"{folder}/{place}.{'' if document is None else f'document={document}'}") as out:
                    out.write((value or "").encode())
        yield pa.RecordBatch.from_pydict({"n": pa.array([], pa.int32())})

    rows = documents.select(F.col("document").cast("string").alias("document"), "value").sortWithinPartitions("document")
    rows.mapInArrow(write, "n int").write.format("noop").mode("overwrite").save()


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files of one document each, however it is laid out: the records with their ``path``, and a table of the bad files.

    A file is read as a whole and parsed in its row, so a file that is no record costs itself only; the bad table holds its ``path``, ``reason``
    and the beginning of its text.
    """
    whole = whole_files(spark, path)
    schema = f"{RECORD_SCHEMA}, {CORRUPT} string"
    parsed = whole.withColumn("_record", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    broken = F.coalesce(F.col(f"_record.{CORRUPT}").isNotNull() | F.col("_record").isNull(), F.lit(True))
    reason = F.when(F.rlike("value", F.lit(r"^\s*$")), "empty").when(broken, "not a record").when(F.col("_record.pull_request").isNull(), "no pull request")
    judged = parsed.withColumn("reason", reason)
    good = judged.where("reason IS NULL").select("path", "_record.*").drop(CORRUPT)
    return good, judged.where("reason IS NOT NULL").select("path", "reason", F.substring("value", 1, 200).alias("beginning"))


def _nodes(block: str) -> Column:
    """Nodes of a connection; a missing connection or a null node gives nothing."""
    return F.filter(F.col(f"pull_request.{block}.nodes"), lambda n: n.isNotNull())


def label_names(nodes: Column) -> Column:
    """Names of the label nodes, null nodes dropped."""
    kept = F.transform(F.filter(nodes, lambda n: n.isNotNull()), lambda n: n["name"])
    return F.coalesce(kept, F.array().cast("array<string>"))


def _commit(pr_id: Column, place: Column, node: Column) -> list[Column]:
    commit = node["commit"]
    return [
        pr_id.alias("pr_id"), place.cast("long").alias("commit_ord"), commit["oid"].alias("sha"), commit["message"].alias("message"),
        commit["author"]["name"].alias("author_name"), commit["author"]["email"].alias("author_email"),
        commit["author"]["user"]["login"].alias("author_login"), commit["additions"].alias("additions"), commit["deletions"].alias("deletions")]


def _file(pr_id: Column, place: Column, node: Column) -> list[Column]:
    kept = ("filename", "status", "additions", "deletions", "patch")
    return [pr_id.alias("pr_id"), place.cast("long").alias("file_ord"), *[node[c].alias(c) for c in kept]]


def _review(pr_id: Column, node: Column) -> list[Column]:
    return [
        pr_id.alias("pr_id"), node["id"].alias("review_id"), node["author"]["login"].alias("reviewer_login"),
        node["author"]["__typename"].alias("reviewer_type"), node["state"].alias("state"), node["submittedAt"].alias("submitted_at")]


def _review_comment(pr_id: Column, review_id: Column, node: Column) -> list[Column]:
    return [
        pr_id.alias("pr_id"), review_id.alias("review_id"), node["id"].alias("comment_id"), node["author"]["login"].alias("author_login"),
        node["body"].alias("body"), node["path"].alias("path"), node["position"].alias("position"), node["createdAt"].alias("created_at")]


def _issue_comment(pr_id: Column, node: Column) -> list[Column]:
    return [
        pr_id.alias("pr_id"), node["id"].alias("comment_id"), node["author"]["login"].alias("author_login"), node["body"].alias("body"),
        node["createdAt"].alias("created_at")]


PR_ID = "pull_request.id"


def commits(records: DataFrame) -> DataFrame:
    """One row per commit in stored order; a null node keeps its place as an empty commit."""
    nodes = records.select(F.col(PR_ID).alias("pr_id"), F.posexplode("pull_request.commits.nodes").alias("n", "node"))
    return nodes.select(*_commit(F.col("pr_id"), F.col("n"), F.col("node")))


def files_changed(records: DataFrame) -> DataFrame:
    rows = records.select(F.col(PR_ID).alias("pr_id"), F.posexplode("files").alias("n", "f"))
    return rows.select(*_file(F.col("pr_id"), F.col("n"), F.col("f")))


def reviews(records: DataFrame) -> DataFrame:
    rows = records.select(F.col(PR_ID).alias("pr_id"), F.explode(_nodes("reviews")).alias("r"))
    return rows.select(*_review(F.col("pr_id"), F.col("r")))


def review_comments(records: DataFrame) -> DataFrame:
    rows = records.select(F.col(PR_ID).alias("pr_id"), F.explode(_nodes("reviews")).alias("r"))
    inner = rows.select("pr_id", F.col("r.id").alias("review_id"), F.explode("r.comments.nodes").alias("c"))
    return inner.select(*_review_comment(F.col("pr_id"), F.col("review_id"), F.col("c")))


def issue_comments(records: DataFrame) -> DataFrame:
    rows = records.select(F.col(PR_ID).alias("pr_id"), F.explode(_nodes("comments")).alias("c"))
    return rows.select(*_issue_comment(F.col("pr_id"), F.col("c")))


def _plain_request() -> list[Column]:
    p = F.col("pull_request")
    return [
        p["id"].alias("id"), F.concat_ws("/", "owner", "repo").alias("repo"), F.col("owner").alias("owner"), F.col("repo").alias("repo_name"),
        F.col("number").alias("number"), p["title"].alias("title"), p["body"].alias("body"), p["author"]["login"].alias("author_login"),
        p["author"]["__typename"].alias("author_type"), p["createdAt"].alias("created_at"), p["closedAt"].alias("closed_at"),
        p["mergedAt"].alias("merged_at"), p["state"].alias("state"), F.coalesce(p["merged"], F.lit(False)).alias("is_merged"),
        p["additions"].alias("additions"), p["deletions"].alias("deletions"), p["changedFiles"].alias("changed_files"),
        label_names(p["labels"]["nodes"]).alias("labels")]


SIGNALS = [
    "is_ai_authored", "ai_authored_kind", "ai_authored_method", "ai_authored_confidence", "ai_authored_evidence",
    "is_ai_reviewed", "ai_reviewer_logins_str", "n_ai_reviewers",
]


def _detected(records: DataFrame) -> DataFrame:
    """The records with detection columns beside them, from each record's own arrays."""
    p, none = F.col("pull_request"), F.array().cast("array<string>")
    made = F.transform(p["commits"]["nodes"], lambda node: F.struct(
        node["commit"]["author"]["user"]["login"].alias("login"), node["commit"]["author"]["name"].alias("name"),
        node["commit"]["author"]["email"].alias("email"), node["commit"]["message"].alias("message"), node["commit"]["oid"].alias("sha")))
    inside = F.flatten(F.transform(_nodes("reviews"), lambda r: F.coalesce(F.transform(r["comments"]["nodes"], lambda c: c["author"]["login"]), none)))
    return detect_in_row(records, p["id"], p["author"]["login"], p["author"]["__typename"], made, {
        "review": F.transform(_nodes("reviews"), lambda r: r["author"]["login"]), "review_comment": inside,
        "issue_comment": F.transform(_nodes("comments"), lambda c: c["author"]["login"])})


def ai_signals(records: DataFrame) -> DataFrame:
    """One detection row per record."""
    return _detected(records).select("pr_id", "author_category", *SIGNALS)


def pull_requests(records: DataFrame) -> DataFrame:
    """One row per record, its detection folded in."""
    return _detected(records).select(*_plain_request(), "author_category", *SIGNALS)


def build_tables(records: DataFrame) -> dict[str, DataFrame]:
    """All seven tables of a set of records, each a projection of the same rows."""
    return {
        "pull_requests": pull_requests(records),
        "commits": commits(records),
        "files_changed": files_changed(records),
        "reviews": reviews(records),
        "review_comments": review_comments(records),
        "issue_comments": issue_comments(records),
        "ai_signals": ai_signals(records).drop("author_category"),
    }


def fan_out(records: DataFrame, path: str, mode: str = "overwrite") -> StructType:
    """All seven tables below ``path`` in one pass: records are read once, each row is tagged with its table, nothing is shuffled.

    A written row holds one struct, named like its table; :func:`fanned_table` reads a table back.  The schema of the written rows is returned.
    """
    pr_id, reviewed, remarks = F.col(PR_ID), _nodes("reviews"), F.array().cast(f"array<{COMMENT}>")
    lists = _detected(records).select(
        F.array(F.struct(*_plain_request(), "author_category", *SIGNALS)).alias("pull_requests"),
        F.transform("pull_request.commits.nodes", lambda node, n: F.struct(*_commit(pr_id, n, node))).alias("commits"),
        F.transform("files", lambda node, n: F.struct(*_file(pr_id, n, node))).alias("files_changed"),
        F.transform(reviewed, lambda r: F.struct(*_review(pr_id, r))).alias("reviews"),
        F.flatten(F.transform(reviewed, lambda r: F.transform(F.coalesce(r["comments"]["nodes"], remarks), lambda c: F.struct(*_review_comment(pr_id, r["id"], c))))).alias("review_comments"),
        F.transform(_nodes("comments"), lambda c: F.struct(*_issue_comment(pr_id, c))).alias("issue_comments"),
        F.array(F.struct("pr_id", *SIGNALS)).alias("ai_signals"))
    kinds = {field.name: field.dataType for field in lists.schema}

    def tagged(name: str) -> Column:
        return F.transform(F.coalesce(F.col(name), F.array().cast(kinds[name])), lambda row: F.struct(
            F.lit(name).alias("table"), *[(row if other == name else F.lit(None)).cast(kind.elementType).alias(other) for other, kind in kinds.items()]))

    rows = lists.select(F.explode(F.concat(*[tagged(name) for name in kinds])).alias("row")).select("row.*")
    rows.write.mode(mode).partitionBy("table").parquet(path)
    return rows.schema


def fanned_table(spark: SparkSession, path: str, name: str, schema: StructType | None = None) -> DataFrame:
    """One of the tables that :func:`fan_out` wrote; other tables' files are not read.  With the ``schema``, a table without rows is read too."""
    if schema is not None:
        return spark.read.schema(schema).parquet(path).where(F.col("table") == name).select(f"{name}.*")
    return spark.read.parquet(f"{path}/table={name}").select(f"{name}.*")


def drop_fanned(path: str, name: str) -> None:
    """Remove what :func:`fan_out` wrote of a table that stands elsewhere by now; its folder stays, empty."""
    system, at = opened(f"{path}/table={name}")
    if system.get_file_info(at).type == fs.FileType.Directory:
        system.delete_dir_contents(at)


def truncated_connections(records: DataFrame) -> DataFrame:
    """``pr_id, connection, total, fetched`` where a page cut off nodes."""
    blocks = F.array(*[
        F.struct(
            F.lit(name).alias("connection"), F.col(f"pull_request.{name}.totalCount").alias("total"),
            F.coalesce(F.greatest(F.size(f"pull_request.{name}.nodes"), F.lit(0)), F.lit(0)).cast("long").alias("fetched"))
        for name in ("commits", "reviews", "comments")
    ])
    rows = records.select(F.col("pull_request.id").alias("pr_id"), F.explode(blocks).alias("_b")).select("pr_id", "_b.*")
    return rows.where(F.coalesce("total", F.lit(0)) > F.col("fetched"))


def write_tables(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> list[str]:
    """One Parquet table per entry below ``path``."""
    written = []
    for name, table in tables.items():
        table.write.mode(mode).parquet(f"{path}/{name}")
        written.append(f"{path}/{name}")
    return written


def nest(
    requests: DataFrame, commit_rows: DataFrame, file_rows: DataFrame, review_rows: DataFrame,
    review_comment_rows: DataFrame, issue_comment_rows: DataFrame,
) -> DataFrame:
    """Records in the nested shape from relational tables, the reverse of flattening.

    A record holds all rows of one pull request by definition of the format.
    Review comments hang below one review of their own.
    """
    def actor(login: str, kind: Column) -> Column:
        return F.when(F.col(login).isNotNull(), F.struct(F.col(login).alias("login"), kind.alias("__typename")))

    def gather(rows: DataFrame, order: str, node: Column, name: str) -> DataFrame:
        sized = rows.groupBy(F.col("pr_id").cast("string").alias("pr_id")).agg(
            F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), node.alias("node")))).alias("_l"))
        return sized.select("pr_id", F.transform("_l", lambda l: l["node"]).alias(name))

    def gather_by_first(rows: DataFrame, node: Column, name: str) -> DataFrame:
        """As ``gather``, where the order is the node's first field already: it is not shuffled twice."""
        return rows.groupBy(F.col("pr_id").cast("string").alias("pr_id")).agg(F.array_sort(F.collect_list(node)).alias(name))

    user = F.when(F.col("author_login").isNotNull(), F.struct(F.col("author_login").alias("login"), F.lit("User").alias("__typename")))
    commit = F.struct(F.struct(
        F.col("sha").alias("oid"), "message", "additions", "deletions",
        F.struct(F.col("author_name").alias("name"), F.col("author_email").alias("email"), user.alias("user")).alias("author"),
    ).alias("commit"))
    file = F.struct("filename", "status", "additions", "deletions", "patch")
    review = F.struct(
        F.col("review_id").alias("id"), "state", F.col("submitted_at").cast("string").alias("submittedAt"),
        actor("reviewer_login", F.col("reviewer_type")).alias("author"))
    comment = F.struct(
        F.col("comment_id").cast("string").alias("id"), "body", "path", actor("author_login", F.lit("User")).alias("author"))
    remark = F.struct(F.col("comment_id").cast("string").alias("id"), "body", actor("author_login", F.lit("User")).alias("author"))
    joined = (
        requests.withColumn("pr_id", F.col("id").cast("string"))
        .join(gather(commit_rows, "commit_ord", commit, "commit_nodes"), "pr_id", "left")
        .join(gather(file_rows, "file_ord", file, "files"), "pr_id", "left")
        .join(gather_by_first(review_rows, review, "review_nodes"), "pr_id", "left")
        .join(gather(review_comment_rows, "comment_id", comment, "inline_nodes"), "pr_id", "left")
        .join(gather(issue_comment_rows, "comment_id", remark, "remark_nodes"), "pr_id", "left")
    )
    with_comments = F.transform("review_nodes", lambda r: F.named_struct(
        F.lit("id"), r["id"], F.lit("state"), r["state"], F.lit("submittedAt"), r["submittedAt"], F.lit("author"), r["author"],
        F.lit("comments"), F.lit(None).cast(f"struct<totalCount:bigint,nodes:array<{COMMENT}>>")))
    carrier = F.when(F.col("inline_nodes").isNotNull(), F.array(F.struct(
        F.concat(F.lit("inline-"), "pr_id").alias("id"), F.struct(F.col("inline_nodes").alias("nodes")).alias("comments"))))

    def connection(nodes: str, name: str) -> Column:
        total = F.coalesce(F.greatest(F.size(nodes), F.lit(0)), F.lit(0))
        return F.struct(total.alias("totalCount"), F.col(nodes).alias("nodes")).alias(name)

    # Review nodes and the carrier of the inline comments differ in shape, so they meet as JSON text.
    reviews_json = F.concat(
        F.lit("["), F.concat_ws(",", F.transform(with_comments, lambda r: F.to_json(r)), F.transform(carrier, lambda r: F.to_json(r))), F.lit("]"))
    node_type = (f"array<struct<id:string,state:string,submittedAt:string,body:string,author:{ACTOR},"
                 f"comments:struct<totalCount:bigint,nodes:array<{COMMENT}>>>>")
    return joined.select(
        "owner", F.col("repo_name").alias("repo"), "number",
        F.struct(
            F.col("pr_id").alias("id"), "number", "title", "body", "state", F.col("is_merged").alias("merged"),
            F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"),
            "additions", "deletions", F.col("changed_files").alias("changedFiles"),
            actor("author_login", F.col("author_type")).alias("author"),
            F.struct(F.transform("labels", lambda l: F.struct(l.alias("name"))).alias("nodes")).alias("labels"),
            connection("commit_nodes", "commits"),
            F.struct(F.from_json(reviews_json, node_type).alias("nodes")).alias("reviews"),
            connection("remark_nodes", "comments"),
        ).alias("pull_request"),
        "files",
    )
