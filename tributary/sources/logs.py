"""Reading and writing tables, answer logs and small result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

USAGE = "struct<total_time:double,prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"
LOG_SCHEMA = f"""
    pr_id string, repo string, context_kind string, task string, strategy string, response_text string,
    turn_texts array<string>, is_conversational boolean, error string, from_cache boolean, latency_ms double,
    usage {USAGE}, turn_usages array<{USAGE}>, model string
"""


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table, optionally only some columns; the scan reads no others."""
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def _parsed_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    lines = spark.read.text(path).where(F.trim("value") != "")
    whole = f"{schema}, _corrupt_record string"
    return lines.select("value", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("row"))


def read_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """An answer log of JSON lines; blank lines and lines that a killed run cut off are left out."""
    return _parsed_log(spark, path, schema).where("row._corrupt_record is null").select("row.*").drop("_corrupt_record")


def rejected_log_lines(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """The lines of an answer log that :func:`read_log` leaves out, but for blank ones."""
    return _parsed_log(spark, path, schema).where("row._corrupt_record is not null").select(F.col("value").alias("line"))


def append_log(rows: DataFrame, path: str) -> None:
    """Append answers to a log; earlier rows stay as they are."""
    rows.write.mode("append").json(path)


def write_small(result: DataFrame, path: str, fmt: str = "json") -> None:
    """A small result as one JSON or CSV file (with header)."""
    writer = result.coalesce(1).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.json(path)
