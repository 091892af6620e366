"""A training-text pipeline: each stage works on the documents that the stage before it kept.

Quality classifier, near duplicates, benchmark leaks and secrets return documents; packing returns the places of
their pieces in sequences.  Every stage is written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tributary.llm import decontaminate, packing, quality_classifier, secret_scan, similar_texts
from tributary.llm.registry import query, table
from tributary.session import scratch_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, accepts."""
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity from 0.8): the one with the least id."""
    return similar_texts.keep_one(docs)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is covered to a half or more."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    ledger = secret_scan.update_ledger(docs, scratch_path(spark, "ledger"))
    return secret_scan.mask(docs, ledger)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    pieces = packing.tokenise(docs, packing.tokenizer_path())
    return packing.pack(pieces.select("doc_id", "piece", "start", "length"))


STAGES = [
    ("quality_classifier", good),
    ("simhash_near_duplicates", distinct),
    ("benchmark_decontamination", unleaked),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

#: A trained model, tilings and packings are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{number}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
