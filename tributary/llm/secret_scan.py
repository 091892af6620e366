"""Secret scans over a ledger of content-addressed blobs.

A version is a path and its text.  A text is a blob, addressed by its SHA-256.  The ledger holds the findings of
every (blob, rule version) scanned so far; a run scans only pairs that it lacks, each blob once however many
paths hold it, and joins the findings back to all paths.  Copies are dropped inside each task before anything
moves, texts move compressed, and findings (one row for a blob) join versions by address.

A null text is scanned as an empty one.  Repeated versions are reported each.  Extra columns are ignored by
``scan`` and kept by ``mask``.  An empty table gives no rows and leaves the ledger as it is; texts of any length are scanned whole; spans that
start together are ordered by kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import Columns, map_columns, sha256_hex, slices, spans_text
from tributary.llm.registry import query, table
from tributary.session import cut_lineage, scratch_path

#: A change to any rule needs a new version, so that old blobs are scanned again.
RULE_VERSION = "2"
#: Blobs and spans of findings that every task may hold (about 100 bytes each).
HELD_FINDINGS = 200_000

# The base kinds, in the order in which they are listed.
KINDS = ["assign", "access", "hex", "key_block", "forge_token", "chat_token", "signed_token"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs are maximal, so asking for 16 characters here finds what the plain run with a later check finds.
HEX = re.compile(r"[0-9a-f]{16,}")
#: Kinds that the scan adds: key blocks, and tokens of code forges, chat services and signed claims.
EXTRA = {
    "key_block": re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"),
    "forge_token": re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})"),
    "chat_token": re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    "signed_token": re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
}
EXTRA_SIGNS = {"key_block": "PRIVATE KEY", "forge_token": "_", "chat_token": "xox", "signed_token": "eyJ"}


def find_secrets(text: str | None) -> list[tuple[int, int, str, int]]:
    """(start, order of kind, kind, end) of every finding, in code points, end exclusive."""
    if not text:
        return []
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    for kind, pattern in EXTRA.items():
        if EXTRA_SIGNS[kind] in text:
            spans += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    return sorted((start, KINDS.index(kind), kind, end) for start, kind, end in spans)


def _address(text: str | None) -> bytes:
    return hashlib.sha256((text or "").encode()).digest()


def addresses(versions: DataFrame, path: str, text: str) -> DataFrame:
    """``path`` and ``blob`` of every version."""
    return versions.select(F.col(path).alias("path"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("blob"))


def _distinct_blobs(versions: DataFrame, text: str) -> DataFrame:
    """``blob`` and its compressed text; a task emits a blob once."""

    def start():
        seen: set[bytes] = set()
        packer = zstandard.ZstdCompressor(level=3)

        def step(batch: Columns) -> Columns:
            out: Columns = {"blob": [], "packed": []}
            for value in batch["text"]:
                blob = _address(value)
                if blob not in seen:
                    seen.add(blob)
                    out["blob"].append(blob)
                    out["packed"].append(packer.compress((value or "").encode()))
            return out

        return step

    return map_columns(versions.select(F.col(text).alias("text")), {"blob": "binary", "packed": "binary"}, start)


def _scan_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Findings of each blob; copies from other tasks arrive in the same partition and are scanned once."""
    seen: set[bytes] = set()
    packer = zstandard.ZstdDecompressor()
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    for batch in slices(batches):
        blobs, spans = [], []
        for blob, packed in zip(batch.column("blob").to_pylist(), batch.column("packed").to_pylist()):
            if blob not in seen:
                seen.add(blob)
                found = find_secrets(packer.decompress(packed).decode())
                blobs.append(blob)
                spans.append([{"kind": k, "start": s, "end": e} for s, _, k, e in found])
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(spans, pa.list_(kind))], names=["blob", "spans"])


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text") -> DataFrame:
    """New ledger rows (blob, rule_version, spans): every pair of a blob here and ``RULE_VERSION`` that ``ledger`` lacks."""
    blobs = _distinct_blobs(versions, text)
    if ledger is not None:
        known = ledger.filter(F.col("rule_version") == RULE_VERSION).select("blob").distinct()
        unseen = addresses(versions, text, text).select("blob").distinct().join(known, "blob", "left_anti")
        blobs = blobs.join(unseen, "blob", "left_semi")
    return (
        blobs.repartition("blob").mapInArrow(_scan_blobs, "blob binary, spans array<struct<kind:string,start:int,end:int>>")
        .select("blob", F.lit(RULE_VERSION).alias("rule_version"), "spans")
    )


def update_ledger(versions: DataFrame, ledger_path: str, text: str = "text") -> DataFrame:
    """Scan what the ledger at ``ledger_path`` lacks, append it there, and return the whole ledger."""
    spark = versions.sparkSession
    schema = "blob binary, rule_version string, spans array<struct<kind:string,start:int,end:int>>"
    try:
        ledger = spark.read.schema(schema).parquet(ledger_path)
    except Exception as error:  # the first run finds no ledger
        if "PATH_NOT_FOUND" not in str(error):
            raise
        ledger = None
    scan_unseen(versions, ledger, text).write.mode("append").parquet(ledger_path)
    return spark.read.schema(schema).parquet(ledger_path)


def _held(found: DataFrame, held_findings: int) -> DataFrame:
    """Findings by blob, to be broadcast where their spans are few enough; else the join shuffles."""
    found = cut_lineage(found)
    size = found.agg(F.sum(1 + F.size("spans"))).first()[0] or 0
    return F.broadcast(found) if size <= held_findings else found


def scan(versions: DataFrame, path: str = "doc_id", text: str = "text", ledger_path: str | None = None) -> DataFrame:
    """``path``, ``blob`` and ``spans`` of every version; without a ledger path, a new ledger in the shared folder."""
    ledger = update_ledger(versions, ledger_path or scratch_path(versions.sparkSession, "ledger"), text)
    current = ledger.filter(F.col("rule_version") == RULE_VERSION).filter(F.size("spans") > 0).select("blob", "spans")
    # runs at the same time may have scanned a blob twice; written, a large table can be joined with skew split
    current = _held(current.dropDuplicates(["blob"]), HELD_FINDINGS)
    return (
        addresses(versions, path, text).join(current, "blob", "left")
        .select("path", "blob", F.coalesce("spans", F.array().cast(current.schema["spans"].dataType)).alias("spans"))
    )


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with every stretch of spans, overlapping ones as one, replaced by ``[SECRET]``."""
    parts, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            parts += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def mask(docs: DataFrame, ledger: DataFrame, held_findings: int = HELD_FINDINGS) -> DataFrame:
    """``docs`` with secrets masked in ``text`` (and ``n_chars``, where it is a column, counted anew)."""
    found = ledger.filter((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0)).select("blob", "spans")
    found = _held(found.dropDuplicates(["blob"]), held_findings)
    marked = docs.select(
        F.struct(*[F.col(name) for name in docs.columns]).alias("row"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob"),
    ).join(found, "blob", "left")
    hidden = marked.filter("spans is not null").select("row.*", F.col("spans").alias("__spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            spans = rows.pop("__spans")
            rows["text"] = [masked(text, [(s["start"], s["end"]) for s in some]) for text, some in zip(rows["text"], spans)]
            if "n_chars" in rows:
                rows["n_chars"] = [len(text) for text in rows["text"]]
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([f for f in batch.schema if f.name != "__spans"]))

    return marked.filter("spans is null").select("row.*").unionByName(hidden.mapInArrow(run, docs.schema))


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from the spans of each path."""

    def step(batch: Columns) -> Columns:
        out: Columns = {"doc_id": batch["path"], **{name: [] for name in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}}
        for spans in batch["spans"]:
            rows = [(s["start"], KINDS.index(s["kind"]), s["kind"], s["end"]) for s in spans]
            for kind in KINDS[:3]:
                out[f"n_{kind}"].append(sum(row[2] == kind for row in rows))
            out["base_sha256"].append(sha256_hex(spans_text([row for row in rows if row[1] < 3])))
            out["spans"].append(spans_text(rows))
        return out

    fields = {"doc_id": "long", "n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string"}
    return map_columns(found.select("path", "spans"), fields, lambda: step)


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")))
