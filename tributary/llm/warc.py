"""WARC archives of pages and a two-level capture index.

Archives: every task writes its pages as records, each a gzip member of its own, into files of the shared folder, and returns a row
for each record.  Of pages with equal payloads of ``LEAST_REVISITED`` bytes or more, those with the largest page_id are responses, the
others revisits that name it (``WARC-Refers-To``); revisits hold no payload but its digest and length.

Index: the rows are sorted by reversed-host URL key (``com,example,www)/path``), then page_id, and written as compressed blocks of
``BLOCK_LINES`` lines; each index file ends with its directory, the first key of each block and its place.  A
lookup holds only the range of keys of each index file: it sorts the wanted keys, binary-searches the files, then the
directory of one file at a time, then the block that it read by its range.  Records are read by their ranges too, those that
stand close together by one request.

Files are written and read through ``pyarrow.fs``, so the shared folder (``spark.checkpoint.dir``) may be any that it opens: a
mounted folder, HDFS, S3 or GCS.  A task that is repeated writes new files; only those that a row names are read.

A null page_id is the smallest; a null html is an empty payload; a null URL, or one without ``://``, has no host.  Repeated rows
are records each: those with the largest page_id of their payload are all responses.  Extra columns are ignored; an empty table
gives no files and no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import slices
from tributary.llm.registry import query, table
from tributary.session import scratch_path

LEAST_REVISITED = 1000
#: Lines of an index block.
BLOCK_LINES = 3000
#: Repeated payloads that every task may hold; beyond it the rarer ones meet their pages by a join.
HELD_DIGESTS = 1_000_000
#: Bytes that one request reads at most, and the gap between records that it reads over.
REQUEST_BYTES = 4 << 20
GAP_BYTES = 64 << 10
#: The tables hold no capture time.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = re.compile(rb"Content-Length: (\d+)", re.I)


def url_key(url: Column) -> Column:
    """``com,example,www)/path?query`` of ``scheme://www.example.com/path?query``; without a host ``)`` and the URL."""
    url = F.coalesce(url, F.lit(""))
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(url)
    host = F.when(start > 0, F.regexp_extract(rest, "^[^/?#]*", 0)).otherwise("")
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.array_join(F.reverse(F.split(lower, "[.]")), ","), F.lit(")"), F.substring(rest, F.length(host) + 1, F.length(url)))


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, and its path there."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", folder))


def page_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    digits = name.strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response or revisit record, uncompressed."""
    length = len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    safe = re.sub(r"[\x00-\x20\x7f-\xa0]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", page_name(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", safe),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", page_name(refers_to))]
    return "".join(["WARC/1.1\r\n", *(f"{name}: {value}\r\n" for name, value in fields), "\r\n"]).encode() + block + b"\r\n\r\n"


@dataclass
class Record:
    kind: str
    page_id: int | None
    url: str
    digest: str
    refers_to: int | None
    length: int
    payload: bytes | None


def parsed(data: bytes) -> Record:
    """A record from its uncompressed bytes; the payload's length is that of the HTTP header, so revisits have it too."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    refers_to = page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
    length = int(_HTTP.search(http)[1])
    if kind == "response" and length != len(payload):
        raise ValueError(f"{fields['WARC-Record-ID']}: {len(payload)} bytes of {length}")
    return Record(kind, page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                  refers_to, length, payload if kind == "response" else None)


def _digest() -> Column:
    return F.sha1(F.coalesce("html", F.lit("")).cast("binary"))


def with_kinds(pages: DataFrame, least: int = LEAST_REVISITED, held: int = HELD_DIGESTS) -> DataFrame:
    """page_id, url, html, digest, and of repeated payloads ``repeated`` and ``latest``, their largest page_id.

    Repeated payloads are counted first.  Those with a share of at least 1 / held of the pages (at most ``held``) are
    broadcast, all of them if they are no more; the others are rare and met by a join on the digest.
    """
    rows = pages.select("page_id", "url", "html", _digest().alias("digest"))
    sized = pages.select("page_id", _digest().alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"))
    path = scratch_path(pages.sparkSession, "repeated-payloads")
    sized.filter(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).filter("n > 1").write.parquet(path)
    repeated = pages.sparkSession.read.parquet(path)
    if repeated.count() <= held:
        often, rare = repeated, None
    else:
        least_n = -(-pages.count() // held)
        often, rare = repeated.filter(F.col("n") >= least_n), repeated.filter(F.col("n") < least_n)
    out = rows.join(F.broadcast(often.drop("n").withColumn("repeated", F.lit(True))), "digest", "left")
    if rare is not None:
        out = out.join(rare.select("digest", F.col("latest").alias("rare_latest"), F.lit(True).alias("rare")), "digest", "left").select(
            "page_id", "url", "html", "digest", F.coalesce("repeated", "rare").alias("repeated"), F.coalesce("latest", "rare_latest").alias("latest"))
    return out.select("page_id", "url", "html", "digest", F.coalesce("repeated", F.lit(False)).alias("repeated"), "latest")


_CAPTURE = "key string, page_id long, url string, digest string, kind string, archive string, offset long, length long"


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISITED, held: int = HELD_DIGESTS) -> DataFrame:
    """Write the pages as archives below ``folder``; a row for each record: its key, page, digest, kind and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_folder(folder)
        files.create_dir(path, recursive=True)
        name, sink, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in slices(batches, 200):
                out: list[tuple] = []
                for page_id, url, html, digest, repeated, latest, key in zip(*(column.to_pylist() for column in batch.columns)):
                    if sink is None:
                        sink = files.open_output_stream(f"{path}/{name}", compression=None)
                    kind = "revisit" if repeated and page_id != latest else "response"
                    data = _gzipped(record(kind, page_id, url, (html or "").encode(), digest, latest))
                    sink.write(data)
                    out.append((key, page_id, url, digest, kind, name, at, len(data)))
                    at += len(data)
                yield pa.RecordBatch.from_pylist([dict(zip(_CAPTURE_SCHEMA.names, row)) for row in out], schema=_CAPTURE_SCHEMA)
        finally:
            if sink is not None:
                sink.close()

    path = scratch_path(pages.sparkSession, "captures")
    with_kinds(pages, least, held).withColumn("key", url_key(F.col("url"))).mapInArrow(run, _CAPTURE).write.parquet(path)
    return pages.sparkSession.read.parquet(path)


_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_CAPTURE_SCHEMA = pa.schema([(name, _KINDS[kind]) for name, kind in (part.split() for part in _CAPTURE.split(", "))])


def _gzipped(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def _order(key: str, page_id: int | None) -> tuple[bytes, int]:
    """How captures are sorted: keys by their bytes, null page ids first."""
    return key.encode(), -(1 << 63) if page_id is None else page_id


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the captures as sorted blocks below ``folder``; a row for each index file: its first and last capture, and its directory's place."""
    fields = "file string, first_key string, first_id long, last_key string, last_id long, offset long, length long"
    schema = pa.schema([(name, _KINDS[kind]) for name, kind in (part.split() for part in fields.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_folder(folder)
        files.create_dir(path, recursive=True)
        name, sink, at = f"{uuid.uuid4().hex}.idx", None, 0
        directory: list[tuple] = []
        lines: list[tuple] = []
        last = None

        def block() -> None:
            nonlocal at, lines, last
            data = _gzipped("\n".join(map(json.dumps, lines)).encode())
            sink.write(data)
            directory.append((lines[0][0], lines[0][1], at, len(data)))
            last, at, lines = lines[-1], at + len(data), []

        try:
            for batch in slices(batches):
                if batch.num_rows and sink is None:
                    sink = files.open_output_stream(f"{path}/{name}", compression=None)
                for line in zip(*(column.to_pylist() for column in batch.columns)):
                    lines.append(line)
                    if len(lines) >= block_lines:
                        block()
            if lines:
                block()
            if directory:
                data = _gzipped("\n".join(map(json.dumps, directory)).encode())
                sink.write(data)
        finally:
            if sink is not None:
                sink.close()
        if directory:
            row = (name, *directory[0][:2], last[0], last[1], at, len(data))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row))], schema=schema)

    # by page_id too, so that many captures of one URL spread over files
    ordered = captures.select(*_CAPTURE_SCHEMA.names).repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    path = scratch_path(captures.sparkSession, "index-files")
    ordered.mapInArrow(run, fields).write.parquet(path)
    return captures.sparkSession.read.parquet(path)


def _tasks(frame: DataFrame) -> int:
    """Tasks for reading: a row is small beside what it makes a task read, so few bytes must not mean few tasks."""
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _lines(files: fs.FileSystem, path: str, offset: int, length: int) -> list[list]:
    """Lines of a block or directory, read by its range."""
    with files.open_input_file(path) as source:
        data = source.read_at(length, offset)
    return [json.loads(line) for line in zlib.decompress(data, 31).decode().split("\n")]


class IndexReader:
    """Captures by key: the index files' ranges are held, one directory and one block at a time are read."""

    def __init__(self, folder: str, index_files: list[tuple]):
        self.files, self.path = open_folder(folder)
        self.index_files = sorted(index_files, key=lambda row: _order(row[1], row[2]))
        self.firsts = [_order(row[1], row[2]) for row in self.index_files]
        self.lasts = [_order(row[3], row[4]) for row in self.index_files]
        self.directory: tuple[str, list, list] = ("", [], [])
        self.block: tuple[tuple, list, list] = ((), [], [])
        self.requests = 0

    def _directory(self, number: int) -> tuple[str, list, list]:
        name, *_, offset, length = self.index_files[number]
        if self.directory[0] != name:
            rows = _lines(self.files, f"{self.path}/{name}", offset, length)
            self.requests += 1
            self.directory = name, rows, [_order(*row[:2]) for row in rows]
        return self.directory

    def _block(self, name: str, offset: int, length: int) -> tuple[tuple, list, list]:
        if self.block[0] != (name, offset):
            rows = _lines(self.files, f"{self.path}/{name}", offset, length)
            self.requests += 1
            self.block = (name, offset), rows, [_order(*row[:2]) for row in rows]
        return self.block

    def find(self, low: tuple[bytes, int], high: tuple[bytes, int]) -> Iterator[list]:
        """Captures from ``low`` to ``high``, both included."""
        number = bisect_left(self.lasts, low)
        while number < len(self.firsts) and self.firsts[number] <= high:
            name, directory, starts = self._directory(number)
            at = max(0, bisect_left(starts, low) - 1)
            while at < len(directory) and starts[at] <= high:
                _, rows, keys = self._block(name, *directory[at][2:])
                yield from rows[bisect_left(keys, low):bisect_right(keys, high)]
                at += 1
            number += 1


def lookup(wanted: DataFrame, folder: str, index_files: DataFrame, with_page: bool = False) -> DataFrame:
    """The captures that have the key of a URL in ``wanted`` (column url; ``with_page``: and its page_id), a row for each.

    The index files' ranges are as many rows as the index has files (its tasks), which bounds what tasks hold.
    """
    held = wanted.sparkSession.sparkContext.broadcast([tuple(row) for row in index_files.collect()])
    names = ["key", "page_id"] if with_page else ["key"]
    ordered = wanted.withColumn("key", url_key(F.col("url"))).select(*names).distinct().repartitionByRange(_tasks(wanted), *names).sortWithinPartitions(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = IndexReader(folder, held.value)
        for batch in slices(batches):
            out = []
            ids = batch.column("page_id").to_pylist() if with_page else [None] * batch.num_rows
            for sought, page_id in zip(batch.column("key").to_pylist(), ids):
                low, high = _order(sought, page_id), _order(sought, page_id if with_page else (1 << 63) - 1)
                out += reader.find(low, high)
                if len(out) > 10_000:  # a URL may have any number of captures
                    yield pa.RecordBatch.from_pylist([dict(zip(_CAPTURE_SCHEMA.names, row)) for row in out], schema=_CAPTURE_SCHEMA)
                    out = []
            yield pa.RecordBatch.from_pylist([dict(zip(_CAPTURE_SCHEMA.names, row)) for row in out], schema=_CAPTURE_SCHEMA)

    return ordered.mapInArrow(run, _CAPTURE)


def read_records(captures: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of ``captures`` (archive, offset, length), read from the archives by ranges in the order of their places.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to, and with ``payloads`` the payload of responses.  The digest of a response is
    computed from what was read.
    """
    fields = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if payloads:
        fields += ", payload binary"
    schema = pa.schema([(name, _KINDS[kind]) for name, kind in (part.split() for part in fields.split(", "))])
    ordered = captures.select("archive", "offset", "length").repartitionByRange(_tasks(captures), "archive", "offset").sortWithinPartitions("archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_folder(folder)
        for batch in slices(batches):
            places = list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))))
            for archive, start, end, parts in requests(places):
                with files.open_input_file(f"{path}/{archive}") as source:
                    data = source.read_at(end - start, start)
                out = []
                for offset, length in parts:
                    found = parsed(zlib.decompress(data[offset - start:offset - start + length], 31))
                    digest = found.digest if found.payload is None else hashlib.sha1(found.payload).hexdigest()
                    if digest != found.digest:
                        raise ValueError(f"{archive} at {offset}: the payload's digest is {digest}, not {found.digest}")
                    row = (found.page_id, found.url, found.length, digest, found.kind, found.refers_to, found.payload)
                    out.append(dict(zip(schema.names, row)))
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return ordered.mapInArrow(run, fields)


def requests(places: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Ranges (archive, start, end, records) that read the sorted places: neighbours together up to ``REQUEST_BYTES``."""
    open_range: tuple | None = None
    for archive, offset, length in places:
        if open_range is not None:
            name, start, end, parts = open_range
            if name == archive and offset - end <= GAP_BYTES and max(end, offset + length) - start <= REQUEST_BYTES:
                open_range = name, start, max(end, offset + length), [*parts, (offset, length)]
                continue
            yield open_range
        open_range = archive, offset, offset + length, [(offset, length)]
    if open_range is not None:
        yield open_range


def with_payloads(records: DataFrame) -> DataFrame:
    """``records`` read with payloads, revisits with that of the response that they refer to."""
    responses = records.filter("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("payload").alias("of_response"))
    return records.join(responses, ["refers_to", "payload_digest"], "left").select(
        *[c for c in records.columns if c != "payload"], F.coalesce("payload", "of_response").alias("payload"))


SQL = f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS bytes FROM pages),
latest AS (SELECT *, CASE WHEN bytes >= {LEAST_REVISITED} THEN max(page_id) OVER (PARTITION BY payload) ELSE page_id END AS response FROM payloads)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest, CASE WHEN page_id IS DISTINCT FROM response THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to FROM latest
"""


@query("op13_warc_capture_index", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages, index the archives, look every page's capture up, and read its record."""
    pages = table(spark, sf_dir, "pages")
    archives, index = scratch_path(spark, "archives"), scratch_path(spark, "index")
    index_files = write_index(write_archives(pages, archives), index)
    captures = lookup(pages, index, index_files, with_page=True)
    return read_records(captures, archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
