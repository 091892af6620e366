import gzip
import hashlib
import os
import random

import pytest
from helpers import have_tables, rows, small
from pyspark.sql import functions as F

from tributary.llm import warc
from tributary.session import scratch_path

SCHEMA = "page_id long, url string, html string"
LONG, LONGER = "<p>é" * 300, "x" * 1000
ODD = [
    (1, "http://Www.Example.COM/a b\r\nX: y?q#z", LONG), (2, "https://www.example.com/a", LONG), (2, "https://www.example.com/a", LONG),
    (3, None, None), (4, "no scheme", ""), (None, "http://b.net", LONG), (None, None, None), (6, "http://b.net", LONGER), (5, "http://b.net:80/", LONGER),
    (7, "http://b.net", "y" * 999), (8, "http://b.net", "y" * 999), (9, "://", "\r\n\r\nWARC/1.1\r\n\r\n"), (10, "http://münchen.de/ü ", "z" * 200_000),
    (None, "http://c.net", "only null ids " * 100), (None, "http://c.net", "only null ids " * 100),
]


def plain(pages):
    payloads = [(html or "").encode() for _, _, html in pages]
    latest = {}
    for (page_id, _, _), payload in zip(pages, payloads):
        if len(payload) >= 1000:
            ids = [i for i in (latest.get(payload), page_id) if i is not None]
            latest[payload] = max(ids, default=None)
    out = []
    for (page_id, _, _), payload in zip(pages, payloads):
        first = latest.get(payload, page_id)
        revisit = first != page_id
        out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def archived(spark, pages, **options):
    archives, index = scratch_path(spark, "archives"), scratch_path(spark, "index")
    block_lines = options.pop("block_lines", warc.BLOCK_LINES)
    captures = warc.write_archives(pages, archives, **options)
    return archives, index, captures, warc.write_index(captures, index, block_lines)


def read_back(spark, pages, **options):
    archives, index, _, index_files = archived(spark, pages, **options)
    found = warc.read_records(warc.lookup(pages, index, index_files, with_page=True), archives, payloads=False)
    return sorted(rows(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")), key=str)


@pytest.mark.skipif(not have_tables, reason="no test tables")
def test_whole_table(spark):
    pages = small(spark, "pages")
    assert read_back(spark, pages, block_lines=7) == plain(rows(pages.select("page_id", "url", "html")))


@pytest.mark.skipif(not have_tables, reason="no test tables")
def test_sql(spark):
    import duckdb
    from helpers import SMALL

    from tributary.llm.registry import ORACLES, QUERIES

    frame = QUERIES["op13_warc_capture_index"](spark, SMALL)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    result = connection.execute(ORACLES["op13_warc_capture_index"])
    names = [d[0] for d in result.description]
    assert sorted(result.fetchall(), key=str) == sorted(rows(frame.select(*names)), key=str)


def test_odd_rows(spark):
    pages = spark.createDataFrame(ODD, SCHEMA)
    for extra in (pages, pages.selectExpr("*", "'x' AS digest", "1 AS `key`", "2 AS latest", "3 AS `offset`", "4 AS archive", "5 AS repeated", "6 AS n")):
        assert read_back(spark, extra) == plain(ODD)
    assert read_back(spark, pages.limit(0)) == []


@pytest.mark.parametrize("held", [0, 1, 2])
def test_rare_payloads_meet_their_pages_by_a_join(spark, held):
    pages = [(i, f"http://h{i % 3}.net/{i}", LONG if i % 2 else "a" * (1000 + i % 5)) for i in range(40)]
    frame = spark.createDataFrame(pages, SCHEMA)
    assert read_back(spark, frame, held=max(1, held)) == plain(pages)


def test_archives_are_records_and_payloads_come_back(spark):
    pages = spark.createDataFrame(ODD, SCHEMA)
    archives, _, captures, _ = archived(spark, pages)
    folder = archives.removeprefix("file:")
    found = {name: gzip.decompress(open(f"{folder}/{name}", "rb").read()) for name in os.listdir(folder) if name.endswith(".gz")}
    for archive, offset, length, page_id, kind in rows(captures.select("archive", "offset", "length", "page_id", "kind")):
        member = gzip.decompress(open(f"{folder}/{archive}", "rb").read()[offset:offset + length])
        assert member in found[archive] and member.startswith(b"WARC/1.1\r\nWARC-Type: " + kind.encode()) and member.endswith(b"\r\n\r\n")
        assert warc.parsed(member).page_id == page_id
    records = warc.read_records(captures, archives)
    assert records.filter("record_type = 'revisit' and payload is not null").count() == 0
    whole = warc.with_payloads(records.filter("page_id is not null"))
    got = sorted(rows(whole.select("page_id", F.col("payload").cast("string"))), key=str)
    assert got == sorted(((i, html or "") for i, _, html in ODD if i is not None), key=str)


def test_lookup_reads_few_blocks(spark):
    chance = random.Random(3)
    pages = [(i, f"http://{chance.choice(['a', 'b', 'www.b', 'hot'])}.example.org/{chance.randint(0, 60)}", f"page {i}") for i in range(900)]
    pages += [(i, "http://hot.example.org/same", f"page {i}") for i in range(900, 1400)]
    frame = spark.createDataFrame(pages, SCHEMA)
    _, index, _, index_files = archived(spark, frame, block_lines=10)
    wanted = ["http://hot.example.org/same", "http://b.example.org/7", "HTTPS://WWW.B.example.org/7", "http://none.org/", None]
    keys = rows(spark.createDataFrame([(u,) for u in wanted], "url string").select("url", warc.url_key(F.col("url"))))
    assert dict(keys)["HTTPS://WWW.B.example.org/7"] == "org,example,b,www)/7" and dict(keys)[None] == ")"
    found = warc.lookup(spark.createDataFrame([(u,) for u in wanted], "url string"), index, index_files)
    bare = {u.partition("://")[2].lower() for u in wanted if u}
    assert sorted(r.page_id for r in found.collect()) == sorted(i for i, url, _ in pages if url.partition("://")[2] in bare)
    reader = warc.IndexReader(index, [tuple(r) for r in index_files.collect()])
    sought = reader.files and warc._order("org,example,b)/7", None)
    assert len(list(reader.find(sought, (sought[0], 1 << 62)))) == sum(url == "http://b.example.org/7" for _, url, _ in pages)
    assert reader.requests <= 4  # a directory or two, and a block or two, of about 140 blocks


def test_neighbours_are_read_together():
    near = [("a", 0, 10), ("a", 10, 10), ("a", 100, 5), ("a", 10 << 20, 5), ("b", 0, 1)]
    assert [(r[:3], len(r[3])) for r in warc.requests(near)] == [(("a", 0, 105), 3), (("a", 10 << 20, (10 << 20) + 5), 1), (("b", 0, 1), 1)]
    assert list(warc.requests([])) == []
