import duckdb
import pytest
from helpers import SMALL, have_tables, no_documents, odd_documents, rows

from tributary.llm import license_scan as s
from tributary.llm.registry import ORACLES, QUERIES


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(rows(s.scan(docs, s.known_digests(spark)).select("doc_id", "scope", "place", "license")))


def test_equivalent_texts(spark):
    mit = "Copyright (c) 2020 Somebody Else\r\n\r\n" + s.MIT.replace("COPYRIGHT HOLDERS", "Copyright\nHolder's".replace("'s", "s")).replace('"AS IS"', "“as is”")
    out = found(spark, [
        mit, "some prose\nReleased under the  mit LICENCE!\nmore prose", "/* Licensed under the Apache Licence, Version 2.0 */", s.ISC.replace("\n", " "),
        "x\n\n" + s.ISC.split("\n\n")[0] + "\n\ny", "released under the mit license of sorts", None, "", "copyright 2020 me\nSPDX-License-Identifier: ISC", "...\n\n---",
    ])
    assert out == [(0, "text", 0, "MIT"), (1, "line", 1, "MIT"), (2, "line", 0, "Apache-2.0"), (2, "text", 0, "Apache-2.0"), (3, "line", 0, "ISC"), (3, "text", 0, "ISC"),
                   (8, "line", 1, "ISC"), (8, "paragraph", 0, "ISC"), (8, "text", 0, "ISC")]


def test_whole_texts_of_the_usual_licences(spark):
    whole = {name: text for name, text in s.KNOWN if len(text) > 1000}
    assert set(whole) >= {"MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"}
    names = sorted(whole)
    out = found(spark, ["Copyright (c) 2021 Somebody\n\n" + " \n".join(whole[name].split("\n")).replace(" License ", " Licence ") for name in names])
    assert [row for row in out if row[1] == "text"] == [(i, "text", 0, name) for i, name in enumerate(names)]


def test_paragraphs_and_odd_rows(spark):
    known = s.known_digests(spark, [("own", "first line here\nsecond line there"), ("own", "FIRST line; here second line there"), ("a", "x " * 3)])
    assert known.count() == 2
    hidden = [(5, "=====\n© 2020 me\nFirst line here, second line there"), (6, "/*\n (c) me\n*/ first line here second line there"), (7, "Copyright 2021 x\nx x x"), (8, "Xx x x")]
    out = rows(s.scan(spark.createDataFrame(hidden, "doc_id long, text string"), known).select("doc_id", "scope", "license"))
    assert sorted(out) == sorted((i, scope, name) for i, name in ((5, "own"), (6, "own"), (7, "a")) for scope in ("line", "paragraph", "text"))
    docs = spark.createDataFrame([(1, "intro\n\n* First line here,\n* second line there.\n\nend"), (1, "intro\n\n* First line here,\n* second line there.\n\nend")], "doc_id long, text string")
    for held in (100, 0):
        assert rows(s.scan(docs, known, held_digests=held).select("doc_id", "scope", "license")) == [(1, "paragraph", "own")] * 2
    assert s.scan(odd_documents(spark, extra=True), s.known_digests(spark)).count() == 0
    assert s.scan(no_documents(spark), s.known_digests(spark)).count() == 0


@pytest.mark.skipif(not have_tables, reason="no test tables")
def test_sql(spark):
    frame = QUERIES["op9_license_scan"](spark, SMALL)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    result = connection.execute(ORACLES["op9_license_scan"])
    names = [d[0] for d in result.description]
    assert sorted(result.fetchall()) == sorted(rows(frame.select(*names)))
