from collections import Counter

import duckdb
import pytest
from helpers import ODD_ROWS, SMALL, have_tables, no_documents, odd_documents, rows, small

from tributary.llm import quality_rules as q
from tributary.llm.registry import ORACLES, QUERIES

NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def plain(doc_id, text):
    text = text or ""
    spaces = " \t\n\x0b\x0c\r"
    words = "".join(" " if c in spaces else c for c in text).split(" ")
    words = [w for w in words if w]
    lines = [x for x in text.split("\n") if any(c not in spaces for c in x)]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return (doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_counts_of_odd_rows(spark):
    out = q.judge(odd_documents(spark, extra=True))
    assert sorted(rows(out.select(*NAMES)), key=str) == sorted((plain(*r[:2]) for r in ODD_ROWS), key=str)
    assert not any(r.kept for r in out.collect() if r.base_failed)
    assert q.judge(no_documents(spark)).count() == 0


@pytest.mark.skipif(not have_tables, reason="no test tables")
def test_whole_table_against_brute_force_and_sql(spark):
    docs = small(spark, "documents")
    assert sorted(rows(q.judge(docs).select(*NAMES))) == sorted(plain(i, t) for i, t in rows(docs.select("doc_id", "text")))
    frame = QUERIES["op1_quality_rules"](spark, SMALL)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    result = connection.execute(ORACLES["op1_quality_rules"])
    names = [d[0] for d in result.description]
    assert sorted(result.fetchall()) == sorted(rows(frame.select(*names)))


def test_buckets_are_monotone_and_narrow(spark):
    out = spark.range(0, 5000).select("id", q.bucket(q.F.col("id")).alias("b")).select("id", "b", q.bucket_start(q.F.col("b")).alias("s")).orderBy("id").collect()
    assert all(x.b <= y.b for x, y in zip(out, out[1:]))
    assert all(r.s <= r.id <= r.s * (1 + 1 / 32) for r in out)


def test_thresholds_adapt_to_the_group(spark):
    words = " ".join(f"w{i}" for i in range(100))
    marked = " ".join(f"w{i}" + ("#" if i % 2 else "") for i in range(100))
    code = [(i, marked, "en", "code", 1) for i in range(300)] + [(i, words, "en", "prose", 1) for i in range(300, 600)] + [(999, marked, "en", "prose", 1), (1000, marked, None, None, 1)]
    docs = spark.createDataFrame(code, "doc_id long, text string, lang string, source string, n_chars long")
    for held in (100, 0):
        kept = {r.doc_id: r.kept for r in q.judge(docs, held_groups=held).collect()}
        assert all(kept[i] for i in range(600)) and not kept[999]


def test_sketches_merge(spark):
    counted = q.counts(odd_documents(spark).unionByName(odd_documents(spark)))
    once, twice = (sorted(((*r[:-1],), r[-1]) for r in ((str(x.level), str(x.lang), str(x.source), x.rate, x.bucket, x.n) for x in q.sketches(c).collect()))
                   for c in (q.counts(odd_documents(spark)), counted))
    assert [(k, 2 * n) for k, n in once] == twice
