import random
import re
from collections import Counter

import pytest
from helpers import ODD_ROWS, have_tables, no_documents, odd_documents, rows, small

from tributary.llm import collocations as co

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(texts, least=10, most=3, best=2000):
    """The contract read literally, with whole phrases as tuples in memory."""
    counts, totals = Counter(), Counter()
    for lang, text in texts:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for size in range(1, most + 1):
                for at in range(len(words) - size + 1):
                    counts[lang or "und", tuple(words[at:at + size])] += 1
    candidates = {key: n for key, n in counts.items() if len(key[1]) > 1 and n >= least}
    dropped = set()
    for (lang, phrase), n in candidates.items():
        for size in range(2, len(phrase)):
            for at in range(len(phrase) - size + 1):
                inner = lang, phrase[at:at + size]
                if 100 * n >= 50 * candidates[inner]:
                    dropped.add(inner)
    out = {}
    for (lang, phrase), a in candidates.items():
        if (lang, phrase) not in dropped:
            cuts = []
            for k in range(1, len(phrase)):
                l, r = counts[lang, phrase[:k]], counts[lang, phrase[k:]]  # noqa: E741
                cuts.append((1000000 * a * a // (l * r), k, l, r))
            score, _, l, r = min(cuts)  # noqa: E741
            out.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), l, r))
    return sorted((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score)
                  for lang, found in out.items() for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:best], 1))


def mined(docs, **options):
    frame = co.collocations(docs, **options)
    return sorted(rows(frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")))


@pytest.mark.skipif(not have_tables, reason="no test tables")
@pytest.mark.parametrize("options", [{}, {"block_words": 3000, "share_words": 5000}])
def test_whole_table(spark, options):
    docs = small(spark, "documents")
    assert mined(docs, **options) == plain(rows(docs.select("lang", "text")))


def test_odd_rows(spark):
    expected = plain([(r[2], r[1]) for r in ODD_ROWS])
    assert mined(odd_documents(spark, extra=True)) == expected and any(row[0] == "und" for row in expected)
    assert mined(no_documents(spark)) == []


def test_longer_phrases_ties_and_odd_signs(spark):
    chance = random.Random(11)
    words = ["a", "B", "b", "c", "é", "x\x1cy", "\x85", "-", "d!", "e.f", "A,"]
    texts = [(chance.choice(["en", "de", None, "und"]), chance.choice([" ", "\t", "  ", " \n"]).join(chance.choice(words) for _ in range(30))) for _ in range(120)]
    texts += [("x", "one two three four five. " * 12), ("x", "a a a a a"), ("y", None), ("y", "..!?"), ("x", "one two " * 3)]
    docs = spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(texts)], "doc_id long, lang string, text string")
    for most in (2, 3, 5):
        for best in (2000, 7):
            options = {"least": 4, "best": best, "most_words": most, "block_words": 200, "share_words": 300}
            assert mined(docs, **options) == plain(texts, 4, most, best)


def test_ranking_in_parts(spark):
    docs = spark.createDataFrame([("en" if i % 3 else "de", i % 7, f"p{i}") for i in range(500)], "lang string, score long, phrase string")
    import pyspark.sql.functions as F

    order = [F.desc("score"), F.asc("phrase")]
    whole, parts = (sorted(rows(co.best_of_each(docs, "lang", order, 20, size))) for size in (10_000, 90))
    assert whole == parts and len(whole) == 40
    tied = co.best_of_each(docs, "lang", [F.desc("score")], 20, 90, ties=True)
    assert tied.count() == docs.filter("score = 6").count()


def test_scores_beyond_64_bits(spark):
    big = 10**14
    key = lambda *words: b"".join(w.to_bytes(4, "big") for w in words)
    rows_in = [("en", key(1), big + 7), ("en", key(2), big + 3), ("en", key(1, 2), big - 11)]
    frame = spark.createDataFrame(rows_in, "lang string, phrase binary, n long")
    found = co.score(frame).first()
    assert found.score == 1000000 * (big - 11) ** 2 // ((big + 7) * (big + 3))


@pytest.mark.skipif(not have_tables, reason="no test tables")
def test_sql(spark):
    import duckdb
    from helpers import SMALL

    from tributary.llm.registry import ORACLES, QUERIES

    frame = QUERIES["op12_phrase_collocations"](spark, SMALL)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    result = connection.execute(ORACLES["op12_phrase_collocations"])
    names = [d[0] for d in result.description]
    assert sorted(result.fetchall()) == sorted(rows(frame.select(*names)))
