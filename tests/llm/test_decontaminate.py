import itertools
import random

import pytest
from helpers import ODD_ROWS, have_tables, no_documents, odd_documents, rows, small

from tributary.llm import decontaminate as d

ITEMS = [
    (1, "the quick brown fox jumps over the lazy dog near the old river bank"), (2, "short item text"), (3, None), (4, ""),
    (5, "THE quick brown fox jumps over the lazy dog near the old river bank!"), (None, "an item without any id but with many words"),
]


def plain_tiling(doc, item, least):
    """Greedy string tiling as published: find the longest unmarked matches, mark them, go on."""
    doc_used, item_used, tiles = set(), set(), []
    while True:
        longest, matches = least, []
        for a, b in itertools.product(range(len(doc)), range(len(item))):
            n = 0
            while (a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n]
                   and a + n not in doc_used and b + n not in item_used):
                n += 1
            if n > longest:
                longest, matches = n, []
            if n == longest:
                matches.append((a, b))
        if not matches:
            return sorted(tiles)
        for a, b in matches:
            if not any(a + i in doc_used or b + i in item_used for i in range(longest)):
                tiles.append((a, b, longest))
                doc_used |= set(range(a, a + longest))
                item_used |= set(range(b, b + longest))


def places(doc, item, least):
    return [(a, b) for a in range(len(doc) - least + 1) for b in range(len(item) - least + 1) if doc[a:a + least] == item[b:b + least]]


def test_tiles_are_those_of_the_published_algorithm():
    chance = random.Random(2)
    for _ in range(150):
        doc, item = ([chance.choice("abc") for _ in range(chance.randint(0, 40))] for _ in range(2))
        found = places(doc, item, 3)
        assert (d.tile(found, 3) if found else []) == plain_tiling(doc, item, 3)


def check(spark, docs, items):
    want = []
    unique = {}
    for item_id, text in items:
        if d.tokens(text):
            key = tuple(d.tokens(text))
            old = unique.get(key)
            unique[key] = item_id if old is None else old if item_id is None else min(old, item_id)
    for doc_id, text in rows(docs.select("doc_id", "text")):
        words = d.tokens(text)
        for item, item_id in unique.items():
            least = min(d.LEAST_TILE, len(item))
            if {tuple(words[i:i + least]) for i in range(len(words))} & {item[i:i + least] for i in range(len(item) - least + 1)}:
                tiles = plain_tiling(words, list(item), least) if len(words) < 400 else d.tile(places(words, list(item), least), least)
                lengths = [n for *_, n in tiles]
                want.append((doc_id, item_id, len(item), sum(lengths), len(lengths), max(lengths)))
    frame = spark.createDataFrame(items, "item_id long, text string")
    for held in (d.HELD_WORDS, 0):  # seeds held by every task, seeds joined
        got = [row[:6] for row in rows(d.leaks(docs, frame, held_words=held))]
        assert sorted(got, key=str) == sorted(want, key=str)
    return want


def test_made_up_texts(spark):
    docs = spark.createDataFrame([
        (1, "x y z The quick brown fox jumps over the lazy dog near the old river bank. and more"),
        (2, "near the old river bank and then the quick brown fox jumps over the lazy dog"),
        (3, "short item text here"), (3, "short item text here"), (4, "the quick brown fox only"), (5, None), (6, "quick brown fox jumps over it"),
        (None, "an item without any id but with many words"),
    ], "doc_id long, text string")
    assert len(check(spark, docs, ITEMS)) == 6
    kept = d.keep_clean(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [4, 5, 6]
    check(spark, odd_documents(spark, extra=True), ITEMS)
    assert check(spark, no_documents(spark), ITEMS) == [] and check(spark, docs, []) == []
    assert d.keep_clean(odd_documents(spark), spark.createDataFrame([], "item_id long, text string")).count() == len(ODD_ROWS)


def test_clean_rows_are_the_same_on_both_paths(spark):
    leaked = "x y z The quick brown fox jumps over the lazy dog near the old river bank. and more"
    docs = spark.createDataFrame([
        (None, leaked, "a"), (1, leaked, "b"), (1, "a clean text that repeats the id", "c"), (2, leaked, None), (2, leaked, "d"), (3, "another clean text", "e"),
        (3, "another clean text", "e"), (None, "a clean text without id", "f"), (None, None, "g"), (4, None, "h"), (5, "", "i"), (6, "short item text here", "j"),
    ], "doc_id long, text string, own string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = [r for r in rows(docs) if r[2] in ("c", "e", "f", "g", "h", "i")]
    for held in (d.HELD_WORDS, 0):
        kept = d.keep_clean(docs, items, held_words=held)
        assert kept.columns == docs.columns
        assert sorted(rows(kept), key=str) == sorted(want, key=str)
        odd = odd_documents(spark, extra=True)
        assert sorted(rows(d.keep_clean(odd, items, held_words=held)), key=str) == sorted(rows(odd), key=str)
        assert d.keep_clean(no_documents(spark), items, held_words=held).count() == 0


@pytest.mark.skipif(not have_tables, reason="no test tables")
def test_test_tables(spark):
    assert check(spark, small(spark, "documents"), rows(small(spark, "benchmark").select("item_id", "text")))


def test_tiles_of_repeated_seeds_are_those_of_the_published_algorithm():
    chance = random.Random(12)
    for _ in range(200):
        letters = chance.choice(["a", "ab", "aab", "abc"])
        doc, item = ([chance.choice(letters) for _ in range(chance.randint(3, 40))] for _ in range(2))
        ids = [d.np.array([1 + "abc".index(w) for w in side], d.np.uint64) for side in (doc, item)]
        assert d.tile_repeated(*ids, 3) == plain_tiling(doc, item, 3)
        starts = d.np.array(sorted({a for a, _ in places(doc, item, 3)}), int)
        if len(starts):
            part = d.tile_repeated(d.covered_part(ids[0], starts, 3), ids[1], 3)
            assert [t[1:] for t in part] == [t[1:] for t in plain_tiling(doc, item, 3)]


@pytest.mark.parametrize("held", [d.HELD_WORDS, 0])
def test_repeated_words_on_both_paths(spark, held):
    items = [(1, "word " * 300), (2, "one two three four five " * 4), (3, "plain words that stand here only once and again")]
    docs = [(1, "word " * 20_000), (2, "word " * 40 + "other " + "word " * 120 + "end"), (3, "two three four five one two three four five one two"), (3, "two three four five one two three four five one two"),
            (4, "nothing"), (None, "plain words that stand here only twice"), (6, None)]
    found = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), held_words=held)
    got = sorted(rows(found.select("doc_id", "item_id", "covered_words", "tiles", "longest_tile")), key=str)
    want = []
    for doc_id, text in docs:
        for item_id, phrase in items:
            if doc_id == 1:
                tiles = [(0, 0, 300)] if item_id == 1 else []
            else:
                tiles = plain_tiling(d.tokens(text), d.tokens(phrase), 5)
            if tiles:
                want.append((doc_id, item_id, sum(t[2] for t in tiles), len(tiles), max(t[2] for t in tiles)))
    assert got == sorted(want, key=str)


def test_many_equal_words_take_little_time_and_memory():
    import time
    import tracemalloc

    benchmark = d.Benchmark([(1, " ".join(["word"] * 300))])
    text = "word " * 20_000
    benchmark.matches(text)
    tracemalloc.start()
    started = time.time()
    assert benchmark.matches(text) == [(1, 300, 300, 1, 300)]
    assert time.time() - started < 5 and tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()
