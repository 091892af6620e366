import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import have_tables, no_documents, odd_documents, rows, small

from tributary.llm import simhash
from tributary.llm.components import components


def plain_fingerprint(text, size=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < size else [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)]
    ones = Counter()
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        ones.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_components(marked):
    """(id, fingerprint) rows to (id, fingerprint, least id of the component)."""
    prints = sorted({p for _, p in marked})
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 3:
                parent[root(p)] = root(q)
    least = {}
    for doc_id, p in marked:
        if doc_id is not None:
            least[root(p)] = min(doc_id, least.get(root(p), doc_id))
    return sorted(((i, p, least.get(root(p))) for i, p in marked), key=str)


def found(docs):
    return sorted(((i, p & (2**64 - 1), c) for i, p, c in rows(simhash.near_duplicates(docs))), key=str)


@pytest.mark.skipif(not have_tables, reason="no test tables")
def test_all_documents_against_brute_force(spark):
    docs = small(spark, "documents")
    marked = [(i, plain_fingerprint(t)) for i, t in rows(docs.select("doc_id", "text"))]
    assert found(docs) == plain_components(marked)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    marked = [(i, plain_fingerprint(t)) for i, t in rows(docs.select("doc_id", "text"))]
    assert found(docs) == plain_components(marked) == found(odd_documents(spark, extra=True))
    assert found(no_documents(spark)) == []


def test_links_in_dense_groups_cut_into_blocks(spark, monkeypatch):
    chance = random.Random(5)
    prints = {chance.getrandbits(64) for _ in range(300)}
    for base in list(prints)[:6]:  # chains and balls around a base
        at = base
        for _ in range(60):
            for b in chance.sample(range(64), chance.choice([1, 2, 3, 3, 4])):
                at ^= 1 << b
            prints.add(at)
            prints.add(base ^ sum(1 << b for b in chance.sample(range(12), 2)))
    prints = sorted(prints)
    want = {(i, c) for i, _, c in plain_components(list(enumerate(prints)))}
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "print long").repartition(3)
    for block in (2048, 7):
        monkeypatch.setattr(simhash, "BLOCK", block)
        edges = [(a & (2**64 - 1), b & (2**64 - 1)) for a, b in rows(simhash.links(frame))]
        number = {p: i for i, p in enumerate(prints)}
        least = list(range(len(prints)))

        def root(i):
            while least[i] != i:
                i = least[i]
            return i

        for a, b in edges:
            x, y = sorted((root(number[a]), root(number[b])))
            least[y] = x
        assert {(i, root(i)) for i in range(len(prints))} == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (200, 201), (201, 200)]
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    out = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    assert {k: v for k, v in out.items() if k != v} == {k: v for k, v in want.items() if k != v}


def test_keep_one(spark):
    same = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([
        (5, same, "en", "a", 1), (3, same, "en", "a", 2), (3, same, "en", "a", 2), (3, "another text that stands alone", "en", "a", 3),
        (None, same, "en", "a", 4), (9, "words of its own altogether here", None, None, None), (11, None, None, None, None),
        (2, "another text that stands alone", "en", "a", 3),
    ], "doc_id long, text string, lang string, source string, n_chars long")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((i, t) for i, t, *_ in rows(kept)), key=str) == sorted([
        (3, same), (2, "another text that stands alone"), (None, same), (9, "words of its own altogether here"), (11, None)], key=str)
