import math
import random

import numpy as np
import pytest
from helpers import ODD_ROWS, SCHEMA, have_tables, no_documents, odd_documents, rows, small

from tributary.llm import similar_texts


def shingles(text, size=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def roots(texts):
    """component_id of each id by comparing all pairs of shingle sets at 0.8."""
    sets = {i: shingles(t) for i, t in texts.items()}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and similarity(sets[i], sets[j]) >= 0.8:
                x, y = sorted((root(i), root(j)))
                least[y] = x
    return {i: root(i) for i in sets}, sets


@pytest.mark.skipif(not have_tables, reason="no test tables")
def test_near_copies_against_brute_force(spark):
    docs = small(spark, "documents")
    want, sets = roots(dict(rows(docs.select("doc_id", "text"))))
    got = {i: c for i, _, c in rows(similar_texts.similar_texts(docs))}
    assert set(got) == set(want)
    members = {}
    for i, c in want.items():
        members.setdefault(c, []).append(i)
    for group in members.values():  # no link from 0.8 is lost
        assert len({got[i] for i in group}) == 1
    for i, c in got.items():  # and what joins groups is close to 0.8
        if c != i:
            assert max(similarity(sets[i], sets[j]) for j in got if j != i and got[j] == c) >= 0.74


def test_edited_copies_and_reach_of_blocks(spark, monkeypatch):
    chance = random.Random(3)
    word = lambda: "".join(chance.choices("abcdefgh", k=6))
    made, number = [], 0
    for group in range(12):
        base = [word() for _ in range(chance.choice([80, 300, 2500]))]
        for copy in range(15):
            text = list(base)
            for at in chance.sample(range(len(base)), len(base) // 100 if copy else 0):  # one word in a hundred: about 0.9
                text[at] = word()
            made.append((number, " ".join(text).upper() if copy % 3 else " ".join(text), "en", "a", group))
            number += 1
    docs = spark.createDataFrame(made, SCHEMA)
    want, _ = roots({i: t for i, t, *_ in made})
    from tributary.llm import simhash
    for block in (2048, 4):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert {i: c for i, _, c in rows(similar_texts.similar_texts(docs))} == want
    assert sorted(i for i, *_ in rows(similar_texts.keep_one(docs))) == sorted(set(want.values()))


def test_odd_rows(spark):
    for extra in (False, True):
        docs = odd_documents(spark, extra)
        got = rows(similar_texts.similar_texts(docs).select("doc_id", "component_id"))
        assert len(got) == len(ODD_ROWS)
        assert sorted(got, key=str) == sorted(
            [(1, 1), (2, 1), (3, 1), (None, 1), (4, 4), (4, 4), (5, 4), (None, None), (7, 7), (8, 8), (9, 9)], key=str)
        kept = similar_texts.keep_one(docs)
        assert kept.columns == docs.columns
        assert sorted((r[0] for r in rows(kept)), key=str) == sorted([1, 4, 7, 8, 9, None, None], key=str)
    assert rows(similar_texts.similar_texts(no_documents(spark))) == [] == rows(similar_texts.keep_one(no_documents(spark)))


def made_up(chance, lengths):
    """Texts of each length and, of each, versions with words appended, cut off or replaced, and one that only begins alike."""
    word = lambda: "".join(chance.choices("abcdefgh", k=6))
    texts = []
    for length in lengths:
        base = [word() for _ in range(length)]
        texts += [base, base + [word()], base + [word(), word()], base[:5] + [word() for _ in range(length - 5)], base[1:], base[2:-1]]
        for at in (0, 1, length // 2, length - 1):
            texts.append(base[:at] + [word()] + base[at + 1:])
        texts.append(base[:5] + [word()])
    return {i: " ".join(t) for i, t in enumerate(texts)}


def test_short_texts_that_share_a_passage_stay(spark):
    """Similarity 0.33 to 0.5: a text and one word more, and many texts with one beginning of five words."""
    start = "one two three four five"
    texts = {i: f"{start} x{i}" for i in range(40)} | {100 + i: f"a{i} b c d e" for i in range(40)} | {200 + i: f"a{i} b c d e f" for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {i: c for i, _, c in rows(similar_texts.similar_texts(docs))} == {i: i for i in texts}
    assert similar_texts.keep_one(docs).count() == len(texts)


def test_the_limit_on_both_sides_from_6_to_130_words(spark, monkeypatch):
    texts = made_up(random.Random(7), [*range(6, 61), *range(61, 131, 3)])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want, sets = roots(texts)
    assert any(similarity(sets[i], sets[i + 1]) == 0.8 for i in range(len(texts) - 1))
    from tributary.llm import simhash
    for block, compared in ((2048, 1 << 21), (4, 100)):
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(similar_texts, "COMPARED", compared)
        assert {i: c for i, _, c in rows(similar_texts.similar_texts(docs))} == want


def test_fingerprints_of_links_are_within_the_radius():
    """Sets of 51 to 400 shingles at 0.8, in all splits of the differing shingles: none is beyond RADIUS, none lacks a common key."""
    chance = np.random.default_rng(5)
    for size in range(51, 401, 7):
        common = math.ceil(0.8 * size)
        for own in range(0, size - common + 1, max(1, (size - common) // 3)):
            hashes = chance.integers(0, 2**63, size).astype(np.uint64)
            a, b = np.sort(hashes[:common + own]), np.sort(np.r_[hashes[:common], hashes[common + own:]])
            if min(len(a), len(b)) <= similar_texts.FEW:
                continue
            (left, left_keys), (right, right_keys) = similar_texts.sketch(a), similar_texts.sketch(b)
            assert (int.from_bytes(left) ^ int.from_bytes(right)).bit_count() <= similar_texts.RADIUS
            assert set(left_keys) & set(right_keys)
