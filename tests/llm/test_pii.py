import hashlib
import random
import re

import pytest
from helpers import ODD_ROWS, have_tables, no_documents, odd_documents, rows, small

from tributary.llm import pii


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_base(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    return sorted(found)


def want(doc_id, text):
    base = plain_base(text)
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base)
    return (doc_id, *(sum(k == kind for _, _, k, _ in base) for kind in pii.BASE), hashlib.sha256(joined.encode()).hexdigest())


TRICKY = [
    "a@b.c_d@e.f x@y a@b..c 😀me@mail.example.com😀 a@b.c@d.e", "1.2.3.4.5 999.1.1.1 001.002.003.255 1.2.3.256 0000000255.1.1.1 12345678901234567890.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 411111111111111 1111 4111111111111111-", "5500 0000 0000 0004 1 378282246310005 5500000000000004-5 12--34",
    "+1 (743) 555-3824 +49 30 1234567. +1 +12 (((5 +1234567890123456 ++33 1 23 45 67 89)", "+1-2-3 (4) 5.6 7 8 9 0 1 2 3 4 5 6 7 8 9 tel 555-123-4567",
    "mail " + "x" * 100_000 + " a@b.cc", "1 " * 30_000 + "@", "9" * 50_000, "é@b.cc ١٢٣.1.1.1 +1 ٣456789012", "1.1.1.1 " * 500, "a.b+c%d-e_f@x-y.z-1.q",
]


def random_texts(count):
    chance = random.Random(11)
    return ["".join(chance.choice(["1", "2", "4", "0", "55", ".", " ", "-", "+", "@", "a", "b.c", "(", ")", "é", "1.2.3.4", "4111 1111 1111 1111"]) for _ in range(chance.randint(0, 60))) for _ in range(count)]


def test_base_spans_of_tricky_and_random_texts(spark):
    texts = list(enumerate(TRICKY + random_texts(600), 100))
    docs = odd_documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    got = pii.digest(pii.find(docs))
    assert sorted(rows(got.drop("spans")), key=str) == sorted((want(i, t) for i, t in [r[:2] for r in ODD_ROWS] + texts), key=str)
    assert pii.find(odd_documents(spark, extra=True)).count() == len(ODD_ROWS) and pii.find(no_documents(spark)).count() == 0


@pytest.mark.skipif(not have_tables, reason="no test tables")
def test_whole_table(spark):
    docs = small(spark, "documents").select("doc_id", "text")
    out = pii.digest(pii.find(docs)).cache()
    assert sorted(rows(out.drop("spans"))) == sorted(want(i, t) for i, t in rows(docs))
    assert all(set(f"{k}:{a}:{b}" for a, _, k, b in plain_base(t)) <= set(out.filter(out.doc_id == i).first().spans.split(",")) for i, t in rows(docs) if plain_base(t))


def test_reliabilities_are_recovered(spark):
    chance = random.Random(3)
    true = [(0.95, 0.1), (0.6, 0.4), (0.9, 0.2), (0.8, 0.3), (0.7, 0.1)]
    cast = []
    for _ in range(6000):
        y = chance.random() < 0.4
        cast.append(([-1 if chance.random() < 0.1 else int(chance.random() < (a if y else b)) for a, b in true],))
    patterns = spark.createDataFrame(cast, "cast array<int>").groupBy("cast").count().withColumnRenamed("count", "n")
    share, chances = pii.reliabilities(patterns, rounds=40)
    assert abs(share - 0.4) < 0.06 and all(abs(a - c) < 0.1 and abs(b - d) < 0.1 for (a, b), (c, d) in zip(true, chances))


def test_spans_are_added_beside_base_spans(spark):
    good = [(i, f"call tel 415-555-{1000 + i} or mail person{i}@gmail.com today, ssn 123-45-{6789 - i} ok") for i in range(30)]
    bad = [(100 + i, f"version 000-00-{1000 + i}/x build 1.0.0.{i % 9}") for i in range(30)]
    out = {r.doc_id: r.spans for r in pii.digest(pii.find(spark.createDataFrame(good + bad, "doc_id long, text string"))).collect()}
    assert all("local_phone:9:21" in out[i] and "ssn:" in out[i] and "email" in out[i] for i in range(30))
    assert not any("ssn" in out[100 + i] for i in range(30))
