import zlib

import numpy as np
from helpers import ODD_ROWS, no_documents, odd_documents, rows

from tributary.llm import quality_classifier as q


def test_linear_time_identity():
    chance = np.random.default_rng(1)
    size = q.BUCKETS + q.STATISTICS
    machine = q.Machine(0.3, chance.normal(size=size), chance.normal(size=(size, q.FACTORS)), np.zeros(q.STATISTICS), np.ones(q.STATISTICS))
    x = np.zeros((2, size))
    x[0, [3, 9, 700]] = [1.0, -2.0, 0.5]
    x[1, [1, q.BUCKETS + 2]] = [2.0, 3.0]
    for row, logit in zip(x, machine.logits(x)):
        on = np.flatnonzero(row)
        pairs = sum(row[i] * row[j] * machine.factors[i] @ machine.factors[j] for n, i in enumerate(on) for j in on[:n])
        assert np.isclose(logit, 0.3 + row @ machine.weights + pairs)


def test_held_out_accuracy_and_odd_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    machine = q.fit(docs, labels)
    scored = q.score(docs, machine).join(labels, "doc_id").filter(q.fold_of(q.F.col("doc_id"), 3) == 1).collect()
    right = [(r.score >= 0.5) == (r.quality == 1) for r in scored]
    assert len(right) > 80 and np.mean(right) > 0.93
    odd = rows(q.score(odd_documents(spark, extra=True), machine))
    assert len(odd) == len(ODD_ROWS) and all(0 <= s <= 1 for _, s in odd)
    assert q.keep_good(odd_documents(spark), machine, least=0.0).count() == len(ODD_ROWS)
    assert q.score(no_documents(spark), machine).count() == 0
    none = q.fit(docs, labels.limit(0))
    assert none is None and {s for _, s in rows(q.score(odd_documents(spark), none))} == {0.5}


def test_held_out_labels_are_not_learned(spark):
    docs = spark.createDataFrame([(i, f"text number {i} with words") for i in range(60)], "doc_id long, text string").selectExpr("*", "24L AS n_chars")
    labels = [(i, i % 2) for i in range(60)]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a, b = (rows(q.score(docs, q.fit(docs, spark.createDataFrame(x, "doc_id long, quality int")))) for x in (labels, flipped))
    assert sorted(a) == sorted(b)
