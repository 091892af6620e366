import math
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from helpers import ODD_ROWS, have_tables, no_documents, odd_documents, rows, small

from tributary.llm import bloom
from tributary.llm import language_model as lm


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def plain_base(texts):
    train = Counter(t for i, text in texts if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for t in tokens(text))
    total, types = sum(train.values()), len(train)
    out = []
    for i, text in texts:
        score = sum(math.log10((train[t] + 0.5) / (total + 0.5 * (types + 1))) for t in tokens(text))
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(tokens(text)), sum(train[t] > 0 for t in tokens(text)), total, score))
    return out


def check(spark, docs):
    model, counts = lm.train(docs.filter(lm.fold_of(lm.F.col("doc_id"), 5) != 1))
    got = sorted(rows(lm.score(docs, model, counts)), key=str)
    want = sorted(plain_base(rows(docs.select("doc_id", "text"))), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert all(r[6] < 0 for r in got)
    return got


@pytest.mark.skipif(not have_tables, reason="no test tables")
@pytest.mark.parametrize("held", [1 << 20, 20])
def test_whole_table(spark, monkeypatch, held):
    monkeypatch.setattr(lm, "HELD_WORDS", held)
    got = check(spark, small(spark, "documents"))
    assert sum(r[6] for r in got if r[1]) > sum(r[5] for r in got if r[1])  # better than the base on held-out texts


def test_odd_rows(spark):
    check(spark, odd_documents(spark, extra=True))
    model, counts = lm.train(no_documents(spark))
    assert lm.score(no_documents(spark), model, counts).count() == 0
    assert len(rows(lm.score(odd_documents(spark), model, counts))) == len(ODD_ROWS)


def test_scores_follow_the_exact_counts(spark, monkeypatch):
    """With a fine filter the score equals the formula on exact counts by level."""
    texts = [(i, " ".join(random.Random(i).choices("a b c d e f g".split(), k=30))) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model, counts = lm.train(docs)
    single, pair = Counter(), Counter()
    for _, text in texts:
        found = tokens(text)
        single.update(found)
        pair.update(zip([b"", *found[:-1]], found))
    total = sum(single.values())
    level = lambda n: 1 + int(math.floor(math.log2(n * lm.RESOLUTION / total)))
    mean = lambda counted: {q: np.mean([n for n in counted.values() if level(n) == q]) for q in {level(n) for n in counted.values()}}
    singles, pairs = mean(single), mean(pair)
    for doc_id, _, _, _, _, _, score in rows(lm.score(docs, model, counts)):
        found = tokens(dict(texts)[doc_id])
        want = sum(math.log10(0.1 * min(1, pairs[level(pair[v, w])] / singles[level(single[v])]) + 0.9 * singles[level(single[w])] / (total + 1))
                   for v, w in zip([b"", *found[:-1]], found))
        assert math.isclose(score, want, rel_tol=0.02)


def test_rare_pairs_of_a_corpus_beyond_the_resolution_count(spark, monkeypatch):
    """More training tokens than RESOLUTION, and a filter of several shards: pairs that occur once are still evidence."""
    chance = random.Random(9)
    texts = [(i, " ".join(f"w{chance.randrange(3000)}" for _ in range(100))) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(lm, "RESOLUTION", 1 << 10)
    monkeypatch.setattr(bloom, "BLOCK_BITS", 1 << 19)
    monkeypatch.setattr(bloom, "SHARD_BYTES", 1 << 16)
    model, counts = lm.train(docs)
    assert model.total > 16 * lm.RESOLUTION
    single, pair = Counter(), Counter()
    for _, text in texts:
        found = tokens(text)
        single.update(found)
        pair.update(zip([b"", *found[:-1]], found))
    singles = np.array([lm.xxhash.xxh64_intdigest(w) for w in single], np.uint64)
    before, after = (np.array([lm.xxhash.xxh64_intdigest(p[n]) for p in pair], np.uint64) for n in (0, 1))
    assert (model.levels.levels(singles) > 0).all() and (model.levels.levels(lm.pair_codes(before, after)) > 0).all()
    kept = model.levels.levels(singles)
    whole = {r.doc_id: r.score for r in lm.score(docs, model, counts).collect()}
    monkeypatch.setattr(bloom, "BITS_PER_KEY", 120)  # ten blocks or so, a shard each
    model, counts = lm.train(docs)
    assert len(model.levels.shards) > 3 and np.mean(model.levels.levels(singles) == kept) > 0.97
    sharded = {r.doc_id: r.score for r in lm.score(docs, model, counts).collect()}
    assert all(math.isclose(whole[i], sharded[i], rel_tol=0.02) for i in whole)


def test_filter_levels(spark):
    chance = np.random.default_rng(4)
    codes = chance.integers(0, 2**63, 60_000).astype(np.int64)
    levels = chance.integers(1, 9, 60_000).astype(np.int32)
    frame = spark.createDataFrame(list(zip(codes.tolist(), levels.tolist())), "code long, level int").repartition(3)
    found = bloom.build(frame, int(levels.sum()))
    got = found.levels(codes.view(np.uint64))
    assert (got >= levels).all() and (got > levels).mean() < 0.02
    others = found.levels(chance.integers(0, 2**63, 60_000).astype(np.uint64))
    assert (others > 0).mean() < 0.02
    assert bloom.build(frame.limit(0), 0).levels(codes.view(np.uint64)).sum() == 0


@pytest.mark.parametrize("shared_by", [None, 7])
def test_a_filter_that_tasks_may_not_hold_gives_the_same_scores(spark, monkeypatch, shared_by):
    docs = odd_documents(spark, extra=True)
    model, counts = lm.train(docs)
    assert model.levels.held
    want = sorted(rows(lm.score(docs, model, counts)), key=str)
    if shared_by:
        monkeypatch.setattr(lm, "SCORED", shared_by)
    monkeypatch.setattr(bloom, "HELD_BYTES", 0)
    model, counts = lm.train(docs)
    assert not model.levels.held and not model.levels.shards
    assert sorted(rows(lm.score(docs, model, counts)), key=str) == want
    assert lm.score(no_documents(spark), model, counts).count() == 0


def test_counts_from_255_on_travel_too():
    codes, counts = np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.array([1, 254, 255, 256, 1 << 40, 3, 255, 1])
    batch = lm._cells(codes, counts, 2, 3)
    got = {}
    for data, small_, larger in zip(*(batch.column(c).to_pylist() for c in ("codes", "counts", "larger"))):
        got |= dict(zip(np.frombuffer(data, np.uint64).tolist(), lm._counts(small_, larger).tolist()))
    assert got == dict(zip(codes.tolist(), counts.tolist()))


def test_tasks_map_the_filter(spark):
    """A process that probes the filter maps its files and holds no copy of them."""
    docs = spark.createDataFrame([(i, f"one two three w{i}") for i in range(50)], "doc_id long, text string")
    model, _ = lm.train(docs)
    levels = model.levels.for_tasks()

    def kinds(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"kind": [type(s.value).__name__ for s in levels.shards], "size": [s.value.size for s in levels.shards]})

    found = spark.range(0, 2, 1, 2).mapInArrow(kinds, "kind string, size long").collect()
    assert {r.kind for r in found} == {"memmap"} and sum(r.size for r in found) == 2 * model.levels.blocks.sum() * bloom.BLOCK_BITS // 8
    assert len(pickle.dumps(levels)) < 20_000


def test_large_rows_are_written_few_at_a_time(spark):
    """Blocks of texts are rows of many MB: a hundred of them must not wait in the writer."""
    rows = spark.range(0, 30, 1, 1).select("id", *[F.repeat(F.sha2(F.concat_ws("-", "id", F.lit(str(n))), 512), 4096).cast("binary").alias(f"c{n}") for n in range(4)])
    for path in lm.written(rows, "large", **{**lm.LARGE_ROWS, "parquet.block.size": 4 << 20}).inputFiles():
        groups = pq.ParquetFile(path.removeprefix("file://")).metadata
        assert groups.num_row_groups > 3 and max(groups.row_group(i).total_byte_size for i in range(groups.num_row_groups)) < 8 << 20
