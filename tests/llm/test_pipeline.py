"""The pipeline beside a plain version of each stage, each on its own input, with rows planted for every stage."""

import numpy as np
import pytest
from helpers import SCHEMA, have_tables, rows, small
from test_decontaminate import places, plain_tiling
from test_packing import check_places, plain_pieces
from test_secret_scan import plain_base
from test_similar_texts import roots, similarity

import corpus_pipeline
from tributary.llm import decontaminate, quality_classifier, secret_scan

pytestmark = pytest.mark.skipif(not have_tables, reason="no test tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The small tables, with a benchmark passage in shuffled parts, an edited copy, a secret and odd rows planted."""
    folder = f"file://{tmp_path_factory.mktemp('tables')}"
    docs, items = small(spark, "documents").select(COLUMNS), small(spark, "benchmark")
    labels = small(spark, "labels")
    good = [r for r in docs.join(labels, "doc_id").filter("quality = 1 and length(text) between 900 and 4000").orderBy("doc_id").collect()]
    first, second, third = (r.text for r in good[:3])
    longest = max((r.text for r in items.collect() if r.text), key=len)
    half = longest.split()
    half = " ".join(half[len(half) // 2:] + half[:len(half) // 2])
    edited = second.split(" ")
    edited[len(edited) // 2] = "zyxwvut"
    planted = [(9_000_001, f"{first} {half} {third}"), (9_000_002, " ".join(edited)), (9_000_003, f"{third} token = 'Zq8rTy2uPw5xKd3f' end"),
               (9_000_004, None), (9_000_005, ""), (9_000_006, second)]
    extra = spark.createDataFrame([(i, t, "en", "planted", None if t is None else len(t)) for i, t in planted], SCHEMA)
    docs.unionByName(extra).write.parquet(f"{folder}/documents.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder


def plain_leak(text, items):
    words = decontaminate.tokens(text)
    for item in items:
        least = min(5, len(item))
        if item and places(words, item, least):
            if 2 * sum(n for _, _, n in plain_tiling(words, item, least)) >= len(item):
                return True
    return False


def hidden(text):
    """Base secrets and those the method adds, masked."""
    out, at = "", 0
    for start, _, _, end in sorted(secret_scan.find_secrets(text or "")):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + (text or "")[at:]


def test_every_stage_against_a_plain_version(spark, sf_dir, tmp_path):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "simhash_near_duplicates", "benchmark_decontamination", "secret_scan", "best_fit_packing"]
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        path = f"file://{tmp_path}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "best_fit_packing":
            assert docs.columns == COLUMNS
            seen[name] = ({r[0]: r for r in rows(before)}, {r[0]: r for r in rows(docs)})
    # quality: the fitted machine row by row
    came, stayed = seen["quality_classifier"]
    machine = quality_classifier.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    buckets = quality_classifier.WordBuckets()
    score = {i: machine.scores(*quality_classifier.features([r[1]], [r[4]], buckets))[0] for i, r in came.items()}
    assert all((i in stayed) == (s >= 0.5) for i, s in score.items() if abs(s - 0.5) > 1e-3)
    labelled = dict(rows(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")))
    assert np.mean([i in stayed for i in came if labelled.get(i) == 1]) > 0.95
    assert all(stayed[i] == came[i] for i in stayed)
    # near copies: of what is linked from 0.8 one stays at most, and what goes is close to another
    came, stayed = seen["simhash_near_duplicates"]
    root, sets = roots({i: r[1] for i, r in came.items()})
    assert len(stayed) == len({root[i] for i in stayed})
    for i in set(came) - set(stayed):
        assert any(j != i and similarity(sets[i], sets[j]) >= 0.74 for j in came)
    assert all(i in stayed for i in came if not any(j != i and similarity(sets[i], sets[j]) >= 0.74 for j in came))
    assert 9_000_002 not in stayed and 9_000_006 not in stayed
    # leaks: published greedy string tiling
    came, stayed = seen["benchmark_decontamination"]
    items = [decontaminate.tokens(t) for t in {r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}]
    assert {i for i in came if i not in stayed} == {i for i, r in came.items() if plain_leak(r[1], items)}
    if 9_000_001 in came:
        assert 9_000_001 not in stayed
    # secrets: all documents stay, their secrets do not
    came, stayed = seen["secret_scan"]
    assert {i: r[1] for i, r in stayed.items()} == {i: None if r[1] is None else hidden(r[1]) for i, r in came.items()}
    assert not any(plain_base(r[1]) for r in stayed.values() if r[1] and "[SECRET]" not in r[1])
    # packing: every id of every document has one place
    want = [p[:4] for p in plain_pieces([(i, r[1]) for i, r in stayed.items()])]
    assert sorted(rows(docs.select("doc_id", "piece", "start", "length")), key=str) == want
    count = check_places(docs)
    assert count <= 1.05 * -(-sum(p[3] for p in want) // 2048) + 1


def test_run_gives_the_last_stage_and_takes_empty_tables(spark, sf_dir, tmp_path):
    assert check_places(corpus_pipeline.run(spark, sf_dir)) > 0
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_workers_give_back_freed_memory(monkeypatch):
    """The Arrow pool is emptied after each batch, of rows and of blocks alike, as a worker stays when its task ends."""
    import pyarrow as pa

    from tributary.llm import common, simhash

    class Pool:
        released = 0

        def release_unused(self):
            Pool.released += 1

    batches = [pa.RecordBatch.from_pydict({"key": [i, i], "block": [0, 0], "part": [0, 0], "print": [i, i + 1]}) for i in (0, 4)]
    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    assert [b.num_rows for b in common.slices(iter(batches), rows=1)] == [1] * 4 and Pool.released == 2
    assert len(list(simhash.block_links(iter(batches), simhash._compare_rows, pa.int64()))) == 2 and Pool.released == 4
