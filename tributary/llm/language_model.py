"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased and one end token for each text.  Counts of all
tokens and all token pairs of the training texts are summed by shuffles and quantised to powers of two: level 1 starts at a
count of one, so every counted word and pair is stored.  (``RESOLUTION`` only sets where, between two powers of two, the levels
part: at shares of 2^q / RESOLUTION of the training tokens.)  Counts travel as arrays, dealt to shares by their code; the
group that sums a share fills the share's part of the filter, which grows with what was counted.  Up to a stated size tasks
map it, beyond it texts deal their codes to the shares (see :mod:`bloom`); both give the same scores.

Every token and pair of a text is probed.  The count behind a level is the mean count of that level, taken over the whole
corpus; a word that was never counted passes for one that occurs once.  A token's probability mixes pair and single:
``PAIR_WEIGHT * count(v w) / count(v) + (1 - PAIR_WEIGHT) * count(w) / (N + 1)``.

Beside it stands the plain smoothed unigram score (``base_score``) from exact counts: frequent words (a share of at least
1 / HELD_WORDS, so at most that many) are held by every task; each text's other words meet their counts by a join.

A null or empty text is its end token alone.  A null id is a training text.  Repeated rows are scored, and
counted, each.  Extra columns are ignored.  An empty table gives no rows, and a model of no text scores all the same; texts of any length
are read whole.  Words of equal count share a level.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import bloom
from tributary.llm.common import fold_of, slices, words_of
from tributary.llm.registry import query, table
from tributary.session import scratch_path

RESOLUTION = 1 << 22
HELD_WORDS = 1 << 20
#: A longer word is never held by tasks, so HELD_WORDS bounds bytes too.
HELD_BYTES = 64
PAIR_WEIGHT = 0.1
FOLDS, HELD_OUT = 5, 1
#: The end token; no word is empty.
END = b""
#: Tokens whose pairs a task gathers before it sends their counts, or scores at a time.
GATHERED = 1_500_000
SCORED = 500_000
#: Tokens of the corpus for each share of pairs that is summed on its own.
SHARE = 2_000_000
CACHED_WORDS = 200_000
#: Levels that statistics have room for: counts of 64 bits have no more.
MOST_LEVELS = 72
#: A row of many MB: the writer looks at what it gathers after each one, and the reader gets few at a time.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1}
_PAIR = np.uint64(0xA0761D6478BD642F)


def written(frame: DataFrame, name: str, **options) -> DataFrame:
    path = scratch_path(frame.sparkSession, name)
    frame.write.options(**options).parquet(path)
    return frame.sparkSession.read.parquet(path)


class WordCodes(dict):
    """64-bit code of each word; the cache is emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


def pair_codes(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return bloom.mixed(before * _PAIR + after)


def text_codes(found: list[bytes], words: WordCodes) -> np.ndarray:
    """Codes of a text's tokens, the end token last."""
    out = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    return np.append(out, np.uint64(words[END]))


def before_each(after: np.ndarray, sizes: np.ndarray, end) -> np.ndarray:
    """What stands before each token of joined texts; the end token stands before the first."""
    before = np.roll(after, 1)
    before[np.r_[0, np.cumsum(sizes)[:-1]]] = end
    return before


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` (bytes; the end token is empty) and its count ``n`` in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def sent() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return batch

        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                found.update(words_of(text, lower=True))
                found[END] += 1
                if len(found) > CACHED_WORDS:
                    yield sent()
        yield sent()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


_CELLS = "share int, length int, codes binary, counts binary, larger binary"


def _cells(codes: np.ndarray, counts: np.ndarray, length: int, shares: int) -> pa.RecordBatch:
    """Codes and counts by share; a count is a byte, those from 255 on follow in ``larger``."""
    order, cuts = bloom.cut_by_share(codes, shares)
    codes, counts = codes[order], counts[order].astype(np.uint64)
    small = np.minimum(counts, 255).astype(np.uint8)
    return pa.RecordBatch.from_arrays([
        pa.array([share for share, _, _ in cuts], pa.int32()), pa.array([length] * len(cuts), pa.int32()), pa.array([codes[s:e].tobytes() for _, s, e in cuts], pa.binary()),
        pa.array([small[s:e].tobytes() for _, s, e in cuts], pa.binary()), pa.array([counts[s:e][counts[s:e] >= 255].tobytes() for _, s, e in cuts], pa.binary())],
        names=["share", "length", "codes", "counts", "larger"])


def _counts(small: bytes, larger: bytes) -> np.ndarray:
    counts = np.frombuffer(small, np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(larger, np.uint64)
    return counts


def word_cells(words: DataFrame, shares: int) -> DataFrame:
    """Codes and counts of counted words, dealt to shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([xxhash.xxh64_intdigest(word) for word in batch.column("word").to_pylist()], np.uint64)
            yield _cells(codes, batch.column("n").to_numpy(), 1, shares)

    return words.select("word", "n").mapInArrow(run, _CELLS)


def pair_cells(docs: DataFrame, shares: int) -> DataFrame:
    """Codes and counts of all pairs of tokens, summed for some texts at a time and dealt to shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, waiting, size = WordCodes(), [], 0

        def sent() -> pa.RecordBatch:
            after = np.concatenate(waiting)
            before = before_each(after, np.array(list(map(len, waiting))), words[END])
            return _cells(*np.unique(pair_codes(before, after), return_counts=True), 2, shares)

        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                waiting.append(text_codes(words_of(text, lower=True), words))
                size += len(waiting[-1])
                if size >= GATHERED:
                    yield sent()
                    waiting, size = [], 0
        if waiting:
            yield sent()

    return docs.select("text").mapInArrow(run, _CELLS)


def fill_shares(cells: DataFrame, total: int) -> DataFrame:
    """Blocks of the filter (share, block, bits); a row with a null block holds the share's statistics by length and level.

    The group that sums a share's counts quantises them and fills the share's blocks, so no counted pair is written.
    """
    resolution, bits_per_key = RESOLUTION, bloom.BITS_PER_KEY

    def fill(key: tuple, group: pa.Table) -> pa.Table:
        stats = np.zeros((2, MOST_LEVELS, 2), np.int64)  # by length and level: the sum of counts, and n-grams
        codes_by_length, levels_by_length = [], []
        for length in (1, 2):
            rows = group.filter(pc.equal(group.column("length"), length))
            if not len(rows):
                continue
            codes = np.concatenate([np.frombuffer(x, np.uint64) for x in rows.column("codes").to_pylist()])
            counts = np.concatenate([_counts(*x) for x in zip(rows.column("counts").to_pylist(), rows.column("larger").to_pylist())])
            order = np.argsort(codes)
            codes = codes[order]
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            n = np.add.reduceat(counts[order], starts)
            levels = levels_of(n, total, resolution)
            stats[length - 1, :, 0] = np.bincount(levels, n.astype(np.float64), MOST_LEVELS).astype(np.int64)
            stats[length - 1, :, 1] = np.bincount(levels, minlength=MOST_LEVELS)
            codes_by_length.append(codes[starts])
            levels_by_length.append(levels)
        blocks = bloom.block_rows(key[0].as_py(), bloom.filled(np.concatenate(codes_by_length), np.concatenate(levels_by_length), bits_per_key))
        last = {"share": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([None], pa.int32()), "bits": pa.array([stats.tobytes()], pa.binary())}
        return pa.concat_tables([pa.table(blocks), pa.table(last)])

    return cells.groupBy("share").applyInArrow(fill, "share int, block int, bits binary")


def levels_of(n: np.ndarray, total: int, resolution: int) -> np.ndarray:
    """Levels of counts: 1 for a count of one, and one more at each power of two of the share of all tokens."""
    once = math.floor(math.log2(resolution / max(1, total)))
    return np.maximum(1, np.floor(np.log2(n * (resolution / max(1, total)))).astype(np.int64) + 1 - once)


class Model:
    """What a task needs: the filter, mean counts by order and level, and the frequent words' exact counts."""

    def __init__(self, levels: bloom.LevelFilter | None, singles: np.ndarray, pairs: np.ndarray, total: int, types: int, held: dict[bytes, int]):
        self.levels, self.singles, self.pairs, self.total, self.types, self.held = levels, singles, pairs, total, types, held

    def with_levels(self, levels: bloom.LevelFilter | None) -> Model:
        return Model(levels, self.singles, self.pairs, self.total, self.types, self.held)

    def scores(self, texts: Texts) -> list[float]:
        """log10 probability of each text, from levels that the held filter tells."""
        return self.scores_of(texts, self.levels.levels(texts.single), self.levels.levels(texts.pair))

    def scores_of(self, texts: Texts, single: np.ndarray, pair: np.ndarray) -> list[float]:
        counts = self.singles[np.minimum(single, len(self.singles) - 1)]
        paired = self.pairs[np.minimum(pair, len(self.pairs) - 1)][texts.of_pair]
        chance = PAIR_WEIGHT * np.minimum(1.0, paired / counts[texts.context]) + (1 - PAIR_WEIGHT) * counts[texts.own] / (self.total + 1)
        return np.add.reduceat(np.log10(chance), np.r_[0, np.cumsum(texts.sizes)[:-1]]).tolist()


class Texts:
    """Distinct tokens and pairs of some texts, and where they stand: ``own`` and ``context`` are places in ``single``, ``of_pair`` in ``pair``."""

    def __init__(self, single: np.ndarray, own: np.ndarray, sizes: np.ndarray, end: int):
        self.single, self.own, self.sizes = single, own, sizes
        self.context = before_each(own, sizes, np.searchsorted(single, np.uint64(end)))
        self.pair, self.of_pair = np.unique(pair_codes(single[self.context], single[own]), return_inverse=True)

    @classmethod
    def of(cls, codes: list[np.ndarray], end: int) -> Texts:
        """``codes`` of each text, the end token's last."""
        single, own = np.unique(np.concatenate(codes), return_inverse=True)
        return cls(single, own, np.array(list(map(len, codes))), end)


def _table(stats: np.ndarray, nothing: float) -> np.ndarray:
    """Mean count by level from (sum of counts, n-grams); a level that holds nothing (reached by a false hit) takes the next lower one's."""
    out = [nothing]
    for n, types in stats[1:np.flatnonzero(stats[:, 1]).max(initial=0) + 1].tolist():
        out.append(n / types if types else out[-1])
    return np.array(out)


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all texts of ``docs``, and the exact count of every word."""
    words = written(count_words(docs), "words")
    total, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shares = max(16, -(-total // SHARE))
    table = written(fill_shares(word_cells(words, shares).unionByName(pair_cells(docs, shares)), total), "filter")
    stats = sum((np.frombuffer(row["bits"], np.int64) for row in table.filter("block is null").collect()), np.zeros(4 * MOST_LEVELS, np.int64))  # a row for each share
    single, pair = stats.reshape(2, MOST_LEVELS, 2)
    levels = bloom.finished(table.filter("block is not null"), shares)
    held = words.filter((F.col("n") * HELD_WORDS >= total) & (F.length("word") <= HELD_BYTES)).toPandas()
    model = Model(levels, _table(single, 1.0), _table(pair, 0.0), total, types, dict(zip(map(bytes, held["word"]), held["n"].tolist())))
    return model, words


def score(docs: DataFrame, model: Model, counts: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    split = docs.select("doc_id", "text", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"))
    scored = written(_scored_with_held_filter(split, model) if model.levels.held else _scored_with_dealt_codes(split, model), "scored")
    scored = scored.withColumn("row", F.monotonically_increasing_id())  # stable: the rows are written
    rare = scored.select("row", F.explode(F.arrays_zip(F.col("rest").alias("word"), "times")).alias("x")).select("row", "x.word", "x.times")
    sums = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_base"))
    below = float(np.log10(model.total + 0.5 * (model.types + 1)))
    return scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(model.total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * below).alias("base_score"), "score")


_SCORED = "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rest array<binary>, times array<long>"


class _Known:
    """Counts of the held words in texts, and the words that are not held."""

    def __init__(self, model: Model):
        self.logs = {word: math.log10(n + 0.5) for word, n in model.held.items()}
        self.known, self.sums, self.rest, self.times, self.ends = [], [], [], [], [0]

    def add(self, found: list[bytes]) -> None:
        own = Counter(found)
        own[END] = 1
        seen, total = 0, 0.0
        for word, n in own.items():
            log = self.logs.get(word)
            if log is None:
                self.rest.append(word)
                self.times.append(n)
            else:
                seen += n
                total += n * log
        self.known.append(seen)
        self.sums.append(total)
        self.ends.append(len(self.rest))

    def taken(self) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
        """known, base, rest and times of the texts so far, which are forgotten."""
        ends = pa.array(self.ends, pa.int32())
        out = (pa.array(self.known, pa.int64()), pa.array(self.sums, pa.float64()), pa.ListArray.from_arrays(ends, pa.array(self.rest, pa.binary())),
               pa.ListArray.from_arrays(ends, pa.array(self.times, pa.int64())))
        self.known, self.sums, self.rest, self.times, self.ends = [], [], [], [], [0]
        return out


def _scored_with_held_filter(split: DataFrame, model: Model) -> DataFrame:
    levels = model.levels.for_tasks()  # its shards are files of their own
    shared = split.sparkSession.sparkContext.broadcast(model.with_levels(None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = shared.value.with_levels(levels), WordCodes()
        counted = _Known(model)
        for batch in slices(batches):
            sizes, scores, waiting, size = [], [], [], 0
            for number, text in enumerate(batch.column("text").to_pylist()):
                found = words_of(text, lower=True)
                counted.add(found)
                sizes.append(len(found) + 1)
                waiting.append(text_codes(found, words))
                size += len(found) + 1
                if size >= SCORED or number + 1 == batch.num_rows:
                    scores += model.scores(Texts.of(waiting, words[END]))
                    waiting, size = [], 0
            known, base, rest, times = counted.taken()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(sizes, pa.int64()), known, base, pa.array(scores, pa.float64()), rest, times],
                                             names=[part.split()[0] for part in _SCORED.split(", ")])

    return split.mapInArrow(run, _SCORED)


def _scored_with_dealt_codes(split: DataFrame, model: Model) -> DataFrame:
    """Blocks of texts are written with their distinct tokens; these and their pairs are dealt to the filter's shares, the levels come back by block."""
    shared = split.sparkSession.sparkContext.broadcast(model.with_levels(None))
    shares, end = model.levels.shares, xxhash.xxh64_intdigest(END)
    columns = "reader long, doc_ids array<long>, held_outs array<boolean>, known array<long>, base array<double>, rest array<array<binary>>, times array<array<long>>, single binary, own binary, sizes binary"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, words = _Known(shared.value), WordCodes()
        reader = TaskContext.get().partitionId() << 32
        waiting, ids, held, size = [], [], [], 0

        def sent() -> pa.RecordBatch:
            texts = Texts.of(waiting, end)
            lists = [pa.array([values.to_pylist()], pa.list_(values.type)) for values in (pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), *counted.taken())]
            data = [pa.array([x.tobytes()], pa.binary()) for x in (texts.single, texts.own.astype(np.uint32), texts.sizes.astype(np.int64))]
            return pa.RecordBatch.from_arrays([pa.array([reader], pa.int64()), *lists, *data], names=[part.split()[0] for part in columns.split(", ")])

        for batch in slices(batches):
            for doc_id, out, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))):
                found = words_of(text, lower=True)
                counted.add(found)
                waiting.append(text_codes(found, words))
                ids.append(doc_id)
                held.append(out)
                size += len(found) + 1
                if size >= SCORED:
                    reader += 1
                    yield sent()
                    waiting, ids, held, size = [], [], [], 0
        if waiting:
            reader += 1
            yield sent()

    def texts_of(batch: pa.RecordBatch) -> Texts:
        single, own, sizes = (np.frombuffer(batch.column(c)[0].as_py(), kind) for c, kind in (("single", np.uint64), ("own", np.uint32), ("sizes", np.int64)))
        return Texts(single, own.astype(np.int64), sizes, end)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = texts_of(batch)
            codes = np.r_[texts.single, texts.pair]
            order, cuts = bloom.cut_by_share(codes, shares)
            yield pa.RecordBatch.from_arrays([
                pa.array([batch.column("reader")[0].as_py()] * len(cuts), pa.int64()), pa.array([share for share, _, _ in cuts], pa.int32()),
                pa.array([codes[order[s:e]].tobytes() for _, s, e in cuts], pa.binary())], names=["reader", "share", "codes"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, 1):
            texts = texts_of(batch)
            order, _ = bloom.cut_by_share(np.r_[texts.single, texts.pair], shares)
            levels = np.zeros(len(order), np.int64)
            levels[order] = np.frombuffer(b"".join(x["levels"] for x in batch.column("answers")[0].as_py()), np.uint8)
            scores = model.scores_of(texts, levels[:len(texts.single)], levels[len(texts.single):])
            lists = {c: batch.column(c)[0].values for c in ("doc_ids", "held_outs", "known", "base", "rest", "times")}
            yield pa.RecordBatch.from_arrays([lists["doc_ids"], lists["held_outs"], pa.array(texts.sizes, pa.int64()), lists["known"], lists["base"], pa.array(scores, pa.float64()), lists["rest"], lists["times"]],
                                             names=[part.split()[0] for part in _SCORED.split(", ")])

    rows = written(split.mapInArrow(blocks, columns), "text-blocks", **LARGE_ROWS)
    cells = rows.select("reader", "single", "own", "sizes").mapInArrow(deal, "reader long, share int, codes binary")
    answers = bloom.probe_shares(cells, model.levels).groupBy("reader").agg(F.array_sort(F.collect_list(F.struct("share", "levels"))).alias("answers"))
    return rows.join(answers, "reader").mapInArrow(finish, _SCORED)


@query("op2_language_model")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, counts = train(docs.filter(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT))
    return score(docs, model, counts)
