"""Phrase collocations by set-oriented relational mining (SETM).

Texts with A-Z lower-cased are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, those into words ``[^\\x20\\x09]+``.  The relation of length
1 holds each occurrence of a word with its place (piece and position), in the order of places.  To get from one
length to the next

* the relation is merge-joined with itself: the same piece, the next position;
* the joined occurrences are counted by phrase: a block of the relation counts its own, shuffles sum the blocks' counts;
* phrases below the support are dropped, and the relation is semi-joined with those that are left before it is extended.

Relations are written in blocks of about ``BLOCK_WORDS`` words of one language, as sorted arrays.  A block sends the counts of its
distinct phrases, cut into shares by hash, and each share answers every block with the phrases that are frequent, in the
order in which the block sent them: so a frequent phrase costs a block one entry however often it occurs, and
neither a phrase nor a language is gathered in one task.  Words get exact 32-bit numbers once they are
frequent, phrases are sequences of these.

A phrase of two or more words is scored at every cut into a first part and a rest, with ``a``, ``l``, ``r`` the occurrences of the
phrase and of both parts: ``floor(1000000 * a * a / (l * r))``, in decimals of 38 digits (enough for counts below 10^15).  The
lowest cut counts, the first of equal ones.  A phrase is dropped if a longer candidate that contains it occurs at least half
as often.

A null text is empty, a null language is ``und``.  Repeated rows count each; extra columns and ids are ignored; an empty table gives no
rows.  A very long text makes a longer block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.common import slices
from tributary.llm.registry import query, table
from tributary.session import scratch_path

LEAST_COUNT = 10
MOST_WORDS = 3
BEST = 2000
#: A longer candidate drops a phrase from this share of its occurrences, in hundredths.
CONTAINED = 50
SCALE = 1_000_000
#: Words of a block, and words of the corpus for each share of the phrases.
BLOCK_WORDS = 1_000_000
SHARE_WORDS = 1_000_000
#: Rows that a task may rank.
RANKED_ROWS = 10_000

# signs that end a piece become a mark that no word holds
_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _ENDS + b"\t", bytes(range(97, 123)) + b"." * len(_ENDS) + b" ")
_MARK = b"."


class WordNumbers(dict):
    """Words of a block by number, from 1; 0 is the mark between pieces."""

    def __init__(self):
        super().__init__({_MARK: 0})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def words_and_marks(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).replace(b".", b" . ").split()


def _packed(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 1)


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _places(marks: np.ndarray) -> np.ndarray:
    """Piece << 32 | position of every entry; ``marks`` tells which entries end a piece."""
    piece = np.cumsum(marks)
    entry = np.arange(len(marks))
    first = np.r_[0, np.flatnonzero(marks) + 1]
    return (piece << 32) | (entry - first[piece])


def _written(frame: DataFrame, name: str) -> DataFrame:
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def occurrences(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The relation of all words in blocks: ``block``, ``lang``, its ``vocabulary``, ``words`` (how many) and ``entries``, word numbers with marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        sent = 0
        waiting: dict[str, tuple[WordNumbers, list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def block(lang: str) -> pa.RecordBatch:
            nonlocal sent
            numbers, parts = waiting.pop(lang)
            del sizes[lang]
            entries = np.concatenate(parts)
            sent += 1
            return pa.RecordBatch.from_arrays([
                pa.array([task + sent], pa.int64()), pa.array([lang]), pa.array([list(numbers)[1:]], pa.list_(pa.binary())),
                pa.array([int(np.count_nonzero(entries))], pa.int64()), pa.array([_packed(entries)], pa.binary())],
                names=["block", "lang", "vocabulary", "words", "entries"])

        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if lang not in waiting:
                    waiting[lang], sizes[lang] = (WordNumbers(), []), 0
                numbers, parts = waiting[lang]
                found = words_and_marks(text)
                parts.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
                parts.append(np.zeros(1, np.uint32))
                sizes[lang] += len(found) + 1
                if sizes[lang] >= block_words:
                    yield block(lang)
                elif sum(sizes.values()) >= 4 * block_words:  # many languages, none of which fills a block
                    yield block(max(sizes, key=sizes.get))
        for lang in list(waiting):
            yield block(lang)

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return texts.mapInArrow(run, "block long, lang string, vocabulary array<binary>, words long, entries binary")


_SENT = "lang string, share int, block long, phrases binary, counts binary"
_SUMMED = "lang string, share int, block long, answer binary, phrase binary, word binary, n long"


def _shares_of(phrases: np.ndarray, shares: int) -> np.ndarray:
    """The share of each phrase (rows of word numbers)."""
    code = np.zeros(len(phrases), np.uint64)
    for column in phrases.T:
        code = (code ^ column) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return ((code * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) % np.uint64(shares)).astype(np.int64)


def _keys(phrases: np.ndarray) -> list[bytes]:
    """Each phrase as big-endian bytes, four for a word."""
    data, width = phrases.astype(">u4").tobytes(), 4 * phrases.shape[1]
    return [data[at:at + width] for at in range(0, len(data), width)]


def count_words(relation: DataFrame, shares: int, least: int) -> DataFrame:
    """Summed rows of single words: each share numbers its frequent words and answers the blocks with the numbers."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            words = batch.column("vocabulary")[0].as_py()
            counts = np.bincount(_unpacked(batch.column("entries")[0].as_py(), np.uint32), minlength=len(words) + 1)[1:]
            order, cuts = _word_shares(words, shares)
            cells = [(share, order[s:e]) for share, s, e in cuts]
            yield pa.RecordBatch.from_arrays([
                pa.array([batch.column("lang")[0].as_py()] * len(cells), pa.string()), pa.array([share for share, _ in cells], pa.int32()),
                pa.array([batch.column("block")[0].as_py()] * len(cells), pa.int64()),
                pa.array([zstandard.compress(b" ".join([words[i] for i in own.tolist()]), 1) for _, own in cells], pa.binary()),
                pa.array([_packed(counts[own].astype(np.int64)) for _, own in cells], pa.binary())], names=["lang", "share", "block", "phrases", "counts"])

    def add(key: tuple, group: pa.Table) -> pa.Table:
        lang, share = key[0].as_py(), key[1].as_py()
        sums: dict[bytes, int] = {}
        cells = [(block, zstandard.decompress(words).split(b" "), _unpacked(counts, np.int64).tolist())
                 for block, words, counts in zip(*(group.column(c).to_pylist() for c in ("block", "phrases", "counts")))]
        for _, words, counts in cells:
            for word, n in zip(words, counts):
                sums[word] = sums.get(word, 0) + n
        frequent = sorted(word for word, n in sums.items() if n >= least)
        if len(frequent) * shares + share >= 1 << 32:
            raise ValueError("more frequent words than 32-bit numbers")
        number = {word: 1 + i * shares + share for i, word in enumerate(frequent)}
        numbers = np.fromiter(number.values(), np.uint32, len(number)).reshape(-1, 1)
        answers = [_packed(np.fromiter((number.get(word, 0) for word in words), np.uint32, len(words))) for _, words, _ in cells]
        return _summed_rows(lang, share, [c[0] for c in cells], answers, _keys(numbers), [sums[word] for word in frequent], frequent, sum(sums.values()))

    sent = relation.select("block", "lang", "vocabulary", "entries").mapInArrow(send, _SENT)
    return sent.groupBy("lang", "share").applyInArrow(add, _SUMMED)


def _word_shares(words: list[bytes], shares: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The words' order by share, and (share, first, end) of each share in it."""
    owner = np.fromiter((xxhash.xxh64_intdigest(word) % shares for word in words), np.int64, len(words))
    return _cut_by(owner)


def _cut_by(owner: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    order = np.argsort(owner, kind="stable")
    sorted_owner = owner[order]
    starts = np.flatnonzero(np.r_[len(owner) > 0, sorted_owner[1:] != sorted_owner[:-1]])
    return order, list(zip(sorted_owner[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(owner)]))


def _summed_rows(lang: str, share: int, blocks: list[int], answers: list[bytes], keys: list[bytes], n: list[int], words: list[bytes] | None, total: int | None) -> pa.Table:
    """Answers to blocks, frequent phrases, and a row with neither for the number of words of the share."""
    rest = [] if total is None else [total]
    size = len(blocks) + len(keys) + len(rest)
    nothing = [None] * (len(keys) + len(rest))
    return pa.table({
        "lang": pa.array([lang] * size, pa.string()), "share": pa.array([share] * size, pa.int32()), "block": pa.array(blocks + nothing, pa.int64()),
        "answer": pa.array(answers + nothing, pa.binary()), "phrase": pa.array([None] * len(blocks) + keys + [None] * len(rest), pa.binary()),
        "word": pa.array([None] * len(blocks) + (words or [None] * len(keys)) + [None] * len(rest), pa.binary()),
        "n": pa.array([None] * len(blocks) + n + rest, pa.int64())})


def _answers(summed: DataFrame) -> DataFrame:
    """``block`` and its answers, one for each share that it sent to."""
    return summed.filter("block is not null").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("share", "answer"))).alias("answers"))


_RELATION = "block long, lang string, places binary, groups binary, phrases binary, length int"


def _relation_row(block: int, lang: str, places: np.ndarray, groups: np.ndarray, phrases: np.ndarray) -> pa.RecordBatch:
    """Occurrences in the order of places; ``groups`` are rows of ``phrases``."""
    return pa.RecordBatch.from_arrays([
        pa.array([block], pa.int64()), pa.array([lang]), pa.array([_packed(np.diff(places, prepend=0))], pa.binary()),
        pa.array([_packed(groups.astype(np.uint32))], pa.binary()), pa.array([_packed(np.ascontiguousarray(phrases.astype(np.uint32).T))], pa.binary()),
        pa.array([phrases.shape[1]], pa.int32())], names=["block", "lang", "places", "groups", "phrases", "length"])


def _relation_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, groups and phrases of a block."""
    places, groups, phrases = (batch.column(c)[0].as_py() for c in ("places", "groups", "phrases"))
    length = batch.column("length")[0].as_py()
    return np.cumsum(_unpacked(places, np.int64)), _unpacked(groups, np.uint32).astype(np.int64), _unpacked(phrases, np.uint32).reshape(length, -1).T


def frequent_words(relation: DataFrame, summed: DataFrame) -> DataFrame:
    """The relation of words semi-joined with the frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            words, answers = batch.column("vocabulary")[0].as_py(), batch.column("answers")[0].as_py()
            entries = _unpacked(batch.column("entries")[0].as_py(), np.uint32)
            order, _ = _word_shares(words, shares)
            numbers = np.zeros(len(words) + 1, np.uint32)
            numbers[order + 1] = np.concatenate([np.zeros(0, np.uint32), *(_unpacked(x["answer"], np.uint32) for x in answers)])
            kept = numbers[entries] > 0
            phrases, groups = np.unique(numbers[entries[kept]], return_inverse=True)
            yield _relation_row(batch.column("block")[0].as_py(), batch.column("lang")[0].as_py(), _places(entries == 0)[kept], groups, phrases.reshape(-1, 1))

    shares = summed.shares
    return relation.join(_answers(summed.rows), "block").select("block", "lang", "vocabulary", "entries", "answers").mapInArrow(run, _RELATION)


def extended(places: np.ndarray, groups: np.ndarray, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The relation merge-joined with itself at the next position of the same piece: places, groups, and the longer phrases.

    Both sides stand in the order of places, and a place is named once.  A phrase overlaps the next one in all its words but the first.
    """
    at = np.searchsorted(places, places + 1)
    follows = at < len(places)
    follows[follows] = places[at[follows]] == places[follows] + 1
    left, right = groups[follows], groups[at[follows]]
    pairs, joined = np.unique(left * len(phrases) + right, return_inverse=True)
    longer = np.column_stack([phrases[pairs // max(1, len(phrases))], phrases[pairs % max(1, len(phrases))][:, -1:]])
    return places[follows], joined, longer


def count_phrases(relation: DataFrame, shares: int, least: int) -> DataFrame:
    """Summed rows of the phrases that extend the relation by a word."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            _, groups, phrases = extended(*_relation_of(batch))
            counts = np.bincount(groups, minlength=len(phrases))
            order, cuts = _cut_by(_shares_of(phrases, shares))
            cells = [(share, order[s:e]) for share, s, e in cuts]
            yield pa.RecordBatch.from_arrays([
                pa.array([batch.column("lang")[0].as_py()] * len(cells), pa.string()), pa.array([share for share, _ in cells], pa.int32()),
                pa.array([batch.column("block")[0].as_py()] * len(cells), pa.int64()),
                pa.array([_packed(np.ascontiguousarray(phrases[own].T)) for _, own in cells], pa.binary()),
                pa.array([_packed(counts[own].astype(np.uint32)) for _, own in cells], pa.binary())], names=["lang", "share", "block", "phrases", "counts"])

    def add(key: tuple, group: pa.Table) -> pa.Table:
        counts = [_unpacked(x, np.uint32) for x in group.column("counts").to_pylist()]
        ends = np.cumsum(list(map(len, counts)))
        phrases = np.concatenate([_unpacked(x, np.uint32).reshape(-1, len(c)) for x, c in zip(group.column("phrases").to_pylist(), counts)], axis=1)
        order = np.lexsort(phrases[::-1])
        ordered = phrases[:, order]
        starts = np.flatnonzero(np.r_[True, (ordered[:, 1:] != ordered[:, :-1]).any(0)])
        sums = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), starts)
        frequent = sums >= least
        flags = np.zeros(len(order), bool)
        flags[order] = np.repeat(frequent, np.diff(np.r_[starts, len(order)]))
        answers = [np.packbits(part).tobytes() for part in np.split(flags, ends[:-1])]
        return _summed_rows(key[0].as_py(), key[1].as_py(), group.column("block").to_pylist(), answers,
                            _keys(ordered[:, starts[frequent]].T), sums[frequent].tolist(), None, None)

    sent = relation.mapInArrow(send, _SENT)
    return sent.groupBy("lang", "share").applyInArrow(add, _SUMMED)


def frequent_phrases(relation: DataFrame, summed: DataFrame) -> DataFrame:
    """The relation extended by a word, semi-joined with the frequent phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            places, groups, phrases = extended(*_relation_of(batch))
            order, cuts = _cut_by(_shares_of(phrases, shares))
            flags = np.zeros(len(phrases), bool)
            for (_, start, end), answer in zip(cuts, batch.column("answers")[0].as_py()):
                flags[order[start:end]] = np.unpackbits(np.frombuffer(answer["answer"], np.uint8), count=end - start).astype(bool)
            kept = flags[groups]
            number = np.cumsum(flags) - 1
            yield _relation_row(batch.column("block")[0].as_py(), batch.column("lang")[0].as_py(), places[kept], number[groups[kept]], phrases[flags])

    shares = summed.shares
    return relation.join(_answers(summed.rows), "block").mapInArrow(run, _RELATION)


class Summed:
    """Written rows of counts and answers, and the number of shares they were cut into."""

    def __init__(self, rows: DataFrame, shares: int):
        self.rows, self.shares = rows, shares

    def phrases(self) -> DataFrame:
        return self.rows.filter("phrase is not null").select("lang", "phrase", "n")


def mine(docs: DataFrame, least: int = LEAST_COUNT, most_words: int = MOST_WORDS, block_words: int = BLOCK_WORDS, share_words: int = SHARE_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases (lang, phrase: four bytes a word, n) of 1 to ``most_words`` words; their words (lang, number, word); words by language."""
    relation = _written(occurrences(docs, block_words), "words")
    total = relation.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    shares = max(4, -(-total // share_words))
    summed = first = Summed(_written(count_words(relation, shares, least), "word-counts"), shares)
    levels = [first.phrases()]
    for length in range(2, most_words + 1):
        semi_joined = frequent_words if length == 2 else frequent_phrases
        relation = _written(semi_joined(relation, summed), f"relation-{length - 1}")
        summed = Summed(_written(count_phrases(relation, shares, least), f"counts-{length}"), shares)
        levels.append(summed.phrases())
    phrases = levels[0]
    for level in levels[1:]:
        phrases = phrases.unionByName(level)
    words = first.rows.filter("word is not null").select("lang", F.col("phrase").alias("number"), "word")
    totals = first.rows.filter("block is null and phrase is null").groupBy("lang").agg(F.sum("n").alias("n"))
    return phrases, words, totals


def score(phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r and score of phrases of two or more words that no longer one drops."""
    candidates = phrases.filter(F.length("phrase") > 4).withColumnRenamed("n", "a")
    size = (F.length("phrase") / 4).cast("int")
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.withColumns({"first": F.substring("phrase", F.lit(1), 4 * F.col("cut")), "rest": F.substring("phrase", 4 * F.col("cut") + 1, F.length("phrase"))})
    parts = phrases.select("lang", "phrase", "n")
    scored = (
        cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
        .join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    )
    a, l, r = (F.col(name).cast("decimal(15,0)") for name in ("a", "l", "r"))  # noqa: E741
    scored = scored.withColumn("score", F.call_function("div", a * a * F.lit(SCALE).cast("decimal(7,0)"), l * r))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low")).select(
        "lang", "phrase", "a", "low.l", "low.r", "low.score")
    longer = candidates.filter(F.length("phrase") > 8)
    inside = (
        longer.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(2), size - 1)).alias("words"))
        .select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(0), size - F.col("words"))).alias("at"))
        .select("lang", F.substring("phrase", 4 * F.col("at") + 1, 4 * F.col("words")).alias("phrase"), "a")
        .groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    )
    kept = F.col("most").isNull() | (100 * F.col("most") < CONTAINED * F.col("a"))
    return lowest.join(inside, ["lang", "phrase"], "left").filter(kept).drop("most")


def best_of_each(frame: DataFrame, group: str, order: list, most: int, rows: int = RANKED_ROWS, ties: bool = False) -> DataFrame:
    """The first ``most`` rows of each group (with ``ties``: and those equal to the last); groups are ranked in parts of about ``rows`` rows first."""
    rank = F.rank() if ties else F.row_number()
    size = frame.count()
    while size > rows:
        part = F.pmod(F.xxhash64(*frame.columns), F.lit(-(-size // rows)))
        frame = _written(frame.withColumn("__part", part).withColumn("__rank", rank.over(Window.partitionBy(group, "__part").orderBy(*order)))
                         .filter(F.col("__rank") <= most).drop("__part", "__rank"), "ranked")
        before, size = size, frame.count()
        if 2 * size > before:
            break
    return frame.withColumn("rank", rank.over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = LEAST_COUNT, most_words: int = MOST_WORDS, best: int = BEST, **sizes) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of each language."""
    phrases, words, totals = mine(docs, least, most_words, **sizes)
    found = _written(score(phrases), "scored")
    by_score = [F.desc("score"), F.desc("a")]
    # without the texts first: phrases equal to the last one stay until the texts decide
    found = _written(best_of_each(found, "lang", by_score, best, ties=True).drop("rank").withColumn("row", F.monotonically_increasing_id()), "best")
    places = found.select("row", "lang", F.explode(F.sequence(F.lit(0), (F.length("phrase") / 4).cast("int") - 1)).alias("at"), "phrase")
    texts = (
        places.select("row", "lang", "at", F.substring("phrase", 4 * F.col("at") + 1, F.lit(4)).alias("number")).join(words, ["lang", "number"])
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
        .select("row", F.concat_ws(" ", F.transform("words", lambda x: x["word"].cast("string"))).alias("text"))
    )
    found = found.join(texts, "row").select("lang", F.col("text").alias("phrase"), "a", "l", "r", "score")
    ranked = best_of_each(found, "lang", [*by_score, F.asc("phrase")], best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = """
WITH pieces AS (
    SELECT row_number() OVER () AS piece, lang, list_filter(regexp_split_to_array(part, '[ \\t]+'), lambda w: w <> '') AS words
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS part FROM documents)),
placed AS (SELECT piece, lang, unnest(words) AS w, generate_subscripts(words, 1) AS place FROM pieces),
runs AS (SELECT lang, w AS w1, lead(w) OVER (PARTITION BY piece ORDER BY place) AS w2, lead(w, 2) OVER (PARTITION BY piece ORDER BY place) AS w3 FROM placed),
f1 AS (SELECT lang, w1, count(*) AS f FROM runs GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
cuts AS (
    SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, 1 AS cut, x.f AS l, y.f AS r
    FROM f2 p JOIN f1 x ON (x.lang, x.w1) = (p.lang, p.w1) JOIN f1 y ON (y.lang, y.w1) = (p.lang, p.w2) WHERE p.f >= 10
    UNION ALL
    SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.f, 1, x.f, y.f
    FROM f3 p JOIN f1 x ON (x.lang, x.w1) = (p.lang, p.w1) JOIN f2 y ON (y.lang, y.w1, y.w2) = (p.lang, p.w2, p.w3)
    UNION ALL
    SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.f, 2, x.f, y.f
    FROM f3 p JOIN f2 x ON (x.lang, x.w1, x.w2) = (p.lang, p.w1, p.w2) JOIN f1 y ON (y.lang, y.w1) = (p.lang, p.w3)),
scored AS (SELECT *, CAST((a::HUGEINT * a * 1000000) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
    SELECT lang, phrase, max(f) AS most
    FROM (SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL),
kept AS (SELECT c.* FROM lowest c LEFT JOIN inside i ON (i.lang, i.phrase) = (c.lang, c.phrase) WHERE i.most IS NULL OR 100 * i.most < 50 * c.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op12_phrase_collocations", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
