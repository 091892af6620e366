"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters, digits and underscores.  A seed is a run of ``LEAST_TILE`` words; its
rolling hash (Karp-Rabin) is looked up among the seeds of the benchmark.  For each document and item that share a
seed, the longest match of words that no tile covers yet is marked as a tile, again and again, until no match of
``LEAST_TILE`` words is left.  The share of the item's words under tiles is its coverage, whatever the order of
the tiles, so passages whose parts were moved are caught.  Items shorter than a seed use their whole length.  Where a seed
repeats in an item, places are not listed: the longest match is searched by Karp-Rabin hashes of falling lengths.

Null or empty texts and items without words match nothing.  Repeated documents are reported each, repeated items
under the least item id.  Extra columns are ignored by ``leaks`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import Columns, filter_columns, map_columns
from tributary.llm.registry import query, table
from tributary.session import cut_lineage

LEAST_TILE = 5
LEAST_COVERAGE = 0.5
#: Words of a benchmark that every task may hold (about 100 bytes each); beyond it, seeds are joined by shuffle.
HELD_WORDS = 1_000_000
BASE = np.uint64(1_000_003)
WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` ids, modulo 2^64."""
    if len(ids) < length:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(ids) - length + 1, np.uint64)
    for i in range(length):
        out = out * BASE + ids[i:len(ids) - length + 1 + i]
    return out


def tile(places: list[tuple[int, int]], least: int, doc: list | None = None) -> list[tuple[int, int, int]]:
    """Tiles (start in document, start in item, words) from the places where seeds of ``least`` words agree.

    Seeds that follow each other on a diagonal form one match.  Matches are taken by length, the longest first
    and ties by place; what earlier tiles cover is cut off a match, and its rest waits for its turn.
    """
    diagonals: dict[int, list[int]] = defaultdict(list)
    for at, item_at in places:
        diagonals[at - item_at].append(at)
    waiting: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by length
    for shift, starts in diagonals.items():
        starts = sorted(set(starts))
        begin = previous = starts[0]
        for at in [*starts[1:], None]:
            if at is None or at != previous + 1:
                waiting[previous - begin + least].append((begin, begin - shift))
                begin = at
            previous = at
    doc_used: set[int] = set()
    item_used: set[int] = set()
    tiles = []
    while waiting:
        length = max(waiting)
        for at, item_at in sorted(waiting.pop(length)):
            free = [at + i not in doc_used and item_at + i not in item_used for i in range(length)]
            if all(free):
                tiles.append((at, item_at, length))
                doc_used.update(range(at, at + length))
                item_used.update(range(item_at, item_at + length))
                continue
            run = 0
            for i, ok in enumerate([*free, False]):
                if ok:
                    run += 1
                    continue
                if run >= least:
                    waiting[run].append((at + i - run, item_at + i - run))
                run = 0
    return sorted(tiles)


def tile_repeated(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The tiles of :func:`tile` for two sequences of ids whose seeds repeat, without listing the places where they meet; id 0 matches nothing.

    The length of the longest match that is left is found by halving (a match of a length holds matches of all shorter ones), on hashes of all free windows
    of a length.  Then the free windows of that length are taken in order, each with the first free one of the item that equals it; a window that is
    not free never becomes free again, so both sides are passed once for each length that occurs.
    """
    # a window's hash, the sum of id * BASE^-place from its start on, is a difference of running sums; all modulo 2^64
    powers, inverse = (np.cumprod(np.r_[np.uint64(1), np.full(max(len(doc), len(item)), base, np.uint64)]) for base in (BASE, pow(int(BASE), -1, 1 << 64)))
    sides = [(np.cumsum(np.r_[np.uint64(0), ids * inverse[:len(ids)]]), ids == 0) for ids in (doc, item)]

    def free(length: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Where windows of ``length`` without a used id start, and their hashes, on both sides."""
        out = []
        for sums, used in sides:
            taken = np.r_[0, np.cumsum(used)]
            starts = np.flatnonzero(taken[length:] == taken[:-length])
            out.append((starts, (sums[starts + length] - sums[starts]) * powers[starts]))
        return out

    tiles, most = [], min(len(doc), len(item))
    while most >= least:
        low, high = least - 1, most  # a match of length low is known or too short to count
        while low < high:
            middle = (low + high + 1) // 2
            (_, ours), (_, theirs) = free(middle)
            if np.isin(ours, theirs).any():
                low = middle
            else:
                high = middle - 1
        if low < least:
            break
        (starts, ours), (item_starts, theirs) = free(low)
        by_code: dict[int, list[int]] = defaultdict(list)
        for at, code in zip(item_starts[::-1].tolist(), theirs[::-1].tolist()):
            by_code[code].append(at)  # the first place stands last
        doc_used, item_used = sides[0][1], sides[1][1]
        for at, code in zip(starts.tolist(), ours.tolist()):
            waiting = by_code.get(code)
            while waiting and item_used[waiting[-1]:waiting[-1] + low].any():
                waiting.pop()
            if waiting and not doc_used[at:at + low].any() and np.array_equal(doc[at:at + low], item[waiting[-1]:waiting[-1] + low]):
                place = waiting.pop()
                tiles.append((at, place, low))
                doc_used[at:at + low] = item_used[place:place + low] = True
        most = low - 1
    return sorted(tiles)


def covered_part(ids: np.ndarray, starts: np.ndarray, seed: int) -> np.ndarray:
    """The ids under seeds that begin at ``starts``, in order, with a 0 wherever some are left out."""
    marks = np.zeros(len(ids) + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + seed, -1)
    kept = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
    gaps = np.flatnonzero(np.diff(kept) > 1) + 1
    return np.insert(ids[kept], gaps, 0)


class Benchmark:
    """Seeds of a benchmark that a task can hold."""

    def __init__(self, items: list[tuple[int | None, str]], least: int = LEAST_TILE):
        """``items``: ids and words joined by spaces, each phrase once."""
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int | None, int]] = []
        self.groups: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        self.repeating: dict[int, np.ndarray] = {}  # words of the items in which a seed repeats: their seeds stand under place -1, once
        for item_id, phrase in sorted(items, key=lambda item: item[1]):
            words = phrase.split(" ")
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint64)
            seed = min(least, len(words))
            found = rolling(self.spread(ids), seed).tolist()
            if len(set(found)) < len(found):
                self.repeating[len(self.items)] = ids
                found, places = list(set(found)), itertools.repeat(-1)
            else:
                places = range(len(found))
            for place, code in zip(places, found):
                self.groups[seed][code].append((len(self.items), place))
            self.items.append((item_id, len(words)))
        self.codes = {seed: np.array(sorted(found), np.uint64) for seed, found in self.groups.items()}

    @staticmethod
    def spread(ids: np.ndarray) -> np.ndarray:
        return ids * np.uint64(0x9E3779B97F4A7C15) ^ (ids >> np.uint64(7))

    def matches(self, text: str | None) -> list[tuple[int | None, int, int, int, int]]:
        """(item id, item words, covered words, tiles, longest tile) of each item that shares a seed with the text."""
        known = self.vocabulary.get
        words = tokens(text)
        ids = np.fromiter((known(w, 0) for w in words), np.uint64, len(words))
        if not ids.any():
            return []
        mixed, out = self.spread(ids), []
        for seed, codes in self.codes.items():
            rolled = rolling(mixed, seed)
            if not len(rolled):
                continue
            near = np.minimum(np.searchsorted(codes, rolled), len(codes) - 1)
            hits = np.flatnonzero(codes[near] == rolled)
            gaps = np.r_[0, np.cumsum(ids == 0)]
            hits = hits[gaps[hits + seed] == gaps[hits]]  # a word outside the benchmark's vocabulary matches nothing
            places: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for at in hits.tolist():
                for number, place in self.groups[seed][int(rolled[at])]:
                    places[number].append((at, place))
            for number, found in places.items():
                item_id, size = self.items[number]
                if number in self.repeating:
                    tiles = tile_repeated(covered_part(ids, np.array([at for at, _ in found]), seed), self.repeating[number], seed)
                else:
                    tiles = tile(found, seed)
                lengths = [length for _, _, length in tiles]
                if not lengths:  # hashes that agree by chance
                    continue
                out.append((item_id, size, sum(lengths), len(lengths), max(lengths)))
        return out


FIELDS = {"doc_id": "long", "item_id": "long", "item_words": "int", "covered_words": "int", "tiles": "int", "longest_tile": "int"}


def _phrases(items: DataFrame) -> DataFrame:
    """item_id (the least of equal items) and the words of each item, joined by spaces."""

    def step(batch: Columns) -> Columns:
        return {"item_id": batch["item_id"], "phrase": [" ".join(tokens(text)) for text in batch["text"]]}

    phrases = map_columns(items.select("item_id", "text"), {"item_id": "long", "phrase": "string"}, lambda: step)
    return phrases.filter("phrase <> ''").groupBy("phrase").agg(F.min("item_id").alias("item_id")).select("item_id", "phrase")


def _held(phrases: DataFrame, held_words: int) -> list[tuple] | None:
    """The items, if their words fit a task; counted before anything is fetched."""
    words = phrases.agg(F.sum(F.size(F.split("phrase", " ")))).first()[0] or 0
    return [tuple(row) for row in phrases.collect()] if words <= held_words else None


def _joined(docs: DataFrame, phrases: DataFrame, least: int) -> DataFrame:
    """Matches for benchmarks of any size, with ``own``, the MD5 digest of the document's text.

    Seeds of both sides meet by a join, tiles follow for each pair of texts.  Items in which a seed repeats meet by distinct seeds: their pairs carry the words of
    the document's seeds, so that places are never multiplied.
    """
    fields = {"own": "string", "seed": "int", "code": "long", "place": "int", "repeats": "boolean", "words": "binary"}

    def seeds_of(lengths: list[int]):
        def step(batch: Columns) -> Columns:
            out: Columns = {name: [] for name in fields}
            for own, text in zip(batch["own"], batch["text"]):
                words = tokens(text)
                codes = np.array([xxhash.xxh64_intdigest(word) for word in words], np.uint64)
                data = codes.tobytes()
                for seed in lengths or [min(least, len(words))]:
                    rolled = rolling(codes, seed).view(np.int64).tolist()
                    out["own"] += [own] * len(rolled)
                    out["seed"] += [seed] * len(rolled)
                    out["code"] += rolled
                    out["place"] += range(len(rolled))
                    out["repeats"] += [len(set(rolled)) < len(rolled)] * len(rolled)
                    out["words"] += [data[8 * at:8 * (at + seed)] for at in range(len(rolled))] if lengths else [None] * len(rolled)
            return out

        return lambda: step

    items = phrases.select(F.md5("phrase").alias("own"), "item_id", F.col("phrase").alias("text"), F.size(F.split("phrase", " ")).alias("item_words"))
    item_seeds = cut_lineage(map_columns(items.select("own", "text"), fields, seeds_of([])))
    lengths = sorted(row.seed for row in item_seeds.select("seed").distinct().collect())
    rows = docs.select("doc_id", F.md5("text").alias("own"), "text")
    doc_seeds = map_columns(rows.select("own", "text"), fields, seeds_of(lengths or [least])).drop("repeats")
    single = item_seeds.filter("not repeats").select(F.col("own").alias("item"), "seed", "code", F.col("place").alias("item_place"))
    pairs = doc_seeds.drop("words").join(single, ["seed", "code"]).select("own", "item", "seed", "place", "item_place").distinct()  # copies of a text leave one set of places

    def counted(own: str, item: str, found: list[tuple[int, int, int]]) -> pd.DataFrame:
        lengths = [length for _, _, length in found]
        return pd.DataFrame([[own, item, sum(lengths), len(lengths), max(lengths)]] if lengths else [], columns=["own", "item", "covered_words", "tiles", "longest_tile"])

    def tiles(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        return counted(first.own, first["item"], tile(list(zip(group.place.tolist(), group.item_place.tolist())), int(first.seed)))

    kinds = "own string, item string, covered_words int, tiles int, longest_tile int"
    found = pairs.groupBy("own", "item").applyInPandas(tiles, kinds)

    repeating = item_seeds.filter("repeats").select(F.col("own").alias("item"), "seed", "code").distinct()
    met = doc_seeds.join(repeating, ["seed", "code"]).groupBy("own", "item", "seed").agg(F.collect_set(F.struct("place", "words")).alias("windows"))
    texts = items.select(F.col("own").alias("item"), F.col("text").alias("phrase"))

    def repeated_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, item, seed, windows, phrase in zip(*(batch[c] for c in ("own", "item", "seed", "windows", "phrase"))):
                starts = np.array([w["place"] for w in windows])
                ids = np.zeros(int(starts.max()) + seed, np.uint64)
                for w in windows:
                    ids[w["place"]:w["place"] + seed] = np.frombuffer(w["words"], np.uint64)
                target = np.array([xxhash.xxh64_intdigest(word) for word in phrase.split(" ")], np.uint64)
                yield counted(own, item, tile_repeated(covered_part(ids, starts, seed), target, seed))

    found = found.unionByName(met.join(texts, "item").mapInPandas(repeated_tiles, kinds))
    return (
        rows.select("doc_id", "own").join(found, "own")
        .join(items.select(F.col("own").alias("item"), "item_id", "item_words"), "item").select("own", *FIELDS)
    )


def leaks(docs: DataFrame, items: DataFrame, least: int = LEAST_TILE, held_words: int = HELD_WORDS) -> DataFrame:
    """A row for each document and benchmark item that share a tile, with coverage = covered_words / item_words."""
    phrases = _phrases(items)
    held = _held(phrases, held_words)
    if held is None:
        found = _joined(docs, phrases, least).drop("own")
    else:
        def start():
            benchmark = Benchmark(held, least)

            def step(batch: Columns) -> Columns:
                rows = [(doc_id, *match) for doc_id, text in zip(batch["doc_id"], batch["text"]) for match in benchmark.matches(text)]
                return {name: [row[i] for row in rows] for i, name in enumerate(FIELDS)}

            return step

        found = map_columns(docs.select("doc_id", "text"), FIELDS, start)
    return found.withColumn("coverage", F.col("covered_words") / F.col("item_words"))


def keep_clean(docs: DataFrame, items: DataFrame, least_coverage: float = LEAST_COVERAGE, held_words: int = HELD_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no item is covered by ``least_coverage`` or more, with all their columns."""
    phrases = _phrases(items)
    held = _held(phrases, held_words)
    if held is None:
        # by text, as the held path judges: an id may be null, or stand for other texts too
        bad = _joined(docs, phrases, LEAST_TILE).filter(F.col("covered_words") >= least_coverage * F.col("item_words")).select(F.col("own").alias("__own")).distinct()
        return docs.join(bad, F.md5("text") == F.col("__own"), "left_anti").select(docs.columns)

    def start():
        benchmark = Benchmark(held)
        return lambda batch: [all(match[2] < least_coverage * match[1] for match in benchmark.matches(text)) for text in batch["text"]]

    return filter_columns(docs, start, ["text"])


@query("op7_benchmark_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked items of each document: coverage of at least ``LEAST_COVERAGE``."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.filter(F.col("coverage") >= LEAST_COVERAGE).withColumn("contaminated", F.lit(True))
