"""Near copies among whole texts: shingle keys, wide SimHash fingerprints, pivot distance tables and exact similarity.

Two texts are near copies if their sets of 5-word shingles (A-Z lower-cased) have a Jaccard similarity of 0.8 or
more.  Texts with equal sets are one class from the start; links between classes are exact, as every one is verified on
the two sets.  How classes meet depends on their size:

* up to ``FEW_REACH`` shingles, by a prefix filter: of sets that reach 0.8, each has a common shingle among its
  ``n - ceil(0.8 n) + 1`` rarest ones, so no pair is lost.  Shingles that only one class has meet nothing and are not sent.
  Sets travel with the classes and are compared where they meet;
* above ``FEW`` shingles (a pair from 0.8 is wholly in the one range or in the other), by ``KEYS`` keys that join ``LEAST``
  minima of the shingle hashes each, which keep a pair of similarity 0.8 together with probability 0.9998, and unrelated
  texts apart at any number of rows.  Of texts that meet, those whose distances to a reference fingerprint (some of the block
  serve as pivots) or to each other exceed ``RADIUS`` are discarded.  A fingerprint has ``BITS`` bits over the distinct
  shingles; two sets of similarity s differ in a share acos(2s / (1 + s)) / pi of the bits on average, and ``RADIUS`` is the
  mean at 0.8 and six standard deviations.  What is left makes components of candidates, inside which all sets are compared.

Blocks, stars and components are those of :mod:`simhash`.

A null or empty text, or one without words, has an empty set and is a copy of any other such text.  A text of fewer than five
words is one shingle.  Rows with a null id take part in links but never name a component.  Repeated rows are returned each, and of
rows that repeat an id ``keep_one`` keeps one.  ``keep_one`` keeps all columns, whatever their names; an empty table gives no rows; texts of any
length are read whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import Columns, map_columns, words_of
from tributary.llm.components import components
from tributary.llm.simhash import block_links, blocks_of, keep_least, spanning_stars
from tributary.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
BITS = 2048
_SHARE = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
RADIUS = round(BITS * _SHARE + 6 * math.sqrt(BITS * _SHARE * (1 - _SHARE)))
KEYS = 16
LEAST = 4
#: Sets of more shingles have fingerprints and keys; sets of up to ``FEW_REACH``, all that 0.8 reaches from ``FEW``, are joined by prefixes.
FEW = 50
FEW_REACH = math.floor(FEW / SIMILARITY + 1e-9)
PIVOTS = 16
#: Shingles that are hashed and counted at a time.
COUNTED = 255 * 16
#: Shingles of the sets that one block compares, if no set is larger.
COMPARED = 1 << 21


def _draws(count: int, name: str) -> tuple[np.ndarray, np.ndarray]:
    """``count`` masks and odd factors that make as many hashes of one."""
    drawn = [xxhash.xxh64_intdigest(f"{name}{i}") for i in range(2 * count)]
    return np.array(drawn[:count], np.uint64)[:, None], np.array(drawn[count:], np.uint64)[:, None] | np.uint64(1)


_PLANES = _draws(BITS // 64, "plane")
_ORDERS = _draws(KEYS * LEAST, "order")


def _bits(hashes: np.ndarray) -> np.ndarray:
    """``BITS`` bits (0 or 1) of each shingle hash."""
    mixed = (hashes ^ _PLANES[0]) * _PLANES[1]
    mixed ^= mixed >> np.uint64(32)
    return np.unpackbits(np.ascontiguousarray(mixed.T).view(np.uint8), axis=1)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles of a text, sorted."""
    words = words_of(text, lower=True)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    each = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    return np.unique(np.fromiter(each, np.uint64, len(words) - shingle + 1))


def sketch(hashes: np.ndarray) -> tuple[bytes, list[int]]:
    """The fingerprint and the keys (signed longs) of a set of shingle hashes, which is not empty."""
    ones = np.zeros(BITS, np.int64)
    least = np.full(KEYS * LEAST, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), COUNTED):
        some = hashes[at:at + COUNTED]
        least = np.minimum(least, ((some ^ _ORDERS[0]) * _ORDERS[1]).min(axis=1))
        for part in range(0, len(some), 255):  # as many ones fit a byte
            ones += _bits(some[part:part + 255]).sum(axis=0, dtype=np.uint8)
    # a tie leaves the bit unset in either text: broken by a shingle, one edit could turn all ties at once
    keys = [xxhash.xxh64_intdigest(least[n * LEAST:(n + 1) * LEAST].tobytes(), n) for n in range(KEYS)]
    return np.packbits(ones * 2 > len(hashes)).tobytes(), np.array(keys, np.uint64).view(np.int64).tolist()


def _node(hashes: np.ndarray) -> bytes:
    return hashlib.md5(hashes.tobytes(), usedforsecurity=False).digest()


def node_of(text: str | None) -> bytes:
    """A short name for the class of a text: the MD5 digest of its sorted shingle hashes."""
    return _node(shingle_hashes(text))


def _links(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``left`` and ``right`` (rows of 64-bit words) whose fingerprints are within RADIUS."""
    pivots = left[np.linspace(0, len(left) - 1, min(PIVOTS, len(left))).astype(int)]
    table_l, table_r = (
        np.stack([np.bitwise_count(side ^ pivot).sum(axis=1, dtype=np.int16) for pivot in pivots], axis=1) for side in (left, right))
    found_l, found_r = [], []
    for row in range(len(left)):
        near = np.flatnonzero((np.abs(table_r - table_l[row]) <= RADIUS).all(axis=1))
        near = near[np.bitwise_count(right[near] ^ left[row]).sum(axis=1, dtype=np.int16) <= RADIUS]
        found_l.append(np.full(len(near), row))
        found_r.append(near)
    return np.concatenate(found_l), np.concatenate(found_r)


def _compare(parts: np.ndarray, nodes: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars of candidates among the classes of one block; ``parts``: 0 all with all, else 1 with 2 only."""
    wide = np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), -1)
    if parts[0] == 0:
        a, b = _links(wide, wide)
        a, b = a[a < b], b[a < b]
    else:
        first, second = np.flatnonzero(parts == 1), np.flatnonzero(parts == 2)
        if not len(first) or not len(second):
            return nodes[:0], nodes[:0]
        a, b = _links(wide[first], wide[second])
        a, b = first[a], second[b]
    moved, centre = spanning_stars(len(nodes), a, b)
    return nodes[moved], nodes[centre]


def _reach(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places, one of ``first`` and one of ``second``, whose sets have SIMILARITY; enough of them to span its components."""
    sizes = np.array(list(map(len, sets)))
    _, own = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [own[end - size:end] for end, size in zip(ends.tolist(), sizes.tolist())]
    held = np.zeros(int(ends[-1]), bool)
    label, found_a, found_b = np.arange(len(sets)), [], []
    for at in first.tolist():
        others = second[second > at] if first is second else second
        # sets that are linked already need no comparison, nor do those of too different sizes
        alike = np.minimum(sizes[others], sizes[at]) >= SIMILARITY * np.maximum(sizes[others], sizes[at]) - 1e-6
        others = others[alike & (label[others] != label[at])]
        if not len(others):
            continue
        held[own[at]] = True
        starts = np.r_[0, np.cumsum(sizes[others])[:-1]]
        common = np.add.reduceat(held[np.concatenate([own[i] for i in others.tolist()])], starts, dtype=np.int64)
        held[own[at]] = False
        near = others[common / (sizes[others] + sizes[at] - common) >= SIMILARITY]
        if len(near):
            found_a.append(np.full(len(near), at))
            found_b.append(near)
            label[np.isin(label, label[near])] = label[at]
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


def _compare_sets(parts: np.ndarray, nodes: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars among the classes of one block by the exact similarity of their sets; ``parts`` as in :func:`_compare`."""
    first = second = np.arange(len(nodes))
    if parts[0] != 0:
        first, second = np.flatnonzero(parts == 1), np.flatnonzero(parts == 2)
        if not len(first) or not len(second):
            return nodes[:0], nodes[:0]
    moved, centre = spanning_stars(len(nodes), *_reach([np.frombuffer(x, np.uint64) for x in packed], first, second))
    return nodes[moved], nodes[centre]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, node and size (distinct shingles) of every row; few (packed set), and print and keys (packed 64-bit words), where its size asks for them."""

    def start():
        def step(batch: Columns) -> Columns:
            sets = [shingle_hashes(text) for text in batch["text"]]
            found = [sketch(x) if len(x) > FEW else (None, None) for x in sets]
            return {
                "doc_id": batch["doc_id"], "node": [_node(x) for x in sets], "size": [len(x) for x in sets],
                "few": [x.tobytes() if 0 < len(x) <= FEW_REACH else None for x in sets], "print": [p for p, _ in found],
                "keys": [None if keys is None else np.array(keys, np.int64).astype(">i8").tobytes() for _, keys in found],
            }

        return step

    return map_columns(
        docs.select("doc_id", "text"),
        {"doc_id": "long", "node": "binary", "size": "int", "few": "binary", "print": "binary", "keys": "binary"}, start)


def _in_blocks(blocks: DataFrame, name: str, compare) -> DataFrame:
    """Stars (a, b) of ``blocks`` (key, block, part, node and the column ``name``)."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return block_links(batches, compare, pa.binary())

    return (
        blocks.repartition("key", "block").sortWithinPartitions("key", "block", "node")
        .select("key", "block", "part", "node", name).mapInArrow(compared, "a binary, b binary")
    )


def few_links(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of small sets whose components are those of all links; ``classes``: node, size, few."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column("few").to_pylist()
            sizes = np.array([len(x) // 8 for x in packed], np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("node").take(pa.array(np.repeat(np.arange(len(packed)), sizes))), pa.array(np.repeat(sizes, sizes), pa.int64()),
                pa.array(np.frombuffer(b"".join(packed), np.int64))], names=["node", "size", "key"])

    # sets of three shingles or fewer reach 0.8 with equal sets only
    few = classes.filter("few is not null and size > 3").select("node", "size", "few")
    shingles = few.select("node", "few").mapInArrow(each, "node binary, size long, key long")
    shared = shingles.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    own = shingles.join(shared, "key").groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("held"))
    prefix = F.col("size") - F.ceil(F.col("size") * SIMILARITY - 1e-6) + 1
    # the rarest come first: those that no other class has take their places of the prefix, the others what is left
    left = (prefix - (F.col("size") - F.size("held"))).cast("int")
    keyed = own.withColumn("left", left).filter("left > 0").select("node", F.explode(F.slice("held", F.lit(1), F.col("left"))).alias("x")).select("x.key", "node")
    return _in_blocks(blocks_of(cut_lineage(keyed), "node").join(few.select("node", "few"), "node"), "few", _compare_sets)


def candidate_links(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose components hold those of all links of large sets that meet; ``classes``: node, print, keys."""
    number = F.sequence(F.lit(0), F.lit(KEYS - 1))
    keyed = classes.filter("keys is not null").select("node", F.explode(F.transform(number, lambda n: F.conv(
        F.hex(F.substring("keys", n * 8 + 1, F.lit(8))), 16, -10).cast("long"))).alias("key"))
    return _in_blocks(blocks_of(keyed, "node").join(classes.select("node", "print"), "node"), "print", _compare)


def verified_links(docs: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose components are those of all links inside the components ``found`` of candidates."""
    # components lists the nodes that move; their roots are members too
    members = cut_lineage(found.unionByName(found.select(F.col("root").alias("node"), "root")).distinct()
                          .join(classes.select("node", "least", "size"), "node"))
    wanted = members.select("least").distinct()

    def start():
        def step(batch: Columns) -> Columns:
            sets = [shingle_hashes(text) for text in batch["text"]]
            return {"node": [_node(x) for x in sets], "set": [x.tobytes() for x in sets]}

        return step

    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("least")), "left_semi").select("text")
    sets = map_columns(texts, {"node": "binary", "set": "binary"}, start).join(members.select("node"), "node", "left_semi").dropDuplicates(["node"])
    keyed = members.select(F.xxhash64("root").alias("key"), "node", "size")
    return _in_blocks(blocks_of(keyed, "node", ("size", COMPARED)).join(sets, "node"), "set", _compare_sets)


def similar_texts(docs: DataFrame) -> DataFrame:
    """doc_id, ``node`` and ``component_id`` (the least id that links reach) of every row."""
    rows = cut_lineage(sketches(docs))
    classes = cut_lineage(rows.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("size", "few", "print", "keys"))))
    near = verified_links(docs, classes, components(candidate_links(classes)))
    found = components(few_links(classes).unionByName(near))
    roots = classes.select(F.col("node").alias("own"), "least").join(found, F.col("own") == F.col("node"), "left").select(
        "own", "least", F.coalesce("root", "own").alias("root"))
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    members = roots.join(named, "root").select(F.col("own").alias("node"), "component_id")
    return rows.select("doc_id", "node").join(members, "node").select("doc_id", "node", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but for near copies: of each component the row with the least id stays.

    Of rows that repeat an id inside a component one stays; rows without an id, which nothing names, all stay.
    """
    return keep_least(docs, similar_texts(docs), "node", node_of, pa.binary())
