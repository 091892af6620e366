"""SimHash near duplicates found through pivot distance tables.

A fingerprint has 64 bits; two fingerprints link when they differ in at most ``RADIUS`` bits.  Distances to
reference fingerprints (pivots) are 1-Lipschitz: two fingerprints at distance r differ by at most r in every
coordinate.  Two sorts of pivots use this:

* *Band pivots* are compared inside one band of bits only.  Of ``BANDS`` bands, at least ``BANDS - RADIUS`` hold
  no differing bit, so there all coordinates agree.  The coordinates of every choice of that many bands form
  an equi-join key: a pair that links meets in at least one table.
* *Whole pivots* are compared in all bits.  Of pairs that meet, those with a coordinate that differs by more
  than ``RADIUS`` are discarded; the survivors are verified by their exact distance.

Equal fingerprints are one class from the start.  Classes that meet in a table are compared in blocks of bounded
size and leave a spanning star, not all their pairs; components follow from these by joins.

A null or empty text has fingerprint zero and links like any other.  Rows with a null id take part in links
but never name a component, unless no row of it has an id (component null).  Repeated rows are returned each; an empty table gives no rows.
Texts of any length are read whole.  Extra columns are ignored.  Of rows that tie for the least id any names the component, as its name is that id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.common import Columns, give_back, map_columns, words_of
from tributary.llm.components import components
from tributary.llm.registry import query, table
from tributary.session import cut_lineage

SHINGLE = 3
RADIUS = 3
BANDS = 6
SEED = 42
#: References for each band, and references compared as a whole.
BAND_PIVOTS = 12
WHOLE_PIVOTS = 16
#: Classes of one table key that are compared in one block; longer lists are cut into pairs of blocks.
BLOCK = 2048
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if over half of the shingle hashes (repeats included) have it."""
    words = words_of(text, lower=True)
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    hash64, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(shingles), COUNTED):
        some = shingles[at:at + COUNTED]
        hashes = np.fromiter((hash64(s, SEED) for s in some), np.dtype("<u8"), len(some))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles), bitorder="little").view("<u8")[0])


def _bands() -> list[int]:
    edges = [round(i * 64 / BANDS) for i in range(BANDS + 1)]
    return [((1 << high) - 1) ^ ((1 << low) - 1) for low, high in zip(edges, edges[1:])]


def _references(count: int, name: str) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{name}{i}") for i in range(count)], np.uint64)


WHOLE = _references(WHOLE_PIVOTS, "whole")


def band_keys(prints: np.ndarray) -> Iterator[np.ndarray]:
    """For each choice of BANDS - RADIUS bands, one 64-bit key of the fingerprints' coordinates there."""
    references = _references(BAND_PIVOTS, "band")
    coded = []
    for mask in _bands():
        code = np.zeros(len(prints), np.uint64)
        for reference in references:  # distances of 0 to 11 in base 16
            code = code * np.uint64(16) + np.bitwise_count((prints ^ reference) & np.uint64(mask)).astype(np.uint64)
        coded.append(code)
    for number, chosen in enumerate(combinations(range(BANDS), BANDS - RADIUS)):
        key = np.full(len(prints), number + 1, np.uint64)
        for band in chosen:
            key = (key ^ coded[band]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        yield key


def _links(left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``left`` and ``right`` whose fingerprints link; ``same``: of one list, each pair once."""
    table_l = np.bitwise_count(left[:, None] ^ WHOLE).astype(np.int8)
    table_r = np.bitwise_count(right[:, None] ^ WHOLE).astype(np.int8)
    found_l, found_r = [], []
    for at in range(0, len(left), 256):
        near = np.ones((len(left[at:at + 256]), len(right)), bool)
        for p in range(WHOLE_PIVOTS):
            near &= np.abs(table_l[at:at + 256, p, None] - table_r[None, :, p]) <= RADIUS
        a, b = np.nonzero(near)
        a += at
        ok = np.bitwise_count(left[a] ^ right[b]) <= RADIUS
        if same:
            ok &= a < b
        found_l.append(a[ok])
        found_r.append(b[ok])
    return np.concatenate(found_l), np.concatenate(found_r)


def spanning_stars(size: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links between places a and b of ``size``, each linked place and the one that stands for its component."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = np.flatnonzero(label != np.arange(size))
    return moved, label[moved]


def _stars(prints: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links between places a and b, each linked fingerprint with one that stands for its component."""
    moved, centre = spanning_stars(len(prints), a, b)
    return prints[moved], prints[centre]


def _compare(parts: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars among the classes of one block; ``parts``: 0 all with all, else 1 with 2 only."""
    if len(prints) == 2:  # by far the most usual block
        linked = parts[0] in (0, 3 - parts[1]) and _near(prints) and np.bitwise_count(prints[0] ^ prints[1]) <= RADIUS
        return (prints[:1], prints[1:]) if linked else (prints[:0], prints[:0])
    if parts[0] == 0:
        return _stars(prints, *_links(prints, prints, True))
    first, second = np.flatnonzero(parts == 1), np.flatnonzero(parts == 2)
    a, b = _links(prints[first], prints[second], False)
    return _stars(prints, first[a], second[b])


def _near(pair: np.ndarray) -> bool:
    """The coordinates of two fingerprints differ by at most RADIUS each."""
    far = np.bitwise_count(pair[:, None] ^ WHOLE[None, :]).astype(np.int8)
    return bool((np.abs(far[0] - far[1]) <= RADIUS).all())


def _compare_rows(part: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = _compare(part, prints.view(np.uint64))
    return a.view(np.int64), b.view(np.int64)


def block_links(batches: Iterator[pa.RecordBatch], compare: Callable[..., tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Stars (a, b) of each block: ``compare`` of its columns after key and block.

    Rows arrive sorted by key and block, so a block may reach over batches.
    """
    rest = pd.DataFrame()

    def stars(rows: pd.DataFrame) -> pa.RecordBatch:
        keys, blocks = rows["key"].to_numpy(), rows["block"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1])])
        others = [rows[name].to_numpy() for name in rows.columns[2:]]
        found = [compare(*(x[s:e] for x in others)) for s, e in zip(starts, np.r_[starts[1:], len(rows)]) if e - s > 1]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(side) if found else [], kind) for side in (list(zip(*found)) or [(), ()])], names=["a", "b"])

    for batch in batches:
        rows = pd.concat([rest, batch.to_pandas()], ignore_index=True)
        if not len(rows):
            continue
        last = rows.iloc[-1]
        ends = ((rows["key"] == last["key"]) & (rows["block"] == last["block"])).to_numpy()
        rest = rows[ends]
        if not ends.all():
            yield stars(rows[~ends].reset_index(drop=True))
        del batch, rows
        give_back()
    if len(rest):
        yield stars(rest.reset_index(drop=True))


def blocks_of(rows: DataFrame, name: str, weight: tuple[str, int] | None = None) -> DataFrame:
    """``rows`` (key and the column ``name``) of keys that meet, with the blocks and parts in which they are compared.

    ``weight``: a column and the sum of it that one part may have on average, beside the number of rows.
    """
    heavy = F.ceil(F.sum(weight[0]) / weight[1]) if weight else F.lit(1).cast("long")
    meeting = rows.groupBy("key").agg(F.count("*").alias("n"), heavy.alias("heavy")).filter("n > 1")
    cuts = F.greatest(F.ceil(F.col("n") / BLOCK), "heavy")
    part = F.pmod(F.xxhash64(name), F.col("cuts"))
    many = F.transform(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1), lambda other: F.struct(
        (F.least("own", other) * F.col("cuts") + F.greatest("own", other)).alias("block"),
        F.when(F.col("own") == other, 0).when(F.col("own") < other, 1).otherwise(2).alias("part")))
    return (
        rows.join(meeting.select("key", cuts.alias("cuts")), "key")
        .withColumn("own", part)
        .select("key", name, F.explode(many).alias("x"))
        .select("key", F.col("x.block").alias("block"), F.col("x.part").alias("part"), name)
    )


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints, column ``print``, whose components are those of all links."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("print").to_numpy()
            for key in band_keys(values.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(values)], names=["key", "print"])

    blocks = blocks_of(prints.mapInArrow(keyed, "key long, print long"), "print")
    return (
        blocks.repartition("key", "block").sortWithinPartitions("key", "block", "print")
        .mapInArrow(lambda batches: block_links(batches, _compare_rows, pa.int64()), "a long, b long")
    )


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint (as a signed long) of every row."""

    def start():
        def step(batch: Columns) -> Columns:
            prints = np.array([fingerprint(text, shingle) for text in batch["text"]], np.uint64).view(np.int64)
            return {"doc_id": batch["doc_id"], "print": prints.tolist()}

        return step

    return map_columns(docs.select("doc_id", "text"), {"doc_id": "long", "print": "long"}, start)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, ``print`` and ``component_id`` (the least id that links reach) of every row."""
    rows = cut_lineage(fingerprints(docs, shingle))
    classes = rows.groupBy("print").agg(F.min("doc_id").alias("least"))
    found = components(links(classes.select("print")))
    roots = classes.join(found, F.col("print") == F.col("node"), "left").select(
        "print", "least", F.coalesce("root", "print").alias("root"))
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    members = cut_lineage(roots.join(named, "root").select("print", "component_id"))
    return rows.join(members, "print").select("doc_id", "print", "component_id")


def _one_of_each(docs: DataFrame, own: DataFrame, name: str, class_of: Callable, kind: pa.DataType) -> DataFrame:
    """One row of ``docs`` for each (id, component) of ``own``, found by id and class."""

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([class_of(text) for text in batch.column("text").to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([found, *batch.columns], names=["__class", *batch.schema.names])

    schema = T.StructType([T.StructField("__class", own.schema[name].dataType), *docs.schema.fields])
    found = own.select(F.col("doc_id").alias("__id"), F.col(name).alias("__found"), F.col("component_id").alias("__root"))
    rows = docs.mapInArrow(printed, schema)
    return (
        rows.join(found, (F.col("doc_id") == F.col("__id")) & (F.col("__class") == F.col("__found")))
        .dropDuplicates(["__id", "__root"]).select(docs.columns)
    )


def keep_least(docs: DataFrame, marked: DataFrame, name: str, class_of: Callable, kind: pa.DataType) -> DataFrame:
    """Of each component of ``marked`` (doc_id, class ``name``, component_id) the row of ``docs`` with the least id.

    ``class_of`` gives the class of a text.  Of rows that repeat an id inside a component one stays; rows without
    an id, which nothing names, all stay.
    """
    marked = cut_lineage(marked)
    own = marked.filter("doc_id = component_id").select("doc_id", name, "component_id").distinct()
    kept = own.select("doc_id").distinct()
    unnamed = docs.filter("doc_id is null")
    repeated = marked.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return docs.join(kept, "doc_id", "left_semi").select(docs.columns).unionByName(unnamed)
    # an id may stand for several texts: those rows are told apart by their classes
    once = docs.join(repeated, "doc_id", "left_anti").join(kept, "doc_id", "left_semi").select(docs.columns)
    often = docs.join(repeated, "doc_id", "left_semi").select(docs.columns)
    return once.unionByName(_one_of_each(often, own, name, class_of, kind)).unionByName(unnamed)


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` but for near duplicates: of each component the row with the least id stays."""
    return keep_least(docs, near_duplicates(docs, shingle), "print",
                      lambda text: int(np.uint64(fingerprint(text, shingle)).astype(np.int64)), pa.int64())


@query("op5_simhash_near_duplicates")
def op5(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
