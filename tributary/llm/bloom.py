"""A Bloom filter of quantised counts (a log-frequency filter), built by Spark and held by every task.

A code of level q is inserted under q keys (code, 1) to (code, q).  A reader probes levels 1, 2, ... until one is
missing; the last hit is the level.  Errors are one-sided: a level is never too low.

Codes are dealt to shares by their high bits, and a share fills blocks of its own, as many as its keys ask for; all bits of a
code lie in one block.  So whoever gathers a share's codes can fill its part of the filter at once, and nothing but
finished blocks is written.  The filter grows with its keys.  Up to ``HELD_BYTES`` it is sent to every machine, in files of ``SHARD_BYTES``,
which all tasks of a machine map: so they share one copy in its file cache, and none holds it; nothing passes through the driver.
Beyond it nothing is sent: readers deal their distinct codes to
the shares and get the levels back (:func:`probe_shares`), so that what is read grows with the codes, not with codes times filter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.session import opened, scratch_path

BLOCK_BITS = 1 << 19
BITS_PER_KEY = 12
PROBES = 4
#: Bytes of one file of a filter, in whole blocks, and of a filter that tasks map.
SHARD_BYTES = 1 << 25
HELD_BYTES = 1 << 32
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mixed(codes: np.ndarray) -> np.ndarray:
    """A 64-bit mix in which every input bit reaches every output bit."""
    codes = (codes ^ (codes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    codes = (codes ^ (codes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return codes ^ (codes >> np.uint64(31))


def _keys(codes: np.ndarray, level: int) -> np.ndarray:
    return mixed(codes + np.uint64(level * 0x9E3779B97F4A7C15 & 2**64 - 1))


def share_of(codes: np.ndarray, shares: int) -> np.ndarray:
    """The share of each code, by the high bits of its mix."""
    return (((mixed(codes) >> np.uint64(32)) * np.uint64(shares)) >> np.uint64(32)).astype(np.int64)


def _block(codes: np.ndarray, blocks) -> np.ndarray:
    """The block of each code among those of its share, by the low bits of its mix."""
    return (((mixed(codes) & np.uint64(0xFFFFFFFF)) * np.asarray(blocks, np.uint64)) >> np.uint64(32)).astype(np.int64)


def cut_by_share(codes: np.ndarray, shares: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The codes' order by share (equal ones keep theirs), and (share, first, end) of each share in it."""
    owner = share_of(codes, shares)
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    starts = np.flatnonzero(np.r_[len(owner) > 0, owner[1:] != owner[:-1]])
    return order, list(zip(owner[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(owner)]))


def _spot(keys: np.ndarray, probe: int) -> np.ndarray:
    return (keys * _ODD[probe]) >> np.uint64(45)


def filled(codes: np.ndarray, levels: np.ndarray, bits_per_key: int) -> np.ndarray:
    """The blocks of a share that holds these codes, a row of bytes each."""
    blocks = max(1, -(-int(levels.sum()) * bits_per_key // BLOCK_BITS))
    bits = np.zeros(blocks * BLOCK_BITS, np.uint8)
    level = 0
    while len(codes):
        level += 1
        first = _block(codes, blocks) * BLOCK_BITS
        keys = _keys(codes, level)
        for probe in range(PROBES):
            bits[first + _spot(keys, probe).astype(np.int64)] = 1
        codes, levels = codes[levels > level], levels[levels > level]
    return np.packbits(bits, bitorder="little").reshape(blocks, -1)


def block_rows(share: int, bits: np.ndarray) -> dict:
    """Columns ``share``, ``block`` and ``bits`` of a share's blocks."""
    return {"share": pa.array([share] * len(bits), pa.int32()), "block": pa.array(range(len(bits)), pa.int32()), "bits": pa.array([row.tobytes() for row in bits], pa.binary())}


def _probe(bits: list[np.ndarray], shard: np.ndarray, row: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Levels of codes whose blocks are these rows of these shards."""
    out = np.zeros(len(codes), np.int64)
    for number, part in enumerate(bits):
        alive = np.flatnonzero(shard == number) if len(bits) > 1 else np.arange(len(codes))
        level = 0
        while len(alive):
            level += 1
            keys = _keys(codes[alive], level)
            for probe in range(PROBES):
                spots = _spot(keys, probe)
                hit = part[row[alive], spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8) & 1 == 1
                alive, keys = alive[hit], keys[hit]
            out[alive] = level
    return out


@lru_cache(maxsize=64)
def _mapped(name: str, rows: int) -> np.ndarray:
    return np.memmap(SparkFiles.get(name), np.uint8, "r", shape=(rows, BLOCK_BITS // 8))


@dataclass
class Shard:
    """Some blocks, in a file that every machine gets once."""

    name: str
    rows: int
    most_rows: int

    @property
    def value(self) -> np.ndarray:
        return _mapped(self.name, self.rows)


class LevelFilter:
    """The finished filter: ``table`` has its blocks; up to ``HELD_BYTES`` tasks map them too, and ``levels`` probes them."""

    def __init__(self, shares: int, blocks: np.ndarray, table: DataFrame | None, place: np.ndarray, shards: list[Shard]):
        self.shares, self.blocks, self.table, self.place, self.shards = shares, blocks, table, place, shards

    @property
    def held(self) -> bool:
        return bool(self.shards) or not self.blocks.sum()

    def for_tasks(self) -> LevelFilter:
        return LevelFilter(self.shares, self.blocks, None, self.place, self.shards)

    def levels(self, codes: np.ndarray) -> np.ndarray:
        if not self.shards or not len(codes):
            return np.zeros(len(codes), np.int64)
        share = share_of(codes, self.shares)
        own = self.blocks[share]
        place = self.place[(np.cumsum(self.blocks) - self.blocks)[share] + np.minimum(_block(codes, own), np.maximum(0, own - 1))]
        rows = self.shards[0].most_rows
        return np.where(own > 0, _probe([np.asarray(s.value) for s in self.shards], place // rows, place % rows, codes), 0)


def finished(table: DataFrame, shares: int) -> LevelFilter:
    """The filter of written blocks (share, block, bits); sent to the tasks if its size, which is counted first, allows it."""
    sizes = table.groupBy("share").agg(F.count("*").alias("n")).collect()  # a row for each share
    blocks = np.zeros(shares, np.int64)
    for row in sizes:
        blocks[row["share"]] = row["n"]
    total = int(blocks.sum())
    if not total or total * BLOCK_BITS // 8 > HELD_BYTES:
        return LevelFilter(shares, blocks, table, np.zeros(0, np.int64), [])
    rows = max(1, min(total, SHARD_BYTES * 8 // BLOCK_BITS))
    spark, folder = table.sparkSession, scratch_path(table.sparkSession, "filter-shards")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = opened(folder)
        system.create_dir(at)
        file, written = None, rows
        for batch in batches:
            names, spots = [], []
            for bits in batch.column("bits"):
                if written == rows:
                    if file:
                        file.close()
                    name, written = f"filter-{uuid.uuid4().hex}", 0
                    file = system.open_output_stream(f"{at}/{name}")
                file.write(bits.as_buffer())
                names.append(name)
                spots.append(written)
                written += 1
            yield pa.RecordBatch.from_arrays([batch.column("share"), batch.column("block"), pa.array(names, pa.string()), pa.array(spots, pa.int32())], names=["share", "block", "name", "spot"])
        if file:
            file.close()

    # the blocks stay with the tasks; the driver learns where each one lies
    first, place = np.cumsum(blocks) - blocks, np.zeros(total, np.int64)
    where = table.select("share", "block", "bits").mapInArrow(write, "share int, block int, name string, spot int").toArrow()
    share, block, spot = (where.column(c).to_numpy() for c in ("share", "block", "spot"))
    names, shard = np.unique(where.column("name").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    place[first[share] + block] = shard * rows + spot
    for name in names.tolist():
        spark.sparkContext.addFile(f"{folder}/{name}")
    return LevelFilter(shares, blocks, table, place, [Shard(name, int(n), rows) for name, n in zip(names.tolist(), np.bincount(shard))])


def build(levels: DataFrame, keys: int, shares: int = 16) -> LevelFilter:
    """The filter of rows (code long, level int)."""
    bits_per_key = BITS_PER_KEY

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, top = batch.column("code").to_numpy().view(np.uint64), batch.column("level").to_numpy()
            order, cuts = cut_by_share(codes, shares)
            yield pa.RecordBatch.from_arrays([
                pa.array([share for share, _, _ in cuts], pa.int32()), pa.array([codes[order[s:e]].tobytes() for _, s, e in cuts], pa.binary()),
                pa.array([top[order[s:e]].astype(np.int32).tobytes() for _, s, e in cuts], pa.binary())], names=["share", "codes", "levels"])

    def fill(key: tuple, group: pa.Table) -> pa.Table:
        codes, levels = (np.concatenate([np.frombuffer(x, kind) for x in group.column(c).to_pylist()]) for c, kind in (("codes", np.uint64), ("levels", np.int32)))
        return pa.table(block_rows(key[0].as_py(), filled(codes, levels, bits_per_key)))

    if not keys:
        return LevelFilter(shares, np.zeros(shares, np.int64), None, np.zeros(0, np.int64), [])
    path = scratch_path(levels.sparkSession, "filter")
    rows = levels.select("code", "level").mapInArrow(spread, "share int, codes binary, levels binary")
    rows.groupBy("share").applyInArrow(fill, "share int, block int, bits binary").write.parquet(path)
    return finished(levels.sparkSession.read.parquet(path), shares)


def probe_shares(cells: DataFrame, found: LevelFilter) -> DataFrame:
    """``reader``, ``share`` and ``levels`` (a byte each) of cells (reader long, share int, codes binary): codes meet their share's blocks."""

    def probe(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(zip(right.column("block").to_pylist(), right.column("bits").to_pylist()))
        bits = np.stack([np.frombuffer(b, np.uint8) for _, b in rows]) if rows else None
        out = []
        for data in left.column("codes").to_pylist():
            codes = np.frombuffer(data, np.uint64)
            levels = np.zeros(len(codes), np.int64) if bits is None else _probe([bits], None, _block(codes, len(rows)), codes)
            out.append(levels.astype(np.uint8).tobytes())
        return pa.table({"reader": left.column("reader"), "share": left.column("share"), "levels": pa.array(out, pa.binary())})

    return cells.groupBy("share").cogroup(found.table.groupBy("share")).applyInArrow(probe, "reader long, share int, levels binary")
