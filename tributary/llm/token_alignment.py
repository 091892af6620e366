"""Alignment of two tokenizers by products of token-byte incidence matrices.

A text is cut into chunks at spaces that no token of either tokenizer crosses, so every chunk is aligned on its own and
equal chunks once.  For the distinct new chunks of a batch, ``A`` and ``B`` are the incidence matrices of token
occurrences (rows) and bytes (columns) in compressed sparse rows.  The row products of ``A`` and ``B`` transposed count the
bytes that two occurrences share (overlap links); those that end at the same byte are the end links.  Byte offsets
where both tokenizers end a token cut the occurrences into groups; the products of the group incidences
are the shared-group links.

Token A bytes are its entry decoded from the byte-level alphabet, token B bytes its piece with U+2581 as space and ``<0xHH>``
as a byte.  A is encoded with a space before the text, B adds one itself.  A text that is null or empty, or whose A or
B bytes differ from the space and the text, has no tokens.  Strings of special tokens are plain text.

Texts are tokenised once: blocks of texts are written with their distinct chunks' end links, link counts of id
pairs are summed over the blocks, and the blocks are read again to look the counts up.  Pairs with a share of at least
1 / HELD_PAIRS of all links (at most HELD_PAIRS) are held by every task; the others meet their counts by a join.

Repeated rows and null ids are aligned each; extra columns are ignored; an empty table gives no rows.  Very long texts and
words are taken whole: products are built some rows at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import slices
from tributary.llm.registry import query, table
from tributary.session import scratch_path

HELD_PAIRS = 1_000_000
#: Chunks, and links of them, that a task remembers; characters from which a chunk is aligned by itself; chunks encoded as one text.
CACHED_CHUNKS = 600_000
CACHED_LINKS = 8_000_000
LONG = 1000
RUN = 200
#: Chunks of texts in a block.
BLOCK_CHUNKS = 1_000_000
#: Entries of a product that are expanded at a time.
PRODUCT_ENTRIES = 2_000_000
#: Spaces between one of these signs and a further sign are where chunks part: no sign of the class is white space to a tokenizer.
_CUT = re.compile(r"(?<=[\w!-~])(?= +[^ ])")
_WHOLE_END = re.compile(r"[\w!-~]")
_ODD_SPACE = re.compile(r"[^\w!-~] ")


class Csr:
    """A sparse 0/1 matrix: the columns of row i are ``columns[starts[i]:starts[i + 1]]``."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, width: int):
        self.starts, self.columns, self.width = starts, columns, width

    @classmethod
    def of_ranges(cls, sizes: np.ndarray, width: int) -> Csr:
        """Rows that follow each other over the columns, each ``sizes[i]`` wide: tokens over the bytes they cover."""
        return cls(np.r_[0, np.cumsum(sizes)].astype(np.int64), np.arange(int(sizes.sum()), dtype=np.int64), width)

    @classmethod
    def of_places(cls, places: np.ndarray, width: int) -> Csr:
        """Rows with one column each."""
        return cls(np.arange(len(places) + 1, dtype=np.int64), places.astype(np.int64), width)

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(len(self.starts) - 1, dtype=np.int64), np.diff(self.starts))
        order = np.argsort(self.columns, kind="stable")
        return Csr(np.r_[0, np.cumsum(np.bincount(self.columns, minlength=self.width))].astype(np.int64), rows[order], len(self.starts) - 1)


def products(left: Csr, right: Csr, entries: int = PRODUCT_ENTRIES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Gustavson's product of two sparse matrices as (row, column, value), some rows at a time.

    Row i of the product is the sum of the rows of ``right`` that row i of ``left`` names; about ``entries`` terms are
    expanded at a time, more only if a single row has more.
    """
    sizes = np.diff(right.starts)[left.columns]  # terms that each entry of left expands to
    before = np.r_[0, np.cumsum(sizes)]
    terms = before[left.starts]
    row, rows = 0, len(left.starts) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(terms, terms[row] + entries, "right")) - 1)
        part = slice(left.starts[row], left.starts[end])
        size, named = sizes[part], left.columns[part]
        owner = np.repeat(np.repeat(np.arange(row, end), np.diff(left.starts[row:end + 1])), size)
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        column = right.columns[np.repeat(right.starts[named], size) + within]
        cell, value = np.unique(owner * right.width + column, return_counts=True)
        if right.width:
            yield cell // right.width, cell % right.width, value
        row = end


def byte_alphabet() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones stand for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers and the chunks that were aligned so far; every chunk has an index until the cache is emptied."""

    def __init__(self, file_a: str, file_b: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        signs = byte_alphabet()
        entries = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(signs[s] for s in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array(list(map(len, entries)), np.int64) for entries in (self.bytes_a, self.bytes_b))
        self.text_a = np.array([f"{i}{end}" for end in ",|" for i in range(len(self.bytes_a))], object)
        self.text_b = np.array([f"{i}{end}" for end in ",;" for i in range(len(self.bytes_b))], object)
        # only where no piece holds a space after another sign may a text be cut before its spaces
        self.separable = not any("▁" in piece.lstrip("▁") for piece in pieces)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.counts = np.zeros((0, 3), np.int64)  # tokens of A and B and groups of each chunk; -1: bytes differ
        self.groups: list[str] = []  # ``a1,a2|b1;`` of each chunk
        self.links = np.zeros(0, np.int64)  # end links of each chunk, and all of them as id of A << 32 | id of B
        self.codes: list[np.ndarray] = []

    def full(self) -> bool:
        return len(self.index) > CACHED_CHUNKS or sum(map(len, self.codes)) > CACHED_LINKS

    def chunks(self, text: str) -> list[str]:
        """The space and the text, cut where no token crosses."""
        whole = " " + text
        if not self.separable:
            return [whole]
        if whole.startswith("  ") or whole.endswith(" ") or _ODD_SPACE.search(text):
            return _CUT.split(whole)
        return [" " + part for part in text.split(" ")]

    def encoded(self, runs: list[list[str]]) -> Iterator[tuple[list[str], list[int], list[int], bool]]:
        """Each run of chunks as one text: its ids, and whether the bytes are the text's; runs that differ are taken apart."""
        texts = list(map("".join, runs))
        ids_b = self.b.encode([text[1:] for text in texts], num_threads=1)
        apart = []
        for run, text, a, b in zip(runs, texts, self.a.encode_batch(texts, add_special_tokens=False), ids_b):
            a = a.ids
            good = b"".join(map(self.bytes_a.__getitem__, a)) == text.encode() == b"".join(map(self.bytes_b.__getitem__, b))
            if good or len(run) == 1:
                yield run, a, b, good
            else:
                apart += [[chunk] for chunk in run]
        if apart:
            yield from self.encoded(apart)

    def learn(self, chunks: list[str]) -> None:
        """Align chunks that have no index yet."""
        # chunks whose end and beginning keep tokens apart are encoded together
        open_ended = [chunk for chunk in chunks if not self.separable or len(chunk) > LONG or not _WHOLE_END.match(chunk[-1])]
        rest = list(set(chunks).difference(open_ended))
        runs = [rest[at:at + RUN] for at in range(0, len(rest), RUN)] + [[chunk] for chunk in open_ended]
        good: list[tuple] = []
        bad: list[str] = []
        for run, a, b, ok in self.encoded(runs):
            if ok:
                good.append((run, a, b))
            else:
                bad += run
        kept = [chunk for run, _, _ in good for chunk in run]
        for chunk in (*kept, *bad):
            self.index[chunk] = len(self.index)
        if kept:
            aligned = Alignment(self, [i for _, a, _ in good for i in a], [i for _, _, b in good for i in b])
            aligned.cut(np.cumsum([len(chunk.encode()) for chunk in kept]))
            links, cuts = aligned.end_links()
            self.codes.append((aligned.a[links[:, 0]] << 32) | aligned.b[links[:, 1]])
            self.links = np.r_[self.links, np.diff(np.searchsorted(links[:, 0], aligned.starts_a))]
            n_groups = np.diff(np.searchsorted(cuts, aligned.chunk_ends, "right"), prepend=0)
            self.counts = np.concatenate([self.counts, np.column_stack([np.diff(aligned.starts_a), np.diff(aligned.starts_b), n_groups])])
            self.groups += aligned.groups(cuts)
        self.links = np.r_[self.links, np.zeros(len(bad), np.int64)]
        self.counts = np.concatenate([self.counts, np.full((len(bad), 3), -1, np.int64)])
        self.groups += [""] * len(bad)

    def links_of(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many end links each of these chunks has, and their id pairs."""
        self.codes = [np.concatenate([np.zeros(0, np.int64), *self.codes])]
        sizes, starts = self.links[chunks], (np.cumsum(self.links) - self.links)[chunks]
        return sizes, self.codes[0][np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]


class Alignment:
    """Token occurrences of A and B over the same bytes."""

    def __init__(self, aligner: Aligner, ids_a: list[int], ids_b: list[int]):
        self.aligner = aligner
        self.a, self.b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        size_a, size_b = aligner.size_a[self.a], aligner.size_b[self.b]
        self.ends_a, self.ends_b = np.cumsum(size_a), np.cumsum(size_b)
        self.width = int(size_a.sum())
        self.matrix_a, self.matrix_b = Csr.of_ranges(size_a, self.width), Csr.of_ranges(size_b, self.width)
        self.cut(np.array([self.width]))

    def cut(self, chunk_ends: np.ndarray) -> None:
        """Tell where chunks end; a token that crosses such an end is an error."""
        self.chunk_ends = chunk_ends
        self.starts_a, self.starts_b = (np.r_[0, np.searchsorted(ends, chunk_ends, "right")] for ends in (self.ends_a, self.ends_b))
        if any((ends[starts[1:] - 1] != chunk_ends).any() for ends, starts in ((self.ends_a, self.starts_a), (self.ends_b, self.starts_b))):
            raise ValueError("a token crosses the end of a chunk")

    def overlap_links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Occurrences of A and of B that share bytes, and how many."""
        return products(self.matrix_a, self.matrix_b.transposed())

    def end_links(self) -> tuple[np.ndarray, np.ndarray]:
        """Overlap links whose tokens end together, as rows (occurrence of A, of B); and where they end."""
        found = [np.zeros((0, 2), np.int64)]
        for a, b, _ in self.overlap_links():
            together = self.ends_a[a] == self.ends_b[b]
            found.append(np.column_stack([a[together], b[together]]))
        links = np.concatenate(found)
        return links, self.ends_a[links[:, 0]]

    def group_links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Occurrences of A and of B in one group."""
        _, cuts = self.end_links()
        group_a, group_b = (Csr.of_places(np.searchsorted(cuts, ends), len(cuts)) for ends in (self.ends_a, self.ends_b))
        return products(group_a, group_b.transposed())

    def groups(self, cuts: np.ndarray) -> list[str]:
        """The groups' ids, ``a1,a2|b1;``, by chunk: ids of A, then of B, group by group, each with the sign after it."""
        group_a, group_b = np.searchsorted(cuts, self.ends_a), np.searchsorted(cuts, self.ends_b)
        last_a, last_b = cuts[group_a] == self.ends_a, cuts[group_b] == self.ends_b
        order = np.argsort(np.r_[2 * group_a, 2 * group_b + 1], kind="stable")
        texts = np.concatenate([self.aligner.text_a[self.a + last_a * len(self.aligner.bytes_a)], self.aligner.text_b[self.b + last_b * len(self.aligner.bytes_b)]])[order].tolist()
        ends = (self.starts_a + self.starts_b).tolist()
        return ["".join(texts[start:end]) for start, end in zip(ends, ends[1:])]


def _packed(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 1)


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


#: ``texts`` counts the block's texts, ``sizes`` chunks of each, ``chunks`` their places in the block's distinct chunks,
#: ``links`` end links of each distinct chunk, ``codes`` their id pairs.
_BLOCK = "doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, shas array<string>, sizes binary, chunks binary, links binary, codes binary"


def aligned_blocks(docs: DataFrame, file_a: str, file_b: str, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """Texts in blocks: what each text counts to, and its chunks' end links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(file_a, file_b)
        out: list[list] = [[], [], [], [], [], []]  # ids, n_a, n_b, n_groups, shas, chunks
        size = 0

        def sent() -> pa.RecordBatch:
            nonlocal out, size
            sizes = np.array(list(map(len, out[5])), np.int32)
            used, places = np.unique(np.concatenate([np.zeros(0, np.int64), *out[5]]), return_inverse=True)
            links, codes = aligner.links_of(used)
            row = [*([part] for part in out[:5]), [_packed(sizes)], [_packed(places.astype(np.uint32))], [_packed(links.astype(np.int32))], [_packed(codes)]]
            kinds = [pa.list_(pa.int64())] * 4 + [pa.list_(pa.string())] + [pa.binary()] * 4
            out, size = [[], [], [], [], [], []], 0
            if aligner.full():
                aligner.clear()
            return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(row, kinds)],
                                              names=[part.split()[0] for part in _BLOCK.split(", ")])

        for batch in slices(batches, 500):
            texts = [aligner.chunks(text) if text else [] for text in batch.column("text").to_pylist()]
            fresh = {chunk for chunks in texts for chunk in chunks}.difference(aligner.index)
            aligner.learn([chunk for chunk in fresh if len(chunk) <= LONG])
            for chunk in fresh:
                if len(chunk) > LONG:  # one at a time, to bound the products' memory
                    aligner.learn([chunk])
            for doc_id, chunks in zip(batch.column("doc_id").to_pylist(), texts):
                found = np.fromiter(map(aligner.index.__getitem__, chunks), np.int64, len(chunks))
                counts = aligner.counts[found]
                if (counts < 0).any():
                    found, counts = found[:0], counts[:0]
                sha = hashlib.sha256("".join(map(aligner.groups.__getitem__, found.tolist()))[:-1].encode()).hexdigest() if len(found) else ""
                for values, value in zip(out, (doc_id, *counts.sum(0).tolist(), sha, found)):
                    values.append(value)
                size += len(found)
            if size >= block_chunks or len(out[0]) >= 5000 or aligner.full():
                yield sent()
        if out[0]:
            yield sent()

    return docs.select("doc_id", "text").mapInArrow(run, _BLOCK)


def _chunk_links(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: chunks of each text, their places, links of each distinct chunk, and the links' pairs."""
    return tuple(_unpacked(batch.column(name)[row].as_py(), kind) for name, kind in
                 (("sizes", np.int32), ("chunks", np.uint32), ("links", np.int32), ("codes", np.int64)))


def link_counts(blocks: DataFrame) -> DataFrame:
    """``code`` (id of A << 32 | id of B), ``n``, its links, and ``best``: no pair of that id of B has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])

        for batch in slices(batches, 1):
            _, chunks, links, own = _chunk_links(batch, 0)
            times = np.repeat(np.bincount(chunks, minlength=len(links)), links)
            codes, back = np.unique(np.r_[codes, own], return_inverse=True)
            counts = np.bincount(back, np.r_[counts, times].astype(np.float64), len(codes)).astype(np.int64)
            if len(codes) > 2 * CACHED_CHUNKS:
                yield sent()
                codes, counts = codes[:0], counts[:0]
        yield sent()

    counted = blocks.select("sizes", "chunks", "links", "codes").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    path = scratch_path(blocks.sparkSession, "token-pairs")
    counted.write.parquet(path)
    counted = blocks.sparkSession.read.parquet(path)
    id_b = F.col("code").bitwiseAND(0xFFFFFFFF)
    most = counted.groupBy(id_b.alias("id_b")).agg(F.max("n").alias("most"))
    # one row for each id of B, so the vocabulary bounds what is sent
    return counted.withColumn("id_b", id_b).join(F.broadcast(most), "id_b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, file_a: str, file_b: str, held_pairs: int = HELD_PAIRS, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every text.

    ``n_best`` counts links whose id pair has the most links among pairs of its id of B, ``count_sum`` sums over links how
    many links of the whole table hold the same id pair.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "token-blocks")
    aligned_blocks(docs, file_a, file_b, block_chunks).write.parquet(path)
    blocks = spark.read.parquet(path)
    counts = link_counts(blocks)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = counts.filter(F.col("n") * held_pairs >= total).toArrow().sort_by("code")
    shared = spark.sparkContext.broadcast(tuple(held.column(c).to_numpy() for c in ("code", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, best = shared.value
        for batch in slices(batches, 1):
            sizes, chunks, links, own = _chunk_links(batch, 0)
            near = np.minimum(np.searchsorted(codes, own), max(0, len(codes) - 1))
            known = codes[near] == own if len(codes) else np.zeros(len(own), bool)
            of_chunk = np.repeat(np.arange(len(links)), links)
            of_text = np.repeat(np.arange(len(sizes)), sizes)

            def by_text(of_links: np.ndarray, exact: bool = True) -> np.ndarray:
                ends = np.r_[0, np.cumsum(links)]
                by_chunk = np.diff(np.r_[0, np.cumsum(of_links)][ends])
                return np.diff(np.r_[0, np.cumsum(by_chunk[chunks])][np.r_[0, np.cumsum(sizes)]])

            hit = np.where(known, near, 0)
            summed = by_text(np.where(known, n[hit], 0) if len(codes) else np.zeros(len(own), np.int64))
            bests = by_text((known & best[hit]).astype(np.int64) if len(codes) else np.zeros(len(own), np.int64))
            n_links = by_text(np.ones(len(own), np.int64))
            rest = np.zeros(len(sizes), object)
            for i in range(len(sizes)):
                rest[i] = []
            rare = np.flatnonzero(~known)
            if len(rare):  # the chunks with such links, and the texts that hold them
                first = np.searchsorted(of_chunk[rare], np.arange(len(links)))
                last = np.searchsorted(of_chunk[rare], np.arange(len(links)), "right")
                for at in np.flatnonzero(last[chunks] > first[chunks]).tolist():
                    chunk = chunks[at]
                    rest[of_text[at]] += own[rare[first[chunk]:last[chunk]]].tolist()
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c)[0].values for c in ("doc_ids", "n_a", "n_b", "n_groups", "shas")), pa.array(n_links), pa.array(bests), pa.array(summed),
                pa.array(rest.tolist(), pa.list_(pa.int64()))],
                names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "held_best", "held_sum", "rest"])

    kinds = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, held_best long, held_sum long, rest array<long>"
    path = scratch_path(spark, "token-counts")
    blocks.mapInArrow(run, kinds).write.parquet(path)
    found = spark.read.parquet(path).withColumn("row", F.monotonically_increasing_id())
    rare = found.select("row", F.explode("rest").alias("code")).join(counts, "code").groupBy("row").agg(
        F.sum(F.col("best").cast("long")).alias("rare_best"), F.sum("n").alias("rare_sum"))
    return found.join(rare, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("held_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"),
        (F.col("held_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum"), "groups_sha256")


def links(docs: DataFrame, file_a: str, file_b: str, kind: str = "overlap") -> DataFrame:
    """A row for each link of two token occurrences in a text: doc_id, places and ids of both tokens, and ``shared``.

    ``kind``: ``overlap`` (``shared`` bytes), ``end`` (overlap links that end together) or ``group`` (1).
    """
    fields = ["doc_id", "place_a", "place_b", "id_a", "id_b", "shared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(file_a, file_b)
        for batch in slices(batches, 1):
            text = batch.column("text")[0].as_py()
            if not text:
                continue
            _, ids_a, ids_b, good = next(aligner.encoded([[" " + text]]))
            if not good:
                continue
            aligned = Alignment(aligner, ids_a, ids_b)
            for a, b, value in aligned.group_links() if kind == "group" else aligned.overlap_links():
                if kind == "end":
                    together = aligned.ends_a[a] == aligned.ends_b[b]
                    a, b, value = a[together], b[together], value[together]
                doc_ids = pa.array([batch.column("doc_id")[0].as_py()] * len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([doc_ids, *map(pa.array, (a, b, aligned.a[a], aligned.b[b], value.astype(np.int64)))], names=fields)

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{name} long" for name in fields))


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), *tokenizer_paths())
