"""Best-fit packing by the sum-of-squares rule.

Documents become token ids with an end id; those longer than a sequence are cut, nothing else is.  A piece goes
to the place (an open sequence of some residual gap, or a new one) that leaves the sum, over gaps, of the
squared counts of open sequences smallest.  The rule keeps every gap rare, which keeps fits likely.

Pieces are dealt to groups by a hash of document and piece, and a group packs alone: its state is one count and
one list of open sequences for each gap, so any number of groups runs side by side and a lost one is
repeated alike.  Sequences that a group leaves unfilled are taken apart and packed again with those of other groups, in
ever fewer groups, until one group holds all that is left.

A null text is an empty document (its end id alone).  Repeated rows are packed each, ties in length go by id and piece.  ``tokenise`` ignores extra
columns; ``pack`` keeps them, but for ``sequence_id`` and ``offset``, which it replaces.  An empty table gives no rows; very long texts are cut
into pieces of a sequence's length, of which one group holds about ``GROUP_PIECES``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tributary.llm.common import Columns, map_columns
from tributary.llm.registry import query, table
from tributary.session import cut_lineage

CAPACITY = 2048
END_ID = 0
#: Pieces that one group packs, and words whose ids a task remembers.
GROUP_PIECES = 16_384
CACHED_WORDS = 500_000
#: A column of :func:`pack` while it works: the fill of a piece's sequence.
FILL = "__fill"


class WordIds(dict):
    """Ids of each word as little-endian 32-bit bytes.

    The tokenizer splits at white space and never merges across it, so a text's ids are those of its words; A-Z
    may be lower-cased first because the tokenizer does so itself.  The cache is emptied when full.
    """

    def __init__(self, tokenizer_file: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = True  # special strings are taken out of the text before
        self.model = self.tokenizer.model

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        core = word.rstrip(b".,;!?$%&*#|")
        if core != word and core and core[-1:].isalnum():  # an ASCII letter or digit ends a token before these signs
            ids = self[core] + self[word[len(core):]]
        elif word.isalpha():  # a-z only, a single token run: the merges alone decide
            ids = np.array([token.id for token in self.model.tokenize(word.decode())], "<u4").tobytes()
        else:
            ids = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids


class TextIds:
    """Ids of a text as the tokenizer gives them by default: strings of special tokens, searched in the text as it stands, are one id each."""

    def __init__(self, tokenizer_file: str):
        self.words = WordIds(tokenizer_file)
        self.special = {t.content: np.array([i], "<u4").tobytes() for i, t in self.words.tokenizer.get_added_tokens_decoder().items()}
        self.pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")

    def __call__(self, text: str | None) -> bytes:
        parts, at = [], 0
        for found in self.pattern.finditer(text or ""):
            parts += [self._plain(text[at:found.start()]), self.special[found[0]]]
            at = found.end()
        return b"".join([*parts, self._plain((text or "")[at:])])

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.encode().lower().split()))


def tokenise(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian 32-bit) of each piece of every document."""
    end, width = np.array([END_ID], "<u4").tobytes(), 4 * capacity

    def start():
        ids_of = TextIds(tokenizer_file)

        def step(batch: Columns) -> Columns:
            out: Columns = {"doc_id": [], "piece": [], "start": [], "length": [], "ids": []}
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = ids_of(text) + end
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at:at + width]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(piece)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids"].append(part)
            return out

        return step

    fields = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids": "binary"}
    return map_columns(docs.select("doc_id", "text"), fields, start)


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, taken in the given order, and the fill of each sequence."""
    counts = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequences, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    never = np.iinfo(np.int64).max
    for i, size in enumerate(lengths.tolist()):
        # a gap g of count n becomes g - size: the sum changes by 2 (count(g - size) - n) + 2, or 1 - 2n when it fills
        change = np.where(counts[size:] > 0, 2 * (counts[:capacity + 1 - size] - counts[size:]) + 2, never)
        if counts[size] > 0:
            change[0] = 1 - 2 * counts[size]
        gap = int(change.argmin()) + size
        fresh = 0 if size == capacity else 2 * int(counts[capacity - size]) + 1
        if change[gap - size] <= fresh:
            number = open_by_gap[gap].pop()
            counts[gap] -= 1
        else:
            number, gap = len(fills), capacity
            fills.append(0)
        sequences[i], offsets[i] = number, capacity - gap
        fills[number] = capacity - gap + size
        if gap > size:
            counts[gap - size] += 1
            open_by_gap[gap - size].append(number)
    return sequences, offsets, np.array(fills, np.int64)


def _group_packer(names: list[str], capacity: int, round_number: int):
    """The function that packs one group, longest pieces first."""

    def pack_group(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]).select(names)
        numbers, offsets, fills = place(group.column("length").to_numpy(), capacity)
        numbers_of = (round_number << 56) + (key[0].as_py() << 32) + numbers
        for name, values in (("sequence_id", numbers_of), ("offset", offsets), (FILL, fills[numbers])):
            group = group.append_column(name, pa.array(values))
        return group

    return pack_group


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any other columns) with sequence_id and offset.

    Every round packs what the round before left in unfilled sequences, as long as that halves the groups; so a
    group never holds more than about ``group_pieces`` pieces.  The last round's unfilled sequences stay as they are: those of the groups that it had.
    """
    pieces = pieces.drop("sequence_id", "offset", FILL)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id long, offset long, {FILL} long"
    names = pieces.columns
    key = "__group" + "_" * sum(name.startswith("__group") for name in names)
    waiting, done, round_number = cut_lineage(pieces), None, 0
    groups = max(1, -(-waiting.count() // group_pieces))
    while True:
        share = F.pmod(F.xxhash64("doc_id", "piece", F.lit(round_number)), F.lit(groups)).alias(key)
        packed = cut_lineage(waiting.groupBy(share).applyInArrow(_group_packer(names, capacity, round_number), schema))
        waiting = packed.filter(F.col(FILL) < capacity)
        fewer = max(1, -(-waiting.count() // group_pieces))
        if 2 * fewer > groups:
            return (packed if done is None else done.unionByName(packed)).drop(FILL)
        filled = packed.filter(F.col(FILL) >= capacity)
        done = filled if done is None else done.unionByName(filled)
        waiting, groups, round_number = waiting.select(*names), fewer, round_number + 1


def sequences(packed: DataFrame) -> DataFrame:
    """Each sequence's pieces in order and their ids joined; ``packed`` has the column ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(ordered.alias("pieces")).select(
        "sequence_id", F.transform("pieces", lambda p: p["doc_id"]).alias("doc_ids"),
        F.aggregate("pieces", F.lit(b""), lambda joined, p: F.concat(joined, p["ids"])).alias("ids"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokenise(table(spark, sf_dir, "documents"), tokenizer_path())
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(narrow).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
