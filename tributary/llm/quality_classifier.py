"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a text with features x is  w0 + <w, x> + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2],
which takes time linear in the features.  The labels, language, source and id are never features.

A null text counts as empty; an empty text is scored by its (zero) statistics.  Repeated rows are scored each.
Without any usable label every score is 0.5.  Extra columns are ignored by ``score`` and kept by ``keep_good``.  An empty table gives no
rows; texts of any length are read whole; a score of exactly 0.5 counts as good.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import Columns, filter_columns, fold_of, map_columns
from tributary.llm.registry import query, table

#: Buckets of hashed words, factors, and the most labelled rows a model is fitted on.
BUCKETS = 4096
FACTORS = 8
SAMPLE_ROWS = 6000
EPOCHS = 25
SYMBOLS = b"#*$%&|<>"
STATISTICS = 16
CACHED_WORDS = 300_000


class WordBuckets(dict):
    """Bucket of each word; the cache is emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        bucket = self[word] = zlib.crc32(word.lower().strip(b".,;:!?")) % BUCKETS
        return bucket


def statistics(data: bytes, words: list[bytes], counts: Counter, n_chars: int | None) -> list[float]:
    n, size = max(1, len(words)), max(1, len(data))
    lines = [line for line in data.split(b"\n") if line.strip()]
    letters = sum(map(len, words))
    symbols = size - len(data.translate(None, SYMBOLS)) if data else 0
    return [
        math.log1p(len(words)), math.log1p(letters / n), min(3.0, symbols / n), len(counts) / n,
        max(counts.values(), default=0) / n, repeats(words) / n,
        math.log1p(len(lines)), math.log1p(len(words) / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
        data.count(b"|") / n, (data.count(b".") + data.count(b",")) / n, 1 - len(data.translate(None, b"0123456789")) / size if data else 0.0,
        1 - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / size if data else 0.0, float(not words),
        math.log1p(max(0, n_chars or 0)), float(n_chars is None),
    ]


def repeats(words: list[bytes]) -> int:
    """Words equal to the word before them."""
    return sum(map(bytes.__eq__, words, words[1:]))


def features(texts: list[str | None], n_chars: list[int | None], buckets: WordBuckets) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words (square root of the count, unit length) and statistics of each text."""
    hashed = np.zeros((len(texts), BUCKETS), np.float32)
    stats = np.zeros((len(texts), STATISTICS), np.float32)
    for row, text in enumerate(texts):
        data = (text or "").encode()
        words = data.split()
        counts = Counter(words)
        if counts:
            places = np.fromiter(map(buckets.__getitem__, counts), np.int64, len(counts))
            values = np.sqrt(np.bincount(places, np.fromiter(counts.values(), np.float64, len(counts)), BUCKETS))
            hashed[row] = values / np.linalg.norm(values)
        stats[row] = statistics(data, words, counts, n_chars[row])
    return hashed, stats


@dataclass
class Machine:
    """A fitted factorisation machine; plain arrays of a size that no input changes."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def inputs(self, hashed: np.ndarray, stats: np.ndarray) -> np.ndarray:
        return np.hstack([hashed, np.clip((stats - self.centre) / self.scale, -6, 6)])

    def logits(self, x: np.ndarray) -> np.ndarray:
        pairs = np.square(x @ self.factors) - np.square(x) @ np.square(self.factors)
        return self.bias + x @ self.weights + 0.5 * pairs.sum(axis=1)

    def scores(self, hashed: np.ndarray, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.inputs(hashed, stats)), -30, 30).astype(np.float64)))


def train(hashed: np.ndarray, stats: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Fit by Adam on the logistic loss, in batches of 256 rows."""
    chance = np.random.default_rng(seed)
    size = BUCKETS + STATISTICS
    machine = Machine(0.0, np.zeros(size, np.float32), chance.normal(0, 0.02, (size, FACTORS)).astype(np.float32),
                      stats.mean(axis=0), stats.std(axis=0) + 1e-3)
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    machine.bias = math.log(share / (1 - share))
    moments = {name: [np.zeros_like(value), np.zeros_like(value)] for name, value in
               (("weights", machine.weights), ("factors", machine.factors))}
    bias_moments, step = [0.0, 0.0], 0
    for _ in range(epochs):
        order = chance.permutation(len(labels))
        for at in range(0, len(order), 256):
            rows, step = order[at:at + 256], step + 1
            x = machine.inputs(hashed[rows], stats[rows])
            error = (1 / (1 + np.exp(-np.clip(machine.logits(x), -30, 30))) - labels[rows]).astype(np.float32) / len(rows)
            sums = x @ machine.factors
            slopes = {
                "weights": x.T @ error + 1e-4 * machine.weights,
                "factors": x.T @ (error[:, None] * sums) - (np.square(x).T @ error)[:, None] * machine.factors + 1e-3 * machine.factors,
            }
            for name, slope in slopes.items():
                first, second = moments[name]
                first += 0.1 * (slope - first)
                second += 0.001 * (np.square(slope) - second)
                rate = 0.02 * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                setattr(machine, name, getattr(machine, name) - rate * first / (np.sqrt(second) + 1e-8))
            slope = float(error.sum())
            bias_moments = [0.9 * bias_moments[0] + 0.1 * slope, 0.999 * bias_moments[1] + 0.001 * slope * slope]
            machine.bias -= 0.02 * bias_moments[0] / (1 - 0.9**step) / (math.sqrt(bias_moments[1] / (1 - 0.999**step)) + 1e-8)
    return machine


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Machine | None:
    """A machine fitted on at most ``sample_rows`` labelled rows, those with the smallest hash of their id.

    Only ids outside fold 1 of 3 are used.  The sampled ids are broadcast (``sample_rows`` bounds them), the
    features of the sampled rows are made where the rows are, and one task fits on that bounded sample.
    """
    ids = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), 3) != 1))
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    sample = docs.select("doc_id", "text", "n_chars").join(F.broadcast(ids), "doc_id")

    def start():
        buckets = WordBuckets()

        def step(batch: Columns) -> Columns:
            hashed, stats = features(batch["text"], batch["n_chars"], buckets)
            found = [np.flatnonzero(row).astype(np.uint16) for row in hashed]
            return {
                "doc_id": batch["doc_id"], "label": batch["label"], "places": [x.tobytes() for x in found],
                "amounts": [row[x].tobytes() for row, x in zip(hashed, found)], "stats": [row.tobytes() for row in stats],
            }

        return step

    rows = map_columns(sample, {"doc_id": "long", "label": "int", "places": "binary", "amounts": "binary", "stats": "binary"}, start)
    one = F.min(F.struct("label", "places", "amounts", "stats"))  # an id that repeats counts once
    rows = rows.groupBy("doc_id").agg(one.alias("one")).select("doc_id", "one.*")

    def fit_group(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "stats", "places"])[:sample_rows]
        hashed = np.zeros((len(group), BUCKETS), np.float32)
        for row, (places, amounts) in enumerate(zip(group.places, group.amounts)):
            hashed[row, np.frombuffer(places, np.uint16)] = np.frombuffer(amounts, np.float32)
        stats = np.stack([np.frombuffer(x, np.float32) for x in group.stats])
        machine = train(hashed, stats, group.label.to_numpy(np.float32))
        arrays = [machine.weights, machine.factors, machine.centre, machine.scale]
        return pd.DataFrame([[float(machine.bias), *(np.ascontiguousarray(a, np.float32).tobytes() for a in arrays)]],
                            columns=["bias", "weights", "factors", "centre", "scale"])

    fitted = rows.groupBy(F.lit(0).alias("all")).applyInPandas(
        fit_group, "bias double, weights binary, factors binary, centre binary, scale binary").collect()
    if not fitted:
        return None
    row = fitted[0]
    return Machine(row.bias, np.frombuffer(row.weights, np.float32), np.frombuffer(row.factors, np.float32).reshape(-1, FACTORS),
                   np.frombuffer(row.centre, np.float32), np.frombuffer(row.scale, np.float32))


def _scorer(machine: Machine | None):
    def start():
        buckets = WordBuckets()

        def scores(texts: list, n_chars: list) -> list[float]:
            if machine is None:
                return [0.5] * len(texts)
            out: list[float] = []
            for at in range(0, len(texts), 256):
                out += machine.scores(*features(texts[at:at + 256], n_chars[at:at + 256], buckets)).tolist()
            return out

        return scores

    return start


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id and score of every row of ``docs``; rows stay where they are."""
    scorer = _scorer(machine)

    def start():
        scores = scorer()
        return lambda batch: {"doc_id": batch["doc_id"], "score": scores(batch["text"], batch["n_chars"])}

    return map_columns(docs.select("doc_id", "text", "n_chars"), {"doc_id": "long", "score": "double"}, start)


def keep_good(docs: DataFrame, machine: Machine | None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with all their columns."""
    scorer = _scorer(machine)

    def start():
        scores = scorer()
        return lambda batch: [s >= least for s in scores(batch["text"], batch["n_chars"])]

    return filter_columns(docs, start, ["text", "n_chars"])


@query("op8_quality_classifier")
def op8(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels)).select(
        "doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
