import zlib

import numpy as np
import pytest
from helpers import ODD_ROWS, have_tables, no_documents, odd_documents, rows, small
from tokenizers import Tokenizer

from tributary.llm import packing


def plain_pieces(texts):
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())  # as it is: strings of special tokens are one id each
    out = []
    for doc_id, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            out.append((doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=str)


def check_places(frame):
    """Sequences are gapless from 0 and within the capacity; returns how many there are."""
    by_sequence = {}
    for sequence, offset, length in rows(frame.select("sequence_id", "offset", "length")):
        by_sequence.setdefault(sequence, []).append((offset, length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by_sequence)


def packed(docs, **options):
    import pyspark.sql.functions as F

    pieces = packing.tokenise(docs, packing.tokenizer_path()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces, **options)


@pytest.mark.skipif(not have_tables, reason="no test tables")
def test_whole_table(spark):
    docs = small(spark, "documents")
    frame = packed(docs).cache()
    got = sorted(rows(frame.select("doc_id", "piece", "start", "length", "ids_crc32")), key=str)
    assert got == plain_pieces(rows(docs.select("doc_id", "text")))
    total = sum(row[3] for row in got)
    count = check_places(frame)
    assert count <= 1.05 * -(-total // 2048) + 1
    many = packed(docs, group_pieces=20)
    assert check_places(many) <= 1.2 * count + 10 and many.count() == len(got)


def test_odd_rows(spark):
    frame = packed(odd_documents(spark, extra=True))
    assert sorted(rows(frame.select("doc_id", "piece", "start", "length", "ids_crc32")), key=str) == plain_pieces([r[:2] for r in ODD_ROWS])
    check_places(frame)
    assert packed(no_documents(spark)).count() == 0


def test_words_have_the_ids_of_the_text():
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    tokenizer.encode_special_tokens = True
    words = packing.WordIds(packing.tokenizer_path())
    for text in ["a..b, 's don't. x'll! É.É, \x1c..  a b ß$ ñ.' <|endoftext|> ́a. ", "İ. ſS", "1.5,3 ab12..!'s", "you're WE'VE it's.'s", "ab́ 12 3.", "\x85\xa0x"]:
        got = b"".join(map(words.__getitem__, text.encode().lower().split()))
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_the_rule_leaves_the_least_sum_of_squares():
    chance = np.random.default_rng(3)
    sizes = chance.integers(1, 30, 200)
    numbers, offsets, fills = packing.place(sizes, 29)
    gaps = {}
    for size, number, offset in zip(sizes.tolist(), numbers.tolist(), offsets.tolist()):
        def total(of):
            counts = np.bincount([g for g in of.values() if g], minlength=30)
            return int((counts**2).sum())

        choices = [total({**gaps, k: g - size}) for k, g in gaps.items() if g >= size] + [total({**gaps, "new": 29 - size})]
        gaps[number] = gaps.get(number, 29) - size
        assert offset == 29 - gaps[number] - size and total(gaps) == min(choices)
    assert fills.tolist() == [29 - gaps[k] for k in range(len(fills))]


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, "a b c"), (3, None)], "doc_id long, text string")
    out = packing.sequences(packing.pack(packing.tokenise(docs, packing.tokenizer_path()))).collect()
    assert len(out) == 1 and len(out[0].ids) == 4 * (3 + 4 + 1)


def test_special_strings_are_the_ids_of_an_untouched_tokenizer(spark):
    import random

    chance = random.Random(6)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "a", "Don't", " ", "\n", ".", "É", "12", "<", "｜", "ﬁ"]
    texts = [(i, "".join(chance.choice(parts) for _ in range(chance.randint(1, 12)))) for i in range(1500)]
    frame = packed(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(rows(frame.select("doc_id", "piece", "start", "length", "ids_crc32")), key=str) == plain_pieces(texts)


def test_columns_of_the_same_names(spark):
    pieces = spark.createDataFrame([(1, 0, 5), (2, 0, 7), (None, 0, 2048)], "doc_id long, piece int, length long").selectExpr(
        "*", "'x' AS fill", "'y' AS `offset`", "1 AS sequence_id", "'z' AS `__group`")
    frame = packing.pack(pieces)
    assert check_places(frame) == 2 and {r.fill for r in frame.collect()} == {"x"} and frame.columns.count("offset") == 1
