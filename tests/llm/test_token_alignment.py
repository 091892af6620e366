import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import ODD_ROWS, have_tables, no_documents, odd_documents, rows, small

from tributary.llm import token_alignment as ta

FILES = ta.tokenizer_paths()


def plain_tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def plain(texts):
    """The contract read literally: whole texts, byte offsets as sets, counts over all of them."""
    a, b = plain_tokenizers()
    signs = ta.byte_alphabet()
    entries = {i: bytes(signs[s] for s in piece) for piece, i in a.get_vocab().items() if i != 50256}
    found = []
    for doc_id, text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [entries[i] for i in ids_a]
        bytes_b = []
        for i in ids_b:
            piece = b.id_to_piece(i)
            bytes_b.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            found.append((doc_id, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum(list(map(len, bytes_a))).tolist(), np.cumsum(list(map(len, bytes_b))).tolist()
        where_b = {end: i for i, end in enumerate(ends_b)}
        links = [(i, where_b[end]) for i, end in enumerate(ends_a) if end in where_b]
        groups, at_a, at_b = [], 0, 0
        for i, j in links:
            groups.append(",".join(map(str, ids_a[at_a:i + 1])) + "|" + ",".join(map(str, ids_b[at_b:j + 1])))
            at_a, at_b = i + 1, j + 1
        found.append((doc_id, ids_a, ids_b, [(ids_a[i], ids_b[j]) for i, j in links], groups))
    counts = Counter(pair for row in found for pair in row[3])
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return sorted(((doc_id, len(x), len(y), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for doc_id, x, y, links, groups in found), key=str)


def aligned(docs, **options):
    frame = ta.align(docs, *FILES, **options)
    return sorted(rows(frame.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")), key=str)


@pytest.mark.skipif(not have_tables, reason="no test tables")
@pytest.mark.parametrize("options", [{}, {"held_pairs": 50, "block_chunks": 500}])
def test_whole_table(spark, options):
    docs = small(spark, "documents")
    assert aligned(docs, **options) == plain(rows(docs.select("doc_id", "text")))


def test_odd_rows(spark):
    assert aligned(odd_documents(spark, extra=True)) == plain([r[:2] for r in ODD_ROWS])
    assert aligned(no_documents(spark)) == []


def test_chunks_are_aligned_like_whole_texts(spark):
    chance = random.Random(5)
    parts = [" ", "  ", "\t", "\n", "\r\n", "　", "\xa0", "\x00", "\x1c", "▁", "a", "the", "don't", "'s", "é", "ß", "日本", "😀", "́", "12", ".", "...", "<|endoftext|>", "<s>", "<0x41>", "ﬁ", "_", "\x85", " ", "'"]
    texts = [(i, "".join(chance.choice(parts) for _ in range(chance.randint(1, 14)))) for i in range(1500)]
    texts += [(2000, " " * 50), (2001, " a" * 3), (2002, "a "), (2003, "▁"), (2004, "   a   b   "), (2005, "日本語 " * 400)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert aligned(frame) == plain(texts)


def test_products_are_those_of_dense_matrices():
    chance = np.random.default_rng(7)
    left, right = chance.random((17, 23)) < 0.3, chance.random((23, 11)) < 0.3
    def sparse(dense):
        return ta.Csr(np.r_[0, np.cumsum(dense.sum(1))], np.nonzero(dense)[1], dense.shape[1])
    for entries in (1, 7, 10_000):
        got = np.zeros((17, 11), int)
        for row, column, value in ta.products(sparse(left), sparse(right), entries):
            got[row, column] += value
        assert (got == left.astype(int) @ right.astype(int)).all()
    turned = sparse(left).transposed()
    assert (turned.starts == np.r_[0, np.cumsum(left.sum(0))]).all() and (turned.columns == np.nonzero(left.T)[1]).all()


def test_links_of_a_text(spark):
    texts = [(1, "unbelievable weather"), (2, None), (3, "▁")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    a, b = plain_tokenizers()
    aligner = ta.Aligner(*FILES)
    ids_a, ids_b = a.encode(" " + texts[0][1], add_special_tokens=False).ids, b.encode(texts[0][1])
    def ranges(ids, entries):
        ends = np.cumsum([len(entries[i]) for i in ids]).tolist()
        return list(zip([0, *ends], ends))
    spans_a, spans_b = ranges(ids_a, aligner.bytes_a), ranges(ids_b, aligner.bytes_b)
    shared = {(i, j): min(x[1], y[1]) - max(x[0], y[0]) for i, x in enumerate(spans_a) for j, y in enumerate(spans_b)}
    common = sorted({x[1] for x in spans_a} & {y[1] for y in spans_b})
    group = lambda span: sum(c < span[1] for c in common)
    expected = {
        "overlap": {(i, j, n) for (i, j), n in shared.items() if n > 0},
        "end": {(i, j, n) for (i, j), n in shared.items() if spans_a[i][1] == spans_b[j][1]},
        "group": {(i, j, 1) for i, x in enumerate(spans_a) for j, y in enumerate(spans_b) if group(x) == group(y)},
    }
    for kind, pairs in expected.items():
        got = rows(ta.links(docs, *FILES, kind=kind))
        assert {(r[1], r[2], r[5]) for r in got} == pairs and {r[0] for r in got} == {1}
        assert all(ids_a[r[1]] == r[3] and ids_b[r[2]] == r[4] for r in got)
