"""Ids against the library, pieces against the whole documents, padding, and the least-squares solver."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from knowlattice.llm import packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [1]


def test_ids(library):
    hard = ["", " ", "don't 's  it's", "  two\n\n three \t", "<|endoftext|>x<|endoftext|>", "<| <|endof", "日本語 한국어 😀👍🏽", "é ñ ß ½ ²", "  x", "1234 12.5", "a" * 3000, "trailing   "]
    texts = hard + pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()[:80]
    for t in texts:
        assert packing.encoder("byte_bpe_50k").ids(t).tolist() == ids_of(library, t)


def check(pieces, docs, library):
    """docs: (id, text) with distinct ids. Returns the share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == {i for i, _ in docs}
    for i, t in docs:
        ids = np.array(ids_of(library, t), "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.WINDOW
    used = sum(p.length for p in pieces)
    return 1 - used / (len(by_sequence) * packing.WINDOW)


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert check(packing.pack(docs).collect(), [tuple(r) for r in docs.collect()], library) < 0.02


def test_edges(spark, library):
    rows = [(1, None, 5), (2, "", 5), (3, "a b " * 4000, 5), (None, "x", 5)] + [(10 + i, "word " * 1100, 5) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack(docs).collect()
    assert check(got, [r[:2] for r in rows], library) < 0.05
    assert packing.pack(docs.limit(0)).collect() == []
    assert sum(p.length for p in packing.pack(docs.where("doc_id = 1").union(docs.where("doc_id = 1"))).collect()) == 2


def test_solver_finds_exact_counts():
    combos = packing.combinations_of(np.array([32, 64, 96, 128, 160, 192, 224]), 256)
    rng = np.random.default_rng(0)
    want = rng.integers(0, 50, len(combos))
    histogram = np.zeros(257)
    for c, n in zip(combos, want):
        for b in c:
            histogram[b] += n
    x = packing.repeats(histogram, combos)
    left = histogram.copy()
    for c, n in zip(combos, x):
        for b in c:
            left[b] -= n
    assert (x >= 0).all() and np.abs(left).max() < 0.05 * histogram.max()


@pytest.mark.parametrize("lengths", [[1200] * 500, [700] * 300 + [100] * 77, list(range(1, 2048)), [5], []])
def test_plan_wastes_little(lengths):
    lengths = np.array(lengths, np.int64)
    pieces = packing.plan(lengths, 2048)
    sequences = len({p[2] for p in pieces})
    assert sequences <= -(-int(lengths.sum()) // 2048) * 1.02 + 1


def test_faster_reader_gives_the_librarys_ids(spark):
    """On all texts of sf0.01 and on random Unicode the ids are those of the named file's own library."""
    import random

    import pyarrow.parquet as pq

    e, rng = packing.Encoder(packing.VOCABULARY), random.Random(3)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    spans = [(32, 127), (0x80, 0x800), (0x800, 0xD800), (0xE000, 0x10000), (0x10000, 0x110000), (9, 14)]
    texts += ["".join(chr(rng.randrange(*rng.choice(spans))) if rng.random() < 0.95 else rng.choice(["'s", "<|", " ", " ", "'LL"]) for _ in range(rng.randrange(1, 120))) for _ in range(4000)]
    library = [x.ids for x in e.library.encode_batch(texts, add_special_tokens=False)]
    assert all(e.ids(t)[:-1].tolist() == ids for t, ids in zip(texts, library))
