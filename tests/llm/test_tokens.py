"""Counts against the library that reads the vocabulary file."""

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from knowlattice.llm import tokens

HARD = [
    "", " ", "a", "aaaa aaaaaaa aaaaaaaaaaaaaaaaaaaaa", "don't you'll we've I'M 's''s '' '", "1234567 12.5 ½ ²³", "ÀÉÎ straße ΣΑΣ İstanbul",
    "éclair", "日本語テキスト 한국어", "emoji 😀😀👍🏽 mixed", "tabs\t\nnew\r\nlines nbsp em", "<|endoftext|> in text<|startoftext|>x<|endoftext|>",
    "<|other|> <|endoftext|", "!!!??? ... --- ###", "x" * 3000, "word " * 500, "ﬁ ﬂ ǅ", "\x00\x01 control\x7f", "_under_score_ [a](b)", "ab" * 900,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))


def test_hard_texts(library):
    got = tokens.Counter(public_tokenizers.path(tokens.VOCABULARY)).count(HARD)
    assert got == [len(library.encode(t, add_special_tokens=False).ids) for t in HARD]


def test_documents(library):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()[:300]
    got = tokens.Counter(public_tokenizers.path(tokens.VOCABULARY)).count(texts)
    assert got == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_frame(spark, library, monkeypatch):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (None, "Some words", 7), (3, "same", 7), (3, "same", 7), (4, "w " * 2049, 7)], "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs).collect()}
    assert got == {(1, 0, 0, False), (2, 0, 0, False), (None, 10, 2, False), (3, 4, 1, False), (4, 4098, 2049, True)}
    assert tokens.count_tokens(docs.limit(0)).count() == 0
