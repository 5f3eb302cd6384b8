"""Token counts by pieces: equal to the library on random stretches, and asked of it about once a piece."""

import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from knowlattice.functions import tokens as K
from knowlattice.operators import chunking as C

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["word", " word", "'s", "'", "'re", "'ll", " ", "  ", "\n", "\n\n", "\t", "　", " ", "\x85", "\x1c", "🙂", "汉字", "é", "é", "12", "١٢", "½", "!", "...", "<|endoftext|>", "x" * 90, "​", " don't", "\r", "𝒳", "👨‍👩", "\x00", " "]
PREFIXES = ["", "# Head", "Head ", "tail'", "\n", "a\n \n", "l　", "12"]


def library(path):
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return lambda text: made.encode(text, add_special_tokens=False)


@pytest.mark.parametrize("name, made", [("byte_bpe_50k.json", K.Stretch), ("word_bpe_49k.json", K.Whole)])
def test_stretches_equal_the_library(name, made):
    path = public_tokenizers.path(name)
    count, encode, draw = K.Counter(path), library(path), random.Random(3)
    for _ in range(300):
        text, prefix = "".join(draw.choice(BITS) for _ in range(draw.randint(1, 60))), draw.choice(PREFIXES)
        start = draw.randrange(len(text))
        end = draw.randint(start + 1, len(text))
        found = count.stretch(text, start, end, prefix)
        assert type(found) is made
        ends = [start + b for _, b in encode(text[start:end]).offsets]
        for _ in range(20):
            a = draw.randrange(start, end)
            b, n = draw.randint(a + 1, end), draw.randint(1, 30)
            assert found.size(a, b) == len(encode((prefix + "\n\n" if prefix else "") + text[a:b]).ids)
            if ends:
                assert found.end_of(a, n) == ends[min(K.bisect_right(ends, a) + n - 1, len(ends) - 1)]


def test_code_points_of_another_kind_are_left_to_the_library():
    count, encode = K.Counter(VOCABULARY), library(VOCABULARY)
    other = "࢏"  # a letter since a later edition of Unicode than the library's
    text = f"a{other}b 1 word"
    found = count.stretch(text, 0, len(text))
    assert isinstance(found, K.Stretch) == (len(count.library.pre_tokenizer.pre_tokenize_str("a" + other)) == len(K.PIECE.findall("a" + other)))
    assert all(found.size(a, b) == len(encode(text[a:b]).ids) for a in range(len(text)) for b in range(a + 1, len(text) + 1))


def test_other_parts_of_such_a_text_are_split():
    count, encode = K.Counter(VOCABULARY), library(VOCABULARY)
    other = next((c for c in map(chr, range(0x500, 0x3000)) if not count._agrees(c)), None)
    if other is None:
        pytest.skip("the library and the pattern agree on all")
    text = f"one {other} two \n" + "some words, isn't it? " * 9
    found = count.stretch(text, 10, len(text) - 1, "# Head")
    assert isinstance(found, K.Shifted) and isinstance(count.stretch(text, 0, 9), K.Whole)
    ends = [10 + b for _, b in encode(text[10:-1]).offsets]
    for a in range(10, len(text) - 1, 3):
        assert all(found.size(a, b) == len(encode("# Head\n\n" + text[a:b]).ids) for b in range(a + 1, len(text)))
        assert found.end_of(a, 4) == ends[min(K.bisect_right(ends, a) + 3, len(ends) - 1)]


def test_kept_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(K, "KEPT", 10)
    count, text = K.Counter(VOCABULARY), " ".join(f"w{i}q" for i in range(100))
    assert count.stretch(text, 0, len(text)).size(0, len(text)) == count(text)[0]
    assert len(count.known) <= 10 and len(count.known.older) <= 10
    count.known["y" * 10] = count.known["y" * 65]
    assert "y" * 65 not in count.known


def test_a_token_target_costs_little_more_than_one_encoding():
    draw, encode = random.Random(7), library(VOCABULARY)
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(2000)]
    text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", ". ", "\n"]) for _ in range(40_000))
    config = C.Config(child_tokens=128, tokenizer=VOCABULARY)
    C.chunk_text(text[:1000], config)

    def seconds(work):
        begun = time.process_time()
        work()
        return time.process_time() - begun

    once, plain = (min(seconds(w) for _ in range(3)) for w in (lambda: [encode(text[i : i + 400]) for i in range(0, len(text), 400)], lambda: C.chunk_text(text)))
    assert min(seconds(lambda: C.chunk_text(text, config)) for _ in range(3)) < plain + 3 * once


def test_rows_of_many_texts_all_go_out(spark):
    texts = ["Some words. " * 200] * 60 + ["", " \n"] + ["x " * 80_000] + [""] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = C.chunk_documents(docs).orderBy("doc_id", "sequence").select("doc_id", "sequence", "content").collect()
    assert [tuple(r) for r in got] == [(i, r["sequence"], r["content"]) for i, t in enumerate(texts) for r in C.chunk_text(t)]
