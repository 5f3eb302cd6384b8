"""The registered queries themselves, on a whole small table: their columns and values against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from knowlattice.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def test_op1(spark, texts):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    items = {str(r["item_id"]): word.findall(lower(r["text"])) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist() if r["text"]}
    windows = defaultdict(set)
    for name, words in items.items():
        for i in range(max(1, len(words) - 9) if words else 0):
            windows[tuple(words[i : i + 10])].add(name)
    sizes = {len(w) for w in windows}
    for r in queries.op1_fm_index_decontamination(spark, SF).collect():
        words, hit, found = word.findall(lower(texts[r.doc_id])), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if owners := windows.get(tuple(words[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= owners
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_op2(spark, texts):
    ids = sorted(texts)
    got = {r.doc_id: r for r in queries.op2_winnowing_fingerprints(spark, SF).collect()}
    assert set(got) == set(ids)
    same = defaultdict(set)
    for k, i in enumerate(ids):
        text, following = texts[i], texts[ids[(k + 1) % len(ids)]]
        cut = len(text) // 2
        edited = text[: len(text) - cut] + following[:cut]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.near_edited == 1 if edited == text else True)
        same[text].add(r.fingerprint)
        same[edited].add(r.edited_fingerprint)
    assert all(len(prints) == 1 for prints in same.values())


def test_op3(spark, texts):
    rows = queries.op3_hypergeometric_sharding(spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == Counter(texts.keys())
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    per = defaultdict(list)
    for r in rows:
        per[r.shard].append(r.slot)
    assert set(per) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1


def test_op4(spark, texts):
    def fingerprint(text):
        words = re.findall("[^\x20\x09-\x0d]+", lower(text))
        if not words:
            return 0
        n = min(3, len(words))
        hashes = [xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    ids = sorted(texts)
    prints = np.array([fingerprint(texts[i]) for i in ids], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    root = list(range(len(ids)))
    changed = True
    while changed:
        smallest = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(ids))]
        changed, root = smallest != root, smallest
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash_near_duplicates(spark, SF).collect()}
    assert got == {i: (f"{int(p):016x}", ids[k]) for i, p, k in zip(ids, prints, root)}


def test_op5_op6_op8_cover_all_documents(spark, texts):
    scored = queries.op5_stupid_backoff(spark, SF)
    assert Counter(r.doc_id for r in scored.select("doc_id").collect()) == Counter(texts.keys())
    rated = queries.op6_ordinal_toxicity(spark, SF).collect()
    assert Counter(r.doc_id for r in rated) == Counter(texts.keys()) and all(0 <= r.severity <= 3 and r.rejected == (r.severity >= 0.3) for r in rated)
    replaced = {r.doc_id: r.text for r in queries.op8_surrogates(spark, SF).select("doc_id", "text").collect()}
    assert set(replaced) == set(texts)
    mail = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+")
    for i, text in texts.items():
        assert not set(mail.findall(text)) & set(mail.findall(replaced[i] or "")) and len(mail.findall(text)) == len(mail.findall(replaced[i] or ""))


def test_op7(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op7_nnls_packing(spark, SF).collect():
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.length == len(piece) > 0 and r.ids_crc32 == zlib.crc32(piece.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, all_ids in ids.items():
        assert sum(n for _, n in pieces[i]) == len(all_ids) and all(a + n == b for (a, n), (b, _) in zip(sorted(pieces[i]), sorted(pieces[i])[1:]))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 2048


def test_op9(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op9_rank_synchronous_token_counts(spark, SF).collect()}
    counts = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    assert got == {i: (len(t.encode()), counts[i], counts[i] > 2048) for i, t in texts.items()}


def test_op10(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    wanted = con.execute(queries.OP10_SQL)
    names = [d[0] for d in wanted.description]
    got = [tuple(r[n] for n in names) for r in queries.op10_redirect_equivalence(spark, SF).collect()]
    assert sorted(got, key=repr) == sorted(wanted.fetchall(), key=repr)
