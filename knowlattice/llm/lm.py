"""Stupid-backoff language-model scores, relationally: count tables partitioned by hash, joined to exploded n-grams.

Three steps, each a group by key of packed rows rather than one row per n-gram:

1. A block is a slice of about ``BLOCK_BYTES`` of a scan task's texts. It explodes its n-grams and sends its distinct
   ones, with their counts, to the hash bucket they belong to. A frequent n-gram costs one entry per block.
2. A bucket adds up the counts of its n-grams over all blocks: its part of the count tables. It joins them to the
   requests and answers each block in the order asked.
3. Each block joins the answers to its texts' n-grams and sums the scores per document.

An n-gram is known by its bucket and 40 further bits of its hash; buckets grow in number with the corpus, so that
about one n-gram in 100,000 shares its identity with another, at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, partitions, span_hashes, text_bytes, text_chunks

ORDER = 3
BACKOFF = 0.4
#: N-grams of two or more words that the whole corpus holds fewer times are backed off from.
LEAST_COUNT = 2
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 12 << 20
SLICE_BYTES = 1 << 20

_REST = np.uint64((1 << 40) - 1)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word: a run of bytes other than ASCII white space, A-Z as a-z."""
    low = _LOWER[raw]
    inside = ~_SPACES[low]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    start = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]])[: len(raw)] | edge[:-1]))
    end = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]])[-len(raw) :] if len(raw) else inside) | inside & edge[1:]) + 1
    return span_hashes(low, start, end), np.searchsorted(at, start, "right") - 1


def block_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``words`` of a column, hashed about ``SLICE_BYTES`` (or one longer text) at a time, so that temporaries stay small."""
    raw, at = text_bytes(texts)
    hashes, rows, start = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while start < len(at) - 1:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + SLICE_BYTES, "right")) - 1)
        found, row = words(raw[at[start] : at[stop]], at[start : stop + 1] - at[start])
        hashes.append(found)
        rows.append(row + start)
        start = stop
    return np.concatenate(hashes), np.concatenate(rows)


def grams(hashes: np.ndarray, row: np.ndarray, order: int, buckets: int) -> list[np.ndarray]:
    """For each n up to ``order`` and each word, bucket and rest of the n-gram that ends there (all ones where the text has none)."""
    out, h = [], hashes
    for n in range(1, order + 1):
        if n > 1:
            h = mix64(np.concatenate([h[:1], h[:-1]]) * np.uint64(0xD6E8FEB86659FD93) + hashes + np.uint64(n)) if len(h) else h
        key = (h >> np.uint64(40)) % np.uint64(buckets) << np.uint64(40) | h & _REST
        first = np.searchsorted(row, row)
        out.append(np.where(np.arange(len(row)) - first >= n - 1, key, np.uint64(2**64 - 1)))
    return out


def _pack(rests: np.ndarray) -> bytes:
    return rests.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def _pack_counts(counts: np.ndarray) -> bytes:
    """How many (8 bytes), a byte each, then 8 bytes for each that is 255 or more: a few frequent n-grams don't widen the rest."""
    large = counts[counts >= 255]
    return len(counts).to_bytes(8, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes() + large.astype("<u8").tobytes()


def _unpack_counts(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    counts = np.frombuffer(packed, np.uint8, n, 8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(packed, "<u8", offset=8 + n)
    return counts


_REQUEST = "bucket long, block long, n int, rests binary, counts binary"
_ANSWER = "block long, bucket long, n int, counts binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of this task's texts with numbers of their own: the same whenever the task runs again."""
    held, size, number = [], 0, TaskContext.get().partitionId() << 32
    for part in text_chunks(batches, BLOCK_BYTES // 8):
        held.append(part)
        size += len(text_bytes(part.column(1))[0])
        if size >= BLOCK_BYTES:
            yield number, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size, number = [], 0, number + 1
    if held:
        yield number, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _requests(block: int, texts: pa.RecordBatch, order: int, buckets: int) -> pa.RecordBatch:
    rows: list[list] = [[], [], [], [], []]
    hashes, row = block_words(texts.column(1))
    for n, keys in enumerate(grams(hashes, row, order, buckets), 1):
        distinct, counts = np.unique(keys[keys != 2**64 - 1], return_counts=True)
        owner = (distinct >> np.uint64(40)).astype(np.int64)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        for a, b in zip(first, np.append(first[1:], len(owner))):
            for column, value in zip(rows, (int(owner[a]), block, n, _pack(distinct[a:b] & _REST), _pack_counts(counts[a:b]))):
                column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=["bucket", "block", "n", "rests", "counts"])


def _packed_block(block: int, texts: pa.RecordBatch) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, texts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(texts)
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "texts"])


def _answers(requests: pa.Table) -> pa.Table:
    rows: list[list] = [[], [], [], []]
    if requests.num_rows:
        bucket, n_of, blocks = requests["bucket"][0].as_py(), requests["n"].to_numpy(), requests["block"].to_pylist()
        for n in np.unique(n_of):
            own = np.flatnonzero(n_of == n)
            rests = [_unpack(requests["rests"][int(i)].as_py()) for i in own]
            counts = [_unpack_counts(requests["counts"][int(i)].as_py()) for i in own]
            distinct, which = np.unique(np.concatenate(rests), return_inverse=True)
            total = np.bincount(which, np.concatenate(counts), len(distinct)).astype(np.int64)[which]
            at = np.cumsum([0, *map(len, rests)])
            for k, i in enumerate(own):
                for column_, value in zip(rows, (blocks[i], bucket, int(n), _pack_counts(total[at[k] : at[k + 1]]))):
                    column_.append(value)
    return pa.table([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["block", "bucket", "n", "counts"])


_SCORE = "doc_id long, n_tokens long, log_score double, backed_off long"


def stupid_backoff(counts: list[np.ndarray], total: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """Log score of each word and how often it backed off; counts[n][i]: of the n+1-gram ending at word i (0: none).

    The context of the n-gram ending at word i is the shorter n-gram ending at word i - 1.
    """
    size = len(counts[0])
    score, backs = np.zeros(size), np.zeros(size, np.int64)
    todo = np.ones(size, bool)
    for n in range(len(counts) - 1, 0, -1):
        exists = np.arange(size) > 0
        context = np.concatenate([[0], counts[n - 1][:-1]])
        seen = todo & exists & (counts[n] >= least) & (context > 0)
        score[seen] += np.log(counts[n][seen]) - np.log(context[seen])
        todo &= ~seen
        # A word with too short a history in its text is scored from what it has, without a penalty.
        backs += todo & (counts[n] >= 0)
    score[todo] += np.log(counts[0][todo]) - np.log(total)
    return score + backs * np.log(BACKOFF), backs


def _scores(block: pa.Table, answers: pa.Table, order: int, buckets: int, total: int) -> pa.Table:
    if not block.num_rows:
        raise ValueError("the texts came in other slices than before: score() needs a repeatable input, such as a table of files")
    texts = pa.ipc.open_stream(block["texts"][0].as_py()).read_all()
    rows = texts.num_rows
    hashes, row = block_words(texts.column(1))
    counts = []
    answers = answers.sort_by([("n", "ascending"), ("bucket", "ascending")])
    n_of = answers["n"].to_numpy()
    for n, keys in enumerate(grams(hashes, row, order, buckets), 1):
        present = keys != 2**64 - 1
        distinct, which = np.unique(keys[present], return_inverse=True)
        found = [_unpack_counts(answers["counts"][int(i)].as_py()) for i in np.flatnonzero(n_of == n)]
        if sum(map(len, found)) != len(distinct):
            raise ValueError("the texts came in other slices than before: score() needs a repeatable input, such as a table of files")
        known = np.full(len(keys), -1, np.int64)
        if present.any():
            known[present] = np.concatenate(found)[which]
        counts.append(known)
    score, backs = stupid_backoff(counts, total) if len(hashes) else (np.zeros(0), np.zeros(0, np.int64))
    ids = texts.column(0).combine_chunks()
    return pa.table(
        [ids, np.bincount(row, minlength=rows).astype(np.int64), np.bincount(row, score, rows).astype(float), np.bincount(row, backs, rows).astype(np.int64)],
        names=["doc_id", "n_tokens", "log_score", "backed_off"],
    )


def score(docs: DataFrame, text: str = "text", order: int = ORDER) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, log_score (sum over its words) and backed_off, with counts over all of ``docs``.

    score(w | history) = count(history w) / count(history) for the longest history whose n-gram the corpus holds at
    least ``LEAST_COUNT`` times, times ``BACKOFF`` for each order given up, down to count(w) / all words. N-grams don't
    cross documents; a text's first words have shorter histories without penalty. Null and blank texts have 0 tokens and
    score 0; ids may be null or repeat, each row is scored and counted; other columns are not read.

    ``docs`` is read twice and must come in the same partitions both times, as a scan of files does (else write it
    first); a difference is found and raised.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size, total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(_word_count(F.col("text"))), F.lit(0))).first()
    # An exploded word takes about 5 bytes an order where it first meets a block; there are some six bytes of text to a word.
    buckets = max(partitions(docs.sparkSession), -(-size * order // (2 * BUCKET_BYTES)))
    requests = docs.mapInArrow(lambda batches: (_requests(n, texts, order, buckets) for n, texts in _blocks(batches)), _REQUEST)
    answers = requests.groupBy("bucket").applyInArrow(_answers, _ANSWER)
    blocks = docs.mapInArrow(lambda batches: (_packed_block(n, texts) for n, texts in _blocks(batches)), "block long, texts binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda t, a: _scores(t, a, order, buckets, total), _SCORE)


def _word_count(text):
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
