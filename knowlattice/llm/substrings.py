"""Substring dedup: words inside a passage of ``WINDOW`` words that also stands in a document of smaller id.

Anchors of ``WINDOW - PERIOD + 1`` words are hashed only at places which are, modulo ``PERIOD``, in a difference cover: any
two places have a shift below ``PERIOD`` that takes both into the cover, so two equal windows, wherever they start, share
an anchor at the same distance from their starts. Anchors that two different texts share are extended: of each, the
windows around it are hashed whole (in 128 bits), and the smallest id of each window is found.

Before each shuffle a task settles what it can: an anchor that two texts of one slice share is known to be shared, and a
window that a smaller id has in the same slice is known to be covered. What is left for the shuffle of a passage that
very many documents hold is a few rows for each slice. Equal texts are told apart from the start: all but the
smallest id of them are covered whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_words, column, look_up, map_text, mix64, partitions, ranges, span_hashes, text_bytes, text_chunks, written

WINDOW = 50
#: The differences of these five and one places modulo 31 are all of 0 to 30 (a perfect difference set).
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
RESULT = "n_words long, n_removed long, kept string"
_LAST = 2**63 - 1
_BASES = (0x9E6C63D0876A9A47, 0xA24BAED4963EE407)


def _window_hashes(hashes: np.ndarray, start: np.ndarray, width: int, base: int) -> np.ndarray:
    """64-bit hashes of ``width`` words from each start, by doubling: halves are joined."""
    parts, power, total = [], hashes + np.uint64(1), None
    done, size = 0, 1
    while width:
        if width & 1:
            parts.append((done, power, size))
            done += size
        width >>= 1
        if width:
            power = power[:-size] * np.uint64(pow(base, size, 2**64)) + power[size:]
            size *= 2
    for offset, part, length in parts:
        total = part[start + offset] if total is None else total * np.uint64(pow(base, length, 2**64)) + part[start + offset]
    return mix64(total)


def _word_hashes(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and number of each word of a slice, and the words of each row."""
    raw, at = text_bytes(column(batch, text))
    words = blank_words(raw, at)
    row = np.repeat(np.arange(batch.num_rows), words.size)
    return span_hashes(raw, words.start, words.end), row, np.arange(len(row)) - words.first[row], words.size


def _new_group(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (same, text): anchors (key, same, place). Place -1 stands for a text only; below it the place -2 - p is known to be shared."""
    in_cover = np.zeros(PERIOD, bool)
    in_cover[list(COVER)] = True
    width = WINDOW - PERIOD + 1
    for batch in text_chunks(batches, 4 << 20):
        hashes, row, number, size = _word_hashes(batch, "text")
        at = np.flatnonzero(in_cover[number % PERIOD] & (number + width <= size[row]) & (size[row] >= WINDOW))
        if not len(at):
            continue
        key, same, place = _window_hashes(hashes, at, width, _BASES[0]).view(np.int64), column(batch, "same").to_numpy()[row[at]], number[at]
        order = np.lexsort((place, same, key))
        key, same, place = key[order], same[order], place[order]
        once = _new_group(key, same, place)  # copies in one slice
        key, same, place = key[once], same[once], place[once]
        first = np.flatnonzero(_new_group(key))
        length = np.diff(np.append(first, len(key)))
        shared = same[first] != same[first + length - 1]
        known = np.repeat(shared, length)
        ends = np.concatenate([first[shared], (first + length - 1)[shared]])
        spread = mix64(same[known].view(np.uint64) + place[known].astype(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x)) for x in ((key[~known], key[ends], spread), (same[~known], same[ends], same[known]), (place[~known].astype(np.int32), np.full(len(ends), -1, np.int32), (-2 - place[known]).astype(np.int32)))],
            names=["key", "same", "place"],
        )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors sorted by (key, same): texts and places (same, place) of those that two texts share."""

    def batch(same: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        real = place >= 0
        return pa.RecordBatch.from_arrays([pa.array(same[real]), pa.array(place[real])], names=["same", "place"])

    # The key that the last batch ended in, its first text, and the places of that text until another one comes.
    last = first_same = None
    held = np.zeros(0, np.int32)
    for rows in batches:
        key, same, place = (column(rows, c).to_numpy() for c in ("key", "same", "place"))
        known = place < -1
        if known.any():
            yield batch(same[known], -2 - place[known])
            key, same, place = key[~known], same[~known], place[~known]
        if not len(key):
            continue
        first = np.flatnonzero(_new_group(key))
        length = np.diff(np.append(first, len(key)))
        leader, final = same[first].copy(), same[first + length - 1]
        if last == key[0]:
            leader[0] = first_same
        shared = leader != final
        if last is not None and (last != key[0] or shared[0]):
            if last == key[0]:
                yield batch(np.full(len(held), first_same), held)
            held = np.zeros(0, np.int32)
        use = np.repeat(shared, length)
        yield batch(same[use], place[use])
        if len(first) > 1 or last != key[0]:
            held = np.zeros(0, np.int32)
        last, first_same = key[-1], leader[-1]
        if not shared[-1]:
            held = np.unique(np.concatenate([held, place[first[-1] :]]))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (id, same, text, places of shared anchors): windows (key, more, id, same, start, known) around the anchors."""
    for batch in text_chunks(batches, 4 << 20):
        hashes, row, number, size = _word_hashes(batch, "text")
        places = column(batch, "places")
        count = places.value_lengths().to_numpy()
        place, of = places.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), count)
        base, last = (np.cumsum(size) - size)[of], size[of] - WINDOW
        low, high = np.maximum(place - (PERIOD - 1), 0), np.minimum(place, last)
        change = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(change, (base + low)[low <= high], 1)
        np.add.at(change, (base + high + 1)[low <= high], -1)
        at = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        if not len(at):
            continue
        key, more = (_window_hashes(h, at, WINDOW, b).view(np.int64) for h, b in zip((hashes, mix64(hashes)), _BASES))
        one, same, start = column(batch, "id").to_numpy()[row[at]], column(batch, "same").to_numpy()[row[at]], number[at].astype(np.int32)
        order = np.lexsort((one, more, key))
        key, more, one, same, start = (x[order] for x in (key, more, one, same, start))
        first = np.flatnonzero(_new_group(key, more))
        known = one > np.repeat(one[first], np.diff(np.append(first, len(one))))
        key = np.where(known, mix64(same.view(np.uint64) + start.astype(np.uint64)).view(np.int64), key)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, np.where(known, 0, more), one, same, start, known)], names=["key", "more", "id", "same", "start", "known"])


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by (known, key, more, id): those (id, same, start) that a smaller id has too."""
    last = least = None  # the window that the last batch ended in, and its smallest id
    for rows in batches:
        key, more, one, same, start = (column(rows, c).to_numpy() for c in ("key", "more", "id", "same", "start"))
        if not len(key):
            continue
        known = column(rows, "known").to_numpy(zero_copy_only=False)
        first = np.flatnonzero(_new_group(key, more, known))
        smallest = one[first].copy()
        if last == (key[0], more[0], known[0]):
            smallest[0] = least
        found = known | (one > np.repeat(smallest, np.diff(np.append(first, len(one)))))
        last, least = (key[-1], more[-1], known[-1]), smallest[-1]
        yield pa.RecordBatch.from_arrays([pa.array(x[found]) for x in (one, same, start)], names=["id", "same", "start"])


def _kept(batch: pa.RecordBatch, text: str) -> list[pa.Array]:
    raw, at = text_bytes(column(batch, text))
    words = blank_words(raw, at)
    starts = column(batch, "_starts")
    of = np.repeat(np.arange(batch.num_rows), starts.fill_null([]).value_lengths().to_numpy())
    start = words.first[of] + starts.flatten().to_numpy()
    change = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + WINDOW, -1)
    copy = column(batch, "_copy").fill_null(False).to_numpy(zero_copy_only=False) & (words.size >= WINDOW)
    kept = (np.cumsum(change[:-1]) == 0) & ~np.repeat(copy, words.size)
    left = np.bincount(np.repeat(np.arange(batch.num_rows), words.size)[kept], minlength=batch.num_rows)
    return [pa.array(words.size, pa.int64()), pa.array(words.size - left, pa.int64()), words.joined(raw, kept)]


def _same(text: Column) -> list[Column]:
    """128 bits by which equal texts are known."""
    return [F.xxhash64(text).alias("_same"), F.xxhash64(F.lit(1), text).alias("_more")]


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """The rows of ``docs`` with the columns of ``RESULT``: words, removed words, and the kept words joined by one space.

    A word is what blanks (space, tab to carriage return) part, unchanged. A word goes if it is in a window of ``WINDOW`` words
    of its document that also starts in a document of smaller ``key`` (an integer); windows are judged on the input. Rows without
    key count as the largest; rows of equal keys do not cover one another, and repeated rows get equal results. Null and empty texts have no
    words and keep an empty text; a text of fewer words than a window keeps all. Columns named like a result give way.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    taken = {"_id", "_same", "_more", "_copy", "_starts"} & set(docs.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} of docs have names used here")
    whole = docs.withColumn("_id", F.coalesce(F.col(key).cast("long"), F.lit(_LAST))).withColumns(dict(zip(("_same", "_more"), _same(F.coalesce(text, F.lit(""))))))
    narrow = written(whole.select("_id", "_same", "_more", F.struct("_same", "_more").alias("_text")), "texts_seen")
    first = narrow.groupBy("_text").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    named = look_up(narrow, written(first, "texts"), "_text", "_n", narrow.count()).select("_id", "_same", "_first")
    copies = named.where("_id > _first").select("_id", "_same", F.lit(True).alias("_copy"), F.lit(None).cast("array<int>").alias("_starts")).distinct()

    found = whole.select(F.col("_same").alias("same"), F.col(text).alias("text")).mapInArrow(_anchors, "key long, same long, place int")
    found = found.repartition(n, "key").sortWithinPartitions("key", "same").mapInArrow(_shared, "same long, place int")
    places = written(found.distinct().groupBy("same").agg(F.collect_list("place").alias("places")), "anchors")

    heads = first.select(F.col("_first").alias("_id"), F.col("_text._same").alias("_same")).join(places.withColumnRenamed("same", "_same"), "_same")
    texts = whole.select("_id", "_same", F.col(text).alias("text")).join(heads, ["_id", "_same"]).select(F.col("_id").alias("id"), F.col("_same").alias("same"), "text", "places")
    seen = texts.mapInArrow(_windows, "key long, more long, id long, same long, start int, known boolean")
    seen = seen.repartition(n, "key").sortWithinPartitions("known", "key", "more", "id").mapInArrow(_covered, "id long, same long, start int")
    spans = seen.groupBy(F.col("id").alias("_id"), F.col("same").alias("_same")).agg(F.lit(False).alias("_copy"), F.collect_set("start").alias("_starts"))
    spans = written(spans.unionByName(copies), "repeats")

    judged = whole.drop("_more").join(spans, ["_id", "_same"], "left")
    return map_text(judged, lambda batch: _kept(batch, text), RESULT, text, ("_id", "_same", "_copy", "_starts", *(() if keep_text else (text,))))
