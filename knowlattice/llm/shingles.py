"""Near duplicates by word shingles: sets of five words in a row with a Jaccard likeness of 0.8 or more, and their components.

Candidates share a min-hash band (``BANDS`` bands of ``ROWS``; a pair at 0.8 misses all of them once in 20 million);
a link is made of a candidate pair only after its two sets were compared whole. All pairs of a band are
considered, but a pair that other links hold together already needs no comparison: each set is first compared
with one hub, then with the hubs of all its bands; what is then left in several components of a band is compared
across them if it shares rare shingles, as all alike sets do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, MOST_HOT, column, look_up, map_text, mix64, partitions, ranges, span_hashes, text_bytes, written
from .components import components
from .decontamination import lower

WORDS = 5
#: Least likeness, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 32, 4
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SALTS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes of each text, rising, and where each text's begin.

    Words are what blanks part, in lower case. A text of fewer than ``WORDS`` words is one shingle, one without words none.
    """
    raw, rows = lower(raw), len(at) - 1
    solid, edge = ~_SPACE[raw], np.zeros(len(raw) + 1, bool)
    edge[at] = True
    start = np.flatnonzero(solid & (edge[:-1] | ~np.append(False, solid[:-1])[: len(solid)]))
    end = np.flatnonzero(solid & (edge[1:] | ~np.append(solid[1:], False)[: len(solid)])) + 1
    hashes = span_hashes(raw, start, end)
    size = np.bincount(np.searchsorted(at, start, "right") - 1, minlength=rows)
    width = np.minimum(size, WORDS)
    count = np.where(size > 0, size - width + 1, 0)
    place, row = ranges(np.cumsum(size) - size, count), np.repeat(np.arange(rows), count)
    value, wide = np.zeros(len(place), np.uint64), width[row]
    for k in range(WORDS):
        inside = wide > k
        value[inside] = value[inside] * _STEP + hashes[place[inside] + k]
    value = mix64(value + wide.astype(np.uint64))
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    first = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1]))[: len(value)]
    value, row = value[first], row[first]
    return value, np.searchsorted(row, np.arange(rows + 1))


def _signs(batch: pa.RecordBatch) -> list[pa.Array]:
    """Hash and size of each text's set of shingles, and its min-hash bands (none for an empty set)."""
    value, at = shingles(*text_bytes(column(batch, "text")))
    size = np.diff(at)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(value + np.uint64(1)))])
    one = mix64(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64) * _STEP)
    filled = np.flatnonzero(size)
    bands = np.zeros((len(filled), BANDS), np.uint64)
    for j, salt in enumerate(_SALTS):
        least = np.minimum.reduceat(value * salt, at[filled]) if len(filled) else np.zeros(0, np.uint64)
        bands[:, j // ROWS] = mix64(bands[:, j // ROWS] ^ least + np.uint64(j))
    offsets = np.append(0, np.cumsum((size > 0) * BANDS))
    return [pa.array(one.view(np.int64)), pa.array(size, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bands.ravel().view(np.int64)))]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads sets sorted by band: those of each band that holds more than one, with the band's first as its hub."""
    names = ["band", "id", "n", "hub", "hub_n"]
    held = None  # the band that the last batch ended in, its hub, and whether the hub is its only row so far
    for rows in batches:
        band, one, n = (column(rows, c).to_numpy() for c in names[:3])
        if not len(band):
            continue
        start = np.append(0, np.flatnonzero(np.diff(band)) + 1)
        length = np.diff(np.append(start, len(band)))
        hub, hub_n, many = one[start], n[start], length > 1
        if held is not None and held[0] == band[0]:
            if held[3]:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*held[:3], *held[1:3]), (pa.int64(), pa.int64(), pa.int32()) + (pa.int64(), pa.int32()))], names=names)
            hub[0], hub_n[0], many[0] = held[1], held[2], True
        held = (int(band[-1]), int(hub[-1]), int(hub_n[-1]), not many[-1])
        use = np.repeat(many, length)
        if use.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (band, one, n, np.repeat(hub, length), np.repeat(hub_n, length))], names=names)


def _may(n: Column, m: Column) -> Column:
    """Sets of these sizes can be alike."""
    return F.least(n, m) * LEAST[1] >= F.greatest(n, m) * LEAST[0]


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""
    a, b = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_a")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    enough = both * (LEAST[0] + LEAST[1]) >= (F.size("_a") + F.size("_b")) * LEAST[0]
    return written(pairs.join(b, "b").join(a, "a").where(enough).select("a", "b"), "links")


def links(signs: DataFrame, sets_of: DataFrame) -> DataFrame:
    """Links (a, b) that hold together all alike sets of ``signs`` (id, n, bands; distinct).

    ``sets_of`` is one document (id, text) for each set; only of those in a shared band the shingles are made.
    """
    spark = signs.sparkSession
    rows = signs.select(F.explode("bands").alias("band"), "id", "n")
    # Bands of very many sets, at most MOST_HOT: their hubs are sent to all tasks, so the sets stay where they are.
    many = max(HOT_ROWS, signs.count() * BANDS // MOST_HOT)
    hot = written(rows.groupBy("band").count().where(F.col("count") > many).select("band"), "hot_bands")
    drawn = F.min(F.struct(F.xxhash64("band", "id"), F.col("id").alias("hub"), F.col("n").alias("hub_n"))).alias("m")
    hubs = rows.join(F.broadcast(hot), "band", "left_semi").groupBy("band").agg(drawn).select("band", "m.hub", "m.hub_n")
    dealt = rows.join(F.broadcast(hot), "band", "left_anti").repartition(partitions(spark), "band").sortWithinPartitions("band", F.xxhash64("band", "id"))
    members = dealt.mapInArrow(_members, "band long, id long, n int, hub long, hub_n int")
    members = written(members.unionByName(rows.join(F.broadcast(hubs), "band").select(members.columns)), "members")

    def made(batch: pa.RecordBatch) -> list[pa.Array]:
        value, at = shingles(*text_bytes(column(batch, "text")))
        return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(value.view(np.int64)))]

    sets = written(map_text(sets_of.join(members.select("id").distinct(), "id", "left_semi"), made, "shingles array<long>", drop=("text",)), "sets")
    pair = (F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    stars = members.where((F.col("id") != F.col("hub")) & _may(F.col("n"), F.col("hub_n")))
    stars = written(stars.select("id", "hub", *pair).distinct(), "stars")

    found = _alike(stars.groupBy("id").agg(F.min("hub").alias("hub")).select(*pair).distinct(), sets)
    group = _groups(found)
    tested = stars.select("a", "b").distinct()
    apart = tested.join(group.select(F.col("id").alias("a"), F.col("group").alias("_ga")), "a", "left").join(group.select(F.col("id").alias("b"), F.col("group").alias("_gb")), "b", "left")
    apart = apart.where(F.coalesce("_ga", "a") != F.coalesce("_gb", "b")).select("a", "b")
    found = written(found.unionByName(_alike(apart, sets)), "links")

    # Sets that are still in several components of one band are compared across components if they share rare shingles.
    inside = members.select("band", "id", "n").join(_groups(found), "id", "left").withColumn("group", F.coalesce("group", "id"))
    mixed = written(inside.groupBy("band").agg(F.min("group").alias("_a"), F.max("group").alias("_b")).where("_a != _b").select("band"), "mixed")
    open_sets = written(inside.join(mixed, "band", "left_semi").select("id", "n", "group").distinct().join(sets, "id"), "open")
    return found.unionByName(_alike(_crossing(open_sets).join(tested, ["a", "b"], "left_anti"), sets))


def _crossing(open_sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different groups; all alike ones are among them.

    With the shingles of each set in one order, rarest first, two alike sets share a shingle among the first n // 9 + 1 of
    the smaller and the first n // 5 + 1 of the larger, since they have 4/9 of both sizes in common. Sets that merely
    hold the same passage, or are copies with many edits, begin with shingles of their own and never meet, or meet so late in
    that order that too few shingles are left for them to be alike.
    """
    rows = open_sets.select("id", "n", "group", F.explode("shingles").alias("shingle"))
    counts = written(rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1").withColumn("_n", F.col("df")), "shared")
    total = open_sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = look_up(rows, counts, "shingle", "_n", total).groupBy("id", "n", "group").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("shared"))
    own = F.col("n") - F.size("shared")  # shingles of no other set: they come first
    first = F.slice("shared", 1, F.greatest(F.lit(0), F.expr("n div 5 + 1").cast("int") - own))
    begins = shared.select("id", "n", "group", own.alias("own"), F.posexplode(first).alias("at", "s"))
    place = F.col("own") + F.col("at")
    begins = written(begins.select("id", "n", "group", F.col("s.shingle").alias("shingle"), place.alias("place"), (place < F.expr("n div 9 + 1")).alias("early")), "begins")

    # In each shingle all but the largest group against the others.
    counts = begins.groupBy("shingle", "group").agg(F.count("*").alias("size"))
    largest = counts.groupBy("shingle").agg(F.max(F.struct("size", "group")).alias("m"), F.count("*").alias("groups")).where("groups > 1")
    begins = begins.join(largest.select("shingle", F.col("m.group").alias("largest")), "shingle")
    other = begins.where(F.col("group") != F.col("largest")).select("shingle", *[F.col(c).alias(f"_{c}") for c in ("id", "n", "group", "place", "early")])
    once = (F.col("group") != F.col("_group")) & ((F.col("group") == F.col("largest")) | (F.col("_id") < F.col("id"))) & _may(F.col("n"), F.col("_n"))
    meet = (F.col("early") & (F.col("n") <= F.col("_n"))) | (F.col("_early") & (F.col("_n") <= F.col("n")))
    # Behind their first common shingle no more are common than the shorter rest holds: too few, and the sets are not alike.
    rest = F.least(F.col("n") - F.col("place"), F.col("_n") - F.col("_place"))
    enough = rest * (LEAST[0] + LEAST[1]) >= (F.col("n") + F.col("_n")) * LEAST[0]
    return other.join(begins, "shingle").where(once & meet & enough).select(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b")).distinct()


def _groups(found: DataFrame) -> DataFrame:
    return components(found).select(F.col("node").alias("id"), F.col("root").alias("group"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row (``key``, component_id) per row of ``docs``, whose keys are distinct: the smallest key reachable over alike texts.

    Texts of equal sets are alike; so are null and blank ones, which have no words. ``docs`` is read more than once, so its
    keys must not change from one reading to the next.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    narrow = written(map_text(docs, _signs, "id long, n int, bands array<long>", drop=("text",)), "signs")
    first = written(narrow.groupBy("id").agg(F.min("key").alias("_first"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("_n")), "sets_seen")
    one = docs.join(first.select("id", F.col("_first").alias("key")), "key").select("id", "text")
    groups = _groups(written(links(first.select("id", "n", "bands"), one), "links"))
    linked = first.select("id", "_first").join(groups, "id")
    smallest = linked.groupBy("group").agg(F.min("_first").alias("_id"))
    named = first.select("id", "_first", "_n").join(linked.join(smallest, "group").select("id", "_id"), "id", "left")
    named = written(named.select("id", F.coalesce("_id", "_first").alias("component_id"), "_n"), "named")
    return look_up(narrow.select("key", "id"), named, "id", "_n", narrow.count()).select(F.col("key").alias(key), "component_id")
