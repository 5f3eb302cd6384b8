"""Toxicity severity by cumulative-link (proportional-odds) ordinal regression on sparse text features.

P(severity >= k) = sigmoid(w . x - threshold_k) with one weight vector for all ordered thresholds; the output is the
expected severity, the sum of these over k = 1 to 3. Features are log(1 + count) of the words and word beginnings whose
presence tells labelled toxic texts from others. The model is fitted on a bounded sample of labelled rows.

The labels say toxic or not. A toxic text's grade is the third it falls in by a toxicity score from a model fitted
without it (on the other folds, with words chosen there), so no grade is made of the features that then predict it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, map_text, mix64, span_hashes, text_bytes
from .decontamination import lower, words

#: Labelled rows that the model is fitted on, at most (those with the smallest hash of doc_id).
SAMPLE_ROWS = 8_000
#: And as many of these as have so many bytes of text in all; texts of more than ``LONG_BYTES`` come last.
SAMPLE_BYTES, LONG_BYTES = 64 << 20, 1 << 20
FOLDS = 5
GRADES = 3
#: Texts with at least this expected severity are rejected.
REJECT_AT = 0.3
#: Words of more bytes also count by their beginning, which catches inflected forms.
STEM_BYTES = 6
#: A feature stands in at least so many toxic sample texts, and tells them apart by so many standard errors.
LEAST_TEXTS, LEAST_Z = 5, 6.0
#: Or most of its texts are toxic, by a test whose level adapts to the labels: of those that pass, chance explains at most this share.
CHANCE_SHARE = 0.2
_BANDS, _ROWS = 10, 8


@dataclass
class Sparse:
    """A matrix of ``shape`` by its entries: row, column and value of each."""

    shape: tuple[int, int]
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.column] * self.value, self.shape[0])

    def transposed_times(self, of_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, of_row[self.row] * self.value, self.shape[1])

    def rows(self, use: np.ndarray) -> "Sparse":
        """The rows where ``use`` is true, numbered anew."""
        held, number = use[self.row], np.cumsum(use) - 1
        return Sparse((int(use.sum()), self.shape[1]), number[self.row[held]], self.column[held], self.value[held])


@dataclass
class Model:
    features: np.ndarray  # hashes of words and beginnings, rising
    weights: np.ndarray
    thresholds: np.ndarray  # rising, one for each grade from 1

    def severity(self, logit: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(self.thresholds[None, :] - logit[:, None]))).sum(1)


def _nothing() -> Model:
    """Rates everything 0."""
    return Model(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES, 50.0))


def _word_counts(raw: np.ndarray, at: np.ndarray, features: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash (or place among the features) and count of each distinct word and word beginning of each text."""
    hashes, start, end, row = words(raw, at)
    long = end - start > STEM_BYTES
    stems = mix64(span_hashes(lower(raw), start[long], start[long] + STEM_BYTES) + np.uint64(1))
    hashes, row = np.concatenate([hashes, stems]), np.concatenate([row, row[long]])
    if features is not None:
        place = np.searchsorted(features, hashes)
        known = features[np.minimum(place, len(features) - 1)] == hashes if len(features) else np.zeros(len(hashes), bool)
        pairs, count = np.unique(np.stack([row[known], place[known]], 1), axis=0, return_counts=True)
        return pairs[:, 0], pairs[:, 1], count
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])])[: len(hashes)])
    return row[first], hashes[first], np.diff(np.append(first, len(hashes)))


def _sample_features(batch: pa.RecordBatch) -> list[pa.Array]:
    """Distinct words, their counts, and the min-hash bands by which copies are known."""
    row, hashes, count = _word_counts(*text_bytes(column(batch, "text")))
    at = np.searchsorted(row, np.arange(batch.num_rows + 1))
    bands = np.zeros((batch.num_rows, _BANDS), np.uint64)
    for j in range(_BANDS * _ROWS):
        salted = mix64(hashes + np.uint64(j * 0x9E3779B97F4A7C15 % 2**64))
        least = np.minimum.reduceat(np.append(salted, np.uint64(0)), np.minimum(at[:-1], len(salted)))
        bands[:, j // _ROWS] = mix64(bands[:, j // _ROWS] ^ np.where(np.diff(at) > 0, least, 0))
    offsets = pa.array(at, pa.int32())
    return [
        pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64))),
        pa.ListArray.from_arrays(offsets, pa.array(count, pa.int32())),
        pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())),
    ]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model for the texts of ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic 0/1).

    The sample has at most ``sample_rows`` texts, one for each id (repeated rows count once), and at most
    ``sample_bytes`` of text, or one longer text. Copies and near copies in it count once (they share a min-hash
    band), so that no repeated text makes its own words look toxic. Rows without text, id or label are not used; an id
    with both labels is toxic. Without toxic or other labels the model has no features and rates everything 0.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    drawn = F.xxhash64("doc_id")
    # Each broadcast has at most sample_rows small rows.
    sample = known.orderBy(drawn, "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", "text").where("text is not null")
    one = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("size"))).alias("m"), F.first("_toxic").alias("_toxic"))
    up_to = F.sum("m.size").over(W.orderBy(F.col("m.size") > LONG_BYTES, drawn, "doc_id").rowsBetween(W.unboundedPreceding, 0))
    chosen = one.withColumn("_upto", up_to).where((F.col("_upto") <= sample_bytes) | (F.col("_upto") == F.col("m.size"))).select("doc_id", "_toxic", F.col("m.h").alias("_h"))
    texts = texts.join(F.broadcast(chosen), "doc_id").where(F.xxhash64("text") == F.col("_h")).dropDuplicates(["doc_id"]).drop("_h")
    sample = map_text(texts, _sample_features, "hashes array<long>, counts array<int>, bands array<long>", drop=("text",))
    # The sample is bounded, and so meets in one task; the driver gets the model only.
    fitted = sample.repartition(1).mapInArrow(_fit_sample, "features array<long>, weights array<double>, thresholds array<double>").toArrow()
    if not fitted.num_rows:
        return _nothing()
    features, weights, thresholds = (fitted[c].combine_chunks().flatten().to_numpy() for c in ("features", "weights", "thresholds"))
    return Model(features.view(np.uint64), weights, thresholds)


def _fit_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows (doc_id, _toxic, hashes, counts, bands) as one row, none for no rows."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    found = pa.Table.from_batches(held)
    del held
    # In the order of the ids, one of those that share a band; only their words are kept from here on.
    order = np.argsort(found["doc_id"].to_numpy(), kind="stable")
    bands, kept = found["bands"].combine_chunks().flatten().to_numpy().reshape(-1, _BANDS)[order], np.ones(len(order), bool)
    for band in bands.T:
        first = np.zeros(len(order), bool)
        first[np.unique(band, return_index=True)[1]] = True
        kept &= first
    found = found.select(["_toxic", "hashes", "counts"]).take(pa.array(order[kept]))
    del bands
    pa.default_memory_pool().release_unused()
    hashes = found["hashes"].combine_chunks()
    model = fit_rows(hashes.value_lengths().to_numpy(), hashes.flatten().to_numpy().view(np.uint64), found["counts"].combine_chunks().flatten().to_numpy(), np.array(found["_toxic"].to_pylist(), bool))
    del found, hashes
    pa.default_memory_pool().release_unused()
    one = [pa.array([x]) for x in (model.features.view(np.int64), model.weights, model.thresholds)]
    yield pa.RecordBatch.from_arrays(one, names=["features", "weights", "thresholds"])


def _numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, rising, and the place of each hash among them; looked up in blocks, so no order of all hashes is held."""
    rising = np.sort(hashes)
    distinct = rising[np.append(True, rising[1:] != rising[:-1])[: len(rising)]]
    del rising
    which = np.empty(len(hashes), np.int32)
    for i in range(0, len(hashes), 1 << 20):
        which[i : i + (1 << 20)] = np.searchsorted(distinct, hashes[i : i + (1 << 20)])
    return distinct, which


def fit_rows(size: np.ndarray, hashes: np.ndarray, counts: np.ndarray, toxic: np.ndarray) -> Model:
    """The model for texts of ``size`` distinct words each, whose ``hashes`` and ``counts`` lie end to end."""
    n = len(size)
    if not toxic.any() or toxic.all():
        return _nothing()
    text = np.repeat(np.arange(n, dtype=np.int32), size)
    distinct, which = _numbered(hashes)
    value = np.log1p(counts.astype(np.float32))

    def design(use: np.ndarray) -> tuple[np.ndarray, Sparse]:
        """The features that tell the toxic texts among ``use``, and their values in all texts."""
        inside = use[text]
        of_toxic, of_all = np.bincount(which[inside], toxic[text[inside]], len(distinct)), np.bincount(which[inside], minlength=len(distinct))
        chosen = _telling(of_toxic, of_all, int(toxic[use].sum()), int(use.sum()))
        place = np.full(len(distinct), -1)
        place[chosen] = np.arange(len(chosen))
        held = place[which] >= 0
        return chosen, Sparse((n, len(chosen)), text[held], place[which[held]], value[held])

    chosen, x = design(np.ones(n, bool))
    if not len(chosen):
        return _nothing()
    # Log-odds of being toxic by the other folds' model; lowest where the text has none of its words.
    fold, strength = np.arange(n) % FOLDS, np.full(n, -np.inf)
    for k in range(FOLDS):
        own, others = fold == k, fold != k
        if toxic[others].any() and not toxic[others].all():
            _, x_k = design(others)
            if x_k.shape[1]:
                w, t = _proportional_odds(x_k.rows(others), toxic[others].astype(int), steps=300, grades=1, floor=0.0)
                holds = np.bincount(x_k.row, minlength=n) > 0
                strength[own] = np.where(holds, x_k.times(w) - t[0], -np.inf)[own]
    strong = strength[toxic & np.isfinite(strength)]
    cuts = np.quantile(strong, [i / GRADES for i in range(1, GRADES)]) if len(strong) else np.zeros(GRADES - 1)
    grade = np.where(toxic, 1 + (strength[:, None] > cuts[None, :]).sum(1), 0)
    # Every chosen word tells toxic texts: few labels must not make one of them speak against it.
    weights, thresholds = _proportional_odds(x, grade, floor=0.0)
    return Model(distinct[chosen], weights, thresholds)


def _telling(of_toxic: np.ndarray, of_all: np.ndarray, n_toxic: int, n: int) -> np.ndarray:
    """The features held by so many more of the toxic texts than of the others that chance does not explain it."""
    p, q, share = of_toxic / n_toxic, (of_all - of_toxic) / (n - n_toxic), of_all / n
    z = (p - q) / np.sqrt(share * (1 - share) * (1 / n_toxic + 1 / (n - n_toxic)) + 1e-12)
    some = np.flatnonzero(of_all)
    beyond = np.zeros(len(of_all), bool)
    beyond[some] = _beyond_chance(of_toxic[some].astype(int), of_all[some])
    return np.flatnonzero((of_toxic >= LEAST_TEXTS) & (z >= LEAST_Z) | beyond)


def _beyond_chance(of_toxic: np.ndarray, of_all: np.ndarray) -> np.ndarray:
    """Features most of whose texts are toxic, at the widest level of a binomial test that chance explains ``CHANCE_SHARE`` of at most.

    A feature of few texts can reach few levels, so what chance would pass is counted for each number of texts apart.
    """
    rate = of_toxic.sum() / of_all.sum()
    log_factorial = np.concatenate([[0], np.cumsum(np.log(np.arange(1, of_all.max() + 1)))])
    pairs, which, seen = np.unique(np.stack([of_all, of_toxic], 1), axis=0, return_inverse=True, return_counts=True)
    tail, levels, chance = np.ones(len(pairs)), [], []
    for n in np.unique(of_all):
        k = np.arange(n + 1)
        above = np.exp(log_factorial[n] - log_factorial[k] - log_factorial[n - k] + k * np.log(rate) + (n - k) * np.log1p(-rate))[::-1].cumsum()[::-1]
        mine = pairs[:, 0] == n
        tail[mine] = above[pairs[mine, 1]]
        use = 2 * k > n
        levels.append(above[use])
        chance.append(np.append(above[use][:-1] - above[use][1:], above[-1]) * seen[mine].sum())
    levels, chance = np.concatenate(levels), np.concatenate(chance)
    order = np.argsort(levels, kind="stable")
    expected = np.concatenate([[0], np.cumsum(chance[order])])
    most = 2 * pairs[:, 1] > pairs[:, 0]
    by_tail = np.argsort(np.where(most, tail, 2), kind="stable")[: int(most.sum())]
    passed, at = np.cumsum(seen[by_tail]), tail[by_tail]
    good = np.flatnonzero(expected[np.searchsorted(levels[order], at, "right")] <= CHANCE_SHARE * passed)
    return (most & (tail <= at[good[-1]]))[which.ravel()] if len(good) else np.zeros(len(of_all), bool)


def _proportional_odds(x: Sparse, grade: np.ndarray, steps: int = 800, ridge: float = 1e-3, rate: float = 0.05, grades: int = GRADES, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood with a small ridge, by Adam; thresholds are the first and positive steps from it; no weight below ``floor``."""
    n, m = x.shape
    theta = np.concatenate([np.zeros(m), [1.0], np.zeros(grades - 1)])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
    row = np.arange(n)
    for step in range(1, steps + 1):
        weights, gaps = theta[:m], np.exp(theta[m + 1 :])
        thresholds = theta[m] + np.concatenate([[0], np.cumsum(gaps)])
        up = np.concatenate([np.ones((n, 1)), sigmoid(x.times(weights)[:, None] - thresholds[None, :]), np.zeros((n, 1))], 1)
        here, above = up[row, grade], up[row, grade + 1]
        share = np.maximum(here - above, 1e-12)
        slope_here, slope_above = here * (1 - here) / share, above * (1 - above) / share
        of_logit = -(slope_here - slope_above) / n
        of_threshold = np.zeros(grades + 2)
        np.add.at(of_threshold, grade, slope_here / n)
        np.add.at(of_threshold, grade + 1, -slope_above / n)
        of_threshold = of_threshold[1 : grades + 1]
        tail = np.cumsum(of_threshold[::-1])[::-1]
        gradient = np.concatenate([x.transposed_times(of_logit) + ridge * weights, [tail[0]], tail[1:] * gaps])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        theta[:m] = np.maximum(theta[:m], floor)
    return theta[:m], theta[m] + np.concatenate([[0], np.cumsum(np.exp(theta[m + 1 :]))])


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The rows of ``docs`` with ``severity`` (expected, 0 to 3) and ``rejected``; null and empty texts hold no toxic word.

    Repeated rows are each rated; a very long text is rated whole; columns named like a result give way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        m = shared.value
        row, place, count = _word_counts(*text_bytes(column(batch, text)), m.features)
        logit = np.bincount(row, m.weights[place] * np.log1p(count), batch.num_rows) if len(row) else np.zeros(batch.num_rows)
        severity = m.severity(logit)
        return [pa.array(severity), pa.array(severity >= REJECT_AT)]

    return map_text(docs, compute, "severity double, rejected boolean", text, () if keep_text else (text,))
