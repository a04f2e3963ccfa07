"""Quality scores: hashed word n-grams, logistic regression by FTRL updates.

A token is a run of letters and digits or a run of other signs. Features are the
hashes of tokens, of neighbouring pairs, of pairs of token shapes (capitals, digits,
signs) and a mark for a token that repeats the one before it. A document's value
for a feature is 1 + log(count), scaled to a vector of length one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramwise.llm.common import (
    bounded_sample,
    crc_fold,
    label_counts,
    mix,
    per_row,
    sigmoid,
    small_batches,
    span_hashes,
    text_slices,
)

#: Labelled rows of each class that the model is fitted on, at most.
SAMPLE_PER_CLASS = 3000
FOLDS = 5
HELD_OUT_FOLD = 0

_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_CLASS = np.full(256, 2, np.uint8)  # signs
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


@dataclass(frozen=True)
class Ftrl:
    """Settings of follow-the-regularised-leader."""

    bits: int = 19
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-4
    passes: int = 4


def features(data: np.ndarray, bounds: np.ndarray, bits: int):
    """(rows, features, values) of a slice of texts."""
    kind = _CLASS[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[bounds] = True
    cuts = np.flatnonzero(edge)
    begin, end = cuts[:-1], cuts[1:]
    word = kind[begin] > 0
    begin, end = begin[word], end[word]
    row = np.searchsorted(bounds, begin, "right") - 1
    token = span_hashes(data, begin, end)
    upper = np.r_[0, np.cumsum(_UPPER[data])]
    digit = np.r_[0, np.cumsum(_DIGIT[data])]
    n_upper, size = upper[end] - upper[begin], end - begin
    shape = np.where(n_upper == size, 1, np.where(n_upper > 0, 2, 0))
    shape = np.where(digit[end] > digit[begin], 3, shape)
    shape = np.where(kind[begin] == 2, 4 + np.minimum(size, 3), shape).astype(np.uint64)
    pair = np.flatnonzero(row[1:] == row[:-1])
    again = pair[token[pair] == token[pair + 1]]
    near = token[pair] * np.uint64(3) + token[pair + 1] * np.uint64(0x9E3779B97F4A7C15)
    shapes = shape[pair] * np.uint64(8) + shape[pair + 1] + np.uint64(1 << 20)
    hashes = np.concatenate([token, mix(near), mix(shapes), mix(np.full(len(again), 77, np.uint64))])
    owner = np.concatenate([row, row[pair], row[pair], row[again]])
    ids = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    rows, ids, times = per_row(ids, owner, bits)
    values = 1 + np.log(times)
    length = np.bincount(rows, values**2, len(bounds) - 1)
    return rows, ids, values / np.sqrt(length[rows])


def fit(examples: list[tuple[int, np.ndarray, np.ndarray]], how: Ftrl) -> np.ndarray:
    """Weights, the last being the intercept, after some passes over (y, ids, values)."""
    z = np.zeros((1 << how.bits) + 1)
    n = np.zeros_like(z)

    def weights(at):
        own, seen = z[at], n[at]
        shrunk = np.sign(own) * np.maximum(np.abs(own) - how.l1, 0)
        return -shrunk / ((how.beta + np.sqrt(seen)) / how.alpha + how.l2)

    for _ in range(how.passes):
        for y, ids, values in examples:
            at, x = np.append(ids, len(z) - 1), np.append(values, 1.0)
            w = weights(at)
            g = (sigmoid(w @ x) - y) * x
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / how.alpha * w
            n[at] = grown
    return weights(np.arange(len(z))).astype(np.float32)


def _sample_features(docs: DataFrame, wanted: DataFrame, how: Ftrl, n: int) -> list:
    """Features of the sampled documents, in an order that does not vary."""

    def compute(batches):
        for batch in batches:
            ids, y = batch.column("doc_id"), batch.column("y")
            for first, data, bounds in text_slices(batch.column("text")):
                rows, found, values = features(data, bounds, how.bits)
                size = len(bounds) - 1
                cut = np.searchsorted(rows, np.arange(size + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, size),
                        y.slice(first, size),
                        pa.array([found[a:b].astype("<i4").tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                        pa.array([values[a:b].astype("<f4").tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                    ],
                    ["doc_id", "y", "ids", "weights"],
                )

    rows = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .join(F.broadcast(wanted), "doc_id")
        .select("doc_id", "y", "text")
        .mapInArrow(compute, "doc_id long, y int, ids binary, weights binary")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y", "ids")
        .limit(2 * n)
        .collect()
    )
    return [(r.y, np.frombuffer(r.ids, "<i4"), np.frombuffer(r.weights, "<f4")) for r in rows]


def train(docs: DataFrame, labels: DataFrame, how: Ftrl, n: int) -> tuple[np.ndarray, float]:
    """Weights and what to add to the log-odds, from the labelled rows given.

    The fit sees at most ``n`` rows of each class, so it adds the log-odds of
    all labelled rows in place of those of the sample.
    """
    examples = _sample_features(docs, bounded_sample(labels, "doc_id", "label", n), how, n)
    none, some = label_counts(labels, "label")
    ones = sum(y for y, _, _ in examples)
    prior = np.log((some + 1) / (none + 1))
    return fit(examples, how), float(prior - np.log((ones + 1) / (len(examples) - ones + 1)))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    how: Ftrl = Ftrl(),
    sample_per_class: int = SAMPLE_PER_CLASS,
    threshold: float = 0.3,
) -> DataFrame:
    """Score every whole text; learn from labels outside the held-out fold.

    ``labels`` has doc_id and quality (0, 1; other values are ignored). Columns:
    doc_id, held_out, score, predicted. Texts that are NULL or empty get the score
    of the intercept; without labels every score is 0.5; repeated documents get the
    same score; rows with a NULL id are scored but never learned from. Other columns
    are not read.
    """
    small_batches(docs.sparkSession)
    learned = labels.select("doc_id", F.col("quality").alias("label")).where(
        crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT_FOLD
    )
    weights, offset = train(docs, learned, how, sample_per_class)
    held = docs.sparkSession.sparkContext.broadcast(weights)  # 2**bits numbers

    def score(batches):
        w = held.value
        for batch in batches:
            found = []
            for _, data, bounds in text_slices(batch.column("text")):
                rows, ids, values = features(data, bounds, how.bits)
                total = np.bincount(rows, w[ids] * values, len(bounds) - 1)
                found.append(sigmoid(total + w[-1] + offset))
            score = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score)], ["doc_id", "score"]
            )

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        score, "doc_id long, score double"
    )
    return scored.select(
        "doc_id",
        F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT_FOLD, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
