"""Toxicity: character n-grams scaled by naive Bayes log-count ratios.

A feature is whether an n-gram occurs in a text. Its value is the log ratio of the
n-gram's smoothed share among toxic and other texts; a logistic regression weighs
these values. Features that say little about the label are left out of the model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramwise.llm.common import (
    bounded_sample,
    char_grams,
    crc_fold,
    label_counts,
    per_row,
    row_slices,
    sigmoid,
    small_batches,
    stage,
)

#: Labelled rows of each class that the model is fitted on, at most.
SAMPLE_PER_CLASS = 3000
SAMPLE_TASKS = 8
FOLDS = 5
HELD_OUT_FOLD = 0


#: The features are hashes of this many bits; a table of FILTER bits sifts them.
BITS = 40
FILTER = 22


@dataclass(frozen=True)
class Grams:
    """What the features are and how the weights are fitted."""

    orders: tuple[int, ...] = (4, 5, 6, 7)
    features: int = 50_000  # of all, those whose ratio is surest
    least_rows: int = 4  # sampled texts that a feature must occur in
    decay: float = 3e-5
    steps: int = 8
    inner: int = 12


class Features:
    """Finds the chosen n-grams in texts."""

    def __init__(self, chosen: np.ndarray, orders: tuple[int, ...]):
        self.chosen, self.orders = chosen, orders  # sorted
        self.sieve = np.zeros(1 << FILTER, bool)
        self.sieve[chosen & ((1 << FILTER) - 1)] = True

    def __call__(self, texts: list[str]):
        """Distinct (row, position of the feature) pairs, sorted."""
        grams, owner = char_grams(texts, self.orders, BITS)
        maybe = np.flatnonzero(self.sieve[grams & ((1 << FILTER) - 1)])
        grams, owner = grams[maybe], owner[maybe]
        at = np.searchsorted(self.chosen, grams)
        hit = at < len(self.chosen)
        hit[hit] = self.chosen[at[hit]] == grams[hit]
        rows, at, _ = per_row(at[hit], owner[hit], BITS)
        return rows, at


def newton(row, col, value, y, width: int, how: Grams) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, each solved by conjugate gradients."""
    n = max(len(y), 1)

    def forward(w):
        return np.bincount(row, value * w[:-1][col], len(y)) + w[-1]

    def back(e):
        return np.append(np.bincount(col, value * e[row], width), e.sum()) / n

    decay = np.append(np.full(width, how.decay), 0.0)

    def loss(w, z):
        return np.mean(np.logaddexp(0, z) - y * z) + 0.5 * (decay * w) @ w

    w = np.zeros(width + 1)
    if not len(y):
        return w[:-1], 0.0
    z = forward(w)
    for _ in range(how.steps):
        p = sigmoid(z)
        g = back(p - y) + decay * w
        if np.abs(g).max() < 1e-7:
            break
        curve = p * (1 - p)
        d, r = np.zeros_like(w), -g
        s, rr = r.copy(), r @ r
        for _ in range(how.inner):
            hs = back(curve * forward(s)) + decay * s + 1e-9 * s
            a = rr / (s @ hs)
            d, r = d + a * s, r - a * hs
            s, rr = r + (r @ r) / rr * s, r @ r
            if rr < 1e-4 * (g @ g):
                break
        now, dz, t = loss(w, z), forward(d), 1.0
        while t > 1e-3 and loss(w + t * d, z + t * dz) > now + 1e-4 * t * (g @ d):
            t /= 2
        w, z = w + t * d, z + t * dz
    return w[:-1], float(w[-1])


def _lower(column) -> list[str]:
    return [(t or "").lower() for t in column.to_pylist()]


def gram_counts(sample: DataFrame, how: Grams) -> DataFrame:
    """(gram, p, q): how many toxic and other sampled texts an n-gram occurs in."""

    def count(batches):
        for batch in batches:
            texts = _lower(batch.column("text"))
            toxic = np.array(batch.column("y").to_pylist(), np.int64)
            for a, b in row_slices(texts):
                grams, owner = char_grams(texts[a:b], how.orders, BITS)
                rows, grams, _ = per_row(grams, owner, BITS)
                grams, at = np.unique(grams, return_inverse=True)
                p = np.bincount(at, toxic[a:b][rows], len(grams)).astype(np.int64)
                q = np.bincount(at, minlength=len(grams)) - p
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams), pa.array(p), pa.array(q)], ["gram", "p", "q"]
                )

    return (
        sample.mapInArrow(count, "gram long, p long, q long")
        .groupBy("gram")
        .agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
        .where(F.col("p") + F.col("q") >= how.least_rows)
    )


def choose(counts: DataFrame, how: Grams) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams with the surest log-count ratios, and those ratios, both smoothed by 1."""
    p, q = F.col("p") + 1, F.col("q") + 1
    all_p, all_q = counts.select(F.sum(p), F.sum(q)).first()
    ratio = F.log(p / float(all_p or 1)) - F.log(q / float(all_q or 1))
    top = (
        counts.select("gram", ratio.alias("ratio"), (F.abs(ratio) / F.sqrt(1 / p + 1 / q)).alias("sure"))
        .orderBy(F.desc("sure"), "gram")
        .limit(how.features)
        .collect()
    )
    top.sort(key=lambda r: r.gram)
    return np.array([r.gram for r in top], np.int64), np.array([r.ratio for r in top], float)


def train(docs: DataFrame, labels: DataFrame, how: Grams, n: int):
    """Features, weights and intercept from the labelled rows given.

    At most ``n`` rows of each class are used, so the log-odds of all labelled rows
    take the place of those of the sample.
    """
    wanted = F.broadcast(bounded_sample(labels, "doc_id", "label", n))
    sample = stage(
        docs.select(F.col("doc_id").cast("long"), "text")
        .join(wanted, "doc_id")
        .select("doc_id", "y", "text")
        .repartition(SAMPLE_TASKS),
        "toxicity-sample",
    )
    chosen, ratio = choose(stage(gram_counts(sample, how), "toxicity-grams"), how)
    find = Features(chosen, how.orders)

    def compute(batches):
        for batch in batches:
            ids, y = batch.column("doc_id"), batch.column("y")
            texts = _lower(batch.column("text"))
            for a, b in row_slices(texts):
                rows, at = find(texts[a:b])
                cut = np.searchsorted(rows, np.arange(b - a + 1))
                held = [at[i:j].astype("<i4").tobytes() for i, j in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), y.slice(a, b - a), pa.array(held, pa.binary())],
                    ["doc_id", "y", "found"],
                )

    rows = (
        sample.mapInArrow(compute, "doc_id long, y int, found binary")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y", "found")
        .limit(2 * n)
        .collect()
    )
    y = np.array([r.y for r in rows], float)
    found = [np.frombuffer(r.found, "<i4") for r in rows]
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    col = np.concatenate([*found, np.zeros(0, np.int32)])
    w, b = newton(row, col, ratio[col], y, len(chosen), how)
    none, some = label_counts(labels, "label")
    shift = np.log((some + 1) / (none + 1)) - np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    return chosen, w * ratio, float(b + shift)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    how: Grams = Grams(),
    sample_per_class: int = SAMPLE_PER_CLASS,
    threshold: float = 0.5,
) -> DataFrame:
    """Score every whole text; learn from labels outside the held-out fold.

    ``labels`` has doc_id and toxic (0, 1; other values are ignored). Columns:
    doc_id, held_out, score, predicted. Texts that are NULL or empty get the score
    of the intercept; without labels every score is 0.5; repeated documents get the
    same score; rows with a NULL id are scored but never learned from. Other columns
    are not read.
    """
    small_batches(docs.sparkSession)
    learned = labels.select("doc_id", F.col("toxic").alias("label")).where(
        crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT_FOLD
    )
    chosen, weights, intercept = train(docs, learned, how, sample_per_class)
    held = docs.sparkSession.sparkContext.broadcast((chosen, weights))  # `features` numbers

    def score(batches):
        chosen, w = held.value
        find = Features(chosen, how.orders)
        for batch in batches:
            texts = _lower(batch.column("text"))
            total = np.zeros(len(texts))
            for a, b in row_slices(texts):
                rows, at = find(texts[a:b])
                total[a:b] = np.bincount(rows, w[at], b - a)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sigmoid(total + intercept))], ["doc_id", "score"]
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
