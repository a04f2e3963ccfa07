"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1. A linear classifier over hashed
character n-grams predicts each bit. Decoding adds up, over the bits, the logistic
loss of a prediction against a codeword, weighed by how well that classifier does
on that language, and takes the language of least loss. A runner-up whose loss is
close makes the answer ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramwise.llm.common import char_grams, crc_fold, row_slices, small_batches

FOLDS = 4
HELD_OUT_FOLD = 2
UNKNOWN = "und"
#: Features that the fit turns to doubles at a time, and rows that it eliminates.
WIDE, TALL = 512, 128


@dataclass(frozen=True)
class Coding:
    """What the features are, how much is sampled, when an answer is ambiguous."""

    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 13
    per_language: int = 300  # labelled rows of a language, about
    sample: int = 3000  # labelled rows in all, at most
    ridge: float = 0.05
    sharpness: float = 3.0
    least_margin: float = 0.1  # of the loss at stake


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    trust: np.ndarray  # languages x bits, rows add up to 1
    weights: np.ndarray  # features + 1 x bits


def codewords(k: int) -> np.ndarray:
    """Codewords of ``k`` classes: all splits for few, else far-apart random ones."""
    if k < 2:
        return np.zeros((k, 0))
    if k <= 5:
        splits = np.arange(1, 2 ** (k - 1))
        return np.where(splits[None, :] >> np.arange(k)[:, None] & 1, 1.0, -1.0)
    bits = int(np.ceil(10 * np.log2(k)))
    best, most = None, (-1, -1)
    draw = np.random.default_rng(k)
    for _ in range(200):
        code = np.where(draw.random((k, bits)) < 0.5, 1.0, -1.0)
        apart = (bits - code @ code.T) / 2 + bits * np.eye(k)
        mixed = int((np.abs(code.sum(0)) < k).sum())  # a bit must split the classes
        if (mixed, apart.min()) > most:
            best, most = code, (mixed, apart.min())
    return best[:, np.abs(best.sum(0)) < k]


def vectors(texts: list[str], how: Coding) -> np.ndarray:
    """Square roots of the shares of each text's n-grams: rows of length one."""
    ids, owner = char_grams(texts, how.orders, how.bits)
    width = 1 << how.bits
    counts = np.bincount(owner * width + ids, minlength=len(texts) * width)
    counts = counts.reshape(len(texts), width)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def solve(m: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``m`` to the power of -1 times ``target``: by Cholesky's way, in the place of ``m``.

    Only the lower triangle of ``m`` is read, which is positive definite.
    """
    blocks = [slice(a, min(a + TALL, len(m))) for a in range(0, len(m), TALL)]
    for k in blocks:
        below = slice(k.stop, len(m))
        m[k, k] -= m[k, : k.start] @ m[k, : k.start].T
        m[k, k] = np.linalg.cholesky(m[k, k])
        m[below, k] -= m[below, : k.start] @ m[k, : k.start].T
        m[below, k] = np.linalg.solve(m[k, k], m[below, k].T).T
    found = target.copy()
    for k in blocks:
        found[k] = np.linalg.solve(m[k, k], found[k] - m[k, : k.start] @ found[: k.start])
    for k in reversed(blocks):
        found[k] = np.linalg.solve(m[k, k].T, found[k] - m[k.stop :, k].T @ found[k.stop :])
    return found


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], how: Coding) -> Model:
    """Bit classifiers by ridge regression, in its dual form as rows are few.

    ``x`` may be of short floats. One matrix of rows by rows in doubles is held at most.
    """
    code = codewords(len(languages))
    target = code[y]
    wide = x.astype(np.float32, copy=False)
    products = wide @ wide.T
    del wide
    ridged = products.astype(float)
    del products
    ridged += 1.0
    ridged[np.diag_indices(len(x))] += how.ridge
    alpha = solve(ridged, target)
    del ridged
    weights = np.empty((x.shape[1] + 1, code.shape[1]), np.float32)
    # In doubles, a slice of the features at a time: all of them would take a multiple of ``x``.
    for first in range(0, x.shape[1], WIDE):
        some = slice(first, min(first + WIDE, x.shape[1]))
        weights[some] = x[:, some].T.astype(float) @ alpha
    weights[-1] = alpha.sum(0)
    right = np.sign(target - how.ridge * alpha) == target  # the kernel times alpha
    trust = np.array([right[y == k].mean(0) for k in range(len(languages))]) + 1e-3
    return Model(languages, code, trust / trust.sum(1, keepdims=True), weights)


def train(rows: DataFrame, how: Coding) -> Model:
    """Learn from (doc_id, text, lang) rows.

    All rows are counted; a bounded, hash-picked part of each language is fitted.
    """
    counts = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((1, 0)))
    share = max(1, min(how.per_language, how.sample // len(languages)))
    wide = 1 << 40
    bars = F.create_map(
        *[F.lit(v) for k in languages for v in (k, min(wide, wide * share // counts[k]))]
    )

    def compute(batches):
        press = zstandard.ZstdCompressor(level=1)  # most are zeros
        for batch in batches:
            texts = [t.lower() for t in batch.column("text").to_pylist()]
            for a, b in row_slices(texts, rows=64):
                held = [press.compress(v.astype("<f2").tobytes()) for v in vectors(texts[a:b], how)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("lang").slice(a, b - a), pa.array(held, pa.binary())],
                    ["doc_id", "lang", "x"],
                )

    sample = (
        rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(wide)) < bars[F.col("lang")])
        .select("doc_id", "lang", "text")
        .mapInArrow(compute, "doc_id long, lang string, x binary")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "x")
        .limit(how.sample)
        .collect()
    )
    languages = sorted({r.lang for r in sample})
    y = np.array([languages.index(r.lang) for r in sample])
    x = np.empty((len(sample), 1 << how.bits), "<f2")
    opener = zstandard.ZstdDecompressor()
    for row in reversed(range(len(x))):  # each is let go of once it is in the array
        x[row] = np.frombuffer(opener.decompress(sample.pop().x), "<f2")
    return fit(x, y, languages, how)


def decode(margins: np.ndarray, model: Model, how: Coding):
    """(best, score, runner-up, gap) of each row of bit predictions."""
    loss = np.logaddexp(0, -how.sharpness * margins[:, None, :] * model.code[None])
    loss = (loss * model.trust[None]).sum(2)
    order = np.argsort(loss, axis=1, kind="stable")
    least = np.take_along_axis(loss, order, 1)
    best = order[:, 0]
    likely = np.exp(-how.sharpness * (least - least[:, :1]))
    second = order[:, 1] if order.shape[1] > 1 else order[:, 0]
    gap = (least[:, 1] - least[:, 0]) if order.shape[1] > 1 else np.full(len(best), np.inf)
    return best, 1 / likely.sum(1), second, gap


def _predict(docs: DataFrame, learn_from: DataFrame | None, how: Coding, keep: list) -> DataFrame:
    """Predictions, with the columns of ``docs`` named in ``keep`` as kept_0, kept_1, ..."""
    small_batches(docs.sparkSession)
    source = docs if learn_from is None else learn_from
    learned = source.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string")).where(
        (crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT_FOLD)
        & F.col("text").isNotNull()
        & F.col("lang").isNotNull()
    )
    model = train(learned, how)
    whole = "text" in keep
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits x code bits numbers

    def predict(batches):
        m = held.value
        for batch in batches:
            texts = [(t or "").lower() for t in batch.column("text").to_pylist()]
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            names, scores, others, close = [], [], [], []
            for a, b in row_slices(texts, rows=64):
                if not m.languages:
                    best = second = np.zeros(b - a, int)
                    score = gap = np.zeros(b - a)
                else:
                    x = vectors(texts[a:b], how)
                    best, score, second, gap = decode(x @ m.weights[:-1] + m.weights[-1], m, how)
                for i, known in enumerate(letters[a:b]):
                    known = bool(known) and bool(m.languages)
                    names.append(m.languages[best[i]] if known else UNKNOWN)
                    scores.append(float(score[i]) if known else 0.0)
                    others.append(m.languages[second[i]] if known and len(m.languages) > 1 else None)
                    close.append(bool(not known or gap[i] < how.least_margin))
            own = batch.drop_columns(["letters"] if whole else ["text", "letters"])
            made = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(others, pa.string()), pa.array(close, pa.bool_())]
            yield pa.RecordBatch.from_arrays(
                [*own.columns, *made], [*own.schema.names, "lang_pred", "score", "runner_up", "ambiguous"]
            )

    given = docs.select(
        F.col("doc_id").cast("long"),
        *[F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep) if c != "text"],
        "text",
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    own = given.schema.fields[: -1 if whole else -2]
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own)
    return given.mapInArrow(
        predict, f"{shape}, lang_pred string, score double, runner_up string, ambiguous boolean"
    )


def identify(
    docs: DataFrame, learn_from: DataFrame | None = None, how: Coding = Coding()
) -> DataFrame:
    """Predict the language of every whole text.

    ``learn_from`` (by default ``docs``) has doc_id, text and lang; rows of the
    held-out fold and rows with a NULL in one of them are not learned from. Columns:
    doc_id, held_out, lang_pred, score, runner_up, ambiguous. A text that is NULL or has
    no letter is ``und`` with score 0, and so is every text if there is nothing to learn
    from. Repeated documents get the same answer; a NULL id is no obstacle. Other
    columns are not read.
    """
    return _predict(docs, learn_from, how, []).select(
        "doc_id",
        F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT_FOLD, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        "runner_up",
        "ambiguous",
    )


def with_known_language(
    docs: DataFrame, learn_from: DataFrame | None = None, how: Coding = Coding()
) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is found without ambiguity."""
    others = [c for c in docs.columns if c != "doc_id"]
    named = {c: c if c == "text" else f"kept_{i}" for i, c in enumerate(others)} | {"doc_id": "doc_id"}
    found = _predict(docs, learn_from, how, others).where((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous"))
    return found.select(*[F.col(named[c]).alias(c) for c in docs.columns])
