"""Language, toxicity and quality: held-out results, folds, odd rows."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import fold, ids
from tramwise.llm import language_id, quality, toxicity

ALL = [1, 1, 1, 2, 3, 4, 5, 6, 7]


def test_language_of_held_out_documents(small):
    docs = small("documents")
    found = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == docs.count()
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) for r in found)
    assert all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95


def test_language_learns_nothing_from_the_held_out_fold(small):
    docs = small("documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    spoilt = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))
    one = language_id.identify(docs).select("doc_id", "lang_pred", "score")
    two = language_id.identify(spoilt).select("doc_id", "lang_pred", "score")
    assert sorted(one.collect()) == sorted(two.collect())


def test_language_of_odd_rows(odd, no_docs):
    found = language_id.identify(odd).collect()
    assert len(found) == odd.count()
    unknown = {r.doc_id for r in found if r.lang_pred == "und"}
    assert unknown == {2, 3, 4, 6, None} and {r.lang_pred for r in found} == {"und", "en"}
    assert language_id.identify(no_docs).count() == 0
    # Nothing to learn from.
    assert {r.lang_pred for r in language_id.identify(odd, no_docs).collect()} == {"und"}
    kept = language_id.with_known_language(odd)
    assert kept.columns == odd.columns
    assert ids(kept) == [None, 1, 1, 1, 5, 7]
    assert {r.score for r in kept.collect()} == {"clash"}


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 6, 40])
def test_codewords_are_apart(k):
    code = language_id.codewords(k)
    assert len(code) == k
    for a in range(k):
        for b in range(a):
            assert (code[a] != code[b]).any()
    assert all(abs(column.sum()) < k for column in code.T)


def test_ambiguous_between_equal_losses():
    how = language_id.Coding()
    code = language_id.codewords(3)
    model = language_id.Model(["a", "b", "c"], code, np.full(code.shape, 1 / code.shape[1]), None)
    best, score, second, gap = language_id.decode(np.array([code[1], (code[0] + code[2]) / 2]), model, how)
    assert best[0] == 1 and gap[0] > how.least_margin and score[0] > score[1]
    assert {best[1], second[1]} == {0, 2} and gap[1] < how.least_margin


@pytest.mark.parametrize(
    "score, column, threshold, least",
    [(toxicity.score_toxicity, "toxic", 0.5, 0.75), (quality.score_quality, "quality", 0.3, 0.88)],
)
def test_scores(larger, score, column, threshold, least):
    docs, labels = larger("documents"), larger("labels")
    found = score(docs, labels)
    again = score(docs, labels)
    rows = found.collect()
    assert sorted(rows) == sorted(again.collect())
    assert len(rows) == docs.count()
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) for r in rows)
    assert all(r.predicted == int(r.score >= threshold) and 0 <= r.score <= 1 for r in rows)
    truth = {r.doc_id: r[column] for r in labels.collect()}
    right = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean(right) > least


@pytest.mark.parametrize("score, column", [(toxicity.score_toxicity, "toxic"), (quality.score_quality, "quality")])
def test_scores_do_not_see_held_out_labels(small, score, column):
    docs, labels = small("documents"), small("labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    spoilt = labels.withColumn(column, F.when(held, 1 - F.col(column)).otherwise(F.col(column)))
    assert sorted(score(docs, labels).collect()) == sorted(score(docs, spoilt).collect())


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_scores_of_odd_rows(odd, no_docs, labels, score):
    found = score(odd, labels).collect()
    assert len(found) == odd.count()
    assert all(r.score is not None and 0 <= r.score <= 1 for r in found)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert by_id[2] == by_id[3]  # NULL counts as empty
    assert score(no_docs, labels).count() == 0
    unlearned = score(odd, labels.where("false")).collect()
    assert all(abs(r.score - 0.5) < 1e-9 for r in unlearned)


def test_toxic_stems_are_found_in_long_texts(spark):
    rng = np.random.default_rng(3)
    syllables = ["ba", "ke", "mi", "to", "lu", "ren", "sal", "vor"]

    def text(n, bad):
        made = ["".join(rng.choice(syllables, rng.integers(2, 4))) for _ in range(n)]
        if bad:
            made.insert(n // 2, "zwackel" + rng.choice(["", "s", "ung"]))
        return " ".join(made)

    rows = [(i, text(int(rng.integers(5, 400)), i % 3 == 0), i % 3 == 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(b)) for i, _, b in rows], "doc_id long, toxic int")
    found = toxicity.score_toxicity(docs, labels).where("held_out").collect()
    assert np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in found]) > 0.97


def test_ftrl_learns_a_separable_rule():
    rng = np.random.default_rng(0)
    examples = []
    for _ in range(400):
        y = int(rng.random() < 0.5)
        examples.append((y, np.array([y, 2 + rng.integers(5)]), np.array([0.7, 0.7])))
    w = quality.fit(examples, quality.Ftrl(bits=4))
    right = [(w[ids_] @ x + w[-1] > 0) == y for y, ids_, x in examples]
    assert np.mean(right) == 1.0
    assert (w[8:15] == 0).all()


def test_fitting_languages_takes_little_memory_beside_the_vectors():
    draw = np.random.default_rng(3)
    x = draw.random((400, 1 << 13), np.float32)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    y = draw.integers(0, 5, len(x))
    tracemalloc.start()
    try:
        model = language_id.fit(x, y, list("abcde"), language_id.Coding())
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < x.nbytes
    kernel = (x @ x.T).astype(float) + 1.0
    alpha = np.linalg.solve(kernel + 0.05 * np.eye(len(x)), model.code[y])
    assert np.allclose(model.weights, np.vstack([x.T @ alpha, alpha.sum(0)]), atol=1e-6)


def test_fitting_languages_holds_one_matrix_of_rows_by_rows():
    draw = np.random.default_rng(4)
    x = draw.random((2300, 1 << 9), np.float32)
    x = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float16)
    y = draw.integers(0, 5, len(x))
    tracemalloc.start()
    try:
        model = language_id.fit(x, y, list("abcde"), language_id.Coding())
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 1.75 * 8 * len(x) ** 2
    wide = x.astype(np.float32)
    kernel = (wide @ wide.T).astype(float) + 1.0
    alpha = np.linalg.solve(kernel + 0.05 * np.eye(len(x)), model.code[y])
    assert np.allclose(model.weights, np.vstack([wide.T @ alpha, alpha.sum(0)]), atol=1e-6)
    right = np.sign(kernel @ alpha) == model.code[y]
    trust = np.array([right[y == k].mean(0) for k in range(5)]) + 1e-3
    assert np.allclose(model.trust, trust / trust.sum(1, keepdims=True))
