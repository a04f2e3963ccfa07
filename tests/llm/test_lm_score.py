import math
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ascii_lower, fold, make_docs, words
from tramwise.llm import attention, lm_score
from tramwise.llm.attention import Layout, Model, Shape
from tramwise.llm.frequent import distinct


def brute_base(rows):
    """{id: (tokens, known, training tokens, base)} from (id, text) pairs."""
    told = {i: [*words(ascii_lower(t)), None] for i, t in rows}
    counts = Counter(w for i, own in told.items() if fold(i, 5) != 1 for w in own)
    total, different = sum(counts.values()), len(counts)
    found = {}
    for i, own in told.items():
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (different + 1))) for w in own)
        found[i] = (len(own), sum(counts[w] > 0 for w in own), total, base)
    return found


def same(rows, expected):
    for r in rows:
        n, known, total, base = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.held_out == (fold(r.doc_id, 5) == 1) and r.score < 0


@pytest.mark.parametrize("frequent", [lm_score.FREQUENT, 100])
def test_base_as_brute_force(small, small_docs, frequent):
    rows = lm_score.score_texts(small("documents"), frequent=frequent).collect()
    assert len(rows) == len(small_docs)
    same(rows, brute_base(zip(small_docs.doc_id, small_docs.text)))


def test_model_learns_what_held_out_texts_need(larger):
    """Better than the same model before it learned, and than counted words where all are known.

    The base gives every unknown word the probability of a single one, whatever its
    letters; the model spells it.
    """
    docs = larger("documents")
    found = lm_score.score_texts(docs, shape=Shape(slots=16)).where("held_out")
    idle = lm_score.score_texts(docs, shape=Shape(rounds=0)).where("held_out")
    assert found.agg(F.sum("score")).first()[0] > idle.agg(F.sum("score")).first()[0]
    known = found.where("n_known = n_tokens").agg(F.sum("score"), F.sum("base_score")).first()
    assert known[0] > 0.97 * known[1]


@pytest.mark.parametrize("shape", [Shape(), Shape(slots=3, rounds=2)])
def test_every_training_window_learns_once(spark, shape):
    draw = np.random.default_rng(11)
    sizes = draw.integers(1, 200, 60)
    ids = [draw.integers(0, 20, n, np.int32).tobytes() for n in sizes]
    rows = [(i, i % 5 != 1, own) for i, own in enumerate(ids)]
    told = spark.createDataFrame(rows, "row long, learn boolean, pieces binary")
    held = spark.sparkContext.broadcast(lm_score.initial_model(told, 25, shape))
    found = Counter()
    for turn in range(shape.rounds):
        for r in lm_score.training_windows(told, held, turn).collect():
            assert len(r.ids) == 4 * r.size
            found[bytes(r.ids)] += 1
    expected = Counter()
    for _, learn, own in rows:
        if learn:
            _, _, begin, places = attention.windows(np.array([len(own) // 4]), shape)
            expected.update(own[4 * b : 4 * (b + n)] for b, n in zip(begin, places))
    assert found == expected


def test_reruns_agree(small):
    one, two = (
        {r.doc_id: r.score for r in lm_score.score_texts(small("documents")).collect()} for _ in range(2)
    )
    assert one == pytest.approx(two, rel=1e-9)


def test_odd_rows(odd, no_docs, spark):
    rows = lm_score.score_texts(odd).collect()
    assert len(rows) == odd.count()
    assert {(r.n_tokens, r.held_out) for r in rows if r.doc_id in (2, 3, 4)} <= {(1, True), (1, False)}
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert lm_score.score_texts(no_docs).count() == 0
    # Nothing to learn from: all ids are equally likely.
    only = [(i, "a b") for i in range(40) if fold(i, 5) == 1]
    rows = lm_score.score_texts(make_docs(spark, only)).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in rows} == {(3, 0, 0)}
    assert {round(r.score, 6) for r in rows} == {round(-3 * math.log10(32001), 6)}


# -- the model ----------------------------------------------------------------


@pytest.fixture
def model():
    draw = np.random.default_rng(3)
    counts = np.r_[draw.integers(1, 50, 20), np.zeros(5, int)]
    layout = Layout(counts)
    shape = Shape(window=8, stride=5, pairs=16)
    v, c = len(layout.members), layout.number
    made = Model(layout, draw.integers(0, 9, (v + 2, c)), draw.integers(0, 9, (c + 2, v)), shape)
    for name, w in made.weights.items():
        made.weights[name] = (draw.standard_normal(w.shape) * 0.4).astype(np.float32)
    return made


def probabilities(model, before, last):
    """Of every id, after one sequence of inputs."""
    h, _ = model.hidden(before, last)
    n = len(model.layout.counts)
    own = np.repeat(h[0, -1][None], n, 0)
    return np.exp(model.log_probability(own, np.full(n, last[0, -1]), np.arange(n)))


def test_probabilities_add_up(model):
    draw = np.random.default_rng(4)
    for n in (1, 4, 8):
        last = draw.integers(0, 20, (1, n))
        assert probabilities(model, draw.integers(0, 20, (1, n)), last).sum() == pytest.approx(1, abs=1e-5)


def test_no_place_sees_a_later_one(model):
    draw = np.random.default_rng(5)
    before, last = draw.integers(0, 20, (2, 3, 8))
    whole, _ = model.hidden(before, last)
    for n in range(1, 8):
        part, _ = model.hidden(before[:, :n], last[:, :n])
        assert np.allclose(part, whole[:, :n], atol=1e-5)


def test_gradients_as_differences(model):
    for name, w in model.weights.items():
        model.weights[name] = w.astype(np.float64)
    model.class_logits = model.class_logits.astype(np.float64)
    model.blocks = [b.astype(np.float64) for b in model.blocks]
    draw = np.random.default_rng(6)
    before, last = draw.integers(0, 20, (2, 4, 6))
    target, inside = draw.integers(0, 25, (4, 6)), draw.random((4, 6)) < 0.8
    _, _, found = model.gradients(before, last, target, inside)

    def value():
        h, _ = model.hidden(before, last)
        return model.log_probability(h[inside], last[inside], target[inside]).sum()

    for name, g in found.items():
        w = model.weights[name]
        if isinstance(g, tuple):
            whole = np.zeros(w.shape)
            whole[g[0]] = g[1]
            g = whole
        for at in zip(*(draw.integers(0, s, 6) for s in w.shape)):
            held, step = w[at], 1e-3
            w[at] = held + step
            up = value()
            w[at] = held - step
            down = value()
            w[at] = held
            assert g[at] == pytest.approx((up - down) / (2 * step), abs=2e-2, rel=2e-2), name


def test_weights_step_together_as_each_alone(model):
    draw = np.random.default_rng(9)
    before = {name: w.copy() for name, w in model.weights.items()}
    learner = attention.Learner(model)
    past = {name: np.full(w.shape, 1e-4) for name, w in before.items()}
    for _ in range(3):
        last, target = draw.integers(0, 20, (2, 4, 6))
        _, tokens, found = model.gradients(draw.integers(0, 20, (4, 6)), last, target, draw.random((4, 6)) < 0.8)
        for name, g in found.items():
            rows, g = g if isinstance(g, tuple) else (slice(None), g)
            past[name][rows] += (g / tokens) ** 2
            before[name][rows] += 0.1 * g / tokens / past[name][rows] ** 0.5
        learner.step(found, tokens, 0.1)
    for name, w in model.weights.items():
        assert np.allclose(w, before[name], atol=1e-5), name


@pytest.mark.parametrize("length", [1, 40])
def test_small_classes_are_computed_together(length):
    """Fewer products than classes, and the logs that a softmax over each class alone gives."""
    draw = np.random.default_rng(8)
    layout = Layout(np.r_[20_000 // np.arange(1, 401), np.zeros(3, int)])
    v, c = len(layout.members), layout.number
    model = Model(layout, draw.integers(0, 9, (v + 2, c)), draw.integers(0, 9, (c + 2, v)), Shape(pairs=16))
    several = np.flatnonzero(np.diff(layout.cuts) > 1).tolist()
    assert [i for first, end in model.groups for i in range(first, end)] == several
    assert len(model.blocks) == len(model.groups) < len(several) / 1.5
    for name in ("class", "token"):
        model.weights[name] = draw.standard_normal(model.weights[name].shape).astype(np.float32)
    h = draw.standard_normal((300, model.shape.width)).astype(np.float32) * length
    assert model.far(h) == (length > 1)
    last, target = draw.integers(0, v + 2, 300), draw.integers(0, layout.size, 300)
    found = model.log_probability(h, last, target)

    def log_share(logits, i):
        logits = np.clip(logits.astype(np.float64), -60, 60)
        return logits[i] - np.log(np.exp(logits).sum())

    for own, l, t, told in zip(h, last, target, found):
        k = layout.classes[t]
        expected = log_share(own @ model.weights["class"] + model.class_logits[l], k)
        if k == c - 1:
            expected -= np.log(layout.unseen)
        elif k in several:
            first, block = next((f, b) for (f, e), b in zip(model.groups, model.blocks) if f <= k < e)
            span, begin = layout.span(k), layout.cuts[first]
            fixed = block[(k - first) * (c + 2) + model.kinds[l], span.start - begin : span.stop - begin]
            expected += log_share(model.weights["token"][span] @ own + fixed, layout.place[t] - span.start)
        assert told == pytest.approx(expected, rel=1e-4, abs=1e-4)


@pytest.mark.parametrize("keys", [[], [7], [5, 3, 5, -2, 3, 9]])
def test_distinct_keys(keys):
    keys = np.array(keys, np.int64)
    own, first, which = distinct(keys)
    for found, expected in zip((own, first, which), np.unique(keys, return_index=True, return_inverse=True)):
        assert found.tolist() == expected.tolist()


def test_words_are_remembered_for_two_generations(monkeypatch):
    """What is known is neither encoded nor stored again; what falls out is encoded as before."""
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        subwords = lm_score.Subwords(f.read())
    encoded = []
    model = subwords.model
    subwords.model = SimpleNamespace(encode=lambda texts, **k: encoded.extend(texts) or model.encode(texts, **k))
    monkeypatch.setattr(lm_score, "REMEMBERED", 2)
    plain = lambda *words: [np.array(model.encode(w.decode()), np.int32).tobytes() for w in words]
    long = b"a" * (lm_score.SHORT + 1)
    for asked, new in [
        ((b"one", b"two"), ["one", "two"]),
        ((b"two", b"three"), ["three"]),  # three are held: a new generation
        ((b"one", b"four", long), ["four", long.decode()]),
        ((b"one", b"four", long), [long.decode()]),
        ((b"five", b"two"), ["five"]),  # again: one, four, five and two are the older ones
        ((b"three", b"one"), ["three"]),
    ]:
        encoded.clear()
        assert subwords(list(asked)) == plain(*asked)
        assert encoded == new


def test_every_token_is_scored_once(model):
    """The score by windows is that of each token after the places before it in its window."""
    draw = np.random.default_rng(7)
    sizes = np.array([1, 0, 8, 9, 30])
    ids = draw.integers(0, 25, sizes.sum())
    none, all_ = np.zeros(len(ids)), np.ones(len(ids))
    found = attention.score(model, ids, sizes, none, all_)
    texts = attention.Texts(model, ids, sizes)
    for k, size in enumerate(sizes):
        total = 0.0
        for i in range(size):
            begin = 0 if i < 8 else ((i - 8) // 5 + 1) * 5
            where = slice(texts.first[k] + begin, texts.first[k] + i + 1)
            own = probabilities(model, texts.before[None, where], texts.last[None, where])
            total += math.log10(own[ids[texts.first[k] + i]])
        assert found[k] == pytest.approx(total, rel=1e-4, abs=1e-6)


def test_counted_shares_leave_the_rest_to_the_model(spark):
    rows = [(i, text) for i, text in enumerate(["anaconda " * 9 + "analog", "anaconda analog"] * 6)]
    docs = make_docs(spark, rows)
    starts = spark.sparkContext.broadcast(np.array([True, False, False, True]))
    ids = np.array([0, 1, 0, 2, 0, 1, 3], np.int32)
    before, keys = lm_score.beginnings(ids, np.array([7]), starts.value)
    assert len(set(before[[0, 2, 4, 6]].tolist())) == 1 and len(set(before[[1, 3, 5]].tolist())) == 1
    assert keys[1] == keys[5] != keys[3] and before[0] != before[1]
    found = lm_score.score_texts(docs).collect()
    assert all(math.isfinite(r.score) for r in found)


def test_rare_continuations_count_as_frequent_ones(small, odd):
    """What is joined gives the score of what is broadcast, and not that of the model alone."""
    for docs, frequent in ((small("documents"), 100), (odd, 0)):
        whole, some = (lm_score.score_texts(docs, frequent=n).collect() for n in (lm_score.FREQUENT, frequent))
        key = lambda r: (r.doc_id is None, r.doc_id, r.n_tokens, r.base_score, r.score)
        assert [r.score for r in sorted(some, key=key)] == pytest.approx([r.score for r in sorted(whole, key=key)], rel=1e-6)


@pytest.mark.parametrize("frequent", [lm_score.FREQUENT, 3, 0])
def test_scores_as_brute_force_from_counts(spark, frequent):
    """Shares by counted dictionaries, with held-out texts that go on as no training text does."""
    draw = np.random.default_rng(12)
    opens = np.arange(12) < 5
    texts = [draw.integers(0, 12, n).astype(np.int32) for n in draw.integers(0, 12, 60)]
    rows = [(i, i, i % 3 > 0, i % 3 == 0, 0, 0, 0.0, [], [], t.tobytes()) for i, t in enumerate(texts)]
    told = spark.createDataFrame(rows, lm_score.TOKENS)

    def places(ids):
        word = ()
        for i, own in enumerate(ids.tolist()):
            word = () if i == 0 or opens[own] else word
            yield word, own
            word += (own,)

    counts, whole, different = Counter(), Counter(), Counter()
    for i, ids in enumerate(texts):
        if i % 3:
            counts.update(places(ids))
    for (word, _), n in counts.items():
        whole[word] += n
        different[word] += 1
    model = lm_score.initial_model(told, 12, Shape())
    starts, held = (spark.sparkContext.broadcast(x) for x in (opens, model))
    shares, others = lm_score.counted_shares(told, starts, frequent)
    assert shares.others == (frequent < len(counts))
    found = lm_score.scored(told, held, starts, spark.sparkContext.broadcast(shares))
    gain = Counter()
    for r in lm_score.gains(found, others).collect():
        gain[r.row] += r.gain
    lacking = 0
    for r in found.collect():
        ids = texts[r.row]
        logs = attention.logs(model, ids, np.array([len(ids)]))
        expected = 0.0
        for (word, own), log in zip(places(ids), logs):
            n, w = counts[word, own], whole[word]
            lacking += w > 0 and n == 0
            share, rest = ((n - 0.8) / w if n else 0, 0.8 * different[word] / w) if w else (0, 1)
            expected += math.log10(share + rest * math.exp(log))
        assert r.score + gain[r.row] == pytest.approx(expected, rel=1e-9, abs=1e-9)
    assert lacking > 5
