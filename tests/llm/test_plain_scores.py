"""Scores of whole tables against plain Python, text by text, from the same weights."""

import math
from itertools import groupby

import numpy as np
import pytest

from tramwise.llm import common, language_id, quality, toxicity

MASK = 2**64 - 1


def mixed(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & MASK
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & MASK
    return h ^ h >> 31


def grams(text, orders, bits):
    """Feature numbers of the character n-grams of a text, one by one."""
    codes = [ord(c) for c in f" {text} "]
    for n in orders:
        for i in range(len(codes) - n + 1):
            total = n * 0x632BE5AB
            for c in codes[i : i + n]:
                total = (total * common._BASE + c) & MASK
            yield mixed(total) >> 64 - bits


@pytest.fixture
def caught(monkeypatch):
    """What a module's ``train`` returned."""

    def watch(module):
        held, plain = {}, module.train

        def train(*args):
            held["model"] = plain(*args)
            return held["model"]

        monkeypatch.setattr(module, "train", train)
        return held

    return watch


def short(docs, n=60):
    return docs[docs.text.str.len() < 1500].head(n)


def test_languages(small, small_docs, caught):
    held, how = caught(language_id), language_id.Coding()
    found = {r.doc_id: r for r in language_id.identify(small("documents")).collect()}
    model = held["model"]
    for i, text in zip(short(small_docs).doc_id, short(small_docs).text):
        counts: dict = {}
        for g in grams(text.lower(), how.orders, how.bits):
            counts[g] = counts.get(g, 0) + 1
        total = sum(counts.values())
        margins = [
            model.weights[-1][b] + sum(math.sqrt(n / total) * model.weights[g][b] for g, n in counts.items())
            for b in range(model.code.shape[1])
        ]
        losses = {
            lang: sum(
                model.trust[k][b] * math.log1p(math.exp(-how.sharpness * m * model.code[k][b]))
                for b, m in enumerate(margins)
            )
            for k, lang in enumerate(model.languages)
        }
        best, second = sorted(losses, key=losses.get)[:2]
        likely = 1 / sum(math.exp(how.sharpness * (losses[best] - v)) for v in losses.values())
        if any(c.isalpha() for c in text):
            assert (found[i].lang_pred, found[i].runner_up) == (best, second)
            assert found[i].score == pytest.approx(likely, abs=1e-4)
            assert found[i].ambiguous == (losses[second] - losses[best] < how.least_margin)


def test_toxicity(small, small_docs, caught):
    held, how = caught(toxicity), toxicity.Grams()
    found = {r.doc_id: r for r in toxicity.score_toxicity(small("documents"), small("labels")).collect()}
    chosen, weights, intercept = held["model"]
    weight = dict(zip(chosen.tolist(), weights.tolist()))
    for i, text in zip(short(small_docs).doc_id, short(small_docs).text):
        own = set(grams(text.lower(), how.orders, toxicity.BITS))
        total = intercept + sum(weight.get(g, 0.0) for g in own)
        assert found[i].score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)
        assert found[i].predicted == (found[i].score >= 0.5)


def kind(b):
    if b == 0x20 or 9 <= b <= 13:
        return 0
    return 1 if 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128 else 2


def hashed(token):
    data = np.frombuffer(token, np.uint8)
    return int(common.span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def shape(token):
    upper = sum(65 <= b < 91 for b in token)
    if kind(token[0]) == 2:
        return 4 + min(len(token), 3)
    if any(48 <= b < 58 for b in token):
        return 3
    return 1 if upper == len(token) else 2 if upper else 0


def test_quality(small, small_docs, caught):
    held, bits = caught(quality), quality.Ftrl().bits
    found = {r.doc_id: r for r in quality.score_quality(small("documents"), small("labels")).collect()}
    weights, offset = held["model"]
    for i, text in zip(short(small_docs).doc_id, short(small_docs).text):
        tokens = [bytes(t) for k, t in groupby(text.encode(), kind) if k]
        counts: dict = {}
        own = [hashed(t) for t in tokens]
        features = list(own)
        for (x, s), (y, t) in zip(zip(own, tokens), zip(own[1:], tokens[1:])):
            features.append(mixed((x * 3 + y * 0x9E3779B97F4A7C15) & MASK))
            features.append(mixed(shape(s) * 8 + shape(t) + (1 << 20)))
            if x == y:
                features.append(mixed(77))
        for f in features:
            counts[f >> 64 - bits] = counts.get(f >> 64 - bits, 0) + 1
        values = {f: 1 + math.log(n) for f, n in counts.items()}
        length = math.sqrt(sum(v * v for v in values.values())) or 1.0
        total = float(weights[-1]) + offset + sum(float(weights[f]) * v / length for f, v in values.items())
        assert found[i].score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-5)
        assert found[i].predicted == (found[i].score >= 0.3)
