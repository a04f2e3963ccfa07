"""Repeated and missing ids, sizes that change nothing, many copies near the threshold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ids, make_docs, words
from tests.llm.test_text import brute_substrings, results
from tramwise.llm import decontaminate, minhash, mixing, substrings, templates


def test_substrings_of_missing_and_repeated_ids(spark):
    """2,000 rows without an id or with one of four, which share passages."""
    draw = random.Random(4)
    passages = [[f"p{p}w{k}" for k in range(30)] for p in range(40)]
    rows = []
    for n in range(2000):
        own = [f"n{n}w{k}" for k in range(draw.randrange(3, 12))]
        rows.append((draw.choice([None, None, 1, 2, 3, 4]), " ".join([*own, *draw.choice(passages), *own])))
    docs = make_docs(spark, rows)
    marks = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).distinct().collect()
    order = sorted(((r.doc_id is not None, r.doc_id or 0, r.mark), r.text) for r in marks)
    expected = brute_substrings([(k, text) for k, (_, text) in enumerate(order)], 20)
    by_text = {text: expected[k] for k, (_, text) in enumerate(order)}
    found = substrings.remove_repeats(docs).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in found) == sorted(
        (i is not None, i or 0, *by_text[t]) for i, t in rows
    )


@pytest.mark.parametrize("hot", [1, 256])
def test_substrings_shuffle_windows_of_branches_once(spark, monkeypatch, hot):
    """Windows are read from the texts once, but for those of crowded minimizers."""
    monkeypatch.setattr(substrings, "HOT", hot)
    draw = random.Random(5)
    passages = [[f"p{p}w{k}" for k in range(24)] for p in range(6)]
    rows = [
        (n, " ".join([f"n{n}w{k}" for k in range(4)] + draw.choice(passages) + [f"m{n}w{k}" for k in range(4)]))
        for n in range(60)
    ]
    found = substrings.remove_repeats(make_docs(spark, rows))
    if hot == 1:  # no minimizer has more than all windows; the other pass finishes texts
        assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    assert results(found) == brute_substrings(rows, 20)


def test_substrings_with_a_hot_minimizer(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 4)
    rows = [(n, " ".join([f"a{n}"] * (n % 3) + ["same", "words", "all", "over"] * (5 + n % 4))) for n in range(300)]
    docs = make_docs(spark, rows)
    found = results(substrings.remove_repeats(docs, window=8, key=3))
    assert found == brute_substrings(rows, 8)


def test_only_leaking_rows_go(spark):
    text = "what is the name of the river that runs through the old town\nit is the long and winding river of the north"
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    fine = " ".join(f"filler{i}" for i in range(50))
    docs = make_docs(spark, [(None, text), (None, fine), (5, text), (5, fine), (6, fine), (None, None)])
    left = decontaminate.without_leaks(docs, bench)
    assert ids(left) == [None, None, 5, 6] and left.where(F.col("text") == text).count() == 0


def test_clashing_names(spark):
    rows = [(n, f"some words of text {n}") for n in range(30)]
    docs = make_docs(spark, rows, _size="a", _mark="b", copy="c", mark="d", line="e", repeats="f", size="g")
    mix = mixing.mixed_documents(docs)
    assert sorted(mix.columns) == sorted(docs.columns)
    assert {r["_size"] for r in mix.collect()} == {"a"} and mix.schema["copy"].dataType.typeName() == "long"
    left = templates.drop_recurring(docs)
    assert {(r["_mark"], r["mark"], r["line"]) for r in left.collect()} == {("b", "d", "e")}


# -- lines --------------------------------------------------------------------


@pytest.mark.parametrize("n", [10, 1_000, 100_000])
def test_a_template_recurs_at_any_size(spark, n):
    """100 names and 100 towns: all lines but the first go, however many there are."""
    name = F.concat(F.lit("Name"), F.char(65 + F.pmod(F.xxhash64("id"), F.lit(26))), F.char(97 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4))))
    town = F.concat(F.lit("Town"), F.char(65 + F.pmod(F.xxhash64("id", F.lit(2)), F.lit(26))), F.char(97 + F.pmod(F.xxhash64("id", F.lit(3)), F.lit(4))))
    line = F.concat(F.lit("Review written by "), name, F.lit(" from "), town, F.lit(" for our shop"))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), line.alias("text"))
    told = templates.drop_recurring(docs).agg(F.sum("n_dropped"), F.max(F.when(F.col("doc_id") == 0, F.col("n_dropped")))).first()
    assert tuple(told) == (n - 1, 0)


def test_templates_that_share_a_leaf(spark):
    rows = []
    for k in range(12):
        for n in range(15):
            kind = "".join(chr(97 + (k * 7 + j * 3) % 26) for j in range(6))
            rows.append((100 * k + n, f"We wrote about {kind}a {kind}b user{n} {kind}c {kind}d {kind}e"))
    found = {r.doc_id: r.n_dropped for r in templates.drop_recurring(make_docs(spark, rows)).collect()}
    assert found == {i: int(i % 100 > 0) for i, _ in rows}


def test_lines_with_numbers_are_templates(spark):
    rows = [(n, f"Tel 555-{n:04} Fax 556-{n:04}\nown{chr(97 + n)} line {chr(97 + n)} x") for n in range(20)]
    rows += [(100 + n, f"{n} {n + 1} {n * 7}") for n in range(20)]  # numbers alone are none
    found = {r.doc_id: r.n_dropped for r in templates.drop_recurring(make_docs(spark, rows)).collect()}
    assert found == {i: int(0 < i < 20) for i, _ in rows}


def test_long_lines_recur_from_two_documents_on(spark):
    long = " ".join(f"passage{k} of words" for k in range(20))
    own = [" ".join(f"own{n}word{k}" for k in range(100)) for n in range(6)]
    rows = [(n, f"{own[n]}\n{long}") for n in range(3)]
    rows += [(3, f"{own[3]}\nshort line"), (4, f"{own[4]}\nshort line")]
    rows += [(5, own[5]), (6, own[5]), (7, f"{own[5]}\nand a little more")]  # copies of a document
    found = {r.doc_id: r for r in templates.drop_recurring(make_docs(spark, rows)).collect()}
    assert {i: r.n_dropped for i, r in found.items()} == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}
    assert found[1].text == own[1]


# -- near-duplicates ----------------------------------------------------------


def exact_components(texts, k):
    """Components by comparing all sets of shingles, as a matrix of counts."""
    sets = []
    for text in texts:
        own = words(text.lower())
        sets.append({tuple(own[s : s + k]) for s in range(len(own) - k + 1)})
    names = {s: j for j, s in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(sets), len(names)), np.float32)
    for i, s in enumerate(sets):
        has[i, [names[x] for x in s]] = 1
    size = has.sum(1)
    least = list(range(len(sets)))

    def root(x):
        while least[x] != x:
            least[x] = least[least[x]]
            x = least[x]
        return x

    for i in range(len(sets)):
        both = has[i + 1 :] @ has[i]
        near = 100 * both >= 80 * (size[i] + size[i + 1 :] - both)
        for j in np.flatnonzero(near):
            x, y = root(i), root(i + 1 + int(j))
            least[max(x, y)] = min(x, y)
    return {i: root(i) for i in range(len(sets))}


@pytest.mark.parametrize("n", [1200, 3000])
def test_many_copies_near_the_threshold(spark, n):
    """Copies of one text with a few words changed, whose similarity lies around 0.8."""
    draw = random.Random(n)
    base = [f"b{k}" for k in range(100)]
    texts = []
    for _ in range(n):
        own = list(base)
        for at in draw.sample(range(100), draw.choice([1, 2, 3, 3, 4])):
            own[at] = f"x{draw.randrange(10**6)}"
        texts.append(" ".join(own))
    found = minhash.near_duplicates(make_docs(spark, list(enumerate(texts))), minhash.Near(words=4))
    assert {r.doc_id: r.component_id for r in found.collect()} == exact_components(texts, 4)
