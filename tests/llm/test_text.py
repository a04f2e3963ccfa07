"""Token counts, substrings, near-duplicates, lines, leaks and the mix."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import SMALL, ascii_lower, ids, make_docs, words
from tramwise.llm import decontaminate, minhash, mixing, substrings, templates, token_counts
from tramwise.llm.components import components

# -- token counts -------------------------------------------------------------

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as f:
    MERGER = token_counts.PairMerger(f.read())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"ab  \n\té1９.'", "'s", " the", "<|endoftext|>", "　", "\x1c", "​", "中", "😀", "\xa0"]), max_size=40).map("".join))
def test_token_counts_as_the_library(text):
    assert MERGER.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_documents(small, small_docs, odd, no_docs):
    found = {r.doc_id: r for r in token_counts.count_tokens(small("documents")).collect()}
    for i, text in zip(small_docs.doc_id, small_docs.text):
        n = len(LIBRARY.encode(text, add_special_tokens=False).ids)
        assert (found[i].n_tokens, found[i].n_bytes) == (n, len(text.encode()))
        assert found[i].over_limit == (n > 1024)
    rows = token_counts.count_tokens(odd).collect()
    assert len(rows) == odd.count()
    assert {(r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (2, 3)} == {(0, 0)}
    assert token_counts.count_tokens(no_docs).count() == 0


def test_memory_forgets_the_older_half(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    memory = token_counts.Memory(len)
    assert [memory["x" * n] for n in [*range(20), 19, 18]] == [*range(20), 19, 18]
    assert len(memory) + len(memory.older) <= 6


# -- substrings ---------------------------------------------------------------


def brute_substrings(rows, window):
    """{id: (words, removed, hash)} for rows with distinct ids."""
    seen, told = set(), {}
    for i, text in sorted(rows):
        own = words(text)
        gone = set()
        for s in range(len(own) - window + 1):
            key = tuple(own[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        kept = " ".join(w for k, w in enumerate(own) if k not in gone)
        told[i] = (len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return told


def results(frame):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in frame.collect()}


def test_substrings_as_brute_force(small, small_docs):
    found = results(substrings.remove_repeats(small("documents")))
    assert found == brute_substrings(zip(small_docs.doc_id, small_docs.text), 20)


@pytest.mark.parametrize("alphabet, length", [("ab", 90), ("abcdefgh", 160)])
def test_substrings_of_random_words(spark, alphabet, length):
    import random

    draw = random.Random(length)
    passage = [draw.choice(alphabet) for _ in range(40)]
    rows = []
    for i in range(40):
        own = [draw.choice(alphabet) for _ in range(draw.randrange(length))]
        at = draw.randrange(len(own) + 1)
        cut = draw.randrange(20)
        rows.append((i, " ".join(own[:at] + passage[cut : cut + draw.randrange(21)] + own[at:])))
    found = results(substrings.remove_repeats(make_docs(spark, rows), window=8, key=3))
    assert found == brute_substrings(rows, 8)


def test_substrings_of_odd_rows(odd, no_docs):
    rows = substrings.remove_repeats(odd).collect()
    assert len(rows) == odd.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.n_words, r.n_removed, r.kept_sha256) == (0, 0, empty) for r in rows if r.doc_id in (2, 3, 4))
    assert len({r.kept_sha256 for r in rows if r.doc_id == 1}) == 2
    assert substrings.remove_repeats(no_docs).count() == 0


# -- near-duplicates ----------------------------------------------------------


def brute_components(rows, k, percent=80):
    """{id: (size, least id)}, all pairs compared."""
    sets = {}
    for i, text in rows:
        own = words(ascii_lower(text))
        sets[i] = {tuple(own[s : s + k]) for s in range(len(own) - k + 1)} or ({tuple(own)} if own else set())
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    order = sorted(sets)
    for i in order:
        for j in order:
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def near(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def test_near_duplicates_as_brute_force(small, small_docs):
    frame = minhash.near_duplicates(small("documents"), minhash.Near(words=4))
    assert near(frame) == brute_components(zip(small_docs.doc_id, small_docs.text), 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in frame.collect())


def test_near_duplicates_of_chains(spark):
    """Neighbours of a chain are near, its ends are not; buckets need further rounds."""
    import random

    draw = random.Random(5)
    rows, i = [], 0
    for chain in range(6):
        text = [f"c{chain}w{n}" for n in range(60)]
        for step in range(40):
            rows.append((i, " ".join(text)))
            i += 1
            text = list(text)
            text[draw.randrange(60)] = f"c{chain}s{step}"
    draw.shuffle(rows)
    rows = list(enumerate(t for _, t in rows))
    frame = minhash.near_duplicates(make_docs(spark, rows), minhash.Near(words=2, large=8))
    assert near(frame) == brute_components(rows, 2)


def test_open_buckets_are_settled_in_full(spark, monkeypatch):
    """Two near members far from the bucket's centre, which the rounds leave, are linked."""
    none = spark.createDataFrame([], "v long, part long, u long, before long")
    monkeypatch.setattr(minhash, "_neighbours", lambda *_: none)
    own = [f"w{k}" for k in range(40)]
    texts = [(1, " ".join(own)), (2, " ".join([*own, "x"])), (3, "a b c d e f"), (4, "g h i j k l")]
    reps = spark.createDataFrame([(1, [10]), (2, [10]), (3, [10, 20]), (4, [20])], "doc_id long, keys array<long>")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = minhash.class_components(reps, docs, minhash.Near(words=4))
    assert [tuple(r) for r in found.collect()] == [(2, 1)]


def test_near_duplicates_of_odd_rows(odd, no_docs):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[7].component_id == 1 and not by_id[7].kept
    assert all(by_id[i].component_id == i and by_id[i].n_shingles == 0 for i in (2, 3, 4))
    assert {(r.component_id, r.kept) for r in rows if r.doc_id is None} == {(None, True)}
    left = minhash.without_near_duplicates(odd)
    assert left.columns == odd.columns
    assert ids(left) == [None, None, 1, 1, 1, 2, 3, 4, 5, 6]
    assert minhash.near_duplicates(no_docs).count() == 0


def test_densified_signatures_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    for size in (3, 12, 3000):
        agree = []
        for _ in range(60):
            own = rng.integers(1, 2**63, size + size // 3, dtype=np.uint64)
            sig = minhash.signatures([own[:size], own[size // 3 :]], 180)
            agree.append((sig[0] == sig[1]).mean())
        shared = size - size // 3
        assert abs(np.mean(agree) - shared / (size + size // 3)) < 0.06


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 6), (6, 5), (5, 4), (9, 9), (3, 1), *[(100 + i, 101 + i) for i in range(50)]]
    found = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {2: 1, 3: 1, 5: 4, 6: 4, 7: 4} | {101 + i: 100 for i in range(50)}


# -- lines --------------------------------------------------------------------


def test_lines_of_recurring_templates(spark):
    rows = [(i, f"Own words of text{chr(97 + i)} here\nVisited on day {i} by user {i * 7} in the app\n\nEnd {i}") for i in range(12)]
    docs = make_docs(spark, rows)
    found = {r.doc_id: r for r in templates.drop_recurring(docs).collect()}
    # The first document keeps its lines. A line of one variable field and one constant
    # has too few constants.
    assert found[0].n_dropped == 0 and found[0].text == rows[0][1]
    for i in range(1, 12):
        assert found[i].text == f"\nEnd {i}" and (found[i].n_lines, found[i].n_dropped) == (4, 2)
    rare = templates.drop_recurring(docs, templates.Tree(documents=13)).collect()
    assert all(r.n_dropped == 0 for r in rare)


def test_lines_repeated_in_one_document_only(spark):
    docs = make_docs(spark, [(1, "\n".join(["the same line again"] * 30))])
    assert templates.drop_recurring(docs).first().n_dropped == 0


def test_lines_of_odd_rows(odd, no_docs):
    found = templates.drop_recurring(odd)
    rows = found.collect()
    assert set(odd.columns) <= set(found.columns) and len(rows) == odd.count()
    assert {(r.text, r.n_lines) for r in rows if r.doc_id in (2, 3)} == {(None, 0), ("", 1)}
    assert templates.drop_recurring(no_docs).count() == 0


def test_lines_run_no_python(small):
    plan = templates.drop_recurring(small("documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- leaks --------------------------------------------------------------------

ITEMS = [
    (1, "what is the name of the river that runs through the old town\nit is the long and winding river of the north"),
    (2, "a single line of words that make up one item without any answer at all"),
    (3, "too short"),
    (3, "too short"),
    (4, None),
    (5, " "),
    (None, "an item without an id is found as well as any other one"),
]


def test_leaks(spark, no_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    filler = " ".join(f"filler{i}" for i in range(300))
    rows = [
        (1, f"{filler} {ITEMS[0][1].upper()} {filler}"),
        (2, f"{filler} {ITEMS[0][1].splitlines()[0]} {filler}"),  # the question only
        (3, ITEMS[1][1]),
        (4, ITEMS[1][1].replace("without", "with")),  # 5 of 10 shingles lost
        (5, f"this is too short {filler}"),
        (6, filler),
        (None, f"{filler} {ITEMS[6][1]}"),
        (7, None),
        (8, ""),
    ]
    docs = make_docs(spark, rows, item_id="clash")
    for how in (decontaminate.Search(), decontaminate.Search(index_words=20, block=2)):
        found = decontaminate.leaks(docs, bench, how).collect()
        got = Counter((r.doc_id, r.item_id) for r in found)
        assert got == Counter([(1, 1), (3, 2), (5, 3), (None, None)])
        assert all(r.score >= 1 for r in found)
    left = decontaminate.without_leaks(docs, bench)
    assert left.columns == docs.columns and ids(left) == [2, 4, 6, 7, 8]
    assert decontaminate.leaks(docs, bench.where("false")).count() == 0
    assert decontaminate.leaks(no_docs, bench).count() == 0


def test_leaks_as_brute_force(small, small_docs):
    import pandas as pd

    bench = pd.read_parquet(f"{SMALL}/benchmark.parquet")

    def shingles(own):
        return {tuple(own[i : i + 5]) for i in range(len(own) - 4)}

    items, longest = [], 0
    for i, text in zip(bench.item_id, bench.text):
        q, _, a = text.partition("\n")
        q, a = words(ascii_lower(q)), words(ascii_lower(a))
        longest = max(longest, len(q) + len(a))
        items.append((i, [shingles(q), shingles(a)] if min(len(q), len(a)) >= 5 else [shingles(q + a)]))
    expected = set()
    for d, text in zip(small_docs.doc_id, small_docs.text):
        own = words(ascii_lower(text))
        for s in range(0, max(len(own) - longest, 1), longest):
            have = shingles(own[s : s + 2 * longest])
            expected |= {(d, i) for i, parts in items if all(len(have & p) >= 0.8 * len(p) for p in parts)}
    found = decontaminate.leaks(small("documents"), small("benchmark"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected and expected


def test_block_max_wand_as_exhaustive_scoring():
    import random
    from types import SimpleNamespace as Row

    draw = random.Random(2)
    vocabulary = [f"t{i}" for i in range(30)]
    texts = [" ".join(draw.choices(vocabulary, k=draw.randrange(4, 12))) for _ in range(200)]
    items = [Row(key=i, item_id=i, text=t) for i, t in enumerate(texts)]
    tf = [(i, w, n) for i, t in enumerate(texts) for w, n in Counter(t.split()).items()]
    df = Counter(w for _, w, _ in tf)
    postings = [Row(key=i, word=w, tf=n, df=df[w]) for i, w, n in tf]
    index = decontaminate.Index(items, postings, 200, 8.0, decontaminate.Search(block=4))
    for _ in range(200):
        query = [t for t in range(len(index.terms)) if draw.random() < 0.3]
        scores: Counter = Counter()
        for t in query:
            for item, impact in zip(*index.lists[t][:2]):
                scores[item] += impact
        found = dict(index.search(query))
        assert set(found) == {i for i, s in scores.items() if s >= 1.0}


# -- mix ----------------------------------------------------------------------


def brute_targets(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full: set = set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / open_ for s in names}
        above = {s for s in names if s not in full and target[s] > most * sizes[s] + 1e-9}
        if not above:
            return target
        full |= above


def test_mix(small, small_docs):
    frame = mixing.mix(small("documents"))
    rows = frame.collect()
    assert sorted(rows) == sorted(mixing.mix(small("documents").repartition(7)).collect())
    size = {i: len(words(t)) for i, t in zip(small_docs.doc_id, small_docs.text)}
    assert {r.doc_id: r.size for r in rows} == size
    totals: Counter = Counter()
    taken: Counter = Counter()
    for r in rows:
        totals[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
    target = brute_targets(totals)
    for r in rows:
        assert r.source_size == totals[r.source] and abs(r.target - target[r.source]) < 1e-6
    longest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= longest / 2 for s in target)


def test_mix_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    rows = spark.range(3000).selectExpr(
        "id doc_id", "repeat('w ', cast(1 + pmod(xxhash64(id), 40) as int)) text", "if(id % 3 = 0, 'b', if(id % 50 = 1, null, 'a')) source"
    )
    frame = mixing.mix(rows)
    sums = frame.groupBy("source").agg({"taken": "sum", "target": "max", "*": "count"}).collect()
    assert sum(r["count(1)"] for r in sums) == 3000
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 20 for r in sums)  # half a document
    again = mixing.mix(rows.repartition(5))
    assert sorted(map(str, frame.collect())) == sorted(map(str, again.collect()))


def test_flight_keeps_counts_and_sizes():
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 500):
        p, size = rng.random(n), rng.integers(1, 90, n)
        end = mixing.flight(p.copy(), size)
        open_ = (end > 1e-9) & (end < 1 - 1e-9)
        assert open_.sum() <= 2
        assert abs(end.sum() - p.sum()) < 1e-6 and abs((end * size).sum() - (p * size).sum()) < 1e-4
        landed = mixing.landing(end, size)
        assert set(landed) <= {0.0, 1.0}
        assert abs((landed * size).sum() - (p * size).sum()) <= 90


def test_targets_as_brute_force(spark):
    for sizes in ({"a": 10, "b": 1000, None: 5}, {"a": 0, "b": 7}, {"Z": 1, "a": 50, "é": 3, "b": 900, None: 40}):
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r.source: r.target for r in mixing.targets(frame).collect()}
        expected = brute_targets(sizes)
        assert found.keys() == expected.keys()
        assert all(abs(found[s] - expected[s]) < 1e-9 for s in found)


def test_mix_of_odd_rows(odd, no_docs):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert len({(r.taken) for r in rows if r.doc_id == 1 and r.size == 6}) == 1
    left = mixing.mixed_documents(odd)
    assert left.columns == [*odd.columns, "copy"]
    assert left.count() == sum(r.repeats for r in rows)
    assert mixing.mix(no_docs).count() == 0
