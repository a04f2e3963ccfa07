"""Benchmark decontamination: BM25 retrieval of test items, then exact overlap.

The test items make an inverted index; each training passage is a query. Postings of
a term are cut into blocks with the largest impact of each, and WAND skips items
and blocks that cannot reach their threshold. Impacts are divided by the item's
threshold, a share of the score the item has with itself, so every item has bar 1.
Retrieved pairs are verified: the passage must cover enough of the word shingles of
the item's question and of its answer.

Passages are windows of twice the longest item's length, one item's length apart, so
each run of an item's length lies whole in one passage.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramwise.llm.common import (
    WORD,
    lower_ascii,
    runs,
    small_batches,
    span_hashes,
    stage,
    text_slices,
    word_spans,
)


@dataclass(frozen=True)
class Search:
    """Settings of scoring, retrieval and verification."""

    k1: float = 1.2
    b: float = 0.75
    bar: float = 0.5  # share of an item's own score that retrieves it
    words: int = 5  # of a shingle
    overlap: float = 0.8  # share of an item part's shingles in the passage
    block: int = 64  # postings of a block
    ranges: int = 64  # of items, for the first sifting of passages
    #: Words of the items that one index holds; more items make more indexes, each
    #: broadcast on its own and run over all documents.
    index_words: int = 500_000


class Index:
    """Postings with block maxima, and the shingles to verify.

    ``items`` has (key, item_id, text), ``postings`` (key, word, tf, df); ``n`` items of
    ``mean`` words are in all indexes together.
    """

    def __init__(self, items: list, postings: list, n: int, mean: float, how: Search):
        self.how = how
        items = sorted(items, key=lambda r: (r.item_id is None, r.item_id, r.text))
        self.ids = [r.item_id for r in items]
        number = {r.key: i for i, r in enumerate(items)}
        self.sizes, self.parts = zip(*[_parts(r.text, how.words) for r in items])
        word = _hashes([p.word for p in postings])
        item = np.array([number[p.key] for p in postings], np.int64)
        tf = np.array([p.tf for p in postings], float)
        df = np.array([p.df for p in postings], float)
        lengths = np.bincount(item, tf, len(items))
        norm = how.k1 * (1 - how.b + how.b * lengths / mean)
        impact = np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (how.k1 + 1) / (tf + norm[item])
        own = np.bincount(item, impact, len(items))
        # Rounded up a little: a sum of parts must not fall below the whole.
        impact = impact / (how.bar * own[item]) * (1 + 1e-9)
        order = np.lexsort([item, word])
        word, self.item, self.impact = word[order], item[order], impact[order]
        self.terms, first = np.unique(word, return_index=True)
        self.most = np.maximum.reduceat(self.impact, first)
        self.longest = int(lengths.max())
        # The largest impact of each term in each of so many ranges of items.
        number = np.repeat(np.arange(len(first)), np.diff([*first, len(word)]))
        self.ranges = np.zeros((len(first), min(how.ranges, len(items))), np.float32)
        place = self.item * self.ranges.shape[1] // len(items)
        np.maximum.at(self.ranges, (number, place), (self.impact * (1 + 1e-6)).astype(np.float32))
        self.lists = [self._blocks(x, y) for x, y in zip(first, [*first[1:], len(word)])]

    def _blocks(self, a: int, b: int):
        """(items, impacts, last item of each block, largest impact of each block)"""
        items, impacts = self.item[a:b].tolist(), self.impact[a:b].tolist()
        cut = range(0, b - a, self.how.block)
        ends = [items[min(c + self.how.block, b - a) - 1] for c in cut]
        return items, impacts, ends, [max(impacts[c : c + self.how.block]) for c in cut]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The term number of each word, -1 for words of no item."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """(item, score) of all items that the distinct ``terms`` lift to the bar.

        Block-max WAND: cursors are kept in item order; the pivot is the first item
        at which the terms' largest impacts could reach the bar. If the maxima of
        the blocks there cannot, the cursors jump to the end of the nearest block.
        """
        cursors = [[self.lists[t][0][0], 0, t] for t in terms]  # item, position, term
        found = []
        while cursors:
            cursors.sort()
            total, pivot = 0.0, None
            for k, (_, _, t) in enumerate(cursors):
                total += self.most[t]
                if total >= 1.0:
                    pivot = k
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, nearest = 0.0, None
            for c in cursors[: pivot + 1]:
                ends, largest = self.lists[c[2]][2:]
                k = bisect_left(ends, item)
                if k < len(ends):
                    bound += largest[k]
                    nearest = ends[k] if nearest is None else min(nearest, ends[k])
            if bound < 1.0:
                # No item up to the nearest end of these blocks can reach the bar.
                target = item if nearest is None else nearest
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0] - 1)
                target = max(target, item) + 1
            elif cursors[0][0] == item:
                score = sum(self.lists[c[2]][1][c[1]] for c in cursors[: pivot + 1])
                if score >= 1.0:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
            for c in cursors[: pivot + 1]:
                if c[0] < target:
                    items = self.lists[c[2]][0]
                    c[1] = bisect_left(items, target, c[1])
                    c[0] = items[c[1]] if c[1] < len(items) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def verify(self, item: int, passage: dict[int, np.ndarray]) -> tuple:
        """Shares of question and answer that the passage's shingles cover; whether both do."""
        have = passage[self.sizes[item]]
        shares = [
            float(np.isin(part, have, assume_unique=True).mean()) if len(part) else None
            for part in self.parts[item]
        ]
        return *shares, min(s for s in shares if s is not None) >= self.how.overlap


class _Shingles(dict):
    """Distinct shingles of a passage by their number of words."""

    def __init__(self, hashes: np.ndarray):
        super().__init__()
        self.hashes = hashes

    def __missing__(self, k: int) -> np.ndarray:
        self[k] = np.unique(runs(self.hashes, np.array([len(self.hashes)]), k)[0])
        return self[k]


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "replace") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def _words(data: np.ndarray, bounds: np.ndarray):
    """Spans and hashes of the words, A-Z in lower case."""
    data = lower_ascii(data)
    begin, end, counts = word_spans(data, bounds)
    return begin, end, counts, span_hashes(data, begin, end)


def _hashes(words: list[str]) -> np.ndarray:
    data, bounds = _bytes(words)
    return span_hashes(data, bounds[:-1], bounds[1:])


def _parts(text: str, k: int) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """Words of a shingle, and those of the question (first line) and the answer (rest).

    A part with fewer than ``k`` words is joined to the other, so that nothing short
    decides alone; an item with fewer is one shingle.
    """
    question, _, answer = text.partition("\n")
    _, _, counts, hashes = _words(*_bytes([question, answer]))
    if counts.min() < k:
        counts = np.array([counts.sum(), 0])
    k = min(k, int(counts[0]))
    found, _, number = runs(hashes, counts, k)
    return k, (np.unique(found[: number[0]]), np.unique(found[number[0] :]))


def search_slice(index: Index, data: np.ndarray, bounds: np.ndarray) -> list[tuple]:
    """(row, item, score, question share, answer share, first word, words) of leaks.

    Of several passages of a row that leak an item, that of the highest score counts.
    """
    _, _, counts, hashes = _words(data, bounds)
    term = index.find(hashes)
    sums = np.r_[0.0, np.cumsum(np.where(term >= 0, index.most[term], 0.0))]
    step = index.longest
    first = np.cumsum(counts) - counts
    number = np.where(counts > 0, np.maximum(-(-counts // step) - 1, 1), 0)
    row = np.repeat(np.arange(len(counts)), number)
    order = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    begin = first[row] + order * step
    end = np.minimum(begin + 2 * step, first[row] + counts[row])
    best: dict = {}
    # What all words of a passage could add up to sorts out most passages.
    for k in np.flatnonzero(sums[end] - sums[begin] >= 1.0 - 1e-6):
        a, b, r = int(begin[k]), int(end[k]), int(row[k])
        own = np.unique(term[a:b])
        own = own[own >= 0]
        # So do the maxima of the ranges of items, term by term.
        if index.ranges[own].sum(0).max(initial=0) < 1.0 - 1e-6:
            continue
        passage = _Shingles(hashes[a:b])
        for item, score in index.search(own.tolist()):
            question, answer, leak = index.verify(item, passage)
            if leak and score > best.get((r, item), (0,))[0]:
                best[r, item] = (score, question, answer, a - int(first[r]), b - a)
    return [(*key, *value) for key, value in best.items()]


def indexes(benchmark: DataFrame, how: Search):
    """The indexes of all items, one after the other, each of bounded size."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    items = (
        benchmark.select(F.col("item_id").cast("long"), "text")
        .where(F.regexp_count("text", F.lit(WORD)) > 0)
        .distinct()
        .withColumn("key", F.xxhash64("item_id", "text"))
        .withColumn("size", F.regexp_count("text", F.lit(WORD)))
    )
    n, total = items.select(F.count("*"), F.sum("size")).first()
    if not n:
        return
    tf = (
        items.select("key", F.explode(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))).alias("word"))
        .groupBy("key", "word")
        .agg(F.count("*").alias("tf"))
    )
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    parts = -(-total // how.index_words)
    postings = stage(
        tf.join(df, "word").withColumn("part", F.pmod("key", F.lit(parts))), "postings"
    )
    for part in range(parts):
        own = items.where(F.pmod("key", F.lit(parts)) == part).select("key", "item_id", "text").collect()
        if own:
            rows = postings.where(F.col("part") == part).select("key", "word", "tf", "df").collect()
            yield Index(own, rows, n, total / n, how)


MATCH = (
    "doc_id long, item_id long, score double, question_share double, answer_share double, "
    "first_word long, n_words long"
)


def _found(texts: DataFrame, benchmark: DataFrame, how: Search) -> DataFrame:
    """Items found, with ``mark``, of rows that have doc_id, mark and text."""
    spark = texts.sparkSession
    small_batches(spark)
    found = spark.createDataFrame([], f"mark long, {MATCH}")
    for index in indexes(benchmark, how):
        held = spark.sparkContext.broadcast(index)  # index_words bounds it

        def run(batches, held=held):
            index = held.value
            for batch in batches:
                ids, marks = batch.column("doc_id"), batch.column("mark")
                rows = []
                for offset, data, bounds in text_slices(batch.column("text")):
                    for r, item, *rest in search_slice(index, data, bounds):
                        rows.append((marks[offset + r].as_py(), ids[offset + r].as_py(), index.ids[item], *rest))
                columns = list(zip(*rows)) if rows else [()] * len(SHAPE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, SHAPE)], schema=SHAPE
                )

        own = texts.select(F.col("doc_id").cast("long"), F.col("mark"), "text")
        found = found.unionByName(own.mapInArrow(run, f"mark long, {MATCH}"))
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, how: Search = Search()) -> DataFrame:
    """Benchmark items found in documents: a row for each document and item.

    ``benchmark`` has item_id and text, whose first line is the question and whose rest
    is the answer. Columns: doc_id, item_id, score (1 is the bar), question_share,
    answer_share (NULL where the item has one part), first_word and n_words of the
    passage. Words are compared with A-Z in lower case.

    Texts or items that are NULL or have no words match nothing; without items the
    result is empty. Repeated documents are reported for each row, repeated items
    once; NULL ids are kept. Other columns are not read.
    """
    rows = docs.select("doc_id", F.lit(None).cast("long").alias("mark"), "text")
    return _found(rows, benchmark, how).drop("mark")


SHAPE = pa.schema(
    [
        *[(c, pa.int64()) for c in ("mark", "doc_id", "item_id")],
        *[(c, pa.float64()) for c in ("score", "question_share", "answer_share")],
        *[(c, pa.int64()) for c in ("first_word", "n_words")],
    ]
)


def without_leaks(docs: DataFrame, benchmark: DataFrame, how: Search = Search()) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item.

    Rows are told apart by id and text, so that of several rows of one id, or without
    one, only those go whose text leaks.
    """
    mark = F.xxhash64("text")
    rows = docs.select("doc_id", mark.alias("mark"), "text")
    found = _found(rows, benchmark, how).select("doc_id", "mark").distinct().alias("k")
    d = docs.alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64("d.text") == F.col("k.mark"))
    return d.join(found, same, "left_anti")
