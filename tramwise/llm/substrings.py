"""Repeated word sequences, removed by compacting a de Bruijn graph.

An edge of the graph is a window of 20 words, its nodes are the 19 words at either
end. Neighbouring windows of a document that share their minimizer (the 5 words of
least hash in the window) make one *stretch*: a path of edges in one record. Equal
windows have equal minimizers at equal offsets, so windows repeat only where
minimizers do, and the graph falls apart by minimizer.

1. Stretches are counted by minimizer. Those whose minimizer occurs once are dropped
   by a join; most of a corpus goes here.
2. Stretches of equal words are compacted to one path with the coordinate of its first
   occurrence. Every other occurrence is a repeat over its whole length.
3. A minimizer with several paths is a branch. The texts are read again at the
   source coordinates of its paths, and their windows are compared one by one.

Shuffles carry hashes and coordinates; the text goes along compressed, and only to
meet what was found in it. Equal words are told by 128 bits of hash (minimizer and content
of a path; minimizer and words of a window), not compared again one by one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramwise.llm.common import (
    TextPress,
    mix,
    runs,
    small_batches,
    span_hashes,
    stage,
    text_slices,
    word_spans,
)

WINDOW = 20
#: Words of a minimizer. Shorter ones repeat by chance, longer ones share stretches less.
KEY = 5
#: Stands for a NULL id, which sorts first.
NO_ID = -(1 << 63)
#: A key with more than this part of all rows is dealt to so many tasks.
HOT, SALTS = 256, 32
#: Up to so many repeated ids are broadcast.
FEW_IDS = 1_000_000


def stretches(hashes: np.ndarray, counts: np.ndarray, window: int, key: int):
    """Stretches of all rows: row, first window, last window, minimizer position, hashes.

    Positions are words within the row. Of equal minimizers the leftmost counts.
    """
    keys, at, numbers = runs(hashes, counts, key)
    span = window - key + 1  # keys in a window
    wins = np.maximum(counts - window + 1, 0)
    if not wins.sum():
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    # Least key of each run of `span` keys, by doubling; ties to the left.
    least, where, width = keys, np.arange(len(keys)), 1
    while width < span:
        step = min(width, span - width)
        size = len(least) - step
        right = least[step:] < least[:size]
        where = np.where(right, where[step:], where[:size])
        least = np.where(right, least[step:], least[:size])
        width += step
    key_first = np.cumsum(numbers) - numbers
    row = np.repeat(np.arange(len(counts)), wins)
    place = np.arange(wins.sum()) - np.repeat(np.cumsum(wins) - wins, wins)
    best = where[key_first[row] + place]  # index into keys
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (best[1:] != best[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(row)) - 1
    word_first = np.cumsum(counts) - counts
    first, last, rows = place[begin], place[end], row[begin]
    # A hash of all words of the stretch, by sums of word hashes times powers.
    spread = span_sums(hashes, word_first[rows] + first, word_first[rows] + last + window)
    middle = best[begin] - key_first[rows]
    content = mix(spread + ((middle - first) << 8 | (last - first)).astype(np.uint64))
    return rows, first, last, middle, keys[best[begin]], content


_STEP = 0xD1342543DE82EF95


def span_sums(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the word hashes in each span."""
    up = np.cumprod(np.r_[np.uint64(1), np.full(len(hashes), _STEP, np.uint64)])
    down = np.cumprod(np.r_[np.uint64(1), np.full(len(hashes), pow(_STEP, -1, 2**64), np.uint64)])
    sums = np.r_[np.uint64(0), np.cumsum(hashes * up[:-1])]
    return mix((sums[end] - sums[begin]) * down[begin])


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _hashed(data, bounds):
    begin, end, counts = word_spans(data, bounds)
    return begin, end, counts, span_hashes(data, begin, end)


# A coordinate packs the minimizer's word position and the stretch's reach to its left
# and right. Texts are told apart by doc and mark.


def pack(position, before, after):
    return (position << 5 | before) << 5 | after


def unpack(packed):
    """(position, before, after)"""
    return packed >> 10, packed >> 5 & 31, packed & 31


def find_stretches(texts: DataFrame, window: int, key: int) -> DataFrame:
    """(minimizer, content, doc, mark, at) of every stretch of (doc, mark, text) rows."""

    def find(batches):
        for batch in batches:
            doc, mark = (batch.column(c).to_numpy() for c in ("doc", "mark"))
            for offset, data, bounds in text_slices(batch.column("text")):
                _, _, counts, hashes = _hashed(data, bounds)
                rows, first, last, middle, keys, content = stretches(hashes, counts, window, key)
                at = pack(middle, middle - first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [_signed(keys), _signed(content), *map(pa.array, (doc[offset + rows], mark[offset + rows], at))],
                    ["minimizer", "content", "doc", "mark", "at"],
                )

    return texts.mapInArrow(find, "minimizer long, content long, doc long, mark long, at long")


def dealt(frame: DataFrame, hot: list[int], every: bool = False) -> DataFrame:
    """``frame`` with ``salt``, which spreads the rows of hot minimizers.

    With ``every`` these rows are there for each salt, to meet the others.
    """
    one = F.lit(0).cast("long")
    if not hot:
        return frame.withColumn("salt", one)
    crowded = F.col("minimizer").isin(hot)
    if every:
        salts = F.when(crowded, F.sequence(one, F.lit(SALTS - 1).cast("long"))).otherwise(F.array(one))
        return frame.withColumn("salt", F.explode(salts))
    draw = F.pmod(F.xxhash64("doc", "mark", "at"), F.lit(SALTS).cast("long"))
    return frame.withColumn("salt", F.when(crowded, draw).otherwise(one))


def compact(found: DataFrame) -> DataFrame:
    """(doc, mark, at, minimizer): stretches that repeat, and paths that branch.

    ``minimizer`` is NULL for a stretch that repeats an earlier one word for word. It
    is given for the first occurrence of a path whose minimizer has other paths.
    """
    again = stage(found.groupBy("minimizer").count().where("count > 1"), "minimizers")
    total = again.agg(F.sum("count")).first()[0] or 0
    # Fewer than HOT of them can have more than that part of all rows.
    hot = [r.minimizer for r in again.where(F.col("count") > total / HOT).select("minimizer").collect()]
    # Stored numbers look small enough to be broadcast, and grow with the corpus.
    known = dealt(again.select("minimizer"), hot, every=True).hint("merge")
    shared = dealt(found, hot).join(known, ["minimizer", "salt"])
    shared = stage(shared.drop("salt"), "stretches")
    paths = shared.groupBy("minimizer", "content").agg(
        F.min(F.struct("doc", "mark", "at")).alias("first"), F.count("*").alias("times")
    )
    paths = stage(paths, "paths")  # read three times
    branches = paths.groupBy("minimizer").count().where("count > 1").select("minimizer")
    later = ~F.struct("doc", "mark", "at").eqNullSafe(F.col("first"))
    repeated = dealt(paths.where("times > 1"), hot, every=True).hint("merge")
    repeats = dealt(shared, hot).join(repeated, ["minimizer", "content", "salt"]).where(later)
    heads = paths.join(branches.hint("merge"), "minimizer").select("first.doc", "first.mark", "first.at", "minimizer")
    return repeats.select("doc", "mark", "at", F.lit(None).cast("long").alias("minimizer")).unionByName(heads)


def removed_words(n: int, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` words some window from ``first`` to ``last`` covers."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, last + window, -1)
    return np.cumsum(edges[:-1]) > 0


def kept_hash(data: bytes, begin, end, gone: np.ndarray) -> str:
    """SHA-256 of the words that stay, joined by one space."""
    keep = np.flatnonzero(~gone)
    words = [data[a:b] for a, b in zip(begin[keep].tolist(), end[keep].tolist())]
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _lists(column: pa.ListArray):
    """Bounds and flat values of a list column; NULL lists are empty."""
    bounds = np.r_[0, np.cumsum(column.value_lengths().fill_null(0).to_numpy())]
    return bounds, column.flatten()


def _texts(open_, blobs: pa.Array):
    for blob in blobs:
        data = open_(blob.as_py())
        yield data, *_hashed(np.frombuffer(data, np.uint8), np.array([0, len(data)]))


_OPEN = (
    "doc_id long, doc long, mark long, n_words long, n_removed long, kept_sha256 string, "
    "blob binary, items array<struct<at: long, minimizer: long>>"
)


def close(joined: DataFrame, press: TextPress, window: int) -> DataFrame:
    """Results of documents without branches; the others keep their text and items."""

    def run(batches):
        open_ = press.opener()
        for batch in batches:
            items = batch.column("items")
            bounds, flat = _lists(items)
            at = flat.field("at").to_numpy()
            branch = flat.field("minimizer").is_valid().to_numpy(zero_copy_only=False)
            n_words, n_removed, digests, waits = [], [], [], []
            for i, (data, begin, end, _, _) in enumerate(_texts(open_, batch.column("blob"))):
                own = slice(bounds[i], bounds[i + 1])
                place, before, after = unpack(at[own])
                n_words.append(len(begin))
                waits.append(bool(branch[own].any()))
                if waits[-1]:
                    n_removed.append(None)
                    digests.append(None)
                    continue
                first = place - before
                gone = removed_words(len(begin), first, first + after, window)
                n_removed.append(int(gone.sum()))
                digests.append(kept_hash(data, begin, end, gone))
            mask = pa.array(waits, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("doc_id", "doc", "mark")],
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(digests, pa.string()),
                    pc.if_else(mask, batch.column("blob"), None),
                    items.filter(mask).take(_positions(waits)),
                ],
                ["doc_id", "doc", "mark", "n_words", "n_removed", "kept_sha256", "blob", "items"],
            )

    return joined.select("doc_id", "doc", "mark", "blob", "items").mapInArrow(run, _OPEN)


def _positions(waits: list[bool]) -> pa.Array:
    """Where each row's value lies among those of the waiting rows."""
    seen = np.cumsum(waits) - 1
    return pa.array([int(k) if w else None for k, w in zip(seen, waits)], pa.int64())


def branch_windows(waiting: DataFrame, press: TextPress, window: int) -> DataFrame:
    """(minimizer, words, doc, mark, at) of every window of the branching paths."""

    def run(batches):
        open_ = press.opener()
        for batch in batches:
            docs, marks = batch.column("doc").to_numpy(), batch.column("mark").to_numpy()
            bounds, flat = _lists(batch.column("items"))
            at = flat.field("at").to_numpy()
            keys = flat.field("minimizer").fill_null(0).to_numpy()
            branch = flat.field("minimizer").is_valid().to_numpy(zero_copy_only=False)
            for i, (_, _, _, _, hashes) in enumerate(_texts(open_, batch.column("blob"))):
                own = slice(bounds[i], bounds[i + 1])
                place, before, after = unpack(at[own])
                mine = branch[own]
                place, before, after = place[mine], before[mine], after[mine]
                number = after + 1
                start = np.repeat(place - before - (np.cumsum(number) - number), number)
                start += np.arange(number.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(keys[own][mine], number)),
                        _signed(span_sums(hashes, start, start + window)),
                        pa.array(np.full(len(start), docs[i])),
                        pa.array(np.full(len(start), marks[i])),
                        pa.array(start),
                    ],
                    ["minimizer", "words", "doc", "mark", "at"],
                )

    return waiting.mapInArrow(run, "minimizer long, words long, doc long, mark long, at long")


def crowded_minimizers(waiting: DataFrame) -> list[int]:
    """Minimizers with more than 1/HOT of all windows of branching paths: fewer than HOT."""
    branch = waiting.select(F.explode("items").alias("i")).where("i.minimizer is not null")
    after = F.col("i.at").bitwiseAND(31)  # see pack
    sizes = branch.groupBy("i.minimizer").agg(F.sum(after + 1).alias("windows"))
    total = sizes.agg(F.sum("windows")).first()[0] or 0
    return [r.minimizer for r in sizes.where(F.col("windows") > total / HOT).select("minimizer").collect()]


def repeated_starts(waiting: DataFrame, press: TextPress, window: int) -> DataFrame:
    """(doc, mark, at) of the windows of branching paths that start earlier as well.

    Windows go through one shuffle, to stand beside their equals. Those of crowded
    minimizers are counted in part before theirs, and are looked up by a join that may
    be split.
    """
    here = F.struct("doc", "mark", "at")

    def after_first(windows: DataFrame) -> DataFrame:
        least = F.min(here).over(Window.partitionBy("minimizer", "words"))
        found = windows.withColumn("first", least)
        return found.where(~here.eqNullSafe(F.col("first"))).select("doc", "mark", "at")

    def after_joined(windows: DataFrame) -> DataFrame:
        firsts = (
            windows.groupBy("minimizer", "words")
            .agg(F.count("*").alias("times"), F.min(here).alias("first"))
            .where("times > 1")
        )
        joined = windows.join(firsts, ["minimizer", "words"])
        return joined.where(~here.eqNullSafe(F.col("first"))).select("doc", "mark", "at")

    def of(items) -> DataFrame:
        some = waiting.select("doc", "mark", "blob", items.alias("items"))
        return branch_windows(some.where(F.size("items") > 0), press, window)

    # Rows that agree in id and text are one document, so the first of its windows is that of all.
    hot = crowded_minimizers(waiting)
    if not hot:
        return after_first(of(F.col("items")))
    crowded = F.filter("items", lambda i: i["minimizer"].isin(hot))
    others = F.filter("items", lambda i: i["minimizer"].isNotNull() & ~i["minimizer"].isin(hot))
    return after_first(of(others)).unionByName(after_joined(of(crowded)))


def finish(waiting: DataFrame, press: TextPress, window: int) -> DataFrame:
    """Results of documents with branches, from their items and ``starts``."""

    def run(batches):
        open_ = press.opener()
        for batch in batches:
            bounds, flat = _lists(batch.column("items"))
            at = flat.field("at").to_numpy()
            plain = ~flat.field("minimizer").is_valid().to_numpy(zero_copy_only=False)
            limits, starts = _lists(batch.column("starts"))
            starts = starts.to_numpy()
            n_removed, digests = [], []
            for i, (data, begin, end, _, _) in enumerate(_texts(open_, batch.column("blob"))):
                own = slice(bounds[i], bounds[i + 1])
                place, before, after = unpack(at[own])
                mine = plain[own]
                first = (place - before)[mine]
                more = starts[limits[i] : limits[i + 1]]
                gone = removed_words(
                    len(begin), np.r_[first, more], np.r_[first + after[mine], more], window
                )
                n_removed.append(int(gone.sum()))
                digests.append(kept_hash(data, begin, end, gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return waiting.mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, mark, text): ``mark`` tells the texts of a repeated or missing id apart.

    It is a 64-bit hash of the text, and 0 for an id that occurs once, as most do.
    """
    text = F.coalesce("text", F.lit(""))
    number = F.col("doc_id").cast("long")
    rows = docs.select(number.alias("doc_id"), F.coalesce(number, F.lit(NO_ID)).alias("doc"), text.alias("text"))
    repeated = stage(rows.groupBy("doc").count().where("count > 1").select("doc"), "repeated-ids")
    many = repeated.count()
    if not many:
        mark = F.lit(0).cast("long")
    elif many > FEW_IDS:
        mark = F.xxhash64("text")
    else:
        rows = rows.join(F.broadcast(repeated.withColumn("again", F.lit(True))), "doc", "left")
        mark = F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return rows.select("doc_id", "doc", mark.alias("mark"), "text")


def remove_repeats(docs: DataFrame, window: int = WINDOW, key: int = KEY) -> DataFrame:
    """Remove every word that a repeated window of ``window`` words covers.

    A window repeats if its words also start earlier: in a document of smaller id, or
    earlier in the same one. Windows are those of the input. Columns: doc_id, n_words,
    n_removed, kept_sha256 (of the words that stay, joined by one space).

    A NULL or empty text has no words. A NULL id comes before all others. Rows of one
    id with different texts are ordered by a hash of their text; rows that agree in
    both are one document stated more than once and get the same result. Other columns
    are not read. ``window`` may be at most 31 + ``key`` words.
    """
    small_batches(docs.sparkSession)
    texts = marked(docs)
    found = find_stretches(texts.select("doc", "mark", "text"), window, key)
    items = (
        compact(found)
        .groupBy("doc", "mark")
        .agg(F.collect_list(F.struct("at", "minimizer")).alias("items"))
    )

    press = TextPress(texts)
    pressed = press.press(texts)
    told = stage(close(pressed.join(items, ["doc", "mark"], "left"), press, window), "substrings")
    waiting = told.where("n_removed is null")
    starts = (
        repeated_starts(waiting, press, window).groupBy("doc", "mark").agg(F.collect_set("at").alias("starts"))
    )
    final = finish(
        waiting.join(starts, ["doc", "mark"], "left").select("doc_id", "n_words", "blob", "items", "starts"),
        press,
        window,
    )
    return told.where("n_removed is not null").select(*final.columns).unionByName(final)
