"""Alignment of the tokens of two tokenizers over the same bytes.

The tokens of both cover the bytes of a text end to end. Every token points to the
farthest-right token of the other side that overlaps it; a token whose end both sides
share points to itself. Doubling the pointers (each takes over its successor's) brings
every token to the last token of its component in a number of steps that grows with the
logarithm of the longest chain. That token labels the group.

Both tokenizers begin a token wherever a single blank is followed by something that is
no white space, so a text falls apart into chunks there. Each different chunk of a slice
is encoded and aligned once, all of them together; a document adds up its chunks. Links are counted over the
corpus by pair of ids, and a document looks its pairs up (see ``frequent``).
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tramwise.llm.common import small_batches, span_hashes, stage, text_slices
from tramwise.llm.frequent import Tally, bar_of, frequent_keys, from_blobs, looked_up, to_blobs
from tramwise.llm.token_counts import byte_letters

#: Pairs of ids that are broadcast, at most (16 bytes each).
FREQUENT = 1 << 20
#: Chunks above this many bytes are encoded by the vocabulary's own library.
LONG = 1 << 16

#: May follow a blank that begins no chunk: white space, or the first byte of some.
_OPEN = np.zeros(256, bool)
_OPEN[[*range(0x09, 0x0E), 0x20, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_OPEN_BYTES = frozenset(np.flatnonzero(_OPEN).tolist())


def chunk_starts(data: np.ndarray) -> np.ndarray:
    """Where chunks begin: blanks after no blank and before no white space."""
    blank = data == 0x20
    begins = np.zeros(len(data), bool)
    begins[1:-1] = blank[1:-1] & ~blank[:-2] & ~_OPEN[data[2:]]
    return np.flatnonzero(begins)


def components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels, from 0 in order, of the tokens that end at ``a`` and at ``b``.

    Both rise strictly and end at the same place.
    """
    n = len(a)
    size = n + len(b)
    after = np.arange(size)
    after[:n] = n + np.searchsorted(b, a, "left")
    last = np.searchsorted(a, b, "left")
    longer = a[last] > b
    after[n:][longer] = last[longer]
    while True:
        twice = after[after]
        if np.array_equal(twice, after):
            break
        after = twice
    ends = np.zeros(size, np.int64)
    ends[n:] = after[n:] == np.arange(n, size)
    label = np.cumsum(ends) - 1
    return label[after[:n]], label[after[n:]]


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of ``a``: the first token of ``b`` it overlaps, and how many."""
    first = np.searchsorted(b, np.r_[0, a[:-1]], "right")
    return first, np.searchsorted(b, a, "left") - first + 1


class Chunks(NamedTuple):
    """Aligned chunks; one whose bytes differ has zeros, no links, and None as ``told``."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    pairs: np.ndarray  # of all links, chunk by chunk
    told: list


class Bytes:
    """The bytes of each id, end to end."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries])
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.data[np.repeat(self.first[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def spell(self, ids: np.ndarray, many: np.ndarray, given: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the ids of each chunk, ``many`` of them, are its bytes in ``given``."""
        ends = np.r_[0, np.cumsum(self.size[ids])][np.r_[0, np.cumsum(many)]]
        good = np.diff(ends) == sizes
        other = self.of(ids[np.repeat(good, many)]) != given[np.repeat(good, sizes)]
        if other.any():
            places = np.flatnonzero(good)
            good[places[np.searchsorted(np.cumsum(sizes[good]), np.flatnonzero(other), "right")]] = False
        return good


def _numbers(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the lists end to end, and how many each has."""
    many = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(chain.from_iterable(rows), np.int64, int(many.sum())), many


def _texts(ids: range) -> np.ndarray:
    """Decimal ids followed by nothing, a comma, a bar or a semicolon."""
    return np.array([[b"%d%s" % (i, end) for i in ids] for end in (b"", b",", b"|", b";")], object)


class Aligner:
    """The two vocabularies."""

    def __init__(self, first: str, second: bytes):
        told = json.loads(first)
        number = byte_letters()
        vocabulary = {bytes(number[c] for c in entry): i for entry, i in told["model"]["vocab"].items()}
        special = {t["content"] for t in told.get("added_tokens") or ()}
        ranks = {t: i for t, i in vocabulary.items() if t.decode("utf-8", "replace") not in special}
        self.whole = Tokenizer.from_str(first)
        self.whole.encode_special_tokens = True  # their strings in a text are text
        self.fast = tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.other = sentencepiece.SentencePieceProcessor(model_proto=second)
        size = max(vocabulary.values()) + 1
        entries = [b""] * size
        for entry, i in vocabulary.items():
            entries[i] = entry
        self.a = Bytes(entries)
        self.b = Bytes([self._piece(i) for i in range(self.other.get_piece_size())])
        self.a_text, self.b_text = _texts(range(size)), _texts(range(len(self.b.size)))
        self.digits = np.array([len(str(i)) for i in range(max(size, len(self.b.size)))])

    def _piece(self, i: int) -> bytes:
        piece = self.other.id_to_piece(i)
        if self.other.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, chunks: list[bytes]) -> tuple[list, list]:
        """Ids of both sides; every chunk starts with the blank before its text."""
        texts = [c.decode() for c in chunks]
        return [self.encode_first(c) for c in chunks], self.other.encode([t[1:] for t in texts], num_threads=1)

    def encode_first(self, chunk: bytes) -> list[int]:
        if len(chunk) <= LONG:
            return self.fast.encode_ordinary(chunk.decode())
        return self.whole.encode(chunk.decode(), add_special_tokens=False).ids

    def first_ids(self, chunks: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the first side end to end, and how many each chunk has.

        Chunks that fall apart again (see ``chunk_starts``) are encoded as one text.
        """
        alike = np.array([len(c) > 1 and c[1] not in _OPEN_BYTES and c[-1] != 0x20 for c in chunks]) & (sizes <= LONG)
        ids = np.array(self.fast.encode_ordinary(b"".join(c for c, one in zip(chunks, alike) if one).decode()), np.int64)
        ends, cuts = np.cumsum(self.a.size[ids]), np.cumsum(sizes[alike])
        last = np.searchsorted(ends, cuts)
        if not np.array_equal(ends[last], cuts):  # a token crosses chunks
            return _numbers([self.encode_first(c) for c in chunks])
        if alike.all():
            return ids, np.diff(last, prepend=-1)
        others, number = _numbers([self.encode_first(c) for c, one in zip(chunks, alike) if not one])
        many, first = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        many[alike], many[~alike] = np.diff(last, prepend=-1), number
        for some, begin in ((alike, 0), (~alike, len(ids))):
            first[some] = begin + np.cumsum(many[some]) - many[some]
        at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.concatenate([ids, others])[at], many

    def align(self, chunks: list[bytes]) -> Chunks:
        """The aligned form of each of the chunks."""
        if not chunks:
            none = np.zeros(0, np.int64)
            return Chunks(none, none, none, none, none, [])
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        given = np.frombuffer(b"".join(chunks), np.uint8)
        a_ids, n_a = self.first_ids(chunks, sizes)
        b_ids, n_b = _numbers(self.other.encode([c[1:].decode() for c in chunks], num_threads=1))
        good = self.a.spell(a_ids, n_a, given, sizes) & self.b.spell(b_ids, n_b, given, sizes)
        a_ids, b_ids = a_ids[np.repeat(good, n_a)], b_ids[np.repeat(good, n_b)]
        n_a, n_b = n_a * good, n_b * good
        n_groups, n_links = np.zeros_like(n_a), np.zeros_like(n_a)
        told: list = [None] * len(chunks)
        if not len(a_ids):
            return Chunks(n_a, n_b, n_groups, n_links, np.zeros(0, np.int64), told)
        a_end, b_end = np.cumsum(self.a.size[a_ids]), np.cumsum(self.b.size[b_ids])
        a_label, b_label = components(a_end, b_end)
        first, links = overlaps(a_end, b_end)
        where = np.repeat(first - (np.cumsum(links) - links), links) + np.arange(links.sum())
        pairs = np.repeat(a_ids, links) * len(self.b.size) + b_ids[where]

        # Group by group, first the one side's ids and then the other's.
        n = len(a_ids)
        key = np.concatenate([2 * a_label, 2 * b_label + 1])
        order = np.argsort(key, kind="stable")
        key = key[order]
        kind = np.full(len(key), 3)
        kind[:-1][key[1:] == key[:-1]] = 1
        kind[:-1][(key[1:] == key[:-1] + 1) & (key[:-1] % 2 == 0)] = 2
        a_last, b_last = np.cumsum(n_a[good]), np.cumsum(n_b[good])
        ends = a_last + b_last
        kind[ends - 1] = 0  # a group never crosses chunks
        from_a = order < n
        texts = np.empty(len(order), object)
        texts[from_a] = self.a_text[kind[from_a], a_ids[order[from_a]]]
        texts[~from_a] = self.b_text[kind[~from_a], b_ids[order[~from_a] - n]]
        joined = b"".join(texts.tolist())
        numbers = np.concatenate([a_ids, b_ids])[order]
        cuts = np.cumsum(self.digits[numbers] + (kind > 0))[ends - 1].tolist()
        for i, begin, end in zip(np.flatnonzero(good).tolist(), [0, *cuts], cuts):
            told[i] = joined[begin:end]
        n_groups[good] = np.diff(a_label[a_last - 1], prepend=-1)
        n_links[good] = np.diff(np.cumsum(links)[a_last - 1], prepend=0)
        return Chunks(n_a, n_b, n_groups, n_links, pairs, told)


@lru_cache(maxsize=2)
def _aligner(first: str, second: bytes) -> Aligner:
    """One aligner for each pair of vocabularies and worker; it outlives the task."""
    return Aligner(first, second)


def align_slice(aligner: Aligner, data: np.ndarray, bounds: np.ndarray):
    """(n_a, n_b, n_groups, n_links, digest, pairs, times) of each row of a slice."""
    rows = len(bounds) - 1
    sizes = np.diff(bounds)
    # A blank before each text; rows without text get none and stay empty.
    spaced = np.full(len(data) + rows, 0x20, np.uint8)
    limits = bounds + np.arange(rows + 1)
    lead = np.zeros(len(spaced), bool)
    lead[limits[:-1]] = True
    spaced[~lead] = data
    begins = chunk_starts(spaced)
    starts = np.unique(np.concatenate([begins, limits[:-1]]))
    ends = np.append(starts[1:], limits[-1])
    row = np.searchsorted(limits, starts, "right") - 1
    alive = sizes[row] > 0
    starts, ends, row = starts[alive], ends[alive], row[alive]
    _, where, which = np.unique(span_hashes(spaced, starts, ends), return_index=True, return_inverse=True)
    held = spaced.tobytes()
    found = aligner.align([held[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist())])

    told = found.n_a > 0
    bad = np.zeros(rows, bool)
    bad[row[~told[which]]] = True
    bad |= sizes == 0
    figures = []
    for each in (found.n_a, found.n_b, found.n_groups):
        total = np.bincount(row, each[which], rows).astype(np.int64) if len(row) else np.zeros(rows, np.int64)
        figures.append(np.where(bad, 0, total))
    cut = np.searchsorted(row, np.arange(rows + 1))
    digests = []
    for r in range(rows):
        own = which[cut[r] : cut[r + 1]].tolist()
        text = b";".join([found.told[u] for u in own]) if not bad[r] else None
        digests.append("" if text is None else hashlib.sha256(text).hexdigest())

    keep = ~bad[row] if len(row) else np.zeros(0, bool)
    row, which = row[keep], which[keep]
    number, flat = found.n_links, found.pairs
    first = np.cumsum(number) - number
    each = number[which] if len(which) else np.zeros(0, np.int64)
    at = np.repeat(first[which] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    owner = np.repeat(row, each)
    links = np.bincount(owner, minlength=rows).astype(np.int64)
    wide = len(aligner.a.size) * len(aligner.b.size)
    keys, times = np.unique(owner * wide + flat[at], return_counts=True)
    return figures, links, digests, keys // wide, keys % wide, times


PAIRS = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs binary, times binary"
)


def aligned(docs: DataFrame, held) -> DataFrame:
    """Each row's figures and how often it links each pair of ids."""

    def run(batches):
        aligner = _aligner(*held.value)
        for batch in batches:
            for offset, data, bounds in text_slices(batch.column("text")):
                (n_a, n_b, n_groups), links, digests, owner, pairs, times = align_slice(aligner, data, bounds)
                rows = len(n_a)
                cut = np.searchsorted(owner, np.arange(rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(offset, rows),
                        batch.column("doc_id").slice(offset, rows),
                        *map(pa.array, (n_a, n_b, n_groups, links)),
                        pa.array(digests, pa.string()),
                        to_blobs(cut, pairs.astype(np.int64)),
                        to_blobs(cut, times.astype(np.int32)),
                    ],
                    [f.split()[0] for f in PAIRS.split(", ")],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, PAIRS)


def pair_counts(found: DataFrame) -> DataFrame:
    """(key, times): how many links of the corpus hold each pair."""

    def run(batches):
        tally = Tally()

        def taken():
            keys, times, _ = tally.take()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], ["key", "times"])

        for batch in batches:
            _, keys = from_blobs(batch.column("pairs"), np.int64)
            if tally.add(keys, from_blobs(batch.column("times"), np.int32)[1].astype(np.int64)):
                yield taken()
        yield taken()

    part = found.select("pairs", "times").mapInArrow(run, "key long, times long")
    return part.groupBy("key").agg(F.sum("times").alias("times"))


def best_counts(counts: DataFrame, width: int) -> np.ndarray:
    """The highest count of each id of the second side, which the vocabulary bounds."""
    best = np.zeros(width, np.int64)
    table = counts.groupBy(F.pmod("key", F.lit(width)).alias("b")).agg(F.max("times").alias("times")).toArrow()
    best[table.column("b").to_numpy()] = table.column("times").to_numpy()
    return best


FIGURES = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
SUMS = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "n_best long, count_sum long, rare array<long>, rare_times array<int>"
)


def weighed(found: DataFrame, held, best, width: int) -> DataFrame:
    """n_best and count_sum over the frequent pairs of each row; the other pairs."""

    def run(batches):
        frequent, tops = held.value, best.value
        for batch in batches:
            sizes, flat = from_blobs(batch.column("pairs"), np.int64)
            many = from_blobs(batch.column("times"), np.int32)[1].astype(np.int64)
            cut = np.r_[0, np.cumsum(sizes)]
            count = looked_up(flat, frequent)
            rare = count == 0

            def sums(values):
                total = np.r_[0, np.cumsum(values)]
                return total[cut[1:]] - total[cut[:-1]]

            n_best = sums(many * ((count == tops[flat % width]) & ~rare))
            ends = pa.array(np.r_[0, np.cumsum(rare)][cut], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in FIGURES],
                    pa.array(n_best),
                    pa.array(sums(many * count)),
                    pa.ListArray.from_arrays(ends, pa.array(flat[rare])),
                    pa.ListArray.from_arrays(ends, pa.array(many[rare].astype(np.int32))),
                ],
                [f.split()[0] for f in SUMS.split(", ")],
            )

    return found.mapInArrow(run, SUMS)


def with_rare(sums: DataFrame, counts: DataFrame, bar: int, tops: np.ndarray) -> DataFrame:
    """``sums`` with what its rare pairs add, by a join: none of them is a hot key."""
    spark = sums.sparkSession
    rare = sums.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("p")).select(
        "row", F.col("p.rare").alias("key"), F.col("p.rare_times").cast("long").alias("many")
    )
    # Ids whose best count is rare too; the vocabulary bounds them.
    top = spark.createDataFrame(
        [(b, n) for b, n in enumerate(tops.tolist()) if 0 < n < bar], "b long, top long"
    )
    seldom = (
        counts.where(F.col("times") < bar)
        .withColumn("b", F.pmod("key", F.lit(len(tops))))
        .join(F.broadcast(top), "b", "left")
        .select("key", "times", F.coalesce(F.col("times") == F.col("top"), F.lit(False)).alias("best"))
    )
    more = (
        rare.join(seldom, "key")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("many")).otherwise(0)).alias("more_best"),
            F.sum(F.col("many") * F.col("times")).alias("more_sum"),
        )
    )
    return (
        sums.join(more, "row", "left")
        .withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
        .withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
    )


def align(docs: DataFrame, first: str | None = None, second: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """How the tokens of two tokenizers align over every whole text.

    ``first`` is the path of a byte-level BPE file and ``second`` that of a piece model
    which marks blanks and puts one before the text; a blank is put before the text for
    the first. Columns: doc_id, n_a, n_b (tokens), n_groups (stretches between byte
    offsets where tokens of both end), n_links (pairs of tokens whose bytes overlap),
    n_best (links whose pair of ids is the most frequent one of its second id, ties
    included), count_sum (corpus counts of the links' pairs, added up), groups_sha256
    (of the ids, as in ``1,2|3;4|5,6``); a row for each row of ``docs``. The ``frequent``
    most frequent pairs, about, are broadcast; the others are joined.

    A text that is NULL or empty, or that a tokenizer does not give back byte for byte
    (one with U+2581), has no tokens: zeros and an empty digest. Repeated rows count as
    often as they occur, in the counts too; a NULL id is kept. Other columns are not
    read. Strings of special tokens inside texts are text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(first or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        entries = f.read()
    with open(second or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        pieces = f.read()
    width = sentencepiece.SentencePieceProcessor(model_proto=pieces).get_piece_size()
    found = stage(aligned(docs, spark.sparkContext.broadcast((entries, pieces))), "aligned")
    counts = stage(pair_counts(found), "pair-counts")
    bar, below = bar_of(counts, frequent)
    tops = best_counts(counts, width)
    held = spark.sparkContext.broadcast(frequent_keys(counts, bar))
    sums = weighed(found, held, spark.sparkContext.broadcast(tops), width)
    if below:
        sums = with_rare(stage(sums, "aligned-sums"), counts, bar, tops)
    return sums.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
