"""Counts looked up from tasks: frequent keys by broadcast, the others by a join.

A table of counts can grow without bound, but its frequent keys, which most look-ups
ask for and which would make hot join keys, are few. They are sent to every task, at
most ``most`` of them. What is left occurs seldom, each key fewer times than the bar,
so a plain shuffle join serves it without skew. Both ways together find every key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bar_of(counts: DataFrame, most: int) -> tuple[int, int]:
    """The least power of two that at most ``most`` keys reach, and how many keys do not.

    ``counts`` has a column ``times`` of positive longs.
    """
    bits = F.length(F.bin("times"))
    told = dict(counts.groupBy(bits.alias("bits")).agg(F.count("*")).collect())  # 64 rows at most
    bar, above = 64, 0
    while bar > 0 and above + told.get(bar, 0) <= most:
        above += told.get(bar, 0)
        bar -= 1
    return 1 << bar, sum(told.values()) - above


def frequent_keys(counts: DataFrame, bar: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that occur at least ``bar`` times, sorted, and how often."""
    table = counts.where(F.col("times") >= bar).select("key", "times").toArrow()
    keys, times = (table.column(c).to_numpy() for c in ("key", "times"))
    order = np.argsort(keys)
    return keys[order], times[order]


def looked_up(keys: np.ndarray, held: tuple[np.ndarray, np.ndarray], other=0) -> np.ndarray:
    """The value held for each of ``keys``; ``other`` for those that are not held."""
    known, values = held
    if not len(known):
        return np.full(len(keys), other, np.float64 if isinstance(other, float) else values.dtype)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], other)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys in order, where each occurs first, and which of them each key is.

    By hashes, so that only different keys are sorted.
    """
    coded = pa.array(keys).dictionary_encode()
    own, which = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    first = np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1))
    order = np.argsort(own)
    rank = np.empty(len(own), np.int64)
    rank[order] = np.arange(len(own))
    return own[order], first[order], rank[which]


class Tally:
    """Adds up (key, times) within a task and lets go of them in bounded pieces.

    ``mark`` is a number that belongs to a key, if given.
    """

    def __init__(self, most: int = 1 << 20):
        self.most = most
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, keys: np.ndarray, times: np.ndarray, marks: np.ndarray | None = None) -> bool:
        """True if the tally is full and should be taken."""
        self.parts.append((keys, times, keys if marks is None else marks))
        self.held += len(keys)
        if self.held > 2 * self.most:
            self.parts = [self.take()]
            self.held = len(self.parts[0][0])
        return self.held > self.most

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All keys so far, their sums and marks; the tally is empty then."""
        if not self.parts:
            return (np.zeros(0, np.int64),) * 3
        keys, times, marks = (np.concatenate(part) for part in zip(*self.parts))
        self.parts, self.held = [], 0
        keys, first, where = np.unique(keys, return_index=True, return_inverse=True)
        return keys, np.bincount(where, times, len(keys)).astype(np.int64), marks[first]


# -- Lists of numbers as bytes, which the JVM passes on without looking into them ---


def to_blobs(cut: np.ndarray, values: np.ndarray) -> pa.BinaryArray:
    """The numbers from each of ``cut`` to the next, a blob each."""
    offsets = pa.py_buffer((cut * values.itemsize).astype(np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), len(cut) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])


def from_blobs(column: pa.BinaryArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """How many numbers each blob holds, and all of them end to end."""
    _, starts, data = column.buffers()
    bounds = np.frombuffer(starts, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    held = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.diff(bounds) // size, held.view(kind) if len(held) else np.zeros(0, kind)
