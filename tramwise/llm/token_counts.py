"""Token counts by heap-driven byte-pair merging.

A piece of text starts as a linked list of bytes. The adjacent pair of lowest
rank is popped from a heap and merged until no ranked pair is left; the count is
the number of bytes less the merges. No token identifiers are produced.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramwise.llm.common import small_batches

#: Fixed value: the split that byte-level vocabularies of this family are made
#: for. White space is the Unicode property.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+|"
    r" ?[^\p{White_Space}\p{L}\p{N}]+|"
    r"\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Entries that a worker remembers: twice this many at most, as the older half goes
#: when the younger is full.
REMEMBERED = 400_000
#: Marks a symbol that was merged into the one before it; no pair has a rank with it.
GONE = 1 << 19


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Memory(dict):
    """Results of ``work``, the latest kept. A miss computes and stores."""

    def __init__(self, work):
        super().__init__()
        self.work, self.older = work, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.work(key)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class PairMerger:
    """Counts tokens by the merges of one vocabulary file."""

    def __init__(self, vocabulary: str):
        told = json.loads(vocabulary)
        number: dict[str, int] = byte_letters()
        self.ranks: dict[int, int] = {}
        self.joined: list[int] = []  # by rank
        for rank, pair in enumerate(told["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[number[left] << 20 | number[right]] = rank
            self.joined.append(number.setdefault(left + right, len(number)))
        special = [t["content"] for t in told.get("added_tokens") or ()]
        self.special = special
        self.cut = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(PIECES)
        self.crowded = re.compile(r" (?:\s|$)")
        self.of_piece = Memory(self.merge)
        # Keys are what follows a blank, which belongs to the piece after it.
        self.after_blank = Memory(self.chunk)

    def merge(self, piece: str) -> int:
        """Tokens of one piece."""
        symbols = list(piece.encode("utf-8", "replace"))
        left = n = len(symbols)
        ranks, joined = self.ranks, self.joined
        # Heap entries are the rank of a pair and where it starts, in one number.
        heap = []
        for i in range(n - 1):
            rank = ranks.get(symbols[i] << 20 | symbols[i + 1])
            if rank is not None:
                heap.append(rank << 32 | i)
        heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            # The pair may have changed since it was pushed.
            if j >= n or ranks.get(symbols[i] << 20 | symbols[j]) != top >> 32:
                continue
            symbols[i] = new = joined[top >> 32]
            symbols[j] = GONE
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get(new << 20 | symbols[k])
                if rank is not None:
                    heappush(heap, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = ranks.get(symbols[h] << 20 | new)
                if rank is not None:
                    heappush(heap, rank << 32 | h)
        return left

    def chunk(self, chunk: str) -> int:
        """Tokens of a blank and the chunk after it."""
        if chunk.isalpha():
            return self.merge(" " + chunk)
        if chunk[-1:] in (".", ",") and chunk[:-1].isalpha():
            return self.after_blank[chunk[:-1]] + 1
        return self.split(" " + chunk)

    def split(self, text: str) -> int:
        """Tokens of a text without special strings."""
        return sum(map(self.of_piece.__getitem__, self.pieces.findall(text)))

    def plain(self, text: str) -> int:
        """As ``split``; where blanks stand alone, chunk by chunk.

        A blank followed by something else than white space begins a piece, so
        the text falls apart there and each chunk is counted once.
        """
        if self.crowded.search(text):
            return self.split(text)
        first, *rest = text.split(" ")
        return self.split(first) + sum(map(self.after_blank.__getitem__, rest))

    def count(self, text: str) -> int:
        """Tokens of a text; special strings in it are one token each."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        found = len(self.cut.findall(text))
        return found + sum(map(self.plain, self.cut.split(text)))


@lru_cache(maxsize=2)
def _merger(vocabulary: str) -> PairMerger:
    """One merger for each vocabulary and worker; it outlives the task."""
    return PairMerger(vocabulary)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = 1024) -> DataFrame:
    """Number of bytes and tokens of every whole text.

    ``vocabulary`` is the path of a byte-level BPE file on the driver; its merges
    are broadcast, whose size the vocabulary bounds. Columns: doc_id, n_bytes,
    n_tokens, over_limit. A NULL or empty text has 0 of both; rows with a NULL or
    repeated id are counted row by row; other columns are not read.
    """
    small_batches(docs.sparkSession)
    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches):
        merger = _merger(held.value)
        for batch in batches:
            numbers = [merger.count(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(numbers, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    text = F.coalesce("text", F.lit(""))
    counted = docs.select(
        F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), "text"
    ).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
