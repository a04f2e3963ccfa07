"""What several corpus operators share: staging, sampling, vectorised text.

Text is handled in Arrow batches inside Spark tasks. A batch is cut into slices
of bounded bytes, so the arrays made from it stay small whatever the documents
are; one very long document is a slice of its own.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from uuid import uuid4

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tramwise
from tramwise.session import checkpoint_root

#: A word: bytes other than blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20
BATCH_ROWS = 1000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)


# -- Spark side ---------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode one of our own."""
    local = spark.sparkContext.master.startswith("local[")
    own = tempfile.mkdtemp(prefix="stages-") if local and not spark.conf.get(
        "spark.checkpoint.dir", None
    ) else None
    return checkpoint_root(spark, own)


def stage(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs tasks of what follows, never
    what came before. The folder belongs to the cluster, which empties it.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of long texts small, and let workers find this package.

    Workers look where the driver found it; a cluster that does not share that folder
    gets the package by ``--py-files``.
    """
    root = str(Path(tramwise.__file__).resolve().parent.parent)
    told = spark.sparkContext.environment
    if root not in told.get("PYTHONPATH", "").split(os.pathsep):
        told["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [told.get("PYTHONPATH")])])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Executions let go of what they shuffled when they end; for frames that run once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def hash_share(key: str, wanted: int, count: int) -> Column:
    """Whether the hash of ``key`` is among the smallest, of about ``wanted`` rows of ``count``."""
    if wanted >= count:
        return F.lit(True)
    return F.xxhash64(key) < int(2**64 * wanted / count) - 2**63


def bounded_sample(rows: DataFrame, key: str, label: str, n: int) -> DataFrame:
    """(key, y): at most ``n`` rows with each of the labels 0 and 1.

    They are those with the smallest hash of ``key``, the same ones every time. Rows
    whose hash is too large to be among them are put aside before they are ordered.
    """
    parts = [
        rows.where((F.col(label) == value) & F.col(key).isNotNull() & hash_share(key, 2 * n, count))
        .select(F.col(key).cast("long").alias(key), F.lit(value).alias("y"))
        .orderBy(F.xxhash64(key), key)
        .limit(n)
        for value, count in enumerate(label_counts(rows, label))
    ]
    return parts[0].unionByName(parts[1])


def label_counts(rows: DataFrame, label: str) -> tuple[int, int]:
    """How many of all rows carry label 0 and label 1."""
    found = rows.select(
        F.count(F.when(F.col(label) == 0, 1)), F.count(F.when(F.col(label) == 1, 1))
    ).first()
    return found[0], found[1]


class TextPress:
    """Compresses texts, one by one, with a dictionary made from a bounded sample.

    Short texts alone give a compressor little to go on. The dictionary changes sizes
    only; what comes out is what went in.
    """

    def __init__(self, texts: DataFrame, samples: int = 2000, characters: int = 4000):
        some = texts.where(hash_share("text", 2 * samples, texts.count()))
        rows = some.select(F.substring("text", 1, characters).alias("text")).limit(samples).collect()
        self.words = b""
        if sum(len(r.text or "") for r in rows) > 1_000_000:
            self.words = zstandard.train_dictionary(1 << 16, [r.text.encode() for r in rows if r.text]).as_bytes()

    def _dictionary(self) -> dict:
        return {"dict_data": zstandard.ZstdCompressionDict(self.words)} if self.words else {}

    def opener(self):
        return zstandard.ZstdDecompressor(**self._dictionary()).decompress

    def press(self, texts: DataFrame) -> DataFrame:
        """``texts`` with ``blob`` in place of the last column, ``text``."""
        *names, last = texts.columns
        assert last == "text"

        def run(batches):
            shut = zstandard.ZstdCompressor(level=5, **self._dictionary())
            for batch in batches:
                blobs = [shut.compress(t.as_buffer()) for t in batch.column("text").cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in names], pa.array(blobs, pa.binary())], [*names, "blob"]
                )

        shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])
        return texts.mapInArrow(run, f"{shape}, blob binary")


# -- Inside tasks -------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column end to end, and where each row starts and ends."""
    column = column.cast(pa.large_string()).fill_null("")
    _, starts, data = column.buffers()
    begin = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[begin[0] : begin[-1]], begin - begin[0]


def slices(bounds: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes, or one row."""
    row, rows = 0, len(bounds) - 1
    while row < rows:
        end = int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def text_slices(column: pa.Array, most: int = SLICE_BYTES):
    """(first row, bytes, bounds) for each slice of a text column."""
    data, bounds = utf8(column)
    for first, end in slices(bounds, most):
        own = bounds[first : end + 1]
        yield first, data[own[0] : own[-1]], own - own[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse, modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int):
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1)
            self.up, self.down = (
                np.cumprod(np.r_[np.uint64(1), np.full(size, base, np.uint64)])
                for base in (_BASE, pow(_BASE, -1, 2**64))
            )
        return self.up, self.down


_powers = _Powers()


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes in each of the spans."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin])


def word_spans(data: np.ndarray, bounds: np.ndarray):
    """Start and end of every word, and how many words each row has."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    edge = inside[1:] != inside[:-1]
    begin = inside[1:] & edge
    # Words also break where a row ends and the next begins.
    cut = bounds[(bounds > 0) & (bounds < len(data))]
    begin[cut] |= inside[cut + 1]
    stop = inside[:-1] & edge
    stop[cut] |= inside[cut]
    begin, stop = np.flatnonzero(begin), np.flatnonzero(stop)
    return begin, stop, np.diff(np.searchsorted(begin, bounds))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return _LOWER[data]


_RUN = np.random.default_rng(7411).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def runs(hashes: np.ndarray, counts: np.ndarray, k: int):
    """A hash for each run of ``k`` neighbouring words of one row.

    Returns the hashes, the position of each run's first word in ``hashes``, and
    the number of runs of each row.
    """
    first = np.cumsum(counts) - counts
    number = np.maximum(counts - k + 1, 0)
    at = np.repeat(first - (np.cumsum(number) - number), number) + np.arange(number.sum())
    total = np.zeros(len(at), np.uint64)
    for j in range(k):
        total += hashes[at + j] * _RUN[j]
    return mix(total), at, number


def char_grams(texts: list[str], orders: tuple[int, ...], bits: int):
    """Hashed character n-grams of each text, all of them, repeats included.

    Returns feature numbers below ``2**bits`` and the position of the text each
    belongs to, order by order. Texts stand between two blanks, so that
    beginnings and ends count too.
    """
    padded = [f" {t} " for t in texts]
    raw = "".join(padded).encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(raw, np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in padded], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # up to the end
    grams, owners = [], []
    for n in orders:
        size = max(len(codes) - n + 1, 0)
        total = np.full(size, n * 0x632BE5AB, np.uint64)
        for j in range(n):
            total = total * np.uint64(_BASE) + codes[j : j + size]
        keep = left[:size] >= n
        grams.append((mix(total[keep]) >> np.uint64(64 - bits)).astype(np.int64))
        owners.append(owner[:size][keep])
    return np.concatenate(grams), np.concatenate(owners)


def per_row(ids: np.ndarray, owner: np.ndarray, bits: int):
    """Distinct (row, feature) pairs: rows, features and how often each occurs."""
    keys, times = np.unique(owner << bits | ids, return_counts=True)
    return keys >> bits, keys & ((1 << bits) - 1), times


def row_slices(texts: list, most: int = SLICE_BYTES // 4, rows: int = 512):
    """Ranges of at most ``rows`` texts with at most ``most`` characters, or one text."""
    sizes = np.cumsum([0, *(len(t) for t in texts)])
    for first, end in slices(sizes, most):
        for at in range(first, end, rows):
            yield at, min(at + rows, end)


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))
