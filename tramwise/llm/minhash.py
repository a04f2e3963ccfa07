"""Near-duplicate documents by one-permutation MinHash.

One hash of each shingle gives both its bin and its value; a bin keeps its least
value. An empty bin borrows from a random bin that is not empty (optimal
densification), so small sets lose nothing. Bins are read in bands; documents that
agree in a band share a bucket. Documents with equal sets are one class from the
start and take part once.

Within a bucket only a star is compared: its best connected document with each other
one. Links are confirmed on the full sets. A bucket whose members then lie in one
component is settled. In the others one round compares neighbours in the order of two
further bands, between components only: the nearest documents agree in the most bands and
come to stand side by side. It adds at most one pair for each member.

What is open then is settled in full: in every bucket that still holds several
components, each member outside the largest of them is compared with all members of the
others, block against block. Components only grow, so after one such pass no bucket
holds a pair across components that was not compared. The number of jobs does not depend
on the data, but for the logarithm of the largest component.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramwise.llm.common import (
    TextPress,
    lower_ascii,
    mix,
    runs,
    slices,
    small_batches,
    span_hashes,
    stage,
    text_slices,
    word_spans,
)
from tramwise.llm.components import components


@dataclass(frozen=True)
class Near:
    """What counts as near, and how candidates are found.

    At similarity 0.8 a pair shares none of 36 bands of 5 bins with a probability of
    6e-7; a similarity of 0.2 shares one with a probability of 0.01.
    """

    words: int = 5
    percent: int = 80  # least similarity
    rows: int = 5  # bins of a band
    bands: int = 36
    large: int = 64  # members of a large bucket
    block: int = 1024  # members on each side of a block of the last pass, about


#: Bytes of compressed text on a side of a block, about, and cells of a matrix of counts.
BLOCK_BYTES = 4 << 20
CELLS = 1 << 23


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; A-Z count as lower case."""
    data = lower_ascii(data)
    begin, end, counts = word_spans(data, bounds)
    hashes = span_hashes(data, begin, end)
    found, _, number = runs(hashes, counts, k)
    cut = np.r_[0, np.cumsum(number)]
    first = np.cumsum(counts) - counts
    sets = []
    for i, n in enumerate(counts):
        if n >= k:
            sets.append(np.unique(found[cut[i] : cut[i + 1]]))
        elif n:
            whole, _, _ = runs(hashes[first[i] : first[i] + n], np.array([n]), int(n))
            sets.append(whole ^ np.uint64(n))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation MinHash of sets that are not empty, densified."""
    sig = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        s = np.sort(mix(s ^ np.uint64(0x5851F42D4C957F2D)))
        at = ((s & np.uint64(0xFFFFFFFF)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        sig[i, at[::-1]] = s[::-1]  # the least is written last
        full[i, at] = True
    row, empty = np.nonzero(~full)
    t = 0
    while len(row):
        t += 1
        # The draws depend on the bin and the attempt, never on the set.
        draw = mix(empty.astype(np.uint64) << np.uint64(20) | np.uint64(t))
        lender = ((draw >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        good = full[row, lender]
        sig[row[good], empty[good]] = sig[row[good], lender[good]]
        row, empty = row[~good], empty[~good]
    return sig


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band of each signature."""
    bands = sig.shape[1] // rows
    keys, _, _ = runs(sig.reshape(-1), np.full(len(sig) * bands, rows), rows)
    return mix(keys.reshape(len(sig), bands) + np.arange(bands, dtype=np.uint64))


def describe(texts: DataFrame, how: Near) -> DataFrame:
    """(doc_id, n, f1, f2, keys): size, two set hashes and band keys of each row.

    A set hash is a sum over the set, so it does not depend on order; two make 128
    bits. An empty set has no keys.
    """

    def run(batches):
        for batch in batches:
            for offset, data, bounds in text_slices(batch.column("text")):
                sets = shingle_sets(data, bounds, how.words)
                some = [s for s in sets if len(s)]
                keys = band_keys(signatures(some, how.rows * how.bands), how.rows)
                held = iter(keys.view(np.int64).tolist())
                prints = [
                    [int(mix(s ^ np.uint64(c)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                    for c in (0x27D4EB2F165667C5, 0x165667B19E3779F9)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(offset, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        *[pa.array(p, pa.int64()) for p in prints],
                        pa.array([next(held) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "f1", "f2", "keys"],
                )

    return texts.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, keys array<long>")


def confirm(pairs: DataFrame, blobs: DataFrame, press: TextPress, how: Near) -> DataFrame:
    """The pairs (u, v) whose full sets are near."""

    def run(batches):
        open_ = press.opener()
        last: tuple = (None, None)

        def own_set(blob):
            data = np.frombuffer(open_(blob), np.uint8)
            return shingle_sets(data, np.array([0, len(data)]), how.words)[0]

        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b")):
                a, b = a.as_py(), b.as_py()
                if last[0] != a:
                    last = (a, own_set(a))
                x, y = last[1], own_set(b)
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(bool(len(x)) and 100 * both >= how.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column("u"), batch.column("v")], ["u", "v"]
            ).filter(pa.array(keep, pa.bool_()))

    a = blobs.select(F.col("doc_id").alias("u"), F.col("blob").alias("a"))
    b = blobs.select(F.col("doc_id").alias("v"), F.col("blob").alias("b"))
    return pairs.join(b, "v").join(a, "u").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members with the component each lies in."""
    told = found.select(F.col("u").alias("doc_id"), F.col("v").alias("part"))
    return members.join(told, "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))


def _unsettled(members: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component, with the bucket's size."""
    mixed = (
        members.groupBy("bucket")
        .agg(F.count("*").alias("size"), F.min("part").alias("x"), F.max("part").alias("y"))
        .where("x != y")
        .select("bucket", "size")
    )
    return members.join(mixed, "bucket")


def _shared(members: DataFrame) -> DataFrame:
    again = members.groupBy("bucket").count().where("count > 1").select("bucket")
    return members.join(again, "bucket")


def _neighbours(members: DataFrame, reps: DataFrame, how: Near) -> DataFrame:
    """(u, v): members next to each other in their bucket that lie in two components.

    The order is that of two bands. In a large bucket only members that agree in the
    first of them meet.
    """
    one, two = (F.get("keys", F.lit(k % how.bands)) for k in (8, 16))
    keys = reps.select("doc_id", one.alias("one"), two.alias("two")).groupBy("doc_id").agg(
        F.min("one").alias("one"), F.min("two").alias("two")
    )
    large = F.when(F.col("size") > how.large, F.col("one"))
    order = Window.partitionBy("bucket", "large").orderBy("one", "two", F.xxhash64("bucket", "doc_id"))
    return (
        members.join(keys, "doc_id")
        .withColumn("large", large)
        .select(
            F.col("doc_id").alias("v"),
            "part",
            F.lag("doc_id").over(order).alias("u"),
            F.lag("part").over(order).alias("before"),
        )
        .where("part != before")
    )


def near_parts(sets: list[np.ndarray], part: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int):
    """Pairs of parts that a near pair of a ``left`` and a ``right`` row connects.

    All pairs of rows whose parts differ and whose sizes allow it are compared; of the
    pairs of parts a spanning forest is told.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    left, right = (rows[np.argsort(sizes[rows], kind="stable")] for rows in (left, right))
    above: dict[int, int] = {}

    def root(x):
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    told = []
    ordered = sizes[right]
    for at in range(0, len(left), 128):
        own = left[at : at + 128]
        least, most = int(sizes[own[0]]), int(sizes[own[-1]])
        # Near sets have 100 * smaller >= percent * larger.
        first = np.searchsorted(ordered * 100, least * percent, "left")
        end = np.searchsorted(ordered * percent, most * 100, "right")
        others = right[first:end]
        if not len(others):
            continue
        names = np.unique(np.concatenate([sets[i] for i in own]))
        both = np.zeros((len(own), len(others)), np.int64)
        wide = max(1, CELLS // (len(own) + len(others)))
        for cut in range(0, len(names), wide):
            some = names[cut : cut + wide]
            both += (_incidence(sets, own, some) @ _incidence(sets, others, some).T).astype(np.int64)
        union = sizes[own][:, None] + sizes[others][None, :] - both
        near = (100 * both >= percent * union) & (both > 0) & (part[own][:, None] != part[others][None, :])
        for i, row in zip(own, near):
            for other in np.unique(part[others[row]]).tolist():
                x, y = root(int(part[i])), root(other)
                if x != y:
                    above[max(x, y)] = min(x, y)
                    told.append((int(part[i]), other))
    return told


def _incidence(sets: list[np.ndarray], rows: np.ndarray, names: np.ndarray) -> np.ndarray:
    """A row of 0 and 1 for each of the sets: which of the sorted ``names`` it has."""
    has = np.zeros((len(rows), len(names)), np.float32)
    for k, i in enumerate(rows):
        own = sets[i]
        own = own[np.searchsorted(own, names[0], "left") : np.searchsorted(own, names[-1], "right")]
        at = np.searchsorted(names, own)
        has[k, at[names[at] == own]] = 1
    return has


def settle(open_: DataFrame, blobs: DataFrame, press: TextPress, how: Near) -> DataFrame:
    """(u, v): parts connected by a near pair of some bucket, all such pairs compared.

    ``open_`` has bucket, doc_id and part. Members outside the largest part of a bucket
    meet all its members, in blocks of both by hash, so that no bucket, however large,
    lies in one task.
    """
    sizes = blobs.select("doc_id", F.length("blob").alias("bytes"))
    parts = (
        open_.join(sizes, "doc_id")
        .groupBy("bucket", "part")
        .agg(F.count("*").alias("count"), F.sum("bytes").alias("bytes"))
    )
    shape = parts.groupBy("bucket").agg(
        F.max(F.struct("count", (-F.col("part")).alias("part"), "bytes")).alias("most"),
        F.sum("count").alias("count"),
        F.sum("bytes").alias("bytes"),
    )

    def blocks(count, held):
        n = F.ceil(F.greatest(count / how.block, held / BLOCK_BYTES))
        return F.greatest(n, F.lit(1)).cast("long")

    shape = shape.select(
        "bucket",
        (-F.col("most.part")).alias("largest"),
        blocks(F.col("count"), F.col("bytes")).alias("across"),
        blocks(F.col("count") - F.col("most.count"), F.col("bytes") - F.col("most.bytes")).alias("down"),
    )
    own = (
        open_.select("bucket", "doc_id", "part")
        .join(shape, "bucket")
        .withColumn("outside", F.col("part") != F.col("largest"))
        .withColumn("i", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("down")))
        .withColumn("j", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("across")))
    )
    # In a bucket of one block a member stands for both sides.
    one = (F.col("across") == 1) & (F.col("down") == 1)
    shared = ["bucket", "doc_id", "part"]
    right = own.select(
        *shared,
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("down") - 1)).alias("i"),
        "j",
        (one & F.col("outside")).alias("left"),
        F.lit(True).alias("right"),
    )
    left = own.where(F.col("outside") & ~one).select(
        *shared,
        "i",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") - 1)).alias("j"),
        F.lit(True).alias("left"),
        F.lit(False).alias("right"),
    )
    rows = (
        right.unionByName(left)
        .join(blobs, "doc_id")
        .select("bucket", "i", "j", "part", "left", "right", "blob")
        .repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j")
    )

    def run(batches):
        open_text = press.opener()

        def compare(held):
            texts = [open_text(b) for _, _, _, b in held]
            bounds = np.cumsum([0, *map(len, texts)])
            sets = []
            for first, end in slices(bounds):
                data = np.frombuffer(b"".join(texts[first:end]), np.uint8)
                sets += shingle_sets(data, bounds[first : end + 1] - bounds[first], how.words)
            part, left, right = (np.array([h[k] for h in held]) for k in range(3))
            return near_parts(sets, part, np.flatnonzero(left), np.flatnonzero(right), how.percent)

        def pairs_of(held):
            told = compare(held)
            u, v = (pa.array([p[k] for p in told], pa.int64()) for k in (0, 1))
            return pa.RecordBatch.from_arrays([u, v], ["u", "v"])

        block, held = None, []
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j"))))
            cells = zip(*(batch.column(c).to_pylist() for c in ("part", "left", "right", "blob")))
            for name, cell in zip(names, cells):
                if name != block:
                    if held:
                        yield pairs_of(held)
                    block, held = name, []
                held.append(cell)
        if held:
            yield pairs_of(held)

    return rows.mapInArrow(run, "u long, v long").distinct()


def class_components(reps: DataFrame, texts: DataFrame, how: Near) -> DataFrame:
    """(u, v): the least class ``v`` of the component of each class ``u`` other than it.

    ``reps`` has doc_id and keys of one document of each class, ``texts`` doc_id and text.
    """
    buckets = reps.select(F.explode("keys").alias("bucket"), "doc_id")
    members = stage(_shared(buckets), "buckets")
    some = members.select("doc_id").distinct()
    press = TextPress(texts)
    blobs = stage(press.press(texts).join(some, "doc_id", "left_semi"), "near-texts")
    # The centre is the member that shares its buckets with most others.
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"))
    known = members.join(sizes, "bucket").groupBy("doc_id").agg(F.sum("size").alias("met"))
    centres = (
        members.join(known, "doc_id")
        .groupBy("bucket")
        .agg(F.max(F.struct("met", (-F.col("doc_id")).alias("u"))).alias("c"))
        .select("bucket", (-F.col("c.u")).alias("u"))
    )
    stars = members.select("bucket", F.col("doc_id").alias("v")).join(centres, "bucket")
    pairs = stage(_pairs(stars), "pairs")
    links = stage(confirm(pairs, blobs, press, how), "near-links")
    found = components(links)
    # Each pair with a bucket's centre is done, so buckets of two are.
    open_ = stage(_unsettled(_labelled(members, found)).where("size > 2"), "unsettled")
    if open_.isEmpty():
        return found
    fresh = _pairs(_neighbours(open_, reps, how)).join(pairs, ["u", "v"], "left_anti")
    links = stage(confirm(fresh, blobs, press, how), "near-links")
    if not links.isEmpty():
        found = components(found.unionByName(links))
        open_ = stage(_unsettled(_labelled(open_.select("bucket", "doc_id"), found)), "unsettled")
    links = stage(settle(open_, blobs, press, how), "near-links")
    return found if links.isEmpty() else components(found.unionByName(links))


def near_duplicates(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """The component of near-duplicates that each document is in.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of
    shingles: runs of ``words`` words, A-Z in lower case; a shorter text is one
    shingle. Columns: doc_id, n_shingles, component_id (the least doc_id reachable),
    kept (doc_id = component_id), a row for each row of ``docs``.

    A text that is NULL or has no words has an empty set and no link. Rows of one id
    are one document as to links. A row with a NULL id takes no part: its component is
    NULL and it is kept. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    told = stage(describe(texts, how), "sets")
    part = told.where("n > 0 and doc_id is not null")
    classes = stage(
        part.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")),
        "classes",
    )
    reps = classes.select(F.col("rep").alias("doc_id"), "keys")

    found = class_components(reps, texts, how)
    placed = told.select("doc_id", "n", "f1", "f2").join(
        classes.drop("keys"), ["f1", "f2", "n"], "left"
    )
    several = (
        placed.groupBy("doc_id")
        .agg(F.min("rep").alias("x"), F.max("rep").alias("y"))
        .where("x != y")
        .select("doc_id")
    )
    ties = stage(placed.join(several, "doc_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")), "ties")
    if not ties.isEmpty():
        found = components(found.unionByName(ties.where("v is not null")))
    end = found.select(F.col("u").alias("rep"), F.col("v").alias("least"))
    return (
        placed.withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
        .join(end, "rep", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "rep").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def without_near_duplicates(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """``docs`` with one document of each component: that of the least id."""
    kept = near_duplicates(docs, how).where("kept").select("doc_id").distinct().alias("k")
    d = docs.alias("d")
    return d.join(kept, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), "left_semi")
