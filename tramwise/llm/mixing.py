"""Mixing sources to target weights by balanced sampling (the cube method).

A document of a source is taken floor(p) or floor(p) + 1 times, where p is the
source's target divided by its size. The fractions of p are inclusion
probabilities. The flight phase moves them, a few documents at a time, along
directions that change neither the expected number of documents nor that of words,
until all but two are 0 or 1. It runs over blocks of documents in parallel; what a
block leaves open goes to the next round, whose blocks are a thousand times fewer.
The landing phase settles the last two documents of a source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramwise.llm.common import WORD, small_batches, stage

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2.0
#: Documents that a block of the flight phase holds, about.
BLOCK = 2_000
EPSILON = 1e-9
#: Up to so many sources their targets are broadcast; more are joined by a shuffle.
FEW_SOURCES = 10_000


def flight(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Move probabilities until at most two lie strictly between 0 and 1.

    Any three open documents have a direction that keeps the sum of p and the sum of
    p * size. A step along it settles at least one of the three.
    """
    p = p.tolist()
    size = size.tolist()
    open_: list[int] = []
    for k in range(len(p)):
        if not EPSILON < p[k] < 1 - EPSILON:
            p[k] = float(round(p[k]))
            continue
        open_.append(k)
        while len(open_) >= 3:
            i, j, m = open_
            # The null space of [[1, 1, 1], sizes].
            u = (size[m] - size[j], size[i] - size[m], size[j] - size[i])
            if u == (0, 0, 0):
                u = (1, -1, 0)
            steps = []
            for at, v in zip(open_, u):
                if v > 0:
                    steps.append(((1 - p[at]) / v, p[at] / v))
                elif v < 0:
                    steps.append((p[at] / -v, (1 - p[at]) / -v))
            # Forth or back so that each p stays what it is on average; the
            # coin is a hash of the three documents, so that reruns agree.
            forth, back = min(s[0] for s in steps), min(s[1] for s in steps)
            coin = (hash((i, j, m, size[i], size[j], size[m])) & 0xFFFFFF) / 0x1000000
            step = forth if coin * (forth + back) < back else -back
            for at, v in zip(open_, u):
                p[at] += step * v
            left = []
            for at in open_:
                if EPSILON < p[at] < 1 - EPSILON:
                    left.append(at)
                else:
                    p[at] = float(round(p[at]))
            if len(left) == 3:  # rounding hid the end of the step
                at = min(left, key=lambda a: min(p[a], 1 - p[a]))
                p[at] = float(round(p[at]))
                left.remove(at)
            open_ = left
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settle the few documents left so that the words come nearest to what is due.

    If they alone cannot bring it near, up to two others of the group change sides.
    """
    due = (p * size).sum()
    open_ = np.flatnonzero((p > EPSILON) & (p < 1 - EPSILON))
    p = p.copy()
    p[open_] = 0.0
    over = (p * size).sum() - due
    best = min(
        range(1 << len(open_)),
        key=lambda c: (abs(over + sum(size[k] for b, k in enumerate(open_) if c >> b & 1)), c),
    )
    for b, k in enumerate(open_):
        p[k] = float(best >> b & 1)
    for _ in range(2 if len(p) else 0):
        over = (p * size).sum() - due
        after = np.abs(over + np.where(p > 0.5, -size, size))
        k = int(after.argmin())
        if after[k] >= abs(over):
            break
        p[k] = 1.0 - p[k]
    return p


def _order(source: Column) -> list[Column]:
    """Sources by code point (UTF-8 order), NULL last."""
    return [source.isNull(), source.cast("binary")]


def targets(
    sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS
) -> DataFrame:
    """Adds ``target`` to ``sizes``, which has a row per source and its source_size.

    Targets share ``share`` of all sizes by weight. Those above ``most`` times their
    source's size stop there and the excess goes to the others, until none is above.
    In the end a source is full exactly if its size per weight is small, so ordering
    by that ratio replaces the rounds.
    """
    n = F.row_number().over(Window.orderBy(*_order(F.col("source")))) - 1
    listed = sizes.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    )
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), *_order(F.col("source")))
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    size = F.col("source_size").cast("double")
    whole = Window.partitionBy()
    return (
        listed.withColumn("budget", F.sum(size).over(whole) * share)
        .withColumn("rest", F.col("budget") - most * F.coalesce(F.sum(size).over(upto), F.lit(0.0)))
        .withColumn("fair", F.col("rest") * F.col("weight") / F.sum("weight").over(after))
        # The first source, by ratio, that is not full sets the level of all.
        .withColumn("level", F.when(F.col("fair") <= most * size, F.col("fair") / F.col("weight")))
        .withColumn("at", F.struct((F.col("source_size") / F.col("weight")).alias("ratio"), F.col("level")))
        .withColumn("at", F.min(F.when(F.col("level").isNotNull(), F.col("at"))).over(whole))
        .withColumn("target", F.least(most * size, F.col("at.level") * F.col("weight")))
        .drop("weight", "budget", "rest", "fair", "level", "at")
    )


def _round(open_: DataFrame, last: bool) -> DataFrame:
    """One flight over blocks of each source; the last one also lands."""
    names = open_.columns

    def fly(part: pd.DataFrame) -> pd.DataFrame:
        # Long documents first: what is left to the landing is short.
        part = part.sort_values(
            ["total", "mark", "key"], ascending=[False, True, True], kind="stable"
        )
        total = part["total"].to_numpy(np.int64)
        p = flight(part["p"].to_numpy(float), total)
        return part.assign(p=landing(p, total) if last else p)[names]

    block = F.lit(0) if last else F.pmod(F.col("mark"), F.col("blocks"))
    return (
        open_.withColumn("block", block)
        .groupBy("source", "block")
        .applyInPandas(lambda part: fly(part.drop(columns="block")), open_.schema)
    )


def words(text: Column) -> Column:
    """How many words a text has; 0 for NULL."""
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def decide(
    docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS
) -> DataFrame:
    """A row for each (doc_id, source, size) of ``docs``: how often it is taken.

    Columns: those three, rows (that agree in them), source_size, target, repeats.
    """
    small_batches(docs.sparkSession)
    units = stage(
        docs.select(F.col("doc_id").cast("long"), "source", words(F.col("text")).alias("size"))
        .groupBy("doc_id", "source", "size")
        .agg(F.count("*").alias("rows")),
        "mix-units",
    )
    sums = stage(
        units.groupBy("source").agg(
            F.sum(F.col("size") * F.col("rows")).alias("source_size"),
            F.count("*").alias("units"),
        ),
        "mix-sources",
    )
    sources, largest = sums.select(F.count("*"), F.coalesce(F.max("units"), F.lit(0))).first()
    aims = targets(sums, weights, share, most)
    if sources <= FEW_SOURCES:
        aims = F.broadcast(aims)
    due = (
        units.alias("u")
        .join(aims.alias("a"), F.col("u.source").eqNullSafe(F.col("a.source")))
        .select("u.*", "a.source_size", "a.target", "a.units")
        .withColumn("times", F.least(F.lit(most), F.try_divide(F.col("target"), F.col("source_size"))))
        .withColumn("times", F.when(F.col("size") > 0, F.col("times")).otherwise(0.0))
        .withColumn("whole", F.floor(F.col("times") + EPSILON))
        .withColumn("p", F.greatest(F.lit(0.0), F.col("times") - F.col("whole")))
        .withColumn("total", F.col("size") * F.col("rows"))
        .withColumn("mark", F.xxhash64("doc_id", "size", "source"))
        .withColumn("blocks", F.floor(F.col("units") / BLOCK) + 1)
        # A NULL would turn the ids of its whole block into floating point.
        .withColumn("no_id", F.col("doc_id").isNull())
        .withColumn("key", F.coalesce("doc_id", F.lit(0)))
        .drop("times", "doc_id", "units")
    )
    settled = (F.col("p") <= EPSILON) | (F.col("p") >= 1 - EPSILON)
    done, open_ = due.where(settled), due.where(~settled)
    while largest > BLOCK:
        flown = stage(_round(open_, last=False), "mix-flight")
        done, open_ = done.unionByName(flown.where(settled)), flown.where(~settled)
        largest = 2 * (largest // BLOCK + 1)
        open_ = open_.withColumn("mark", F.xxhash64("mark")).withColumn(
            "blocks", F.floor(2 * F.col("blocks") / BLOCK) + 1
        )
    return done.unionByName(_round(open_, last=True)).select(
        F.when(~F.col("no_id"), F.col("key")).alias("doc_id"),
        "source",
        "size",
        "rows",
        "source_size",
        "target",
        (F.col("whole") + F.round("p")).cast("long").alias("repeats"),
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """How many words the mix takes of each document.

    Columns: doc_id, source, size (words of the text, 0 for NULL), source_size,
    target (that of the source), taken (repeats counted), repeats; a row for each row
    of ``docs``. NULL sources form one source, the last. Rows that agree in doc_id,
    source and size are decided together. Documents without words are taken 0 times;
    sources without words have target 0. The same rows give the same mix, however
    they are partitioned. Other columns are not read.
    """
    return (
        decide(docs, **how)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            (F.col("size") * F.col("repeats")).alias("taken"),
            "repeats",
        )
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, whole rows of ``docs``, repeated as the mix says.

    ``copy`` numbers the repeats from 1, in place of a column of that name; the other
    columns are those of ``docs``.
    """
    told = decide(docs, **how).select("doc_id", "source", "size", "repeats").where("repeats > 0").alias("m")
    own = docs.alias("d")
    same = (
        F.col("d.doc_id").eqNullSafe(F.col("m.doc_id"))
        & F.col("d.source").eqNullSafe(F.col("m.source"))
        & (words(F.col("d.text")) == F.col("m.size"))
    )
    return own.join(told, same).select(
        *[F.col(f"d.`{c}`") for c in docs.columns if c != "copy"],
        F.explode(F.sequence(F.lit(1), F.col("m.repeats"))).alias("copy"),
    )
