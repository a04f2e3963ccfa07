"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut in two halves, each quantised by its own centroids; a pair of
centroids is a cell. For a query the inner products of its halves with the centroids
are two sorted lists, and a heap walks through the pairs by falling sum until the
cells visited hold a given share of all vectors. The vectors in them are ranked by
their exact inner product.

The work is dealt by first centroid, in blocks of bounded numbers of queries and
vectors; a block gives its nearest for each query, and these are merged.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramwise.llm.common import hash_share, small_batches, stage


@dataclass(frozen=True)
class MultiIndex:
    """Size of the index, how much of it a query visits, and sizes of blocks.

    ``share`` is what recall costs: independent random vectors have no near
    neighbours to speak of and need 0.55 for a recall of 0.95; clustered ones need less.
    """

    centroids: int = 64  # of each half
    sample: int = 20_000  # vectors that the centroids are fitted on, at most
    rounds: int = 12
    share: float = 0.55
    queries: int = 1000  # of a block
    vectors: int = 4000  # of a block


def kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centroids; fewer than ``k`` if there are fewer different vectors."""
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    centres = x[np.random.default_rng(k).choice(len(x), k, replace=False)] if k else x
    for _ in range(rounds):
        near = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1) if k else np.zeros(0, int)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)


def traverse(a: np.ndarray, b: np.ndarray, counts: np.ndarray, wanted: float) -> np.ndarray:
    """Which cells are visited: pairs by falling ``a[i] + b[j]`` until they hold ``wanted``."""
    first, second = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    down, across = a[first].tolist(), b[second].tolist()
    held = counts[np.ix_(first, second)].tolist()
    done = [0] * len(down)  # pairs popped in each row; rows shrink downwards
    visited = np.zeros(counts.shape, bool)
    heap, have = [(-(down[0] + across[0]), 0, 0)], 0
    while heap and have < wanted:
        _, i, j = heappop(heap)
        done[i] = j + 1
        if held[i][j]:
            have += held[i][j]
            visited[first[i], second[j]] = True
        # A pair is pushed once the pairs above it and to its left are popped.
        if j + 1 < len(across) and (i == 0 or done[i - 1] > j + 1):
            heappush(heap, (-(down[i] + across[j + 1]), i, j + 1))
        if i + 1 < len(down) and done[i + 1] == j:
            heappush(heap, (-(down[i + 1] + across[j]), i + 1, j))
    return visited


def best_of_block(q_ids, q, allowed, ids, x, second, k: int):
    """(query, vector, score) of the ``k`` nearest allowed vectors of each query."""
    order = np.argsort(ids, kind="stable")
    ids, x, second = ids[order], x[order], second[order]
    rough = q @ x.T
    rough[~allowed[:, second] | (q_ids[:, None] == ids[None])] = -np.inf
    queries, found, scores = [], [], []
    slack = 1e-9 * (np.abs(q).max(1) * np.abs(x).max() * x.shape[1] + 1e-300)
    for i in range(len(q)):
        row = rough[i]
        bar = np.partition(row, -k)[-k] if len(row) > k else -np.inf
        near = np.flatnonzero((row >= bar - slack[i]) & (row > -np.inf))
        # Equal vectors get equal scores here, whatever block they are in.
        exact = (x[near] * q[i]).sum(1)
        top = np.lexsort([ids[near], -exact])[:k]
        queries.append(np.full(len(top), q_ids[i]))
        found.append(ids[near][top])
        scores.append(exact[top])
    return tuple(np.concatenate(c) if c else np.zeros(0) for c in (queries, found, scores))


def _matrix(blobs, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(-1, width)


def valid_vectors(table: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(vec_id, v) with v as array<double>, a row per id, and the number of components.

    Rows take part if their id and vector are not NULL, the vector has as many
    components as most have (the fewer of equally frequent numbers), all of them finite and not all zero. Of rows with one id the
    least vector counts.
    """
    v = F.col(vector).cast("array<double>")
    rows = table.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull()
        & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists("v", lambda c: c != 0)
    )
    widths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = widths.n if widths else 0
    return rows.where(F.size("v") == width).groupBy("vec_id").agg(F.min("v").alias("v")), width


def nearest(
    table: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    every: int = 20,
    k: int = 20,
    how: MultiIndex = MultiIndex(),
) -> DataFrame:
    """The ``k`` nearest vectors found for each row whose id ``every`` divides.

    Nearness is the inner product in double precision. Columns: query_id, rank (from
    1), vec_id, score; ties go to the smaller id; a query is not its own neighbour.
    Vectors that are NULL, zero, or hold a NULL or non-finite component take no part;
    see :func:`valid_vectors` for repeated ids and odd lengths. An empty table gives no
    rows. Other columns are not read.
    """
    spark = table.sparkSession
    small_batches(spark)
    rows, width = valid_vectors(table, key, vector)
    rows = stage(rows, "vectors")
    half = width // 2
    some = rows.where(hash_share("vec_id", 2 * how.sample, rows.count()))
    sample = some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(how.sample).select("v").collect()
    x = np.array([r.v for r in sample], float).reshape(len(sample), width)
    books = [kmeans(p, how.centroids, how.rounds) for p in (x[:, :half], x[:, half:])]
    shape = [max(len(b), 1) for b in books]
    held = spark.sparkContext.broadcast(books)  # 2 * centroids vectors of half the width

    def place(batches):
        one, two = held.value
        for batch in batches:
            v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, width)
            ids = batch.column("vec_id")
            c1, c2 = nearest_centre(v[:, :half], one), nearest_centre(v[:, half:], two)
            blobs = pa.array([r.tobytes() for r in v.astype("<f8")], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(c1, pa.int32()), pa.array(c2, pa.int32()), blobs],
                ["vec_id", "first", "second", "v"],
            )

    index = stage(
        rows.mapInArrow(place, "vec_id long, first int, second int, v binary"), "multi-index"
    )
    counts = np.zeros(shape, np.int64)  # a number for each cell
    for r in index.groupBy("first", "second").count().collect():
        counts[r["first"], r["second"]] = r["count"]
    wanted = max(how.share * counts.sum(), k + 1)
    cells = spark.sparkContext.broadcast(counts)

    def route(batches):
        one, two = held.value
        for batch in batches:
            v = _matrix(batch.column("v").to_pylist(), width)
            a, b = v[:, :half] @ one.T, v[:, half:] @ two.T
            for i in range(len(v)):
                visited = traverse(a[i], b[i], cells.value, wanted)
                first = np.flatnonzero(visited.any(1))
                n = len(first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("vec_id")[i].as_py()] * n, pa.int64()),
                        pa.array(first, pa.int32()),
                        pa.array([visited[f].tobytes() for f in first], pa.binary()),
                        pa.array([batch.column("v")[i].as_py()] * n, pa.binary()),
                    ],
                    ["query_id", "first", "allowed", "q"],
                )

    routed = stage(
        index.where(F.col("vec_id") % every == 0)
        .select("vec_id", "v")
        .mapInArrow(route, "query_id long, first int, allowed binary, q binary"),
        "routed",
    )
    # Each first centroid is cut into blocks: so many of queries times so many of vectors.
    asked = {r["first"]: r["count"] for r in routed.groupBy("first").count().collect()}
    per_first = counts.sum(1)
    pieces = F.create_map(
        *[F.lit(p) for f in range(shape[0]) for p in (
            f, F.array(F.lit(-(-asked.get(f, 0) // how.queries)), F.lit(int(-(-per_first[f] // how.vectors))))
        )]
    )[F.col("first")]

    def dealt(frame, own, other, ident):
        mine = F.pmod(F.xxhash64(ident), F.greatest(pieces[own], F.lit(1)))
        return frame.withColumn(f"b{own}", mine).withColumn(
            f"b{other}", F.explode(F.sequence(F.lit(0), F.greatest(pieces[other], F.lit(1)) - 1))
        ).withColumns({c: F.col(c).cast("int") for c in ("b0", "b1")})

    queries = dealt(routed, 0, 1, "query_id")
    vectors = dealt(index.where(F.col("first").isin(list(asked)) if asked else F.lit(False)), 1, 0, "vec_id")
    block = ["first", "b0", "b1"]

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        allowed = np.frombuffer(b"".join(left["allowed"]), bool).reshape(len(left), -1)
        found = best_of_block(
            left["query_id"].to_numpy(), _matrix(left["q"], width), allowed,
            right["vec_id"].to_numpy(), _matrix(right["v"], width), right["second"].to_numpy(), k,
        )
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    found = (
        queries.groupBy(*block)
        .cogroup(vectors.groupBy(*block))
        .applyInPandas(rank, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
