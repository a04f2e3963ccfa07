"""Whitening of vectors from the exact characteristic polynomial of their scatter.

Entries become integers, so sums and products over all vectors are exact, and n times the
scatter is an integer matrix A. Its characteristic polynomial is found modulo many primes
(Hessenberg reduction, a task for some primes each) and put together by Chinese
remaindering. All its roots are real, so the sign changes of the shifted polynomial count
the roots above a point exactly; bisection isolates them and narrows them far below the
least gap. Inverse iteration in long fixed-point numbers then gives the null space of
A minus a root, which is the component.

What reaches the driver is bounded by the dimension: its square for the sums, and for the
polynomial one residue of each coefficient for each prime.
"""

from __future__ import annotations

import random
from fractions import Fraction
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramwise.llm.common import small_batches

COMPONENTS = 32
#: Entries are clipped here, far within the range of a long.
FAR = float(1 << 62)


# -- Integer vectors ----------------------------------------------------------


def whole_numbers(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * entry) of each vector; all are clean and of one length."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        values = np.clip(np.floor(scale * values), -FAR, FAR)
    return values.astype(np.int64).reshape(len(column), -1)


def _largest(y: np.ndarray) -> int:
    return max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))


def products(y: np.ndarray) -> np.ndarray:
    """y' y, exactly, as Python integers."""
    if _largest(y) ** 2 * max(len(y), 1) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    own = y.astype(object)
    return own.T @ own


def deviations(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * y - sums, exactly: longs, or Python integers where those are too short."""
    most = n * _largest(y) + max(map(abs, sums), default=0)
    if most < 1 << 62:
        return n * y - np.array(sums, np.int64)
    return n * y.astype(object) - np.array(sums, object)


def squares(dev: np.ndarray) -> pa.Array:
    """The sum of squares of each row, exactly; NULL beyond 38 digits."""
    if dev.dtype != object and _largest(dev) ** 2 * max(dev.shape[1], 1) < 1 << 63:
        return pa.array((dev * dev).sum(1)).cast(pa.decimal128(38, 0))
    own = dev.astype(object)
    found = [v if v < 10**38 else None for v in (own * own).sum(1).tolist()]
    return pa.array(found, pa.decimal128(38, 0))


def _cells(matrix):
    """(i, j, high, low) of the upper half of a symmetric matrix of integers."""
    d = len(matrix)
    for i in range(d):
        for j in range(i, d):
            yield i, j, int(matrix[i][j]) >> 64, int(matrix[i][j]) & (1 << 64) - 1


def exact_sums(vectors: DataFrame, d: int, scale: int):
    """(n, sums, products) over all vectors, as Python integers."""
    shape = pa.schema(
        [("i", pa.int32()), ("j", pa.int32()), ("high", pa.decimal128(38, 0)), ("low", pa.decimal128(38, 0))]
    )

    def run(batches):
        n, sums, total = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            y = whole_numbers(batch.column("vector"), scale)
            n += len(y)
            sums = sums + y.astype(object).sum(0)
            total = total + products(y)
        if n:
            cells = [(-1, -1, 0, n), *((i, -1, int(s) >> 64, int(s) & (1 << 64) - 1) for i, s in enumerate(sums))]
            cells += _cells(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*cells), shape)], schema=shape
            )

    parts = vectors.select("vector").mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)")
    rows = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    n, sums, total = 0, [0] * d, [[0] * d for _ in range(d)]
    for i, j, high, low in rows:
        value = (int(high) << 64) + int(low)
        if i < 0:
            n = value
        elif j < 0:
            sums[i] = value
        else:
            total[i][j] = total[j][i] = value
    return n, sums, total


# -- Characteristic polynomial ------------------------------------------------


def is_prime(n: int) -> bool:
    """Miller's test with bases that are enough below 2**64."""
    if n < 2 or any(n % q == 0 for q in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)):
        return n in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
    odd = n - 1
    twos = (odd & -odd).bit_length() - 1
    odd >>= twos
    for base in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(bits: int) -> list[int]:
    """Primes below 2**31 whose product has more than ``bits`` bits."""
    found, product, n = [], 1, (1 << 31) - 1
    while product.bit_length() <= bits:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo ``p``, that of x**0 first."""
    h = matrix % p
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + below[0]
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(1)) % p
    # Leading minors of x - h, one after the other.
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(d):
        own = np.zeros(d + 1, np.int64)
        own[1:] = minors[k, :-1]
        weights, chain = np.zeros(k + 1, np.int64), 1
        weights[k] = h[k, k]
        for i in range(k - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            weights[i] = int(h[i, k]) * chain % p
        minors[k + 1] = (own - (weights[:, None] * minors[: k + 1] % p).sum(0)) % p
    return minors[d]


def coefficient_bits(trace: int, d: int) -> int:
    """Bits of the largest coefficient, by the means of eigenvalues that are not negative."""
    return max((comb(d, k) * trace**k // d**k).bit_length() for k in range(d + 1)) + 2


def _tasks(spark: SparkSession, items: int):
    return spark.range(0, items, 1, max(1, min(items, 4 * spark.sparkContext.defaultParallelism)))


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Integer coefficients of det(x - matrix), that of x**0 first."""
    d = len(matrix)
    primes = primes_for(coefficient_bits(sum(matrix[i][i] for i in range(d)), d))
    held = spark.sparkContext.broadcast((matrix, primes))

    def run(batches):
        matrix, primes = held.value
        own = np.array(matrix, object)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                found = polynomial_modulo((own % primes[k]).astype(np.int64), primes[k])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int64()), pa.array([found.tolist()], pa.list_(pa.int64()))], ["k", "c"]
                )

    rows = _tasks(spark, len(primes)).mapInArrow(run, "k long, c array<long>").collect()
    product = 1
    for p in primes:
        product *= p
    total = [0] * (d + 1)
    for k, c in rows:
        rest = product // primes[k]
        weight = rest * pow(rest, -1, primes[k])
        total = [t + v * weight for t, v in zip(total, c)]
    total = [t % product for t in total]
    return [t - product if 2 * t > product else t for t in total]


# -- Roots --------------------------------------------------------------------


def roots_above(c: list[int], at: int, bits: int) -> int:
    """How many roots exceed at / 2**bits, repeated ones repeatedly; all roots are real."""
    d = len(c) - 1
    own = [v << bits * (d - k) for k, v in enumerate(c)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            own[k] += at * own[k + 1]
    signs = [v > 0 for v in own if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value(c: list[int], at: int, bits: int) -> int:
    total, d = 0, len(c) - 1
    for k in range(d, -1, -1):
        total = total * at + (c[k] << bits * (d - k))
    return total


def distinct_roots(c: list[int]) -> int:
    """The number of different roots: the degree less that of gcd(c, c')."""
    least = len(c)
    for p in primes_for(60):
        a, b = [v % p for v in c], [k * v % p for k, v in enumerate(c)][1:]
        while any(b):
            while not b[-1]:
                b.pop()
            inverse = pow(b[-1], -1, p)
            while len(a) >= len(b):
                q = a[-1] * inverse % p
                for i in range(1, len(b) + 1):
                    a[-i] = (a[-i] - q * b[-i]) % p
                a.pop()
            a, b = b, a or [0]
        least = min(least, len(a) - 1)
    return len(c) - 1 - least


def isolate(c: list[int], count: int):
    """Intervals with one root each, falling, for the largest ``count``; and the least gap.

    An interval is (low, high, bits, multiplicity): low / 2**bits to high / 2**bits, its
    upper end included. All roots are positive. Neighbours, and zero, lie at least as far
    apart as they are wide.
    """
    top = 1
    while roots_above(c, 1 << top, 0):
        top *= 2
    wanted = distinct_roots(c)
    pieces = [(0, 1 << top, 0, len(c) - 1)]
    above = {(0, 0): len(c) - 1}

    def over(at, bits):
        while bits and not at & 1:
            at, bits = at >> 1, bits - 1
        if (at, bits) not in above:
            above[at, bits] = roots_above(c, at, bits)
        return above[at, bits]

    while True:
        split = []
        for low, high, bits, _ in pieces:
            if high - low == 1:
                low, high, bits = low * 2, high * 2, bits + 1
            middle = (low + high) // 2
            for a, b in ((middle, high), (low, middle)):
                held = over(a, bits) - over(b, bits)
                if held:
                    split.append((a, b, bits, held))
        pieces = split
        if len(pieces) == wanted:
            spans = [(Fraction(a, 1 << s), Fraction(b, 1 << s)) for a, b, s, _ in pieces]
            apart = all(x[0] - y[1] >= max(x[1] - x[0], y[1] - y[0]) for x, y in zip(spans, spans[1:]))
            if apart and spans[-1][0] > 0:
                break
    kept, total = [], 0
    for piece in pieces:
        kept.append(piece)
        total += piece[3]
        if total >= count:
            break
    return kept, min([x[0] - y[1] for x, y in zip(spans, spans[1:])] + [spans[-1][0]])


def narrow(c: list[int], low: int, high: int, bits: int, times: int, to: int) -> int:
    """The root in (low, high] / 2**bits, times 2**to, rounded down."""
    if bits < to:
        low, high, bits = low << to - bits, high << to - bits, to
    if times == 1:
        sign = _value(c, high, bits) > 0 or not _value(c, high, bits) and _value(c, low, bits) < 0
    held = roots_above(c, high, bits) if times > 1 else 0
    while high - low > 1 << bits - to:
        middle = (low + high) // 2
        if times > 1:
            left = roots_above(c, middle, bits) == held
        else:
            value = _value(c, middle, bits)
            left = value == 0 or (value > 0) == sign
        low, high = (low, middle) if left else (middle, high)
    return high >> bits - to


# -- Components ---------------------------------------------------------------


def null_space(matrix: list[list[int]], root: int, bits: int, times: int) -> np.ndarray:
    """Unit vectors, ``times`` of them, that A - root / 2**bits sends to almost nothing.

    Inverse iteration with fixed-point numbers far longer than the root is exact.
    """
    d = len(matrix)
    size = max(abs(v) for row in matrix for v in row).bit_length()
    guard = bits + size + 128
    a = np.array([[v << bits for v in row] for row in matrix], object)
    a[np.arange(d), np.arange(d)] -= root
    a = a << (guard - bits)
    draw = random.Random(20240531)
    x = np.array([[draw.getrandbits(64) << guard - 64 for _ in range(times)] for _ in range(d)], object)
    order, factors = np.arange(d), np.zeros((d, d), object)
    for k in range(d):
        pivot = k + int(np.argmax(np.abs(a[k:, k])))
        for held in (a, factors, order):
            held[[k, pivot]] = held[[pivot, k]]
        if not a[k, k]:
            a[k, k] = 1  # a root met exactly
        f = (a[k + 1 :, k] << guard) // a[k, k]
        factors[k + 1 :, k] = f
        a[k + 1 :, k:] -= f[:, None] * a[k, k:] >> guard
    for _ in range(2):
        x = x[order]
        for k in range(d):
            x[k + 1 :] -= factors[k + 1 :, k][:, None] * x[k] >> guard
        for k in range(d - 1, -1, -1):
            x[k] = (x[k] << guard) // a[k, k]
            x[:k] -= a[:k, k][:, None] * x[k] >> guard
        for j in range(times):  # each orthogonal to those before, at unit length
            for i in range(j):
                x[:, j] -= (x[:, i] @ x[:, j]) * x[:, i] >> 2 * guard
            length = isqrt(int(x[:, j] @ x[:, j])) or 1
            x[:, j] = (x[:, j] << guard) // length
    unit = 1 << guard
    found = np.array([[v / unit for v in row] for row in x.tolist()], np.float64).T
    largest = np.argmax(np.abs(found), 1)
    return found * np.sign(found[np.arange(times), largest])[:, None]


def components(spark: SparkSession, matrix: list[list[int]], count: int):
    """(eigenvalues as fractions, unit eigenvectors): the largest ``count`` that are positive.

    Repeated eigenvalues have orthogonal eigenvectors.
    """
    c = characteristic_polynomial(spark, matrix)
    while c and c[0] == 0:  # roots at zero
        c = c[1:]
    if len(c) < 2:
        return [], np.zeros((0, len(matrix)))
    pieces, gap = isolate(c, count)
    # A root's error stays 2**-100 of the least gap, that to zero among them.
    bits = max(0, 100 - (gap.numerator.bit_length() - gap.denominator.bit_length()))
    held = spark.sparkContext.broadcast((matrix, c, pieces))

    def run(batches):
        matrix, c, pieces = held.value
        for batch in batches:
            for k in batch.column("id").to_pylist():
                low, high, own, times = pieces[k]
                root = narrow(c, low, high, own, times, bits)
                found = null_space(matrix, root, bits, times)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k] * times, pa.int64()),
                        pa.array([str(root)] * times),
                        pa.array(found.tolist(), pa.list_(pa.float64())),
                    ],
                    ["k", "root", "vector"],
                )

    rows = _tasks(spark, len(pieces)).mapInArrow(run, "k long, root string, vector array<double>").collect()
    rows = sorted(rows, key=lambda r: (r.k, r.vector))[:count]
    return [Fraction(int(r.root), 1 << bits) for r in rows], np.array([r.vector for r in rows])


# -- Whitening ----------------------------------------------------------------


def _root(x: Fraction) -> float:
    """The square root, to double precision."""
    spare = 256
    return isqrt((x.numerator << 2 * spare) // x.denominator) / (1 << spare)


def identity_error(vectors: DataFrame, project, k: int) -> float:
    """The largest absolute entry of the covariance of the projections less the identity."""
    if not k:
        return 0.0
    shape = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("value", pa.float64())])

    def run(batches):
        n, mean, product = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = project(batch.column("vector"))[1]
            own = w.mean(0)
            w = w - own
            step = own - mean
            share = n * len(w) / (n + len(w))
            product += w.T @ w + share * np.outer(step, step)
            mean += step * len(w) / (n + len(w))
            n += len(w)
        if n:
            i, j = np.triu_indices(k)
            # About zero, which is the mean of all up to rounding.
            about = (product + n * np.outer(mean, mean))[i, j]
            cells = [np.r_[i, np.arange(k), -1], np.r_[j, np.full(k + 1, -1)], np.r_[about, n * mean, n]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(cells, shape)], schema=shape
            )

    # Sums of decimals do not depend on the order of tasks.
    part = vectors.select("vector").mapInArrow(run, "i int, j int, value double")
    rows = part.groupBy("i", "j").agg(F.sum(F.col("value").cast("decimal(38,18)")).cast("double")).collect()
    held = {(i, j): v for i, j, v in rows}
    n = held[-1, -1]
    return max(
        abs(held[i, j] / n - held[i, -1] * held[j, -1] / n**2 - (i == j)) for i in range(k) for j in range(i, k)
    )


ROWS = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"


def whiten(vectors: DataFrame, count: int = COMPONENTS, scale: int = 64, column: str = "embedding") -> DataFrame:
    """Every vector on the largest principal components of all, scaled to unit variance.

    Each entry c counts as the integer floor(``scale`` * c); a shift of all entries would
    change nothing. Columns: vec_id, component (from 1, by falling variance), n (vectors),
    deviation (sum of the squares of n * entry - sum of entries, exact; NULL beyond 38
    digits), whitened, explained (share of the variance), identity_error (how far the
    covariance of ``whitened`` is from the identity). A row for each row of ``vectors`` and
    each of the first ``count`` components of positive variance.

    Vectors that are NULL or empty or hold a NULL, NaN or infinite entry take no part, nor
    do those of another length than most (of lengths equally frequent, the largest
    counts). Repeated rows count each time; a NULL id is kept. Without vectors, or if all
    are equal, there are no components and no rows. Entries beyond 2**62 count as that.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    held = vectors.select(F.col("vec_id").cast("long"), F.col(column).cast("array<double>").alias("vector"))
    clean = held.where("vector is not null and size(vector) > 0").where(
        F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    )
    sizes = clean.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes.d if sizes else 0
    clean = clean.where(F.size("vector") == d)
    n, sums, total = exact_sums(clean, d, scale) if d else (0, [], [])
    scatter = [[n * total[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    roots, found = components(spark, scatter, count) if d else ([], np.zeros((0, 0)))
    k = len(roots)
    turn = found.T / np.array([_root(r) for r in roots]) if k else np.zeros((d, 0))
    trace = sum(scatter[i][i] for i in range(d))
    explained = np.array([float(r / trace) for r in roots])
    model = spark.sparkContext.broadcast((n, sums, turn, explained))  # d * count numbers

    def project(column):
        n, sums, turn, _ = model.value
        dev = deviations(whole_numbers(column, scale), n, sums)
        return dev, dev.astype(np.float64) @ turn

    def run(batches):
        n, _, _, explained = model.value
        k = len(explained)
        for batch in batches:
            if not k or not batch.num_rows:
                continue
            dev, w = project(batch.column("vector"))
            each = np.repeat(np.arange(len(w)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w))),
                    pa.array(np.full(len(each), n)),
                    squares(dev).take(pa.array(each)),
                    pa.array(w.ravel()),
                    pa.array(np.tile(explained, len(w))),
                ],
                [f.split()[0] for f in ROWS.split(", ")],
            )

    error = identity_error(clean, project, k)
    return clean.mapInArrow(run, ROWS).withColumn("identity_error", F.lit(error))
