"""Whitening of embeddings with a bidiagonal qd solver.

Vectors are taken in fixed point: an entry c becomes the integer floor(scale * c) + shift.
Sums are then exact, rows are centred exactly, and the squared deviations are exact too.

1. Sums of each dimension, added up inside each task first.
2. Blockwise QR: each task folds its centred rows, block by block, into one triangular
   factor R. These factors are merged in a tree, so that neither a task nor the driver ever
   holds more than ``FAN`` of them; one factor of the size of the dimensions is left.
3. Householder reflections turn R into an upper bidiagonal B = U'RV. Its singular values come
   from dqds, the differential quotient-difference sweep with shifts, which loses no relative
   accuracy, and the vectors of the largest from twisted factorisations of B'B. V turns them
   into the eigenvectors of the covariance. This is work on one matrix of the dimensions,
   whatever the number of rows.
4. Rows are projected in a map-only pass, by directions that hold dimensions x components
   numbers. A further small aggregate measures how far the covariance of what comes out is
   from the identity.

Defined results: vectors that are null or hold null or non-finite entries take no part, nor
do those with an entry of 2**51 or more (its fixed point would not fit); vectors of different
lengths are fitted and whitened apart, each length on its own; empty vectors have no
components; there are as many components as the covariance has rank, ``most`` at most, so
that equal rows have none; repeated rows count as often as they stand; null ids are kept; a
deviation that does not fit in 64 bits is null. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .lineage import cut
from .topk import usable

#: Triangular factors that are merged at a time, at most, and bytes of them.
FAN, FAN_BYTES = 16, 1 << 28
#: Rows that are folded into a factor at a time.
BLOCK = 4096
EPS = 2.0**-52
#: Neighbouring eigenvalues whose relative distance is below get their vectors together.
CLOSE = 1e-5


class Model(NamedTuple):
    """Whitening of vectors of one length."""

    n: int
    #: exact, one of each dimension
    sums: list[int]
    #: eigenvalues of the covariance, falling, and their sum with those left out
    values: np.ndarray
    total: float
    #: one column a component
    directions: np.ndarray


# ---- one bidiagonal matrix --------------------------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, upper diagonal, V) of a square R = U B V'."""
    a, n = np.array(r, dtype=float), len(r)
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0 or len(x) < 2 or not np.any(x[1:]):
            return None
        h = x.copy()
        h[0] += math.copysign(size, x[0])
        return h / np.linalg.norm(h)

    for k in range(n):
        if (h := reflector(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(h, h @ a[k:, k:])
        if (h := reflector(a[k, k + 1 :])) is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ h, h)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ h, h)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), v


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds sweep; None if the shift is above the smallest value."""
    d, to_q, to_e = q[0] - shift, [], []
    for i, x in enumerate(e):
        if d < 0:
            return None
        s = d + x
        if s == 0:
            return None
        t = q[i + 1] / s
        to_q.append(s)
        to_e.append(x * t)
        d = d * t - shift
    if not d >= 0:
        return None
    return [*to_q, d], to_e


def _shift(q: list[float], e: list[float]) -> float:
    """A guess below the smallest value: that of the last two rows, less what ties them to the rest."""
    tie, low = math.sqrt(q[-1] * e[-1]), q[-1]
    high = q[-2] + e[-1]
    half = (high - low) / 2
    root = math.hypot(half, tie)
    value = (high + low) / 2 - root
    if len(q) == 2:
        return max(0.0, value * (1 - 4 * EPS))
    weight = tie / math.hypot(tie, half + root) if tie else 0.0
    return max(0.0, value - weight * math.sqrt(q[-2] * e[-2]))


def singular_squares(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling, by dqds."""
    scale = max(np.abs(diagonal).max(initial=0), np.abs(upper).max(initial=0))
    if not scale:
        return np.zeros(len(diagonal))
    a, b = _nonzero(diagonal / scale), upper / scale
    work, found, small = [((a * a).tolist(), (b * b).tolist(), 0.0)], [], (8 * EPS) ** 2
    while work:
        q, e, sigma = work.pop()
        while q:
            if len(q) == 1 or e[-1] <= small * (sigma + q[-1]):
                found.append(sigma + q.pop())
                if e:
                    e.pop()
                continue
            cut_at = next((i for i in range(len(e) - 2, -1, -1) if e[i] <= small * (sigma + min(q[i], q[i + 1]))), None)
            if cut_at is not None:
                work.append((q[: cut_at + 1], e[:cut_at], sigma))
                q, e = q[cut_at + 1 :], e[cut_at + 1 :]
                continue
            if q[-1] > 1.5 * q[0]:  # values are found from the small end
                q.reverse()
                e.reverse()
            guess = _shift(q, e)
            for shift in (guess, guess / 2, guess / 8, 0.0):
                if (out := _sweep(q, e, shift)) is not None:
                    break
            else:  # a zero on the way: the smallest value is zero to working precision
                q = [max(x, EPS**4) for x in q]
                continue
            (q, e), sigma = out, sigma + shift
    return np.sort(np.array(found))[::-1] * scale**2


def _nonzero(a: np.ndarray) -> np.ndarray:
    """Zeros on the diagonal raised far below what the largest values feel."""
    least = EPS**2 * np.abs(a).max(initial=0) or EPS**2
    return np.where(np.abs(a) < least, least, a)


def twisted_vector(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The unit eigenvector of B'B, B unreduced, at a simple eigenvalue: twisted where the factorisation's pivot is smallest."""
    n = len(a)
    d, l = a * a, np.append(b / a[:-1], 0.0)
    tiny = EPS * float(d.max())
    for _ in range(3):
        s, p = np.empty(n), np.empty(n)
        lower, upper = np.empty(n), np.empty(n)
        s[0] = -value
        for i in range(n - 1):
            pivot = d[i] + s[i]
            pivot = pivot if abs(pivot) > tiny * EPS else tiny * EPS
            lower[i] = d[i] * l[i] / pivot
            s[i + 1] = lower[i] * l[i] * s[i] - value
        p[-1] = d[-1] - value
        for i in range(n - 2, -1, -1):
            pivot = d[i] * l[i] * l[i] + p[i + 1]
            pivot = pivot if abs(pivot) > tiny * EPS else tiny * EPS
            upper[i] = d[i] * l[i] / pivot
            p[i] = p[i + 1] * (d[i] / pivot) - value
        gamma = s + p + value
        r = int(np.argmin(np.abs(gamma)))
        z = np.zeros(n)
        z[r] = 1.0
        for i in range(r - 1, -1, -1):
            z[i] = -lower[i] * z[i + 1]
        for i in range(r, n - 1):
            z[i + 1] = -upper[i] * z[i]
        size = z @ z
        step = gamma[r] / size
        z /= math.sqrt(size)
        if abs(step) <= 2 * EPS * abs(value):
            break
        value += step
    return z


def _cluster_vectors(t: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthonormal vectors of neighbouring eigenvalues of a tridiagonal matrix, by inverse iteration on all of them together."""
    z = np.linalg.qr(np.random.default_rng(1).standard_normal((len(t), len(values))))[0]
    off = t - (values[0] + 64 * EPS * abs(values[0])) * np.eye(len(t))
    for _ in range(4):
        z = np.linalg.qr(np.linalg.solve(off, z))[0]
    return z @ np.linalg.eigh(z.T @ t @ z)[1][:, ::-1]


def largest_eigen(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, unit eigenvectors as columns, sum of all eigenvalues) of R'R, ``most`` at most and no more than its rank."""
    n = r.shape[1]
    square = np.zeros((n, n))
    square[: len(r)] = r
    a, b, v = bidiagonal(square)
    norm = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if not norm:
        return np.zeros(0), np.zeros((n, 0)), 0.0
    a = _nonzero(a)
    edges = [0, *(np.flatnonzero(np.abs(b) <= EPS * norm) + 1).tolist(), n]
    blocks = [(lo, hi, singular_squares(a[lo:hi], b[lo : hi - 1])) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    every = sorted(((x, lo, hi, j) for lo, hi, values in blocks for j, x in enumerate(values.tolist())), reverse=True)
    least = (n * EPS) ** 2 * every[0][0]
    chosen = [x for x in every[:most] if x[0] > least]
    vectors, of_block = np.zeros((n, len(chosen))), {lo: values for lo, _, values in blocks}
    for at, (value, lo, hi, j) in enumerate(chosen):
        values, x, y = of_block[lo], a[lo:hi], b[lo : hi - 1]
        near = values[:-1] - values[1:] < CLOSE * values[:-1]
        first, last = j, j
        while first and near[first - 1]:
            first -= 1
        while last < len(values) - 1 and near[last]:
            last += 1
        if first == last:
            vectors[lo:hi, at] = twisted_vector(x, y, value) if hi - lo > 1 else 1.0
        else:
            whole = np.diag(x) + np.diag(y, 1)
            vectors[lo:hi, at] = _cluster_vectors(whole.T @ whole, values[first : last + 1])[:, j - first]
    return np.array([x[0] for x in chosen]), v @ vectors, float(sum(x[0] for x in every))


# ---- rows -------------------------------------------------------------------------------


def fixed_point(df: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """(id, x): the usable vectors as integers."""
    vector = F.col(vector_col)
    fits = ~F.coalesce(F.exists(vector, lambda c: F.abs(c.cast("double")) >= 2.0**51), F.lit(False))
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(shift).cast("long"))
    return df.filter(usable(vector) & fits).select(F.col(id_col).cast("long").alias("id"), whole.alias("x"))


def _by_length(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix of integers) of the vectors of each length, in blocks of bounded size; empty ones are left out."""
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        for lo in range(0, len(rows), BLOCK):
            some = rows[lo : lo + BLOCK]
            yield d, some, vectors.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), d)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact."""
    most = max(int(np.abs(x).max(initial=0)), 1) * n + max(map(abs, sums))
    if most < 1 << 62:
        return x * np.int64(n) - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _sums(x: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and exact sums of each dimension, by length."""
    number = pa.decimal128(38, 0)

    def add(batches):
        total: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for d, rows, m in _by_length(b.column(0)):
                safe = int(np.abs(m).max(initial=0)) * len(m) < 1 << 62
                own = (m if safe else m.astype(object)).sum(axis=0).astype(object)
                n, so_far = total.get(d, (0, 0))
                total[d] = n + len(rows), so_far + own
        for d, (n, own) in total.items():
            columns = [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(s) for s in own], number)]
            yield pa.RecordBatch.from_arrays(columns, names=["d", "at", "n", "total"])

    parts = x.select("x").mapInArrow(add, "d int, at int, n long, total decimal(38,0)")
    rows = parts.groupBy("d", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # a row a dimension
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: (r["d"], r["at"])):
        out.setdefault(r["d"], (r["n"], []))[1].append(int(r["total"]))
    return out


def _fold(factor: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if factor is None else np.vstack([factor, rows]), mode="r")


def _factors(x: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """The triangular factor of the centred rows of each length."""
    shape = "d int, part long, r binary"

    def reduce(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, m in _by_length(b.column(0)):
                n, total = sums[d]
                held[d] = _fold(held.get(d), (_deviations(m, n, total) / n).astype(float))
        for d, r in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([0], pa.int64()), pa.array([r.tobytes()])], names=["d", "part", "r"])

    def merge(pdf):
        d, held = int(pdf["d"].iloc[0]), None
        for r in pdf["r"]:
            held = _fold(held, np.frombuffer(r).reshape(-1, d))
        return pdf.iloc[:1].assign(r=[held.tobytes()])

    fan = max(2, min(FAN, FAN_BYTES // (8 * max(sums) ** 2)))
    parts = cut(x.select("x").mapInArrow(reduce, shape).withColumn("part", F.spark_partition_id().cast("long")))
    most = parts.agg(F.max("part")).first()[0] + 1
    while most > fan:
        most = -(-most // fan)
        parts = cut(parts.withColumn("part", F.floor(F.col("part") / fan)).groupBy("d", "part").applyInPandas(merge, shape))
    out: dict[int, np.ndarray] = {}
    for d, _, r in parts.collect():  # ``fan`` factors of a length at most
        out[d] = _fold(out.get(d), np.frombuffer(r).reshape(-1, d))
    return out


def fit(vectors: DataFrame, most: int = 8) -> dict[int, Model]:
    """A model for each length of the integer vectors (id, x)."""
    sums = _sums(vectors)
    if not sums:
        return {}
    out = {}
    for d, r in _factors(vectors, sums).items():
        n, total = sums[d]
        values, directions, trace = largest_eigen(r, most)
        out[d] = Model(n, total, values / n, trace / n, directions)
    return out


def _project(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(n * x - S, whitened rows)."""
    off = _deviations(x, model.n, model.sums)
    return off, (off / model.n).astype(float) @ (model.directions / np.sqrt(model.values))


def identity_errors(vectors: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """The largest absolute entry of the whitened rows' covariance minus the identity, by length."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, m in _by_length(b.column(0)):
                w = _project(m, models[d])[1]
                held[d] = held.get(d, 0) + np.vstack([w.T @ w, w.sum(axis=0)])
        for d, own in held.items():
            flat = own.ravel()
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(flat), pa.int32()), pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["d", "at", "total"])

    parts = vectors.select("x").mapInArrow(add, "d int, at int, total double").groupBy("d", "at").agg(F.sum("total").alias("total"))
    cells: dict[int, dict[int, float]] = {}
    for d, at, total in parts.collect():  # a row a pair of components
        cells.setdefault(d, {})[at] = total
    out = {}
    for d, own in cells.items():
        k, n = len(models[d].values), models[d].n
        both = np.array([own[i] for i in range(k * (k + 1))]).reshape(k + 1, k) / n
        out[d] = float(np.abs(both[:k] - np.outer(both[k], both[k]) - np.eye(k)).max(initial=0))
    return out


def whiten(vectors: DataFrame, models: dict[int, Model]) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each vector of (id, x) and component."""
    errors = identity_errors(vectors, models) if models else {}
    shape = pa.schema(
        [("id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]
    )

    def run(batches):
        for b in batches:
            for d, rows, m in _by_length(b.column(1)):
                model = models[d]
                k = len(model.values)
                if not k:
                    continue
                off, w = _project(m, model)
                most = int(np.abs(off).max(initial=0))
                if most * most * d < 1 << 62:
                    square = pa.array((off * off).sum(axis=1), pa.int64())
                else:
                    exact = (off.astype(object) ** 2).sum(axis=1).tolist()
                    square = pa.array([s if s < 1 << 63 else None for s in exact], pa.int64())
                each = pa.array(np.repeat(np.arange(len(rows)), k))
                size = len(rows) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(rows)).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(size, model.n)),
                        square.take(each),
                        pa.array(w.ravel()),
                        pa.array(np.tile(model.values / model.total, len(rows))),
                        pa.array(np.full(size, errors[d])),
                    ],
                    schema=shape,
                )

    return vectors.select("id", "x").mapInArrow(run, "id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op11(embeddings: DataFrame) -> DataFrame:
    """The rows of the query: up to eight components of every usable embedding."""
    x = fixed_point(embeddings, "vec_id", "embedding", 1024, 100_000)
    return whiten(x, fit(x, 8)).withColumnRenamed("id", "vec_id")
