"""Exact top-k by inner product with no random access (NRA).

Every dimension is a list of the vectors sorted by their value. A query reads the list of a
dimension from the end that helps its score, downwards if its weight is positive and upwards
if it is negative, all lists to the same depth. What has been read gives each vector a
certain part of its score; what has not been read lies between the list's last value and the
value at the reading point. Reading stops when so few vectors have an upper bound that
reaches the k-th best lower bound that resolving these finally is cheaper than to read on.
Vectors outside that set cannot qualify, so that the result is exact.

Vectors are dealt to blocks of bounded size by row, queries to blocks of bounded size, and
each pair of blocks is one group: lists, bounds and partial results live inside a group, and
all queries of a block read in step, as matrix products. Each group returns k rows a query,
which a window merges. The work is queries times vectors, in blocks, as exact search over
given queries needs.

Defined results: vectors that are null or hold null or non-finite components take no part,
nor do rows with a null id; vectors are compared only with vectors of the same length (an
empty vector scores 0 with others); ties go to the smaller id; repeated rows are candidates
as often as they stand, a repeated query row gets its own result, and rows with the query's
id are never its candidates; with fewer than k candidates all are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Vectors and queries in a block at most.
BLOCK, QUERY_BLOCK = 8192, 1024
#: Shares of the lists read before the bounds are looked at.
DEPTHS = (0.25, 0.45, 0.65, 0.85)


def _dtype(x: np.ndarray, q: np.ndarray) -> type:
    """The smallest type in which every partial sum is exact."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def nra(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the rows of ``x`` with the k best scores, best first, and these scores."""
    n, d = x.shape
    kind = _dtype(x, q)
    x, q = x.astype(kind), q.astype(kind)
    up, down = np.maximum(q, 0).T, np.minimum(q, 0).T
    own = [np.flatnonzero(ids == i) for i in query_ids]
    found: list = [None] * len(q)

    def resolve(j: int, rows: np.ndarray) -> None:
        scores = x[rows] @ q[j]
        best = np.lexsort((ids[rows], -scores))[:k]
        found[j] = rows[best], scores[best]

    active = np.arange(len(q))
    if n > k and d and kind is not object:
        order = np.argsort(x, axis=0, kind="stable")
        ordered = np.take_along_axis(x, order, axis=0)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
        least, most = ordered[0], ordered[-1]
        for share in DEPTHS:
            depth = min(n - 1, max(1, int(n * share)))
            top, low = rank >= n - depth, rank < depth
            a, b = up[:, active], down[:, active]
            lower = np.where(top, x, least) @ a + np.where(low, x, most) @ b
            upper = np.where(top, x, ordered[n - 1 - depth]) @ a + np.where(low, x, ordered[depth]) @ b
            for at, j in enumerate(active):
                lower[own[j], at] = upper[own[j], at] = -np.inf
            bar = np.partition(lower, n - k, axis=0)[n - k]
            may = (upper >= bar) & (upper > -np.inf)
            few = may.sum(axis=0) <= max(4 * k, n // 16)
            for at in np.flatnonzero(few):
                resolve(int(active[at]), np.flatnonzero(may[:, at]))
            active = active[~few]
            if not len(active):
                return found
    # the lists are read to their ends: all parts of all scores are known
    scores = x @ q[active].T
    for at, j in enumerate(active):
        s, rows = scores[:, at], np.setdiff1d(np.arange(n), own[j])
        if len(rows) > 4 * k and kind is not object:
            rows = rows[s[rows] >= np.partition(s[rows], len(rows) - k)[len(rows) - k]]
        best = rows[np.lexsort((ids[rows], -s[rows]))[:k]]
        found[j] = best, s[best]
    return found


def usable(vector: Column) -> Column:
    """True for vectors without null, NaN or infinite components."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score) of integer-valued double vectors; both sides have (id, vector)."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame) -> DataFrame:
        return df.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).cast("long").alias("id"),
            F.col(vector_col).cast("array<double>").alias("vector"),
        )

    n, m = vectors.count(), queries.count()
    blocks = max(-(-n // BLOCK), min(parts, -(-n // 512)), 1)
    query_blocks = max(-(-m // QUERY_BLOCK), 1)
    at = lambda count: F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = dealt(vectors).select("row", "id", "vector", F.lit(False).alias("asks"), at(blocks).alias("b"), every(query_blocks).alias("q"))
    right = dealt(queries).select("row", "id", "vector", F.lit(True).alias("asks"), at(query_blocks).alias("q"), every(blocks).alias("b"))
    both = left.unionByName(right).select(
        F.xxhash64(F.size("vector"), "b", "q").alias("gid"), "asks", "row", "id", "vector"
    )
    shape = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def group(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        asks = batch.column(1).to_numpy(zero_copy_only=False)
        if asks.all() or not asks.any():
            return None
        rows, ids = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        data = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        given, q_rows, q_ids = ids[~asks], rows[asks], ids[asks]
        found = nra(given, data[~asks], q_ids, data[asks], k)
        count = [len(r) for r, _ in found]
        if not sum(count):
            return None
        bound = np.iinfo(np.int64)
        scores = [int(min(max(s, bound.min), bound.max)) for _, ss in found for s in ss.tolist()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(q_rows, count)),
                pa.array(np.repeat(q_ids, count)),
                pa.array(given[np.concatenate([r for r, _ in found])]),
                pa.array(scores, type=pa.int64()),
            ],
            schema=shape,
        )

    def by_group(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            gid = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(gid[1:] != gid[:-1]) + 1).tolist(), len(gid)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if held and held[0].column(0)[0].as_py() != gid[lo]:
                    if (out := group(_one(held))) is not None:
                        yield out
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held and (out := group(_one(held))) is not None:
            yield out

    part = both.repartition(parts, "gid").sortWithinPartitions("gid").mapInArrow(
        by_group, "row long, query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def op6(embeddings: DataFrame) -> DataFrame:
    """The rows of the query: every fiftieth vector against all others, five each."""
    ints = embeddings.filter(usable(F.col("embedding"))).select(
        "vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * 256).cast("double")).alias("vector")
    )
    return top_k(ints, ints.filter(F.col("vec_id") % 50 == 0), 5)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
