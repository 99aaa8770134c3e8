"""Cosine scores and exact top-k over vector tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Vectors of a block.
BLOCK = 1024
#: Columns of a match.
MATCH = "query_id long, vec_id long, score double"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Dot product over the norms; a zero vector scores 0 with everything."""
    return F.when((norm_a == 0) | (norm_b == 0), F.lit(0.0)).otherwise(dot(a, b) / (norm_a * norm_b))


def top_k(scores: DataFrame, k: int, min_score: float | None = None) -> DataFrame:
    """The k best per query, ranked; weak matches are dropped afterwards."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best if min_score is None else best.filter(F.col("score") >= min_score)


def held(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = t.column("vec_id").to_numpy()
    e = t.column("e").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    square = np.zeros(len(ids))
    for x in e.T:
        square += x * x
    return ids, e, np.sqrt(square)


def by_length(t: pa.Table):
    """What is held of the vectors of each length, and which of them have a null component."""
    t = t.combine_chunks()
    lengths = pc.list_value_length(t.column("e")).to_numpy()
    for n in np.unique(lengths):
        own = t.filter(pa.array(lengths == n)).combine_chunks()
        nulls = own.column("e").combine_chunks().flatten().is_null().to_numpy(zero_copy_only=False)
        yield *held(own), nulls.reshape(own.num_rows, -1).any(axis=1)


def products(qe: np.ndarray, ve: np.ndarray) -> np.ndarray:
    """Dot products, component by component, so that equal vectors have equal scores."""
    score = np.zeros((len(qe), len(ve)))
    for x, y in zip(qe.T, ve.T, strict=True):
        score += x[:, None] * y[None, :]
    return score


def scorer():
    """A function of a block of queries and a block of vectors: the scores of all pairs."""
    shape = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        out, other = [shape.empty_table()], list(by_length(right))
        for qi, qe, qn, q_null in by_length(left):
            asked = ~q_null & ~(qn <= 0)
            qi, qe, qn = qi[asked], qe[asked], qn[asked]
            for vi, ve, vn, v_null in other:
                with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                    alike = qe.shape[1] == ve.shape[1]
                    score = products(qe, ve) / (qn[:, None] * vn[None, :]) if alike else np.zeros((len(qi), len(vi)))
                score[:, vn == 0] = 0.0
                null = np.broadcast_to(v_null | (not alike) & (vn != 0), score.shape)
                use = qi[:, None] != vi[None, :]
                q, v = np.nonzero(use)
                out.append(pa.Table.from_arrays([pa.array(qi[q]), pa.array(vi[v]), pa.array(score[use], mask=null[use])], schema=shape))
        return pa.concat_tables(out)

    return scores


def matcher(k: int):
    """A function of a block of queries and a block of vectors: each query's k best of the block."""
    shape = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return shape.empty_table()
        (qi, qe, qn), (vi, ve, vn) = held(left), held(right)
        score = products(qe, ve)
        norms = qn[:, None] * vn[None, :]
        score = np.where(norms == 0, 0.0, score / np.where(norms == 0, 1.0, norms))
        use = (qi[:, None] != vi[None, :]) & (qn > 0)[:, None] & ~np.isnan(score)
        out = []
        for i, at in enumerate(map(np.flatnonzero, use)):
            at = at[np.lexsort((vi[at], -score[i, at]))[:k]]
            out.append((np.full(len(at), qi[i]), vi[at], score[i, at]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=shape)

    return best


def in_blocks(vectors: DataFrame, queries: DataFrame, kind: list[str], namespace: str, block: int):
    """Blocks of queries beside blocks of vectors (vec_id, e) of the same kind: of ``ns``, or of ``ns`` and ``size``."""

    def dealt(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        full = df.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.col("vec_id").isNotNull())
        full = full.select("vec_id", F.col(namespace).alias("ns"), F.size("embedding").alias("size"), F.col("embedding").cast("array<double>").alias("e")).filter("ns is not null")
        parts = full.groupBy(*kind).agg(F.ceil(F.count(F.lit(1)) / block).alias(f"{name}s"))
        return full.join(parts, kind).withColumn(name, F.pmod(F.xxhash64("vec_id"), F.col(f"{name}s"))), parts

    (q, q_parts), (v, v_parts) = dealt(queries, "q"), dealt(vectors, "v")
    q = q.join(v_parts, kind).withColumn("v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("vs") - 1)))
    v = v.join(q_parts, kind).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qs") - 1)))
    key = [*kind, "q", "v"]
    own = lambda df: df.select(*(F.col(c).alias(c) for c in (*key, "vec_id", "e"))).groupBy(*key)
    return own(q).cogroup(own(v))


def _gaps(vectors: pa.Array) -> pa.Array:
    each = vectors.flatten()
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(each):
        return pa.array([[] for _ in sizes], pa.list_(pa.float64()))
    e = each.flatten().to_numpy(zero_copy_only=False).reshape(len(each), -1)
    square, inner = np.zeros(len(e)), np.zeros(len(e))
    for x in e.T.astype(np.float64):
        square += x * x
        inner[:-1] += x[:-1] * x[1:]
    length = np.sqrt(square)
    norms = length * np.append(length[1:], 0)
    zero = (length == 0) | np.append(length[1:] == 0, True)
    gap = 1 - np.where(zero, 0.0, inner / np.where(zero, 1.0, norms))
    last = np.zeros(len(e), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True  # no gap behind the last vector of an array
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.maximum(sizes - 1, 0))).astype(np.int32)), pa.array(gap[~last]))


def neighbour_gaps(vectors: Column) -> Column:
    """One less the cosine of each vector of an array and the next one; all vectors are of one length and without nulls."""
    return F.arrow_udf(_gaps, "array<double>")(vectors)


def vector_scores(vectors: DataFrame, queries: DataFrame, namespace: str = "label", block: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, score) of each query with every vector of its namespace but itself.

    Vectors without components and zero queries are left out. A pair of different lengths has a
    null score, as has a vector with a null component. Blocks of queries meet blocks of vectors:
    a task holds two blocks and their scores, however large a namespace is. The pairs grow with
    the square of a namespace, as all of them are the result.
    """
    return in_blocks(vectors, queries, ["ns"], namespace, block).applyInArrow(scorer(), MATCH)


def top_k_in_blocks(vectors: DataFrame, queries: DataFrame, k: int, min_score: float | None = None, namespace: str = "label", block: int = BLOCK) -> DataFrame:
    """As ``top_k`` of ``vector_scores``, for queries that grow with the table.

    Blocks of queries meet blocks of vectors of their namespace; each keeps its k best per
    query, so that no table of all pairs is made. Pairs without a defined score, as with
    vectors of another length, are no matches.
    """
    found = in_blocks(vectors, queries, ["ns", "size"], namespace, block)
    return top_k(found.applyInArrow(matcher(k), MATCH), k, min_score)


def with_context(best: DataFrame, texts: DataFrame, length: int = 2500) -> DataFrame:
    """Ranked matches with the beginning of their texts (vec_id, text)."""
    return best.join(texts.select("vec_id", F.left("text", F.lit(length)).alias("context")), "vec_id", "left")
