"""Exact cosine top-k that leaves out blocks of vectors that are too far away in angle.

Every namespace has a few pivots. A vector belongs to the pivot at the smallest angle, and vectors
of one pivot are cut into rings of equal width by that angle, rings into blocks of bounded size.
Angles obey the triangle inequality: a query at angle t to a pivot is at least max(t - hi, lo - t)
away from all vectors of a ring that spans lo to hi, so that the cosine of this gap bounds its
scores there. Each query first meets the blocks with the best bounds until they hold k vectors;
its k-th score among them, or the smallest score asked for, then rules out further blocks.

What travels beside the vectors are one row a block and one narrow row a query and block; a query's
vector is sent only to blocks that it has to meet.

Defined results: those of ``vectors.top_k_in_blocks``, whatever the pivots are. Vectors whose
angle is not defined to working precision (zero, non-finite or extremely long or short ones) are
in blocks without a bound, which every query meets; such queries meet all blocks. Null and empty
vectors and null namespaces take no part.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..sources.tables import scratch
from .vectors import BLOCK, MATCH, held, matcher, top_k

#: Pivots of a namespace, and the width of a ring in radians.
PIVOTS, RING = 16, 0.1
#: Far above the rounding of cosines of angles.
SLACK = 1e-6
#: Lengths outside are not squared to working precision.
SHORTEST, LONGEST = 1e-140, 1e140
KIND = ["ns", "size"]
PLACE = [*KIND, "pivot", "ring", "part"]


class Search(NamedTuple):
    best: DataFrame
    #: (query_id, PLACE, n, bound): every block of a query's namespace, and those that were multiplied
    blocks: DataFrame
    met: DataFrame


def _stored(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _usable(df: DataFrame, namespace: str) -> DataFrame:
    """(vec_id, ns, size, e) of vectors that take part."""
    full = df.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.col(namespace).isNotNull())
    return full.select("vec_id", F.col(namespace).alias("ns"), F.size("embedding").alias("size"), F.col("embedding").cast("array<double>").alias("e"))


def _pivots(v: DataFrame, n: int) -> DataFrame:
    """(ns, size, pivots): ``n`` vectors of each namespace at most, by a hash of the id; tasks keep their first ones."""
    square = F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)
    order = Window.partitionBy(*KIND).orderBy(F.xxhash64("vec_id"), "vec_id")
    some = v.filter(square.between(SHORTEST**2, LONGEST**2)).withColumn("at", F.row_number().over(order)).filter(F.col("at") <= n)
    listed = some.groupBy(*KIND).agg(F.sort_array(F.collect_list(F.struct("at", "e"))).alias("p"))
    return listed.select(*KIND, F.transform("p", lambda x: x["e"]).alias("pivots"))


def _measured(v: DataFrame, pivots: DataFrame, block: int) -> DataFrame:
    """``v`` with ``angles`` to the pivots of the namespace, null where they are not defined."""
    deal = v.groupBy(*KIND).agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    dealt = v.join(deal, KIND).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts")).drop("parts")
    to = pivots.join(deal, KIND).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select(["vec_id", "ns", "size", "e"])
        if not left.num_rows or not right.num_rows:
            return left.append_column("angles", pa.nulls(left.num_rows, pa.list_(pa.float64())))
        _, e, length = held(left)
        p = np.array(right.column("pivots")[0].as_py())
        fit = (length >= SHORTEST) & (length <= LONGEST)
        unit = np.where(fit[:, None], e, 1.0) / np.where(fit, length, 1.0)[:, None]
        angles = np.arccos(np.clip(unit @ (p / np.linalg.norm(p, axis=1, keepdims=True)).T, -1, 1))
        return left.append_column("angles", pa.array([a if ok else None for a, ok in zip(angles, fit.tolist(), strict=True)], pa.list_(pa.float64())))

    shape = f"vec_id long, ns {v.schema['ns'].dataType.simpleString()}, size int, e array<double>, angles array<double>"
    key = [*KIND, "part"]
    own = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns)).groupBy(*key)
    return own(dealt.withColumn("vec_id", F.col("vec_id").cast("long"))).cogroup(own(to)).applyInArrow(measure, shape)


def _in_blocks(measured: DataFrame, ring: float, block: int) -> DataFrame:
    """(PLACE, angle, vec_id, e)."""
    angle = F.array_min("angles")
    v = measured.select(
        *KIND, "vec_id", "e", angle.alias("angle"),
        F.coalesce(F.array_position("angles", angle), F.lit(0)).alias("pivot"),
        F.coalesce(F.floor(angle / ring), F.lit(-1)).alias("ring"),
    )
    parts = v.groupBy(*KIND, "pivot", "ring").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    return v.join(parts, [*KIND, "pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts")).drop("parts")


def _matches(met: DataFrame, q: DataFrame, v: DataFrame, k: int, block: int) -> DataFrame:
    """The k best of each query in each block it meets: blocks of queries with blocks of vectors."""
    deal = q.groupBy(*KIND).agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    met = met.select("query_id", *PLACE).join(deal, KIND).withColumn("q", F.pmod(F.xxhash64("query_id"), "parts")).drop("parts")
    key = [*PLACE, "q"]
    left = met.join(q.select(F.col("vec_id").alias("query_id"), *KIND, "e"), ["query_id", *KIND]).withColumnRenamed("query_id", "vec_id")
    right = v.join(met.select(*key).distinct(), PLACE)
    own = lambda df: df.select(*(F.col(c).alias(c) for c in (*key, "vec_id", "e"))).groupBy(*key)
    return own(left).cogroup(own(right)).applyInArrow(matcher(k), MATCH)


def search(vectors: DataFrame, queries: DataFrame, k: int, min_score: float | None = None, namespace: str = "label", pivots: int = PIVOTS, ring: float = RING, block: int = BLOCK) -> Search:
    """The k best per query, with the blocks there were and those that were multiplied."""
    v = _usable(vectors, namespace)
    chosen = _stored(_pivots(v, pivots))
    v = _stored(_in_blocks(_measured(v, chosen, block), ring, block))
    q = _stored(_measured(_usable(queries, namespace), chosen, block))
    spans = v.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    t = F.when(F.col("pivot") > 0, F.get("angles", (F.col("pivot") - 1).cast("int")))
    gap = F.greatest(t - F.col("hi"), F.col("lo") - t, F.lit(0.0))
    bound = F.when(t.isNull(), F.lit(2.0)).otherwise(F.cos(gap) + SLACK)
    each = q.select(F.col("vec_id").alias("query_id"), *KIND, "angles").join(spans, KIND)
    blocks = each.groupBy("query_id", *PLACE).agg(F.max("n").alias("n"), F.max(bound).alias("bound"))  # a query id may be repeated
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), *PLACE)
    before = F.coalesce(F.sum("n").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = _stored(blocks.withColumn("first", before <= k))
    able = blocks if min_score is None else blocks.filter(F.col("bound") >= min_score)
    found = _stored(top_k(_matches(able.filter("first"), q, v, k, block), k).select("query_id", "vec_id", "score"))
    least = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    rest = able.filter("not first").join(least, "query_id", "left").filter("least is null or bound >= least").select(blocks.columns)
    best = top_k(found.unionByName(_matches(rest, q, v, k, block)), k, min_score)
    return Search(best, blocks, able.filter("first").unionByName(rest))


def top_k_by_pivots(vectors: DataFrame, queries: DataFrame, k: int, min_score: float | None = None, **options) -> DataFrame:
    """As ``vectors.top_k_in_blocks``, for vectors that lie in groups."""
    return search(vectors, queries, k, min_score, **options).best
