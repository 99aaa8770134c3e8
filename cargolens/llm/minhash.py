"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

A document's set holds its distinct word shingles. Each random permutation of the shingle
hashes gives two signature values, the smallest and the largest, so that a signature of
240 values costs 120 hash evaluations per shingle. Both agree for two sets with about the
probability of their Jaccard similarity, and the pair of them estimates it with a lower
variance than two minima of separate permutations. Six values (three permutations) make a
band; 40 bands miss a pair at similarity 0.85 with probability (1 - 0.85^6)^40 < 1e-8 and
one at 0.8 with (1 - 0.8^6)^40 < 1e-5.

How it scales:

* Documents with equal sets are one class; only its smallest id goes on. Groups of exact
  copies of any size are combined before the shuffle.
* Band buckets are counted and joined back; no pairs are made inside a bucket. A bucket
  ties its members to its *pivot*, the smallest of them. Near copies share most buckets, so
  that a document has few pivots, whatever the number of its buckets.
* The documents tied to a pivot are cut into blocks of bounded size, each with the pivot.
  Inside a block a member is compared only with members it is not yet connected to, so that
  a group of near copies costs about one comparison a member.
* A pivot with one block has all its pairs compared. With more blocks, the documents outside
  the pivot's most frequent component are *open*. An open document of which too many
  shingles stand in no other document of the pivot cannot be linked there; this takes only
  the shingles that the pivot itself does not hold. The few others are compared with all
  documents of the pivot that have another component, again in bounded blocks. So each pair
  that shares a bucket is compared, connected already or known not to be linked.
* Sets are computed once, for members of buckets only, and travel once per block.

Defined results: null or empty text and text without words has an empty set, is linked with
nothing and kept; a text with fewer words than a shingle has its whole word sequence as the
one shingle; rows with a null id take no part in linking, have a null component and are
kept; rows that share an id are one node; repeated rows are returned as often as they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .exprs import free_name
from .lineage import cut, stored
from .wordhash import BASE, Words, batches, mix, runs

SHINGLE = 5
#: Bands of a signature, and permutations (two values each) of a band.
BANDS, PERMUTATIONS = 40, 3
#: Documents that are compared in one task at a time, and blocks of a pivot for each slot of its shingles.
BLOCK, SLOT_BLOCKS = 64, 16


def shingle_sets(texts: pa.Array, k: int, words: Words) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each text), in bounded batches."""
    for row, _, data, offsets in batches(texts):
        hashes, at = words.of(data, offsets)
        grams = runs(hashes, k)
        out = []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if hi - lo >= k:
                out.append(np.unique(grams[lo : hi - k + 1]))
            elif hi > lo:
                x = np.uint64(hi - lo)
                with np.errstate(over="ignore"):
                    for h in hashes[lo:hi]:
                        x = x * np.uint64(BASE) + h
                out.append(mix(np.array([x], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        yield row, out


def band_keys(sets: list[np.ndarray], bands: int) -> np.ndarray:
    """One key per set and band; no set may be empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    x = (flat >> np.uint64(32)).astype(np.uint32)
    n = bands * PERMUTATIONS
    draw = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    factor, shift = (draw[:n] | np.uint64(1)).astype(np.uint32), draw[n:].astype(np.uint32)
    keys, y = np.empty((len(sets), bands), dtype=np.uint64), np.empty_like(x)
    for band in range(bands):
        key = np.full(len(sets), band, dtype=np.uint64)
        for p in range(band * PERMUTATIONS, (band + 1) * PERMUTATIONS):
            np.multiply(x, factor[p], out=y)
            y += shift[p]
            for value in (np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)):
                key = mix(key * np.uint64(BASE) + value)
        keys[:, band] = key
    return keys


def signatures(docs: DataFrame, k: int = SHINGLE, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, digest, keys) per row of (doc_id, text); digest and keys are null for empty sets."""
    words = Words(fold=True)
    shape = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64()))]
    )

    def sign(batches_in):
        for batch in batches_in:
            ids = batch.column(0)
            for row, sets in shingle_sets(batch.column(1), k, words):
                some = [i for i, s in enumerate(sets) if len(s)]
                keys = [None] * len(sets)
                if some:
                    for i, row_keys in zip(some, band_keys([sets[i] for i in some], bands).view(np.int64), strict=True):
                        keys[i] = row_keys
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(row, len(sets)),
                        pa.array([len(s) for s in sets], type=pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], type=pa.binary()),
                        pa.array(keys, type=pa.list_(pa.int64())),
                    ],
                    schema=shape,
                )

    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return d.mapInArrow(sign, "doc_id long, n_shingles long, digest binary, keys array<long>")


def link(sets: list[np.ndarray], seeds: list[int], labels: list, per_cent: int) -> list[tuple]:
    """Labels (label, smallest label) of each component that links between a seed and another set make.

    Members that are connected already, by equal labels or by links found here, are not
    compared again.
    """
    sizes = np.array([len(s) for s in sets])
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    names, root = np.unique(np.array(labels), return_inverse=True)
    of_name = np.arange(len(names))
    mark = np.zeros(int(place.max()) + 1, dtype=np.int32)
    for s in seeds:
        # sets whose sizes differ too much cannot be linked
        small, large = np.minimum(sizes, sizes[s]), np.maximum(sizes, sizes[s])
        other = (root != root[s]) & (100 * small >= per_cent * large)
        if not other.any():
            continue
        own = place[starts[s] : starts[s] + sizes[s]]
        mark[own] = 1
        shared = np.add.reduceat(mark[place], starts)
        mark[own] = 0
        for o in np.flatnonzero(other & (100 * shared >= per_cent * (sizes + sizes[s] - shared))):
            x, y = root[s], root[o]
            if x != y:  # the smaller name stands for both
                root[root == max(x, y)] = of_name[of_name == max(x, y)] = min(x, y)
    return [(names[i], names[j]) for i, j in enumerate(of_name.tolist()) if i != j]


def sets_of(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, shingles): the full sets, as sorted 64-bit hashes, of the nodes' texts."""
    words = Words(fold=True)
    shape = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def to_sets(batches_in):
        for b in batches_in:
            for row, sets in shingle_sets(b.column(1), k, words):
                found = pa.array([s.tobytes() for s in sets], type=pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(sets)), found], schema=shape)

    d = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string"))
    return nodes.select("node").join(d, "node").mapInArrow(to_sets, "node long, shingles binary")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of neighbours that are equal in the first column."""
    held: list[tuple] = []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][0] != r[0]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _together(rows: DataFrame, gid: str) -> DataFrame:
    """Dealt so that groups of bounded size stand together in one partition."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, gid).sortWithinPartitions(gid)


def _verified(sets: DataFrame, members: DataFrame, per_cent: int) -> DataFrame:
    """Links (a, b) between labels inside each group of ``members`` (node, gid, label, seed), on full sets."""
    pairs = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def by_group(batches_in):
        for rows in groups(batches_in):
            if len(rows) > 1:
                full = [np.frombuffer(r[3], dtype=np.uint64) for r in rows]
                out = link(full, [i for i, r in enumerate(rows) if r[2]], [r[1] for r in rows], per_cent)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in zip(*out, strict=True)], schema=pairs)

    rows = members.join(sets, "node").select("gid", "label", "seed", "shingles")
    return _together(rows, "gid").mapInArrow(by_group, "a long, b long")


def _lone_shingles(sets: DataFrame, grouped: DataFrame) -> DataFrame:
    """(pivot, node, size, own): of the node's shingles, how many no other node of the pivot holds, nor the pivot.

    ``grouped``: (pivot, node, gid, blocks), a pivot among the nodes of each of its groups.
    Shingles that a pivot does not hold travel packed, one row per group and slot; a slot
    takes those of one part of all hashes.
    """
    kept = pa.schema([("slot", pa.int64()), ("pivot", pa.int64()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("shingles", pa.binary())])
    counts = pa.schema([("pivot", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("own", pa.int64())])

    def new_ones(batches_in):
        for rows in groups(batches_in):
            pivot, slots = rows[0][1], -(-rows[0][3] // SLOT_BLOCKS)
            heads = [np.frombuffer(r[4], dtype=np.int64) for r in rows if r[2] == pivot]
            known = np.unique(np.concatenate(heads)) if heads else np.zeros(0, dtype=np.int64)
            own = [np.frombuffer(r[4], dtype=np.int64) for r in rows]
            new = [x[~np.isin(x, known)] for x in own]
            n = [len(x) for x in new]
            flat, node, size = np.concatenate(new), np.repeat([r[2] for r in rows], n), np.repeat([len(x) for x in own], n)
            slot = flat.view(np.uint64) % np.uint64(slots)
            for k in np.unique(slot):
                here = slot == k
                packed = [pa.array([x[here].astype(np.int64).tobytes()], type=pa.binary()) for x in (node, size, flat)]
                yield pa.RecordBatch.from_arrays([pa.array([int(k)]), pa.array([pivot]), *packed], schema=kept)

    def lone(batches_in):
        for rows in groups(batches_in):
            node, size, shingle = (np.concatenate([np.frombuffer(r[i], dtype=np.int64) for r in rows]) for i in (2, 3, 4))
            _, first, n = np.unique(shingle, return_index=True, return_counts=True)
            alone = first[n == 1]
            who, at, own = np.unique(node[alone], return_index=True, return_counts=True)
            if len(who):
                columns = (np.full(len(who), rows[0][1]), who, size[alone][at], own)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=counts)

    rows = _together(grouped.join(sets, "node").select("gid", "pivot", "node", "blocks", "shingles"), "gid")
    packed = rows.mapInArrow(new_ones, "slot long, pivot long, nodes binary, sizes binary, shingles binary")
    packed = packed.withColumn("gid", F.xxhash64("pivot", "slot")).select("gid", "pivot", "nodes", "sizes", "shingles")
    return _together(packed, "gid").mapInArrow(lone, "pivot long, node long, size long, own long")


def bucket_ties(sig: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digest, rep) of the classes; distinct (node, pivot): each member of a bucket and the bucket's smallest one."""
    classes = cut(
        sig.filter("digest is not null and doc_id is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    )
    bands = classes.select(F.col("rep").alias("node"), F.explode("keys").alias("key"))
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).filter("n > 1")
    return classes.select("digest", "rep"), cut(bands.join(buckets, "key").filter("node <> pivot").select("node", "pivot").distinct())


def _in_blocks(tied: DataFrame, pivots: DataFrame) -> DataFrame:
    """(pivot, node, gid, blocks): the nodes of each pivot (pivot, blocks), dealt to its blocks, and the pivot in each of them."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    rows = tied.join(pivots, "pivot").filter("node <> pivot").select("pivot", "node", F.xxhash64("pivot", block).alias("gid"), "blocks")
    heads = pivots.select("pivot", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return rows.unionByName(heads.select("pivot", F.col("pivot").alias("node"), F.xxhash64("pivot", "block").alias("gid"), "blocks"))


def _open_nodes(sets: DataFrame, placed: DataFrame, per_cent: int) -> DataFrame:
    """(pivot, node, label) outside their pivot's main component that may be linked with another node of the pivot.

    ``placed``: (pivot, node, label, main, blocks). A set cannot reach the similarity with
    any other if too many of its shingles stand in no other. Nodes with several texts stay.
    """
    grouped = _in_blocks(placed.select("pivot", "node"), placed.select("pivot", "blocks").distinct())
    lost = _lone_shingles(sets, grouped).groupBy("pivot", "node").agg(F.sum("own").alias("own"), F.min("size").alias("size"))
    lost = lost.filter((F.col("size") - F.col("own")) * 100 < F.col("size") * per_cent)
    several = sets.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    lost = lost.join(several, "node", "left_anti").select("pivot", "node")
    return placed.filter("label <> main").join(lost, ["pivot", "node"], "left_anti").select("pivot", "node", "label")


def links(docs: DataFrame, ties: DataFrame, per_cent: int, k: int = SHINGLE) -> DataFrame:
    """Component (node, component) of every linked node, exact for all pairs that share a bucket."""
    size = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int")
    pivots = cut(ties.groupBy("pivot").agg(size.alias("blocks")))
    heads = pivots.select(F.col("pivot").alias("node"))
    sets = stored(sets_of(docs, ties.select("node").unionByName(heads).distinct(), k).filter(F.length("shingles") > 0))
    grouped = _in_blocks(ties, pivots).select("node", "gid", F.col("node").alias("label"), F.lit(True).alias("seed"))
    comps = connected_components(_verified(sets, grouped, per_cent))

    large = pivots.filter("blocks > 1")
    near = ties.join(large, "pivot").select("pivot", "node", "blocks").unionByName(large.select("pivot", F.col("pivot").alias("node"), "blocks"))
    labelled = cut(near.join(comps, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"))
    per_label = labelled.groupBy("pivot", "label").agg(F.count(F.lit(1)).alias("c"))
    per_pivot = per_label.groupBy("pivot").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("c", "label")).alias("main"))
    placed = cut(labelled.join(per_pivot.filter("labels > 1").select("pivot", "main"), "pivot"))
    apart = cut(_open_nodes(sets, placed, per_cent))
    if apart.isEmpty():
        return comps
    parts = apart.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    among = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n).cast("long")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    gid = F.xxhash64("pivot", "block", "part").alias("gid")
    here = placed.join(parts, "pivot").withColumn("block", among("blocks", 2)).withColumn("part", each("parts"))
    counts = placed.select("pivot", "blocks").distinct().join(parts, "pivot")
    there = apart.join(counts, "pivot").withColumn("part", among("parts", 3)).withColumn("block", each("blocks"))
    rows = here.select("node", gid, "label", F.lit(False).alias("seed")).unionByName(there.select("node", gid, "label", F.lit(True).alias("seed")))
    joined = connected_components(_verified(sets, rows, per_cent))
    last = joined.select(F.col("node").alias("component"), F.col("component").alias("last"))
    linked = comps.join(last, "component", "left").select("node", F.coalesce("last", "component").alias("component"))
    # a label may be a node that was not linked before
    return cut(linked.unionByName(joined.join(comps, "node", "left_anti")))


def near_duplicates(docs: DataFrame, per_cent: int = 80, k: int = SHINGLE, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row: the smallest document reachable over links.

    Two documents are linked if 100 * intersection >= per_cent * union of their sets.
    """
    sig = cut(signatures(docs, k, bands))
    classes, ties = bucket_ties(sig)
    comps = links(docs, ties, per_cent, k)
    of_class = cut(
        classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(
            "digest", F.coalesce("component", "rep").alias("component")
        )
    )
    rows = sig.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    component = F.coalesce("component", "doc_id")
    return rows.join(of_class, "digest", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def deduplicate(docs: DataFrame, per_cent: int = 80, k: int = SHINGLE) -> DataFrame:
    """The documents, with their own columns, of which one of each near-duplicate group is left.

    Repeated rows of a kept document stay once; rows with a null id all stay.
    """
    found = near_duplicates(docs, per_cent, k).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = free_name(docs.columns, "_gone")
    left = docs.join(found.withColumnRenamed("_gone", gone), F.col("doc_id") == F.col(f"`{gone}`"), "left_anti")
    ids = left.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    again = free_name(docs.columns, "_again")
    repeated = cut(ids.filter("n > 1").select(F.col("doc_id").alias(again)))
    if repeated.isEmpty():
        return left
    same, columns = F.col("doc_id") == F.col(f"`{again}`"), [F.col(f"`{c}`") for c in docs.columns]
    row = F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(again)
    one = left.join(repeated, same, "left_semi").groupBy("doc_id").agg(row).select(*(F.col(f"`{again}`")[c].alias(c) for c in docs.columns))
    return left.join(repeated, same, "left_anti").unionByName(one)


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION
  SELECT r.a, sym.b FROM r JOIN sym ON r.b = sym.a
), m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""


def op9(docs: DataFrame) -> DataFrame:
    """The rows of the query: links at 0.85."""
    return near_duplicates(docs, per_cent=85)
