"""Mixing sources to target weights by Pfair scheduling.

Documents of a source form blocks. Time is counted in slots, one block each. Block j
(from 1) of a source of weight w may not run before slot floor((j - 1) / w) and has to run
before slot ceil(j / w); among the blocks that may run, the one with the earliest deadline
does. With weights that sum to one this keeps every deadline, and at every slot each source
is less than one block away from its weight times the slot number.

*Equal weights.* Where time runs on while sources run out, block j of every source has the same
release time and the same deadline: the number of blocks that all sources have among their first
j - 1, and among their first j. Earliest deadline first is then a round for each j, and ties go
to the source that has more blocks, then by a hash of its name. So a source has the same place in
all its rounds, and a block's slot is arithmetic: its round's release time plus that place. Release
time and deadline of each block are worked out, and a slot outside of them is an error. The
driver sees how many sources there are of each size only; sizes that differ add up to no more
than all blocks, so that there are fewer than the square root of twice their number. Any number
of sources is fine.

*Other weights* are exact: a number stands for the simplest fraction that is equal to it as a
float. Over their common denominator, the *period*, all weights complete whole blocks together,
so that the schedule of one period holds for every period: a block finds its slot by
arithmetic, however many there are, and never drifts from its weight. A phase ends in the
slot in which a source runs out; the next one begins there for the others, with their
weights scaled up, so that no document is dropped. Of a phase that ends before its period does,
only that part is planned. The driver sees the number of blocks per source here, and the plan,
one row a source and phase with the places of its blocks in a period, is joined to the
documents. Plans take ``MOST_PLACES`` places at most; an error says so if they need more: then
give fractions with a common denominator, or fewer sources.

A source's documents are ranked in many buckets, so that one source may hold any share of them.

Defined results: a null source is a source of its own; sources without a given weight share
the weight of the smallest given one, and all sources weigh the same if none is given;
weights must be positive; repeated rows are documents of their own; rows with a null id are
ranked by the source alone; an empty table gives an empty result; texts and other columns
travel unread, null, empty or long.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .exprs import free_name
from .lineage import cut

#: Places of blocks in the plans of all phases, at most: 64 MB as a table.
MOST_PLACES = 1 << 24
#: Documents in a block.
BLOCK = 16


def exact(weight: float | int | str | Fraction) -> Fraction:
    """The simplest fraction that is equal to the weight as a float; fractions and whole numbers stay."""
    if not isinstance(weight, float):
        return Fraction(weight)
    digits = 1
    while float(found := Fraction(weight).limit_denominator(10**digits)) != weight:
        digits += 1
    return found


def quotas(weights: list) -> list[int]:
    """The smallest whole numbers in the exact proportion of the weights."""
    shares = [exact(w) for w in weights]
    least = math.lcm(*(s.denominator for s in shares))
    whole = [int(s * least) for s in shares]
    return [w // math.gcd(*whole) for w in whole]


def schedule(quota: list[int], left: list[int] | None = None) -> list[list[int]]:
    """Slots of each source's blocks in one period of sum(quota) slots: earliest deadline first.

    Ties go to the block whose source has the larger weight, then to the earlier source. If
    a source has no more than ``left`` blocks of its share, the last slot is the one in which
    the first source runs out.
    """
    period = sum(quota)
    ready: list[tuple[int, int, int]] = []
    coming = [(0, i, 0) for i in range(len(quota))]  # (release, source, block)
    heapq.heapify(coming)
    out: list[list[int]] = [[] for _ in quota]
    for slot in range(period):
        while coming and coming[0][0] <= slot:
            _, i, j = heapq.heappop(coming)
            heapq.heappush(ready, (-((j + 1) * period // -quota[i]), -quota[i], i))
        _, _, i = heapq.heappop(ready)
        out[i].append(slot)
        j = len(out[i])
        if left is not None and j == left[i]:
            break
        if j < quota[i]:
            heapq.heappush(coming, (j * period // quota[i], i, j))
    return out


def plan(blocks: dict, weights: dict | None) -> list[tuple]:
    """(source, first block, block behind the last, quota, places in a period, first slot, period) per source and phase."""
    names = sorted(blocks, key=lambda s: (s is not None, s or ""))
    weights = weights or {}
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    least = min(weights.values(), default=1)
    left = {s: blocks[s] for s in names if blocks[s]}
    done, at, rows, used = dict.fromkeys(names, 0), 0, [], 0
    while left:
        live = list(left)
        q = quotas([weights.get(s, least) for s in live])
        period = sum(q)
        whole = all(left[s] > x for s, x in zip(live, q, strict=True))  # a period passes before a source runs out
        used += period if whole else min(period, sum(left.values()))
        if used > MOST_PLACES:
            raise ValueError(f"the weights of {len(blocks)} sources have a period of {period} slots and all phases together need more than {MOST_PLACES} places")
        places = schedule(q, None if whole else [left[s] for s in live])
        # the slot behind the one in which the first source runs out
        if whole:
            end = 1 + min((left[s] - 1) // x * period + p[(left[s] - 1) % x] for s, x, p in zip(live, q, places, strict=True))
        else:
            end = 1 + max(p[-1] for p in places if p)
        turns, rest = divmod(end, period) if whole else (0, end)
        for s, x, p in zip(live, q, places, strict=True):
            n = turns * x + bisect_left(p, rest)
            rows.append((s, done[s], done[s] + n, x, p, at, period))
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        at += end
    return rows


def mix(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The documents with ``block``, ``slot`` and ``mix_order`` (slot, then place in the block).

    The new columns get other names if the documents have such columns.
    """
    spark = docs.sparkSession
    names = {n: free_name(docs.columns, n) for n in ("block", "slot", "mix_order")}
    cols = docs.columns
    s, i = F.col(f"`{source_col}`").cast("string"), F.col(f"`{id_col}`")
    tmp = {n: free_name(cols, f"_{n}") for n in ("source", "bucket", "first", "row", "name", "from", "to", "quota", "places", "place", "start", "period")}
    # more buckets for more partitions, so that a window holds a bounded part of a source
    buckets = max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = docs.select(
        *(F.col(f"`{c}`") for c in cols),
        F.coalesce(F.concat(F.lit("s"), s), F.lit("")).alias(tmp["source"]),
        F.pmod(F.xxhash64(i, s), F.lit(buckets)).cast("int").alias(tmp["bucket"]),
    )
    counts = keyed.groupBy(tmp["source"], tmp["bucket"]).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(tmp["source"]).orderBy(tmp["bucket"]).rowsBetween(Window.unboundedPreceding, -1)
    firsts = cut(counts.withColumn(tmp["first"], F.coalesce(F.sum("n").over(before), F.lit(0))))
    want = {"" if k is None else f"s{k}": v for k, v in (weights or {}).items()}
    if any(w <= 0 for w in want.values()):
        raise ValueError("weights must be positive")
    even = len({exact(w) for w in want.values()}) <= 1
    if even:
        ranks, release = _rounds(firsts, tmp, block)
        firsts = firsts.join(ranks, tmp["source"])
    local = Window.partitionBy(tmp["source"], tmp["bucket"]).orderBy(F.xxhash64(i), i)
    own = [tmp["source"], tmp["bucket"]]
    ranked = keyed.join(firsts.select(*own, tmp["first"], *([tmp["place"]] if even else [])), own)
    ranked = ranked.withColumn(tmp["row"], F.col(tmp["first"]) + F.row_number().over(local) - 1)
    ranked = ranked.withColumn(names["block"], F.floor(F.col(tmp["row"]) / block))
    number = F.col(names["block"])
    if even:
        # a block's deadline is the release time of the next one; of the blocks that may run, all of one deadline, the place says which goes first
        timed = ranked.withColumns({tmp["from"]: release(number), tmp["to"]: release(number + 1)})
        slot = F.col(tmp["from"]) + F.col(tmp["place"])
        late = F.raise_error(F.concat(F.lit("a block in slot "), slot.cast("string"), F.lit(" misses its deadline "), F.col(tmp["to"]).cast("string")))
        slotted = timed.withColumn(names["slot"], F.when(slot < F.col(tmp["to"]), slot).otherwise(late.cast("long")))
    else:
        totals = {r[0]: r[1] for r in firsts.groupBy(tmp["source"]).agg(F.sum("n")).collect()}  # one row a source
        phases = plan({k: -(-n // block) for k, n in totals.items()}, want)
        schema = ", ".join(f"`{tmp[n]}` {t}" for n, t in (("name", "string"), ("from", "long"), ("to", "long"), ("quota", "long"), ("places", "array<int>"), ("start", "long"), ("period", "long")))
        table = spark.createDataFrame(phases, schema)
        in_phase = (F.col(tmp["source"]) == F.col(tmp["name"])) & (number >= F.col(tmp["from"])) & (number < F.col(tmp["to"]))
        n = number - F.col(tmp["from"])
        slot = F.col(tmp["start"]) + F.floor(n / F.col(tmp["quota"])) * F.col(tmp["period"]) + F.get(F.col(tmp["places"]), (n % F.col(tmp["quota"])).cast("int"))
        slotted = ranked.join(F.broadcast(table), in_phase).withColumn(names["slot"], slot)  # bounded by MOST_PLACES
    order = F.col(names["slot"]) * block + F.col(tmp["row"]) % block
    return slotted.withColumn(names["mix_order"], order).select(*(F.col(f"`{c}`") for c in cols), *names.values())


def _rounds(firsts: DataFrame, tmp: dict, block: int) -> tuple[DataFrame, Callable[[Column], Column]]:
    """Each source's place in its rounds, and the release time of a block by its number."""
    name, size, part = tmp["source"], tmp["quota"], tmp["name"]
    sizes = firsts.groupBy(name).agg(F.ceil(F.sum("n") / block).cast("long").alias(size))
    # sources of one size are ranked by the hash of their name, in ranges of it
    h = F.xxhash64(name)
    sizes = cut(sizes.withColumn(part, F.shiftright(h, 54)))
    ranges = sizes.groupBy(size, part).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(size).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn(tmp["from"], F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    found = sizes.groupBy(size).agg(F.count(F.lit(1)).alias("n")).orderBy(size).collect()  # below sqrt(2 * blocks) rows
    at, n = np.array([r[0] for r in found], dtype=np.int64), np.array([r[1] for r in found], dtype=np.int64)
    larger = np.append(np.cumsum(n[::-1])[::-1][1:], 0) if len(n) else n
    edges, live = np.append(0, at), np.append(n.sum(), larger)
    released = np.append(0, np.cumsum(np.diff(edges) * live[:-1]))

    @F.arrow_udf("long")
    def release(number: pa.Array) -> pa.Array:
        j = number.to_numpy(zero_copy_only=False)
        i = np.searchsorted(edges, j, side="right") - 1
        return pa.array(released[i] + (j - edges[i]) * live[i])

    spark = firsts.sparkSession
    above = spark.createDataFrame([(int(a), int(x)) for a, x in zip(at, larger, strict=True)], f"`{size}` long, `{tmp['to']}` long")
    local = Window.partitionBy(size, part).orderBy(F.xxhash64(name), name)
    ranks = sizes.withColumn(tmp["start"], F.row_number().over(local) - 1).join(ranges, [size, part]).join(F.broadcast(above), size)
    place = F.col(tmp["start"]) + F.col(tmp["from"]) + F.col(tmp["to"])
    return ranks.select(name, place.alias(tmp["place"])), release


def mixed(docs: DataFrame, weights: dict | None = None, **options) -> DataFrame:
    """The documents, with their own columns, in the order of the mix: range-partitioned and sorted.

    Written to files and read file by file they are the mixed stream.
    """
    out = mix(docs, weights, **options)
    order = out.columns[-1]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(n, order).sortWithinPartitions(order).select(*(F.col(f"`{c}`") for c in docs.columns))


#: Target weights of the query and the pipeline: the sources share evenly.
TARGET = None


def op3(docs: DataFrame) -> DataFrame:
    """(doc_id, source, block, slot, mix_order) of all documents."""
    return mix(docs.select("doc_id", "source"), TARGET)
