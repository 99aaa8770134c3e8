"""Packing documents into token sequences by cutting-stock column generation.

A document's ids are cut into full sequences and one rest. Rests are counted by length class
(``STEP`` tokens wide, rounded up); this histogram, a few hundred numbers whatever the size
of the corpus, is the cutting-stock problem. Its linear program is solved by column
generation: the restricted master program over patterns gives every class a price, a
knapsack by dynamic programming finds the pattern worth most at these prices, and the
pattern is added until none is worth more than one sequence. The solution is rounded down,
what is left over is packed by first fit, and the patterns are opened into sequences by
arithmetic: the rest of rank r in its class belongs to the r-th place for that class.

Ranks are global but never sorted globally: documents are ranked inside many buckets of a
class, and a small table of bucket counts gives each bucket its first rank. Full pieces need
no rank: each is a sequence of its own, numbered by its place in the stored pieces.

The program ends when no pattern is worth more than ``NEAR`` sequences. Its prices divided
by the best pattern's worth give a lower bound of any packing of the rounded rests, so that
the solution states how far from the optimum it can be at most.

Defined results: null text is empty and consists of the end id; a document keeps its pieces
in order, each id in exactly one piece; full pieces are sequences of their own; rows that
share an id are documents of their own if their texts differ, and repeated rows are packed
as often as they stand; an empty table gives no rows. A sequence is padded to its capacity
unless its length is a power of two.
"""

from __future__ import annotations

import functools
import logging
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .lineage import cut

CAPACITY = 2048
STEP = 16
END_ID = 1
log = logging.getLogger(__name__)

#: Buckets that ranks are counted in, per class, at least; half as many as there are partitions if that is more.
BUCKETS = 64
#: Distinct pieces of text whose ids a task keeps.
CACHE = 400_000


MARKS = ".,;:!?"


@functools.lru_cache(maxsize=1)
def token_bytes(path: str, ranks: str | None = None):
    """A function from a list of texts to their ids as bytes (little-endian unsigned 32-bit), made once a worker.

    Words recur, so the ids of blank-separated stretches are kept in a bounded cache. Ids may
    be joined there because byte-level pre-tokenisation always cuts before a single blank
    that stands between two characters that aren't white space; other texts are encoded whole.

    ``ranks``: the same vocabulary as merge ranks. Stretches of Latin letters, on whose
    character classes all engines agree, are then encoded with these, at a third of the cost.
    """
    import base64
    import re

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    quick = None
    if ranks:
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    latin = re.compile("[\x00-\u024f]*")
    odd = re.compile(r"\s ")
    special = re.compile("|".join(re.escape(t.content) for t in tok.get_added_tokens_decoder().values()) or r"(?!)")
    cache: dict[str, bytes] = {}  # of stretches behind a blank, which is part of their ids but not of the key

    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(parts: list[str]) -> list[bytes]:
        out = [packed(quick.encode_ordinary(p)) if quick and latin.fullmatch(p) else None for p in parts]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, tok.encode_batch_fast([parts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = packed(e.ids)
        return out

    def learn(new: set[str]) -> None:
        if len(cache) > CACHE:
            cache.clear()
        new = {p for p in new if p not in cache}
        # letters and closing marks are never one token: words with and without a mark share their ids
        marked = [p for p in new if p[-1:] in marks and p[-2:-1].isalpha()]
        missing = list({p for p in new.difference(marked).union(p[:-1] for p in marked) if p not in cache})
        cache.update(zip(missing, encode([" " + p for p in missing]), strict=True))
        cache.update((p, cache[p[:-1]] + marks[p[-1]]) for p in marked)

    marks = dict(zip(MARKS, encode(list(MARKS)), strict=True))

    def run(texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        whole, split = [], []
        for i, t in enumerate(texts):
            if not t:
                out[i] = b""
            elif odd.search(t) or special.search(t):
                whole.append(i)
            else:
                split.append((i, t.split(" ")))
        learn({p for _, parts in split for p in parts[1:]})
        heads = encode([parts[0] for _, parts in split])
        for (i, parts), head in zip(split, heads, strict=True):
            del parts[0]
            out[i] = head + b"".join(map(cache.__getitem__, parts))
        for i, e in zip(whole, tok.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = packed(e.ids)
        return out

    return run


def pieces(docs: DataFrame, tokenizer: tuple[str, str | None], capacity: int = CAPACITY, extra: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids], *extra): full pieces and the rest of each document.

    ``tokenizer``: the paths of a vocabulary and, if there is one, of the same as ranks.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.binary()))
    n_own = len(fields)

    def chop(batches):
        encode = token_bytes(*tokenizer)
        for batch in batches:
            texts, at = batch.column(1), 0
            while at < batch.num_rows:
                to, size = at, 0
                rows = []
                while to < batch.num_rows and (to == at or size < 1 << 22):
                    rows.append(texts[to].as_py() or "")
                    size += len(rows[-1])
                    to += 1
                cols: list[list] = [[] for _ in range(n_own - 1)]
                source = []
                for i, raw in enumerate(encode(rows)):
                    raw += END_ID.to_bytes(4, "little")
                    n = len(raw) // 4
                    for start in range(0, n, capacity):
                        part = raw[4 * start : 4 * (start + capacity)]
                        source.append(at + i)
                        values = [start, len(part) // 4, zlib.crc32(part), n, part]
                        for c, v in zip(cols, values, strict=False):
                            c.append(v)
                took = pa.array(source, type=pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(took),
                        *(pa.array(c, type=t) for c, (_, t) in zip(cols, fields[1:], strict=True)),
                        *(batch.column(2 + j).take(took) for j in range(len(extra))),
                    ],
                    names=[*(f for f, _ in fields), *extra],
                )
                at = to

    kinds = {"ids": "binary"}
    schema = ", ".join(f"{f} {kinds.get(f, 'long')}" for f, _ in fields)
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(F.col(f"`{c}`") for c in extra))
    return d.mapInArrow(chop, schema)


def price_pattern(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern (class -> copies) of the greatest value: class c takes c + 1 units."""
    n = len(value)
    best = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        top = min(room, n)
        total = value[:top] + best[room - 1 :: -1][:top] if room > 0 else value[:0]
        c = int(np.argmax(total))
        best[room], take[room] = total[c], c + 1
        if best[room - 1] >= best[room]:
            best[room], take[room] = best[room - 1], 0
    pattern = np.zeros(n, dtype=np.int64)
    room = capacity
    while room > 0:
        if take[room]:
            pattern[take[room] - 1] += 1
            room -= take[room]
        else:
            room -= 1
    return float(best[capacity]), pattern


#: The program is solved when no pattern is worth more than this; its optimum is then at most as much lower.
NEAR = 1.003


class Solution(NamedTuple):
    #: Patterns (class -> copies) and how often each is used.
    patterns: list[tuple[np.ndarray, int]]
    #: No packing of the demand takes fewer sequences.
    bound: float

    @property
    def gap(self) -> float:
        """By which part of the bound the solution can be too large at most."""
        return sum(n for _, n in self.patterns) / self.bound - 1 if self.bound else 0.0


def solve(demand: np.ndarray, capacity: int, rounds: int = 6000) -> Solution:
    """Patterns and how often to use them, covering the demand exactly, with a bound of the optimum.

    ``demand[c]`` rests take c + 1 of ``capacity`` units. Revised simplex on the covering
    program; the first basis has one pattern per class, as many copies as fit.
    """
    classes = np.flatnonzero(demand)
    if not len(classes):
        return Solution([], 0.0)
    want = demand[classes].astype(float)
    n = len(classes)
    basis = np.diag([float(capacity // (c + 1)) for c in classes])
    inverse = np.diag(1 / np.diag(basis))
    level = inverse @ want
    value = np.zeros(capacity)
    bound = float((demand * np.arange(1, len(demand) + 1)).sum()) / capacity
    for _ in range(rounds):
        price = inverse.sum(axis=0)  # each pattern costs one sequence
        value[:] = 0
        value[classes] = price
        worth, pattern = price_pattern(np.maximum(value, 0), capacity)
        # prices that no pattern exceeds bound the program from below
        bound = max(bound, float(np.maximum(price, 0) @ want) / max(worth, 1.0))
        if worth <= NEAR:
            break
        column = inverse @ pattern[classes].astype(float)
        ok = column > 1e-9
        if not ok.any():
            break
        ratio = np.full(n, np.inf)
        ratio[ok] = level[ok] / column[ok]
        out = int(np.argmin(ratio))
        basis[:, out] = pattern[classes]
        row = inverse[out] / column[out]
        inverse -= np.outer(column, row)
        inverse[out] = row
        level = np.maximum(inverse @ want, 0)
    else:
        log.warning("no optimum after %d rounds; the packing is complete, its gap to the bound is larger than usual", rounds)
    left = demand.astype(np.int64).copy()
    plan = []
    for j in range(n):
        pattern = np.zeros(len(demand), dtype=np.int64)
        pattern[classes] = np.round(basis[:, j]).astype(np.int64)
        used = pattern > 0
        times = int(min(np.floor(level[j] + 1e-6), (left[used] // pattern[used]).min()))
        if times > 0:
            plan.append((pattern, times))
            left -= pattern * times
    # rounding leaves less than one use of each pattern; first fit, longest first
    bins: list[tuple[np.ndarray, int]] = []
    for c in range(len(left) - 1, -1, -1):
        while left[c]:
            for i, (pattern, room) in enumerate(bins):
                if room > c:
                    n_here = min(int(left[c]), room // (c + 1))
                    pattern[c] += n_here
                    bins[i] = (pattern, room - n_here * (c + 1))
                    left[c] -= n_here
                    if not left[c]:
                        break
            else:
                pattern = np.zeros(len(demand), dtype=np.int64)
                bins.append((pattern, capacity))
    return Solution(plan + [(p, 1) for p, _ in bins], bound)


def pack(parts: DataFrame, capacity: int = CAPACITY, step: int = STEP, order_by: tuple[str, ...] = ()) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    ``order_by``: columns (bucket, place) that rank the documents of a class; by default
    they are ranked by a hash. Ranks run bucket by bucket.
    """
    parts = cut(parts)
    own = [c for c in parts.columns if c not in order_by]
    full, rests = parts.filter(F.col("length") == capacity), parts.filter(F.col("length") < capacity)
    buckets = max(BUCKETS, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)
    size_class = F.ceil(F.col("length") / step).cast("int") - 1
    bucket = F.col(f"`{order_by[0]}`") if order_by else F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets))
    place = [F.col(f"`{c}`") for c in order_by[1:]] if order_by else []
    keyed = rests.withColumn("_class", size_class).withColumn("_bucket", bucket)
    counts = keyed.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    firsts = cut(counts.withColumn("_first", F.coalesce(before, F.lit(0))))
    totals = {r[0]: r[1] for r in firsts.groupBy("_class").agg(F.sum("_n")).collect()}  # one row a class
    demand = np.array([totals.get(c, 0) for c in range(capacity // step)], dtype=np.int64)
    solution = solve(demand, capacity // step)
    plan = solution.patterns
    log.info("%d sequences for the rests of documents, at most %.2f %% above any packing of their classes", sum(t for _, t in plan), 100 * solution.gap)
    base = np.concatenate([[0], np.cumsum([t for _, t in plan])]).astype(np.int64)
    # per class: places by pattern; rank -> pattern by the running number of places
    slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for c in np.flatnonzero(demand):
        use = [(i, int(p[c]), t) for i, (p, t) in enumerate(plan) if p[c]]
        ends = np.cumsum([a * t for _, a, t in use])
        slots[int(c)] = (ends, np.array([base[i] for i, _, _ in use]), np.array([a for _, a, _ in use]))
    local = F.row_number().over(Window.partitionBy("_class", "_bucket").orderBy(*place, "doc_id", "start", "ids_crc32")) - 1
    ranked = keyed.withColumn("_local", local).join(firsts.select("_class", "_bucket", "_first"), ["_class", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_first") + F.col("_local"))

    @F.arrow_udf("long")
    def sequence(cls: pa.Array, rank: pa.Array) -> pa.Array:
        c, r = cls.to_numpy(), rank.to_numpy()
        out = r.astype(np.int64).copy()
        for k in np.unique(c[c >= 0]):
            ends, first, copies = slots[int(k)]
            mine = c == k
            i = np.searchsorted(ends, r[mine], side="right")
            within = r[mine] - np.where(i > 0, ends[np.maximum(i - 1, 0)], 0)
            out[mine] = first[i] + within // copies[i]
        return pa.array(out)

    placed = ranked.withColumn("sequence_id", sequence("_class", "_rank"))
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    packed = placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long"))
    # behind all packed sequences; the checkpoint keeps the places
    alone = full.withColumn("sequence_id", F.lit(int(base[-1])) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.select(*own, "sequence_id", "offset").unionByName(alone.select(*own, "sequence_id", "offset"))


def pack_in_order(docs: DataFrame, tokenizer: tuple[str, str | None], capacity: int = CAPACITY) -> DataFrame:
    """As ``pack``, ranking the documents by the order in which their files hold them.

    ``docs`` are read from files whose names sort in the order of the rows; rows that come
    from no file have no order and are ranked as in ``pack``.
    """
    try:
        placed = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return pack(pieces(docs, tokenizer, capacity), capacity)
    extra = ("_file", "_row")
    return pack(pieces(placed, tokenizer, capacity, extra), capacity, order_by=extra)


def vocabulary() -> tuple[str, str]:
    """Where the vocabulary of the query and the pipeline lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op2(docs: DataFrame) -> DataFrame:
    """The rows of the query."""
    return pack(pieces(docs, vocabulary()))
