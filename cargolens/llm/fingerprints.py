"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words (runs of anything but ASCII white space, A-Z as a-z), each
weighted by how often it stands there. Sample i of a text gives every term k of weight S

    r, c ~ Gamma(2, 1) and beta ~ U(0, 1), fixed by (i, k)
    t = floor(ln S / r + beta)
    a = c * exp(-r * (t - beta) - r)

and keeps the term with the least a, together with its step t. Two texts keep the same pair
with the probability of their generalised Jaccard similarity: the sum of the lesser weights
over the sum of the greater ones. As a follows from (i, k, t), the pair is known by a itself,
so that a fingerprint holds the bits of the least 1 - exp(-a) of each sample, and the share
of samples that agree estimates the similarity, with a standard error of at most 0.045 for 128
samples. Values of different pairs agree in single precision about once in a million.

A gamma variable of shape 2 is the sum of two exponential ones, which its product with a
uniform one tells apart. With x, y, z' exponential: c = x + y, r * (1 - beta) = z = ln(1 + y / x)
and r * beta = z', so that a = x * exp(-r * t). At t = 0, as in most cells (a word that stands
once always), a is x, and 1 - exp(-x) is uniform: the hash of (i, k) itself.

``with_next`` brings each text together with the next one in the order of ids, in one
shuffle of compressed texts: quantiles of the ids deal the rows to places that follow one
another, and the first row of each place travels to the place before as well. A place is then
sorted and read as a stream that holds one row ahead, so that no task holds a place.

Defined results: null text is empty; texts without words share one fingerprint, which is like
itself (1) and like no other (0); equal texts have equal fingerprints; rows are in the order of
their ids, rows without an id before all others, rows of equal id by a hash of their text, and
equal rows one after another, each with a result of its own; after the last row comes the
first, so that a single row is its own next. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .wordhash import Words, batches, mix

SAMPLES = 128
#: Entries whose samples are worked on at a time, terms of them at a time, characters of texts that are read ahead.
ENTRIES, TERMS, AHEAD = 1 << 14, 1 << 7, 1 << 20
#: What stands for no term at all.
NONE = np.float32(2)
ODD, BASE = np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Below, x stands for 1 - exp(-x) and -ln(1 - x), which it is to four digits; both only order and name cells.
SMALL = np.float32(1e-4)


class Sampler:
    """Fingerprints of weighted sets of well mixed 64-bit terms; ``samples`` values each."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        self.exponential = -np.log((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)
        self.salt = mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)

    def cells(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """1 - exp(-a) of each term (rows) and sample (columns)."""
        out = np.empty((len(terms), self.samples), dtype=np.float32)
        for lo in range(0, len(terms), TERMS):
            h = self._hash(terms[lo : lo + TERMS])
            h >>= np.uint64(1)
            np.multiply(h.view(np.int64).astype(np.float32), np.float32(2.0**-63), out=out[lo : lo + TERMS])
        many = np.flatnonzero(weights > 1)
        for lo in range(0, len(many), TERMS):
            some = many[lo : lo + TERMS]
            out[some] = self._steps(self._hash(terms[some]), out[some], np.log(weights[some]).astype(np.float32)[:, None])
        return out

    def _hash(self, terms: np.ndarray) -> np.ndarray:
        h = terms[:, None] * self.salt
        h ^= h >> np.uint64(32)
        h *= ODD
        return h

    def _steps(self, h: np.ndarray, least: np.ndarray, log_weight: np.ndarray) -> np.ndarray:
        """Cells of terms that stand more than once; ``least`` holds those at t = 0."""
        v = np.minimum(least, np.float32(1 - 2.0**-24))
        x = np.where(v < SMALL, v, -np.log(1 - v)) + np.float32(2.0**-64)
        h = h * BASE
        y, z = self.exponential[(h >> np.uint64(48)).view(np.int64)], self.exponential[((h >> np.uint64(32)) & np.uint64(0xFFFF)).view(np.int64)]
        r = np.log((x + y) / x) + z
        t = np.floor((log_weight + z) / r)
        a = x * np.exp(-r * t)
        return np.where(t == 0, least, np.where(a < SMALL, a, 1 - np.exp(-a)))

    def of(self, text: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """Least ln a by text (rows) and sample; ``text`` rises from 0 to n - 1 at most."""
        out = np.full((n, self.samples), NONE, dtype=np.float32)
        for lo in range(0, len(text), ENTRIES):
            some, w = text[lo : lo + ENTRIES], weights[lo : lo + ENTRIES]
            # a term of the same weight has the same cells in every text
            pair = mix(terms[lo : lo + ENTRIES]) ^ mix(w.astype(np.uint64))
            _, first, back = np.unique(pair, return_index=True, return_inverse=True)
            cells = self.cells(terms[lo : lo + ENTRIES][first], w[first])
            start = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(some)], strict=True):
                row = out[some[a]]
                np.minimum(row, cells[back[a:b]].min(axis=0), out=row)
        return out


def term_weights(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, weight): the distinct words of each text and how often they stand there."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    _, first, n = np.unique(mix(hashes ^ mix(text.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
    order = np.argsort(first)
    first = first[order]
    return text[first], hashes[first], n[order]


class Printer:
    """Fingerprints of texts."""

    def __init__(self, samples: int = SAMPLES):
        self.sampler, self.words = Sampler(samples), Words(fold=True)

    def of(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), self.sampler.samples), dtype=np.float32)
        for row, to, data, offsets in batches(pa.array(texts, pa.large_string())):
            out[row:to] = self.sampler.of(*term_weights(*self.words.of(data, offsets)), to - row)
        return out


def shown(values: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(values, dtype="<f4").tobytes()).decode()


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples in which two shown fingerprints agree."""
    at = F.sequence(F.lit(0), F.lit(samples - 1))
    part = lambda c, i: F.substring(F.hex(F.unbase64(c)), 8 * i + 1, F.lit(8))
    return F.aggregate(at, F.lit(0), lambda n, i: n + (part(a, i) == part(b, i)).cast("int")) / F.lit(samples)


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint) of every row of (doc_id, text), without a shuffle."""

    def run(batches_in):
        printer = Printer(samples)
        for b in batches_in:
            for row, to, data, offsets in batches(b.column(1)):
                values = printer.sampler.of(*term_weights(*printer.words.of(data, offsets)), to - row)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, to - row), pa.array([shown(v) for v in values])], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


# ---- neighbours in the order of ids -----------------------------------------------------


class Places(NamedTuple):
    """Stretches of the order of rows. Places 0 .. lost - 1 hold rows without id, by ranges of their hash."""

    #: least id of each further place
    bounds: np.ndarray
    #: number of places of rows without id
    lost: int
    #: (place, hash) of the first row of each place of rows without id that has any
    lost_first: dict[int, int]

    def of_hash(self, h: np.ndarray) -> np.ndarray:
        return ((h.view(np.uint64) ^ np.uint64(1 << 63)) // np.uint64(-(-(1 << 64) // self.lost))).astype(np.int64)

    def of_id(self, ids: np.ndarray) -> np.ndarray:
        return self.lost + np.searchsorted(self.bounds, ids, side="right") - 1

    def before(self) -> dict[int, int]:
        """The place whose last row comes before the first row of a place."""
        filled = [*sorted(self.lost_first), *range(self.lost, self.lost + len(self.bounds))]
        return {p: filled[i - 1] for i, p in enumerate(filled)}


def _places(rows: DataFrame, n: int) -> Places:
    """About ``n`` places of as many rows each; the driver gets that many ids."""
    shares = [i / n for i in range(1, n)] or [0.5]
    got = rows.agg(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", shares, 100 * n).alias("ids"), F.count_if(F.col("doc_id").isNull()).alias("lost")).first()
    bounds = np.unique(np.array([] if got["least"] is None else [got["least"], *got["ids"]], dtype=np.int64))
    if not got["lost"]:
        return Places(bounds, 0, {})
    lost = Places(bounds, n, {})

    def first(batches_in):
        least: dict[int, int] = {}
        for b in batches_in:
            h = b.column(0).to_numpy()
            for p, x in zip(lost.of_hash(h).tolist(), h.tolist(), strict=True):
                least[p] = min(least.get(p, x), x)
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int64()), pa.array(list(least.values()), pa.int64())], names=["place", "h"])

    least = rows.filter(F.col("doc_id").isNull()).select("h").mapInArrow(first, "place long, h long").groupBy("place").agg(F.min("h").alias("h"))
    return Places(bounds, n, {r["place"]: r["h"] for r in least.collect()})


def _routed(rows: DataFrame, places: Places) -> DataFrame:
    """(place, after, doc_id, h, packed): each row at its place, and the first rows of places also, as ``after``, at the place before."""
    before = places.before()
    firsts = {int(b): places.lost + i for i, b in enumerate(places.bounds)}

    def run(batches_in):
        pack = zstandard.ZstdCompressor(3)
        for b in batches_in:
            null, h = b.column(0).is_null().to_numpy(zero_copy_only=False), b.column(1).to_numpy()
            ids = b.column(0).fill_null(0).to_numpy()
            place = places.of_id(ids) if len(places.bounds) else np.zeros(len(ids), dtype=np.int64)
            if null.any():
                place[null] = places.of_hash(h[null])
            if null.any():
                first = np.array([places.lost_first[p] == x if gone else i in firsts for gone, p, x, i in zip(null.tolist(), place.tolist(), h.tolist(), ids.tolist(), strict=True)])
            else:
                first = np.isin(ids, places.bounds)
            rows_of = np.concatenate([np.arange(len(ids)), np.flatnonzero(first)])
            after = np.arange(len(rows_of)) >= len(ids)
            to = np.where(after, [before[p] for p in place[rows_of].tolist()], place[rows_of])
            packed = pa.array([pack.compress(t.encode()) for t in b.column(2).to_pylist()], pa.binary())
            take = pa.array(rows_of)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(after), b.column(0).take(take), b.column(1).take(take), packed.take(take)], names=["place", "after", "doc_id", "h", "packed"])

    return rows.select("doc_id", "h", "text").mapInArrow(run, "place long, after boolean, doc_id long, h long, packed binary")


def _stream(batches_in) -> Iterator[tuple[int, bool, pa.Scalar, bytes]]:
    for b in batches_in:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)


def _stretches(batches_in) -> Iterator[tuple[list[int | None], list[str]]]:
    """(ids, texts): some neighbouring rows at a time, with one text more than ids, the next one."""
    unpack, ids, texts, size, at, done = zstandard.ZstdDecompressor(), [], [], 0, None, False
    for place, after, doc_id, packed in _stream(batches_in):
        if place != at:
            at, done, ids, texts, size = place, False, [], [], 0
        if done:  # one row behind the place is enough
            continue
        text = unpack.decompress(packed).decode()
        texts.append(text)
        size += len(text)
        if after:
            yield ids, texts
            done = True
            continue
        if size > AHEAD and ids:
            yield ids, texts
            ids, texts, size = [], [text], len(text)
        ids.append(doc_id)


def with_next(docs: DataFrame) -> DataFrame:
    """(place, after, doc_id, packed) in sorted partitions that ``_stretches`` reads."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    routed = _routed(rows, _places(rows, n))
    placed = routed.repartitionById(n, F.pmod("place", F.lit(n)).cast("int"))
    return placed.sortWithinPartitions("place", "after", F.col("doc_id").asc_nulls_first(), "h").select("place", "after", "doc_id", "packed")


def edited_likeness(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """How like each text of (doc_id, text) is to itself edited, and to the next text.

    The edited text has the last half (rounded down) of its code points replaced by as many
    of the first ones of the next text, or by all of them.
    """
    shape = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )

    def run(batches_in):
        printer = Printer(samples)
        for ids, texts in _stretches(batches_in):
            own = printer.of(texts)
            halves = [len(t) // 2 for t in texts[:-1]]
            edited = [t[: len(t) - half] + after[:half] for t, after, half in zip(texts[:-1], texts[1:], halves, strict=True)]
            other = printer.of(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array([shown(v) for v in own[:-1]]),
                    pa.array([shown(v) for v in other]),
                    pa.array(_agreement(own[:-1], other)),
                    pa.array(_agreement(own[:-1], own[1:])),
                ],
                schema=shape,
            )

    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(run, out)


def op12(docs: DataFrame) -> DataFrame:
    """The rows of the query."""
    return edited_likeness(docs)
