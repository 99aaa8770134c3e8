"""Vectors for texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

DIMENSIONS = 64
CHARS = 4000


def hashed_slots(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """The axes of the words of the text's beginning, in their order."""
    words = F.array_remove(F.split(F.lower(F.left(text, F.lit(CHARS))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dimensions)).cast("int"))


def hashed_terms_all(texts: Column, dimensions: int = DIMENSIONS) -> Column:
    """``hashed_terms`` of each text of an array: words are counted for a batch of arrays at a time."""

    @F.arrow_udf("array<array<float>>")
    def units(slots: pa.Array) -> pa.Array:
        texts, words = slots.flatten(), slots.flatten().flatten()
        of = np.repeat(np.arange(len(texts)), pc.list_value_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        counts = np.bincount(of * dimensions + words.to_numpy(zero_copy_only=False), minlength=len(texts) * dimensions).reshape(-1, dimensions).astype(np.float64)
        length = np.sqrt((counts * counts).sum(axis=1))
        counts /= np.where(length > 0, length, 1.0)[:, None]
        ends = np.arange(len(texts) + 1, dtype=np.int32) * dimensions
        inner = pa.ListArray.from_arrays(pa.array(ends), pa.array(counts.astype(np.float32).ravel()))
        return pa.ListArray.from_arrays(starts(slots), inner)

    return units(F.transform(texts, lambda t: hashed_slots(F.coalesce(t, F.lit("")), dimensions)))


def starts(lists: pa.Array) -> pa.Array:
    """Offsets of lists in what ``flatten`` gives of them; a null list is an empty one."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))


def hashed_terms(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Unit vector of hashed word counts of the text's beginning; all zeros without words.

    The default where no model is given; a model is any column expression from text to
    array<float>, such as a pandas UDF that calls it in batches.
    """
    slots = hashed_slots(text, dimensions)
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  computes the value once

    def counts(s: Column) -> Column:
        axes = F.sequence(F.lit(0), F.lit(dimensions - 1))
        return F.transform(axes, lambda d: F.size(F.filter(s, lambda x: x == d)).cast("float"))

    def unit(c: Column) -> Column:
        length = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        return once(length, lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)).cast("float")))

    return once(once(slots, counts), unit)


def embed(text: Column, precomputed: Column | None = None, model=hashed_terms) -> Column:
    """A vector that is there already wins."""
    computed = model(F.coalesce(text, F.lit("")))
    return computed if precomputed is None else F.coalesce(F.when(F.size(precomputed) > 0, precomputed), computed)


#: Texts of a call of a model.
BATCH = 25


def embed_missing(df: DataFrame, make_model: Callable[[], Callable[[list[str]], list]], text: str = "text", vector: str = "embedding", batch: int = BATCH) -> DataFrame:
    """The rows with ``vector`` (array<float>) filled in by a model where it is null or empty.

    ``make_model`` is called once a task and returns what makes vectors of a list of texts; it
    gets ``batch`` texts at a time, across Arrow batches, and fewer at the end of a task only.
    Vectors that are there already pass by without a call. Null texts are embedded as empty ones.
    Arrow batches wait until all their calls are made.
    """
    out = df.withColumn(vector, (F.col(vector) if vector in df.columns else F.lit(None)).cast("array<float>"))
    at, source = out.columns.index(vector), out.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, texts = make_model(), [], []  # batches that wait, and the texts they wait for

        def call() -> None:
            found = model(texts)
            if len(found) != len(texts):
                raise ValueError(f"the model made {len(found)} vectors of {len(texts)} texts")
            for (vectors, i), v in zip(places, found, strict=True):
                vectors[i] = [float(x) for x in v]
            texts.clear()
            places.clear()

        def ready(b: pa.RecordBatch, vectors: list) -> pa.RecordBatch:
            return b.set_column(at, b.schema.field(at), pa.array(vectors, type=b.schema.field(at).type))

        places: list[tuple[list, int]] = []
        for b in batches:
            vectors = b.column(at).to_pylist()
            held.append((b, vectors))
            for i, (v, t) in enumerate(zip(vectors, b.column(source).to_pylist(), strict=True)):
                if not v:
                    texts.append(t or "")
                    places.append((vectors, i))
                    if len(texts) == batch:
                        call()
            if not texts:
                yield from (ready(*h) for h in held)
                held = []
        if texts:
            call()
        yield from (ready(*h) for h in held)

    return out.mapInArrow(run, out.schema)
