"""Texts to linked chunks, and reconciling the texts of a document's parts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.questions import let

SIZE, OVERLAP = 800, 120
SEPARATORS = ("\n\n", "\n", ".", " ", "")


def _ends(text: str, separator: str) -> np.ndarray:
    """Places behind each separator, from the left."""
    if len(separator) == 1:
        return np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) == ord(separator)) + 1
    out, at = [], text.find(separator)
    while at >= 0:
        out.append(at + len(separator))
        at = text.find(separator, at + len(separator))
    return np.array(out, dtype=np.int64)


def split_places(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """From where to where the chunks of a text go, cut at the coarsest separators that make them fit.

    Pieces keep their separator at the end and are joined while they fit; a chunk begins
    with the last pieces of the one before that have at most ``overlap`` characters. All is
    worked out on places; no piece is a text of its own.
    """
    ends: dict[str, np.ndarray] = {}
    edges: list[int] = [0]  # where pieces end

    def fit(lo: int, hi: int, level: int) -> None:
        if hi - lo <= size:
            if hi > lo:
                edges.append(hi)
            return
        separator = separators[level]
        if not separator:
            edges.extend([*range(lo + size, hi, size), hi])
            return
        if separator not in ends:
            ends[separator] = _ends(text, separator)
        places = ends[separator]
        inside = places[np.searchsorted(places, lo, side="right") : np.searchsorted(places, hi, side="right")].tolist()
        for at in inside if inside and inside[-1] == hi else [*inside, hi]:
            fit(lo, at, level + 1)
            lo = at

    fit(0, len(text), 0)
    out, first = [], 0  # a chunk goes from edge to edge
    for i in range(1, len(edges)):
        start, end = edges[i - 1], edges[i]
        if first < i - 1 and end - edges[first] > size:
            out.append((edges[first], start))
            while first < i - 1 and (start - edges[first] > overlap or end - edges[first] > size):
                first += 1
    if len(edges) > 1:
        out.append((edges[first], edges[-1]))
    return out


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """The chunks of ``split_places``, without white space around; blank ones are none."""
    return [c for c in (text[a:z].strip() for a, z in split_places(text, size, overlap, separators)) if c]


def chunk_recursive(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, pos, chunk): a map-only pass; a text is split by itself."""

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([split_text(t.as_py() or "", size, overlap) for t in texts], type=pa.list_(pa.string()))

    return docs.select("doc_id", F.posexplode(split(F.coalesce(F.col("text"), F.lit("")))).alias("pos", "chunk"))


def chunk_no_split(docs: DataFrame) -> DataFrame:
    """One chunk per document, for records that stay whole; empty texts have none."""
    return docs.filter(F.trim("text") != "").select("doc_id", F.lit(0).alias("pos"), F.col("text").alias("chunk"))


def sentences(text: Column) -> Column:
    """The sentences of a text: cut behind ``.``, ``!`` or ``?`` that white space follows; blank ones are none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def percentile_of(values: Column, share: float) -> Column:
    """The interpolated percentile of an array of numbers, null of an empty one."""

    def at(v: Column) -> Column:
        place = (F.size(v) - 1) * F.lit(share)
        low, high = F.get(v, F.floor(place).cast("int")), F.get(v, F.ceil(place).cast("int"))
        return low + (high - low) * (place - F.floor(place))

    return let(F.sort_array(values), at)


def chunk_semantic(docs: DataFrame, embed: Callable[[Column], Column], percentile: float = 0.95, embed_all: Callable[[Column], Column] | None = None, gaps_all: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, pos, chunk): breaks where neighbouring sentence vectors are further apart than that percentile of the text's distances.

    A text is split inside its row, as arrays of its sentences, vectors and distances, without
    a shuffle. ``embed`` makes a vector of a sentence; ``embed_all``, such as a UDF that calls a
    model, makes the vectors of an array of sentences instead, and ``gaps_all`` the distances of neighbours
    in an array of vectors, such as ``vectors.neighbour_gaps``. A text of one sentence, or with
    equal distances, is one chunk; null and blank texts have none.
    """
    from .vectors import cosine, norm

    vectors = embed_all or (lambda s: F.transform(s, lambda x: embed(x)))

    def gaps(v: Column) -> Column:
        return F.zip_with(F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 2, F.size(v)), lambda a, b: 1 - cosine(a, b, norm(a), norm(b)))

    def cut(s: Column, gap: Column) -> Column:
        far = percentile_of(gap, percentile)

        def pieces(limit: Column) -> Column:
            # where chunks begin, from 1, with a last place behind the text
            begins = F.filter(F.transform(gap, lambda g, i: F.when(g > limit, i + 2)), lambda i: i.isNotNull())
            edges = F.concat(F.array(F.lit(1)), begins, F.array(F.size(s) + 1))
            return F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges)), lambda a, z: F.array_join(F.slice(s, a, z - a), " "))

        return F.when(F.size(s) > 0, let(far, pieces))

    rows = docs.select("doc_id", sentences(F.col("text")).alias("_s"))
    rows = rows.withColumn("_v", vectors(F.col("_s"))).withColumn("_g", (gaps_all or gaps)(F.col("_v")))
    return rows.select("doc_id", F.posexplode(cut(F.col("_s"), F.col("_g"))).alias("pos", "chunk"))


def chunk_links(chunks: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``chunk_id`` and the ids of its neighbours inside one page; null at both ends."""
    chunk_id = F.concat_ws("-", *(F.col(k).cast("string") for k in keys), F.col("pos").cast("string"))
    order = Window.partitionBy(*keys).orderBy("pos")
    c = chunks.withColumn("chunk_id", chunk_id)
    return c.withColumn("prev_chunk_id", F.lag("chunk_id").over(order)).withColumn("next_chunk_id", F.lead("chunk_id").over(order))


def with_metadata(chunks: DataFrame, base: Column, extra: Column) -> DataFrame:
    """Adds ``metadata``: both maps, an extra value in place of a base value of the same key."""
    only = F.map_filter(base, lambda k, v: ~F.map_contains_key(extra, k))
    return chunks.withColumn("metadata", F.map_concat(only, extra))


def real_words(text: Column) -> Column:
    """Tokens of more than one character."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: F.length(w) > 1))


# What stands before text that was read from images, and before form fields.
IMAGE_MARK, PAGE_MARK = "\n\n=== EMBEDDED IMAGE OCR ===\n", "\n\n=== PAGE RENDER OCR ===\n"
FORM_MARK = "=== PDF FORM FIELD VALUES ===\n"


def reconcile_pdf(text: Column, ocr: Column) -> Column:
    """Both with a marker from 30 real words on; else the OCR text if it is at least as long; else the text."""
    t, o = F.trim(F.coalesce(text, F.lit(""))), F.trim(F.coalesce(ocr, F.lit("")))
    return F.when(o == "", t).when(real_words(t) >= 30, F.concat(t, F.lit(IMAGE_MARK), o)).when(F.length(o) >= F.length(t), o).otherwise(t)


def reconcile_render(text: Column, ocr: Column) -> Column:
    """Only for sparse texts (under 30 real words): appended from 10 words on, else the longer wins."""
    t, o = F.trim(F.coalesce(text, F.lit(""))), F.trim(F.coalesce(ocr, F.lit("")))
    n = real_words(t)
    return F.when((n >= 30) | (o == ""), t).when(n >= 10, F.concat(t, F.lit(PAGE_MARK), o)).when(F.length(o) > F.length(t), o).otherwise(t)


def reconcile_word(text: Column, ocr: Column) -> Column:
    """struct(text, error): OCR only for sparse texts and if at least as long; no text at all is an error."""
    t, o = F.trim(F.coalesce(text, F.lit(""))), F.trim(F.coalesce(ocr, F.lit("")))
    chosen = F.when((real_words(t) < 30) & (o != "") & (F.length(o) >= F.length(t)), o).otherwise(t)
    return F.struct(chosen.alias("text"), F.when(chosen == "", F.lit("no text")).alias("error"))


def form_fields_text(fields: DataFrame) -> DataFrame:
    """(doc_id, text) of (doc_id, pos, field, value): ``field: value`` lines in order under a heading.

    Skips empty values, bare states of check fields, and label fields that repeat a label.
    """
    value, name = F.trim(F.coalesce("value", F.lit(""))), F.trim("field")
    state = value.isin("/", "Off", "Yes", "No") & F.lower(name).rlike("(check|chk|box|flag)$")
    label = F.lower(name).endswith("label") & value.endswith(":")
    kept = fields.filter((value != "") & ~state & ~label)
    lines = F.array_sort(F.collect_list(F.struct("pos", F.concat(name, F.lit(": "), value).alias("line"))))
    text = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    return kept.groupBy("doc_id").agg(F.concat(F.lit(FORM_MARK), text).alias("text"))


def with_form_fields(pages: DataFrame, forms: DataFrame) -> DataFrame:
    """Pages (doc_id, page, text) with the form text behind page 0."""
    both = pages.join(forms.select("doc_id", F.col("text").alias("form")), "doc_id", "left")
    added = F.when((F.col("page") == 0) & F.col("form").isNotNull(), F.concat_ws("\n\n", "text", "form")).otherwise(F.col("text"))
    return both.select("doc_id", "page", added.alias("text"))


def document_text(pages: DataFrame, most: int = 12000) -> DataFrame:
    """(doc_id, text) of (doc_id, page, text): non-empty pages in order, one line break between, cut."""
    full = pages.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return full.groupBy("doc_id").agg(F.left(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n"), F.lit(most)).alias("text"))
