"""Ranked lexical search over an index in strata of equal length normaliser.

Terms are the runs of letters, digits and anything beyond ASCII, A-Z as a-z. A document's
normaliser m grows with its length n against the mean; it and the term's count tf there are all
that its impact (10**9 * tf) div (1000 * tf + 12 * m) depends on. A score is the sum of weight
times impact over the terms of an item.

1. Texts are read once: each document gives its length and its counts of the terms that any
   item asks for. This forward table is stored, with one row a document.
2. Its totals give N, L and, added up inside tasks first, the document frequency of each of
   these terms. The driver gets one number a term.
3. Each task indexes its documents in blocks: documents of equal m form a stratum, whose
   postings are lists by term, by tf inside the stratum. The impact of each (m, tf) is worked
   out once. A stratum's greatest impact of each term bounds what an item can score there.
   An item visits the strata with the best bounds first, and then those whose bound reaches
   its k-th best score so far, also that of blocks before. A task returns k rows an item, which
   a window merges.

Items are worked on in blocks of ``ITEMS``, so that what travels to tasks is bounded by the
texts of as many items: each block makes its own forward table of all documents.

Defined results: null texts and texts without terms count nowhere and are never found; an item
without terms, or whose terms stand in no document, has no rows; documents of equal score go
by the smaller id, those without id last; repeated rows of documents are documents of their
own; equal rows of items count once, different texts of one item id have their own ranks.
Other columns are ignored. Weights are those of double precision logarithms, rounded down.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .lineage import stored
from .toxicity import Terms, _doc_terms, lookup, spans

#: Items at a time; documents in a block; documents that an item visits before it looks at its bounds.
ITEMS, BLOCK, FIRST = 2048, 8192, 512
#: Above all ids: where rows without id stand.
LAST = np.iinfo(np.int64).max


class Items(NamedTuple):
    """The items of a block: keys, and their distinct terms with repeats, as places in the sorted vocabulary."""

    keys: list[int]
    vocab: np.ndarray
    item: np.ndarray
    term: np.ndarray
    times: np.ndarray


def read_items(items: DataFrame) -> Items | None:
    """From (key, text); None if no item has a term."""
    rows = items.select("key", "text").collect()  # bounded by the caller
    keys = [r["key"] for r in rows]
    parts = [(text + row, own, n) for row, _, text, own, n in _doc_terms(pa.array([r["text"] for r in rows], pa.large_string()), Terms())]
    if not sum(len(own) for _, own, _ in parts):
        return None
    item, hashes, times = (np.concatenate(x) for x in zip(*parts, strict=True))
    vocab = np.unique(hashes)
    return Items(keys, vocab, item, np.searchsorted(vocab, hashes), times)


def forward(docs: DataFrame, vocab: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs) of each text with a term: its length and its counts of the vocabulary's terms."""
    terms = Terms()
    shape = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def run(batches_in):
        for b in batches_in:
            for row, to, text, own, tf in _doc_terms(b.column(1), terms):
                n = np.bincount(text, tf, minlength=to - row).astype(np.int64)
                at = lookup(vocab, own)
                keep = at >= 0
                starts = np.searchsorted(text[keep], np.arange(to - row + 1)).astype(np.int32)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(starts), pa.array(x.astype(np.int32)))  # noqa: E731,B023
                out = pa.RecordBatch.from_arrays([b.column(0).slice(row, to - row), pa.array(n), lists(at[keep]), lists(tf[keep])], schema=shape)
                yield out.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)


class Strata:
    """Index of a block of documents: strata of equal m, in each the postings by term and tf."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int):
        """``doc``, ``term``, ``tf``: one entry a posting, ``doc`` a place in ``ids``."""
        self.ids, self.n_terms = ids, n_terms
        norms, self.stratum = np.unique(m, return_inverse=True)
        self.size = np.bincount(self.stratum, minlength=len(norms))
        of = self.stratum[doc]
        order = np.lexsort((tf, term, of))
        key, tf = (of * n_terms + term)[order], tf[order].astype(np.int64)
        self.doc = doc[order]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tf[1:] != tf[:-1])])) if len(key) else np.zeros(0, dtype=np.int64)
        run_tf, run_m = tf[first], norms[key[first] // n_terms]
        impact = (1_000_000_000 * run_tf) // (1000 * run_tf + 12 * run_m)
        #: of each posting
        self.impact = np.repeat(impact, np.diff(np.append(first, len(key))))
        #: lists: (stratum, term) in order, where they begin, and their greatest impact, which is that of the last tf
        self.lists, self.start = np.unique(key, return_index=True)
        self.start = np.append(self.start, len(key))
        self.most = self.impact[self.start[1:] - 1] if len(key) else np.zeros(0, dtype=np.int64)

    def bounds(self, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(strata x terms) places of the lists of an item's terms, or -1, and the best score of each stratum."""
        wanted = np.arange(len(self.size))[:, None] * self.n_terms + term
        at = np.searchsorted(self.lists, wanted)
        at[at == len(self.lists)] = 0
        at = np.where(self.lists[at] == wanted, at, -1)
        return at, np.where(at >= 0, self.most[at], 0) @ weight

    def scores(self, at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of documents of these lists (strata x terms) and their scores."""
        row, column = np.nonzero(at >= 0)
        lists = at[row, column]
        size = self.start[lists + 1] - self.start[lists]
        pos = spans(self.start[lists], size)
        doc, part = self.doc[pos], self.impact[pos] * np.repeat(weight[column], size)
        order = np.argsort(doc, kind="stable")
        doc, part = doc[order], part[order]
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, dtype=np.int64)
        return doc[first], np.add.reduceat(part, first) if len(first) else part

    def search(self, term: np.ndarray, weight: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[tuple[np.ndarray, np.ndarray], int]:
        """The k best (ids, scores) of this block and ``best``, and how many strata were visited."""
        if not len(self.lists):
            return best, 0
        at, bound = self.bounds(term, weight)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        done = 0
        step = max(1, int(np.searchsorted(np.cumsum(self.size[order]), max(FIRST, 4 * k))) + 1)
        while done < len(order):
            # equal scores may still win by their ids
            reach = order[done : done + step]
            if len(best[1]) >= k:
                reach = reach[bound[reach] >= best[1][-1]]
            if not len(reach):
                break
            doc, score = self.scores(at[reach], weight)
            found = score > 0
            best = top(np.append(best[0], self.ids[doc[found]]), np.append(best[1], score[found]), k)
            done += len(reach)
            step = max(1, 2 * step)
        return best, done


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) > 8 * k:
        some = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[some], scores[some]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _search_block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame | None:
    """(key, doc_id, score): k rows a task and item at most."""
    given = read_items(items)
    if given is None:
        return None
    index = stored(forward(docs, given.vocab))
    total = index.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(given.vocab), dtype=np.int64)
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
        df[r["term"]] = r["df"]  # one row a term of the items
    n_docs, n_terms = total["n"], total["terms"]
    w = weights(n_docs, df)
    shape = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches_in):
        edge = np.searchsorted(given.item, np.arange(len(given.keys) + 1))
        asked = [(given.term[a:b], w[given.term[a:b]] * given.times[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(asked)
        for whole in batches_in:
            for lo in range(0, whole.num_rows, BLOCK):
                b = whole.slice(lo, BLOCK)
                ids = b.column(0).fill_null(LAST).to_numpy()
                n = b.column(1).to_numpy()
                # python numbers where a product could pass 64 bits
                wide = int(n.max(initial=0)) * 25 * n_docs >= 1 << 63
                m = 75 + np.array([25 * x * n_docs // n_terms for x in n.tolist()], dtype=np.int64) if wide else 75 + 25 * n * n_docs // n_terms
                size = np.diff(b.column(2).offsets.to_numpy())
                strata = Strata(ids, m, np.repeat(np.arange(len(ids)), size), b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy(), len(given.vocab))
                for i, (term, weight) in enumerate(asked):
                    if len(term):
                        best[i], _ = strata.search(term, weight, k, best[i])
        count = [len(ids) for ids, _ in best]
        ids, scores = (np.concatenate(x) for x in zip(*best, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(given.keys, count)), pa.array(ids, mask=ids == LAST), pa.array(scores)], schema=shape)

    return index.mapInArrow(run, "key long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, block: int = ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item of (item_id, text) its k best documents of (doc_id, text)."""
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    # stored, so that an item has one key in all that follows
    asked = stored(asked.withColumn("key", F.monotonically_increasing_id()))
    n = max(1, -(-asked.count() // block))
    parts = [_search_block(docs, asked.filter(F.pmod(F.xxhash64("key"), F.lit(n)) == i), k) for i in range(n)]
    found = None
    for part in parts:
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("key", "item_id").hint("merge"), "key").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of the query: the 20 best documents of every benchmark item."""
    return search(docs, benchmark, 20)


OP13_SQL = r"""
WITH i AS (
  SELECT item_id, text, row_number() OVER () AS k FROM (SELECT DISTINCT item_id, text FROM benchmark)
), q AS (
  SELECT k, t, count(*) AS times FROM (
    SELECT k, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM i
  ) GROUP BY k, t
), d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), e AS (
  SELECT row_number() OVER () AS r, doc_id, ts, len(ts) AS n FROM d WHERE len(ts) > 0
), c AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS l FROM e
), p AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM e) WHERE t IN (SELECT t FROM q) GROUP BY r, t
), w AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c
), s AS (
  SELECT k, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // l)))) AS BIGINT) AS score
  FROM q JOIN w USING (t) JOIN p USING (t) JOIN e USING (r), c GROUP BY k, r
), o AS (
  SELECT k, doc_id, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN e USING (r) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o JOIN i USING (k) WHERE rank <= 20
"""
