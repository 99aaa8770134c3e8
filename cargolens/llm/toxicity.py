"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

Examples are a bounded, deterministic sample of labelled documents, the same number at most
of either label. Terms are words without ASCII punctuation, in lower case; the vocabulary
holds every term of the examples, with document frequencies counted over all documents.
A document's other terms meet no example but count in its norm: their frequencies come from
a join of all documents' terms by key.

The example vectors form an inverted index. Its long lists, those of common terms, are cut
into blocks of ``INDEX_BLOCK`` examples, and the index knows each term's greatest weight in
each block. A document's rare terms are added up entry by entry; the greatest of these sums
in a block and the block's greatest weights of the common terms bound all its cosines.
Blocks with the best bounds are evaluated first, then only those whose bound reaches the
k-th best cosine so far. Blocks are evaluated for a batch of documents at a time, as matrix
products in single precision; whatever may be among the k best then gets its cosine in
double precision. The result is that of comparing with all examples; equal cosines (to
twelve digits) go by the smaller id.

Neighbours vote with the square of their cosine, examples weighted by how many labelled
documents they stand for. Leaving each example out of its own vote gives votes with known
labels; a monotone fit to them turns votes into probabilities.

Everything that is sent to the driver or broadcast is bounded by the examples' texts. The
nearest examples and their votes do not depend on a document's norm: finding them is a
map-only pass over whole texts, and the norm is joined to what it found.

Defined results: null and empty texts, and texts without any term of the vocabulary, get the
rate of such examples; with no labelled rows at all every score is 0; labels that are null or
not 0 or 1 are not used; a document with several labels counts as toxic if any says so; of
several texts of one labelled id the one with the smallest hash is the example; rows with a
null id are scored and belong to no fold (``held_out`` is false); repeated rows are scored
alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .lineage import cut
from .wordhash import Words, batches, mix

#: Examples of each label at most, neighbours.
EXAMPLES, K = 4000, 48
INDEX_BLOCK = 64
#: Longest lists that are kept dense; documents that are evaluated at a time, and their entries in other lists, at most.
DENSE, BATCH, ENTRIES = 512, 64, 1 << 19
#: What single precision can be wrong by, at most, in a sum of products of unit vectors.
SLACK = 1e-4


class Terms(Words):
    """Words between ASCII characters other than letters and digits."""

    def __init__(self):
        super().__init__(fold=True)
        self.space[:128] = [not chr(b).isalnum() for b in range(128)]


def held_out(doc_id: Column) -> Column:
    """True if crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_examples(labels: DataFrame, label_col: str, most: int = EXAMPLES) -> DataFrame:
    """(doc_id, label, weight): at most ``most`` rows of each label, by a hash of the id."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).filter(~held_out(F.col("doc_id")))
    known = rows.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    known = cut(known)
    count = {r[0]: r[1] for r in known.groupBy("label").count().collect()}  # two rows
    out, share = None, F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    for label in (0, 1):
        n = max(1, count.get(label, 0))
        # a few more than needed pass, so that no task sorts more
        part = known.filter((F.col("label") == label) & (share <= 1.1 * (most + 200) / n))
        part = part.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id").limit(most)
        part = part.withColumn("weight", F.lit(max(1.0, count.get(label, 0) / most)))
        out = part if out is None else out.unionByName(part)
    return cut(out)


def _doc_terms(texts: pa.Array, terms: Terms):
    """(first row, end row, row of each entry from the first on, term hash, count): the distinct terms of some texts at a time."""
    for row, to, data, offsets in batches(texts):
        hashes, at = terms.of(data, offsets)
        text = np.repeat(np.arange(to - row), np.diff(at))
        _, first, n = np.unique(mix(hashes ^ mix(text.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
        order = np.argsort(first)
        yield row, to, text[first[order]], hashes[first[order]], n[order]


def _vectors(docs: DataFrame, without: np.ndarray | None = None) -> DataFrame:
    """(doc_id, term, n): the distinct terms of each text, without those of a (sorted) vocabulary."""
    terms = Terms()

    def unfold(batches_in):
        for b in batches_in:
            for row, _, text, own, n in _doc_terms(b.column(1), terms):
                if without is not None and len(without):
                    keep = lookup(without, own) < 0
                    text, own, n = text[keep], own[keep], n[keep]
                if len(own):
                    columns = [b.column(0).take(pa.array(row + text)), pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "term", "n"])

    return docs.select("doc_id", "text").mapInArrow(unfold, "doc_id long, term long, n long")


def _packed_terms(examples: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, numbers of terms, terms, counts) of the bounded sample, twelve bytes an entry on their way to the driver."""
    terms = Terms()

    def pack(batches_in):
        for b in batches_in:
            for row, to, text, own, n in _doc_terms(b.column(1), terms):
                at = np.searchsorted(text, np.arange(to - row + 1))
                cut_up = lambda x: [x[lo:hi].tobytes() for lo, hi in zip(at[:-1], at[1:], strict=True)]  # noqa: E731,B023
                columns = [b.column(0).slice(row, to - row), pa.array(cut_up(own), pa.binary()), pa.array(cut_up(n.astype(np.int32)), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "terms", "counts"])

    found = examples.select("doc_id", "text").mapInArrow(pack, "doc_id long, terms binary, counts binary").toArrow()
    whole = lambda c, kind: np.frombuffer(b"".join(x.as_py() for x in found.column(c)), dtype=kind)
    counts = [len(x.as_py()) // 4 for x in found.column("counts")]
    return found.column("doc_id").to_numpy(), np.array(counts, dtype=np.int64), whole("terms", np.uint64), whole("counts", np.int32)


def document_frequency(docs: DataFrame, vocab: np.ndarray) -> np.ndarray:
    """In how many of all documents each term of the (sorted) vocabulary stands."""
    terms = Terms()

    def count(batches_in):
        total = np.zeros(len(vocab), dtype=np.int64)
        for b in batches_in:
            for _, _, _, own, _ in _doc_terms(b.column(0), terms):
                at = lookup(vocab, own)
                total += np.bincount(at[at >= 0], minlength=len(vocab))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocab), dtype=np.int64)
    out[rows.column("term").to_numpy()] = rows.column("n").to_numpy()  # one row a term of the bounded vocabulary
    return out


def outer_squares(docs: DataFrame, vocab: np.ndarray, n_docs: int) -> DataFrame:
    """(key, square) per distinct text of (key, text): the squared weights of its terms outside the vocabulary.

    ``key`` is a hash of the text, so that copies add up to a multiple, which is divided out.
    """
    terms = _vectors(docs.select(F.col("key").alias("doc_id"), "text"), vocab).withColumnRenamed("doc_id", "key")
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # as many rows as the documents have terms: joined by sort-merge at every size
    weight = (1 + F.log("n")) * (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1)
    sums = terms.join(df.hint("merge"), "term").groupBy("key").agg(F.sum(weight * weight).alias("total"))
    copies = docs.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    return sums.join(copies.hint("merge"), "key").select("key", (F.col("total") / F.col("copies")).alias("square"))


def lookup(vocab: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted vocabulary, or -1."""
    at = np.searchsorted(vocab, hashes)
    at[at == len(vocab)] = 0
    return np.where(vocab[at] == hashes, at, -1) if len(vocab) else np.full(len(hashes), -1)


def spans(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` neighbouring places from each ``lo`` on."""
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))


class BlockMaxIndex:
    """Exact nearest examples by cosine."""

    def __init__(self, vocab: np.ndarray, df: np.ndarray, n_docs: int, ids: np.ndarray, labels: np.ndarray, weights: np.ndarray, entries: tuple[np.ndarray, np.ndarray, np.ndarray]):
        """``entries``: example, term and count of each non-zero of the example vectors."""
        self.vocab, self.idf = vocab, np.log((1 + n_docs) / (1 + df)) + 1
        self.n_docs = n_docs
        ex, term, n = entries
        w = (1 + np.log(n)) * self.idf[term]
        # examples whose heaviest term is the same share blocks, so that bounds are tight
        top = np.full(len(ids), len(vocab))
        order = np.lexsort((w, ex))
        top[ex[order]] = term[order]
        rank = np.lexsort((ids, labels, top))
        place = np.empty(len(ids), dtype=np.int32)
        place[rank] = np.arange(len(ids), dtype=np.int32)
        self.ids, self.labels, self.weights = ids[rank], labels[rank], weights[rank]
        ex = place[ex]
        order = np.lexsort((ex, term))
        # what travels is the counts; weights follow from them
        self.term, self.example, self.count = term[order].astype(np.int32), ex[order], n[order].astype(np.int32)
        self.n_blocks = max(1, -(-len(ids) // INDEX_BLOCK))
        self.ready = False

    @property
    def weight(self) -> np.ndarray:
        """Unit weights of the entries."""
        w = (1 + np.log(self.count)) * self.idf[self.term]
        return w / np.sqrt(np.bincount(self.example, w * w, minlength=len(self.ids)))[self.example]

    def unfold(self) -> None:
        """Works out, once, what follows from the entries; it does not travel with the index."""
        if self.ready:
            return
        self.lists = np.searchsorted(self.term, np.arange(len(self.vocab) + 1))
        self.at, self.value = self.example.astype(np.int64), self.weight
        length = np.bincount(self.term, minlength=len(self.vocab))
        long = np.sort(np.argsort(-length, kind="stable")[:DENSE])
        self.column = np.full(len(self.vocab), -1)
        self.column[long] = np.arange(len(long))
        mine = self.column[self.term]
        #: one row per example
        self.dense = np.zeros((self.n_blocks * INDEX_BLOCK, len(long)))
        self.dense[self.at[mine >= 0], mine[mine >= 0]] = self.value[mine >= 0]
        by_block = self.dense.reshape(self.n_blocks, INDEX_BLOCK, len(long))
        self.dense_most = by_block.max(axis=1).T
        self.rare = np.where(self.column < 0, length, 0)
        self.single = np.ascontiguousarray(by_block.transpose(0, 2, 1), dtype=np.float32)
        self.term = self.example = self.count = None
        self.ready = True

    def vectors(self, doc: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, unit weight) of entries in the vocabulary, and the squared length of each of n documents before."""
        term = lookup(self.vocab, hashes)
        doc, counts, term = doc[term >= 0], counts[term >= 0], term[term >= 0]
        w = (1 + np.log(counts)) * self.idf[term]
        square = np.bincount(doc, w * w, minlength=n)
        return doc, term, w / np.sqrt(square)[doc], square

    def nearest(self, doc: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and cosines of the k nearest examples of each of n documents, best first; those at cosine 0 are none."""
        n_blocks, width = self.n_blocks, self.n_blocks * INDEX_BLOCK
        col = self.column[term]
        head = np.zeros((n, self.dense.shape[1]))
        head[doc[col >= 0], col[col >= 0]] = w[col >= 0]
        doc, term, w = doc[col < 0], term[col < 0], w[col < 0]
        size = self.lists[term + 1] - self.lists[term]
        pos = spans(self.lists[term], size)
        to = np.repeat(doc * width, size)
        to += self.at[pos]
        rare = np.bincount(to, np.repeat(w, size) * self.value[pos], minlength=n * width).reshape(n, width)
        bound = head @ self.dense_most + rare.reshape(n, n_blocks, INDEX_BLOCK).max(axis=2)
        common, left, head_single = np.zeros((n, width), dtype=np.float32), bound > 0, head.astype(np.float32)

        def evaluate(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)):
                rows = np.flatnonzero(wanted[:, b])
                common[rows, b * INDEX_BLOCK : (b + 1) * INDEX_BLOCK] = head_single[rows] @ self.single[b]

        first = np.zeros_like(left)
        most = min(n_blocks, -(-3 * k // INDEX_BLOCK))
        np.put_along_axis(first, np.argpartition(-bound, most - 1, axis=1)[:, :most], True, axis=1)
        first &= left
        evaluate(first)
        kth = lambda total: np.partition(total, width - k, axis=1)[:, width - k] if k < width else np.zeros(n)
        single = rare.astype(np.float32)
        least = kth(common + single) - SLACK
        evaluate(left & ~first & (bound >= least[:, None]))
        total = common + single
        least = np.maximum(kth(total) - SLACK, 0)
        out = []
        for i in range(n):
            found = np.flatnonzero((total[i] >= least[i]) & (total[i] > 0))
            exact = np.round(rare[i, found] + self.dense[found] @ head[i], 12)
            best = np.lexsort((self.ids[found], -exact))[:k]
            out.append((found[best], exact[best]))
        return out

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        say = cosine * cosine * self.weights[near]
        return float((say * self.labels[near]).sum() / say.sum())


def monotone_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (x, rising mean of y)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x[order], y[order], w[order], strict=True):
        pools.append([xi * wi, yi * wi, wi])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    sums = np.array(pools)
    return sums[:, 0] / sums[:, 2], sums[:, 1] / sums[:, 2]


class Model:
    """Votes of the nearest examples, turned into probabilities by rising knots."""

    def __init__(self, index: BlockMaxIndex | None, k: int = K, none: float = 0.0):
        self.index, self.k, self.none = index, k, none
        self.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def calibrate(self, votes: dict[int, float | None]) -> None:
        """``votes``: each example's vote without itself, None if it has no neighbour."""
        ix = self.index
        vote = np.array([np.nan if votes.get(i) is None else votes[i] for i in ix.ids.tolist()])
        some = ~np.isnan(vote)
        prior = (ix.labels * ix.weights).sum() / ix.weights.sum()
        own = ix.weights[~some]
        self.none = float(((ix.labels[~some] * own).sum() + prior) / (own.sum() + 1))
        if some.any():
            self.knots = monotone_fit(vote[some], ix.labels[some].astype(float), ix.weights[some])

    def search(self, texts: pa.Array, terms: Terms, k: int):
        """(row, places, cosines in the vocabulary, squared length there) of each text with a neighbour."""
        self.index.unfold()
        for row, to, doc, hashes, counts in _doc_terms(texts, terms):
            doc, term, w, square = self.index.vectors(doc, hashes, counts, to - row)
            # as many documents as stay below both bounds, one at least
            upto = np.cumsum(np.bincount(doc, self.index.rare[term], minlength=to - row))
            lo = 0
            while lo < to - row:
                before = upto[lo - 1] if lo else 0
                hi = min(lo + BATCH, max(lo + 1, int(np.searchsorted(upto, before + ENTRIES, side="right"))), to - row)
                a, b = np.searchsorted(doc, (lo, hi))
                for i, (near, cosine) in enumerate(self.index.nearest(doc[a:b] - lo, term[a:b], w[a:b], hi - lo, k)):
                    if len(near):
                        yield row + lo + i, near, cosine, float(square[lo + i])
                lo = hi


def _own_votes(examples: DataFrame, model: Model) -> dict[int, float | None]:
    """The vote of each example's neighbours, without itself."""
    terms = Terms()

    def run(batches_in):
        for b in batches_in:
            ids, votes = b.column(0).to_numpy(), np.full(b.num_rows, np.nan)
            for row, near, cosine, _ in model.search(b.column(1), terms, model.k + 1):
                keep = model.index.ids[near] != ids[row]
                near, cosine = near[keep][: model.k], cosine[keep][: model.k]
                if len(near):
                    votes[row] = model.index.vote(near, cosine)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(votes, mask=np.isnan(votes))], names=["doc_id", "vote"])

    rows = examples.select("doc_id", "text").mapInArrow(run, "doc_id long, vote double").collect()  # bounded by the sample
    return {r[0]: r[1] for r in rows}


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: int = EXAMPLES) -> Model:
    """Learns from (doc_id, text) and (doc_id, label). Ids serve to find an example's text only."""
    chosen = sample_examples(labels, label_col, most)
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # 2 * most ids at most: a bounded broadcast
    texts = keyed.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "weight")
    # of several texts of an id the same one in whatever order they are read
    examples = cut(texts.agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")))
    rows = examples.select("doc_id", "label", "weight").collect()  # bounded by the sample
    if not rows:
        return Model(None)
    found_ids, sizes, hashes, counts = _packed_terms(examples)
    vocab = np.unique(hashes)
    if not len(vocab) or len({r["label"] for r in rows}) < 2:
        w = sum(r["weight"] for r in rows)
        return Model(None, none=sum(r["label"] * r["weight"] for r in rows) / w)
    n_docs, df = docs.count(), document_frequency(keyed, vocab)
    ids = np.array([r["doc_id"] for r in rows])
    by_id = np.argsort(ids)
    ex = np.repeat(by_id[np.searchsorted(ids[by_id], found_ids)].astype(np.int32), sizes)
    entries = (ex, np.searchsorted(vocab, hashes).astype(np.int32), counts)
    del hashes, counts
    index = BlockMaxIndex(
        vocab, df, n_docs, ids, np.array([r["label"] for r in rows]), np.array([r["weight"] for r in rows], dtype=float), entries
    )
    del entries, ex
    model = Model(index)
    model.calibrate(_own_votes(examples, model))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, evidence) of every row of (doc_id, text)."""
    terms = Terms()
    # the model travels with the function; it is bounded by the examples' texts
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))
    shape = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("inner", pa.float64()), ("score", pa.float64()), ("evidence", evidence)])

    def run(batches_in):
        ix = model.index
        for b in batches_in:
            scores, inner, why = np.full(b.num_rows, model.none), np.zeros(b.num_rows), [[]] * b.num_rows
            for row, near, cosine, square in model.search(b.column(2), terms, model.k) if ix else ():
                scores[row] = np.interp(ix.vote(near, cosine), *model.knots)
                inner[row] = square
                best = zip(ix.ids[near[:3]].tolist(), ix.labels[near[:3]].tolist(), cosine[:3].tolist(), strict=True)
                why[row] = [{"doc_id": i, "label": y, "cosine": c} for i, y, c in best]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(inner), pa.array(scores), pa.array(why, type=evidence)], schema=shape)

    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("key"), "text")
    out = d.mapInArrow(run, "doc_id long, key long, inner double, score double, evidence array<struct<doc_id:bigint,label:int,cosine:double>>")
    if model.index is None:
        return out.select("doc_id", "score", "evidence")
    outer = cut(outer_squares(d.select("key", "text"), model.index.vocab, model.index.n_docs))
    share = F.sqrt(F.col("inner") / (F.col("inner") + F.coalesce("square", F.lit(0.0))))
    whole = F.transform("evidence", lambda e: F.struct(e["doc_id"].alias("doc_id"), e["label"].alias("label"), (e["cosine"] * share).alias("cosine")))
    return out.join(outer.hint("merge"), "key", "left").select("doc_id", "score", whole.alias("evidence"))


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the query."""
    out = score(docs, fit(docs, labels))
    near = F.transform("evidence", lambda e: F.concat_ws(":", e["doc_id"].cast("string"), e["label"].cast("string"), F.format_number(e["cosine"], 4)))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.array_join(near, ",").alias("evidence"),
    )
