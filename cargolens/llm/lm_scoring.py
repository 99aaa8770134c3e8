"""Cross-entropy difference of two matched n-gram models.

Both models are bigram models with the same shape, smoothing and vocabulary; one is trained
on the target documents, the other on all documents. The vocabulary holds every word of the
corpus, and unigram and bigram counts are exact, so that the models grow with the input. A
bigram's probability is interpolated with the unigram's, which is smoothed by one.

A document's score is the mean over its tokens of the target model's loss minus the
background model's: the lower, the more it reads like the target.

The models never leave the executors; the driver gets a few sums. Texts are read and cut to
words once, into a stored table of *batches*: some neighbouring texts, the 64-bit hashes of
their distinct words, and each word's place among these. A batch asks for the counts it needs
and gets them back:

* It sends its distinct words, with how often they stand in it, sorted and cut into ranges of
  hashes. Each range meets in one task, which adds up what all batches have sent, and answers
  each batch with the totals in the order of its words.
* Its distinct bigrams go the same way, in ``SLICES`` parts of all hashes, one after another,
  so that shuffle files take a bounded share of the input.
* The batch meets its answers again, works out the losses of its bigrams and adds them up by text.

Rows of these shuffles are packed arrays. A bigram travels once for each batch in which it
stands, so that one that every text holds is no heavier than any other, and ranges are made as
many as keep each below ``RANGE`` entries.

Defined results: null text and text without words has no tokens, losses null and score 0;
without target documents both models are the background model and all scores are 0; repeated
rows count and are scored as often as they stand; rows with a null id are never target
documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .lineage import cut, discard, release, scratch, stored
from .wordhash import BASE, Words, batches, mix

#: Weight of the bigram part.
BLEND = 0.6
#: Tokens of a batch, unless one text has more, and entries in a range of hashes, about.
BATCH, RANGE = 1 << 18, 1 << 22
#: Parts of all bigrams, by their hashes.
SLICES = 2

BATCHES = "batch long, ids array<long>, inside array<boolean>, sizes array<long>, vocab binary, tokens binary"
ASKED = "range long, batch long, hashes binary, n binary, t binary"
ANSWERED = "batch long, kind int, range long, n binary, t binary, known long"


def _pack(x: np.ndarray) -> bytes:
    """Small numbers, at a fraction of their bytes."""
    return zstandard.compress(x.tobytes(), 1)


def _unpack(x: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x.as_py()), dtype=kind)


def batch_table(docs: DataFrame) -> DataFrame:
    """Batches of the rows of (doc_id, in_target, text)."""
    words = Words(fold=True)

    def cut_up(batches_in):
        held: list[tuple] = []
        number = TaskContext.get().partitionId() << 32

        def emit():
            nonlocal number
            ids, inside, sizes, hashes = zip(*held, strict=True)
            vocab, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            columns = [
                pa.array([number]), pa.array([[i for x in ids for i in x]], pa.list_(pa.int64())), pa.array([[i for x in inside for i in x]], pa.list_(pa.bool_())),
                pa.array([np.concatenate(sizes)], pa.list_(pa.int64())), pa.array([vocab.tobytes()], pa.binary()), pa.array([_pack(tokens.astype(np.uint32))], pa.binary()),
            ]
            number += 1
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["batch", "ids", "inside", "sizes", "vocab", "tokens"])

        for b in batches_in:
            for row, to, data, offsets in batches(b.column(2)):
                hashes, at = words.of(data, offsets)
                ids, inside = b.column(0).slice(row, to - row).to_pylist(), b.column(1).slice(row, to - row).to_pylist()
                lo = 0
                while lo < to - row:
                    room = BATCH - sum(len(h[3]) for h in held)
                    hi = max(lo + (not held), int(np.searchsorted(at, at[lo] + room, side="right")) - 1)
                    if hi > lo:
                        held.append((ids[lo:hi], inside[lo:hi], np.diff(at[lo : hi + 1]), hashes[at[lo] : at[hi]]))
                        lo = hi
                    if lo < to - row:
                        yield emit()
        if held:
            yield emit()

    return docs.select("doc_id", "in_target", "text").mapInArrow(cut_up, BATCHES)


class Batch:
    """One row of the batch table."""

    def __init__(self, inside: pa.Scalar, sizes: pa.Scalar, vocab: pa.Scalar, tokens: pa.Scalar):
        self.sizes = sizes.values.to_numpy()
        self.vocab, self.tokens = np.frombuffer(vocab.as_py(), dtype=np.uint64), _unpack(tokens, np.uint32)
        self.inside = np.repeat(inside.values.to_numpy(zero_copy_only=False), self.sizes)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, n, t) of each distinct word, by hash; those of the target are t."""
        size = len(self.vocab)
        return self.vocab, np.bincount(self.tokens, minlength=size), np.bincount(self.tokens, self.inside, minlength=size).astype(np.int64)

    def starts(self) -> np.ndarray:
        out = np.zeros(len(self.tokens), dtype=bool)
        out[self.first[self.sizes > 0]] = True
        return out

    def pair_hashes(self) -> np.ndarray:
        """A hash of each token and the one before, or of the token alone at a text's start."""
        hashes, start = self.vocab[self.tokens], self.starts()
        before = np.zeros_like(hashes)
        before[1:] = hashes[:-1]
        before[start] = 0
        pair = before * np.uint64(BASE) + hashes
        pair[start] = mix(~pair[start])
        return mix(pair)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, n, t) of each distinct bigram, by hash, and the place of each token's bigram among them."""
        pairs, back, n = np.unique(self.pair_hashes(), return_inverse=True, return_counts=True)
        return pairs, n, np.bincount(back, self.inside, minlength=len(pairs)).astype(np.int64), back


def _edges(hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that sorted hashes fall into, and where each range begins; one more place."""
    width = -(-(1 << 64) // ranges)
    at = hashes // np.uint64(width) if ranges > 1 else np.zeros(len(hashes), dtype=np.uint64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, dtype=np.int64)
    return at[first].astype(np.int64), np.append(first, len(hashes))


def _part(pairs: np.ndarray, part: int, parts: int) -> tuple[int, int]:
    """From which to which of the sorted hashes a part goes."""
    width = -(-(1 << 64) // parts)
    lo, hi = np.searchsorted(pairs, np.uint64(part * width)), len(pairs) if part == parts - 1 else np.searchsorted(pairs, np.uint64((part + 1) * width))
    return int(lo), int(hi)


def asked(table: DataFrame, ranges: int, part: tuple[int, int] | None = None) -> DataFrame:
    """What the batches ask for, a row a batch and range: their words, or a part of their bigrams."""

    def ask(batches_in):
        for b in batches_in:
            for i in range(b.num_rows):
                own = Batch(*(b.column(c)[i] for c in range(1, 5)))
                hashes, n, t = own.words() if part is None else own.pairs()[:3]
                if part is not None:
                    lo, hi = _part(hashes, *part)
                    hashes, n, t = hashes[lo:hi], n[lo:hi], t[lo:hi]
                at, edge = _edges(hashes, ranges)
                parts = lambda x, pack: pa.array([pack(x[a:z]) for a, z in zip(edge[:-1], edge[1:], strict=True)], pa.binary())  # noqa: E731,B023
                columns = [pa.array(at), pa.array(np.full(len(at), b.column(0)[i].as_py())), parts(hashes, np.ndarray.tobytes), parts(n.astype(np.int32), _pack), parts(t.astype(np.int32), _pack)]
                yield pa.RecordBatch.from_arrays(columns, names=["range", "batch", "hashes", "n", "t"])

    return table.select("batch", "inside", "sizes", "vocab", "tokens").mapInArrow(ask, ASKED)


def answered(questions: DataFrame, kind: int) -> DataFrame:
    """The totals of what was asked, in its order. ``known``: number of distinct hashes of a range, once a range."""

    def answer(group: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(v.as_py(), dtype=np.uint64) for v in group.column("hashes")]
        n, t = ([_unpack(v, np.int32) for v in group.column(c)] for c in ("n", "t"))
        each, back = np.unique(np.concatenate(hashes), return_inverse=True)
        edge = np.cumsum([0, *(len(h) for h in hashes)])

        def totals(parts: list[np.ndarray]) -> pa.Array:
            total = np.bincount(back, np.concatenate(parts), minlength=len(each)).astype(np.int64)[back]
            return pa.array([_pack(total[a:z]) for a, z in zip(edge[:-1], edge[1:], strict=True)], pa.binary())

        rows = group.num_rows
        known = pa.array([len(each), *[0] * (rows - 1)], pa.int64())
        columns = [group.column("batch"), pa.array([kind] * rows, pa.int32()), group.column("range"), totals(n), totals(t), known]
        return pa.Table.from_arrays(columns, names=["batch", "kind", "range", "n", "t", "known"])

    return questions.groupBy("range").applyInArrow(answer, ANSWERED)


def text_losses(table: DataFrame, answers: DataFrame, sums: dict) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss) of every text; the losses are means over its tokens."""
    shape = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64())])

    def score(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        kind = group.column("kind").to_numpy()
        (row,) = np.flatnonzero(kind == 0)
        own = Batch(*(group.column(c)[int(row)] for c in ("inside", "sizes", "vocab", "tokens")))
        order = np.lexsort((group.column("range").to_numpy(), kind))
        whole = lambda c, wanted: np.concatenate([np.zeros(0, dtype=np.int64), *(_unpack(group.column(c)[int(i)], np.int64) for i in order if wanted(kind[i]))])
        back, start = own.pairs()[3], own.starts()
        before = np.concatenate([own.tokens[:1], own.tokens[:-1]])

        def losses(c: str) -> np.ndarray:
            words, pairs = whole(c, lambda k: k == 1), whole(c, lambda k: k > 1)
            total, starts = sums[c], sums[f"{c}_texts"]
            context = np.maximum(np.where(start, starts, words[before]), 1)
            smooth = (words[own.tokens] + 1) / (total + sums["words"])
            each = -np.log(BLEND * pairs[back] / context + (1 - BLEND) * smooth)
            some = own.sizes > 0
            out = np.full(len(own.sizes), np.nan)
            if some.any():
                out[some] = np.add.reduceat(each, own.first[some]) / own.sizes[some]
            return out

        t, n = losses("t" if sums["t"] else "n"), losses("n")
        ids = group.column("ids")[int(row)].values
        return pa.Table.from_arrays([ids, pa.array(own.sizes), pa.array(t, mask=np.isnan(t)), pa.array(n, mask=np.isnan(n))], schema=shape)

    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    texts = table.select("*", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("range"), *none("binary", "n", "t"))
    given = answers.select("batch", *none("array<long>", "ids"), *none("array<boolean>", "inside"), *none("array<long>", "sizes"), *none("binary", "vocab", "tokens"), "kind", "range", "n", "t")
    both = texts.unionByName(given)
    return both.groupBy("batch").applyInArrow(score, "doc_id long, n_tokens long, target_loss double, background_loss double")


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, slices: int | None = None) -> DataFrame:
    """Scores of all documents; ``target_ids`` (doc_id) name the target documents, of any number. The slices change no score."""
    spark, slices = docs.sparkSession, slices or SLICES
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    wanted = target_ids.select(F.col("doc_id").cast("long"), F.lit(True).alias("in_target")).distinct()
    # one strategy at every size: the labelled ids grow with the corpus and are never broadcast
    marked = texts.join(wanted.hint("shuffle_hash"), "doc_id", "left")
    paths = [scratch(spark)]
    table = stored(batch_table(marked.select("doc_id", F.coalesce("in_target", F.lit(False)).alias("in_target"), "text")), paths[0], "snappy")
    each = table.select(F.inline(F.arrays_zip("inside", "sizes")))
    some, inside = F.col("sizes") > 0, F.col("inside")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    got = each.agg(
        total("sizes").alias("n"), total(F.when(inside, F.col("sizes"))).alias("t"), F.count_if(some).alias("n_texts"), F.count_if(some & inside).alias("t_texts")
    ).first()
    release(spark)
    sums = got.asDict()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sums["n"] // RANGE))
    answers = None
    for i in range(-1, slices):
        questions = asked(table, ranges, None if i < 0 else (i, slices))
        paths.append(scratch(spark))
        answer = stored(answered(questions.repartition(ranges, "range"), 2 + i), paths[-1])
        answers = answer if answers is None else answers.unionByName(answer)
        if i < 0:
            sums["words"] = answer.agg(total("known")).first()[0]
        release(spark)
    out = cut(text_losses(table, answers, sums))
    for path in paths:  # what is left does not read them again
        discard(spark, path)
    score = F.coalesce(F.col("target_loss") - F.col("background_loss"), F.lit(0.0)).alias("score")
    return out.select("doc_id", "n_tokens", "target_loss", "background_loss", score)


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents scored against those labelled as of high quality, outside the held-out fifth of ids."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull() & (fold != 0)).select("doc_id")
    return cross_entropy_difference(docs, good)
