"""Removal of passages that stand in the corpus more than once.

A window is ``WINDOW`` consecutive words. A word goes if it is covered by a window whose
word sequence also starts anywhere else. The work is arranged so that only a small part of
all windows is ever shuffled:

1. **Fingerprints.** Each window is represented by the smallest hash among the 8-word
   sequences inside it. Equal windows have equal fingerprints at the same place, and
   neighbouring windows mostly share one, so that a text has about one fingerprint for
   fourteen windows.
2. **Log-structured index.** A batch of documents adds one immutable run with a row for each
   fingerprint (fingerprint, number of places, the place if it is the only one), bucketed
   and sorted by fingerprint. The new run is merge-joined with every older one; neither side
   is shuffled again. A fingerprint that an older run knows, or that stands twice in the
   batch, is *repeated*: the batch's documents that hold it and the one older document whose
   only place in a run it was are hits. All other places of it became hits when they came in. When
   there are more runs than the fan-out they are compacted into one.
3. **Verification.** Windows of the hits whose fingerprint is repeated are compared
   themselves, by two independent 64-bit hashes of their words, counted over the corpus and
   combined before the shuffle. Documents with equal word sequences are one class, and only
   one of them takes part, with its weight.
4. **Removal.** The windows found to be repeated go back to their documents.

Nothing is collected to the driver; a passage that a third of all documents share is a hot
key of joins whose sides are both dealt by that key, which adaptive execution splits.

Defined results: null text has no words; texts with fewer words than a window lose nothing;
an overlapping repeat inside one document counts; repeated rows are copies of each other,
so that they lose all words if they have a window; a null id is returned as it is.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .lineage import cut, discard, scratch, spread, stored
from .wordhash import Words, batches, mix, runs

WINDOW = 35
GRAM = 8
EMPTY = hashlib.sha256(b"").hexdigest()


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def _windows(words: Words, data: np.ndarray, offsets: np.ndarray, window: int):
    """Word hashes, text borders in words, and the starts of windows that lie inside one text."""
    hashes, at = words.of(data, offsets)
    n = len(hashes) - window + 1
    if n <= 0:
        return hashes, at, np.zeros(0, dtype=np.int64)
    inside = np.zeros(len(hashes) + 1, dtype=np.int32)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= window:
            inside[lo] += 1
            inside[hi - window + 1] -= 1
    return hashes, at, np.flatnonzero(np.cumsum(inside[:-1]) > 0)


def _fingerprints(hashes: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """The fingerprint of the window at each start."""
    return sliding_min(runs(hashes, GRAM), window - GRAM + 1)[starts]


def _texts_with_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.col("doc_id"), text).alias("key"), F.col("doc_id"), text.alias("text"))


def facts(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, sha) per row; sha is that of all words joined by one space."""
    shape = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string())])

    def look(batches_in):
        for b in batches_in:
            for row, to, data, offsets in batches(b.column(2)):
                raw = data.tobytes()
                texts = [raw[lo:hi].split() for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(row, to - row),
                        b.column(1).slice(row, to - row),
                        pa.array([len(t) for t in texts], type=pa.int64()),
                        pa.array([hashlib.sha256(b" ".join(t)).hexdigest() for t in texts]),
                    ],
                    schema=shape,
                )

    d = _texts_with_key(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return d.mapInArrow(look, "key long, doc_id long, n_words long, sha string")


def fingerprints(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(fp, key, n): fingerprints of a document and the places at which they stand in it."""
    words = Words(fold=False)
    shape = pa.schema([("fp", pa.int64()), ("key", pa.int64()), ("n", pa.int32())])

    def find(batches_in):
        for b in batches_in:
            keys = b.column(0).to_numpy()
            for row, _, data, offsets in batches(b.column(2)):
                hashes, at, starts = _windows(words, data, offsets, window)
                if not len(starts):
                    continue
                grams = runs(hashes, GRAM)
                low = sliding_min(grams, window - GRAM + 1)[starts]
                text = np.searchsorted(at, starts, side="right") - 1
                # a window's place is that of its first smallest gram; windows that slide over it share it
                new = np.ones(len(starts), dtype=bool)
                new[1:] = (low[1:] != low[:-1]) | (starts[1:] != starts[:-1] + 1) | (grams[starts[:-1]] == low[:-1])
                fp, of = low[new], text[new]
                order = np.lexsort((fp, of))
                fp, of = fp[order], of[order]
                first = np.ones(len(fp), dtype=bool)
                first[1:] = (fp[1:] != fp[:-1]) | (of[1:] != of[:-1])
                at_first = np.flatnonzero(first)
                count = np.diff(np.append(at_first, len(fp)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(fp[at_first].view(np.int64)),
                        pa.array(keys[row + of[at_first]]),
                        pa.array(np.minimum(count, 2).astype(np.int32)),
                    ],
                    schema=shape,
                )

    return _texts_with_key(docs).mapInArrow(find, "fp long, key long, n int")


class FingerprintIndex:
    """Sorted immutable runs of (fp, n, key): ``n`` is 1 or 2 (two or more places), ``key`` the place if n is 1.

    Runs are tables under ``path``, in the shared folder by default; ``runs`` holds their
    names. An index with the same path and runs goes on where another one stopped.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, runs: list[str] | None = None, fanout: int = 2):
        self.spark, self.fanout, self.runs = spark, fanout, list(runs or ())
        self.path = path or scratch(spark)

    def _write(self, rows: DataFrame) -> str:
        """``rows``: (fp, n, key), any number for a fingerprint."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"fingerprints_{n}_{uuid.uuid4().hex}"
        one = rows.groupBy("fp").agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"), F.min("key").alias("key"))
        one = one.withColumn("key", F.when(F.col("n") == 1, F.col("key")))  # dealt by fp already, as buckets are
        one.write.bucketBy(n, "fp").sortBy("fp").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def table(self, run: str) -> DataFrame:
        if not self.spark.catalog.tableExists(run):
            buckets = int(run.split("_")[1])
            self.spark.sql(
                f"CREATE TABLE {run} (fp BIGINT, n INT, key BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {buckets} BUCKETS LOCATION '{self.path}/{run}'"
            )
        return self.spark.table(run)

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        discard(self.spark, f"{self.path}/{run}")

    def known(self, run: str) -> DataFrame:
        """(fp, n, key) of the older runs for each fingerprint of a run: one merge join for each of them."""
        own = self.table(run).select("fp").hint("merge")
        older = [self.table(r).join(own, "fp") for r in self.runs if r != run]
        out = self.table(run).limit(0)
        for o in older:
            out = out.unionByName(o)
        return out

    def add(self, prints: DataFrame) -> DataFrame:
        """Adds a batch (fp, key, n); the hits (fp, key), in it and in older batches, of fingerprints that are now repeated."""
        batch = scratch(self.spark)
        prints = stored(prints, batch)
        run = self._write(prints)
        old = spread(self.known(run))
        self.runs.append(run)
        twice = self.table(run).filter("n > 1").select("fp").unionByName(old.select("fp"))
        hits = prints.select("fp", "key").join(twice, "fp", "left_semi").unionByName(old.filter("n = 1").select("fp", "key"))
        hits = cut(hits)
        discard(self.spark, batch)
        if len(self.runs) > self.fanout:
            self.compact()
        return hits

    def compact(self) -> None:
        if len(self.runs) > 1:
            # as files: Spark takes a union of bucketed tables to be dealt by their key, which it is not
            rows = self.spark.read.schema("fp long, n int, key long").parquet(*(f"{self.path}/{r}" for r in self.runs))
            old, self.runs = self.runs, [self._write(rows)]
            for r in old:
                self._drop(r)

    def drop(self) -> None:
        for r in self.runs:
            self._drop(r)
        self.runs = []


def _candidate_windows(found: DataFrame, window: int) -> DataFrame:
    """(h, v, key, n) per distinct window of (key, text, fps, weight) whose fingerprint is repeated."""
    words, second = Words(fold=False), Words(fold=False, seed=77)
    shape = pa.schema([("h", pa.int64()), ("v", pa.int64()), ("key", pa.int64()), ("n", pa.int32())])

    def check(batches_in):
        for b in batches_in:
            keys, weights, prints = b.column(0).to_numpy(), b.column(3).to_numpy(), b.column(2)
            for row, to, data, offsets in batches(b.column(1)):
                hashes, at, starts = _windows(words, data, offsets, window)
                if not len(starts):
                    continue
                low = _fingerprints(hashes, starts, window)
                h = runs(hashes, window)[starts]
                v = runs(second.of(data, offsets)[0], window)[starts]
                edge = np.searchsorted(starts, at)
                parts = []
                for i in range(to - row):
                    lo, hi = edge[i], edge[i + 1]
                    if lo == hi:
                        continue
                    fps = np.asarray(prints[row + i].values.to_numpy()).view(np.uint64)
                    hit = np.isin(low[lo:hi], fps)
                    own, first, count = np.unique(h[lo:hi][hit], return_index=True, return_counts=True)
                    times = np.minimum(count, 2) * weights[row + i]
                    parts.append((own, v[lo:hi][hit][first], np.full(len(own), keys[row + i]), times))
                if parts:
                    own, other, key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own.view(np.int64)),
                            pa.array(other.view(np.int64)),
                            pa.array(key.astype(np.int64)),
                            pa.array(n.astype(np.int32)),
                        ],
                        schema=shape,
                    )

    return found.select("key", "text", "fps", "weight").mapInArrow(check, "h long, v long, key long, n int")


def _without(found: DataFrame, window: int) -> DataFrame:
    """(key, n_removed, kept_text, kept_sha) of (key, text, hs, vs), the hashes of repeated windows."""
    words, second = Words(fold=False), Words(fold=False, seed=77)
    shape = pa.schema([("key", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha", pa.string())])

    def remove(batches_in):
        for b in batches_in:
            keys = b.column(0).to_numpy()
            repeated = lambda c, i: np.asarray(b.column(c)[i].values.to_numpy()).view(np.uint64)  # noqa: B023, E731
            for row, to, data, offsets in batches(b.column(1)):
                hashes, at, starts = _windows(words, data, offsets, window)
                h = v = starts.astype(np.uint64)
                if len(starts):
                    h, v = runs(hashes, window)[starts], runs(second.of(data, offsets)[0], window)[starts]
                edge, raw = np.searchsorted(starts, at), data.tobytes()
                gone_n, kept = [], []
                for i in range(to - row):
                    lo, hi = edge[i], edge[i + 1]
                    cover = np.zeros(at[i + 1] - at[i] + 1, dtype=np.int32)
                    bad = starts[lo:hi][np.isin(h[lo:hi], repeated(2, row + i)) & np.isin(v[lo:hi], repeated(3, row + i))] - at[i]
                    np.add.at(cover, bad, 1)
                    np.add.at(cover, bad + window, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    gone_n.append(int(gone.sum()))
                    text = raw[offsets[i] : offsets[i + 1]].split()
                    kept.append(b" ".join(w for w, g in zip(text, gone.tolist(), strict=True) if not g))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[row:to]),
                        pa.array(gone_n, type=pa.int64()),
                        pa.array([k.decode() for k in kept], type=pa.string()),
                        pa.array([hashlib.sha256(k).hexdigest() for k in kept], type=pa.string()),
                    ],
                    schema=shape,
                )

    return found.mapInArrow(remove, "key long, n_removed long, kept_text string, kept_sha string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, n_batches: int = 4, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) per row of (doc_id, text).

    The documents are added to an index in ``n_batches`` batches, as they would come in over
    time; the verdict is that of the whole corpus. ``kept_text`` is null where nothing was
    removed.
    """
    spark = docs.sparkSession
    index = FingerprintIndex(spark)
    in_batch = F.pmod(F.xxhash64("doc_id"), F.lit(n_batches))
    hits = None
    try:
        for i in range(n_batches):
            new = index.add(fingerprints(docs.filter(in_batch == i), window))
            hits = new if hits is None else hits.unionByName(new)
    finally:
        index.drop()
    return remove_verified(docs, hits, window, with_text)


def remove_verified(docs: DataFrame, hits: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """As ``remove_repeats``, for all documents in an index, given the hits of all its batches."""
    if window < GRAM:
        raise ValueError(f"a window needs {GRAM} words at least")
    known = cut(facts(docs))
    copies = spread(
        known.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("first")).filter("copies > 1")
    )
    of_class = known.join(copies, "sha", "left")
    prints = hits.groupBy("key").agg(F.collect_set("fp").alias("fps"))
    role = (
        of_class.filter("copies is null or key = first")
        .select("key", F.when(F.col("copies").isNull(), 1).otherwise(2).alias("weight"))
        .dropDuplicates(["key"])
    )
    found = stored(_texts_with_key(docs).drop("doc_id").join(prints.join(role, "key"), "key"))
    windows = _candidate_windows(found, window)
    repeated = spread(windows.groupBy("h", "v").agg(F.sum("n").alias("n")).filter("n > 1").select("h", "v"))
    single = _candidate_windows(found.filter("weight = 1"), window)
    back = single.join(repeated, ["h", "v"]).groupBy("key").agg(F.collect_list("h").alias("hs"), F.collect_list("v").alias("vs"))
    cleaned = _without(found.filter("weight = 1").select("key", "text").join(back, "key"), window)
    if not with_text:
        cleaned = cleaned.drop("kept_text")
    all_gone = F.col("copies").isNotNull() & (F.col("n_words") >= window)
    cols = [
        F.col("doc_id"),
        F.col("n_words"),
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    ]
    if with_text:
        cols.append(F.when(all_gone, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
    return of_class.join(cleaned, "key", "left").select(*cols)


def op5(docs: DataFrame) -> DataFrame:
    """The rows of the query."""
    return remove_repeats(docs)


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT rid, w, unnest(CASE WHEN len(w) >= 35 THEN range(1, len(w) - 33) ELSE [] END) AS i FROM d)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c >= 2
), gone AS (
  SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM rep
), g AS (SELECT rid, list(p) AS ps, count(*) AS n FROM gone GROUP BY rid
), k AS (
  SELECT x.rid, string_agg(x.word, ' ' ORDER BY x.p) AS kept
  FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x
  LEFT JOIN gone ON gone.rid = x.rid AND gone.p = x.p WHERE gone.p IS NULL GROUP BY x.rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON g.rid = d.rid LEFT JOIN k ON k.rid = d.rid
"""
