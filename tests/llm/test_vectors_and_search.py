"""Whitening, fingerprints and ranked search against brute force, SQL and hand-made cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.llm import fingerprints, queries, ranking, whitening

from ..oracle import DATA

# ---- op11 -------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 9, 64])
@pytest.mark.parametrize("kind", ["random", "graded", "short", "equal", "zero column", "nearly equal"])
def test_largest_eigen(n, kind):
    rng = np.random.default_rng(n)
    a = rng.standard_normal((3 * n + 1, n))
    if kind == "graded":
        a *= np.logspace(0, -12, n)
    elif kind == "short":
        a = a[: max(1, n // 2)]
    elif kind == "equal":
        a = np.linalg.qr(a)[0] * np.repeat([3.0, 2.0, 1.0], n)[:n]
    elif kind == "zero column":
        a[:, 0] = 0
    elif kind == "nearly equal":
        left, right = np.linalg.qr(a)[0], np.linalg.qr(rng.standard_normal((n, n)))[0]
        a = left * (1 + 1e-9 * np.arange(n)) @ right
    values, vectors, total = whitening.largest_eigen(np.linalg.qr(a, mode="r"), 8)
    want = np.linalg.svd(a, compute_uv=False) ** 2
    k = len(values)
    assert k == min(8, int((want > (n * 2.0**-52) ** 2 * want[0]).sum() if want[0] else 0))
    assert np.allclose(values, want[:k], rtol=1e-11) and np.isclose(total, want.sum())
    assert np.abs(vectors.T @ vectors - np.eye(k)).max(initial=0) < 1e-10
    assert np.abs(a.T @ (a @ vectors) - vectors * values).max(initial=0) <= 1e-12 * max(want[0], 1e-300)


def test_dqds_keeps_relative_accuracy():
    # all entries of B**-1 are known exactly: singular values of B and of its inverse are each other's reciprocals
    diagonal, upper = 2.0 ** -np.arange(0, 40, 2.0), 2.0 ** -np.arange(1, 39, 2.0)
    got = np.sqrt(whitening.singular_squares(diagonal, upper))
    inverse = np.linalg.inv(np.diag(diagonal) + np.diag(upper, 1))
    assert np.isclose(got[-1], 1 / np.linalg.svd(inverse, compute_uv=False)[0], rtol=1e-13)
    assert np.isclose(np.prod(got), np.prod(diagonal), rtol=1e-12) and got[-1] < 1e-9


def whitened(df, **names):
    return sorted((tuple(r) for r in whitening.op11(df).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()), key=lambda r: (repr(r[0]), r[1]))


def plain_whitening(rows):
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    off = (np.array(x, dtype=float) * n - np.array(sums, dtype=float)) / n
    e, v = np.linalg.eigh(off.T @ off / n)
    e, v = e[::-1][:8], v[:, ::-1][:, :8]
    return n, [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x], off @ v / np.sqrt(e), e / np.trace(off.T @ off / n)


def agree(got, rows):
    n, deviation, w, explained = plain_whitening(rows)
    k = w.shape[1]
    assert len(got) == n * k
    table = np.array([r[4] for r in got]).reshape(n, k)
    order = sorted(range(n), key=lambda i: repr(rows[i][0]))
    w = w[order]
    signs = np.sign((table * w).sum(axis=0))
    assert np.allclose(table, w * signs, atol=1e-7)
    assert [r[3] for r in got[::k]] == [deviation[i] for i in order] and {r[2] for r in got} == {n}
    assert np.allclose([r[5] for r in got[:k]], explained, rtol=1e-9) and 0 <= got[0][6] < 1e-9


def test_whitening_of_the_whole_table(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    agree(whitened(df), [(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_whitening_in_many_tasks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 16)
    df = spark.read.parquet(f"{DATA}/embeddings.parquet").repartition(9)
    agree(whitened(df), [(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_whitening_of_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.random() for _ in range(5)]) for i in range(40)]
    rows += [(7, rows[3][1]), (None, rows[4][1]), (50, None), (51, [0.1, None, 0.2, 0.3, 0.4]), (52, [math.nan] * 5), (53, [math.inf] + [0.0] * 4), (54, []), (55, [1e300] * 5)]
    shape = "vec_id long, embedding array<double>, n long, component string"
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], shape)
    used = sorted(rows[:42], key=lambda r: (repr(r[0]), r[1]))
    got = whitened(df)
    n, deviation, w, _ = plain_whitening(used)
    assert len(got) == n * 5 and Counter(r[3] for r in got) == Counter({d: 5 * k for d, k in Counter(deviation).items()})
    assert sum(r[0] is None for r in got) == 5 and sum(r[0] == 7 for r in got) == 10
    assert whitened(df.limit(0)) == [] and whitened(df.filter("vec_id >= 50")) == []
    # equal rows have no component, two lengths are fitted apart
    assert whitened(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<double>")) == []
    two = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [0.0, 0.0]), (4, [1.0, 1.0]), (5, [3.0, 0.0])], "vec_id long, embedding array<double>")
    assert Counter((r[0], r[2]) for r in whitened(two)) == {(1, 2): 1, (2, 2): 1, (3, 3): 2, (4, 3): 2, (5, 3): 2}
    # sums beyond 64 bits stay exact, deviations beyond are null
    big = spark.createDataFrame([(i, [2.0**49 * (i % 3)]) for i in range(9)], "vec_id long, embedding array<double>")
    got = whitened(big)
    assert len(got) == 9 and [round(r[4], 6) for r in got[:3]] in ([-1.224745, 0.0, 1.224745], [1.224745, 0.0, -1.224745])
    assert [r[3] for r in got[:3]] == [None, 0, None]


# ---- op12 -------------------------------------------------------------------------------


def test_sampler_is_unbiased():
    sampler, rng = fingerprints.Sampler(20_000), np.random.default_rng(3)
    for n in (5, 40, 400):
        terms = rng.integers(0, 2**63, n).astype(np.uint64)
        a, b = rng.integers(0, 9, n), rng.integers(0, 9, n)
        one = lambda w: sampler.of(np.zeros((w > 0).sum(), dtype=int), terms[w > 0], w[w > 0], 1)  # noqa: E731,B023
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((one(a) == one(b)).mean() - want) < 4 * math.sqrt(want * (1 - want) / 20_000)
        assert (one(a) == one(a[::1].copy())).all()


def tf_jaccard(a, b):
    low = lambda t: Counter("".join(c.lower() if c.isascii() else c for c in t).split(" "))
    a, b = ({w: n for w, n in low(re.sub(r"[\t-\r]", " ", t)).items() if w} for t in (a, b))
    most = sum(max(a.get(w, 0), b.get(w, 0)) for w in {*a, *b})
    return sum(min(a.get(w, 0), b.get(w, 0)) for w in {*a, *b}) / most if most else 1.0


def check_fingerprints(df, rows):
    """``rows``: (id, text) in the defined order, except for the order of rows with one id."""
    key = lambda r: (r[0] is not None, r[0] or 0)
    got = [tuple(r) for r in fingerprints.op12(df).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()]
    assert sorted((r[0] or -1, r[1]) for r in got) == sorted((i or -1, len(t or "")) for i, t in rows)
    own = [(i, t or "") for i, t in sorted(rows, key=key)]
    if own and len({i for i, _ in own}) == len(own):
        by_id, off = {r[0]: r for r in got}, []
        prints = {}
        for (i, t), (_, after) in zip(own, [*own[1:], own[0]]):
            edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
            r = by_id[i]
            assert r[2] == hashlib.sha256(edited.encode()).hexdigest()
            assert prints.setdefault(t, r[3]) == r[3] and prints.setdefault(edited, r[4]) == r[4]
            off += [r[5] - tf_jaccard(t, edited), r[6] - tf_jaccard(t, after)]
        assert max(map(abs, off)) < 0.25 and abs(np.mean(off)) < 0.03
    return got


def test_fingerprints_of_the_whole_table(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = check_fingerprints(df, rows)
    # shown fingerprints compare alike in SQL, and alone
    alone = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(df).collect()}
    assert all(alone[r[0]] == r[3] for r in got)
    both = spark.createDataFrame([r[3:6] for r in got], "a string, b string, near double")
    assert both.filter(fingerprints.likeness(F.col("a"), F.col("b")) != F.col("near")).count() == 0


def test_fingerprints_do_not_depend_on_places(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    rows = [(i * 3, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(200)]
    monkeypatch.setattr(fingerprints, "AHEAD", 500)
    monkeypatch.setattr(fingerprints, "ENTRIES", 37)
    monkeypatch.setattr(fingerprints, "TERMS", 5)
    for n in (1, 4, 300):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        check_fingerprints(df, rows)


def test_fingerprints_of_odd_rows(spark):
    long = "lorem " * 200_000 + "end"
    shape = "doc_id long, text string, place int, h string"
    one = lambda rows: check_fingerprints(spark.createDataFrame([(*r, 1, "x") for r in rows], shape), rows)
    assert one([]) == []
    (r,) = one([(4, "a b c d")])
    assert r[6] == 1.0 and r[1] == 7
    got = {r[0]: r for r in one([(1, None), (2, ""), (3, " \n\t "), (4, "ünï cödé 𝒳 text"), (5, long), (None, "no id")])}
    assert got[1][5] == got[1][6] == got[2][6] == 1.0 and got[3][6] == 0.0 and got[1][3] == got[3][3]
    assert got[4][1] == 15 and got[5][1] == len(long)
    # several rows without id come first, by their hash; repeated rows follow one another
    got = one([(None, f"t{i} lost") for i in range(30)] + [(1, "x y z")] * 3 + [(2, "q r s")])
    assert sorted(r[6] for r in got if r[0] == 1)[1:] == [1.0, 1.0] and len(got) == 34


# ---- op13 -------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_search(docs, items, k=20):
    d = [(i, Counter(terms(t))) for i, t in docs]
    d = [(i, c, sum(c.values())) for i, c in d if c]
    n_docs, total = len(d), sum(n for *_, n in d)
    df = Counter(t for _, c, _ in d for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c, n in d:
            m = 75 + 25 * n * n_docs // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in Counter(terms(text)).items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def random_table(rng, n):
    words = [f"w{i}" for i in range(40)]
    return [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(40)], k=rng.choice((1, 3, 3, 3, 9, 30))))) for i in range(n)]


@pytest.mark.parametrize("first", [1, 512])
def test_search_against_brute_force(spark, monkeypatch, first):
    rng = random.Random(2)
    docs = random_table(rng, 400)
    docs += [(5000, docs[3][1]), (5000, docs[3][1]), (None, docs[3][1]), (None, "w1 w2"), (5001, None), (5002, ""), (5003, "., !"), (5004, "w1 " * 5000), (5005, "Ünï-W1_W2 ÜNÏ")]
    items = [(i, " ".join(rng.choices([f"W{j}" for j in range(45)], k=rng.randrange(1, 12)))) for i in range(30)]
    items += [items[0], (1, "w1"), (None, "w2 w2 w2"), (90, None), (91, "nowhere"), (92, "ünï")]
    monkeypatch.setattr(ranking, "BLOCK", 64)
    monkeypatch.setattr(ranking, "FIRST", first)
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n long").repartition(3)
    q = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, key string")
    want = plain_search(docs, items)
    assert found(ranking.search(d, q)) == want
    assert found(ranking.search(d, q, block=7)) == want
    assert found(ranking.search(d, q, k=3)) == plain_search(docs, items, 3)
    assert found(ranking.search(d.limit(0), q)) == [] and found(ranking.search(d, q.limit(0))) == []


def test_strata_are_skipped():
    rng = np.random.default_rng(1)
    n, terms_ = 4000, 30
    m = rng.integers(75, 400, n)
    doc = np.repeat(np.arange(n), 4)
    term, tf = rng.integers(0, terms_, 4 * n), rng.integers(1, 4, 4 * n)
    _, one = np.unique(doc * terms_ + term, return_index=True)
    doc, term, tf = doc[one], term[one], tf[one]
    strata = ranking.Strata(np.arange(n), m, doc, term, tf, terms_)
    none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    asked, weight = np.array([2, 5, 9]), np.array([900, 40, 3])
    (ids, scores), visited = strata.search(asked, weight, 20, none)
    all_scores = np.zeros(n, dtype=np.int64)
    for t, w in zip(asked, weight):
        own = term == t
        np.add.at(all_scores, doc[own], w * ((10**9 * tf[own]) // (1000 * tf[own] + 12 * m[doc[own]])))
    want = np.lexsort((np.arange(n), -all_scores))[:20]
    assert ids.tolist() == want.tolist() and scores.tolist() == all_scores[want].tolist()
    assert visited < len(strata.size) // 2


def test_new_queries_are_registered():
    assert {"op11_embedding_whitening", "op12_document_fingerprints", "op13_ranked_search"} <= set(queries.QUERIES) and "op13_ranked_search" in queries.SQL
