"""The operators against SQL, brute force and hand-made cases."""

import ctypes
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cargolens.llm import automaton, licenses, lm_scoring, minhash, mixing, packing, quality, queries, secrets, substrings, topk, toxicity, wordhash

from ..oracle import DATA, same

ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (None, "one two three four five six"), (5, "Ünïcode — text: token = 'abcdefgh12' AKIA" + "A1" * 9), (6, "w " * 400), (7, "cc by GENERAL public license all rights reserved")]


@pytest.fixture(autouse=True)
def few_slices(monkeypatch):
    monkeypatch.setattr(lm_scoring, "SLICES", 2)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, None, i, "x", 1) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, fail_bits int")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    same(queries.QUERIES[name](spark, DATA), queries.SQL[name])


OPS = [quality.op4, secrets.op8, licenses.op10, minhash.op9, substrings.op5, packing.op2, mixing.op3]


@pytest.mark.parametrize("op", OPS, ids=lambda f: f.__name__)
def test_odd_rows_and_empty_tables(odd, op):
    got = op(odd).collect()
    assert len(got) == len(ROWS)
    assert op(odd.limit(0)).count() == 0


@pytest.fixture(scope="module")
def few_labels(spark):
    return spark.createDataFrame([(4, 1, 1), (7, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("op", [toxicity.op1, lm_scoring.op7], ids=lambda f: f.__name__)
def test_learned_operators_on_odd_rows(odd, few_labels, op):
    assert op(odd, few_labels).count() == len(ROWS)
    assert op(odd.limit(0), few_labels).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_id(df, *columns):
    """The values of these columns by id; repeated rows must agree."""
    out = {}
    for r in df.collect():
        values = tuple(r[c] for c in columns)
        assert out.setdefault(r["doc_id"], values) == values
    return out


def test_packing_values_on_odd_rows(odd):
    none = zlib.crc32((1).to_bytes(4, "little"))
    got = by_id(packing.op2(odd), "start", "doc_tokens", "ids_crc32")
    assert got[1] == got[2] == (0, 1, none) and got[4][1] > 1 and got.keys() == {i for i, _ in ROWS}


def test_substring_values_on_odd_rows(odd):
    got = by_id(substrings.op5(odd), "n_words", "n_removed", "kept_sha256")
    assert got[1] == got[2] == got[3] == (0, 0, sha("")) and got[4] == (2, 0, sha("one two")) and got[6] == (400, 400, sha(""))
    assert got[None] == (6, 0, sha("one two three four five six"))


def test_near_duplicate_values_on_odd_rows(odd):
    got = by_id(minhash.op9(odd), "n_shingles", "component_id", "kept")
    assert got[1] == (0, 1, True) and got[3] == (0, 3, True) and got[4] == (1, 4, True) and got[None] == (2, None, True) and got[6] == (1, 6, True)


def test_scan_and_mix_values_on_odd_rows(odd):
    got = by_id(licenses.op10(odd), "n_words", "n_base", "first_word", "last_word", "base_labels", "score")
    assert got[1] == got[3] == (0, 0, None, None, "", 0.0) and got[7][:5] == (8, 3, 0, 5, "cc-by,gpl,reserved") and got[7][5] > 0
    got = by_id(secrets.op8(odd), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    text = dict(ROWS)[5]
    spans = [(m.start(), "assign", m.end()) for m in re.finditer("token = 'abcdefgh12", text)] + [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text)]
    assert got[1] == got[2] == (0, 0, 0, sha(""), "") and got[5][:4] == (1, 1, 0, sha(",".join(f"{k}:{a}:{b}" for a, k, b in spans)))
    rows = mixing.op3(odd).collect()
    assert sorted(r["mix_order"] for r in rows) == list(range(len(ROWS))) and {r["block"] for r in rows} == {0}


def test_toxicity_values_on_odd_rows(odd, few_labels):
    got = by_id(toxicity.op1(odd, few_labels), "held_out", "score", "predicted")
    assert got[1][1] == got[2][1] == got[3][1] == got[6][1] and not got[None][0] and all(0 <= v[1] <= 1 and v[2] == (v[1] >= 0.5) for v in got.values())
    got = by_id(toxicity.op1(odd, few_labels.limit(0)), "score", "predicted", "evidence")
    assert set(got.values()) == {(0.0, 0, "")}


def test_lm_values_on_odd_rows(odd, few_labels):
    got = by_id(lm_scoring.op7(odd, few_labels), "n_tokens", "target_loss", "score")
    assert got[1] == got[2] == got[3] == (0, None, 0.0) and got[4][0] == 2 and got[4][2] < 0 < got[6][2]
    assert {v[0] for v in by_id(lm_scoring.op7(odd, few_labels.limit(0)), "score").values()} == {0.0}


LONG_WORDS = [f"w{random.Random(i).randrange(10**6)}" for i in range(90_000)]
LONG, ONE = " ".join(LONG_WORDS), "x" * 600_000
N_WORDS = {1: 90_000, 2: 90_001, 3: 1, 4: 3}


@pytest.fixture(scope="module")
def very_long(spark):
    assert len(LONG) > wordhash.CHUNK and len(ONE) > wordhash.CHUNK
    return spark.createDataFrame([(1, LONG, "s"), (2, LONG + " end", "s"), (3, ONE, None), (4, f"a {ONE} b", "t")], "doc_id long, text string, source string")


def test_native_scans_of_very_long_texts(very_long):
    assert {k: v[0] for k, v in by_id(quality.op4(very_long), "n_words").items()} == N_WORDS
    assert {k: v[0] for k, v in by_id(licenses.op10(very_long), "n_words").items()} == N_WORDS
    secret = very_long.withColumn("text", F.concat(F.col("text"), F.lit(" password=abcdef1")))
    assert {v[0] for v in by_id(secrets.op8(secret), "n_assign").values()} == {1}


def test_repeats_in_very_long_texts(very_long):
    got = by_id(substrings.op5(very_long), "n_words", "n_removed", "kept_sha256")
    assert {k: v[0] for k, v in got.items()} == N_WORDS
    assert got[1][1:] == (90_000, sha("")) and got[2][1:] == (90_000, sha("end")) and got[3][1:] == (0, sha(ONE)) and got[4][1:] == (0, sha(f"a {ONE} b"))
    shingles = len({" ".join(LONG_WORDS[i : i + 5]) for i in range(89_996)})
    got = by_id(minhash.op9(very_long), "n_shingles", "component_id")
    assert got[1] == (shingles, 1) and got[2] == (shingles + 1, 1) and got[3] == (1, 3) and got[4] == (1, 4)


def test_models_of_very_long_texts(spark, very_long):
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    assert {k: v[0] for k, v in by_id(lm_scoring.op7(very_long, labels), "n_tokens").items()} == N_WORDS
    assert len(by_id(toxicity.op1(very_long, labels), "score")) == 4


def test_order_and_packing_of_very_long_texts(very_long):
    sums = packing.op2(very_long).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"), F.max("length").alias("most")).collect()
    assert all(r["n"] == r["all"] and r["most"] <= 2048 for r in sums) and len(sums) == 4
    assert mixing.op3(very_long).count() == 4


def test_a_cut_between_words_changes_no_hash(monkeypatch):
    w, data = wordhash.Words(fold=True), np.frombuffer(LONG[:5000].encode() + ONE[:900].encode() + b" tail", dtype=np.uint8)
    whole = w.of(data, np.array([0, len(data)]))[0]
    monkeypatch.setattr(wordhash, "CHUNK", 100)
    assert (w.of(data, np.array([0, len(data)]))[0] == whole).all()


NAMES = ["_gone", "_again", "node", "kept", "slot", "_source", "_row", "_file", "_class", "sequence_id", "length", "n", "spans", "key", "SHINGLES"]


@pytest.fixture(scope="module")
def clashing(spark):
    words = " ".join(f"w{i}" for i in range(40))
    columns = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(i, f"{words} password: abc{i}defgh", "en", "ab"[i % 2], 9, *NAMES) for i in range(6)], columns)


STAGE_LIKE = {
    "deduplicate": (minhash.deduplicate, 1), "redact": (secrets.redact, 6), "mixed": (lambda d: mixing.mixed(d, {"a": 2, "b": 1}), 6), "filter_docs": (quality.filter_docs, 0),
}


@pytest.mark.parametrize("name", STAGE_LIKE)
def test_stages_keep_clashing_columns(clashing, name):
    stage, n = STAGE_LIKE[name]
    out = stage(clashing)
    assert out.columns == clashing.columns
    rows = out.collect()
    assert len(rows) == n and all(r[x] == x for r in rows for x in NAMES)


@pytest.mark.parametrize("op", OPS, ids=lambda f: f.__name__)
def test_queries_on_clashing_columns(clashing, op):
    assert op(clashing).count() == 6


def test_learned_and_ordered_operators_on_clashing_columns(spark, clashing, tmp_path):
    labels = spark.createDataFrame([(0, 1, 1, "x"), (1, 0, 0, "y")], "doc_id long, quality int, toxic int, text string")
    for op in (toxicity.op1, lm_scoring.op7):
        assert op(clashing, labels).count() == 6
    clashing.write.parquet(str(tmp_path / "d"))
    assert packing.pack_in_order(spark.read.parquet(str(tmp_path / "d")), packing.vocabulary()).count() == 6
    vectors = spark.createDataFrame([(i, [float(i), 1.0], "x", "y", "z") for i in range(60)], "vec_id long, embedding array<float>, rank string, score string, query_id string")
    assert topk.op6(vectors).count() == 10


def test_quality_verdicts(odd):
    got = {(r["doc_id"], r["n_words"]): r for r in quality.op4(odd).collect()}
    assert got[(6, 400)]["base_failed"] and got[(6, 400)]["n_repeat_words"] == 400
    assert set(quality.filter_docs(odd).columns) == set(odd.columns)
    led = quality.evaluate_rules(odd, keep=["doc_id", "text"])
    rules = {r["rule"]: r["n_failed"] for r in quality.ablations(led).collect()}
    assert rules["few_words"] == len(ROWS) - 1


def family(seed):
    rng = random.Random(seed)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            w[rng.randrange(150)] = f"x{rng.randrange(40)}"
        rows.append((i * 3 % 121, " ".join(w)))
    return rows + [(1000, None), (1002, "a b"), (1003, "A  b"), (None, "a b"), (1002, "a b")]


def by_hand(rows, per_cent):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and None not in (rows[a][0], rows[b][0]) and 100 * n >= per_cent * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(rows[a][0]), root(rows[b][0])
                up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets)), key=repr)


@pytest.mark.parametrize("per_cent", [80, 85])
def test_near_duplicates_in_small_blocks(spark, monkeypatch, per_cent):
    monkeypatch.setattr(minhash, "BLOCK", 6)
    monkeypatch.setattr(minhash, "SLOT_BLOCKS", 4)
    rows = family(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(r)[:3] for r in minhash.near_duplicates(df, per_cent).collect()], key=repr)
    assert got == by_hand(rows, per_cent)


def test_secret_spans_by_regex():
    rng = random.Random(1)
    parts = ["token", "Secret", "password", " ", "=", ":", "'", '"', "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMNOP12", "é", "ß\n", "ghp_", "0123456789abcdef" * 3, "eyJab", ".", "xoxb-", "api_key", "APIKEY", "bearer ", "sk_live_"]
    scanner = secrets.Scanner()
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 20)))
        want = []
        for k, r in enumerate(secrets.RULES):
            pat = r.pattern
            if r.fold:
                for w in ("password", "passwd", "secret", "token", "api", "key", "bearer"):
                    pat = pat.replace(w, "".join(f"[{c.upper()}{c}]" for c in w))
            for m in re.finditer(pat, text):
                value = re.search(r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", m[0])[1] if r.value else m[0]
                if len(value) >= r.least:
                    want.append((m.start(), k, m.end()))
        assert [(s["start"], s["kind"], s["end"]) for s in scanner.text_spans(text)] == [(s, secrets.RULES[k].kind, e) for s, k, e in sorted(want)]


def test_automaton_is_minimal():
    dfa = automaton.compile_dfa([automaton.parse("a(b|c)d"), automaton.parse("ab?c?d")], search=False)
    assert automaton.longest(dfa, b"abdx", range(4)) == 3 and automaton.longest(dfa, b"x", range(1)) == -1
    with pytest.raises(ValueError):
        automaton.parse("a(")


def test_redaction_keeps_columns(odd):
    out = secrets.redact(odd)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    row = out.filter("doc_id = 5").first()
    assert "[assign]" in row["text"] and "abcdefgh12" not in row["text"] and row["n_chars"] == len(row["text"])


def test_license_rules_hold_their_keywords_and_gates(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for r in licenses.op10(docs).collect()[:1]:
        assert 0 <= r["score"] <= 1
    assert len(licenses.RULES) > 300 and all(r[1] for r in licenses.RULES)
    text = "Licensed under the GNU GPL v2. SPDX-License-Identifier: MIT. CC BY cc by All rights reserved"
    row = licenses.op10(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["license_spans"] == "gpl-2.0:0:6,mit:6:10,all-rights-reserved:14:17" and (row["n_base"], row["first_word"], row["last_word"]) == (3, 10, 14)


BASE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, i - 1 AS place, CASE WHEN w[i:i + 1] = ['cc', 'by'] THEN 'cc-by' WHEN w[i:i + 2] = ['general', 'public', 'license'] THEN 'gpl' WHEN w[i:i + 2] = ['all', 'rights', 'reserved'] THEN 'reserved' END AS label
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)),
b AS (SELECT doc_id, count(*) AS n, min(place) AS f, max(place) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p WHERE label IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, f AS first_word, l AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN b ON b.doc_id = d.doc_id
"""


def test_license_base_against_sql(spark):
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    for folder in (DATA, "/root/testdata/sf0.01"):
        same(licenses.op10(spark.read.parquet(f"{folder}/documents.parquet")).select(columns), BASE_SQL, folder)
    texts = ["CC BY\u212a cc by cc BY", "general public l\u0130cense", "\u0130 All-Rights\tReserved \u212a", "é CC\x00by", None]
    got = licenses.op10(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select(columns)
    assert sorted(map(tuple, got.collect())) == [(0, 6, 2, 2, 4, "cc-by"), (1, 3, 0, None, None, ""), (2, 5, 1, 1, 1, "reserved"), (3, 3, 1, 1, 1, "cc-by"), (4, 0, 0, None, None, "")]


def test_license_spans_by_regex(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: (r["n_words"], r["license_spans"]) for r in licenses.op10(docs).collect()}
    for d in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", d["text"].lower())
        form = " " + "  ".join(words) + " "
        spans = sorted((m.start(), -m.end(), p, i, lab) for i, (lab, _, p, _, pat) in enumerate(licenses.RULES) for m in re.finditer(pat, form))
        kept = [x for k, x in enumerate(spans) if not any(y[2] <= x[2] and y[1] <= x[1] for y in spans[:k])]
        at = lambda n: form[:n].count(" ") // 2
        assert got[d["doc_id"]] == (len(words), ",".join(f"{x[4]}:{at(x[0])}:{at(-x[1])}" for x in kept))


def test_packing_by_the_ids_themselves(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    tok = Tokenizer.from_file(packing.vocabulary()[0])
    out = packing.op2(docs).toPandas().sort_values(["sequence_id", "offset"])
    assert ((out.groupby("sequence_id").length.cumsum() - out.length) == out.offset).all()
    used = out.groupby("sequence_id").length.sum()
    assert used.max() <= 2048 and used.sum() / (2048 * len(used)) > 0.9
    by_doc = dict(list(out.groupby("doc_id")))
    for d in docs.collect():
        ids = np.array([*tok.encode(d["text"], add_special_tokens=False).ids, 1], dtype="<u4")
        own = by_doc[d["doc_id"]].sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum()[:-1].tolist()] and own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        for p in own.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32


def test_ids_of_stretches_are_those_of_whole_texts():
    from tokenizers import Tokenizer

    rng, path = random.Random(3), packing.vocabulary()
    parts = [" ", "  ", "\n", "a", "bc", "é", "'s", "1", "!", "\t", "　", "x ", ".\n", "<|endoftext|>", " \n", "日本", "a.", "ª", "²"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    tok = Tokenizer.from_file(path[0])
    for t, b in zip(texts, packing.token_bytes(*path)(texts), strict=True):
        assert np.frombuffer(b, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_column_generation_covers_demand():
    rng = np.random.default_rng(0)
    for n in (0, 1, 50, 20000):
        demand = np.bincount(rng.integers(0, 128, n), minlength=128)
        solved, units = packing.solve(demand, 128), np.arange(1, 129)
        plan = solved.patterns
        assert (sum((p * t for p, t in plan), np.zeros(128, dtype=int)) == demand).all() and all((p * units).sum() <= 128 for p, _ in plan)
        if n > 1000:
            assert sum(t for _, t in plan) < 1.02 * (demand * units).sum() / 128 + 2 and 0 <= solved.gap < 0.01
        assert solved.bound <= sum(t for _, t in plan)


def test_the_bound_is_below_the_best_packing():
    def fewest(items, room=12):
        best = len(items)

        def go(rest, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if not rest:
                best = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] >= rest[0]:
                    go(rest[1:], bins[:i] + [bins[i] - rest[0]] + bins[i + 1 :])
            go(rest[1:], [*bins, room - rest[0]])

        go(sorted(items, reverse=True), [])
        return best

    rng = random.Random(5)
    for _ in range(25):
        items = [rng.randint(1, 12) for _ in range(rng.randint(1, 9))]
        solved = packing.solve(np.bincount(np.array(items) - 1, minlength=12), 12)
        assert solved.bound <= fewest(items) + 1e-9 <= sum(n for _, n in solved.patterns) + 1e-9


def test_packing_of_rows_from_no_file(spark):
    out = packing.pack_in_order(spark.createDataFrame([(1, "one two"), (2, None), (1, "one two")], "doc_id long, text string"), packing.vocabulary())
    assert sorted((r["doc_id"], r["length"]) for r in out.collect()) == [(1, 3), (1, 3), (2, 1)]


def test_even_blocks_run_between_release_and_deadline(spark, monkeypatch):
    left = {"a": 5, "b": 2, "c": 3, None: 1}
    docs = spark.createDataFrame([(i, s) for s, n in left.items() for i in range(2 * n)], "doc_id long, source string")
    rows = mixing.mix(docs, block=2).collect()
    for r in rows:
        release, deadline = (sum(min(n, j) for n in left.values()) for j in (r["block"], r["block"] + 1))
        assert release <= r["slot"] < deadline
    assert {r["slot"] for r in rows} == set(range(11))
    rounds = mixing._rounds

    def shifted(firsts, tmp, block):
        ranks, release = rounds(firsts, tmp, block)
        return ranks.withColumn(tmp["place"], F.col(tmp["place"]) + 1), release

    monkeypatch.setattr(mixing, "_rounds", shifted)
    with pytest.raises(Exception, match="misses its deadline"):
        mixing.mix(docs, block=2).collect()


def test_pfair_lag_is_less_than_a_block():
    rng = random.Random(1)
    for _ in range(30):
        quota = [rng.randint(1, 30) for _ in range(rng.randint(1, 12))]
        slots, period = mixing.schedule(quota), sum(quota)
        assert sorted(x for s in slots for x in s) == list(range(period))
        for s, q in zip(slots, quota, strict=True):
            done = 0
            for t in range(period + 1):
                assert abs(done * period - q * t) < period
                done += t in s


def test_mix_keeps_all_rows_in_weight(spark):
    rows = [(i, "abc"[0 if i < 600 else 1 if i < 900 else 2], 0) for i in range(1000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, slot int"), {"a": 2.0, "b": 1.0, "c": 1.0}, block=4)
    got = out.orderBy("mix_order").collect()
    assert len({r["doc_id"] for r in got}) == 1000 and out.columns[:3] == ["doc_id", "source", "slot"]
    first = [r["source"] for r in got[:160]]
    assert (first.count("a"), first.count("b"), first.count("c")) == (80, 40, 40)


def earliest_deadline_first(blocks, weights):
    """The source of each slot, one slot at a time, with exact weights; a new phase begins when a source has run out."""
    left, order = dict(blocks), []
    while left:
        total = sum(weights[s] for s in left)
        w, start, done = {s: weights[s] / total for s in left}, len(order), dict.fromkeys(left, 0)
        while True:
            t = len(order) - start
            ready = [s for s in left if left[s] and done[s] / w[s] < t + 1]  # block done + 1 is released at floor(done / w)
            s = min(ready, key=lambda s: (math.ceil((done[s] + 1) / w[s]), -w[s], s))
            order.append(s)
            done[s] += 1
            left[s] -= 1
            assert all(abs(done[x] - w[x] * (t + 1)) < 1 for x in w)
            if not left[s]:
                del left[s]
                break
    return order


def rounds_first(blocks):
    """The source of each slot for equal weights: a round for each block number, larger sources first, then by a hash of the name."""
    key = lambda s: (-blocks[s], ctypes.c_int64(xxhash.xxh64_intdigest(("s" + s if s else "").encode(), 42)).value, s)
    names, order, done = sorted(blocks, key=key), [], dict.fromkeys(blocks, 0)
    for j in range(max(blocks.values(), default=0)):
        start, end = len(order), len(order) + sum(n > j for n in blocks.values())
        for s in names:
            if blocks[s] > j:
                # released at the round's start and done before its end, so that it is less than a block from its share
                assert start <= len(order) < end and done[s] == j
                order.append(s)
                done[s] += 1
    return order


@pytest.mark.parametrize("weights", [{"a": 0.0007, "b": 0.4996, "c": 0.4997}, {"a": 0.123456, "b": 0.876544, "c": 0.1}, {"a": 1 / 3, "b": 2 / 7, "c": 8 / 21}, {}])
def test_mix_is_earliest_deadline_first(spark, weights):
    counts = {"a": 37, "b": 900, "c": 611, "": 150}
    rows = [(i, s or None) for s, n in counts.items() for i in range(n)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), {s: w for s, w in weights.items()} or None, block=2).collect()
    least = min(weights.values(), default=1)
    exact = {s: Fraction(weights.get(s, least)).limit_denominator(10**6) for s in counts}
    own = {s: -(-n // 2) for s, n in counts.items()}
    want = earliest_deadline_first(own, exact) if weights else rounds_first(own)
    slots = {r["slot"]: r["source"] or "" for r in got}
    assert [slots[t] for t in range(len(want))] == want and len(got) == len(rows)
    for s, n in counts.items():
        own = sorted((r["mix_order"], r["block"]) for r in got if (r["source"] or "") == s)
        assert [b for _, b in own] == [k // 2 for k in range(n)]


def test_weights_of_seven_digits():
    weights, blocks = {"a": 0.1234567, "b": 0.8765433}, {"a": 300, "b": 900}
    want = earliest_deadline_first(blocks, {s: mixing.exact(w) for s, w in weights.items()})
    slots = {}
    for name, lo, hi, quota, places, start, period in mixing.plan(blocks, weights):
        for j in range(hi - lo):
            slots[start + j // quota * period + places[j % quota]] = name
    assert [slots[t] for t in range(1200)] == want


def test_ten_thousand_sources(spark):
    rng = random.Random(3)
    counts = {f"host{i}": 1 + min(40, int(rng.paretovariate(1))) for i in range(10_000)} | {"host7": 900}
    rows = [(i, s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    began = time.time()
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), {"host1": 2, "host5": 2}, block=2)
    got = out.select("source", "slot", "mix_order").collect()
    assert time.time() - began < 60
    order = rounds_first({s: -(-n // 2) for s, n in counts.items()})
    slots = {r["slot"]: r["source"] for r in got}
    assert [slots[t] for t in range(len(order))] == order and len({r["mix_order"] for r in got}) == len(rows) == len(got)


def test_weights_without_a_common_period_are_an_error():
    assert mixing.quotas([0.0007, 0.4996, 0.4997]) == [7, 4996, 4997] and mixing.quotas([1 / 3, 0.5]) == [2, 3]
    with pytest.raises(ValueError, match="period"):
        mixing.plan({"a": 1 << 60, "b": 1 << 60}, {"a": 3.141592653589793, "b": 2.718281828459045})
    # a phase that ends early needs its own part of the period only
    assert [r[2] for r in mixing.plan({"a": 5, "b": 5}, {"a": 3.141592653589793, "b": 2.718281828459045})]
    with pytest.raises(ValueError, match="positive"):
        mixing.plan({"a": 5}, {"a": 0})


def test_top_k_reads_until_sure():
    rng = np.random.default_rng(2)
    x, q = rng.integers(-90, 90, (700, 16)), rng.integers(-90, 90, (40, 16))
    ids = np.arange(700)
    for j, (rows, s) in enumerate(topk.nra(ids, x, ids[:40], q, 5)):
        full = (x @ q[j]).astype(float)
        full[j] = -np.inf
        want = np.lexsort((ids, -full))[:5]
        assert rows.tolist() == want.tolist() and s.tolist() == full[want].tolist()


def test_top_k_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [1.0, 1.0]), (5, [1.0, 1.0]), (50, [-1.0, 0.5]), (6, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.op6(df).collect())
    assert got == [(0, 1, 4, 3 * 65536), (0, 2, 5, 3 * 65536), (0, 3, 50, 0), (50, 1, 0, 0), (50, 2, 4, -32768), (50, 3, 5, -32768)]
    assert topk.op6(df.limit(0)).count() == 0


def test_fingerprint_runs_are_joined_and_compacted(spark):
    index = substrings.FingerprintIndex(spark, fanout=2)
    hits = []
    for i in range(4):
        batch = [(i, i, 1), (7, i, 1), (i + 100, i, 2), (i // 2 + 50, i, 1)]
        new = index.add(spark.createDataFrame(batch, "fp long, key long, n int"))
        hits.append(sorted(map(tuple, new.select("fp", "key").collect())))
        assert len(index.runs) <= 2
    assert hits == [[(100, 0)], [(7, 0), (7, 1), (50, 0), (50, 1), (101, 1)], [(7, 0), (7, 1), (7, 2), (102, 2)], [(7, 3), (51, 2), (51, 3), (103, 3)]]
    # another index goes on with the same runs
    again = substrings.FingerprintIndex(spark, index.path, index.runs)
    assert sorted(map(tuple, again.add(spark.createDataFrame([(0, 9, 1), (7, 9, 1), (200, 9, 1)], "fp long, key long, n int")).collect())) == [(0, 0), (0, 9), (7, 3), (7, 9)]
    rows = {r["fp"]: (r["n"], r["key"]) for run in again.runs for r in again.table(run).collect()}
    assert rows[7] == (2, None) and rows[3] == (1, 3) and rows[100] == (2, None)
    again.drop()


def test_batches_one_by_one_equal_the_whole(spark):
    rng = random.Random(9)
    passages = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(60)) for _ in range(4)]
    own = lambda: " ".join(f"u{rng.random()}" for _ in range(rng.randrange(90)))
    rows = [(i, " ".join([own(), *([rng.choice(passages)[rng.randrange(30) :]] if rng.random() < 0.5 else []), own()])) for i in range(60)]
    rows += [(60, rows[3][1]), (60, rows[3][1]), (61, None), (62, ""), (None, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n = Counter(tuple(w[i : i + 35]) for _, t in rows for w in [(t or "").split()] for i in range(len(w) - 34))
    want = []
    for i, t in rows:
        w = (t or "").split()
        gone = {j for k in range(len(w) - 34) if n[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    index, hits = substrings.FingerprintIndex(spark), []
    for part in range(3):
        hits.append(index.add(substrings.fingerprints(docs.filter(F.coalesce("doc_id", F.lit(0)) % 3 == part))))
    both = hits[0].unionByName(hits[1]).unionByName(hits[2])
    for got in (substrings.remove_verified(docs, both), substrings.remove_repeats(docs, n_batches=1), substrings.op5(docs)):
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    x = toxicity.op1(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    rank, ones = x.score.rank(), int(x.toxic.sum())
    auc = (rank[x.toxic == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(x) - ones))
    assert auc > 0.8 and (x.predicted == x.toxic).mean() > 0.85


def test_quality_lm_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    x = lm_scoring.op7(docs, labels).join(labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0), "doc_id").toPandas()
    rank, good = (-x.score).rank(), int(x.quality.sum())
    assert (rank[x.quality == 1].sum() - good * (good + 1) / 2) / (good * (len(x) - good)) > 0.75


@pytest.mark.parametrize("dense", [0, 7, 100])
def test_block_max_index_is_exact(monkeypatch, dense):
    monkeypatch.setattr(toxicity, "DENSE", dense)
    rng = np.random.default_rng(0)
    n, terms = 600, 30
    dense = np.where(rng.random((n, terms)) < 0.08, rng.integers(1, 4, (n, terms)), 0)
    ex, term = np.nonzero(dense)
    entries = (ex, term, dense[ex, term])
    vocab = np.sort(rng.integers(1, 1 << 60, terms).astype(np.uint64))
    index = toxicity.BlockMaxIndex(vocab, rng.integers(1, 50, terms), 1000, np.arange(n), rng.integers(0, 2, n), np.ones(n), entries)
    full = np.zeros((n, terms))
    full[index.example, index.term] = index.weight
    index.unfold()
    docs = [np.unique(rng.integers(0, terms, rng.integers(0, 6))) for _ in range(200)]
    weights = [rng.random(len(d)) for d in docs]
    weights = [w / np.sqrt((w * w).sum()) if len(w) else w for w in weights]
    doc = np.repeat(np.arange(200), [len(d) for d in docs])
    got = index.nearest(doc, np.concatenate(docs), np.concatenate(weights), 200, 20)
    for (near, cosine), at, w in zip(got, docs, weights, strict=True):
        score = np.round(full[:, at] @ w, 12)
        want = [i for i in np.lexsort((index.ids, -score))[:20] if score[i] > 0]
        assert index.ids[near].tolist() == index.ids[want].tolist() and np.allclose(cosine, score[want])


def test_lm_counts_are_exact_in_a_large_vocabulary(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(60000)}" if rng.random() < 0.8 else f"c{rng.randrange(9)}" for _ in range(250)) for _ in range(300)]
    rows = [*enumerate(texts), (0, texts[0]), (None, texts[1]), (900, ""), (901, None)]
    good = set(range(0, 300, 4))

    def model(own):
        tokens = [t.split() for t in own if t]
        return Counter(w for t in tokens for w in t), Counter(p for t in tokens for p in zip([None, *t], t)), len(tokens)

    every, best = model([t for _, t in rows]), model([t for i, t in rows if i in good])
    words = len(every[0])
    assert words > 1 << 15

    def loss(text, m):
        single, pair, starts = m
        total = sum(single.values()) + words
        t = text.split()
        p = [0.6 * pair[a, b] / max(starts if a is None else single[a], 1) + 0.4 * (single[b] + 1) / total for a, b in zip([None, *t], t)]
        return -np.log(p).mean()

    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in lm_scoring.cross_entropy_difference(df, spark.createDataFrame([(i,) for i in good], "doc_id long")).collect()), key=repr)
    want = sorted(((i, 250, loss(t, best), loss(t, every)) if t else (i, 0, None, None) for i, t in rows), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2]
        if w[1]:
            assert abs(g[2] - w[2]) < 1e-9 and abs(g[3] - w[3]) < 1e-9 and abs(g[4] - w[2] + w[3]) < 1e-9
        else:
            assert g[2:] == (None, None, 0.0)


def test_slices_batches_and_ranges_change_no_score(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    good = labels.filter("quality = 1").select("doc_id")
    score = lambda slices, d=docs: {r["doc_id"]: tuple(r)[1:] for r in lm_scoring.cross_entropy_difference(d, good, slices).collect()}
    want = score(1)
    assert len(want) == docs.count() and any(v[3] for v in want.values())
    assert score(5) == want
    monkeypatch.setattr(lm_scoring, "BATCH", 700)
    monkeypatch.setattr(lm_scoring, "RANGE", 900)
    got = score(3, docs.repartition(5))
    assert got.keys() == want.keys() and all(np.allclose(got[i][1:], want[i][1:], atol=1e-11) and got[i][0] == want[i][0] for i in want)


def test_toxicity_uses_every_term(spark):
    rng = random.Random(7)
    common = [f"c{i}" for i in range(12)]
    rows = [(i, " ".join(rng.sample(common, 6) + ([f"slur{i % 40}"] * 2 if i % 2 else []))) for i in range(240)]
    rows += [(1000 + i, f"slur{2 * i + 1} alone{i}") for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(240)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(got) == len(rows) and all(got[1000 + i]["score"] > 0.9 for i in range(20))
    count = {i: {w: t.split().count(w) for w in t.split()} for i, t in rows}
    df = {w: sum(w in c for c in count.values()) for c in count.values() for w in c}
    vec = {i: {w: (1 + np.log(n)) * (np.log((1 + len(rows)) / (1 + df[w])) + 1) for w, n in c.items()} for i, c in count.items()}
    norm = {i: np.sqrt(sum(x * x for x in v.values())) for i, v in vec.items()}
    cos = lambda i, j: sum(x * vec[j].get(w, 0) for w, x in vec[i].items()) / norm[i] / norm[j]
    learned = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5]

    def near(i, k, but=None):
        return sorted(((-round(c, 11), j) for j in learned if j != but and (c := cos(i, j)) > 0))[:k]

    def vote(found):
        return sum(c * c * (j % 2) for c, j in found) / sum(c * c for c, _ in found)

    own = [vote(near(i, toxicity.K, i)) for i in learned]
    knots = toxicity.monotone_fit(np.array(own), np.array([float(i % 2) for i in learned]), np.ones(len(learned)))
    for i, r in got.items():
        found = near(i, toxicity.K)
        assert abs(r["score"] - np.interp(vote(found), *knots)) < 1e-6
        assert [e["doc_id"] for e in r["evidence"]] == [j for _, j in found[:3]]
        for e in r["evidence"]:
            j = e["doc_id"]
            assert abs(e["cosine"] - sum(x * vec[j].get(w, 0) for w, x in vec[i].items()) / norm[i] / norm[j]) < 1e-9


def test_the_example_of_an_id_does_not_depend_on_the_order_of_rows(spark):
    rows = [(1, "alpha alpha one"), (1, "beta two"), (1, "gamma gamma three"), (2, "delta"), (2, "epsilon"), *((i, f"word{i} common") for i in range(3, 30))]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, toxic int")
    fitted = []
    for order in (rows, rows[::-1]):
        model = toxicity.fit(spark.createDataFrame(order, "doc_id long, text string").coalesce(1), labels)
        fitted.append((model.index.vocab.tolist(), model.index.weight.tolist(), model.knots[1].tolist()))
    assert fitted[0] == fitted[1]


def test_one_row_of_a_kept_document_stays(spark):
    words = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    rows = [(1, words[0])] * 3 + [(2, words[0])] * 2 + [(3, words[1])] + [(None, words[2])] * 2
    left = minhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert left.columns == ["doc_id", "text"]
    assert sorted((tuple(r) for r in left.collect()), key=repr) == sorted([(1, words[0]), (3, words[1]), (None, words[2]), (None, words[2])], key=repr)


def test_whole_private_keys_are_redacted(spark):
    body = "\n".join("MIIEvQIBADAN+/" + "Ab9" * 16 for _ in range(6)) + "\nq8Zz=="
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    rows = [
        (1, f"before\n{head}\n{body}\n{end}\nafter it", "before\n[private_key]\nafter it"),
        (2, f"x {head}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n{body}\n{end} y", "x [private_key] y"),
        (3, f'"{head}\\n' + body.replace("\n", "\\n") + f'\\n{end}\\n"', '"[private_key]\\n"'),
        (4, f"{head}\n{body}", "[private_key]"),
        (5, f"{head} of a key", "[private_key] of a key"),
    ]
    out = secrets.redact(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {i: t for i, _, t in rows}
