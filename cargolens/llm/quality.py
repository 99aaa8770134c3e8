"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements the rules
read and one integer whose bit *i* says that rule *i* failed. Policies are versioned masks
over these bits: applying another policy, or asking what a rule costs, reads only the
ledger and never the text.

Everything here is DataFrame functions: the ledger is a map-only pass, an ablation is one
aggregate over the bits with a constant number of output rows.

Defined results: null text counts as empty; a document without words fails ``few_words``;
repeated rows are judged one by one; columns of the input that clash with a ledger column
are replaced by it only in the ledger struct, never in the document itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .exprs import count_chars, free_name, let, words


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements, true if a document breaks the rule."""

    name: str
    fails: str


#: Bit i is rule i. Rules are only ever appended, so that stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("shouting", "2 * n_upper > word_chars"),
    Rule("exclamations", "2 * n_exclaim > n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("digits", "3 * n_digits > word_chars"),
    Rule("too_many_words", "n_words > 1000000"),
    Rule("ellipsis_lines", "10 * n_ellipsis_lines > 3 * n_lines"),
    Rule("bullet_lines", "10 * n_bullet_lines > 9 * n_lines"),
    Rule("braces", "10 * n_braces > n_words"),
)


def mask(*names: str) -> int:
    at = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << at[n] for n in set(names))


BASE = mask("few_words", "repeated_trigrams")
#: Policy versions: the bits that reject a document.
POLICIES = {
    "v1": BASE,
    "v2": BASE | mask("symbols", "duplicate_lines"),
    "v3": mask(*(r.name for r in RULES)),
}
PRODUCTION = "v3"


def _repeat_words(w: Column) -> Column:
    """Words inside a 3-word window whose word sequence stands in the text twice or more.

    Window hashes find the candidates: a text whose hashes all differ has no repeat, and
    most work ends there. The windows whose hash recurs are then compared as strings, so
    that a hash collision cannot change the count.
    """

    def neighbours(ordered: Column) -> Column:
        """Positions of entries (k, i) whose k equals that of the entry before or after."""
        near = F.zip_with(
            ordered,
            F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))),
            lambda x, y: F.when(x["k"] == y["k"], F.array(x["i"], y["i"])),
        )
        return F.array_distinct(F.flatten(F.filter(near, lambda p: p.isNotNull())))

    def heavy(hashes: Column) -> Column:
        keyed = F.transform(hashes, lambda h, i: F.struct(h.alias("k"), i.alias("i")))
        found = let(F.sort_array(keyed), neighbours)
        text = lambda p: F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2))
        exact = F.transform(found, lambda p: F.struct(text(p).alias("k"), p.alias("i")))
        starts = let(F.sort_array(exact), neighbours)
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))

    n = F.size(w)
    rest = lambda k: F.slice(w, k, F.greatest(n, F.lit(1)))
    pairs = F.zip_with(w, rest(2), lambda a, b: F.xxhash64(a, b))
    triples = F.slice(F.zip_with(pairs, rest(3), lambda h, c: F.xxhash64(h, c)), 1, F.greatest(n - 2, F.lit(0)))
    return F.when(n < 4, F.lit(0)).otherwise(
        let(triples, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(heavy(h)))
    )


def measurements(text: Column) -> Column:
    """One struct of counts (longs) over a whole text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lng = lambda c, name: c.cast("long").alias(name)
    line_part = let(
        lines,
        lambda a: F.struct(
            lng(F.size(a), "n_lines"),
            lng(F.size(a) - F.size(F.array_distinct(a)), "n_dup_lines"),
            lng(F.size(F.filter(a, lambda x: x.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*$"))), "n_ellipsis_lines"),
            lng(F.size(F.filter(a, lambda x: x.rlike(r"^[\x20\x09]*[-*•][\x20\x09]"))), "n_bullet_lines"),
        ),
    )
    word_part = let(
        words(text),
        lambda w: F.struct(
            lng(F.size(w), "n_words"),
            lng(F.length(F.array_join(w, "")), "word_chars"),
            lng(_repeat_words(w), "n_repeat_words"),
        ),
    )
    joined = F.struct(word_part.alias("w"), line_part.alias("l"))
    return let(
        joined,
        lambda m: F.struct(
            m["w"]["n_words"].alias("n_words"),
            m["w"]["word_chars"].alias("word_chars"),
            count_chars(t, r"[#*$%&|<>]+").alias("n_symbols"),
            m["l"]["n_dup_lines"].alias("n_dup_lines"),
            m["w"]["n_repeat_words"].alias("n_repeat_words"),
            m["l"]["n_lines"].alias("n_lines"),
            m["l"]["n_ellipsis_lines"].alias("n_ellipsis_lines"),
            m["l"]["n_bullet_lines"].alias("n_bullet_lines"),
            count_chars(t, "[A-Z]+").alias("n_upper"),
            count_chars(t, "!+").alias("n_exclaim"),
            count_chars(t, "[0-9]+").alias("n_digits"),
            count_chars(t, "[{}]+").alias("n_braces"),
        ),
    )


MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ellipsis_lines",
    "n_bullet_lines", "n_upper", "n_exclaim", "n_digits", "n_braces",
)


def evaluate_rules(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ledger: the kept columns, the measurements and ``fail_bits``.

    A kept column that has a measurement's name is renamed ``<name>_1``.
    """
    kept = docs.columns if keep is None else keep
    names = {c: free_name([*MEASURES, "fail_bits"], c) for c in kept}
    m = free_name(kept, "_m")
    out = docs.select(*(F.col(f"`{c}`") for c in kept), measurements(F.col(f"`{text_col}`")).alias(m))
    out = out.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), *(F.col(f"`{m}`.{x}").alias(x) for x in MEASURES))
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return out.withColumn("fail_bits", bits)


def passes(policy: str = PRODUCTION, bits: Column | None = None) -> Column:
    """True if none of the policy's rules failed."""
    b = F.col("fail_bits") if bits is None else bits
    return b.bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablations(ledger: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it rejects.

    One aggregate over the stored bits; its result has one row per rule.
    """
    on = POLICIES[policy]
    bits = F.col("fail_bits").bitwiseAND(F.lit(on).cast("long"))
    rules = [(i, r.name) for i, r in enumerate(RULES) if on >> i & 1]
    sums = []
    for i, _ in rules:
        one = F.lit(1 << i).cast("long")
        sums += [F.count_if(bits.bitwiseAND(one) != 0).alias(f"f{i}"), F.count_if(bits == one).alias(f"o{i}")]
    row = ledger.agg(*sums)
    return row.select(
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(n).alias("rule"), F.col(f"f{i}").alias("n_failed"), F.col(f"o{i}").alias("n_only_this"))
                    for i, n in rules
                )
            )
        )
    )


def filter_docs(docs: DataFrame, policy: str = PRODUCTION, text_col: str = "text") -> DataFrame:
    """The documents, with their own columns only, that no rule of the policy rejects."""
    led = free_name(docs.columns, "_ledger")
    with_bits = docs.withColumn(led, measurements(F.col(f"`{text_col}`")))
    fails = [r.fails for i, r in enumerate(RULES) if POLICIES[policy] >> i & 1]
    # measurements are addressed inside their struct, so that no column of the input can take their place
    inside = lambda sql: re.sub(r"\b(" + "|".join(MEASURES) + r")\b", lambda m: f"`{led}`.`{m[1]}`", sql)
    bad = F.lit(False)
    for sql in fails:
        bad = bad | F.expr(inside(sql))
    return with_bits.filter(~bad).drop(led)


def op4(docs: DataFrame) -> DataFrame:
    """The digest rows of the query: measurements, base verdict and production verdict."""
    led = evaluate_rules(docs, keep=["doc_id", "text"]).drop("text")
    return led.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~passes("v1")).alias("base_failed"),
        passes(PRODUCTION).alias("kept"),
        "fail_bits",
    )


OP4_SQL = (
    r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), a AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM d
), win AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM a)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c >= 2
), cov AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid
), m AS (
  SELECT a.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(ln) AS n_lines,
         len(list_filter(ln, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines,
         len(list_filter(ln, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•][\x20\x09]'))) AS n_bullet_lines,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
         length(t) - length(replace(t, '!', '')) AS n_exclaim,
         length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS n_digits,
         length(t) - length(regexp_replace(t, '[{}]', '', 'g')) AS n_braces
  FROM a LEFT JOIN cov ON a.rid = cov.rid
), b AS (
  SELECT *, """
    + " + ".join(f"(CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END)" for i, r in enumerate(RULES))
    + f""" AS bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (bits & {POLICIES["v1"]}) <> 0 AS base_failed, (bits & {POLICIES[PRODUCTION]}) = 0 AS kept,
       CAST(bits AS BIGINT) AS fail_bits
FROM b
"""
)
