r"""Secret scan with one combined deterministic automaton.

All rules are compiled into one minimal byte automaton (see ``automaton``). A text is read
once, byte by byte, whatever the number of rules; only where the automaton says that a rule
has a match ending are the rule's own two small automata run, backwards to the leftmost
start and forwards to the longest end. Matches of a rule are leftmost, as long as possible
and do not overlap; those whose value is too short are dropped after matching.

The pass is map-only. A batch's texts are read one after the other, so that memory is one
Arrow batch plus the transition arrays.

Defined results: null text is empty and has no spans; repeated rows are scanned one by one;
positions are code points of the text, end exclusive; rules never match across a line break
unless their class holds one (none does); a secret of several kinds has a span for each.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .automaton import any_case, compile_dfa, earliest, longest, mirrored, parse


@dataclass(frozen=True)
class Rule:
    """``least``: code points that the whole match needs, or its value if ``value`` is set.

    The value is what follows the first ``:`` or ``=``, blanks and an optional quote.
    """

    kind: str
    pattern: str
    least: int = 0
    value: bool = False
    fold: bool = False


#: In the order of the contract: the three base kinds, then those that the library adds.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
    Rule("session_access", r"ASIA[A-Z0-9]+", 20),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("git_token", r"(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]+", 40),
    Rule("git_pat", r"(github_pat_|glpat-)[A-Za-z0-9_-]+", 26),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("payment_key", r"(sk|rk|pk)_(live|test)_[A-Za-z0-9]+", 24),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("package_token", r"(npm_|pypi-|hf_)[A-Za-z0-9_-]+", 30),
    Rule("mail_key", r"SG\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9+/_.=-]+", 27, False, True),
)
BASE = ("assign", "access", "hex")
#: What follows the header of a private key: its own headers, base64 lines (line breaks may be escaped) and the END line.
KEY_BODY = re.compile(r"(?:[ \t]*\r?\n(?:Proc-Type|DEK-Info): [^\r\n]*)*(?:[A-Za-z0-9+/=]|[ \t]*(?:[\r\n]|\\[rn])[ \t]*)*(?:-----END [A-Z ]*PRIVATE KEY-----)?")


class Scanner:
    """All automata of a rule table. Compiled once by the driver, then sent to the tasks."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = [any_case(parse(r.pattern)) if r.fold else parse(r.pattern) for r in rules]
        self.all = compile_dfa([earliest(t) for t in trees], search=True)
        self.forward = [compile_dfa([t], search=False) for t in trees]
        self.backward = [compile_dfa([mirrored(t)], search=False) for t in trees]

    def _long_enough(self, rule: Rule, match: bytes) -> bool:
        if not rule.value:
            return len(match) >= rule.least
        at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
        rest = match[at + 1 :].lstrip(b" ")
        return len(rest) - (rest[:1] in (b'"', b"'")) >= rule.least

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, by start, then in rule order."""
        dfa = self.all
        step, accepting, state, n_cls = dfa.step, dfa.accepting, dfa.start, dfa.classes
        free = [0] * len(self.rules)
        out = []
        for i, c in enumerate(data.translate(dfa.class_of)):
            state = step[state + c]
            if state >= accepting:
                for r in dfa.rules[(state - accepting) // n_cls]:
                    if i < free[r]:
                        continue
                    back = longest(self.backward[r], data, range(i, free[r] - 1, -1))
                    if back < 1:  # it began inside the rule's last match
                        continue
                    start = i + 1 - back
                    end = start + longest(self.forward[r], data, range(start, len(data)))
                    free[r] = end
                    if self._long_enough(self.rules[r], data[start:end]):
                        out.append((start, end, r))
        return sorted(out, key=lambda x: (x[0], x[2]))

    def text_spans(self, text: str) -> list[dict]:
        """The spans as kinds and code points."""
        data = text.encode()
        found = self.spans(data)
        if not found:
            return []
        chars: dict[int, int] = {}
        at = n = 0
        plain = len(text) == len(data)
        for b in sorted({x for s, e, _ in found for x in (s, e)}):
            n = b if plain else n + len(data[at:b].decode())
            at = b
            chars[b] = n
        return [{"kind": self.rules[r].kind, "start": chars[s], "end": chars[e]} for s, e, r in found]


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text column, by start, then in rule order."""
    scanner = Scanner(rules)

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        return pa.array([scanner.text_spans(t.as_py() or "") for t in texts], type=_ARROW)

    return scan(text)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with every secret replaced by ``[kind]``; overlapping spans are one.

    A private key goes from its header to its END line, or as far as base64 lines go.

    Columns and their order stay. A character count column, if there is one, is brought up
    to date where the text changed. Null text stays null.
    """
    scanner = Scanner(rules)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            text = t.as_py()
            found = scanner.text_spans(text) if text else []
            parts, at = [], 0
            for x in found:
                if x["start"] >= at:
                    parts += [text[at : x["start"]], f"[{x['kind']}]"]
                end = KEY_BODY.match(text, x["end"]).end() if x["kind"] == "private_key" else x["end"]
                at = max(at, end)
            out.append("".join([*parts, text[at:]]) if found else text)
        return pa.array(out, type=pa.string())

    new = clean(F.col(f"`{text_col}`"))
    if chars_col not in docs.columns:
        return docs.withColumn(text_col, new)
    tmp = "_clean"
    while tmp in docs.columns:
        tmp += "_"
    d = docs.withColumn(tmp, new)
    same = F.col(f"`{tmp}`").eqNullSafe(F.col(f"`{text_col}`"))
    count = F.length(F.col(f"`{tmp}`")).cast(docs.schema[chars_col].dataType)
    put = {text_col: F.col(f"`{tmp}`"), chars_col: F.when(same, F.col(f"`{chars_col}`")).otherwise(count)}
    return d.select(*(put[c].alias(c) if c in put else F.col(f"`{c}`") for c in docs.columns))


def _joined(spans: Column) -> Column:
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, text), ",")


def op8(docs: DataFrame) -> DataFrame:
    """The digest rows of the query."""
    d = docs.select("doc_id", find_spans(F.col("text")).alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return d.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(F.filter("found", lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )


def _rule_sql(number: int, rule: Rule) -> str:
    pat = rule.pattern
    if rule.fold:  # letters inside classes are there in both cases already
        for word in ("password", "passwd", "secret", "token", "api", "key", "bearer"):
            pat = pat.replace(word, "".join(f"[{c.upper()}{c}]" for c in word))
    pat = pat.replace("'", "''")
    need = f"length(m) >= {rule.least}"
    if rule.value:
        need = f"length(regexp_extract(m, '[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= {rule.least}"
    return f"""
  SELECT rid, {number} AS k, '{rule.kind}' AS kind, m, s, s + length(m) AS e FROM (
    SELECT rid, ms[i] AS m,
           list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT rid, ms, string_split_regex(t, '{pat}') AS ps, unnest(range(1, len(ms) + 1)) AS i
          FROM (SELECT rid, t, regexp_extract_all(t, '{pat}') AS ms FROM d))
  ) WHERE {need}"""


OP8_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), x AS ("
    + " UNION ALL ".join(_rule_sql(i, r) for i, r in enumerate(RULES))
    + """), g AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) FILTER (k < 3) AS base,
         string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) AS spans
  FROM x GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.rid = g.rid"""
)
