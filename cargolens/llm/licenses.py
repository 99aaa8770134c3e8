r"""License detection with ordered signature rules.

A text is reduced to its words (ASCII letters in lower case, digits, and anything outside
ASCII), each with a space of its own on both sides. Hundreds of signature rules, built
from a table of licences and a few phrase templates plus hand-written text signatures, are
matched against that form. A rule is tried only if its keyword stands in the text, and no
rule is tried on texts without one of a dozen gate words. Detections are then resolved: a
detection is suppressed if its interval lies inside that of a detection of the same or a
higher priority.

Only DataFrame functions are used: one map-only pass, no shuffle, no Python. The rules are
a literal array in the plan, bounded by the rule table.

Defined results: null and empty texts have no words, no detections and score 0; equal
intervals of equal priority keep the first rule in table order; repeated rows are scanned
one by one; a column of the input named like a result column is not read.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, functions as F

from .exprs import let

SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Licence label, keyword, name without the word "license", full name. Regular expressions over
# words joined by one blank.
LICENSES = (
    ("apache-2.0", "apache", r"apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?2(?: 0)?", r"apache(?: software)? licen[sc]e(?: version)? 2(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: licen[sc]e)?(?: version)? 1 1", r"apache(?: software)? licen[sc]e(?: version)? 1 1"),
    ("apache", "apache", r"apache(?: software foundation)?", r"apache(?: software)? licen[sc]e"),
    ("mit", "mit", r"(?:expat )?mit(?: x11)?", r"mit(?: x11| expat)? licen[sc]e"),
    ("mit-0", "mit", r"mit 0", r"mit no attribution(?: licen[sc]e)?"),
    ("x11", "x11", r"x11", r"x11 licen[sc]e"),
    ("isc", "isc", r"isc", r"isc licen[sc]e"),
    ("zlib", "zlib", r"zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("libpng", "libpng", r"libpng", r"libpng licen[sc]e"),
    ("bsd-4-clause", "bsd", r"bsd 4 clause", r"(?:four clause bsd|bsd 4 clause|original bsd) licen[sc]e"),
    ("bsd-3-clause", "bsd", r"(?:new )?bsd 3 clause", r"(?:three clause bsd|bsd 3 clause|3 clause bsd|new bsd|modified bsd) licen[sc]e"),
    ("bsd-2-clause", "bsd", r"bsd 2 clause", r"(?:two clause bsd|bsd 2 clause|2 clause bsd|simplified bsd|freebsd) licen[sc]e"),
    ("0bsd", "0bsd", r"0bsd", r"0bsd licen[sc]e"),
    ("bsd", "bsd", r"bsd", r"bsd(?: style)? licen[sc]e"),
    ("gpl-1.0", "gnu", r"gnu gpl(?: version| v)? ?1", r"gnu general public licen[sc]e(?: version)? 1(?: 0)?"),
    ("gpl-2.0", "gnu", r"gnu gpl(?: version| v)? ?2(?: 0)?", r"gnu general public licen[sc]e(?: version)? 2(?: 0)?"),
    ("gpl-3.0", "gnu", r"gnu gpl(?: version| v)? ?3(?: 0)?", r"gnu general public licen[sc]e(?: version)? 3(?: 0)?"),
    ("gpl", "gnu", r"gnu gpl", r"gnu general public licen[sc]e"),
    ("lgpl-2.0", "general", r"gnu lgpl(?: version| v)? ?2(?: 0)?", r"gnu (?:library|lesser) general public licen[sc]e(?: version)? 2(?: 0)?"),
    ("lgpl-2.1", "lesser", r"gnu lgpl(?: version| v)? ?2 1", r"gnu lesser general public licen[sc]e(?: version)? 2 1"),
    ("lgpl-3.0", "lesser", r"gnu lgpl(?: version| v)? ?3(?: 0)?", r"gnu lesser general public licen[sc]e(?: version)? 3(?: 0)?"),
    ("lgpl", "lesser", r"gnu lgpl", r"(?:gnu )?lesser general public licen[sc]e"),
    ("agpl-3.0", "affero", r"gnu agpl(?: version| v)? ?3(?: 0)?", r"gnu affero general public licen[sc]e(?: version)? 3(?: 0)?"),
    ("agpl", "affero", r"gnu agpl", r"(?:gnu )?affero general public licen[sc]e"),
    ("gfdl-1.3", "documentation", r"gnu fdl 1 3", r"gnu free documentation licen[sc]e(?: version)? 1 3"),
    ("gfdl", "documentation", r"gnu fdl", r"(?:gnu )?free documentation licen[sc]e"),
    ("mpl-1.1", "mozilla", r"mpl(?: version| v)? ?1 1", r"mozilla public licen[sc]e(?: version)? 1 1"),
    ("mpl-2.0", "mozilla", r"mpl(?: version| v)? ?2(?: 0)?", r"mozilla public licen[sc]e(?: version)? 2(?: 0)?"),
    ("mpl", "mozilla", r"mpl", r"mozilla public licen[sc]e"),
    ("epl-1.0", "eclipse", r"epl(?: version| v)? ?1(?: 0)?", r"eclipse public licen[sc]e(?: version)? 1(?: 0)?"),
    ("epl-2.0", "eclipse", r"epl(?: version| v)? ?2(?: 0)?", r"eclipse public licen[sc]e(?: version)? 2(?: 0)?"),
    ("cddl-1.0", "cddl", r"cddl(?: version| v)? ?1(?: 0)?", r"cddl licen[sc]e"),
    ("cpl-1.0", "common", r"cpl 1 0", r"common public licen[sc]e(?: version)? 1(?: 0)?"),
    ("eupl-1.2", "european", r"eupl(?: version| v)? ?1 2", r"european union public licen[sc]e(?: version)? 1 2"),
    ("eupl", "european", r"eupl", r"european union public licen[sc]e"),
    ("artistic-1.0", "artistic", r"artistic 1 0", r"artistic licen[sc]e(?: version)? 1(?: 0)?"),
    ("artistic-2.0", "artistic", r"artistic 2 0", r"artistic licen[sc]e(?: version)? 2(?: 0)?"),
    ("artistic", "artistic", r"artistic", r"artistic licen[sc]e"),
    ("bsl-1.0", "boost", r"boost 1 0", r"boost software licen[sc]e(?: version)?(?: 1(?: 0)?)?"),
    ("busl-1.1", "business", r"busl 1 1", r"business source licen[sc]e(?: version)?(?: 1 1)?"),
    ("unlicense", "unlicense", r"unlicense", r"the unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl", r"wtfpl licen[sc]e"),
    ("python-2.0", "python", r"psf(?: 2)?", r"python software foundation licen[sc]e(?: version)?(?: 2)?"),
    ("php-3.01", "php", r"php 3 01", r"php licen[sc]e(?: version)?(?: 3 01)?"),
    ("ruby", "ruby", r"ruby", r"ruby licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql", r"postgresql licen[sc]e"),
    ("openssl", "openssl", r"openssl", r"openssl licen[sc]e"),
    ("ofl-1.1", "font", r"sil ofl(?: 1 1)?", r"(?:sil )?open font licen[sc]e(?: version)?(?: 1 1)?"),
    ("odbl-1.0", "database", r"odbl(?: 1 0)?", r"open database licen[sc]e(?: version)?(?: 1 0)?"),
    ("odc-by-1.0", "data", r"odc by(?: 1 0)?", r"open data commons attribution licen[sc]e"),
    ("cecill-2.1", "cecill", r"cecill(?: 2 1)?", r"cecill(?: free software)? licen[sc]e"),
    ("ms-pl", "microsoft", r"ms pl", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft", r"ms rl", r"microsoft reciprocal licen[sc]e"),
    ("upl-1.0", "universal", r"upl 1 0", r"universal permissive licen[sc]e(?: version)?(?: 1 0)?"),
    ("ncsa", "ncsa", r"ncsa", r"(?:university of illinois )?ncsa open source licen[sc]e"),
    ("afl-3.0", "academic", r"afl 3 0", r"academic free licen[sc]e(?: version)?(?: 3 0)?"),
    ("osl-3.0", "open", r"osl 3 0", r"open software licen[sc]e(?: version)?(?: 3 0)?"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-1.0", "creative", r"cc by 1 0", r"creative commons attribution(?: licen[sc]e)? 1 0"),
    ("cc-by-2.0", "creative", r"cc by 2 0", r"creative commons attribution(?: licen[sc]e)? 2 0"),
    ("cc-by-3.0", "creative", r"cc by 3 0", r"creative commons attribution(?: licen[sc]e)? 3 0"),
    ("cc-by-4.0", "creative", r"cc by 4 0", r"creative commons attribution(?: licen[sc]e)? 4 0"),
    ("cc-by-sa-2.0", "creative", r"cc by sa 2 0", r"creative commons attribution share ?alike(?: licen[sc]e)? 2 0"),
    ("cc-by-sa-3.0", "creative", r"cc by sa 3 0", r"creative commons attribution share ?alike(?: licen[sc]e)? 3 0"),
    ("cc-by-sa-4.0", "creative", r"cc by sa 4 0", r"creative commons attribution share ?alike(?: licen[sc]e)? 4 0"),
    ("cc-by-sa", "creative", r"cc by sa", r"creative commons attribution share ?alike"),
    ("cc-by-nc-2.0", "creative", r"cc by nc 2 0", r"creative commons attribution non ?commercial(?: licen[sc]e)? 2 0"),
    ("cc-by-nc-3.0", "creative", r"cc by nc 3 0", r"creative commons attribution non ?commercial(?: licen[sc]e)? 3 0"),
    ("cc-by-nc-4.0", "creative", r"cc by nc 4 0", r"creative commons attribution non ?commercial(?: licen[sc]e)? 4 0"),
    ("cc-by-nc", "creative", r"cc by nc", r"creative commons attribution non ?commercial"),
    ("cc-by-nd-4.0", "creative", r"cc by nd 4 0", r"creative commons attribution no ?deriv(?:ative)?s(?: licen[sc]e)? 4 0"),
    ("cc-by-nd", "creative", r"cc by nd", r"creative commons attribution no ?deriv(?:ative)?s"),
    ("cc-by-nc-sa-4.0", "creative", r"cc by nc sa 4 0", r"creative commons attribution non ?commercial share ?alike(?: licen[sc]e)? 4 0"),
    ("cc-by-nc-sa", "creative", r"cc by nc sa", r"creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd-4.0", "creative", r"cc by nc nd 4 0", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: licen[sc]e)? 4 0"),
    ("cc-by-nc-nd", "creative", r"cc by nc nd", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s"),
)

# Phrases of licence texts and notices: label, keyword, priority, score, pattern.
TEXTS = (
    ("mit", "granted", 1, 0.95, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "granted", 1, 0.95, r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", 1, 0.9, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("zlib", "provided", 1, 0.9, r"this software is provided as is without any express or implied warranty"),
    ("wtfpl", "what", 1, 0.9, r"do what the fuck you want to public licen[sc]e"),
    ("unlicense", "unencumbered", 1, 0.95, r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "domain", 2, 0.7, r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "domain", 3, 0.5, r"public domain"),
    ("no-warranty", "warranty", 3, 0.4, r"without warranty of any kind"),
    ("no-warranty", "warranty", 3, 0.4, r"without any warranty"),
    ("copyright", "copyright", 3, 0.4, r"copyright(?: c)? (?:19|20)[0-9][0-9]"),
    ("proprietary", "proprietary", 2, 0.8, r"proprietary and confidential"),
    ("proprietary", "permission", 2, 0.7, r"may not be (?:reproduced|copied|distributed) without (?:prior |written |express )*permission"),
    ("proprietary", "redistribute", 2, 0.7, r"do not redistribute"),
    ("non-commercial", "commercial", 3, 0.5, r"for non ?commercial use only"),
    ("fair-use", "fair", 3, 0.3, r"fair use"),
    ("copyleft", "copyleft", 3, 0.4, r"copyleft"),
    ("all-rights-reserved", "reserved", 3, 0.6, r"all rights reserved"),
    ("some-rights-reserved", "reserved", 3, 0.5, r"some rights reserved"),
    ("gpl", "published", 2, 0.8, r"gnu general public licen[sc]e as published by the free software foundation"),
    ("lgpl", "lesser", 2, 0.8, r"gnu lesser general public licen[sc]e as published by the free software foundation"),
    ("agpl", "affero", 2, 0.8, r"gnu affero general public licen[sc]e as published by the free software foundation"),
    ("cc", "commons", 3, 0.5, r"creative commons"),
)

#: Every match of every rule contains one of these.
GATES = (
    "licen", "copyright", "rights  reserved", " cc ", "creative", "domain", "warrant", "redistribut", "granted",
    "proprietary", "permission", "commercial", "fair  use", "copyleft", "cc0", "unlicense", "attribution",
)

BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def spaced(pattern: str) -> str:
    """A pattern over words joined by one blank, for words with a blank of their own on both sides."""
    return " " + pattern.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?") + " "


def first_word(pattern: str) -> str:
    return re.match("[a-z0-9]*", re.sub(r"^(?:\(\?:[^()]*\)\?)+", "", pattern))[0]


def build_rules() -> list[tuple[str, str, int, float, str]]:
    """(label, keyword, priority, score, pattern) in order; priority 0 is the highest.

    Each match of a rule contains its keyword.
    """
    lead = r"(?: the)?(?: terms of(?: the)?)? "
    out = []
    for label, kw, short, full in LICENSES:
        spdx = label.replace(".", " ").replace("-", " ")
        out.append((label, "spdx", 0, 1.0, rf"spdx licen[sc]e identifier {spdx}(?: only| or later)?"))
        out.append((label, first_word(short), 1, 0.95, rf"licen[sc]ed under{lead}{short}"))
        out.append((label, kw, 1, 0.95, rf"(?:licen[sc]ed|released|distributed|published|available) under{lead}{full}"))
        out.append((label, kw, 2, 0.8, full))
    return [(*r[:4], spaced(r[4])) for r in (*out, *TEXTS)]


RULES = build_rules()
PRIORITIES = 4

SPAN = "struct<start:int,end:int,priority:int,rule:int,label:string,score:double>"


def word_form(words: Column) -> Column:
    """Each word with a blank of its own on both sides."""
    return F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))


def places(text: Column, pattern: Column) -> Column:
    """Character intervals (start, end) of all matches, leftmost first, without overlaps.

    The pieces between the matches and the matches themselves give the positions by a
    running sum of their lengths.
    """
    between = F.call_function("split", text, pattern, F.lit(-1))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    zipped = F.slice(
        F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("skip"), F.length(m).alias("len"))),
        F.lit(1),
        F.size(found),
    )
    step = lambda acc, x: F.struct(
        (acc["at"] + x["skip"] + x["len"]).alias("at"),
        F.concat(
            acc["out"],
            F.array(F.struct((acc["at"] + x["skip"]).alias("start"), (acc["at"] + x["skip"] + x["len"]).alias("end"))),
        ).alias("out"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return F.aggregate(zipped, zero, step, lambda acc: acc["out"])


def detections(form: Column) -> Column:
    """All matches of all rules whose keyword the text holds, by start, then longest, then priority."""
    by_kw: dict[str, list[int]] = {}
    for i, r in enumerate(RULES):
        by_kw.setdefault(r[1], []).append(i)
    table = F.array(
        *(
            F.struct(
                F.lit(kw).alias("kw"),
                F.array(
                    *(
                        F.struct(
                            F.lit(i).alias("rule"),
                            F.lit(RULES[i][0]).alias("label"),
                            F.lit(RULES[i][2]).alias("priority"),
                            F.lit(RULES[i][3]).alias("score"),
                            F.lit(RULES[i][4]).alias("pattern"),
                        )
                        for i in ids
                    )
                ).alias("rules"),
            )
            for kw, ids in by_kw.items()
        )
    )
    live = F.flatten(F.transform(F.filter(table, lambda g: F.contains(form, g["kw"])), lambda g: g["rules"]))
    spans = F.flatten(
        F.transform(
            live,
            lambda r: F.transform(
                places(form, r["pattern"]),
                lambda p: F.struct(
                    p["start"].alias("start"),
                    (-p["end"]).alias("minus_end"),
                    r["priority"].alias("priority"),
                    r["rule"].alias("rule"),
                    r["label"].alias("label"),
                    r["score"].alias("score"),
                ),
            ),
        )
    )
    return F.transform(
        F.sort_array(spans),
        lambda x: F.struct(
            x["start"].alias("start"), (-x["minus_end"]).alias("end"), x["priority"], x["rule"], x["label"], x["score"]
        ),
    )


def resolve(spans: Column) -> Column:
    """Drops each span inside an earlier one of the same or a higher priority.

    One sweep over the sorted spans keeps the furthest end per priority, so that the work
    is linear in the number of spans.
    """
    ends = [f"e{p}" for p in range(PRIORITIES)]

    def step(acc: Column, x: Column) -> Column:
        covered = F.lit(False)
        for p, e in enumerate(ends):
            covered = covered | ((x["priority"] >= p) & (acc[e] >= x["end"]))
        grown = [
            F.when(x["priority"] == p, F.greatest(acc[e], x["end"])).otherwise(acc[e]).alias(e) for p, e in enumerate(ends)
        ]
        return F.struct(*grown, F.when(covered, acc["out"]).otherwise(F.concat(acc["out"], F.array(x))).alias("out"))

    zero = F.struct(*(F.lit(-1).alias(e) for e in ends), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.aggregate(spans, zero, step, lambda acc: acc["out"])


def _in_words(form: Column, spans: Column) -> Column:
    """The spans counted in words, end exclusive: there are two blanks for each word before."""
    blanks = lambda upto: F.length(F.left(form, upto)) - F.length(F.replace(F.left(form, upto), F.lit(" ")))
    at = lambda upto: (blanks(upto) / 2).cast("long")
    return F.transform(
        spans,
        lambda x: F.struct(
            at(x["start"]).alias("start"), at(x["end"]).alias("end"), x["priority"], x["rule"], x["label"], x["score"]
        ),
    )


def scan(text: Column) -> Column:
    """struct(n_words, base, spans): base places as (start, label) and resolved detections, in words."""
    whole = F.coalesce(text, F.lit(""))
    # only A-Z are folded. Two other capitals turn into ASCII letters; all others are inside words that no rule
    # names, so that their case changes nothing, and ``lower`` is far faster than ``translate``
    odd = F.contains(whole, F.lit("\u212a")) | F.contains(whole, F.lit("\u0130"))
    low = F.when(odd, F.translate(whole, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(whole))
    words = F.array_remove(F.split(low, SEP, -1), "")
    no_base = F.array().cast("array<struct<start:bigint,label:string>>")
    no_spans = F.array().cast(f"array<{SPAN.replace('start:int,end:int', 'start:bigint,end:bigint')}>")

    def labelled(spans: Column, label: str) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(label).alias("label")))

    def base(form: Column) -> Column:
        parts = []
        for phrase, label in BASE:
            pat = spaced(phrase)
            found = _in_words(
                form,
                F.transform(
                    places(form, F.lit(pat)),
                    lambda p: F.struct(
                        p["start"].alias("start"), p["end"].alias("end"), F.lit(0).alias("priority"), F.lit(0).alias("rule"),
                        F.lit("").alias("label"), F.lit(1.0).alias("score"),
                    ),
                ),
            )
            parts.append(
                F.when(
                    F.contains(form, F.lit(pat)),
                    labelled(found, label),
                ).otherwise(no_base)
            )
        return F.concat(*parts)

    def scanned(form: Column) -> Column:
        gate = F.lit(False)
        for g in GATES:
            gate = gate | F.contains(form, F.lit(g))
        return F.struct(
            F.when(gate, base(form)).otherwise(no_base).alias("base"),
            F.when(gate, _in_words(form, resolve(detections(form)))).otherwise(no_spans).alias("spans"),
        )

    return let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), let(word_form(w), scanned).alias("found")))


def op10(docs: DataFrame) -> DataFrame:
    """The digest rows of the query, with the resolved spans as text behind them."""
    d = docs.select("doc_id", scan(F.col("text")).alias("s")).select(
        "doc_id", F.col("s.n_words").alias("n_words"), F.col("s.found.base").alias("base"), F.col("s.found.spans").alias("spans")
    )
    starts = F.transform("base", lambda b: b["start"])
    base_labels = F.array_distinct(F.transform("base", lambda b: b["label"]))
    labels = F.array_union(base_labels, F.transform("spans", lambda x: x["label"]))
    scores = F.concat(
        F.transform("spans", lambda x: x["score"]), F.when(F.size("base") > 0, F.array(F.lit(0.5))).otherwise(F.array().cast("array<double>"))
    )
    return d.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.sort_array(base_labels), ",").alias("base_labels"),
        F.array_join(F.sort_array(labels), ",").alias("labels"),
        F.coalesce(F.array_max(scores), F.lit(0.0)).alias("score"),
        F.array_join(
            F.transform("spans", lambda x: F.concat_ws(":", x["label"], x["start"].cast("string"), x["end"].cast("string"))), ","
        ).alias("license_spans"),
    )
