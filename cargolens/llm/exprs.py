"""Small column helpers shared by the native operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: ASCII white space, the only word boundary of the word contracts.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda variable is bound to the value, so that the optimiser cannot copy a costly
    expression to each place (or into each inner lambda) that uses it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The runs of anything but ASCII white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of this regular expression's class the text holds.

    Removing runs with a regular expression is several times faster than ``translate``,
    which looks up every character as a string.
    """
    return (F.length(text) - F.length(F.regexp_replace(text, chars, ""))).cast("long")


def free_name(taken: list[str], name: str) -> str:
    """``name``, or the first of ``name_1``, ``name_2`` ... that is not taken (ignoring case)."""
    low = {t.lower() for t in taken}
    if name.lower() not in low:
        return name
    n = 1
    while f"{name}_{n}".lower() in low:
        n += 1
    return f"{name}_{n}"
