"""City, state and country out of comma-separated addresses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import STATE_OF_NAME

UNKNOWN = "Unknown"


def title_case(text: Column) -> Column:
    """First letter of every run of letters in upper case, the others in lower case.

    ``initcap`` would only look at white space: it turns O'Brien into O'brien.
    """
    pieces = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    first_up = lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))
    return F.array_join(F.transform(pieces, first_up), "")


def resolve_state(name: Column) -> Column:
    """The code of a state or province named by code or name; null for anything else."""
    pairs = [F.lit(x) for item in STATE_OF_NAME.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(name)))


def address_parts(address: Column, canonical: bool = False) -> Column:
    """struct(city, state, country) in lower case, or null with fewer than three parts; an unknown country is null.

    Parts are trimmed, empty ones do not count. City is the second and state the third
    part; country is the fifth, or the fourth of exactly four unless it starts with a
    five-digit code; whatever holds an ``@`` is no country. ``canonical``: a Canadian postal
    code in fourth place is no country.
    """
    parts = F.filter(F.transform(F.split(address, ","), lambda p: F.trim(p)), lambda p: p != "")

    def build(p: Column) -> Column:
        fourth = F.get(p, F.lit(3))
        code = r"^\d{5}" if not canonical else r"^(?:\d{5}|(?i:[a-z]\d[a-z] ?\d[a-z]\d)$)"
        country = F.when(F.size(p) >= 5, F.get(p, F.lit(4))).when((F.size(p) == 4) & ~fourth.rlike(code), fourth)
        country = F.lower(F.when(~country.contains("@"), country))
        return F.when(F.size(p) >= 3, F.struct(F.lower(F.get(p, F.lit(1))).alias("city"), F.lower(F.get(p, F.lit(2))).alias("state"), country.alias("country")))

    return F.get(F.transform(F.array(parts), build), F.lit(0))


def shown(parts: Column, canonical: bool = False) -> dict[str, Column]:
    """City, state and country as they are shown: in title case, short states in upper case. ``canonical``: known states as codes."""
    state = F.when(F.length(parts["state"]) <= 3, F.upper(parts["state"])).otherwise(title_case(parts["state"]))
    if canonical:
        state = F.coalesce(resolve_state(parts["state"]), state)
    return {"city": title_case(parts["city"]), "state": state, "country": F.coalesce(title_case(parts["country"]), F.lit(UNKNOWN))}


def _shown_struct(parts: Column, canonical: bool) -> Column:
    return F.when(parts.isNotNull(), F.struct(*(c.alias(n) for n, c in shown(parts, canonical).items())))


def parse_address(address: Column, canonical: bool = False) -> Column:
    """struct(city, state, country) as shown, or null with fewer than three parts; see ``address_parts``."""
    return F.get(F.transform(F.array(address_parts(address, canonical)), lambda p: _shown_struct(p, canonical)), F.lit(0))


def order_parts(side: str = "both", canonical: bool = False) -> Column:
    """The parts of one address per order: of ``both`` sides the pickup's if it can be parsed, else the delivery's."""
    sides = {"pickup": ["pickup"], "delivery": ["delivery"]}.get(side, ["pickup", "delivery"])
    return F.coalesce(*(address_parts(F.col(f"{s}fulladdress"), canonical) for s in sides))


def order_geo(side: str = "both", canonical: bool = False) -> Column:
    """``order_parts`` as shown."""
    return F.get(F.transform(F.array(order_parts(side, canonical)), lambda p: _shown_struct(p, canonical)), F.lit(0))
