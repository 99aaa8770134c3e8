"""Model responses to clean shipment rows, with VARIANT expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The keys of a shipment, and those that may be lists with one value per commodity.
SHIPMENT_KEYS = (
    "commodity", "pickup_location", "pickup_date", "pickup_time", "pickup_refrence_no", "distance", "delivery_location",
    "delivery_date", "delivery_time", "delivery_refrence_no", "ValueOfgoods", "Equipment", "No.OfPackage", "weight",
    "temperature", "dimention", "pickupNote", "DeliveryNotes", "Copmliancehandling",
)
# Units of package counts and of weights.
PACKAGES = ("pc", "pcs", "piece", "pieces", "pkg", "pkgs", "package", "packages", "pallet", "pallets", "skid", "skids", "qty")
MASSES = ("lb", "lbs", "kg", "kgs", "pound", "pounds")
LINE_KEYS = ("commodity", "No.OfPackage", "weight", "dimention")


def _path(key: str) -> str:
    return f"$['{key}']"


def cleaned(response: Column) -> Column:
    """Without white space and a code fence around, and without quotes if it is a JSON string."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim(response), r"^```(?:json)?", ""), r"```$", ""))
    inner = F.try_variant_get(F.try_parse_json(text), "$", "string")
    return F.when(text.rlike(r'(?s)^".*"$'), F.coalesce(F.trim(inner), text)).otherwise(text)


def parse_responses(responses: DataFrame) -> DataFrame:
    """(resp_id, pos, obj, raw): one row per object; ``raw`` holds a text that cannot be read.

    A text whose lines are all objects is one object per line. Else the whole text is tried
    first, then its outermost object, then its outermost array of objects, then the lines
    that are objects.
    """
    is_object = lambda v: F.coalesce(F.upper(F.schema_of_variant(v)).startswith("OBJECT"), F.lit(False))
    none = F.lit(None).cast("array<variant>")

    def items(text: Column) -> Column:
        return F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")

    def let(bound: Column, body) -> Column:
        return F.get(F.transform(F.array(bound), body), F.lit(0))

    def single(text: Column) -> Column:
        """The one object that the text is, in an array; a text with anything behind it is none."""
        return let(items(text), lambda v: F.when((F.size(v) == 1) & is_object(F.get(v, F.lit(0))), v).otherwise(none))

    def listed(text: Column) -> Column:
        return let(items(text), lambda v: F.when((F.size(v) > 0) & F.forall(v, is_object), v).otherwise(none))

    def by_line(text: Column) -> Column:
        begun = F.filter(F.split(text, "\n"), lambda x: F.trim(x).startswith("{"))
        objects = F.flatten(F.filter(F.transform(begun, lambda x: single(F.regexp_replace(F.trim(x), ",+$", ""))), lambda v: v.isNotNull()))
        return let(objects, lambda v: F.when(F.size(v) > 0, v).otherwise(none))

    full = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    begun = F.filter(full, lambda x: F.trim(x).startswith("{"))
    # each reading is tried only where those before it found nothing
    all_lines = F.when((F.size(full) > 1) & (F.size(begun) == F.size(full)), let(by_line(F.col("text")), lambda v: F.when(F.size(v) == F.size(full), v).otherwise(none)))
    inside = lambda pattern: F.regexp_extract("text", pattern, 1)
    found = F.coalesce(
        all_lines, single(F.col("text")), single(inside(r"(?s)(\{.*\})")), listed(inside(r"(?s)\[(.*)\]")), F.when(F.size(begun) > 0, by_line(F.col("text")))
    )
    r = responses.select("resp_id", "response", cleaned(F.col("response")).alias("text")).withColumn("objs", found)
    return r.select("resp_id", F.posexplode_outer("objs").alias("pos", "obj"), F.when(F.col("objs").isNull(), F.col("response")).alias("raw"))


def invalid_commodity(value: Column) -> Column:
    """True for package counts and bare weights, which are no goods.

    A number with a package unit behind it is a count. A number with a unit of weight behind
    it is a bare weight unless some other word of three letters or more names goods; pieces
    beside a weight are a count however they are written.
    """
    parts = F.regexp_extract_all(F.lower(value), F.lit(r"[\p{L}]+|[0-9]+(?:[.,][0-9]+)*"), F.lit(0))

    def judge(p: Column) -> Column:
        number = lambda x: x.rlike("^[0-9]")
        behind = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.when(number(a), b))
        units = F.filter(behind, lambda u: u.isNotNull())
        goods = F.exists(p, lambda x: ~number(x) & (F.length(x) > 2) & ~x.isin(*PACKAGES, *MASSES, "and"))
        some = lambda words: F.arrays_overlap(p, F.array(*(F.lit(w) for w in words)))
        counted = F.exists(units, lambda u: u.isin(*PACKAGES))
        weighed = F.exists(units, lambda u: u.isin(*MASSES))
        return counted | (weighed & ~goods) | (some(PACKAGES[:2]) & some(MASSES))

    return F.coalesce(F.get(F.transform(F.array(parts), judge), F.lit(0)), F.lit(False))


def shipment_rows(objects: DataFrame) -> DataFrame:
    """(resp_id, pos, ship, line, 19 text columns) of (resp_id, pos, obj).

    A shipment may be an object or an array of objects; an empty array is one row of nulls.
    A list of commodities makes a row each: lists beside it are taken by place, a single
    value is copied, other fields are repeated. Empty values and invalid commodities are null.
    """
    as_list = F.try_variant_get("obj", "$.shipment", "array<variant>")
    single = F.try_variant_get("obj", "$.shipment", "variant")
    ships = F.when(F.size(as_list) > 0, as_list).when(as_list.isNotNull(), F.array(F.try_parse_json(F.lit("{}")))).otherwise(F.array(single))
    s = objects.filter("obj is not null").select("resp_id", "pos", F.posexplode(ships).alias("ship", "v"))
    texts = lambda key: F.try_variant_get("v", _path(key), "array<string>")
    goods = F.filter(texts("commodity"), lambda c: c.isNotNull() & (c != ""))
    lines = F.when(F.size(goods) > 0, goods).otherwise(F.array(F.when(texts("commodity").isNull(), F.try_variant_get("v", _path("commodity"), "string"))))
    s = s.select("resp_id", "pos", "ship", "v", F.size(lines).alias("n"), F.posexplode(lines).alias("line", "goods"))
    cols = []
    for key in SHIPMENT_KEYS:
        scalar = F.try_variant_get("v", _path(key), "string")
        if key == "commodity":
            value = F.when(~invalid_commodity(F.col("goods")), F.col("goods"))
        elif key in LINE_KEYS:
            value = F.when(texts(key).isNotNull() & (F.col("n") > 1), F.get(texts(key), F.col("line"))).otherwise(scalar)
        else:
            value = scalar
        cols.append(F.nullif(value, F.lit("")).alias(key))
    return s.select("resp_id", "pos", "ship", "line", *cols)
