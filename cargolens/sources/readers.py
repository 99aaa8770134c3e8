"""Reading orders and documents from JSON and text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# File name endings that are read.
EXTENSIONS = (".pdf", ".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp", ".tiff", ".docx", ".doc", ".json", ".txt")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def readable(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per file; files are read by the executors."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def whole_json(text: Column) -> Column:
    """The value of a text that is JSON as a whole, else null; Spark's parser takes ``12 pallets`` for 12.

    What stands behind a value either breaks the list made of the text or changes its length.
    """
    items = lambda end: F.size(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(end))), "$", "array<variant>"))
    return F.when((items("]") == 1) & (items(",0]") == 2), F.try_parse_json(text))


def unwrap_records(texts: DataFrame) -> DataFrame:
    """(path, record, raw) of (path, text): the records of each JSON text, in order.

    A text is a list of records, a list of wrappers or one wrapper; a wrapper's ``details``
    are records, or a JSON string of them. What is not an object is dropped.
    """
    t = texts.select("path", whole_json(F.col("text")).alias("v")).filter("v is not null")
    top = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    items = t.select("path", F.posexplode(top).alias("i", "item"))
    nested = F.coalesce(
        F.try_variant_get("item", "$.details", "array<variant>"),
        F.try_variant_get(whole_json(F.try_variant_get("item", "$.details", "string")), "$", "array<variant>"),
    )
    rows = items.select("path", "i", F.posexplode(F.coalesce(nested, F.array("item"))).alias("j", "raw"))
    return rows.filter(F.upper(F.schema_of_variant("raw")).startswith("OBJECT")).select("path", F.struct("i", "j").alias("record"), "raw")


def typed(records: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The named fields as typed columns; unknown keys stay in ``raw``."""
    return records.select("path", "record", *(F.try_variant_get("raw", f"$['{n}']", kind).alias(n) for n, kind in fields.items()), "raw")


def read_orders(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    return typed(unwrap_records(whole_texts(spark, path)), fields)


def json_documents(texts: DataFrame) -> DataFrame:
    """(path, text, no_split, orderid, ordernumber): each record is one document that stays whole."""
    r = unwrap_records(texts)
    return r.select(
        "path", "record", F.to_json("raw").alias("text"), F.lit(True).alias("no_split"),
        F.try_variant_get("raw", "$.orderid", "bigint").alias("orderid"), F.try_variant_get("raw", "$.ordernumber", "string").alias("ordernumber"),
    )


def text_documents(texts: DataFrame) -> DataFrame:
    """(path, text, no_split): texts that are not JSON are documents to be split; blank ones are none."""
    plain = texts.filter(whole_json(F.col("text")).isNull() & (F.trim("text") != ""))
    return plain.select("path", "text", F.lit(False).alias("no_split"))
