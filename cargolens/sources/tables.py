"""Order documents to be stored, and tables that are replaced or extended by namespace."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .stored import Stored

# Fields of the searchable text, in order.
PREFERRED = (
    "orderid", "ordernumber", "tempordernumber", "orderdate", "customername", "customercode", "companycode", "salesmanname",
    "salesmancode", "currencycode", "totalfreight", "grosstotalfreight", "freightcharges", "fuelcharges", "othercharges", "taxes",
    "totaltaxamount", "pretaxamount", "offeredamount", "orderstatus", "statuscode", "loadtypelucode", "pickuplocationname",
    "pickupfulladdress", "pickupdate", "deliverylocationname", "deliveryfulladdress", "deliverydate", "commodityname", "weight",
    "weightunit", "distance", "distanceunit", "ordernotes",
)
JSON_CHARS = 6000


def page_content(orders: DataFrame, fields: tuple[str, ...] = PREFERRED) -> Column:
    """``key: value`` lines of the fields that have a value, then the whole order as JSON, cut."""
    lines = [
        F.when(F.col(c).cast("string") != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in fields if c in orders.columns
    ]
    whole = F.to_json(F.struct(*orders.columns))
    cut = F.when(F.length(whole) > JSON_CHARS, F.concat(F.left(whole, F.lit(JSON_CHARS)), F.lit("..."))).otherwise(whole)
    return F.concat_ws("\n", *lines, F.concat(F.lit("full_order_json: "), cut))


def build_documents(orders: DataFrame, source: str, ingested_at: Column, embedding: Column | None = None) -> DataFrame:
    """The orders with ``page_content``, ``embedding`` and ``metadata``; without vectors the embedding is empty."""
    vector = F.array().cast("array<float>") if embedding is None else embedding
    return orders.withColumns(
        {
            "page_content": page_content(orders),
            "embedding": vector,
            "metadata": F.struct(
                F.col("doc_type").alias("type"), F.lit(source).alias("source_document"), "orderid", "ordernumber",
                ingested_at.alias("ingested_at"), F.size(vector).alias("embedding_dimensions"), F.lit(True).alias("structured"),
            ),
        }
    )


def write_vectors(table: Stored, chunks: DataFrame, namespace: str, replace: bool = True) -> None:
    """Chunks (chunk_id, text, embedding, metadata ...) as the namespace's rows, or added to them; rows without a vector are no matches and stay out.

    Replacing a namespace by no rows empties it.
    """
    rows = chunks.filter(F.size("embedding") > 0).withColumn("namespace", F.lit(namespace))
    table.write(rows, replace, values=[namespace])


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster names for checkpoints; a temporary one only in a local session without it."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{folder or tempfile.mkdtemp(prefix='spark-')}/stored-{uuid.uuid4().hex}"


def read_namespace(df: DataFrame, namespace: str) -> DataFrame | None:
    """The namespace's rows, or None if there are none."""
    rows = df.filter(F.col("namespace") == namespace)
    return None if rows.isEmpty() else rows


def ingest_summary(loaded: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: records loaded and stored, smallest id, first 25 field names in order."""
    names = F.slice(F.sort_array(F.array(*(F.lit(c) for c in stored.columns))), 1, 25)
    left = loaded.agg(F.count(F.lit(1)).alias("loaded"))
    right = stored.agg(F.count(F.lit(1)).alias("stored"), F.min("orderid").alias("sample_id"))
    return left.crossJoin(right).withColumn("fields", F.array_join(names, ","))  # two single rows


def chunk_preview(chunks: DataFrame, source: str, n: int = 5) -> DataFrame:
    """(total, chunk_id, text, dimensions): the first chunks of a source document."""
    own = chunks.filter(F.col("source_document") == source)
    total = own.agg(F.count(F.lit(1)).alias("total"))
    first = own.orderBy("pos").limit(n).select("chunk_id", F.left("chunk", F.lit(350)).alias("text"), F.size("embedding").alias("dimensions"))
    return first.crossJoin(F.broadcast(total))  # one row
