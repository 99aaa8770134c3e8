"""Order lists, rankings, lookups, details and comparisons."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..schema import LISTED, SORTABLE


def with_numbers(orders: DataFrame) -> DataFrame:
    """Adds ``distance_num``: the distance if it is a number, else null."""
    return orders.withColumn("distance_num", F.expr("try_cast(distance_raw as double)"))


def search_orders(orders: DataFrame, where: Column, limit: int = 15, sort_by: str = "orderid", ascending: bool = False) -> DataFrame:
    """The first orders that match, with the number of all matches in ``total``, in one pass.

    Each task keeps its ``limit`` best rows and a count of its matches; these are merged twice.
    Nulls come first in rising and last in falling order, equal keys by ``orderid``.
    """
    n = min(50, max(1, limit))
    key = sort_by if sort_by in SORTABLE else "orderid"
    hits = with_numbers(orders).filter(where)
    number = dict(hits.dtypes)[key] in ("double", "float")
    value = F.col(key) if not number else F.when(~F.isnan(key), F.col(key))
    # NaN is above all numbers; without it and nulls Arrow sorts as Spark does
    rank = F.when(F.col(key).isNull(), 0).when(F.isnan(key) if number else F.lit(False), 2).otherwise(1)
    order = [("_rank", "ascending" if ascending else "descending"), ("_value", "ascending" if ascending else "descending"), ("_id", "ascending")]
    rows = hits.select(*LISTED, F.lit(1).cast("long").alias("total"), rank.cast("int").alias("_rank"), value.alias("_value"), F.col("orderid").alias("_id"))

    def best(batches):
        held, total = None, 0
        for b in batches:
            t = pa.Table.from_batches([b])
            total += pc.sum(t.column("total")).as_py() or 0
            t = t if held is None else pa.concat_tables([held, t])
            held = t.take(pc.sort_indices(t, sort_keys=order)[:n])
        if held is not None and held.num_rows:
            # the whole count goes with the first row
            counts = pa.array([total, *[0] * (held.num_rows - 1)], pa.int64())
            yield from held.set_column(held.schema.get_field_index("total"), "total", counts).combine_chunks().to_batches()

    parts = rows.mapInArrow(best, rows.schema).repartition(8).mapInArrow(best, rows.schema)
    top = parts.coalesce(1).mapInArrow(best, rows.schema)
    return top.select(*LISTED, F.max("total").over(Window.partitionBy()).alias("total"))  # the rows of one result


def list_recent(orders: DataFrame, limit: int = 10) -> DataFrame:
    return search_orders(orders, F.lit(True), limit)


def find_orders(orders: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, *order) for a table of tokens: by id, number or temporary number, first match kept.

    Digits are looked up in all three columns, anything else in the two numbers; numbers
    compare without case. The tokens meet a narrow table of keys and ids first; only what they
    hit fetches whole orders.
    """
    named, numbered = lambda c: F.concat(F.lit("n"), F.upper(c)), lambda c: F.concat(F.lit("i"), c.cast("string"))
    key = F.upper(F.trim("token"))
    asked = F.array_compact(F.array(named(key), numbered(F.when(key.rlike(r"^\d+$"), F.expr("try_cast(trim(token) as bigint)")))))
    t = tokens.filter(key != "").select("token").distinct().select("token", F.explode(asked).alias("_key"))
    own = F.array(numbered(F.col("orderid")), named(F.col("ordernumber")), named(F.col("tempordernumber")))
    keyed = orders.select(F.col("orderid").alias("_id"), F.posexplode(own).alias("_how", "_key")).filter("_key is not null")
    first = F.row_number().over(Window.partitionBy("token").orderBy("_how", "_id"))
    hits = t.join(keyed, "_key").withColumn("_n", first).filter("_n = 1").drop("_n")
    whole = hits.join(orders, F.col("_id").eqNullSafe(F.col("orderid"))).filter(F.get(own, F.col("_how")) == F.col("_key"))
    return whole.dropDuplicates(["token"]).select("token", *orders.columns)  # repeated orders count once


#: Shown first in a detail, in this order.
PRIORITY = (
    "ordernumber", "orderid", "tempordernumber", "orderstatus", "orderdate", "pickupdate", "deliverydate", "customername",
    "customercode", "companycode", "currencycode", "totalfreight", "grosstotalfreight", "taxes", "totaltaxamount",
    "pickuplocationname", "pickupfulladdress", "deliverylocationname", "deliveryfulladdress", "salesmanname", "commodityname",
)
INTERNAL = ("namespace", "doc_type", "page_content", "embedding", "metadata")


def order_detail(found: DataFrame, max_fields: int = 120) -> DataFrame:
    """(token, position, field, value): priority fields first, then the others, without empty values.

    Numbers with a fraction are written plainly, to six digits at most.
    """
    plain = lambda c: F.regexp_replace(F.col(c).cast("decimal(38,6)").cast("string"), r"\.?0+$", "")
    kinds = dict(found.dtypes)
    written = lambda c: plain(c) if kinds[c] in ("double", "float") else F.col(c).cast("string")
    fields = [c for c in (*PRIORITY, *(c for c in found.columns if c not in PRIORITY)) if c in found.columns and c not in (*INTERNAL, "token")]
    cells = F.array(
        *(F.struct(F.lit(i).alias("i"), F.lit(c).alias("field"), written(c).alias("value")) for i, c in enumerate(fields))
    )
    full = F.slice(F.filter(cells, lambda x: x["value"].isNotNull() & (F.trim(x["value"]) != "")), 1, max_fields)
    return found.select("token", F.posexplode(full)).select("token", (F.col("pos") + 1).alias("position"), "col.field", "col.value")


def compare_orders(found: DataFrame, left: str, right: str, max_fields: int = 40) -> DataFrame:
    """(field, left, right, differs) of two looked-up tokens; fields of a missing order are null."""
    cells = order_detail(found, max_fields)
    side = lambda t: F.max(F.when(F.col("token") == t, F.col("value")))
    both = cells.filter(F.col("token").isin(left, right)).groupBy("field").agg(side(left).alias("left"), side(right).alias("right"))
    return both.withColumn("differs", ~F.col("left").eqNullSafe(F.col("right")))
