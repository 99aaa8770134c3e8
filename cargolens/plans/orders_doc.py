"""Freight orders as one wide row per order, derived from the star-schema tables.

The same SQL text serves Spark and the SQL oracle; it uses only what both read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.stored import Stored
from ..sources.tables import scratch

NAMESPACE = "order_ns"
DOC_TYPE = "order"
TABLES = ("orders", "lineitem", "customer", "supplier", "part")

ORDERS_DOC_SQL = """
WITH li AS (
  SELECT l_orderkey, min(l_suppkey) AS suppkey, min(l_partkey) AS partkey,
         min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship,
         sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS net,
         sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * CAST(l_tax AS DECIMAL(4,2))) AS tax,
         sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS discount,
         sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS gross,
         sum(CAST(l_quantity AS DECIMAL(12,2))) AS quantity
  FROM lineitem GROUP BY l_orderkey
), o AS (
  SELECT *, o_orderkey AS k, c_nationkey AS n, s_nationkey % 5 AS q
  FROM orders JOIN customer ON c_custkey = o_custkey
  LEFT JOIN li ON l_orderkey = o_orderkey
  LEFT JOIN supplier ON s_suppkey = suppkey
  LEFT JOIN part ON p_partkey = partkey
)
SELECT
  'order_ns' AS namespace, 'order' AS doc_type, CAST(k AS BIGINT) AS orderid,
  'MRP' || CAST(k AS STRING) AS ordernumber, 'TORD' || CAST(k AS STRING) AS tempordernumber,
  CASE WHEN k % 97 = 0 THEN NULL WHEN k % 89 = 0 THEN ''
       WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'Invoiced' ELSE 'Delivered' END
       WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'Dispatched' ELSE 'Confirmed' END
       ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'Cancelled' ELSE 'Quoted' END END AS orderstatus,
  CASE WHEN k % 101 = 0 THEN NULL WHEN k % 103 = 0 THEN '' ELSE c_name END AS customername,
  'CUST' || lpad(CAST(o_custkey AS STRING), 5, '0') AS customercode,
  c_mktsegment AS companycode,
  CASE WHEN n % 2 = 0 THEN 'CAD' ELSE 'USD' END AS currencycode,
  'Rep ' || CAST(o_custkey % 10 AS STRING) AS salesmanname,
  p_type AS commodityname,
  CAST(o_totalprice AS DOUBLE) AS grosstotalfreight,
  CAST(net AS DOUBLE) AS totalfreight, CAST(net AS DOUBLE) AS pretaxamount,
  CAST(tax AS DOUBLE) AS taxes, CAST(tax AS DOUBLE) AS totaltaxamount,
  CAST(discount AS DOUBLE) AS othercharges, CAST(gross AS DOUBLE) AS offeredamount,
  CAST(quantity AS DOUBLE) AS fuelcharges,
  CASE WHEN l_orderkey IS NULL THEN NULL WHEN k % 7 = 0 THEN '' WHEN k % 11 = 0 THEN 'N/A'
       ELSE CAST(CAST(quantity AS DECIMAL(18,2)) AS STRING) END AS distance_raw,
  'mi' AS distanceunit,
  CASE WHEN l_orderkey IS NULL THEN NULL WHEN k % 5 = 0 THEN '' ELSE 'TRIP' || CAST(k AS STRING) END AS tripno,
  substr(CAST(o_orderdate AS STRING), 1, 10) || 'T05:20:03.043+05:30' AS orderdate,
  substr(CAST(first_ship AS STRING), 1, 10) || 'T08:00:00.000-05:00' AS pickupdate,
  substr(CAST(last_ship AS STRING), 1, 10) || 'T17:00:00.000-05:00' AS deliverydate,
  s_name AS pickuplocationname, c_name || ' DC' AS deliverylocationname,
  CASE WHEN suppkey IS NULL OR k % 53 = 0 THEN NULL WHEN k % 59 = 0 THEN 'NO PARTS'
       ELSE CAST(suppkey AS STRING) || ' MAIN ST, CITY ' || CAST(suppkey % 7 AS STRING) || ', '
            || CASE q WHEN 0 THEN 'CA' WHEN 1 THEN 'TX' WHEN 2 THEN 'ON' WHEN 3 THEN 'QC' ELSE 'NEW YORK' END
            || CASE WHEN k % 61 = 0 THEN '' WHEN q IN (2, 3) THEN ', M5V 2T6' ELSE ', ' || CAST(10000 + suppkey AS STRING) END
            || CASE WHEN k % 67 = 0 THEN '' WHEN q IN (2, 3) THEN ', Canada' ELSE ', UNITED STATES' END END AS pickupfulladdress,
  CAST(o_custkey AS STRING) || ' DOCK RD, TOWN ' || CAST(o_custkey % 9 AS STRING) || ', '
    || CASE n % 3 WHEN 0 THEN 'TX, ' || CAST(20000 + o_custkey AS STRING) || ', United States'
                  WHEN 1 THEN 'ON, M5V2T6, Canada'
                  ELSE 'California, ' || CAST(20000 + o_custkey AS STRING) || ', United States' END AS deliveryfulladdress
FROM o
"""


#: Amounts of an order's lines as whole numbers, so that a line's sums are a few longs on their way: hundredths, products of two of them, or of three.
CENTS = "CAST(CAST({0} AS DECIMAL(12,2)) * 100 AS BIGINT)"
HUNDREDTHS = "CAST(CAST({0} AS DECIMAL(4,2)) * 100 AS BIGINT)"
LINES_SQL = f"""
  SELECT l_orderkey, min(l_suppkey) AS suppkey, min(l_partkey) AS partkey, min(shipped) AS first_ship, max(shipped) AS last_ship,
         sum(price * (100 - off)) AS net4, sum(price * (100 - off) * rate) AS tax6, sum(price * off) AS discount4, sum(price) AS gross2, sum(quantity) AS quantity2
  FROM (SELECT l_orderkey, l_suppkey, l_partkey, {{shipped}} AS shipped, {CENTS.format("l_extendedprice")} AS price,
               {HUNDREDTHS.format("l_discount")} AS off, {HUNDREDTHS.format("l_tax")} AS rate, {CENTS.format("l_quantity")} AS quantity FROM lineitem )
  GROUP BY l_orderkey
"""
#: The sums as the decimals they stand for.
SUMS = {"net": ("net4", "0.0001"), "tax": ("tax6", "0.000001"), "discount": ("discount4", "0.0001"), "gross": ("gross2", "0.01"), "quantity": ("quantity2", "0.01")}


def orders_doc(spark: SparkSession, sf_dir: str, dated: bool = False) -> DataFrame:
    """One row per order; orders without lines keep nulls in what comes from lines.

    The rows of ``ORDERS_DOC_SQL``. What is shuffled are keys and whole numbers: the sums of
    lines are longs (a sum beyond them is an error) and ship times days, and texts are written
    behind the joins. ``dated``: each partition in the order of dates.
    """
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    timed = dict(frames["lineitem"].dtypes)["l_shipdate"].startswith("timestamp")
    of_lines, of_orders, shown = ORDERS_DOC_SQL.index("SELECT l_orderkey"), ORDERS_DOC_SQL.index("), o AS ("), ORDERS_DOC_SQL.index("SELECT\n  'order_ns'")
    joined = ORDERS_DOC_SQL[of_orders:shown].rstrip()
    sums = ", ".join(f"CAST({n} AS DECIMAL(20,0)) * {unit} AS {name}" for name, (n, unit) in SUMS.items())
    in_order = f", d AS (SELECT * FROM o{' SORT BY o_orderdate, k' if dated else ''}), w AS (SELECT *, {sums} FROM d)\n"
    text = ORDERS_DOC_SQL[:of_lines] + LINES_SQL.format(shipped="CAST(l_shipdate AS DATE)" if timed else "l_shipdate") + joined + in_order + ORDERS_DOC_SQL[shown:].replace("FROM o\n", "FROM w\n")
    for t in TABLES:
        text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(text, **frames)


#: Columns that orders are looked up by; a row group without a value is not read.
LOOKED_UP = ("orderid", "ordernumber", "tempordernumber")


def store_orders(orders: DataFrame, path: str) -> Stored:
    """Orders as a stored table: partitioned by namespace, its files in the order that their rows come in.

    With each file in the order of dates, a period or a day reads the pages whose least and
    greatest dates meet it. Ids and numbers are spread over all row groups, so that these have
    Bloom filters of them, as large as their values need.
    """
    table = Stored(orders.sparkSession, path, orders.schema)
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in LOOKED_UP}
    table.write(orders, **blooms, **{"parquet.bloom.filter.adaptive.enabled": "true", "compression": "zstd"})
    return table


_STORED: dict[tuple[str, str], Stored] = {}


def stored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders_doc``, written to the checkpoint folder by the first query of a session that asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        _STORED[key] = store_orders(orders_doc(spark, sf_dir, dated=True), scratch(spark))
    return _STORED[key].read()
