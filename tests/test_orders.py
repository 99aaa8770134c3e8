"""Order lists, lookups and the stored table: plans and odd rows."""

import math
import os
import re
from urllib.parse import unquote, urlparse

import duckdb
import pytest
from pyspark.sql import functions as F

from cargolens.operators import orders as ops
from cargolens.operators.filters import order_filter, scope
from cargolens.operators.metrics import orders_in_period
from cargolens.plans import registry
from cargolens.plans.orders_doc import NAMESPACE, orders_doc, store_orders, stored_orders
from cargolens.schema import LISTED
from cargolens.sources.tables import scratch

from .oracle import DATA, same


def plan(df):
    return df._jdf.queryExecution().toString()


def test_the_stored_orders_are_the_derived_ones(spark):
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(stored_orders(spark, DATA).drop("namespace")) == rows(orders_doc(spark, DATA).drop("namespace"))
    assert stored_orders(spark, DATA).columns == orders_doc(spark, DATA).columns


def test_orders_are_stored_without_a_shuffle_of_their_texts_and_small(spark):
    fresh = orders_doc(spark, DATA, dated=True)
    assert "rangepartitioning" not in plan(fresh).lower()
    table = store_orders(fresh, scratch(spark))
    files = table.read().inputFiles()
    assert 0 < sum(os.path.getsize(unquote(urlparse(f).path)) for f in files) < 1e6  # three filters of 1 MB a file before
    for f in files:
        days = [r[0] for r in spark.read.parquet(f).select("orderdate").collect()]
        assert days == sorted(days)


def test_odd_lines_and_orders(spark, tmp_path):
    con = duckdb.connect()
    odd = {
        "lineitem": "l_extendedprice: CASE WHEN l_linenumber % 3 = 0 OR l_orderkey % 10 = 1 THEN NULL ELSE l_extendedprice + 0.004 END, l_discount: CASE WHEN l_linenumber % 4 = 1 THEN NULL ELSE l_discount END,"
        " l_tax: CASE WHEN l_linenumber % 5 = 2 THEN NULL ELSE -l_tax END, l_quantity: nullif(l_quantity, 7) * 1e6, l_shipdate: CASE WHEN l_orderkey % 9 = 2 THEN NULL ELSE l_shipdate END, l_suppkey: nullif(l_suppkey, 3), l_partkey: l_partkey * 2",
        "orders": "o_custkey: CASE WHEN o_orderkey % 50 = 3 THEN NULL ELSE o_custkey END, o_orderdate: CASE WHEN o_orderkey % 70 = 5 THEN NULL ELSE o_orderdate END", "customer": "", "supplier": "", "part": "",
    }
    for t, change in odd.items():
        named = ", ".join(f"{v} AS {k}" for k, v in re.findall(r"(\w+): (.*?)(?:,\s+(?=\w+: )|$)", change))
        twice = "UNION ALL SELECT * FROM t WHERE o_orderkey % 40 = 7" if t == "orders" else "WHERE l_orderkey % 13 > 0" if t == "lineitem" else ""
        con.sql(f"COPY (WITH t AS (SELECT * {f'REPLACE ({named})' if named else ''} FROM '{DATA}/{t}.parquet') SELECT * FROM t {twice}) TO '{tmp_path}/{t}.parquet'")
    same(registry.QUERIES["orders_doc"](spark, str(tmp_path)), registry.SQL["orders_doc"], str(tmp_path))


@pytest.mark.parametrize("condition, pushed", [({"orderstatus": "Confirmed"}, "EqualTo(orderstatus,Confirmed)"), ({"orderdate": "1998-03"}, "StringStartsWith(orderdate,1998-03)")])
def test_plans_read_partitions_and_push_filters(spark, condition, pushed):
    text = plan(scope(stored_orders(spark, DATA), NAMESPACE).filter(order_filter(**condition)).select("orderid"))
    physical = text[text.index("== Physical Plan") :]
    assert "PartitionFilters: [isnotnull(namespace" in physical and pushed in physical and "lineitem" not in physical and "Exchange" not in physical
    assert "ReadSchema: struct<doc_type:string,orderid:bigint," in physical and physical[physical.index("ReadSchema") :].count(":") < 7


def test_a_search_scans_once(spark):
    for df in (registry.QUERIES["search_orders"](spark, DATA), registry.QUERIES["top_orders_by_tax"](spark, DATA)):
        physical = plan(df)[plan(df).index("== Physical Plan") :]
        assert physical.count("Scan parquet") == 1 and "NestedLoop" not in physical and "Cartesian" not in physical
    text = plan(orders_in_period(scope(stored_orders(spark, DATA), NAMESPACE), "2001-08-01", 365, "Confirmed"))
    assert "lineitem" not in text


@pytest.mark.parametrize("key", ["totalfreight", "orderdate", "distance_num", "nothing"])
@pytest.mark.parametrize("up", [False, True])
def test_search_orders_rows_as_spark_sorts_them(spark, key, up):
    kinds = {"orderid": "long", "totalfreight": "double", "orderdate": "string", "distance_raw": "string"}
    shown = [c for c in LISTED if c != "distance_num"]
    freight = [3.5, None, math.nan, math.inf, -1.0, 3.5, -math.inf, 0.0]
    rows = [tuple({"orderid": i, "totalfreight": freight[i % 8], "orderdate": [None, "", "2020", "é", "b"][i % 5], "distance_raw": ["7", "NaN", "x", None][i % 4]}.get(c) for c in (*shown, "distance_raw")) for i in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in (*shown, "distance_raw"))).repartition(7)
    column = key if key != "nothing" else "orderid"
    hits = ops.with_numbers(df).filter("orderid % 3 <> 1")
    want = [r["orderid"] for r in hits.orderBy(F.col(column).asc() if up else F.col(column).desc(), "orderid").limit(25).collect()]
    got = ops.search_orders(df, F.expr("orderid % 3 <> 1"), 25, key, up).collect()
    assert [r["orderid"] for r in got] == want and {r["total"] for r in got} == {40}
    assert ops.search_orders(df, F.lit(False)).count() == 0


def test_lookups_fetch_late(spark):
    rows = [(1, "MRP1", "T1", "a"), (2, "mrp2", None, "b"), (3, None, "3", "c"), (3, None, "3", "c"), (None, "MRP9", "1", "d"), (None, "MRP8", None, "e"), (12, "5", "mrp1", "f")]
    df = spark.createDataFrame(rows, "orderid long, ordernumber string, tempordernumber string, text string")
    tokens = spark.createDataFrame([(t,) for t in (" mrp1", "MRP2", "3", "1", "mrp8", "MRP9", "5", "t1", "", None, "99999999999999999999999")], "token string")
    got = {r["token"]: r["text"] for r in ops.find_orders(df, tokens).collect()}
    assert got == {" mrp1": "a", "MRP2": "b", "3": "c", "1": "a", "mrp8": "e", "MRP9": "d", "5": "f", "t1": "a"}
    analysed = ops.find_orders(df, tokens)._jdf.queryExecution().optimizedPlan().toString()
    keys = analysed[analysed.index("Generate posexplode") :]
    assert "text#" not in keys[: keys.index("LogicalRDD")]
