"""Registered queries over orders, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.addresses import order_geo, resolve_state
from ..operators import metrics, orders as ops
from ..operators.filters import order_filter, scope
from ..sources.stored import Stored
from ..sources.tables import scratch
from ..schema import DEFAULT_FORMULAS, FORMULAS, KNOWN_STATUSES, LISTED, STATE_OF_NAME
from .orders_doc import NAMESPACE, ORDERS_DOC_SQL, orders_doc, stored_orders

AS_OF = "2001-08-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WITH = f"WITH raw_orders AS ({ORDERS_DOC_SQL}), orders_doc AS (SELECT *, TRY_CAST(distance_raw AS DOUBLE) AS distance_num FROM raw_orders WHERE namespace = 'order_ns' AND doc_type = 'order')"


def register(name: str, build: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    """``build`` gets the orders in scope."""
    QUERIES[name] = lambda spark, sf_dir: build(scope(stored_orders(spark, sf_dir), NAMESPACE))
    if sql is not None:
        SQL[name] = f"{WITH} {sql}" if sql.lstrip().upper().startswith("SELECT") else f"{WITH}, {sql.lstrip()}"


# as it is derived from the tables; all other queries read it as it is stored
register("orders_doc", lambda o: o, "SELECT * EXCLUDE (distance_num) FROM orders_doc")

QUERIES["orders_doc"] = lambda spark, sf_dir: scope(orders_doc(spark, sf_dir), NAMESPACE)

STATUS = "coalesce(nullif(orderstatus, ''), 'Unknown')"
register(
    "status_summary",
    metrics.status_summary,
    f"k AS (SELECT unnest([{', '.join(repr(s) for s in KNOWN_STATUSES)}]) AS status), c AS (SELECT {STATUS} AS status, count(*) AS n FROM orders_doc GROUP BY 1)"
    " SELECT coalesce(c.status, k.status) AS status, coalesce(n, 0) AS n FROM c FULL JOIN k ON c.status = k.status",
)

LIKE = {
    "customername": ("filter_customername", "customername", "Customer#00000001"),
    "pickup_location": ("filter_pickup_location", "pickuplocationname", "supplier#00000000"),
    "delivery_location": ("filter_delivery_location", "deliverylocationname", "2 dc"),
    "salesmanname": ("filter_salesman", "salesmanname", "REP 3"),
    "commodityname": ("filter_commodity", "commodityname", "e"),
}
SHOWN = ("orderid", "ordernumber", "orderstatus")


def register_filter(name: str, sql_where: str, **filters) -> None:
    register(name, lambda o: o.filter(order_filter(**filters)).select(*SHOWN), f"SELECT {', '.join(SHOWN)} FROM orders_doc WHERE {sql_where}")


register_filter("filter_status", "orderstatus = 'Confirmed'", orderstatus="Confirmed")
register_filter("filter_currency", "currencycode = 'CAD'", currencycode="CAD")
register_filter("filter_customercode", "lower(customercode) = 'cust00042'", customercode="cust00042")
register_filter("filter_companycode", "lower(companycode) = 'building'", companycode="Building")
for key, (query, column, value) in LIKE.items():
    register_filter(query, f"contains(lower({column}), '{value.lower()}')", **{key: value})
register_filter("filter_orderdate", "starts_with(orderdate, '1998-03')", orderdate="1998-03")
register_filter("filter_pickupdate", "starts_with(pickupdate, '1998-03')", pickupdate="1998-03")
register_filter("filter_deliverydate", "starts_with(deliverydate, '1998-03')", deliverydate="1998-03")

ADDRESSES = {"pickup": ["pickupfulladdress"], "delivery": ["deliveryfulladdress"], "both": ["pickupfulladdress", "deliveryfulladdress"]}
PLACES = [*ADDRESSES["both"], "pickuplocationname", "deliverylocationname"]


def any_of(columns: list[str], test: str) -> str:
    return "(" + " OR ".join(f"coalesce({test.format(c)}, false)" for c in columns) + ")"


TX = any_of(ADDRESSES["both"], r"regexp_matches({}, '(?i)(^|,\s*)(texas|TX)(\s*,|$)')")
for side in ("pickup", "delivery", "both"):
    test = any_of(ADDRESSES[side], r"regexp_matches({}, '(?i)(^|,\s*)(ontario|ON)(\s*,|$)')")
    register_filter(f"filter_side_{side}", test, state="ON", side=side)
register_filter("filter_pin", any_of(ADDRESSES["both"], r"regexp_matches({}, '(?i)\bM5V\s?2T6\b')"), pin="m5v2t6")
register_filter("filter_state", TX, state="texas")
register_filter("filter_city", any_of(PLACES, r"regexp_matches({}, '(?i)\bcity 3\b')"), city="City 3")
register_filter("filter_address", any_of(ADDRESSES["both"], "contains(lower({}), '7 dock rd')"), address="7 Dock Rd")
register_filter("filter_location", any_of(PLACES, "contains(lower({}), 'supplier#000000002')"), location="Supplier#000000002")
register_filter(
    "filter_combined",
    f"orderstatus = 'Delivered' AND currencycode = 'USD' AND {TX} AND {any_of(PLACES, "contains(lower({}), 'rd')")}",
    orderstatus="Delivered", currencycode="USD", state="TX", location="rd",
)


def listing(where: str, order: str, limit: int) -> str:
    return f"h AS (SELECT * FROM orders_doc WHERE {where}) SELECT {', '.join(LISTED)}, (SELECT count(*) FROM h) AS total FROM h ORDER BY {order}, orderid LIMIT {limit}"


register(
    "search_orders",
    lambda o: ops.search_orders(o, order_filter(orderstatus="Confirmed", currencycode="CAD"), 15),
    listing("orderstatus = 'Confirmed' AND currencycode = 'CAD'", "orderid DESC", 15),
)
register("list_recent", ops.list_recent, listing("true", "orderid DESC", 10))
for measure, column in (("freight", "totalfreight"), ("revenue", "grosstotalfreight"), ("tax", "taxes"), ("distance", "distance_num")):
    for word, up in (("top", False), ("bottom", True)):
        if word == "bottom" and measure == "revenue":
            continue
        nulls = "ASC NULLS FIRST" if up else "DESC NULLS LAST"
        register(
            f"{word}_orders_by_{measure}",
            lambda o, c=column, a=up: ops.search_orders(o, F.lit(True), 5, c, a),
            listing("true", f"{column} {nulls}", 5),
        )

#: Tokens are derived from the orders: every seventh as a lower-case number, every eleventh as digits, every 13th temporary.
TOKENS = """tokens AS (
  SELECT lower(ordernumber) AS token FROM orders_doc WHERE orderid % 7 = 0
  UNION SELECT CAST(orderid AS STRING) FROM orders_doc WHERE orderid % 11 = 0
  UNION SELECT tempordernumber FROM orders_doc WHERE orderid % 13 = 0 UNION SELECT 'MRP0'
)"""


def tokens(o: DataFrame) -> DataFrame:
    every = lambda n, c: F.when(F.col("orderid") % n == 0, c.cast("string"))
    own = F.array_compact(F.array(every(7, F.lower("ordernumber")), every(11, F.col("orderid")), every(13, F.col("tempordernumber"))))
    none = o.sparkSession.createDataFrame([("MRP0",)], "token string")
    return o.select(F.explode(own).alias("token")).union(none).distinct()


register(
    "find_order",
    lambda o: ops.find_orders(o, tokens(o)).select("token", "orderid", "ordernumber", "orderstatus"),
    f"{TOKENS} SELECT token, orderid, ordernumber, orderstatus FROM tokens JOIN orders_doc ON upper(token) IN (ordernumber, tempordernumber) OR token = CAST(orderid AS STRING)",
)
DETAIL = [c for c in (*ops.PRIORITY, "pretaxamount", "othercharges", "offeredamount", "fuelcharges", "distance_raw", "distanceunit", "tripno")]
NUMBERS = {"orderid", "totalfreight", "grosstotalfreight", "taxes", "totaltaxamount", "pretaxamount", "othercharges", "offeredamount", "fuelcharges"}


def detail_input(o: DataFrame, *wanted: str) -> DataFrame:
    return ops.find_orders(o, tokens(o)) if not wanted else ops.find_orders(o, o.sparkSession.createDataFrame([(w,) for w in wanted], "token string"))


def plain(c: str) -> str:
    return f"CAST({c} AS STRING)" if c not in NUMBERS or c == "orderid" else f"regexp_replace(CAST(CAST({c} AS DECIMAL(38,6)) AS STRING), '\\.?0+$', '')"


CELLS = "[" + ", ".join(f"{{'field': '{c}', 'value': {plain(c)}}}" for c in DETAIL) + "]"
register(
    "order_detail",
    lambda o: ops.order_detail(detail_input(o)),
    f"""{TOKENS}, c AS (SELECT token, list_filter({CELLS}, lambda x: x.value IS NOT NULL AND trim(x.value) <> '') AS cs
    FROM tokens JOIN orders_doc ON upper(token) IN (ordernumber, tempordernumber) OR token = CAST(orderid AS STRING))
    SELECT token, CAST(i AS INTEGER) AS position, cs[i].field AS field, cs[i].value AS value FROM (SELECT token, cs, unnest(range(1, len(cs) + 1)) AS i FROM c)""",
)
register(
    "compare_orders",
    lambda o: ops.compare_orders(detail_input(o, "MRP33", "MRP65"), "MRP33", "MRP65"),
    f"""c AS (SELECT ordernumber AS token, unnest({CELLS}) AS x FROM orders_doc WHERE ordernumber IN ('MRP33', 'MRP65')),
    v AS (SELECT token, x.field AS field, x.value AS value FROM c WHERE trim(x.value) <> '')
    SELECT field, max(value) FILTER (token = 'MRP33') AS "left", max(value) FILTER (token = 'MRP65') AS "right",
           max(value) FILTER (token = 'MRP33') IS DISTINCT FROM max(value) FILTER (token = 'MRP65') AS differs FROM v GROUP BY field""",
)

# geography
TITLE = "array_to_string(list_transform(regexp_extract_all(lower({0}), '(\\p{{L}}+|[^\\p{{L}}]+)'), lambda s: upper(s[1]) || s[2:]), '')"


def geo_sql(side: str) -> str:
    parse = {
        s: f"""p_{s} AS (SELECT orderid, list_filter(list_transform(string_split({s}fulladdress, ','), lambda x: trim(x)), lambda x: x <> '') AS p FROM orders_doc),
    c_{s} AS (SELECT orderid, p, CASE WHEN len(p) >= 5 THEN p[5] WHEN len(p) = 4 AND NOT regexp_matches(p[4], '^\\d{{5}}') THEN p[4] END AS c FROM p_{s}),
    g_{s} AS (SELECT orderid, {TITLE.format("p[2]")} AS city, CASE WHEN length(p[3]) <= 3 THEN upper(p[3]) ELSE {TITLE.format("p[3]")} END AS state,
      CASE WHEN c IS NULL OR contains(c, '@') THEN 'Unknown' ELSE {TITLE.format("c")} END AS country FROM c_{s} WHERE len(p) >= 3)"""
        for s in ("pickup", "delivery")
    }
    if side != "both":
        return f"{parse[side]}, g AS (SELECT * FROM g_{side})"
    return f"{parse['pickup']}, {parse['delivery']}, g AS (SELECT * FROM g_pickup UNION ALL SELECT * FROM g_delivery WHERE orderid NOT IN (SELECT orderid FROM g_pickup))"


register("parse_address", lambda o: o.select("orderid", order_geo("pickup").alias("g")).filter("g is not null").select("orderid", "g.*"), f"{geo_sql('pickup')} SELECT orderid, city, state, country FROM g")
register("order_geo", lambda o: o.select("orderid", order_geo().alias("g")).filter("g is not null").select("orderid", "g.*"), f"{geo_sql('both')} SELECT orderid, city, state, country FROM g")
register("orders_by_state", lambda o: metrics.geo_counts(o, "state"), f"{geo_sql('both')}, c AS (SELECT country, state, count(*) AS n FROM g GROUP BY ALL) SELECT *, (SELECT count(*) FROM c) AS groups FROM c ORDER BY n DESC, country, state LIMIT 50")
register("orders_by_city", lambda o: metrics.geo_counts(o, "city"), f"{geo_sql('both')}, c AS (SELECT city, state, country, count(*) AS n FROM g GROUP BY ALL) SELECT *, (SELECT count(*) FROM c) AS groups FROM c ORDER BY n DESC, city, state, country LIMIT 50")
register("best_city", lambda o: metrics.geo_counts(o, "city", limit=5).drop("groups"), f"{geo_sql('both')} SELECT city, state, country, count(*) AS n FROM g GROUP BY ALL ORDER BY n DESC, city, state, country LIMIT 5")
PAIRS = ", ".join(f"('{n}', '{c}')" for n, c in STATE_OF_NAME.items())
register(
    "resolve_state",
    lambda o: o.select("orderid", order_geo("delivery").alias("g")).select("orderid", F.col("g.state").alias("state")).withColumn("code", resolve_state(F.col("state"))),
    f"{geo_sql('delivery')}, m AS (SELECT * FROM (VALUES {PAIRS}) t(name, code)) SELECT orderid, state, code FROM g LEFT JOIN m ON name = lower(trim(state))",
)

# totals
DAY = "CAST(substr(orderdate, 1, 10) AS DATE)"
SINCE = f"{DAY} >= DATE '{AS_OF}' - INTERVAL 365 DAY"
SUM = "coalesce(CAST(sum(CAST({0} AS DECIMAL(38,6))) AS DOUBLE), 0)"
register("orders_in_period", lambda o: metrics.orders_in_period(o, AS_OF, 365, "Confirmed"), f"SELECT {STATUS} AS status, count(*) AS n, count(*) FILTER (orderstatus = 'Confirmed') AS matching FROM orders_doc WHERE {SINCE} GROUP BY 1")
for name, days in (("trip_distance", None), ("trip_distance_in_period", 365)):
    register(
        name,
        lambda o, d=days: metrics.trip_distance(o, AS_OF, d),
        f"SELECT count(*) AS orders, count(*) FILTER (tripno <> '') AS orders_with_trip, count(*) FILTER (distance_raw <> '') AS orders_with_distance, round({SUM.format('distance_num')}, 4) AS total_distance FROM orders_doc WHERE {SINCE if days else 'true'}",
    )
CUSTOMERS = f"c AS (SELECT customername, count(*) AS orders, round({SUM.format('grosstotalfreight')}, 4) AS revenue, round({SUM.format('totalfreight')}, 4) AS freight FROM orders_doc WHERE customername <> '' GROUP BY 1)"
for direction, word in (("best", "DESC"), ("worst", "ASC")):
    for metric, keys in (("orders", ("orders", "revenue")), ("revenue", ("revenue", "orders"))):
        register(
            f"{direction}_customers_{metric}",
            lambda o, m=metric, d=direction: metrics.rank_customers(o, m, d),
            f"{CUSTOMERS} SELECT * FROM c ORDER BY {', '.join(f'{k} {word}' for k in keys)}, customername LIMIT 5",
        )
CANADA = any_of(PLACES, r"regexp_matches({}, '(?i)(\bCanada\b|\bCAN\b)')")
COUNTS = "count(*) AS matching_orders, count(DISTINCT nullif(customername, '')) AS distinct_customers"
TOP = "SELECT customername, count(*) AS orders FROM orders_doc WHERE customername <> '' AND {} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
register("customers_by_country", lambda o: metrics.customer_activity(o, metrics.in_country("Canada")), f"SELECT {COUNTS} FROM orders_doc WHERE {CANADA}")
register("customers_by_country_top", lambda o: metrics.top_customers(o, metrics.in_country("Canada")), TOP.format(CANADA))
register("activity_on_date", lambda o: metrics.customer_activity(o, order_filter(orderdate="1998-03-05")), f"SELECT {COUNTS} FROM orders_doc WHERE starts_with(orderdate, '1998-03-05')")
register("activity_daily", metrics.activity_daily, f"SELECT substr(orderdate, 1, 10) AS day, {COUNTS} FROM orders_doc GROUP BY 1")
register(
    "activity_monthly",
    lambda o: metrics.activity_over(metrics.activity_bitmaps(o, metrics.customer_numbers(o)), F.left("day", F.lit(7))).withColumnRenamed("_k0", "month"),
    f"SELECT substr(orderdate, 1, 7) AS month, {COUNTS} FROM orders_doc GROUP BY 1",
)
FIELDS = ["taxes", "totalfreight", "grosstotalfreight", "distance_num"]
AVG = "CAST({0} AS DOUBLE)"


def avg_sql(f: str) -> str:
    return f"CAST(sum(CAST({f} AS DECIMAL(38,6))) AS DOUBLE) / count({f})"


register(
    "field_aggs",
    lambda o: metrics.field_aggs(o, FIELDS),
    " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS n, round({SUM.format(f)}, 4) AS sum, round({avg_sql(f)}, 4) AS avg, min({f}) AS min, max({f}) AS max FROM orders_doc" for f in FIELDS),
)


def formula_sql(ids: tuple[str, ...] | None, where: str = "true") -> str:
    parts = []
    for name, kind, f in FORMULAS:
        if ids is not None and name not in ids:
            continue
        stats, sums = "NULL, NULL, NULL", []
        if kind == "count":
            value, text = "CAST(count(*) AS DOUBLE)", "COUNT(orders)"
        elif kind == "sum":
            value, text, stats = SUM.format(f), f"SUM({f})", f"round({avg_sql(f)}, 4), round(CAST(min({f}) AS DOUBLE), 4), round(CAST(max({f}) AS DOUBLE), 4)"
        elif kind == "avg":
            value, text = avg_sql(f), f"AVG({f})"
        else:
            value, text = " ".join(SUM.format(w[4:]) if w.startswith("sum_") else w for w in f.split()), f.replace("sum_", "")
            sums = [f"round({SUM.format(w[4:])}, 4)" for w in f.split() if w.startswith("sum_")]
        parts.append(f"SELECT '{name}' AS formula, round({value}, 4) AS value, '{text}' AS text, {stats}, CAST([{', '.join(sums)}] AS DOUBLE[]) AS components FROM orders_doc WHERE {where}")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") t(formula, value, text, avg, min, max, components)"


register("formulas_all", metrics.run_formulas, formula_sql(None))
register("formula_default_bundle", lambda o: metrics.run_formulas(o, DEFAULT_FORMULAS), formula_sql(DEFAULT_FORMULAS))
register("formula_net_after_tax", lambda o: metrics.run_formulas(o, ("net_after_tax_estimate",)), formula_sql(("net_after_tax_estimate",)))
register("formula_freight_plus_fuel", lambda o: metrics.run_formulas(o, ("freight_plus_fuel",)), formula_sql(("freight_plus_fuel",)))
register("formula_filtered", lambda o: metrics.run_formulas(o, None, order_filter(companycode="BUILDING", currencycode="USD")), formula_sql(None, "lower(companycode) = 'building' AND currencycode = 'USD'"))


# namespaces: the orders of each company are one, and each has a marker
def stored_rows(o: DataFrame) -> DataFrame:
    rows = o.withColumn("namespace", F.when(F.col("orderid") % 17 > 0, F.col("companycode")))
    markers = rows.select("namespace").distinct().select("namespace", F.lit("setup").alias("doc_type"))
    return rows.select("namespace", "doc_type").unionByName(markers)


register(
    "namespace_counts",
    lambda o: metrics.namespace_counts(stored_rows(o)),
    "r AS (SELECT CASE WHEN orderid % 17 > 0 THEN companycode END AS namespace FROM orders_doc), c AS (SELECT namespace, count(*) AS n FROM r GROUP BY 1)"
    " SELECT namespace, false AS whole, n, 1 AS markers FROM c UNION ALL SELECT NULL, true, sum(n), count(*) FROM c",
)


def replaced(o: DataFrame) -> DataFrame:
    """All orders by company; then one company's even ids replace it, another one's go, and a third one's stand twice."""
    rows = o.select("orderid", F.col("companycode").alias("namespace"))
    table = Stored(o.sparkSession, scratch(o.sparkSession), "orderid long, namespace string")
    table.write(rows)
    table.write(rows.filter("namespace = 'BUILDING' and orderid % 2 = 0"), values=["BUILDING"])
    table.write(rows.limit(0), values=["MACHINERY"])
    table.write(rows.filter("namespace = 'FURNITURE'"), replace=False)
    table.vacuum()
    return table.read()


register(
    "sink_replace_namespace",
    replaced,
    "SELECT orderid, companycode AS namespace FROM orders_doc WHERE companycode <> 'MACHINERY' AND (companycode <> 'BUILDING' OR orderid % 2 = 0) UNION ALL SELECT orderid, companycode FROM orders_doc WHERE companycode = 'FURNITURE'",
)
