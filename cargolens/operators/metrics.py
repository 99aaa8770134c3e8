"""Counts, totals and averages over orders, each in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.addresses import order_parts, shown
from ..schema import FORMULAS, KNOWN_STATUSES
from .filters import any_of, mentions_country, side_columns
from .orders import with_numbers

MONEY = "decimal(38,6)"


def total(column: str) -> Column:
    """A sum that does not depend on the order of its rows; nothing sums to 0."""
    return F.coalesce(F.sum(F.col(column).cast(MONEY)), F.lit(0).cast(MONEY)).cast("double")


def status_of(column: str = "orderstatus") -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("Unknown"))


def status_summary(orders: DataFrame) -> DataFrame:
    """(status, n): the known statuses even without orders, then any others."""
    spark = orders.sparkSession
    known = spark.createDataFrame([(s,) for s in KNOWN_STATUSES], "status string")
    counted = orders.groupBy(status_of().alias("status")).agg(F.count(F.lit(1)).alias("n"))
    zero = known.withColumn("n", F.lit(0).cast("long"))
    return counted.unionByName(zero).groupBy("status").agg(F.sum("n").alias("n"))


def geo_counts(orders: DataFrame, by: str = "state", side: str = "both", limit: int = 50, canonical: bool = False) -> DataFrame:
    """Orders by (country, state) or (city, state, country), most first; ``groups`` is the number before the limit.

    Addresses are grouped in lower case and only the groups get their shown form. The number
    of groups needs their counts too, so that both branches share one exchange.
    """
    keys = ["country", "state"] if by == "state" else ["city", "state", "country"]
    g = orders.select(order_parts(side, canonical).alias("g")).filter("g is not null").select("g.*")
    counted = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    look = shown({k: F.col(k) if k in keys else F.lit(None).cast("string") for k in ("city", "state", "country")}, canonical)
    counted = counted.select(*(look[k].alias(k) for k in keys), "n")
    if canonical:  # different spellings of a state
        counted = counted.groupBy(*keys).agg(F.sum("n").alias("n"))
    groups = counted.agg(F.count_if(F.col("n") > 0).alias("groups"))
    top = counted.orderBy(F.desc("n"), *keys).limit(min(100, max(1, limit)))
    return top.crossJoin(F.broadcast(groups))  # one row


def orders_in_period(orders: DataFrame, as_of: str, days: int = 30, status: str | None = None, date_field: str = "orderdate") -> DataFrame:
    """(status, n, matching): all statuses of the period; ``matching`` counts only the asked one."""
    day = F.to_date(F.substring(date_field, 1, 10))
    since = F.date_sub(F.lit(as_of).cast("date"), max(1, days))
    hit = F.lit(True) if status is None else F.col("orderstatus") == status
    return (
        orders.filter(day >= since)
        .groupBy(status_of().alias("status"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("matching"))
    )


def trip_distance(orders: DataFrame, as_of: str | None = None, days: int | None = None) -> DataFrame:
    o = with_numbers(orders)
    if days is not None:
        o = o.filter(F.to_date(F.substring("orderdate", 1, 10)) >= F.date_sub(F.lit(as_of).cast("date"), max(1, days)))
    full = lambda c: F.count_if(F.col(c).isNotNull() & (F.col(c) != ""))
    return o.agg(
        F.count(F.lit(1)).alias("orders"),
        full("tripno").alias("orders_with_trip"),
        full("distance_raw").alias("orders_with_distance"),
        F.round(total("distance_num"), 4).alias("total_distance"),
    )


def customer_totals(orders: DataFrame) -> DataFrame:
    return (
        orders.filter(F.col("customername").isNotNull() & (F.col("customername") != ""))
        .groupBy("customername")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.round(total("grosstotalfreight"), 4).alias("revenue"),
            F.round(total("totalfreight"), 4).alias("freight"),
        )
    )


def rank_customers(orders: DataFrame, metric: str = "orders", direction: str = "best", limit: int = 5) -> DataFrame:
    keys = ["revenue", "orders"] if metric == "revenue" else ["orders", "revenue"]
    order = [F.col(k).asc() if direction == "worst" else F.col(k).desc() for k in keys]
    return customer_totals(orders).orderBy(*order, "customername").limit(min(20, max(1, limit)))


def in_country(country: str, side: str = "both") -> Column:
    return any_of(side_columns(side, names=True), mentions_country(country))


def customer_activity(orders: DataFrame, where: Column) -> DataFrame:
    """One row: matching orders and the number of different named customers among them."""
    return orders.filter(where).agg(
        F.count(F.lit(1)).alias("matching_orders"),
        F.countDistinct(F.nullif(F.col("customername"), F.lit(""))).alias("distinct_customers"),
    )


def top_customers(orders: DataFrame, where: Column, limit: int = 10) -> DataFrame:
    return (
        orders.filter(where & F.col("customername").isNotNull() & (F.col("customername") != ""))
        .groupBy("customername")
        .agg(F.count(F.lit(1)).alias("orders"))
        .orderBy(F.desc("orders"), "customername")
        .limit(limit)
    )


def activity_daily(orders: DataFrame, date_field: str = "orderdate") -> DataFrame:
    """(day, matching_orders, distinct_customers) for all days: the day in the stored offset."""
    return orders.groupBy(F.substring(date_field, 1, 10).alias("day")).agg(
        F.count(F.lit(1)).alias("matching_orders"),
        F.countDistinct(F.nullif(F.col("customername"), F.lit(""))).alias("distinct_customers"),
    )


def customer_numbers(orders: DataFrame, ranges: int = 256) -> DataFrame:
    """(customername, number): every named customer by a number of its own, from 0 without gaps, inside ranges of a hash."""
    names = orders.filter(F.coalesce("customername", F.lit("")) != "").select("customername").distinct()
    names = names.withColumn("_range", F.pmod(F.xxhash64("customername"), F.lit(ranges)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # ``ranges`` rows
    starts = names.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("customername")) - 1
    return names.join(F.broadcast(starts), "_range").select("customername", (F.col("_from") + own).alias("number"))


def activity_bitmaps(orders: DataFrame, numbers: DataFrame, date_field: str = "orderdate") -> DataFrame:
    """(day, bucket, matching_orders, customers): orders of each day, and its customers as exact bitmaps over their numbers.

    Bitmaps of days can be stored and merged: the different customers of any set of days follow
    from these rows, without the orders. Orders without a customer are in a bucket of their own.
    """
    o = orders.select(F.substring(date_field, 1, 10).alias("day"), "customername").join(numbers, "customername", "left")
    number = F.col("number")
    rows = o.select("day", F.coalesce(F.bitmap_bucket_number(number), F.lit(-1)).alias("bucket"), F.bitmap_bit_position(number).alias("bit"))
    return rows.groupBy("day", "bucket").agg(F.count(F.lit(1)).alias("matching_orders"), F.bitmap_construct_agg("bit").alias("customers"))


def activity_over(bitmaps: DataFrame, *keys: Column) -> DataFrame:
    """(*keys, matching_orders, distinct_customers) from bitmaps of days, for keys that days have, such as a month."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    merged = bitmaps.select("*", *named).groupBy(*names, "bucket").agg(F.sum("matching_orders").alias("n"), F.bitmap_or_agg("customers").alias("c"))
    found = F.when(F.col("bucket") >= 0, F.bitmap_count("c")).otherwise(0)
    return merged.groupBy(*names).agg(F.sum("n").alias("matching_orders"), F.sum(found).alias("distinct_customers"))


def field_aggs(orders: DataFrame, fields: list[str], where: Column | None = None) -> DataFrame:
    """(field, n, sum, avg, min, max) of several fields, in one pass over the orders."""
    o = with_numbers(orders)
    o = o if where is None else o.filter(where)
    stats = [
        F.struct(
            F.lit(f).alias("field"),
            F.count(F.lit(1)).alias("n"),
            F.round(total(f), 4).alias("sum"),
            F.round(F.avg(F.col(f).cast(MONEY)).cast("double"), 4).alias("avg"),
            F.min(f).alias("min"),
            F.max(f).alias("max"),
        )
        for f in fields
    ]
    return o.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def run_formulas(orders: DataFrame, ids: tuple[str, ...] | None = None, where: Column | None = None) -> DataFrame:
    """(formula, value, text, avg, min, max, components) of the asked formulas, or all, from one aggregate.

    ``text`` is the formula as SQL. Average and extremes of the field go with sums, the sums
    that an expression is made of, in its order, go with expressions. Expressions are over
    ``sum_<field>``; other names are refused.
    """
    chosen = [f for f in FORMULAS if ids is None or f[0] in ids]
    o = with_numbers(orders)
    o = o if where is None else o.filter(where)
    fields = {f for _, kind, f in chosen if kind in ("sum", "avg")}
    for _, kind, text in chosen:
        if kind == "expression":
            names = [w for w in text.replace("(", " ").replace(")", " ").split() if w not in "+-*/"]
            if not all(n.startswith("sum_") and n.isidentifier() for n in names):
                raise ValueError(f"unknown name in {text!r}")
            fields |= {n[4:] for n in names}
    aggs = [F.count(F.lit(1)).cast("double").alias("order_count")]
    for f in sorted(fields):
        aggs += [total(f).alias(f"sum_{f}"), F.avg(F.col(f).cast(MONEY)).cast("double").alias(f"avg_{f}")]
        aggs += [F.min(f).cast("double").alias(f"min_{f}"), F.max(f).cast("double").alias(f"max_{f}")]
    value = lambda kind, f: F.expr("order_count" if kind == "count" else f if kind == "expression" else f"{kind}_{f}")
    four = lambda c: F.round(c, 4)
    none = F.lit(None).cast("double")

    def row(name: str, kind: str, f: str | None) -> Column:
        stats = {s: four(F.col(f"{s}_{f}")) if kind == "sum" else none for s in ("avg", "min", "max")}
        parts = [four(F.col(w)) for w in f.split() if w.startswith("sum_")] if kind == "expression" else []
        text = "COUNT(orders)" if kind == "count" else f.replace("sum_", "") if kind == "expression" else f"{kind.upper()}({f})"
        return F.struct(
            F.lit(name).alias("formula"), four(value(kind, f)).alias("value"), F.lit(text).alias("text"),
            *(c.alias(s) for s, c in stats.items()), F.array(*parts).cast("array<double>").alias("components"),
        )

    return o.agg(*aggs).select(F.inline(F.array(*(row(*c) for c in chosen))))


def namespace_counts(documents: DataFrame) -> DataFrame:
    """(namespace, whole, n, markers): stored orders and setup markers of each namespace, a null one included, and of all where ``whole`` is true."""
    return documents.rollup("namespace").agg(
        (F.grouping("namespace") == 1).alias("whole"),
        F.count_if(F.col("doc_type") == "order").alias("n"),
        F.count_if(F.coalesce(F.col("doc_type") != "order", F.lit(True))).alias("markers"),
    )
