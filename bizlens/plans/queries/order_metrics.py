"""Section C queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizlens.operators import order_metrics as om
from bizlens.plans.bindings import Tables


def order_list(spark, sf):
    return Tables(spark, sf).orders().select(
        "business_id", "order_id", F.col("date").alias("day"),
        F.when(F.col("order_id") % 29 != 0, F.col("buyer_ref")).alias("customer"), F.col("total").alias("revenue"))


def raw_lines(spark, sf):
    t = Tables(spark, sf)
    return t.read("lineitem").select(
        F.concat(F.when(F.col("l_returnflag") == "R", "C").otherwise(""), F.col("l_orderkey").cast("string")).alias("invoice"),
        F.when(F.col("l_partkey") % 37 == 0, "POST").otherwise(F.concat(F.lpad(F.col("l_partkey").cast("string"), 5, "0"), F.lit("A"))).alias("stock_code"),
        F.when(F.col("l_suppkey") % 41 == 0, 0).otherwise(F.col("l_quantity")).cast("decimal(10,0)").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(14,2)").alias("price"),
        F.when(F.col("l_orderkey") % 23 == 0, "").otherwise(F.col("l_orderkey").cast("string")).alias("customer_id"),
        F.col("l_shipdate").cast("date").alias("day"))


def seller_orders(spark, sf):
    s, p = F.col("l_suppkey").cast("string"), F.col("l_partkey")
    seller = (F.when(F.col("l_suppkey") % 4 == 0, s).when(F.col("l_suppkey") % 4 == 1, F.concat_ws("-", s, (p % 4).cast("string")))
              .when(F.col("l_suppkey") % 4 == 2, F.concat_ws("-", s, (p % 20).cast("string"))).otherwise(F.concat_ws("-", s, p.cast("string"))))
    return Tables(spark, sf).read("lineitem").select(seller.alias("seller"), F.col("l_orderkey").alias("order_id"))


def customer_orders(spark, sf):
    return Tables(spark, sf).read("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer"))


def deliveries(spark, sf):
    o = Tables(spark, sf).read("orders").where(F.col("o_orderstatus") == "F")
    days = (F.col("o_orderkey") % 30) + (F.col("o_custkey") % 24) / F.lit(24.0)
    return o.select(F.col("o_orderkey").alias("order_id"), days.alias("days"), (days > 25).alias("late"))


def reviews(spark, sf):
    t = Tables(spark, sf)
    return t.read("labels").join(t.read("documents").select("doc_id", "n_chars"), "doc_id").select(
        (F.lit(1) + 2 * F.col("quality") + (1 - F.col("toxic"))).alias("score"), (F.col("n_chars") >= 500).alias("has_comment"))


def priced_items(spark, sf):
    price = F.col("l_extendedprice").cast("decimal(14,2)")
    return Tables(spark, sf).read("lineitem").select(price.alias("price"), (price * F.col("l_tax").cast("decimal(4,2)")).alias("freight"))


def categories(spark, sf):
    t = Tables(spark, sf)
    lines = t.read("lineitem").groupBy(F.col("l_partkey").alias("part_id")).agg(F.count(F.lit(1)).alias("lines"))
    parts = t.read("part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("category"))
    return om.top_categories(lines, parts)


def category_counts(spark, sf):
    o = Tables(spark, sf).read("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    status = o.groupBy(F.lit("status").alias("kind"), F.col("o_orderstatus").alias("value")).agg(F.sum("n").alias("orders"))
    return status.unionByName(o.groupBy(F.lit("payment").alias("kind"), F.col("o_orderpriority").alias("value")).agg(F.sum("n").alias("orders")))


def sessions(spark, sf):
    e = Tables(spark, sf).events().groupBy("user_id", "day").agg(
        (F.count(F.lit(1)) * 5).alias("pages"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("buys"),
        F.count(F.when(F.col("event_type") == "click", 1)).alias("clicks"))
    first = e.groupBy("user_id").agg(F.min("day").alias("first_day"))
    return e.join(first, "user_id").select(
        F.when(F.col("day") == F.col("first_day"), "New_Visitor").otherwise("Returning_Visitor").alias("visitor_type"),
        F.when(F.col("clicks") > 0, "page_value > 0").otherwise("page_value = 0").alias("page_value"),
        F.when(F.col("pages") < 10, "0-9 product pages").when(F.col("pages") < 50, "10-49").otherwise("50+").alias("pages_viewed"),
        F.when(F.col("pages") > 5, "bounce rate = 0").otherwise("bounce rate > 0").alias("bounce"),
        F.when(F.dayofweek("day").isin(1, 7), "weekend").otherwise("weekday").alias("day_kind"), (F.col("buys") > 0).alias("converted"))


QUERIES = {
    "c01_totals": lambda s, d: om.totals(order_list(s, d)),
    "c02_repeat_customers": lambda s, d: om.repeat_customers(order_list(s, d)),
    "c03_days_between_orders": lambda s, d: om.days_between_orders(order_list(s, d)),
    "c04_c06_concentration": lambda s, d: om.concentration(order_list(s, d)),
    "c05_pareto_share": lambda s, d: om.pareto_share(order_list(s, d)),
    "c07_monthly": lambda s, d: om.monthly(order_list(s, d)),
    "c08_line_quality": lambda s, d: om.line_quality(raw_lines(s, d)),
    "c08_line_rollup": lambda s, d: om.orders_from_lines(raw_lines(s, d)).select(
        "order_id", F.col("day").cast("string").alias("day"), "customer", F.col("revenue").cast("double").alias("revenue")),
    "c10_seller_size": lambda s, d: om.seller_size(seller_orders(s, d)),
    "c11_repeat_by_band": lambda s, d: om.repeat_by_scope(customer_orders(s, d), om.band_orders(seller_orders(s, d), "50-500")),
    "c12_delivery": lambda s, d: om.delivery(deliveries(s, d), om.band_orders(seller_orders(s, d), "50-500")),
    "c13_score_distribution": lambda s, d: om.score_distribution(reviews(s, d)),
    "c14_price_profile": lambda s, d: om.price_profile(priced_items(s, d)),
    "c14_top_categories": categories,
    "c15_category_counts": category_counts,
    "c16_conversion_by_segment": lambda s, d: om.conversion_by_segment(sessions(s, d)),
    "c16_conversion_lifts": lambda s, d: om.conversion_lifts(om.conversion_by_segment(sessions(s, d))),
}
