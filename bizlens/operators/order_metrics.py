"""Order-list metrics per business and profiles of marketplace-like corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizlens.functions.numbers import half_even, ratio
from bizlens.operators.skew import exact_quantiles, two_level_cumsum

BUSINESS = "business_id"


def per_customer(orders: DataFrame) -> DataFrame:
    """One row per linked customer; every customer metric starts here, so raw orders are shuffled once."""
    return orders.where(F.col("customer").isNotNull()).groupBy(BUSINESS, "customer").agg(
        F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("spent"))


def totals(orders: DataFrame) -> DataFrame:
    """Orders, unlinked orders, customers, revenue, average order value, first and last day."""
    base = orders.groupBy(BUSINESS).agg(
        F.count(F.lit(1)).alias("orders"), F.count(F.when(F.col("customer").isNull(), 1)).alias("orders_without_customer"),
        F.sum("revenue").alias("revenue"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    customers = per_customer(orders).groupBy(BUSINESS).agg(F.count(F.lit(1)).alias("customers"))
    return base.join(customers, BUSINESS, "left").select(
        BUSINESS, "orders", "orders_without_customer", F.coalesce("customers", F.lit(0)).alias("customers"),
        half_even(F.col("revenue"), 2).alias("revenue_total"),
        half_even(ratio(F.col("revenue"), F.col("orders")), 2).alias("average_order_value"),
        F.col("first_day").cast("string").alias("first_order"), F.col("last_day").cast("string").alias("last_order"))


def repeat_customers(orders: DataFrame, keys: tuple = (BUSINESS,)) -> DataFrame:
    per = orders.where(F.col("customer").isNotNull()).groupBy(*keys, "customer").agg(F.count(F.lit(1)).alias("n"))
    agg = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("customers"), F.count(F.when(F.col("n") >= 2, 1)).alias("repeat_customers"))
    return agg.withColumn("repeat_customer_share", half_even(ratio(F.col("repeat_customers"), F.col("customers")), 4))


def order_gaps(orders: DataFrame, keys: tuple = (BUSINESS,), customer: str = "customer", day: str = "day") -> DataFrame:
    """Days between a customer's consecutive orders as (gap, how often), with the later day.

    Orders are counted per customer and day first: the window then holds days, never one customer's every order.
    """
    days = orders.where(F.col(customer).isNotNull()).groupBy(*keys, customer, day).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys, customer).orderBy(day)
    days = days.withColumn("gap", F.datediff(F.col(day), F.lag(day).over(w)))
    steps = days.select(*keys, day, F.explode(F.array(
        F.struct(F.col("gap"), F.lit(1).cast("bigint").alias("times")),
        F.struct(F.lit(0).alias("gap"), (F.col("n") - 1).alias("times")))).alias("s"))
    return steps.select(*keys, day, "s.gap", "s.times").where(F.col("gap").isNotNull() & (F.col("times") > 0))


def days_between_orders(orders: DataFrame) -> DataFrame:
    """Median and interpolated 90th percentile; gaps are whole days, so `percentile` keeps a small count table."""
    gaps = order_gaps(orders).groupBy(BUSINESS, "gap").agg(F.sum("times").alias("times"))
    q = gaps.groupBy(BUSINESS).agg(F.percentile("gap", F.array(F.lit(0.5), F.lit(0.9)), F.col("times")).alias("q"), F.sum("times").alias("gaps"))
    return q.select(BUSINESS, "gaps", F.col("q")[0].alias("median_days"), half_even(F.col("q")[1], 6).alias("p90_days"))


def concentration(orders: DataFrame, top: int = 10) -> DataFrame:
    """Revenue share of the best and the ten best customers, with the one-client alert.

    The rank filter is applied before the shuffle (window group limit), so at most `top` rows a task are moved.
    """
    per = per_customer(orders)
    w = Window.partitionBy(BUSINESS).orderBy(F.col("spent").desc(), F.col("customer"))
    best = per.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= top)
    tops = best.groupBy(BUSINESS).agg(F.sum(F.when(F.col("pos") == 1, F.col("spent"))).alias("t1"), F.sum("spent").alias("tk"))
    linked = per.groupBy(BUSINESS).agg(F.sum("spent").alias("linked"))
    share1 = half_even(ratio(F.col("t1"), F.col("linked")), 4)
    return linked.join(tops, BUSINESS).select(
        BUSINESS, share1.alias("top_1"), half_even(ratio(F.col("tk"), F.col("linked")), 4).alias("top_10"),
        F.coalesce(share1 > 0.30, F.lit(False)).alias("single_customer_over_30pct"))


def pareto_share(orders: DataFrame, part: float = 0.8) -> DataFrame:
    """Smallest share of customers whose revenue reaches `part` of the total."""
    equal = per_customer(orders).groupBy(BUSINESS, "spent").agg(F.count(F.lit(1)).alias("n"))
    equal = equal.withColumn("sum", F.col("spent") * F.col("n").cast("decimal(12,0)"))
    run = two_level_cumsum(equal, [BUSINESS], "spent", {"cum": "sum", "seen": "n"}, descending=True)
    goal = F.col("cum_all") * F.lit(str(part)).cast("decimal(3,2)")
    before = F.col("cum") - F.col("sum")
    need = F.ceil((goal - before).cast("double") / F.col("spent").cast("double"))
    hit = run.where((F.col("cum") >= goal) & (before < goal))
    return hit.select(BUSINESS, half_even(ratio(F.col("seen") - F.col("n") + need, F.col("seen_all")), 4).alias("customer_share_for_80pct"))


def monthly(orders: DataFrame) -> DataFrame:
    return orders.groupBy(BUSINESS, F.date_format("day", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("revenue").alias("r")).select(
        BUSINESS, "month", "orders", half_even(F.col("r"), 2).alias("revenue"))


# ---------------------------------------------------------------- line lists
def line_class() -> Column:
    """Why a raw line is not a sale; tested in this order."""
    return (F.when(F.upper(F.col("invoice")).startswith("C"), "cancellation")
            .when(~F.col("stock_code").rlike("^[0-9]{5}"), "non_product")
            .when((F.col("quantity") <= 0) | (F.col("price") <= 0), "non_positive")
            .otherwise("sale"))


def line_quality(lines: DataFrame) -> DataFrame:
    kind = line_class()
    blank = F.coalesce(F.trim("customer_id"), F.lit("")) == ""
    return lines.agg(
        F.count(F.lit(1)).alias("lines"), F.count(F.when(kind == "cancellation", 1)).alias("cancellation_lines"),
        F.count(F.when(kind == "non_product", 1)).alias("non_product_lines"),
        F.count(F.when(kind == "non_positive", 1)).alias("non_positive_quantity_or_price_lines"),
        F.count(F.when((kind == "sale") & blank, 1)).alias("missing_customer_id_lines"))


def orders_from_lines(lines: DataFrame) -> DataFrame:
    sales = lines.where(line_class() == "sale")
    blank = F.when(F.trim("customer_id") != "", F.trim("customer_id"))
    return sales.groupBy(F.col("invoice").alias("order_id")).agg(
        F.min("day").alias("day"), F.max(blank).alias("customer"), F.sum(F.col("quantity") * F.col("price")).alias("revenue"))


# ---------------------------------------------------------------- marketplace profile
def seller_band(n: Column) -> Column:
    return F.when(n < 10, "<10").when(n < 50, "10-49").when(n <= 500, "50-500").otherwise(">500")


def sellers(seller_orders: DataFrame) -> DataFrame:
    return seller_orders.distinct().groupBy("seller").agg(F.count(F.lit(1)).alias("orders")).withColumn("band", seller_band(F.col("orders")))


def seller_size(seller_orders: DataFrame) -> DataFrame:
    """Sellers and seller orders per band, with the overall median of orders per seller."""
    per = sellers(seller_orders)
    bands = per.groupBy("band").agg(F.count(F.lit(1)).alias("sellers"), F.sum("orders").alias("seller_orders"))
    median = exact_quantiles(per, [], "orders", {"median_orders_per_seller": 0.5})
    whole = bands.agg(F.sum("seller_orders").alias("all_orders"))  # one row, as is the median
    return bands.crossJoin(F.broadcast(median)).crossJoin(F.broadcast(whole)).select(
        "band", "sellers", "seller_orders", "median_orders_per_seller",
        half_even(ratio(F.col("seller_orders"), F.col("all_orders")), 4).alias("order_share"))


def band_orders(seller_orders: DataFrame, band: str) -> DataFrame:
    """Order ids that hold at least one seller of the band."""
    inside = sellers(seller_orders).where(F.col("band") == band).select("seller")
    return seller_orders.join(inside, "seller", "left_semi").select("order_id").distinct()


def repeat_by_scope(orders: DataFrame, in_band: DataFrame) -> DataFrame:
    scoped = orders.withColumn("scope", F.lit("all_customers")).unionByName(
        orders.join(in_band, "order_id", "left_semi").withColumn("scope", F.lit("customers_of_band")))
    return repeat_customers(scoped, ("scope",))


def delivery(orders: DataFrame, in_band: DataFrame) -> DataFrame:
    """Late share, median and p90 delivery days, overall and for the band."""
    marked = orders.withColumn("scope", F.lit("all")).unionByName(
        orders.join(in_band, "order_id", "left_semi").withColumn("scope", F.lit("band")))
    base = marked.groupBy("scope").agg(F.count(F.lit(1)).alias("delivered_orders"), F.count(F.when(F.col("late"), 1)).alias("late"))
    q = exact_quantiles(marked, ["scope"], "days", {"median": 0.5, "p90": 0.9})
    return base.join(q, "scope").select(
        "scope", "delivered_orders", half_even(ratio(F.col("late"), F.col("delivered_orders")), 4).alias("late_share"),
        half_even(F.col("median"), 4).alias("delivery_days_median"), half_even(F.col("p90"), 4).alias("delivery_days_p90"))


def score_distribution(reviews: DataFrame) -> DataFrame:
    """(score, reviews) with the overall mean, low-score share and with-comment share on each row."""
    per = reviews.groupBy("score").agg(F.count(F.lit(1)).alias("reviews"), F.count(F.when(F.col("has_comment"), 1)).alias("c"))
    whole = per.agg(F.sum("reviews").alias("n"), F.sum(F.col("score") * F.col("reviews")).alias("s"),
                    F.sum(F.when(F.col("score") <= 2, F.col("reviews"))).alias("low"), F.sum("c").alias("com"))
    return per.crossJoin(F.broadcast(whole)).select(
        F.col("score").cast("bigint").alias("score"), "reviews", half_even(ratio(F.col("s"), F.col("n")), 4).alias("mean_score"),
        half_even(ratio(F.coalesce("low", F.lit(0)), F.col("n")), 4).alias("low_score_share"),
        half_even(ratio(F.col("com"), F.col("n")), 4).alias("with_comment_share"))


def price_profile(items: DataFrame) -> DataFrame:
    q = exact_quantiles(items, [], "price", {"price_median": 0.5, "price_p90": 0.9})
    m = items.agg(F.sum("freight").alias("f"), F.sum("price").alias("p"), F.count(F.lit(1)).alias("n"))
    return q.crossJoin(F.broadcast(m)).select(
        half_even(F.col("price_median"), 4).alias("price_median"), half_even(F.col("price_p90"), 4).alias("price_p90"),
        half_even(ratio(F.col("f"), F.col("n")), 4).alias("mean_freight"),
        half_even(ratio(F.col("f"), F.col("p")), 4).alias("freight_share"))


def top_categories(line_counts: DataFrame, parts: DataFrame, k: int = 8) -> DataFrame:
    """Largest categories by lines; lines are counted per part before the join."""
    return line_counts.join(parts, "part_id").groupBy("category").agg(F.sum("lines").alias("lines")).orderBy(
        F.col("lines").desc(), "category").limit(k)


SEGMENTS = ("visitor_type", "page_value", "pages_viewed", "bounce", "day_kind")


def conversion_by_segment(sessions: DataFrame) -> DataFrame:
    """Five segmentations and the overall row in one pass.

    Sessions collapse to the few combinations of segment values first; the grouping sets expand only those.
    """
    combos = sessions.groupBy(*SEGMENTS).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("converted"), 1)).alias("p"))
    sets = [[F.col(s)] for s in SEGMENTS] + [[]]
    g = combos.groupingSets(sets, *[F.col(s) for s in SEGMENTS]).agg(F.sum("n").alias("sessions"), F.sum("p").alias("purchases"),
                                                                    *[F.grouping(s).alias(f"_g_{s}") for s in SEGMENTS])
    seg, val = F.lit("overall"), F.lit("all")
    for s in SEGMENTS:
        seg = F.when(F.col(f"_g_{s}") == 0, s).otherwise(seg)
        val = F.when(F.col(f"_g_{s}") == 0, F.col(s)).otherwise(val)
    return g.select(seg.alias("segment"), val.alias("value"), "sessions", "purchases",
                    half_even(ratio(F.col("purchases"), F.col("sessions")), 4).alias("conversion"))


def conversion_lifts(by_segment: DataFrame) -> DataFrame:
    def conv(seg, val):
        return F.max(F.when((F.col("segment") == seg) & (F.col("value") == val), F.col("conversion")))

    c = by_segment.agg(conv("visitor_type", "New_Visitor").alias("a"), conv("visitor_type", "Returning_Visitor").alias("b"),
                       conv("page_value", "page_value > 0").alias("c"), conv("page_value", "page_value = 0").alias("d"))
    return c.select(half_even(ratio(F.col("a"), F.col("b")), 3).alias("new_vs_returning_conversion_ratio"),
                    half_even(ratio(F.col("c"), F.col("d")), 1).alias("page_value_lift"))
