"""The library's input tables, derived from the TPC-H-like tables, events and texts in a parquet folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bizlens.functions.numbers import money
from bizlens.sources.tables import spread_small

HISTORY_START = "1995-01-02"
ADVISORY_START = "2001-07-02"
LEAD_SHIFT_DAYS = 8246  # a multiple of 7: brings event dates into the order history
LEAD_SNAPSHOTS = ("2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29", "2024-02-05")

RELATIONSHIP_BY_SEGMENT = {"AUTOMOBILE": "friend", "BUILDING": "friend_of_friend", "FURNITURE": "stranger",
                           "MACHINERY": "friend", "HOUSEHOLD": "unknown"}
SIGNAL_BY_EVENT = {"view": "follow_or_like", "click": "comment", "signup": "saved_or_shared", "error": "story_reply",
                   "purchase": "price_question"}
INTENT_BY_EVENT = {"view": "general_praise", "click": "product_interest", "signup": "product_interest",
                   "error": "custom_request", "purchase": "buying_question"}


def lookup(column, mapping: dict, default=None):
    """CASE over a small fixed mapping."""
    expr = None
    for k, v in mapping.items():
        expr = F.when(column == k, v) if expr is None else expr.when(column == k, v)
    return expr.otherwise(F.lit(default)) if default is not None else expr


def week_of(day):
    return F.trunc(day, "week")


class Tables:
    """Lazy views over one parquet folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # ------------------------------------------------------------------ sellers, orders, posts
    def businesses(self) -> DataFrame:
        return self.read("nation").select(F.col("n_regionkey").cast("bigint").alias("business_id")).distinct()

    def order_business(self) -> DataFrame:
        """Every order with its business (all statuses). nation has 25 fixed rows."""
        cust = self.read("customer").join(F.broadcast(self.read("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
        cust = cust.select(F.col("c_custkey"), F.col("n_regionkey").cast("bigint").alias("business_id"), "c_mktsegment")
        return self.read("orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
            "business_id", "c_mktsegment", F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("buyer_ref"),
            F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").alias("date"),
            F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("o_totalprice"))

    def items(self) -> DataFrame:
        """One priced item per order line; money as DECIMAL."""
        price = money(F.col("l_extendedprice"))
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part_id"),
            F.col("l_quantity").cast("bigint").alias("qty"), price.alias("gross"),
            money(price * F.col("l_discount").cast("decimal(4,2)")).alias("discount"),
            money(price * (F.lit(40).cast("decimal(4,0)") + 2 * (F.col("l_partkey") % 10).cast("decimal(4,0)")) / 100).alias("cost"))

    def orders(self, with_money: bool = True) -> DataFrame:
        """Order records: one row per order with its money totals (zero, and no join with the lines, where not wanted)."""
        base = self.order_business().where(F.col("status") != "P")
        zero = F.lit(0).cast("decimal(18,4)")
        if with_money:
            totals = self.items().groupBy("order_id").agg(
                F.sum("qty").alias("qty"), money(F.sum("gross")).alias("gross"), money(F.sum("discount")).alias("discount"),
                money(F.sum("cost")).alias("cost"))
            base = base.join(totals, "order_id", "left")
        else:
            base = base.select("*", F.lit(0).cast("bigint").alias("qty"), *[zero.alias(c) for c in ("gross", "discount", "cost")])
        return base.select(
            "business_id", "order_id", "date", "buyer_ref",
            lookup(F.col("c_mktsegment"), RELATIONSHIP_BY_SEGMENT).alias("relationship"),
            F.col("priority").alias("channel"), "status",
            F.coalesce("qty", F.lit(0)).alias("qty"), F.coalesce("gross", zero).alias("gross"),
            F.coalesce("discount", zero).alias("discount"), F.coalesce("cost", zero).alias("cost"),
            money(F.coalesce("gross", zero) - F.coalesce("discount", zero)).alias("total"),
            F.date_add("date", (F.col("order_id") % 7).cast("int")).alias("dispatched_at"),
            F.when(F.col("order_id") % 4 == 0, F.concat_ws("_", F.lit("post"), "business_id",
                                                           week_of(F.col("date")).cast("string"), F.lit("0"))).alias("post_id"))

    def turned_away(self) -> DataFrame:
        return self.order_business().where((F.col("status") == "P") & (F.col("order_id") % 2 == 0)).select(
            "business_id", "date", F.lit("over capacity").alias("reason"))

    def stockouts(self) -> DataFrame:
        return self.order_business().where((F.col("status") == "P") & (F.col("order_id") % 2 == 1)).select(
            "business_id", "date", F.concat(F.lit("item "), (F.col("order_id") % 10).cast("string")).alias("product"))

    def posts(self) -> DataFrame:
        lines = self.read("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").cast("date").alias("ship"),
            F.col("l_quantity").cast("bigint").alias("qty"), "l_returnflag", (F.col("l_partkey") % 3).alias("class"))
        owner = self.order_business().select("order_id", "business_id")
        flag = F.col("l_returnflag")
        grouped = lines.join(owner, "order_id").groupBy("business_id", week_of(F.col("ship")).alias("week"), "class").agg(
            (F.sum("qty") * 10).alias("reach"), F.coalesce(F.sum(F.when(flag == "R", F.col("qty"))), F.lit(0)).alias("profile_visits"),
            F.count(F.when(flag == "A", 1)).alias("follows"), F.count(F.when(flag == "N", 1)).alias("saves"))
        return grouped.select(
            "business_id", F.concat_ws("_", F.lit("post"), "business_id", F.col("week").cast("string"), F.col("class").cast("string")).alias("post_id"),
            F.date_add("week", (F.col("class") * 2).cast("int")).alias("date"), "reach", "profile_visits", "follows", "saves",
            F.concat(F.lit("topic "), F.col("class").cast("string")).alias("topic"))

    # ------------------------------------------------------------------ business profile
    def profile(self) -> DataFrame:
        b = F.col("business_id")
        return self.businesses().select(
            b, F.concat(F.lit("Shop "), b.cast("string")).alias("name"), (b + 8).alias("capacity"),
            F.when(b % 3 == 0, 500).otherwise(0).cast("bigint").alias("ad_budget_inr"),
            F.when(b % 3 == 0, F.array().cast("array<string>")).when(b == 4, F.array(F.lit("paid_ads"), F.lit("pricing"))).otherwise(F.array(F.lit("paid_ads"))).alias("forbidden_actions"),
            (F.lit(60) + b * 40).cast("bigint").alias("growth_minutes"),
            F.when(b % 2 == 0, "Pune").otherwise("Mumbai").alias("city"),
            F.array(F.lit("Pune"), F.lit("Mumbai"), F.lit("Delhi")).alias("serves_cities"),
            F.array(F.lit("S"), F.lit("M"), F.lit("L"), F.lit("XL")).alias("serves_sizes"),
            F.array(F.concat(F.lit("topic"), (b % 4).cast("string"))).alias("topics"),
            F.concat(F.lit("shop"), b.cast("string"), F.lit(".example/order")).alias("order_link"), F.lit("UPI").alias("payment"))

    def products(self) -> DataFrame:
        """One price per (business, product name), cost 55% to 75% of it; a product of business 4 has no known cost."""
        p = self.read("part").groupBy((F.col("p_partkey") % 5).alias("business_id"), F.col("p_name").alias("name")).agg(
            F.min("p_retailprice").alias("price"), F.min("p_partkey").alias("first_key"))
        return p.select("business_id", "name", "price", "first_key",
                        F.when((F.col("business_id") == 4) & (F.col("first_key") % 7 == 0), None).otherwise(
                            F.col("price") * (F.lit(55) + F.col("first_key") % 20) / 100).alias("unit_cost"))

    def partners(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.read("supplier").select(
            (k % 5).alias("business_id"), F.concat(F.lit("partner_"), k.cast("string")).alias("partner_id"), F.col("s_name").alias("name"),
            F.when(k % 3 == 0, "community").when(k % 3 == 1, "fan_page").otherwise("creator").alias("type"),
            F.array(F.concat(F.lit("topic"), (k % 4).cast("string")), F.concat(F.lit("topic"), (k % 7).cast("string"))).alias("topics"),
            F.when(k % 4 == 0, "Pune").when(k % 4 == 1, "Mumbai").when(k % 4 == 2, "Delhi").alias("city"),
            (F.lit(200) + (k * 37) % 5000).alias("followers"), ((k * 13) % 40).alias("avg_comments_per_post"),
            ((k * 7) % 25).alias("avg_shares_per_post"), F.when(k % 6 == 0, 800).otherwise(0).cast("bigint").alias("cost_inr"))

    def partner_results(self) -> DataFrame:
        """Stranger leads each past collaboration brought: one row per supplier and year."""
        return self.read("lineitem").groupBy(
            F.concat(F.lit("partner_"), F.col("l_suppkey").cast("string")).alias("partner_id"), F.year("l_shipdate").alias("collab")).agg(
            (F.count(F.lit(1)) % 9).alias("stranger_leads"))

    def snapshots(self) -> DataFrame:
        """(business, week number 1..4, as_of, history_start): the advisory weeks."""
        return self.businesses().select("business_id", F.explode(F.array(*[F.lit(i).cast("bigint") for i in (1, 2, 3, 4)])).alias("week_no")).select(
            "business_id", "week_no", F.date_add(F.lit(ADVISORY_START).cast("date"), ((F.col("week_no") - 1) * 7).cast("int")).alias("as_of"),
            F.lit(HISTORY_START).cast("date").alias("history_start"))

    # ------------------------------------------------------------------ leads
    def events(self) -> DataFrame:
        return self.read("events").select(
            "event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), F.col("ts").cast("date").alias("day"))

    def purchase_days(self) -> DataFrame:
        return self.events().where(F.col("event_type") == "purchase").select("user_id", "day").distinct()

    def leads(self) -> DataFrame:
        u = F.col("user_id")
        per_day = self.events().groupBy("user_id", "day").agg(
            F.max(F.when(F.col("event_type") == "click", 1).otherwise(0)).alias("clicked"),
            F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("custom"))
        later = self.purchase_days().select("user_id", F.date_sub("day", 2).alias("day"), F.lit(True).alias("buys"))
        return per_day.join(later, ["user_id", "day"], "left").select(
            (u % 5).alias("business_id"), lead_id(u, F.col("day")).alias("lead_id"), "user_id", F.col("day").alias("created"),
            F.concat(F.lit("@user_"), u.cast("string")).alias("handle_ref"),
            F.when(u % 3 == 0, "dm").when(u % 3 == 1, "comment").otherwise("story").alias("source"),
            F.when(u % 4 == 0, "friend").when(u % 4 == 1, "friend_of_friend").when(u % 4 == 2, "stranger").otherwise("unknown").alias("relationship"),
            F.when(F.col("buys"), "ordered").otherwise("not_ordered").alias("outcome"),
            F.when(F.col("buys"), F.date_add("day", 2)).otherwise(F.date_add("day", 9)).alias("outcome_date"),
            F.when(u % 11 == 3, "Jaipur").when(u % 5 == 1, "Pune").when(u % 5 == 2, "Delhi").alias("city"),
            F.when(u % 13 == 5, "XXL").when(u % 4 == 1, "M").when(u % 4 == 2, "L").alias("size"),
            F.when((u + F.dayofmonth("day")) % 9 == 0, "custom name").alias("design"),
            F.when((F.col("custom") == 1), "custom_request").when(F.col("clicked") == 1, "product_interest").otherwise("general_praise").alias("intent"))

    def lead_signals(self) -> DataFrame:
        """(lead, signal type, date): from the day's events, plus bought_before when the user bought the day before."""
        own = self.events().select("user_id", "day", lookup(F.col("event_type"), SIGNAL_BY_EVENT).alias("type")).distinct()
        active = self.events().select("user_id", "day").distinct()
        past = self.purchase_days().select("user_id", F.date_add("day", 1).alias("day"))
        bought = active.join(past, ["user_id", "day"], "left_semi").withColumn("type", F.lit("bought_before"))
        return own.unionByName(bought).select(
            (F.col("user_id") % 5).alias("business_id"), lead_id(F.col("user_id"), F.col("day")).alias("lead_id"), "type",
            F.col("day").alias("date"))

    def lead_snapshots(self) -> DataFrame:
        """The lead list's Mondays, for every business that has leads."""
        days = F.array(*[F.lit(d).cast("date") for d in LEAD_SNAPSHOTS])
        return self.businesses().select("business_id", F.explode(days).alias("as_of"))

    # ------------------------------------------------------------------ D2C views
    def d2c_daily(self) -> DataFrame:
        e = F.col("event_type")
        channel = F.when(F.col("user_id") % 3 == 0, "instagram").when(F.col("user_id") % 3 == 1, "google").otherwise("other")
        amount = F.col("value").cast("decimal(18,4)")
        return self.events().groupBy(channel.alias("channel"), F.col("day").alias("date")).agg(
            F.coalesce(F.sum(F.when(e == "view", amount)), F.lit(0)).alias("spend"), F.count(F.when(e == "click", 1)).alias("sessions"),
            F.count(F.when(e == "signup", 1)).alias("new_customers"),
            F.coalesce(F.sum(F.when(e == "purchase", amount)), F.lit(0)).alias("revenue"))

    def d2c_orders(self) -> DataFrame:
        """Purchases as orders; the first purchase of a user is their first order."""
        buys = self.events().where(F.col("event_type") == "purchase")
        first = buys.groupBy("user_id").agg(F.min("event_id").alias("first_event"))
        return buys.join(first, "user_id").select(
            F.col("event_id").alias("order_id"), F.col("user_id").alias("customer_id"), F.col("ts").alias("ordered_at"), F.col("day"),
            F.col("value").cast("decimal(18,4)").alias("revenue"),
            (F.col("value").cast("decimal(18,4)") * (F.lit(30) + F.col("event_id") % 20).cast("decimal(4,0)") / 100).cast("decimal(18,4)").alias("cogs"),
            (F.col("event_id") == F.col("first_event")).alias("is_first_order"))

    def d2c_leads(self) -> DataFrame:
        """Inquiries (error and signup events) with the user's next click as first response and next purchase as win."""
        e = F.col("event_type")
        # a user's events are folded to per-day extremes first, so one very busy user is never sorted in one task
        w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
        daily = self.events().groupBy("user_id", "day").agg(
            F.min(F.when(e == "click", F.col("ts"))).alias("click"), F.min(F.when(e == "purchase", F.col("ts"))).alias("buy"))
        after = Window.partitionBy("user_id").orderBy("day").rowsBetween(1, Window.unboundedFollowing)
        later = daily.select("user_id", "day", F.min("click").over(after).alias("later_click"), F.min("buy").over(after).alias("later_buy"))
        same = self.events().select("*", F.min(F.when(e == "click", F.col("ts"))).over(w).alias("next_click"),
                                    F.min(F.when(e == "purchase", F.col("ts"))).over(w).alias("next_buy"))
        inq = same.where(e.isin("error", "signup")).join(later, ["user_id", "day"])
        amount = F.col("value").cast("decimal(18,4)") * 100
        win = F.coalesce("next_buy", "later_buy")
        return inq.select(
            F.col("event_id").alias("lead_id"), "user_id", F.when(F.col("user_id") % 3 == 0, "instagram").when(F.col("user_id") % 3 == 1, "google").otherwise("website_form").alias("channel"),
            F.col("ts").alias("created_at"), F.coalesce("next_click", "later_click").alias("first_response_at"), win.alias("won_at"),
            amount.cast("decimal(18,4)").alias("expected_value_inr"), (amount >= 15000).alias("high_value"),
            F.when(win.isNotNull(), "won").when(F.coalesce("next_click", "later_click").isNotNull(), "qualified")
            .when(F.col("event_id") % 10 == 0, "lost").otherwise("new").alias("stage"))


def lead_id(user, day):
    return F.concat(F.lit("lead_"), user.cast("string"), F.lit("_"), day.cast("string"))


ORDER_MAPPING = {
    "order_id": "Order ID", "ordered_at": "Order Date", "customer_id": "Customer", "channel": "UTM Source", "campaign_id": "UTM Campaign",
    "payment_mode": "Payment Method", "revenue": "Order Amount (INR)", "discount": "Discount (INR)", "status": "Fulfilment Status", "items": "Items",
    "relationship": "How found", "product": "Product", "quantity": "Quantity", "post_id": "Source Post", "dispatched_at": "Dispatched On"}


def case(pairs, otherwise):
    expr = None
    for cond, value in pairs:
        value = value if not isinstance(value, str) else F.lit(value)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(F.lit(otherwise) if isinstance(otherwise, str) else otherwise)


def raw_sheet(t: Tables) -> DataFrame:
    """Order lines as a messy order sheet: four imports, planted defects, exact repeats of every row with k % 11 = 0."""
    line = spread_small(t.read("lineitem"))
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    copies = F.explode(F.sequence(F.lit(0), F.when(k % 11 == 0, 1).otherwise(0))).alias("copy")
    base = line.select("*", copies, k.alias("k"), F.col("l_shipdate").cast("date").alias("d"), F.floor(F.col("l_extendedprice") / 10).cast("bigint").alias("a"),
                       ((F.col("l_partkey") * 100000 + F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))) * 64
                        + F.col("l_quantity").cast("bigint")).alias("pos"))
    k, s = F.col("k"), (lambda c: F.col(c).cast("string"))
    day = F.col("d")
    return base.select(
        F.concat(F.lit("imp_orders_"), (F.col("l_orderkey") % 4).cast("string")).alias("import_id"), (F.col("pos") * 2 + F.col("copy")).alias("source_row"),
        case([(k % 97 == 0, "")], F.concat_ws("-", s("l_orderkey"), s("l_linenumber"))).alias("Order ID"),
        case([(k % 101 == 0, "not a date"), (k % 103 == 0, ""), (k % 13 == 0, F.date_format(day, "dd/MM/yyyy")),
              (k % 14 == 0, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T10:30:00Z"))), (k % 15 == 0, F.date_format(day, "dd-MM-yyyy"))],
             F.date_format(day, "yyyy-MM-dd")).alias("Order Date"),
        s("l_suppkey").alias("Customer"),
        case([(k % 23 == 0, "TikTok"), (k % 29 == 0, ""), (F.col("l_returnflag") == "A", "Instagram Ads"), (F.col("l_returnflag") == "R", "Google CPC")], "direct").alias("UTM Source"),
        case([(k % 5 == 0, "")], F.concat(F.lit("camp_"), (F.col("l_suppkey") % 7).cast("string"))).alias("UTM Campaign"),
        case([(k % 6 == 0, "COD"), (k % 6 == 1, "UPI"), (k % 6 == 2, "Card"), (k % 6 == 3, "barter"), (k % 6 == 4, "")], "Cash on Delivery").alias("Payment Method"),
        case([(k % 107 == 0, "abc"), (k % 109 == 0, "-5"), (k % 103 == 1, ""), (k % 17 == 0, (F.col("a") * 100).cast("string")),
              (k % 19 == 0, F.concat(F.lit("Rs. "), F.format_number("a", 0))), (k % 2 == 0, F.concat(s("a"), F.lit(".50")))], s("a")).alias("Order Amount (INR)"),
        case([(k % 3 == 0, "")], F.round(F.col("l_discount") * 100).cast("bigint").cast("string")).alias("Discount (INR)"),
        case([(k % 31 == 0, "lost in post"), (k % 37 == 0, ""), (F.col("l_linestatus") == "F", " Delivered ")], "Returned to Origin").alias("Fulfilment Status"),
        case([(k % 4 == 1, F.concat(F.lit("Item "), (F.col("l_partkey") % 50).cast("string"), F.lit("|Mug")))],
             F.concat(F.lit("Item "), (F.col("l_partkey") % 50).cast("string"), F.lit(" x"), F.col("l_quantity").cast("bigint").cast("string"), F.lit("; Cap x1"))).alias("Items"),
        case([(k % 7 == 0, "my friend"), (k % 7 == 1, "Friend of friend"), (k % 7 == 2, "Found on Insta!"), (k % 7 == 3, "FoF"), (k % 7 == 4, "cousin (family)"),
              (k % 7 == 5, "???")], "").alias("How found"),
        case([(k % 5 == 2, F.concat(F.lit("Item "), (F.col("l_partkey") % 50).cast("string")))], "").alias("Product"),
        case([(k % 113 == 0, "2.5"), (k % 8 == 0, "")], F.col("l_quantity").cast("bigint").cast("string")).alias("Quantity"),
        case([(k % 10 == 0, F.concat(F.lit("p"), s("l_suppkey")))], "").alias("Source Post"),
        case([(k % 127 == 0, "soon"), (k % 3 == 0, ""), (k % 26 == 1, F.date_format(F.date_add(day, 2), "dd/MM/yyyy"))],
             F.date_format(F.date_add(day, 2), "yyyy-MM-dd")).alias("Dispatched On"))


def contact_history(t: Tables) -> DataFrame:
    """One row per order: what the seller knew of the customer before it, and whether it beat their average so far.

    Orders are summed per (customer, day) first; the running sums step over days and only a day's own orders are
    ordered one by one.
    """
    o = t.read("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer"), F.col("o_orderdate").cast("date").alias("day"),
                                F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("decimal(14,2)").alias("price"))
    days = o.groupBy("customer", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("s"), F.max(F.struct("order_id", "status"))["status"].alias("last_status"))
    run = Window.partitionBy("customer").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    step = Window.partitionBy("customer").orderBy("day")
    days = days.select("customer", "day", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("n0"), F.sum("s").over(run).alias("s0"),
                       F.lag("last_status").over(step).alias("status0"), F.lag("day").over(step).alias("day0"))
    inside = Window.partitionBy("customer", "day").orderBy("order_id")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(14,2)")
    x = o.join(days, ["customer", "day"]).select(
        "*", F.row_number().over(inside).alias("r"), F.coalesce(F.sum("price").over(before), zero).alias("s1"), F.lag("status").over(inside).alias("status1"))
    prior = F.col("n0") + F.col("r") - 1
    last = F.coalesce("status1", "status0")
    last_day = F.when(F.col("r") > 1, F.col("day")).otherwise(F.col("day0"))
    return x.select(
        "order_id", "customer", "day", F.month("day").cast("bigint").alias("month"),
        F.when(last.isNull(), "nonexistent").when(last == "F", "success").otherwise("failure").alias("previous_outcome"), prior.alias("prior_contacts"),
        F.when(last_day.isNull(), 999).otherwise(F.datediff("day", last_day)).cast("bigint").alias("days_since_last_contact"),
        (F.lit(1) + F.col("order_id") % 4).alias("contacts_this_campaign"),
        F.when((prior > 0) & (F.col("price") * prior.cast("decimal(12,0)") > F.coalesce("s0", zero) + F.col("s1")), 1).otherwise(0).cast("bigint").alias("y"))


def chat_lines(t: Tables) -> DataFrame:
    """Pasted chat lines: each conversation turn picks one of twelve line texts and fills in a product name."""
    part = t.read("part").select(F.col("p_partkey").alias("pk"), F.col("p_name").alias("p"))
    parts = part.agg(F.count(F.lit(1)).alias("parts"))  # one row
    conv = t.read("conversations").crossJoin(F.broadcast(parts)).select("conv_id", "turn", (F.col("conv_id") % F.col("parts")).alias("pk"))
    c = (F.col("conv_id") % 40).cast("string")
    p = F.col("p")
    lines = [F.concat(F.lit("@riya.k (dm): price of the "), p, F.lit(" in size L? deliver to Pune")), F.concat(F.lit("@fan_"), c, F.lit(" (comment): this one 🔥 obsessed")),
             F.concat(F.lit("[04/10/26, 9:41 am] Riya Shah: is the "), p, F.lit(" in stock?")), F.lit("04/10/2026, 21:05 - Aman: love your page"),
             F.lit("@shop_x (dm): collab? we promote small brands"), F.concat(F.lit("@neel"), c, F.lit(" (story): can you make one with my name, XL")),
             F.lit("just some text without a format"), F.concat(F.lit("@mira_"), c, F.lit(" (whatsapp): my number is +91 98765 43210 call me")),
             F.concat(F.lit("@zed_"), c, F.lit(" (dm): mail me at zed@mail.com about custom "), p), F.lit("[31/31/26, 9:41 am] Odd Date: do you ship to Jaipur?"),
             F.concat(F.lit("@a_"), c, F.lit(" (story): love this "), p, F.lit(" need it")), F.lit("  @Riya.K (DM): ask @someone.else about cod  ")]
    pick = (F.col("conv_id") * 7 + F.col("turn")) % 12
    return conv.join(part, "pk").select((F.col("conv_id") % 5).alias("business_id"), "conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_no"),
                                        F.get(F.array(*lines), pick.cast("int")).alias("line"))


def event_windows(t: Tables) -> DataFrame:
    """One window a month, first Friday to Sunday, for every month orders or events fall in."""
    months = t.read("orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("m")).unionByName(
        t.read("events").select(F.trunc(F.col("ts").cast("date"), "month").alias("m"))).distinct()
    friday = F.next_day(F.date_sub("m", 1), "FRI")
    return months.select(F.concat(F.lit("Weekend "), F.date_format("m", "yyyy-MM")).alias("name"), F.lit("race_weekend").alias("kind"), friday.alias("window_start"), F.date_add(friday, 2).alias("window_end"))


def festivals(t: Tables) -> DataFrame:
    """The 20th of every such month; even months are flagged as demand windows."""
    w = event_windows(t)
    m = F.trunc("window_start", "month")
    return w.select(F.concat(F.lit("Festival "), F.date_format(m, "yyyy-MM")).alias("name"), F.date_add(m, 19).alias("date"), (F.month(m) % 2 == 0).alias("demand_window"))
