"""Section M queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizlens.operators import leads as ld
from bizlens.operators import outreach as ot
from bizlens.plans.bindings import Tables
from bizlens.plans.queries.diagnosis import asked
from bizlens.plans.queries.leads import daily

KEYS = ["business_id", "as_of"]


def reasons(s, d):
    """Up to three reasons a week, by business and week."""
    i = (F.datediff("as_of", F.lit("2024-01-01").cast("date")) / 7).cast("int")
    b = F.col("business_id")
    key = lambda name: F.concat(F.lit(f"{name}_week_"), i.cast("string"))
    options = F.filter(F.array(F.when((b + i) % 2 == 0, F.struct(F.lit(1).alias("place"), key("drop").alias("reason_key"))), F.when((b + i) % 3 == 0, F.struct(F.lit(2).alias("place"), key("preorder").alias("reason_key"))),
                               F.when((b + i) % 5 != 1, F.struct(F.lit(3).alias("place"), key("offer").alias("reason_key")))), lambda x: x.isNotNull())
    return Tables(s, d).lead_snapshots().select(*KEYS, F.explode(options).alias("r")).select(*KEYS, "r.*")


def contacted(s, d):
    l = Tables(s, d).leads()
    return l.where(F.col("user_id") % 3 == 0).select("lead_id", F.lit("drop_week_2").alias("reason_key")).unionByName(
        l.where(F.col("user_id") % 2 == 0).select("lead_id", F.lit("offer_week_3").alias("reason_key")))


def m02(s, d):
    return ot.open_reasons(daily(s, d), reasons(s, d), contacted(s, d))


def m01(s, d):
    listed = daily(s, d)
    r = ot.next_actions(ld.ranked(listed), ot.open_reasons(listed, reasons(s, d), contacted(s, d)))
    return r.select("business_id", F.col("as_of").cast("string").alias("as_of"), "lead_id", "group", "next_action", "position")


def drafts(s, d):
    t = Tables(s, d)
    hot = daily(s, d).where("group = 'hot'").select("business_id", "as_of", "lead_id", "user_id", "size", "serves_sizes", F.col("city").alias("asked_city"), "design")
    products = t.products().select("business_id", F.col("name").alias("product"), "price")
    j = hot.join(asked(s, d), ["business_id", "lead_id"]).withColumn("product", F.when(F.col("user_id") % 6 != 0, F.col("product"))).join(products, ["business_id", "product"], "left")
    j = j.join(t.profile().select("business_id", "city", "order_link", "payment"), "business_id")
    j = j.withColumn("last_message", F.when(F.col("user_id") % 8 == 1, "Is it back in STOCK?").otherwise("price?"))
    return ot.reply_text(j).select("business_id", F.col("as_of").cast("string").alias("as_of"), "lead_id", "draft", "placeholders")


def m05(s, d):
    k = F.length("draft") % 3
    return ot.risk_flags(drafts(s, d).withColumn("draft", F.when(k == 0, F.concat("draft", F.lit(" Nike style"))).otherwise(F.col("draft"))), "draft").select("business_id", "as_of", "lead_id", "risk_terms")


QUERIES = {
    "m01_next_actions": m01,
    "m02_warm_reasons": lambda s, d: m02(s, d).withColumn("as_of", F.col("as_of").cast("string")),
    "m03_reply_texts": drafts,
    "m04_unmet_demand": lambda s, d: ot.unmet_demand(daily(s, d)).withColumn("as_of", F.col("as_of").cast("string")),
    "m04_closed_outcomes": lambda s, d: ot.closed_outcomes(Tables(s, d).leads(), Tables(s, d).lead_snapshots()).withColumn("as_of", F.col("as_of").cast("string")),
    "m05_risk_flags": m05,
}
