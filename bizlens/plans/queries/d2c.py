"""Section D queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizlens.functions.numbers import half_even
from bizlens.operators import d2c
from bizlens.plans.bindings import Tables

PERIODS = [("current", "2024-01-28", "2024-01-30", "2024-01-30 20:00:00"), ("before", "2024-01-24", "2024-01-26", "2024-01-26 23:00:00"),
           ("week", "2024-01-21", "2024-01-27", "2024-01-29 06:30:00"), ("outside", "2024-01-29", "2024-02-03", "2024-02-03 12:00:00")]


def periods(s):
    p = s.createDataFrame(PERIODS, "period_id string, lo string, hi string, as_of string")
    return p.select("period_id", F.col("lo").cast("date").alias("lo"), F.col("hi").cast("date").alias("hi"), F.col("as_of").cast("timestamp").alias("as_of"))


def inputs(s, d) -> d2c.Inputs:
    t = Tables(s, d)
    orders = t.d2c_orders()
    cohort = orders.where(F.col("is_first_order") & (F.col("day") <= F.lit("2024-01-10").cast("date")) & (F.col("customer_id") % 2 == 0)).select("customer_id")
    return d2c.Inputs(t.d2c_daily(), orders, t.d2c_leads(), cohort, periods(s))


FACT_QUERIES = {
    "d04_ad_spend": ["f_spend_instagram", "f_spend_google"], "d05_cac": ["f_cac_instagram", "f_cac_google"], "d06_conversion_rate": ["f_conv_instagram"],
    "d07_roas": ["f_roas_instagram"], "d08_contribution_roas": ["f_croas_instagram", "f_croas_google"], "d09_cac_blended": ["f_cac_blended"],
    "d10_revenue_orders_aov": ["f_revenue_total", "f_orders_total", "f_aov"], "d11_gross_margin": ["f_gross_margin"], "d12_repeat_rate": ["f_repeat_rate"],
    "d13_cohort_repeat": ["f_repeat_email"], "d14_leads": ["f_leads_total"], "d15_response_latency": ["f_latency_hot_leads"],
    "d16_unattended": ["f_unattended_hot_leads"], "d17_high_value_wins": ["f_hot_lead_wins"],
    "d19_funnel": ["f_funnel_sessions", "f_funnel_leads", "f_funnel_qualified", "f_funnel_won"],
}
BRIEF = ["period_id", "fact_id", "value", "baseline", "delta_pct", "numerator", "denominator"]


def _brief(ids):
    return lambda s, d: d2c.fact_table(inputs(s, d), ids).select(*BRIEF)


def d01(s, d):
    days = Tables(s, d).events().select("day").distinct()
    end = d2c.baseline_end(F.col("day"))
    return days.select(F.col("day").cast("string").alias("period_from"), F.date_sub(end, 27).cast("string").alias("baseline_from"), end.cast("string").alias("baseline_to"))


def d02(s, d):
    b = d2c.baselines(d2c.label_values(inputs(s, d)))
    return b.select("period_id", "fact_id", "baseline_kind", half_even(F.col("baseline"), 6).alias("baseline"))


def d18(s, d):
    seen = Tables(s, d).d2c_leads().crossJoin(F.broadcast(periods(s).select("period_id", "as_of"))).where(F.col("created_at") <= F.col("as_of"))
    return seen.groupBy("period_id", d2c.stage_seen(F.col("as_of")).alias("stage")).agg(F.count(F.lit(1)).alias("leads"))


def series(s, d):
    return d2c.daily_series(Tables(s, d).d2c_daily(), "2024-01-01", "2024-01-30")


def d22(s, d):
    o = Tables(s, d).d2c_orders().where(F.col("day").between(F.lit("2024-01-28").cast("date"), F.lit("2024-01-30").cast("date")))
    return o.agg(F.count(F.lit(1)).alias("orders"), half_even(F.sum("revenue"), 2).alias("revenue"), F.countDistinct("customer_id").alias("customers"))


QUERIES = {
    "d01_baseline_window": d01, "d02_baselines": d02, "d03_kpi_facts": lambda s, d: d2c.fact_table(inputs(s, d)),
    **{k: _brief(v) for k, v in FACT_QUERIES.items()},
    "d18_stage_seen": d18, "d20_daily_series": series, "d21_anomalies": lambda s, d: d2c.anomalies(series(s, d), "cac", "2024-01-22"), "d22_current_summary": d22,
}
