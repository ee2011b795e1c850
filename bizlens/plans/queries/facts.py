"""Sections E and F queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizlens.operators import facts as fx
from bizlens.plans.bindings import LEAD_SHIFT_DAYS, Tables
from bizlens.sources.tables import stored


def inputs(spark, sf) -> fx.Inputs:
    """The tables that facts start from. Orders, posts, leads and the two event tables are joined from the sources once."""
    t = Tables(spark, sf)
    shift = [F.date_sub(c, LEAD_SHIFT_DAYS).alias(c) for c in ("created", "outcome_date")]
    held = [stored(spark, sf, name, build) for name, build in (
        ("orders", t.orders), ("posts", t.posts), ("shifted-leads", lambda: t.leads().select("business_id", "outcome", *shift)),
        ("turned-away", t.turned_away), ("stockouts", t.stockouts))]
    return fx.Inputs(*held, t.profile(), t.snapshots())


BRIEF = ["business_id", "week_no", "fact_id", "value", "numerator", "denominator", "sample_size", "sample_kind", "baseline", "gap_to_best"]

# query key -> the facts it returns
FACT_QUERIES = {
    "e01_orders_by_source": [f"f_orders_by_source_{r}" for r in fx.RELATIONSHIPS],
    "e02_stranger_orders_week": ["f_stranger_orders_week"],
    "e03_stranger_share": ["f_stranger_share"],
    "e04_reach_per_post": ["f_reach_per_post"],
    "e05_posts_with_orders": ["f_posts_with_orders"],
    "e06_profile_visit_rate": ["f_profile_visit_rate"],
    "e07_follow_rate": ["f_follow_rate"],
    "e08_orders_per_1000_reach": ["f_orders_per_1000_reach"],
    "e09_lead_to_order_rate": ["f_lead_to_order_rate"],
    "e10_unit_cost_full": ["f_unit_cost_full"],
    "e11_margin_per_order": ["f_margin_per_order"],
    "e12_margin_pct": ["f_margin_pct"],
    "e13_discount_share": ["f_discount_share"],
    "e14_repeat_customer_share": ["f_repeat_customer_share"],
    "e15_days_between_orders": ["f_days_between_orders"],
    "e16_orders_per_week": ["f_orders_per_week"],
    "e17_dispatch_delay": ["f_dispatch_delay_days"],
    "e18_stockouts": ["f_stockouts"],
    "e19_orders_turned_away": ["f_orders_turned_away"],
    "e20_capacity_utilisation": ["f_capacity_utilisation"],
}


def _brief(ids):
    return lambda s, d: fx.fact_table(inputs(s, d), facts=ids).select(*BRIEF)


def facts(s, d):
    """The fact table, which diagnosis, actions and follow-up read as well."""
    return stored(s, d, "facts", lambda: fx.fact_table(inputs(s, d)))


def _series(s, d):
    out = None
    for fid in ("f_stranger_orders_week", "f_margin_pct", "f_dispatch_delay_days", "f_days_between_orders"):
        part = fx.weekly_series(inputs(s, d), fid).withColumn("fact_id", F.lit(fid))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    **{k: _brief(ids) for k, ids in FACT_QUERIES.items()},
    "f01_week_grid": lambda s, d: fx.complete_windows(Tables(s, d).snapshots()).select(
        "business_id", "week_no", F.col("window_from").cast("string").alias("window_from"), F.col("window_to").cast("string").alias("window_to")),
    "f02_point_in_time": lambda s, d: fx.visible_counts(inputs(s, d)),
    "f03_f04_own_best": lambda s, d: facts(s, d).where(F.col("better") != "info").select(
        "business_id", "week_no", "fact_id", "value", "baseline", "best_from", "best_to", "gap_to_best", "delta_pct"),
    "f05_small_samples": lambda s, d: facts(s, d).select("business_id", "week_no", "fact_id", "sample_size", "sample_kind", "quality_flag", "source"),
    "f06_fact_table": facts,
    "f07_weekly_series": _series,
    "f08_facts_by_bottleneck": lambda s, d: facts(s, d).where(F.col("bottleneck") == "margin").select(*BRIEF, "bottleneck"),
    "f09_fact_changes": lambda s, d: fx.fact_changes(facts(s, d)),
}
