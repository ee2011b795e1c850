"""Section N queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizlens.operators import actions as ac
from bizlens.operators import advice_loop as al
from bizlens.operators import diagnosis as dx
from bizlens.operators import followup as fu
from bizlens.plans.bindings import Tables
from bizlens.plans.queries.actions import status
from bizlens.plans.queries.diagnosis import candidates, facts, findings
from bizlens.sources.tables import stored


def week(s, d):
    """(facts, verdicts, reviews) of one run; each stage is a written table."""
    f, v = facts(s, d), dx.verdict(findings(s, d))
    return f, v, stored(s, d, "reviews", lambda: fu.reviews(ac.week_actions(candidates(s, d), ac.target_bottleneck(v), status(s, d)), f))


def steered(s, d):
    """Every week's actions, steered by the review of the week before, with their evidence."""
    f, v = facts(s, d), dx.verdict(findings(s, d))
    advice = al.advice_loop(candidates(s, d), ac.target_bottleneck(v), status(s, d), f)
    return al.with_evidence(advice, dx.cards(dx.rated_facts(f), dx.window_orders(f)))


def demand_view(s, d):
    return fu.demand(facts(s, d))


def n05(s, d):
    f, v, r = week(s, d)
    return fu.followups(r, f, v)


def n06(s, d):
    f, _, r = week(s, d)
    return fu.arc(f, r)


def plans(s, d):
    """One executed plan per order: its lines are the tasks, its price against a frozen range the outcome."""
    o = Tables(s, d).read("orders")
    k = F.col("o_orderkey")
    price = F.col("o_totalprice")
    return o.select(k.alias("plan_id"), (1 + k % 4).alias("tasks_total"), F.least(1 + k % 4, 1 + k % 3).alias("tasks_done"), (k % 100 * 1000).cast("double").alias("low"),
                    (k % 100 * 1000 + 250000).cast("double").alias("high"), (k % 7 * 10000).cast("double").alias("baseline"), price.alias("actual"), (k % 40).alias("days_passed"),
                    F.when(k % 2 == 0, 7).otherwise(30).alias("window_days"), (k % 48).alias("guard_value"), F.lit(24).alias("guard_max"))


REVIEW = ["business_id", "week_no", "action_id", "action_key", "status", "done", "fact_id", "target_value", "previous", "current", "effectiveness", "decision"]
QUERIES = {
    "n01_action_reviews": lambda s, d: week(s, d)[2].select(*REVIEW),
    "n02_demand": demand_view,
    "n03_shared_targets": lambda s, d: fu.shared_targets(week(s, d)[2]).select("business_id", "week_no", "action_id", "attribution_note"),
    "n04_preferences": lambda s, d: fu.preferences(week(s, d)[2]),
    "n04_advice_loop": steered,
    "n05_followups": n05, "n06_four_week_arc": n06,
    "n07_partner_history": lambda s, d: fu.partner_history(Tables(s, d).partner_results()),
    "n08_outcome_grading": lambda s, d: fu.grade_outcomes(plans(s, d)),
}
