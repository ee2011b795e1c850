"""Section L queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizlens.operators import actions as ac
from bizlens.operators import diagnosis as dx
from bizlens.plans.bindings import Tables
from bizlens.plans.queries.diagnosis import asked, candidates, findings

KEYS = ["business_id", "week_no"]


def partners(s, d):
    t = Tables(s, d)
    return ac.rank_partners(t.partners(), t.profile(), t.partner_results())


def branded_products(s, d):
    """Part names with a brand word on every third, so protected terms occur."""
    k = F.col("p_partkey")
    tail = F.when(k % 9 == 0, " nike edition").when(k % 9 == 3, " Ferrarista").when(k % 9 == 6, " (Hello Kitty)").otherwise("")
    return Tables(s, d).read("part").select((k % 5).alias("business_id"), F.concat(F.col("p_name"), tail).alias("name")).distinct()


def preferences(s, d):
    k = F.col("place") + F.col("week_no")
    return Tables(s, d).snapshots().select(*KEYS).join(F.broadcast(ac.library(s).select("action_key", "place"))).where((k % 4 == 0) | (k % 5 == 1)).select(
        *KEYS, "action_key", F.when(k % 4 == 0, "exclude").otherwise("boost").alias("preference"))


def status(s, d):
    """Earlier marks: every other action id of every week is done or skipped."""
    k = F.col("business_id") + F.col("week_no") + F.col("place")
    a = Tables(s, d).snapshots().select(*KEYS).join(F.broadcast(ac.library(s).select("action_key", "place")))
    return a.select(F.concat(F.lit("act_"), F.col("business_id").cast("string"), F.lit("_w"), F.col("week_no").cast("string"), F.lit("_"), "action_key").alias("action_id"),
                    F.when(k % 5 < 3, "done").when(k % 5 == 3, "skipped").otherwise("todo").alias("status"))


def week_actions(s, d):
    return ac.week_actions(candidates(s, d), ac.target_bottleneck(dx.verdict(findings(s, d))), status(s, d))


GATED = [*KEYS, "action_key", "eligible", "blocked_reason"]
QUERIES = {
    "l01_l02_gate": lambda s, d: candidates(s, d).select(*GATED),
    "l03_l04_score": lambda s, d: candidates(s, d).select(*KEYS, "action_key", "fit", "timing", "score", "partner_id", "product_name"),
    "l05_targets": lambda s, d: candidates(s, d).select(*KEYS, "action_key", "target_fact", "current", "target_value"),
    "l06_actionability": lambda s, d: ac.actionability(candidates(s, d)),
    "l07_selection": lambda s, d: ac.select_actions(candidates(s, d), [*KEYS, "bottleneck"]).where("chosen").select(*KEYS, "bottleneck", "action_key", "score"),
    "l08_partner_ranking": lambda s, d: partners(s, d).select("business_id", "partner_id", "audience", "location", "engagement", "past", "score", "blocked", "rank"),
    "l09_protected_terms": lambda s, d: ac.protected_matches(branded_products(s, d)),
    "l09_action_risk": lambda s, d: ac.action_risk(candidates(s, d), ac.brand_risk(ac.protected_matches(branded_products(s, d)))),
    "l10_product_demand": lambda s, d: ac.product_demand(asked(s, d), Tables(s, d).products()),
    "l11_preferences": lambda s, d: ac.apply_preferences(candidates(s, d), preferences(s, d)).select(*GATED, "score"),
    "l12_week_actions": week_actions,
}
