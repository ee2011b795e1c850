"""Section K queries and the next-month view."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizlens.functions.numbers import half_even
from bizlens.operators import actions as ac
from bizlens.operators import calendar as cal
from bizlens.operators import diagnosis as dx
from bizlens.operators import facts as fx
from bizlens.operators.ranges import range_rank
from bizlens.plans import bindings as bd
from bizlens.plans.bindings import Tables
from bizlens.plans.queries.facts import facts
from bizlens.plans.queries.projection import projection
from bizlens.sources.tables import materialise, stored


def asked(s, d):
    return stored(s, d, "asked", lambda: _asked(s, d))


def _asked(s, d):
    """Leads with the product they asked for: a name of their business's catalogue picked by key."""
    t = Tables(s, d)
    names = materialise(range_rank(t.products().select("business_id", "name"), ["business_id"], [F.col("name")], "place"), "names")
    size = names.groupBy("business_id").agg(F.max("place").alias("names"))
    l = t.leads().join(size, "business_id").select("business_id", "lead_id", (F.col("user_id") * F.col("user_id") % F.col("names") + 1).alias("place"))
    return l.join(names, ["business_id", "place"]).select("business_id", "lead_id", F.col("name").alias("product"))


def situation(s, d):
    t = Tables(s, d)
    partners = ac.partner_picks(ac.score_partners(t.partners(), t.profile(), t.partner_results()))
    products = ac.product_picks(t.products(), ac.product_demand(asked(s, d), t.products()))
    up = cal.upcoming(t.snapshots(), bd.event_windows(t), ["business_id", "week_no"])
    return ac.situation(t.snapshots(), t.profile(), partners, up, products, facts(s, d))


def candidates(s, d):
    return stored(s, d, "candidates", lambda: ac.candidates(situation(s, d), ac.library(s), facts(s, d)))


def findings(s, d):
    return stored(s, d, "findings", lambda: dx.findings(facts(s, d), ac.actionability(candidates(s, d))))


def verdicts(s, d):
    return dx.verdict(findings(s, d))


def j06(s, d):
    t = Tables(s, d)
    month = t.snapshots().select("business_id", "week_no", "as_of", F.date_add("as_of", 27).alias("hi"))
    return dx.next_month(projection(s, d), verdicts(s, d), cal.overlapping(month, bd.event_windows(t), ["business_id", "week_no"], "as_of", "hi"))


RATED = ["business_id", "week_no", "fact_id", "gap", "what", "material"]
QUERIES = {
    "k01_k02_gap_and_shortfall": lambda s, d: dx.rated_facts(facts(s, d)).select(*RATED, half_even(F.col("amount"), 4).alias("amount")),
    "k03_decisive_facts": lambda s, d: dx.decisive_facts(dx.rated_facts(facts(s, d))).select("business_id", "week_no", "bottleneck", "fact_id", "gap", "material", F.col("pos").cast("bigint").alias("pos")),
    "k04_k05_findings": findings,
    "k06_evidence_cards": lambda s, d: (lambda f: dx.cards(dx.rated_facts(f), dx.window_orders(f)).drop("pos"))(facts(s, d)),
    "k07_k08_verdict": verdicts,
    "j06_next_month": j06,
}
