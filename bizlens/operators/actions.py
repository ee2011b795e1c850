"""Library actions for every business and snapshot: gate, fit, score, target, selection; partners and protected terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.functions.numbers import half_even, ratio
from bizlens.operators.ranges import range_rank
from bizlens.operators.skew import settle

KEYS = ["business_id", "week_no"]
MAX_ACTIONS = 3

# ---- fixed values: action, bottleneck, kind, minutes, impact, cost, timing sensitive, raises visibility, needs, target fact, target rule, amount, fit
LIBRARY = (
    ("reach_partner_collab", "reach", "organic", 60, 0.8, 0, True, True, "reach_candidates", "f_stranger_orders_week", "add", 2.0, 0.8),
    ("reach_demand_window_drop", "reach", "content", 90, 0.7, 0, True, True, "demand_window", "f_stranger_orders_week", "add", 2.0, 0.8),
    ("reach_community_share", "reach", "outreach", 30, 0.5, 0, False, True, "", "f_stranger_orders_week", "add", 1.0, 0.6),
    ("reach_buyer_tag_share", "reach", "outreach", 20, 0.4, 0, False, True, "", "f_stranger_orders_week", "add", 1.0, 0.7),
    ("reach_paid_ads", "reach", "paid_ads", 30, 0.6, 1000, False, True, "", "f_stranger_orders_week", "add", 2.0, 0.8),
    ("conv_saved_replies", "conversion", "operations", 45, 0.6, 0, False, False, "", "f_lead_to_order_rate", "relative", 0.1, 0.8),
    ("conv_fix_profile", "conversion", "content", 30, 0.5, 0, False, False, "", "f_lead_to_order_rate", "relative", 0.05, 0.8),
    ("conv_pin_best_post", "conversion", "content", 10, 0.3, 0, False, False, "", "f_lead_to_order_rate", "relative", 0.03, 0.8),
    ("margin_reprice", "margin", "pricing", 30, 0.7, 0, False, False, "unit_cost", "f_margin_pct", "relative", 0.07, 0.8),
    ("margin_bundle", "margin", "pricing", 45, 0.5, 0, False, False, "", "f_margin_pct", "relative", 0.04, 0.8),
    ("margin_supplier_rate", "margin", "operations", 40, 0.4, 0, False, False, "", "f_margin_pct", "relative", 0.03, 0.8),
    ("repeat_thank_you_next_drop", "repeat_orders", "outreach", 40, 0.7, 0, False, False, "past_buyers", "f_repeat_customer_share", "relative", 0.1, 0.8),
    ("repeat_reorder_incentive", "repeat_orders", "pricing", 30, 0.5, 0, False, False, "past_buyers", "f_repeat_customer_share", "relative", 0.06, 0.8),
    ("cap_batch_making", "capacity", "operations", 60, 0.7, 0, False, False, "", "f_orders_turned_away", "to_best", None, 0.8),
    ("cap_preorder_drop", "capacity", "operations", 45, 0.7, 0, False, False, "", "f_orders_turned_away", "to_zero", None, 0.8),
    ("cap_dispatch_schedule", "capacity", "operations", 30, 0.5, 0, False, False, "", "f_dispatch_delay_days", "to_best", None, 0.8),
)
PROTECTED_TERMS = ("F1", "Formula 1", "Formula One", "Ferrari", "Mercedes", "Red Bull", "McLaren", "Aston Martin", "Alpine", "Williams", "Haas", "Hamilton", "Verstappen", "Leclerc",
                   "Norris", "Alonso", "Senna", "Schumacher", "Nutella", "Ferrero", "Kitkat", "Oreo", "Cadbury", "Lotus Biscoff", "Biscoff", "Disney", "Marvel", "Pokemon", "Barbie",
                   "Harry Potter", "Mickey", "Spider-Man", "Hello Kitty", "Nike", "Adidas", "Puma", "IPL", "FIFA")
# ---- end of fixed values


def library_rows() -> list[tuple]:
    return [(place, *row) for place, row in enumerate(LIBRARY)]


def library(spark) -> DataFrame:
    return spark.createDataFrame(library_rows(), "place int, action_key string, bottleneck string, kind string, effort_min long, impact double, cost_inr long, timing_sensitive boolean, "
                                                 "raises_visibility boolean, needs string, target_fact string, rule string, amount double, base_fit double")


# ---------------------------------------------------------------- partners, terms, products
def score_partners(partners: DataFrame, profile: DataFrame, results: DataFrame) -> DataFrame:
    """Score of each candidate; one that costs more than the budget is blocked."""
    past = results.groupBy("partner_id").agg(F.avg("stranger_leads").alias("avg_leads"))
    j = partners.join(profile.select("business_id", F.col("city").alias("own_city"), F.col("topics").alias("own_topics"), "ad_budget_inr"), "business_id").join(past, "partner_id", "left")
    audience = F.when(F.arrays_overlap("topics", "own_topics"), 1.0).otherwise(0.4)
    location = F.when(F.col("city").eqNullSafe(F.col("own_city")), 1.0).when(F.col("city").isNull(), 0.5).otherwise(0.6)
    rate = (F.col("avg_comments_per_post") + F.col("avg_shares_per_post")) / F.greatest(F.lit(1), F.col("followers"))
    engagement = half_even(F.least(F.lit(1.0), rate / 0.02), 3)
    history = F.when(F.col("avg_leads").isNotNull(), half_even(F.least(F.lit(1.0), F.col("avg_leads") / 5), 3)).otherwise(0.5)
    p = settle(j.select("business_id", "partner_id", "name", "type", "cost_inr", "ad_budget_inr", audience.alias("audience"), location.alias("location"), engagement.alias("engagement"), history.alias("past")))
    score = 100 * (0.35 * F.col("audience") + 0.20 * F.col("location") + 0.25 * F.col("engagement") + 0.20 * F.col("past"))
    return settle(p.withColumn("score", half_even(score, 1)).withColumn("blocked", F.col("cost_inr") > F.col("ad_budget_inr")))


def rank_partners(partners: DataFrame, profile: DataFrame, results: DataFrame) -> DataFrame:
    """Scored candidates with their rank among those of the business that are not blocked."""
    placed = range_rank(score_partners(partners, profile, results), ["business_id", "blocked"], [F.col("score").desc(), F.col("partner_id")])
    return placed.withColumn("rank", F.when(~F.col("blocked"), F.col("rank")))


def partner_picks(scored: DataFrame) -> DataFrame:
    """Per business: the best partner and the best community other than it. Best is highest score, then smallest id."""
    open_ = scored.where(~F.col("blocked"))
    best = F.min(F.struct((-F.col("score")).alias("minus"), "partner_id", "score"))
    top = open_.groupBy("business_id").agg(best.alias("top"))
    others = open_.where("type = 'community'").join(top, "business_id").where(F.col("partner_id") != F.col("top.partner_id"))
    community = others.groupBy("business_id").agg(best.alias("c"))
    return top.join(community, "business_id", "left").select("business_id", F.col("top.partner_id").alias("top_partner"), F.col("top.score").alias("top_score"),
                                                             F.col("c.partner_id").alias("community"), F.col("c.score").alias("community_score"))


def protected_matches(products: DataFrame) -> DataFrame:
    """(business, product, term) for each protected term a product name holds as whole words, in any case."""
    hits = F.filter(F.array(*[F.when(F.col("name").rlike(rf"(?iU)(?<![\w])\Q{t}\E(?![\w])"), t) for t in PROTECTED_TERMS]), lambda x: x.isNotNull())
    return products.select("business_id", "name", F.explode(hits).alias("term"))


def brand_risk(matches: DataFrame) -> DataFrame:
    return matches.groupBy("business_id").agg(F.array_join(F.array_sort(F.collect_set("term")), ", ").alias("terms"), F.countDistinct("name").alias("products"))  # at most 38 terms


def action_risk(cands: DataFrame, risk: DataFrame) -> DataFrame:
    """Brand risk of every action of a business with protected terms in its product names: high where the action makes the
    products more visible, else medium. Businesses without such terms have no rows."""
    level = F.when(F.col("raises_visibility"), "high").otherwise("medium")
    return cands.join(risk, "business_id").select(*KEYS, "action_key", level.alias("level"), "terms", "products")


def product_demand(leads: DataFrame, products: DataFrame) -> DataFrame:
    """Products by how many leads asked for them."""
    return leads.join(products.select("business_id", F.col("name").alias("product")), ["business_id", "product"], "left_semi").groupBy("business_id", "product").agg(
        F.count(F.lit(1)).alias("asks"))


def product_picks(products: DataFrame, demand: DataFrame) -> DataFrame:
    """Lowest-margin product, whether any unit cost is missing, and the most-asked product of each business."""
    margin = F.when(F.col("price") > 0, (F.col("price") - F.coalesce("unit_cost", F.lit(0.0))) / F.col("price")).otherwise(1.0)
    low = products.groupBy("business_id").agg(F.min(F.struct(margin.alias("m"), "first_key", "name"))["name"].alias("low_margin_product"),
                                              F.count(F.when(F.col("unit_cost").isNull(), 1)).alias("missing_costs"))
    most = demand.groupBy("business_id").agg(F.min(F.struct((-F.col("asks")).alias("n"), "product"))["product"].alias("most_asked"))
    return low.join(most, "business_id", "left")


# ---------------------------------------------------------------- candidates
def situation(snapshots: DataFrame, profile: DataFrame, partners: DataFrame, upcoming: DataFrame, products: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per (business, snapshot) with everything the gate and the scores read. A profile may name kinds of action that
    the owner forbids (`forbidden_actions`); null or no such column forbids none."""
    buyers = facts.where("fact_id = 'f_repeat_customer_share'").select(*KEYS, F.col("denominator").alias("past_buyers"))
    nxt = upcoming.groupBy(*KEYS).agg(F.min("window_start").alias("next_window"))
    no_kinds = F.array().cast("array<string>")
    forbidden = F.coalesce("forbidden_actions", no_kinds) if "forbidden_actions" in profile.columns else no_kinds
    p = profile.select("business_id", "growth_minutes", "ad_budget_inr", forbidden.alias("forbidden_actions"))
    return snapshots.select(*KEYS, "as_of").join(p, "business_id").join(partners, "business_id", "left").join(products, "business_id", "left").join(
        nxt, KEYS, "left").join(buyers, KEYS, "left").withColumn("window_days", F.datediff("next_window", "as_of"))


def _money(c: Column) -> Column:
    return F.format_number(c, 0)


def candidates(sit: DataFrame, lib: DataFrame, facts: DataFrame) -> DataFrame:
    """Every library action for every situation: gated, scored and with its target. The library has 16 rows."""
    c = sit.join(F.broadcast(lib))
    # paid ads and kinds that the owner forbids never pass; of the others the cost decides
    paid = (F.col("kind") == "paid_ads") | F.expr("array_contains(forbidden_actions, kind)") | (F.col("cost_inr") > F.col("ad_budget_inr"))
    ads = F.when(paid, F.concat(F.lit("Needs INR "), _money(F.col("cost_inr")), F.lit(" for ads; your ad budget is INR "), _money(F.col("ad_budget_inr")), F.lit(", so paid ads are not an option.")))
    hours = F.when(F.col("effort_min") > F.col("growth_minutes"), F.concat(F.lit("Needs "), F.col("effort_min").cast("string"), F.lit(" minutes; you have "),
                                                                           F.col("growth_minutes").cast("string"), F.lit(" minutes a week for growth.")))
    need = F.col("needs")
    data = (F.when((need == "reach_candidates") & F.col("top_partner").isNull(), "No reach partners are listed (add a few fan pages, creators or communities).")
            .when((need == "demand_window") & F.col("next_window").isNull(), "No demand window in the next 3 weeks.")
            .when((need == "past_buyers") & (F.coalesce("past_buyers", F.lit(0.0)) < 5), "Fewer than 5 past buyers.")
            .when((need == "unit_cost") & (F.coalesce("missing_costs", F.lit(0)) > 0), "Unit costs are missing for some products."))
    soon = F.col("window_days") <= 7
    key = F.col("action_key")
    fit = (F.when((key == "reach_partner_collab") & F.col("top_partner").isNotNull(), F.col("top_score") / 100)
           .when((key == "reach_community_share") & F.col("community").isNotNull(), F.greatest("base_fit", F.col("community_score") / 100))
           .when((key == "reach_demand_window_drop") & F.col("next_window").isNotNull(), F.when(soon, 1.0).otherwise(0.7)).otherwise(F.col("base_fit")))
    timing = F.when(~F.col("timing_sensitive"), 0.5).when(F.col("next_window").isNull(), 0.0).when(soon, 1.0).otherwise(0.5)
    partner = F.when(key == "reach_partner_collab", F.col("top_partner")).when(key == "reach_community_share", F.col("community"))
    c = settle(c.select(*KEYS, "as_of", "growth_minutes", "place", "action_key", "bottleneck", "effort_min", "impact", "raises_visibility", "target_fact", "rule", "amount",
                        F.coalesce(ads, hours, data).alias("blocked_reason"), half_even(fit, 3).alias("fit"), timing.alias("timing"), partner.alias("partner_id"),
                        F.when(F.col("bottleneck") == "capacity", F.coalesce("most_asked", "low_margin_product")).otherwise(F.col("low_margin_product")).alias("product_name")))
    share = F.least(F.lit(1.0), F.col("effort_min") / F.greatest(F.lit(1), F.col("growth_minutes")))
    c = settle(c.withColumn("eligible", F.col("blocked_reason").isNull()).withColumn(
        "score", half_even(100 * (0.5 * F.col("impact") + 0.3 * F.col("fit") + 0.2 * F.col("timing")) * (1 - 0.5 * share), 1)))
    f = facts.select(*KEYS, F.col("fact_id").alias("target_fact"), F.col("value").alias("current"), "baseline", "direction")
    goal = (F.when(F.col("rule") == "add", F.col("current") + F.col("amount")).when(F.col("rule") == "relative", half_even(F.col("current") * (1 + F.col("amount")), 3))
            .when(F.col("rule") == "to_best", half_even(F.col("baseline"), 2)).otherwise(0.0))
    return c.join(f, [*KEYS, "target_fact"], "left").withColumn("target_value", F.when(F.col("current").isNotNull(), goal)).drop("amount")


def actionability(cands: DataFrame) -> DataFrame:
    """Per bottleneck: any eligible action, the least effort, and else the distinct reasons."""
    g = cands.groupBy(*KEYS, "bottleneck").agg(F.bool_or("eligible").alias("has_action"), F.min(F.when(F.col("eligible"), F.col("effort_min"))).alias("min_effort"),
                                              F.array_sort(F.collect_set("blocked_reason")).alias("r"))  # at most five actions
    return g.select(*KEYS, "bottleneck", "has_action", "min_effort", F.when(~F.col("has_action"), F.concat(F.lit("every action for it is blocked: "), F.array_join("r", " "))).alias("why_not"))


def select_actions(cands: DataFrame, group: list[str]) -> DataFrame:
    """Greedy choice per group: best score first, at most three, together within the week's minutes; adds `chosen`.

    A group is one bottleneck's share of the library (at most five rows), folded inside the JVM.
    """
    ordered = F.array_sort(F.collect_list(F.when(F.col("eligible"), F.struct((-F.col("score")).alias("s"), F.col("effort_min").alias("e"), F.col("place"), F.col("action_key").alias("k")))))
    g = cands.groupBy(*group).agg(ordered.alias("o"), F.max("growth_minutes").alias("m"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("keys"))

    def take(acc, x):
        ok = (acc["used"] + x["e"] <= F.col("m")) & (F.size(acc["keys"]) < MAX_ACTIONS)
        return F.when(ok, F.struct((acc["used"] + x["e"]).alias("used"), F.concat(acc["keys"], F.array(x["k"])).alias("keys"))).otherwise(acc)

    picked = g.select(*group, F.aggregate("o", start, take)["keys"].alias("picked"))
    return cands.join(picked, group).withColumn("chosen", F.array_contains("picked", F.col("action_key"))).drop("picked")


def apply_preferences(cands: DataFrame, prefs: DataFrame) -> DataFrame:
    """Follow-up preferences (business, week, action_key, preference): exclude blocks, boost adds 10 points."""
    j = cands.join(prefs, [*KEYS, "action_key"], "left")
    out = (F.col("preference") == "exclude") & F.col("eligible")
    up = (F.col("preference") == "boost")
    return settle(j.select(*[c for c in cands.columns if c not in ("eligible", "blocked_reason", "score")],
                           F.when(out, "Dropped after last week's follow-up: the number did not move.").otherwise(F.col("blocked_reason")).alias("blocked_reason"),
                           (F.col("eligible") & ~F.coalesce(out, F.lit(False))).alias("eligible"), F.when(up, half_even(F.col("score") + 10, 1)).otherwise(F.col("score")).alias("score")))


def target_bottleneck(verdicts: DataFrame) -> DataFrame:
    """What each week works on: the primary; in a quiet week last week's primary, else reach, in maintain mode; none when data is thin."""
    prev = verdicts.select("business_id", (F.col("week_no") + 1).alias("week_no"), F.col("primary").alias("previous"))
    j = verdicts.join(prev, KEYS, "left")
    quiet = F.col("primary").isNull() & (F.col("status") == "no_clear_bottleneck")
    return j.select(*KEYS, F.when(quiet, "maintain").otherwise("fix").alias("mode"), F.when(quiet, F.coalesce("previous", F.lit("reach"))).otherwise(F.col("primary")).alias("bottleneck"))


def week_actions(cands: DataFrame, targets: DataFrame, status: DataFrame) -> DataFrame:
    """Chosen, blocked and not chosen actions of the week's bottleneck; a chosen action keeps the status it had."""
    mine = cands.join(targets, [*KEYS, "bottleneck"])
    s = select_actions(mine, KEYS).withColumn("action_id", F.concat(F.lit("act_"), F.col("business_id").cast("string"), F.lit("_w"), F.col("week_no").cast("string"), F.lit("_"), "action_key"))
    s = s.join(status, "action_id", "left")
    kind = F.when(F.col("chosen"), "action").when(~F.col("eligible"), "blocked").otherwise("not_chosen")
    return s.select(*KEYS, "action_id", "action_key", "bottleneck", "mode", kind.alias("kind"), "effort_min", "score", "blocked_reason", "target_fact", "target_value", "current", "direction",
                    F.when(F.col("chosen"), F.date_add("as_of", 7).cast("string")).alias("due"), F.when(F.col("chosen"), F.coalesce("status", F.lit("todo"))).alias("status"), "partner_id",
                    "product_name")
