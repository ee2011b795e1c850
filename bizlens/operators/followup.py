"""Weekly follow-up: was each action done, did its number move, and what next week should favour or avoid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.functions.numbers import half_even, ratio
from bizlens.operators.facts import moved
from bizlens.operators.skew import settle

KEYS = ["business_id", "week_no"]
CAPACITY_KPIS = ("orders_turned_away", "dispatch_delay_days", "stockouts")  # fixed value


def demand(facts: DataFrame) -> DataFrame:
    """Orders in the window plus orders turned away: what people wanted, not what was made."""
    g = facts.groupBy(*KEYS).agg(F.max(F.when(F.col("sample_kind") == "orders", F.col("sample_size"))).alias("o"),
                                 F.max(F.when(F.col("fact_id") == "f_orders_turned_away", F.col("value"))).alias("t"))
    return g.select(*KEYS, F.when(F.col("o") > 0, F.col("o") + F.coalesce("t", F.lit(0.0))).alias("demand"))


def reviews(week_actions: DataFrame, facts: DataFrame) -> DataFrame:
    """Each action of a week judged with the facts of the week after. Fidelity (done) is kept apart from the effect."""
    nxt = (F.col("week_no") + 1).alias("week_no")
    acts = week_actions.where("kind = 'action'").select("business_id", nxt, "action_id", "action_key", "status", F.col("target_fact").alias("fact_id"), "target_value")
    prev = facts.select("business_id", nxt, "fact_id", F.col("value").alias("previous"), F.col("direction").alias("prev_direction"))
    cur = facts.select(*KEYS, "fact_id", F.col("value").alias("current"), "direction", "kpi")
    d = demand(facts)
    j = acts.join(facts.select(*KEYS).distinct(), KEYS, "left_semi").join(prev, [*KEYS, "fact_id"], "left").join(cur, [*KEYS, "fact_id"], "left")
    j = j.join(d.withColumnRenamed("demand", "d1"), KEYS, "left").join(d.select("business_id", nxt, F.col("demand").alias("d0")), KEYS, "left")
    j = settle(j.withColumn("way", F.coalesce("direction", "prev_direction")).drop("direction", "prev_direction"))
    c, p, goal = F.col("current"), F.col("previous"), F.col("target_value")
    reached = F.coalesce(F.when(F.col("way").eqNullSafe("down"), c <= goal).otherwise(c >= goal), F.lit(False))
    surge = F.col("kpi").isin(*CAPACITY_KPIS) & (F.col("d0") > 0) & (F.col("d1") > F.col("d0")) & p.isNotNull() & c.isNotNull() & F.when(
        F.col("kpi") == "orders_turned_away", c - p <= F.col("d1") - F.col("d0")).otherwise(F.col("d1") >= 1.1 * F.col("d0"))
    j = settle(j.select("*", moved(F.col("way"), p, c).alias("move"), reached.alias("reached"), F.coalesce(surge, F.lit(False)).alias("surge"), (F.col("status") == "done").alias("done")))
    effect = (F.when(~F.col("done"), "not_judged").when(F.col("reached"), "reached_target").when(F.col("move") == 1, "moving").when(F.col("surge"), "inconclusive")
              .when(F.coalesce(F.col("move"), F.lit(0)) == 0, "no_change").otherwise("worse"))
    decision = (F.when(~F.col("done"), "retry").when(F.col("reached"), "double_down").when((F.col("move") == 1) | F.col("surge"), "keep").otherwise("drop"))
    return settle(j.select(*KEYS, "action_id", "action_key", "status", "done", "fact_id", "target_value", "previous", "current", effect.alias("effectiveness"), decision.alias("decision")))


def shared_targets(reviewed: DataFrame) -> DataFrame:
    """Done actions that aimed at the same number cannot split its change (at most three actions a week)."""
    n = reviewed.where("done").groupBy(*KEYS, "fact_id").agg(F.count(F.lit(1)).alias("aimed"))
    j = reviewed.join(n, [*KEYS, "fact_id"], "left")
    note = F.when(F.col("done") & (F.col("aimed") > 1), F.concat(F.col("aimed").cast("string"), F.lit(" done actions aimed at this number; the change cannot be split between them.")))
    return j.withColumn("attribution_note", note).drop("aimed")


def preferences(reviewed: DataFrame) -> DataFrame:
    def keys(*decisions):
        return F.array_join(F.array_sort(F.collect_set(F.when(F.col("decision").isin(*decisions), F.col("action_key")))), ",")

    return reviewed.groupBy(*KEYS).agg(keys("double_down", "keep").alias("boost"), keys("drop").alias("exclude"))


def preference_rows(reviewed: DataFrame) -> DataFrame:
    """Preferences as (business, week, action_key, preference), the input of `actions.apply_preferences`."""
    return reviewed.where("decision <> 'retry'").select(*KEYS, "action_key", F.when(F.col("decision") == "drop", "exclude").otherwise("boost").alias("preference")).distinct()


def _ids(status: str) -> Column:
    return F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == status, F.col("action_id")))), ",")


def followups(reviewed: DataFrame, facts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per (business, week): done, skipped and open actions, the main measure, and whether the bottleneck moved."""
    lists = reviewed.groupBy(*KEYS).agg(_ids("done").alias("actions_done"), _ids("skipped").alias("actions_skipped"), _ids("todo").alias("actions_open"))
    main = facts.where("fact_id = 'f_stranger_orders_week'").select(*KEYS, F.col("value").alias("current_measure"))
    before = main.select("business_id", (F.col("week_no") + 1).alias("week_no"), F.col("current_measure").alias("previous_measure"))
    v = verdicts.select(*KEYS, F.col("primary").alias("bottleneck"))
    pv = v.select("business_id", (F.col("week_no") + 1).alias("week_no"), F.col("bottleneck").alias("previous_bottleneck"))
    j = v.join(pv, KEYS).join(lists, KEYS, "left").join(main, KEYS, "left").join(before, KEYS, "left")
    b, p = F.col("bottleneck"), F.col("previous_bottleneck")
    words = lambda c: F.regexp_replace(c, "_", " ")
    first = (F.when(b.isNotNull() & ~b.eqNullSafe(p), F.concat(F.lit("The main bottleneck moved from "), words(F.coalesce(p, F.lit("none"))), F.lit(" to "), words(b), F.lit(": this week's actions switch to it.")))
             .when(p.isNotNull() & b.isNull(), F.concat(F.initcap(F.substring_index(words(p), " ", 1)), F.substr(words(p), F.length(F.substring_index(words(p), " ", 1)) + 1),
                                                        F.lit(" is back at your best weeks and nothing else is clearly off: keep doing what works."))))
    return j.select(*KEYS, *[F.coalesce(c, F.lit("")).alias(c) for c in ("actions_done", "actions_skipped", "actions_open")], "previous_measure", "current_measure",
                    half_even(F.col("current_measure") - F.col("previous_measure"), 4).alias("change"), "previous_bottleneck", "bottleneck", (~b.eqNullSafe(p)).alias("changed"), first.alias("adjustment"))


def arc(facts: DataFrame, reviewed: DataFrame) -> DataFrame:
    """First week against last: main measure, and which advice worked."""
    def at(fid, pick):
        return pick(F.when(F.col("fact_id") == fid, F.struct("week_no", "value")))["value"]

    ends = facts.groupBy("business_id").agg(at("f_stranger_orders_week", F.min).alias("orders_first"), at("f_stranger_orders_week", F.max).alias("orders_last"),
                                            at("f_stranger_share", F.min).alias("share_first"), at("f_stranger_share", F.max).alias("share_last"))
    label = F.concat(F.lit("week_"), (F.col("week_no") - 1).cast("string"), F.lit(" "), "action_key")

    def got(*effects):
        return F.array_join(F.array_sort(F.collect_list(F.when(F.col("effectiveness").isin(*effects), label))), ",")

    w = reviewed.groupBy("business_id").agg(got("reached_target", "moving").alias("worked"), got("no_change", "worse").alias("did_not_work"))
    return ends.join(w, "business_id", "left").fillna("", ["worked", "did_not_work"])


def partner_history(results: DataFrame) -> DataFrame:
    return results.groupBy("partner_id").agg(F.count(F.lit(1)).alias("collabs"), half_even(F.avg("stranger_leads"), 4).alias("mean_stranger_leads"))


def grade_outcomes(plans: DataFrame) -> DataFrame:
    """Outcome of executed plans against the range frozen at approval; the guardrail is judged apart.

    Rows carry tasks_total, tasks_done, low, high, baseline, actual, days_passed, window_days, guard_value, guard_max.
    """
    executed = F.col("tasks_done") == F.col("tasks_total")
    inside = F.col("actual").between(F.col("low"), F.col("high"))
    return plans.select(
        "plan_id", half_even(ratio(F.col("tasks_done"), F.col("tasks_total")), 4).alias("fidelity_rate"), executed.alias("executed"),
        F.when(F.col("baseline") != 0, half_even((F.col("actual") - F.col("baseline")) / F.col("baseline") * 100, 1)).alias("delta_vs_baseline_pct"),
        F.when(~executed | (F.col("days_passed") < F.col("window_days")), "inconclusive").when(inside, "promising").otherwise("not_effective").alias("effectiveness"),
        (F.col("guard_value") > F.col("guard_max")).alias("guardrail_breached"))
