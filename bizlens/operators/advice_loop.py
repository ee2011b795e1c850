"""Weekly advice as a closed loop: what the review of one week's actions found steers the choice of the week after.

What a review would say of an action does not depend on whether it is chosen, so all candidates of all weeks are reviewed
in one pass. Only the choice itself goes week by week: per business a fold over its weeks, with at most five candidates a
week, so a business's rows are bounded by the calendar and not by its orders. The state between two weeks is the table of
preferences; it can be written, and a later run goes on from it.

A week without a bottleneck to work on chooses nothing; where the week before is missing, or its action was not done,
nothing is carried over. Null statuses count as to do. An empty table of candidates gives empty results.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.operators import actions as ac
from bizlens.operators import followup as fu
from bizlens.operators.skew import settle

KEYS = ["business_id", "week_no"]
BONUS = 10  # fixed value: points of an action that worked
DROPPED = "Dropped after last week's follow-up: the number did not move."  # fixed value
STATE = "business_id long, week_no long, action_key string, preference string"
FOLDED = "business_id long, week_no long, action_key string, excluded boolean, score double, chosen boolean, preference string"


def with_action_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("action_id", F.concat(F.lit("act_"), F.col("business_id").cast("string"), F.lit("_w"), F.col("week_no").cast("string"), F.lit("_"), "action_key"))


def verdict_of_each(mine: DataFrame, status: DataFrame, facts: DataFrame) -> DataFrame:
    """What next week's review says of every candidate if it is chosen: (business, week, action_key, decision)."""
    marked = with_action_id(mine).join(status, "action_id", "left")
    as_chosen = marked.select("*", F.lit("action").alias("kind")).withColumn("status", F.coalesce("status", F.lit("todo")))
    return fu.reviews(as_chosen, facts).select("business_id", (F.col("week_no") - 1).alias("week_no"), "action_key", "decision")


def _weeks_of_a_business(rows: pd.DataFrame, carried: dict[tuple[int, str], str]) -> list[tuple]:
    """The fold: `carried` are preferences by (week, action) from before the first week."""
    out, prefs = [], dict(carried)
    for week, group in rows.groupby("week_no", sort=True):
        minutes, ranked = int(group["growth_minutes"].iloc[0]), []
        for r in group.itertuples(index=False):
            pref = prefs.get((week, r.action_key))
            excluded = pref == "exclude" and bool(r.eligible)
            ranked.append((-round(r.score + BONUS, 1) if pref == "boost" else -r.score, r.effort_min, r.place, r.action_key, bool(r.eligible) and not excluded, excluded, pref, r.decision))
        used, chosen = 0, set()
        for _, effort, _, key, eligible, *_ in sorted(ranked, key=lambda t: t[:4]):
            if eligible and len(chosen) < ac.MAX_ACTIONS and used + effort <= minutes:
                used += int(effort)
                chosen.add(key)
        prefs = {}
        for minus, _, _, key, _, excluded, pref, decision in ranked:
            out.append((week, key, excluded, -minus, key in chosen, pref))
            if key in chosen and decision in ("drop", "keep", "double_down"):
                prefs[(week + 1, key)] = "exclude" if decision == "drop" else "boost"
    return out


def advice_loop(cands: DataFrame, targets: DataFrame, status: DataFrame, facts: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Chosen, blocked and not chosen actions of every week's bottleneck, each week steered by the review of the one before.

    `state` holds the preferences (STATE) that earlier weeks left; `next_state` derives it from a result.
    Adds to the columns of `actions.week_actions`: preference, and decision (what next week's review says; null where
    that week has no facts or the action is not chosen).
    """
    mine = cands.join(targets, [*KEYS, "bottleneck"]).where("bottleneck is not null")
    mine = mine.join(verdict_of_each(mine, status, facts), [*KEYS, "action_key"], "left")
    narrow = mine.select(F.col("business_id").cast("long"), F.col("week_no").cast("long"), "action_key", "eligible", "score", "effort_min", "place", "growth_minutes", "decision")
    before = (state if state is not None else cands.sparkSession.createDataFrame([], STATE)).select(
        F.col("business_id").cast("long"), F.col("week_no").cast("long"), "action_key", "preference")

    def fold(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["business_id", "week_no", "action_key", "excluded", "score", "chosen", "preference"]
        if left.empty:
            return pd.DataFrame(columns=names)
        carried = {(r.week_no, r.action_key): r.preference for r in right.itertuples(index=False)}
        rows = _weeks_of_a_business(left, carried)
        return pd.DataFrame([(left["business_id"].iloc[0], *r) for r in rows], columns=names)

    folded = narrow.groupBy("business_id").cogroup(before.groupBy("business_id")).applyInPandas(fold, FOLDED)
    j = mine.drop("score").join(folded, [*KEYS, "action_key"])
    j = settle(j.withColumn("eligible", F.col("eligible") & ~F.col("excluded")).withColumn("blocked_reason", F.when(F.col("excluded"), DROPPED).otherwise(F.col("blocked_reason"))))
    s = with_action_id(j).join(status, "action_id", "left")
    kind = F.when(F.col("chosen"), "action").when(~F.col("eligible"), "blocked").otherwise("not_chosen")
    return s.select(*KEYS, "action_id", "action_key", "bottleneck", "mode", kind.alias("kind"), "effort_min", "score", "blocked_reason", "target_fact", "target_value", "current", "direction",
                    F.when(F.col("chosen"), F.date_add("as_of", 7).cast("string")).alias("due"), F.when(F.col("chosen"), F.coalesce("status", F.lit("todo"))).alias("status"), "partner_id",
                    "product_name", "preference", F.when(F.col("chosen"), F.col("decision")).alias("decision"))


def next_state(advice: DataFrame) -> DataFrame:
    """The preferences (STATE) that the weeks of a result leave to the weeks after them."""
    told = advice.where("kind = 'action' and decision in ('drop', 'keep', 'double_down')")
    return told.select(F.col("business_id").cast("long"), (F.col("week_no") + 1).cast("long").alias("week_no"), "action_key",
                       F.when(F.col("decision") == "drop", "exclude").otherwise("boost").alias("preference"))


def with_evidence(advice: DataFrame, cards: DataFrame) -> DataFrame:
    """Evidence ids of each chosen action: the facts of its bottleneck's cards in their order, then the partner."""
    facts = cards.groupBy(*KEYS, "bottleneck").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fact_id"))), lambda x: x["fact_id"]).alias("_ids"))  # at most a handful of facts a bottleneck
    ids = F.array_join(F.concat(F.coalesce("_ids", F.array().cast("array<string>")), F.array_compact(F.array("partner_id").cast("array<string>"))), ",")
    return advice.join(facts, [*KEYS, "bottleneck"], "left").withColumn("evidence_ids", F.when(F.col("kind") == "action", ids)).drop("_ids")
