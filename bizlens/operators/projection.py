"""Next month's demand per business and snapshot: damped trend, context factor, a range, and the capacity cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.functions.numbers import half_even, ratio
from bizlens.operators import calendar as cal
from bizlens.operators.facts import week_grid, weekly_events
from bizlens.operators.skew import settle

# fixed values
MIN_WEEKS, MAX_WEEKS, DAMPING, Z80, CONTEXT_EFFECT = 6, 8, 0.5, 1.2816, 0.3
KEYS = ["business_id", "week_no"]


def weekly_demand(snapshots: DataFrame, orders: DataFrame, turned_away: DataFrame) -> DataFrame:
    """Orders plus requests turned away in each of the last 8 complete weeks; x counts from the oldest."""
    grid = week_grid(snapshots).withColumn("back", (F.datediff("as_of", "week") / 7).cast("int")).where(F.col("back") <= MAX_WEEKS)
    g = grid.join(weekly_events(orders, "o"), ["business_id", "week"], "left").join(weekly_events(turned_away, "t"), ["business_id", "week"], "left")
    return g.select(*KEYS, "as_of", "week", "back", F.coalesce("o", F.lit(0)).alias("orders"), F.coalesce("t", F.lit(0)).alias("turned_away"),
                    (F.coalesce("o", F.lit(0)) + F.coalesce("t", F.lit(0))).alias("demand"))


def trend(demand: DataFrame) -> DataFrame:
    """Least squares over the weeks, from five sums; residual deviation on n - 2."""
    y, x = F.col("demand"), -F.col("back")
    s = demand.groupBy(*KEYS, "as_of").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"),
                                           F.sum(y * y).alias("syy"), F.min("week").alias("hist_from"))
    n = F.col("n")
    s = settle(s.select(*KEYS, "as_of", "n", "sx", "sy", "hist_from", (F.col("sxx") - F.col("sx") * F.col("sx") / n).alias("cxx"),
                        (F.col("sxy") - F.col("sx") * F.col("sy") / n).alias("cxy"), (F.col("syy") - F.col("sy") * F.col("sy") / n).alias("cyy")))
    slope = F.when(F.col("cxx") > 0, F.col("cxy") / F.col("cxx")).otherwise(0.0)
    s = settle(s.withColumn("slope", slope))
    my = F.col("sy") / n
    resid = F.greatest(F.col("cyy") - F.col("slope") * F.col("cxy"), F.lit(0.0))
    level = my + F.col("slope") * (F.lit(-1) - F.col("sx") / n)  # fitted demand of the last week (x = -1)
    return settle(s.select(*KEYS, "as_of", "n", "hist_from", "slope", my.alias("mean"), level.alias("level"), F.sqrt(resid / F.greatest(F.lit(1), n - 2)).alias("sd")))


def context_factor(trends: DataFrame, windows: DataFrame, effect: float = CONTEXT_EFFECT) -> DataFrame:
    r = trends.select(*KEYS, F.explode(F.array(
        F.struct(F.lit("next").alias("side"), F.col("as_of").alias("lo"), F.date_add("as_of", 27).alias("hi")),
        F.struct(F.lit("hist").alias("side"), F.col("hist_from").alias("lo"), F.date_sub("as_of", 1).alias("hi")))).alias("r")).select(*KEYS, "r.*")
    s = cal.inside_share(r, windows, [*KEYS, "side"], "lo", "hi")
    p = s.groupBy(*KEYS).agg(F.max(F.when(F.col("side") == "next", F.col("share"))).alias("f_next"), F.max(F.when(F.col("side") == "hist", F.col("share"))).alias("f_hist"))
    return settle(p.withColumn("factor", (1 + effect * F.col("f_next")) / (1 + effect * F.col("f_hist"))))


def path(k: int) -> Column:
    return F.greatest(F.lit(0.0), (F.col("level") + F.lit(DAMPING) * F.col("slope") * k) * F.col("factor"))


def project(snapshots: DataFrame, orders: DataFrame, turned_away: DataFrame, windows: DataFrame, profile: DataFrame) -> DataFrame:
    t = trend(weekly_demand(snapshots, orders, turned_away))
    enough = F.col("n") >= MIN_WEEKS
    j = t.join(context_factor(t, windows), KEYS).join(profile.select("business_id", "capacity"), "business_id", "left")
    weeks = [path(k) for k in (1, 2, 3, 4)]
    j = settle(j.select("*", *[w.alias(f"w{i + 1}") for i, w in enumerate(weeks)]))
    j = settle(j.withColumn("expected", F.col("w1") + F.col("w2") + F.col("w3") + F.col("w4")).withColumn("half", F.lit(Z80) * F.col("sd") * 2))
    low, high = F.greatest(F.lit(0.0), F.col("expected") - F.col("half")), F.col("expected") + F.col("half")
    limit = F.col("capacity") * 4

    def if_enough(c):
        return F.when(enough, c)

    def capped(c):
        return half_even(F.when(limit.isNull(), c).otherwise(F.least(c, limit.cast("double"))), 0)

    expected = F.col("expected")
    return j.select(
        *KEYS, F.col("as_of").cast("string").alias("month_from"), F.date_add("as_of", 27).cast("string").alias("month_to"), F.col("n").alias("weeks_used"),
        *[if_enough(half_even(F.col(f"w{k}"), 1)).alias(f"week_{k}") for k in (1, 2, 3, 4)],
        if_enough(half_even(low, 0)).alias("demand_low"), if_enough(half_even(expected, 0)).alias("demand_expected"), if_enough(half_even(high, 0)).alias("demand_high"),
        if_enough(capped(low)).alias("orders_low"), if_enough(capped(expected)).alias("orders_expected"), if_enough(capped(high)).alias("orders_high"),
        if_enough(half_even(F.col("slope"), 2)).alias("trend_per_week"), if_enough(half_even(F.col("sd"), 2)).alias("weekly_scatter_sd"), if_enough(half_even(F.col("factor"), 3)).alias("context_factor"),
        if_enough(F.coalesce(expected > limit, F.lit(False))).alias("demand_exceeds_capacity"),
        if_enough(F.greatest(F.lit(0.0), half_even(expected, 0) - limit)).alias("orders_lost"),
        F.when(~enough, "none").when((F.col("n") < MAX_WEEKS) | ((F.col("mean") > 0) & (ratio(F.col("sd"), F.col("mean")) > 0.35)), "low").otherwise("medium").alias("confidence"),
        F.when(~enough, F.format_string("Only %d weeks of history; at least 6 are needed to project. Not projecting.", F.col("n"))).alias("message"))
