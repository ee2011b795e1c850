"""Event windows on a calendar: overlap, cover, next event, build-up, uplift, and share of days.

`windows` has (name, kind, window_start, window_end). Ranges meet windows through the months or days they touch, an
equi-join, never through a comparison of every pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizlens.functions.numbers import half_even, ratio

PLAN_DAYS = 21  # fixed value: windows that start later are not planned for


def _months(a: Column, b: Column) -> Column:
    return F.explode(F.sequence(F.trunc(a, "month"), F.trunc(b, "month"), F.expr("interval 1 month")))


def overlapping(ranges: DataFrame, windows: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """Windows that share a day with each range; one row per (range, name, start)."""
    r = ranges.select(*keys, lo, hi, _months(F.col(lo), F.col(hi)).alias("_m"))
    w = windows.select("name", "window_start", "window_end", _months(F.col("window_start"), F.col("window_end")).alias("_m"))
    hit = r.join(w, "_m").where((F.col(lo) <= F.col("window_end")) & (F.col("window_start") <= F.col(hi)))
    return hit.groupBy(*keys, "name", "window_start").agg(F.max("window_end").alias("window_end"))


def window_days(windows: DataFrame) -> DataFrame:
    return windows.select("name", "window_start", "window_end", F.explode(F.sequence("window_start", "window_end")).alias("day"))


def covering(days: DataFrame, windows: DataFrame, day: str) -> DataFrame:
    return days.join(window_days(windows).withColumnRenamed("day", day), day)


def next_event(days: DataFrame, windows: DataFrame, day: str) -> DataFrame:
    """First window end on or after each distinct day, and the days until it. Distinct days are few, so one ordered pass does."""
    marks = windows.groupBy(F.col("window_end").alias(day)).agg(F.min("name").alias("_name"))
    w = Window.orderBy(day).rowsBetween(0, Window.unboundedFollowing)
    all_days = days.select(day).distinct().withColumn("_ask", F.lit(True)).join(marks, day, "full_outer")
    nxt = F.first(F.when(F.col("_name").isNotNull(), F.struct("_name", day)), ignorenulls=True).over(w)
    return all_days.withColumn("_n", nxt).where("_ask").select(day, F.col("_n._name").alias("name"), F.datediff(F.col(f"_n.{day}"), F.col(day)).cast("bigint").alias("days_until"))


def phases(windows: DataFrame, before: int = 7, after: int = 3) -> DataFrame:
    """Build-up before and tail after each window (the tail's length is the caller's choice)."""
    return windows.select("name", "window_start", "window_end", F.date_sub("window_start", before).alias("build_from"), F.date_sub("window_start", 1).alias("build_to"),
                          F.date_add("window_end", 1).alias("tail_from"), F.date_add("window_end", after).alias("tail_to"))


def festival_windows(festivals: DataFrame) -> DataFrame:
    """Flagged festivals as windows from a week before to the day."""
    return festivals.where("demand_window").select("name", F.lit("festival").alias("kind"), F.date_sub("date", 7).alias("window_start"), F.col("date").alias("window_end"))


def uplift(series: DataFrame, windows: DataFrame) -> DataFrame:
    """Mean views on window days against other days, per season and overall. `series` is (date, views)."""
    inside = window_days(windows).select(F.col("day").alias("date")).distinct().withColumn("_in", F.lit(True))
    daily = series.join(inside, "date", "left").withColumn("season", F.year("date").cast("string"))
    on, off = F.col("_in").isNotNull(), F.col("_in").isNull()
    g = daily.rollup("season").agg(F.count(F.when(on, 1)).alias("weekend_days"), F.count(F.when(off, 1)).alias("other_days"),
                                   F.sum(F.when(on, F.col("views"))).alias("a"), F.sum(F.when(off, F.col("views"))).alias("b"))
    m1, m2 = ratio(F.col("a"), F.col("weekend_days")), ratio(F.col("b"), F.col("other_days"))
    return g.select(F.coalesce("season", F.lit("overall")).alias("season"), "weekend_days", "other_days", half_even(m1, 3).alias("mean_weekend"),
                    half_even(m2, 3).alias("mean_other"), half_even(ratio(m1, m2), 3).alias("uplift"))


def inside_share(ranges: DataFrame, windows: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """Share of a range's days that lie in any window (each day once)."""
    days = window_days(windows).select("day").distinct()
    r = ranges.select(*keys, lo, hi, F.explode(F.sequence(lo, hi)).alias("day"))
    g = r.join(days.withColumn("_in", F.lit(1)), "day", "left").groupBy(*keys, lo, hi).agg(F.count("_in").alias("inside_days"))
    return g.withColumn("share", F.col("inside_days") / (F.datediff(hi, lo) + 1))


def upcoming(snapshots: DataFrame, windows: DataFrame, keys: list[str], days: int = PLAN_DAYS) -> DataFrame:
    """Windows that start after the snapshot day and within `days` of it."""
    ranges = snapshots.select(*keys, "as_of", F.date_add("as_of", 1).alias("lo"), F.date_add("as_of", days).alias("hi"))
    hit = overlapping(ranges, windows, [*keys, "as_of"], "lo", "hi")
    return hit.where((F.col("window_start") > F.col("as_of")) & (F.col("window_start") <= F.date_add("as_of", days)))
