"""Section I queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizlens.operators import calendar as cal
from bizlens.plans import bindings as bd
from bizlens.plans.bindings import Tables
from bizlens.plans.queries.leads import day as text_days


def windows(s, d):
    return bd.event_windows(Tables(s, d))


def order_days(s, d):
    return Tables(s, d).read("orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()


def ranges(s, d):
    return Tables(s, d).snapshots().select("business_id", "week_no", "as_of", F.date_add("as_of", 27).alias("hi"))


def series(s, d):
    e = Tables(s, d).events().where("event_type = 'view'").groupBy(F.col("day").alias("date")).agg(F.count(F.lit(1)).alias("views"))
    o = Tables(s, d).read("orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("views"))
    return e.unionByName(o)


QUERIES = {
    "i01_overlapping_windows": lambda s, d: text_days(cal.overlapping(ranges(s, d), windows(s, d), ["business_id", "week_no"], "as_of", "hi")),
    "i02_covering_window": lambda s, d: text_days(cal.covering(order_days(s, d), windows(s, d), "day")),
    "i03_next_event": lambda s, d: text_days(cal.next_event(order_days(s, d), windows(s, d), "day")),
    "i04_build_up_and_tail": lambda s, d: text_days(cal.phases(windows(s, d))),
    "i05_festival_windows": lambda s, d: text_days(cal.festival_windows(bd.festivals(Tables(s, d)))),
    "i06_interest_uplift": lambda s, d: cal.uplift(series(s, d), windows(s, d)),
    "i07_inside_share": lambda s, d: text_days(cal.inside_share(ranges(s, d), windows(s, d), ["business_id", "week_no"], "as_of", "hi")),
    "i08_upcoming_windows": lambda s, d: text_days(cal.upcoming(Tables(s, d).snapshots(), windows(s, d), ["business_id", "week_no"])),
}
