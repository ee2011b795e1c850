"""Section J queries (the next-month view, J6, is with the diagnosis queries)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizlens.functions.numbers import half_even
from bizlens.operators import projection as pj
from bizlens.plans import bindings as bd
from bizlens.plans.bindings import Tables


def demand(s, d):
    t = Tables(s, d)
    return pj.weekly_demand(t.snapshots(), t.order_business().where("status <> 'P'"), t.turned_away())


def projection(s, d):
    t = Tables(s, d)
    return pj.project(t.snapshots(), t.order_business().where("status <> 'P'"), t.turned_away(), bd.event_windows(t), t.profile())


def j03(s, d):
    return pj.context_factor(pj.trend(demand(s, d)), bd.event_windows(Tables(s, d))).select(*pj.KEYS, *[half_even(F.col(c), 6).alias(c) for c in ("f_next", "f_hist", "factor")])


def j02(s, d):
    return pj.trend(demand(s, d)).select(*pj.KEYS, "n", *[half_even(F.col(c), 6).alias(c) for c in ("slope", "mean", "level", "sd")])


QUERIES = {
    "j01_weekly_demand": lambda s, d: demand(s, d).select(*pj.KEYS, F.col("week").cast("string").alias("week"), "orders", "turned_away", "demand"),
    "j02_trend": j02, "j03_context_factor": j03, "j04_j05_projection": projection,
}
