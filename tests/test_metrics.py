"""Worked examples: order metrics, lines, baseline weeks, leads, model, projection, follow-up, calendar."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from bizlens.functions import model as mdl
from bizlens.operators import calendar as cal
from bizlens.operators import d2c, diagnosis, followup, leads, outreach, projection
from bizlens.operators import order_metrics as om


def test_order_metrics(spark):
    rows = [("1", "2026-01-01", "A", 100), ("2", "2026-01-11", "A", 100), ("3", "2026-02-10", "A", 550), ("4", "2026-01-05", "B", 100), ("5", "2026-01-25", "B", 100), ("6", "2026-03-01", "C", 50), ("7", "2026-03-02", None, 70)]
    df = spark.createDataFrame([(1, o, date.fromisoformat(d), c, float(r)) for o, d, c, r in rows], "business_id int, order_id string, day date, customer string, revenue double").withColumn("revenue", F.col("revenue").cast("decimal(18,4)"))
    t = om.totals(df).first()
    assert (t.orders, t.orders_without_customer, t.customers, t.revenue_total, t.first_order, t.last_order) == (7, 1, 3, 1070.0, "2026-01-01", "2026-03-02")
    assert om.repeat_customers(df).first().repeat_customer_share == round(2 / 3, 4)
    g = om.days_between_orders(df).first()
    assert (g.gaps, g.median_days, g.p90_days) == (3, 20.0, 28.0)
    c = om.concentration(df).first()
    assert (c.top_1, c.top_10, c.single_customer_over_30pct) == (0.75, 1.0, True)
    assert om.pareto_share(df).first().customer_share_for_80pct == round(2 / 3, 4)


def test_line_rollup(spark):
    rows = [("1001", "85123A", 2, 3.0, "17850"), ("1001", "21730", 1, 4.0, "17850"), ("C1002", "85123A", -1, 3.0, "17850"), ("1003", "POST", 1, 18.0, "17850"), ("1004", "22423", 0, 5.0, "17850"),
            ("1005", "22423", 3, 2.0, ""), ("1006", "22423", 1, 2.0, "12347")]
    df = spark.createDataFrame(rows, "invoice string, stock_code string, quantity int, price double, customer_id string").withColumn("day", F.lit("2010-03-01").cast("date"))
    q = om.line_quality(df).first()
    assert (q.lines, q.cancellation_lines, q.non_product_lines, q.non_positive_quantity_or_price_lines, q.missing_customer_id_lines) == (7, 1, 1, 1, 1)
    got = {r.order_id: (r.revenue, r.customer) for r in om.orders_from_lines(df).collect()}
    assert got == {"1001": (10.0, "17850"), "1005": (6.0, None), "1006": (2.0, "12347")}


@pytest.mark.parametrize("lo,a,b", [("2026-09-27", "2026-08-30", "2026-09-26"), ("2026-10-05", "2026-09-06", "2026-10-03")])
def test_baseline_window(spark, lo, a, b):
    r = spark.createDataFrame([(lo,)], "d string").select(d2c.baseline_end(F.col("d").cast("date")).alias("e")).select(F.date_sub("e", 27).alias("a"), F.col("e").alias("b")).first()
    assert (str(r.a), str(r.b)) == (a, b)


def test_lead_scores_and_decay(spark):
    base = "business_id int, lead_id string, relationship string, city string, size string, design string, product string, product_text string, intents array<string>, serves_cities array<string>, serves_sizes array<string>, outcome string, outcome_date date"
    lead = lambda i, rel="friend", city=None: (1, i, rel, city, None, None, None, None, ["product_interest"], ["Pune"], ["M"], "open", None)
    L = spark.createDataFrame([lead("A", "stranger"), lead("B"), lead("C"), lead("E", city="Jaipur")], base)
    sig = [("A", "price_question", "2026-10-01"), ("A", "saved_or_shared", "2026-10-01"), ("A", "comment", "2026-10-02"), ("A", "comment", "2026-10-03"), ("B", "price_question", "2026-10-01"), ("B", "comment", "2026-10-01"),
           ("C", "saved_or_shared", "2026-09-01"), ("C", "story_reply", "2026-09-02"), ("E", "price_question", "2026-10-01")]
    S = spark.createDataFrame([(1, i, t, date.fromisoformat(d)) for i, t, d in sig], "business_id int, lead_id string, type string, date date")
    snaps = spark.createDataFrame([(1, date(2026, 10, 1)), (1, date(2026, 10, 3))], "business_id int, as_of date")
    got = {(r.lead_id, str(r.as_of)): (r.score, r.group, r["rank"]) for r in leads.ranked(leads.daily_list(L, S, snaps)).collect()}
    assert got[("A", "2026-10-03")] == (75, "hot", 1) and got[("B", "2026-10-03")] == (50, "hot", 2) and got[("E", "2026-10-03")][1:] == ("disqualified", None)
    assert got[("C", "2026-10-01")][0] == 35 and got[("C", "2026-10-03")][0] == 15  # 29 silent days, then 31
    assert ("A", "2026-10-01") not in got  # nothing seen yet


def test_spearman(spark):
    df = spark.createDataFrame([("up", i, i * 2.0) for i in range(5)] + [("down", i, -1.0 * i) for i in range(5)] + [("two", i, 1.0 * i) for i in range(2)], "g string, a int, b double")
    assert {r.g: r.spearman for r in leads.spearman(df, "g", "a", "b").collect()} == {"up": 1.0, "down": -1.0, "two": None}


def test_model_expressions(spark):
    df = spark.createDataFrame([("success", 3, 2, 1), ("nonexistent", 0, 999, 2), ("failure", 9, 45, 99)], "previous_outcome string, prior_contacts int, days_since_last_contact int, contacts_this_campaign int")
    enc = [[r[f"x{i}"] for i in range(6)] for r in df.select(*[c.alias(f"x{i}") for i, c in enumerate(mdl.encode(mdl.columns_of()))]).collect()]
    assert enc == [[0, 1, 3, 0, 2, 1], [0, 0, 0, 1, 0, 2], [1, 0, 7, 0, 30, 10]]
    p = spark.createDataFrame([(-1.0,), (0.25,), (2.0,)], "p double").select(mdl.calibrate_isotonic(F.col("p"), [0, .5, 1], [.1, .4, .9]).alias("q")).collect()
    assert [round(r.q, 6) for r in p] == [0.1, 0.25, 0.9]
    ps = [r.p for r in mdl.with_probability(df).orderBy(F.desc("previous_outcome")).collect()]
    assert ps[0] > ps[1]


def _project(spark, counts, away=(), capacity=None):
    n = len(counts)
    monday = date(2026, 1, 5)
    at = lambda k: date.fromordinal(monday.toordinal() + 7 * k)
    mk = lambda cs: spark.createDataFrame([(1, at(k)) for k, c in enumerate(cs) for _ in range(c)] or [(2, monday)], "business_id int, date date")
    snaps = spark.createDataFrame([(1, 1, at(n), monday)], "business_id int, week_no int, as_of date, history_start date")
    w = spark.createDataFrame([("far", date(2030, 1, 1), date(2030, 1, 2))], "name string, window_start date, window_end date")
    prof = spark.createDataFrame([(1, capacity)], "business_id int, capacity int")
    return projection.project(snaps, mk(counts), mk(away), w, prof).first()


def test_projection(spark):
    r = _project(spark, [10] * 8)
    assert (r.demand_low, r.demand_expected, r.demand_high, r.confidence) == (40, 40, 40, "medium")
    r = _project(spark, [6, 8, 10, 12, 14, 16, 18, 20])
    assert [r.week_1, r.week_2, r.week_3, r.week_4, r.demand_expected] == [21, 22, 23, 24, 90]
    r = _project(spark, [14] * 8, [3] * 8, 14)
    assert (r.demand_expected, r.orders_expected, r.orders_lost) == (68, 56, 12)
    r = _project(spark, [10] * 5)
    assert r.orders_expected is None and r.confidence == "none" and "Only 5 weeks" in r.message


def test_calendar(spark):
    w = spark.createDataFrame([("A", date(2026, 10, 2), date(2026, 10, 4)), ("B", date(2026, 10, 9), date(2026, 10, 11)), ("C", date(2026, 10, 31), date(2026, 11, 2))], "name string, window_start date, window_end date")
    r = spark.createDataFrame([(1, date(2026, 10, 4), date(2026, 10, 31))], "k int, lo date, hi date")
    assert {x.name for x in cal.overlapping(r, w, ["k"], "lo", "hi").collect()} == {"A", "B", "C"}
    days = spark.createDataFrame([(date(2026, 10, 5),), (date(2026, 10, 4),), (date(2026, 12, 30),)], "day date")
    assert {str(x.day): (x.name, x.days_until) for x in cal.next_event(days, w, "day").collect()} == {"2026-10-05": ("B", 6), "2026-10-04": ("A", 0), "2026-12-30": (None, None)}
    assert cal.inside_share(r, w, ["k"], "lo", "hi").first().inside_days == 5


def _fact(fid, kpi, week, value, unit="count", sample=40, direction="down", kind="orders", **k):
    return dict(business_id=1, week_no=week, fact_id=fid, kpi=kpi, value=float(value), unit=unit, sample_size=sample, sample_kind=kind, direction=direction, **k)


def test_reviews_and_surge(spark):
    acts = spark.createDataFrame([(1, 1, f"a{g}", f"k{g}", "done", "f_x", 5.0, "action") for g in (3, 4, 5)] + [(1, 1, "t", "kt", "done", "f_orders_turned_away", 0.0, "action"), (1, 1, "s", "ks", "skipped", "f_x", 5.0, "action")],
                                 "business_id int, week_no int, action_id string, action_key string, status string, target_fact string, target_value double, kind string")
    for cur, want in ((3, ("no_change", "drop")), (4, ("moving", "keep")), (5, ("reached_target", "double_down"))):
        rows = [_fact("f_x", "x", 1, 3, direction="up"), _fact("f_x", "x", 2, cur, direction="up"), _fact("f_orders_turned_away", "orders_turned_away", 1, 7), _fact("f_orders_turned_away", "orders_turned_away", 2, 23, sample=50)]
        r = {x.action_id: (x.effectiveness, x.decision) for x in followup.reviews(acts, spark.createDataFrame(rows)).collect()}
        assert r["a3"] == want and r["s"] == ("not_judged", "retry") and r["t"] == ("inconclusive", "keep")


def test_diagnosis_gap_and_unmet_parser(spark):
    f = _fact("f_stranger_orders_week", "stranger_orders_per_week", 1, 1.5, unit="orders/week", direction="up", baseline=3.25, better="higher", gap_to_best=0.5385, denominator=4.0, bottleneck="reach",
              dimension="", quality_flag="ok", source="derived", origin="o", numerator=6.0)
    r = diagnosis.rated_facts(spark.createDataFrame([f])).first()
    assert (r.gap, r.amount, r.what, r.material) == (0.5385, 7.0, "orders", True)
    k, v, p = outreach.parse_unmet(F.col("r"))
    got = [(x.k, x.v, x.p) for x in spark.createDataFrame([("size: XXL is not available",), ("city: cannot deliver to Jaipur",)], "r string").select(k.alias("k"), v.alias("v"), p.alias("p")).collect()]
    assert got == [("size", "XXL", "make size XXL"), ("city", "Jaipur", "deliver to Jaipur")]
