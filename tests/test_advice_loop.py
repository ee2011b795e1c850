"""The closed loop: a week's review steers the next week's choice, in one run or in two with written state."""

import datetime as dt

from pyspark.sql import functions as F

from bizlens.operators import advice_loop as al

CAND = ("business_id int, week_no int, as_of date, growth_minutes int, action_key string, bottleneck string, effort_min int, eligible boolean, blocked_reason string, "
        "score double, target_fact string, target_value double, current double, direction string, partner_id string, product_name string, place int")
FACT = "business_id int, week_no int, fact_id string, value double, direction string, kpi string, sample_kind string, sample_size bigint"
LIBRARY = [("collab", 80.0, 60), ("share", 70.0, 60), ("story", 69.0, 60)]  # key, score, minutes; 120 minutes hold two


def tables(spark, value_by_week, status=(), businesses=(1,), weeks=4):
    cands, facts, targets = [], [], []
    for b in businesses:
        for w in range(1, weeks + 1):
            day = dt.date(2026, 1, 5) + dt.timedelta(days=7 * w)
            for place, (key, score, minutes) in enumerate(LIBRARY):
                cands.append((b, w, day, 120, key, "reach", minutes, True, None, score, f"f_{key}", 100.0, 1.0, "up", None, None, place))
            for key, *_ in LIBRARY:
                facts.append((b, w, f"f_{key}", float(value_by_week[key][w - 1]), "up", "reach", "orders", 10))
            targets.append((b, w, "fix", "reach"))
    marks = spark.createDataFrame(list(status) or [("none", "todo")], "action_id string, status string")
    return (spark.createDataFrame(cands, CAND), spark.createDataFrame(targets, "business_id int, week_no int, mode string, bottleneck string"), marks, spark.createDataFrame(facts, FACT))


def done(b, *pairs):
    return [(f"act_{b}_w{w}_{k}", "done") for w, k in pairs]


def chosen(df):
    return {(r.week_no, r.action_key) for r in df.where("kind = 'action'").collect()}


def test_a_dropped_action_gives_way_for_one_week(spark):
    flat = {"collab": [5, 5, 5, 5], "share": [5, 6, 7, 8], "story": [5, 5, 5, 5]}
    out = al.advice_loop(*tables(spark, flat, done(1, (1, "collab"), (1, "share")))).cache()
    assert chosen(out) == {(1, "collab"), (1, "share"), (2, "share"), (2, "story"), (3, "collab"), (3, "share"), (4, "collab"), (4, "share")}
    w2 = {r.action_key: r for r in out.where("week_no = 2").collect()}
    assert (w2["collab"].kind, w2["collab"].blocked_reason, w2["collab"].preference) == ("blocked", al.DROPPED, "exclude")
    assert (w2["share"].score, w2["share"].preference, w2["story"].preference) == (80.0, "boost", None)
    w1 = {r.action_key: r.decision for r in out.where("week_no = 1").collect()}
    assert w1 == {"collab": "drop", "share": "keep", "story": None}


def test_without_anything_done_nothing_is_carried(spark):
    flat = {k: [5, 5, 5, 5] for k in ("collab", "share", "story")}
    out = al.advice_loop(*tables(spark, flat))
    assert chosen(out) == {(w, k) for w in range(1, 5) for k in ("collab", "share")} and out.where("preference is not null").count() == 0


def test_two_runs_with_written_state_equal_one(spark, tmp_path):
    value = {"collab": [5, 5, 9, 9], "share": [5, 4, 4, 9], "story": [5, 6, 5, 5]}
    marks = [(f"act_{b}_w{w}_{k}", "done" if (b + w) % 3 else "skipped") for b in range(6) for w in range(1, 5) for k, *_ in LIBRARY]
    cands, targets, status, facts = tables(spark, value, marks, businesses=range(6))
    whole = al.advice_loop(cands, targets, status, facts)
    first = al.advice_loop(cands.where("week_no <= 2"), targets.where("week_no <= 2"), status, facts)
    al.next_state(first).write.parquet(str(tmp_path / "state"))
    second = al.advice_loop(cands.where("week_no > 2"), targets.where("week_no > 2"), status, facts, spark.read.parquet(str(tmp_path / "state")))
    assert sorted(map(str, whole.collect())) == sorted(map(str, first.unionByName(second).collect()))
    assert whole.where("preference = 'exclude'").count() > 0 and whole.where("preference = 'boost'").count() > 0


def test_gap_in_weeks_and_empty_tables(spark):
    flat = {k: [5, 5, 5, 5] for k in ("collab", "share", "story")}
    cands, targets, status, facts = tables(spark, flat, done(1, (1, "collab"), (1, "share")))
    out = al.advice_loop(cands.where("week_no <> 2"), targets, status, facts)
    assert (3, "collab") in chosen(out) and out.where("preference is not null").count() == 0
    assert al.advice_loop(cands.where("false"), targets, status, facts).count() == 0


def test_evidence_lists_cards_in_order_then_the_partner(spark):
    flat = {k: [5, 5, 5, 5] for k in ("collab", "share", "story")}
    cands, targets, status, facts = tables(spark, flat, weeks=1)
    cands = cands.withColumn("partner_id", F.when(F.col("action_key") == "collab", "p7"))
    cards = spark.createDataFrame([(1, 1, "reach", "f_b", 2), (1, 1, "reach", "f_a", 1), (1, 1, "margin", "f_c", 1)], "business_id int, week_no int, bottleneck string, fact_id string, pos int")
    got = {r.action_key: r.evidence_ids for r in al.with_evidence(al.advice_loop(cands, targets, status, facts), cards).collect()}
    assert got == {"collab": "f_a,f_b,p7", "share": "f_a,f_b", "story": None}
