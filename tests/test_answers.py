"""Rules for answers, and closed leads by snapshot."""

from datetime import date

from bizlens.operators import actions
from bizlens.operators.grounding import answer_errors
from bizlens.operators.outreach import closed_outcomes


def test_an_answer_with_numbers_must_cite(spark):
    answers = spark.createDataFrame([(1, "It rose to 12.", 1), (2, "It rose to 12.", 0), (3, "It rose.", 0), (4, "It rose to 99.", 0), (5, None, 1), (6, "It rose to 12.", 1), (7, "x" * 901, 0), (8, "Up by 3.", None)],
                                    "id int, text string, cited int")
    unknown = spark.createDataFrame([(6, "f_b"), (6, "f_a")], "id int, fact_id string")
    numbers = spark.createDataFrame([(4, "99")], "id int, token string")
    got = {r["id"]: r["errors"] for r in answer_errors(answers, unknown, numbers, ["id"]).collect()}
    assert got == {1: "", 2: "numbers without a cited fact", 3: "", 4: "numbers not in the evidence packet: 99", 5: "schema", 6: "unknown citations: f_a,f_b", 7: "schema",
                   8: "numbers without a cited fact"}


def test_closed_leads_are_counted_up_to_each_snapshot(spark):
    leads = spark.createDataFrame([(1, "ordered", date(2024, 1, 2)), (1, "not_ordered", date(2024, 1, 9)), (1, "open", None), (1, "ordered", None), (2, "ordered", date(2024, 1, 8))],
                                  "business_id int, outcome string, outcome_date date")
    snaps = spark.createDataFrame([(b, date(2024, 1, d)) for b in (1, 2, 3) for d in (8, 15)], "business_id int, as_of date")
    got = {(r["business_id"], r["as_of"].day): (r["ordered"], r["not_ordered"]) for r in closed_outcomes(leads, snaps).collect()}
    assert got == {(1, 8): (1, 0), (1, 15): (1, 1), (2, 8): (0, 0), (2, 15): (1, 0), (3, 8): (0, 0), (3, 15): (0, 0)}


def test_forbidden_kinds_never_pass_the_gate_and_visible_actions_carry_high_risk(spark):
    profile = spark.createDataFrame([(1, 900, 0, ["pricing"]), (2, 900, 0, None)], "business_id int, growth_minutes long, ad_budget_inr long, forbidden_actions array<string>")
    snaps = spark.createDataFrame([(b, 1, date(2024, 1, 8)) for b in (1, 2)], "business_id int, week_no int, as_of date")
    partners = spark.createDataFrame([], "business_id int, top_partner string, top_score double, community string, community_score double")
    products = spark.createDataFrame([], "business_id int, low_margin_product string, missing_costs long, most_asked string")
    upcoming = spark.createDataFrame([], "business_id int, week_no int, window_start date")
    facts = spark.createDataFrame([], "business_id int, week_no int, fact_id string, value double, baseline double, direction string, denominator double")
    lib = actions.library(spark)

    def blocked(p):
        c = actions.candidates(actions.situation(snaps, p, partners, upcoming, products, facts), lib, facts).join(lib.select("action_key", "kind"), "action_key")
        return {r["business_id"] for r in c.where("kind = 'pricing' and blocked_reason like 'Needs INR%'").collect()}, c

    assert blocked(profile)[0] == {1}
    assert blocked(profile.drop("forbidden_actions"))[0] == set()
    risk = actions.brand_risk(actions.protected_matches(spark.createDataFrame([(1, "Nike cap"), (1, "Plain cap"), (2, "Nikes")], "business_id int, name string")))
    rows = actions.action_risk(blocked(profile)[1], risk).join(lib.select("action_key", "raises_visibility"), "action_key").collect()
    assert len(rows) == 16 and all((r["business_id"], r["terms"], r["products"]) == (1, "Nike", 1) and r["level"] == ("high" if r["raises_visibility"] else "medium") for r in rows)
