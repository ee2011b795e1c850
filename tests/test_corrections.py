"""The owner's corrections to leads."""

from datetime import date

from pyspark.sql import functions as F

from bizlens.operators.leads import apply_corrections


def test_outcomes_take_their_date_with_them_and_intents_are_lists(spark):
    leads = spark.createDataFrame([(i, "friend", "ordered", date(2024, 1, 9), "general_praise") for i in "abcde"],
                                  "lead_id string, relationship string, outcome string, outcome_date date, intent string")
    rows = [("a", 1, "outcome", "not_ordered", date(2024, 1, 3)), ("a", 2, "outcome", "open", None), ("b", 1, "outcome", "not_ordered", None), ("c", 2, "outcome", "ordered", date(2024, 1, 4)),
            ("c", 1, "outcome", "open", None), ("d", 1, "intents", "custom_request,buying_question", None), ("d", 2, "intents", "buying_question,maybe", None), ("d", 3, "intents", "", None),
            ("e", 1, "relationship", "enemy", None), ("e", 2, None, "friend", None), ("e", 3, "outcome", None, None), ("z", 1, "outcome", "open", None)]
    fixed, refused = apply_corrections(leads, spark.createDataFrame(rows, "lead_id string, at int, field string, value string, outcome_date date"), F.lit("2024-02-05").cast("date"))
    got = {r["lead_id"]: (r["outcome"], r["outcome_date"], r["intent"], r["intents"], r["intents_corrected"]) for r in fixed.collect()}
    same = ("general_praise", ["general_praise"], False)
    assert got == {"a": ("open", None, *same), "b": ("not_ordered", date(2024, 2, 4), *same), "c": ("ordered", date(2024, 1, 4), *same),
                   "d": ("ordered", date(2024, 1, 9), "custom_request", ["custom_request", "buying_question"], True), "e": ("ordered", date(2024, 1, 9), *same)}
    assert sorted((r["lead_id"], r["at"]) for r in refused.collect()) == [("d", 2), ("d", 3), ("e", 1), ("e", 2), ("e", 3)]
