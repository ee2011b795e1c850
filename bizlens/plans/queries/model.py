"""Section H queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizlens.functions import model as mdl
from bizlens.functions.numbers import half_even
from bizlens.operators import model as om
from bizlens.operators import training as tr
from bizlens.plans import bindings as bd
from bizlens.plans.bindings import Tables
from bizlens.session import scratch_path
from bizlens.sources.tables import materialise, stored

ISOTONIC = ((0.0, 0.5, 1.0), (0.1, 0.4, 0.9))


def contact(s, d):
    return stored(s, d, "contacts", lambda: bd.contact_history(Tables(s, d)))


def gappy(s, d):
    k = F.col("order_id")
    return contact(s, d).withColumn("prior_contacts", F.when(k % 60 != 0, F.col("prior_contacts"))).withColumn(
        "previous_outcome", F.when(k % 70 == 0, "maybe").otherwise(F.col("previous_outcome"))).withColumn("channel", F.when(k % 50 != 0, "web")).withColumn(
        "lead_id", k).withColumn("expected_value_inr", k % 1000)


def split_rows(s, d):
    return stored(s, d, "split", lambda: om.split(om.years_from_months(om.chronological(contact(s, d), "day", "order_id"), 1995), 1996))


def hold_out_scores(s, d):
    """The stored model, its calibrated form and the constant base rate on the hold-out; scores to 9 digits so ties are ties."""
    t = mdl.with_probability(split_rows(s, d).where("hold_out"))
    rows = t.select("idx", "y", F.explode(F.array(
        F.struct(F.lit("uncalibrated").alias("model"), F.col("raw_p").alias("p")), F.struct(F.lit("calibrated").alias("model"), F.col("p").alias("p")),
        F.struct(F.lit("constant").alias("model"), F.lit(mdl.BASE_RATE).alias("p")))).alias("m")).select("idx", "y", "m.*")
    return rows.withColumn("p", half_even(F.col("p"), 9))


def h05(s, d):
    p = contact(s, d).select("order_id", mdl.raw_probability(mdl.columns_of()).alias("p"))
    return p.select("order_id", half_even(mdl.calibrate_sigmoid(F.col("p")), 9).alias("sigmoid"), half_even(mdl.calibrate_isotonic(F.col("p"), *ISOTONIC), 9).alias("isotonic"))


def h06(s, d):
    ok = gappy(s, d).withColumn("missing", F.concat_ws(", ", mdl.missing_fields(F.col("channel")))).where("missing = ''")
    return mdl.with_contributions(mdl.with_probability(ok)).select("order_id", half_even(F.col("p"), 3).alias("probability"), "factors")


# ---- training
RAW = om.RAW
MONTHS = [f"m_{m}" for m in range(2, 13)]


def development(s, d, months=False):
    """(weighted cells of the development set with their fold, scaler row, rows in it, hold-out rows); cells are written once, every fit reads them."""
    feats = om.feature_rows(split_rows(s, d).withColumn("y", F.col("y").cast("double")))
    if months:
        feats = feats.select("*", *[F.when(F.col("month") == m, 1.0).otherwise(0.0).alias(f"m_{m}") for m in range(2, 13)])
    dev = feats.where("not hold_out").withColumn("fold", om.block_of(F.col("idx"), F.floor(F.lit(0.8) * F.col("n_rows")), 4))
    stats = om.scaler(dev)
    cells_of = om.with_vector(om.scaled(om.training_cells(dev, ["fold", *RAW, *(MONTHS if months else [])]), stats), RAW)
    # a few thousand weighted cells at any input size
    cells = om.with_vector(stored(s, d, "cells-by-month" if months else "cells", lambda: cells_of.drop("features")), RAW)
    return cells, stats, cells.agg(F.sum("w")).first()[0], feats.where("hold_out")


def h09(s, d):
    cells = development(s, d)[0]
    return tr.out_of_fold(cells, RAW, tr.fit_all(cells, RAW, [(1.0, f) for f in range(tr.FOLDS)])).select("fold", *[half_even(F.col(c), 6).alias(c) for c in RAW], "y", "w", half_even(F.col("p"), 4).alias("p"))


def h10(s, d):
    """Out-of-fold PR-AUC of every strength, and which one is chosen."""
    return tr.strength_grid(development(s, d)[0], RAW)[1].select(
        F.concat(F.lit("C="), F.col("c").cast("string")).alias("regularisation"), half_even(F.col("oof_pr_auc"), 4).alias("oof_pr_auc"), "chosen")


def h11(s, d):
    """Cross-validated Brier scores of the calibrators on the chosen strength's out-of-fold predictions."""
    cells = development(s, d)[0]
    fits, grid = tr.strength_grid(cells, RAW)
    best = grid.where("chosen").first()["c"]
    return tr.calibrator_choice(tr.out_of_fold(cells, RAW, fits.where(F.col("c") == best)))


def challengers(s, d, fitted=None, strength=1.0):
    cells, stats, n, test = fitted or development(s, d, months=True)
    test = om.scaled(test, stats).select("idx", "y", *RAW, *MONTHS)
    seen = om.with_vector(cells.drop("features"), RAW + MONTHS)
    trees = om.predict(om.fit_trees(cells), om.with_vector(test, RAW)).select("idx", "y", "p", F.lit("boosted_trees").alias("model"))
    month = om.predict(om.fit_lr(seen, n, strength), om.with_vector(test, RAW + MONTHS)).select("idx", "y", "p", F.lit("with_month").alias("model"))
    return trees.unionByName(month)


def shipped(s, d):
    """(model read back from its written table, the fit under every calibrator, the choices) of the development set."""
    cells, stats, _, _ = development(s, d)
    model, forms, chosen = tr.train(cells, stats)
    path = scratch_path(s, "lead-model")
    tr.save_model(s, model, path)
    return tr.load_model(s, path), forms, chosen


def scored_hold_out(s, d):
    """Every hold-out contact scored by the model as it was written: probability and what drives it."""
    model = shipped(s, d)[0]
    rows = mdl.with_contributions(mdl.with_probability(split_rows(s, d).where("hold_out"), model), m=model)
    return rows.select("order_id", "y", half_even(F.col("raw_p"), 6).alias("raw_p"), half_even(F.col("p"), 6).alias("p"), "factors")


def h15(s, d):
    """Hold-out metrics of the constant rate, the fit without and with each calibrator, the shipped model as written, the
    boosted challenger and the fit with months; beside them the choices and the positive rates, whose gap is the drift."""
    fitted = cells, _, _, test = development(s, d, months=True)
    model, forms, chosen = shipped(s, d)
    names = {"none": "logistic_regression", "sigmoid": "logistic_regression_sigmoid", "isotonic": "logistic_regression_isotonic"}
    hold_out = split_rows(s, d).where("hold_out")
    parts = challengers(s, d, fitted, chosen["strength"])
    for name, m in [*((names[k], m) for k, m in forms.items()), ("shipped", model)]:
        parts = parts.unionByName(mdl.with_probability(hold_out, m).select("idx", F.col("y").cast("double").alias("y"), "p", F.lit(name).alias("model")))
    base = cells.agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("p"))  # one row
    const = test.select("idx", "y").crossJoin(F.broadcast(base)).select("idx", "y", "p", F.lit("constant_baseline").alias("model"))
    rows = materialise(parts.unionByName(const), "report-scores")
    return om.ranking_metrics(rows).join(om.calibration_metrics(rows), "model").crossJoin(F.broadcast(base.select(half_even(F.col("p"), 4).alias("development_rate")))).select(
        "*", F.lit(chosen["strength"]).alias("chosen_strength"), F.lit(chosen["calibrator"]).alias("chosen_calibrator"),
        half_even(F.col("prevalence") - F.col("development_rate"), 4).alias("rate_drift"))


QUERIES = {
    "h01_features": lambda s, d: om.feature_rows(contact(s, d)).select("order_id", *RAW),
    "h02_abstention": lambda s, d: gappy(s, d).select("order_id", F.concat_ws(", ", mdl.missing_fields(F.col("channel"))).alias("missing")).where("missing <> ''"),
    "h03_scaling": lambda s, d: (lambda st: st.select(*[half_even(F.col(c), 6).alias(c) for c in st.columns]))(om.scaler(om.feature_rows(contact(s, d)))),
    "h04_probability": lambda s, d: contact(s, d).select("order_id", mdl.raw_probability(mdl.columns_of()).alias("p")).select("order_id", half_even(F.col("p"), 9).alias("raw_p")),
    "h05_calibration": h05, "h06_contributions": h06,
    "h07_queue": lambda s, d: om.queue(gappy(s, d), F.col("channel"), 50),
    "h08_split": lambda s, d: split_rows(s, d).select("order_id", "year", "idx", "hold_out"),
    "h09_out_of_fold": h09, "h10_regularisation_grid": h10, "h11_calibrator_choice": h11,
    "h12_challengers": lambda s, d: om.ranking_metrics(challengers(s, d)),
    "h13_ranking_metrics": lambda s, d: om.ranking_metrics(hold_out_scores(s, d)),
    "h14_calibration_metrics": lambda s, d: om.calibration_metrics(hold_out_scores(s, d)),
    "h15_model_report": h15, "h15_shipped_scores": scored_hold_out,
}
