"""Choosing and shipping the conversion model: every regularisation strength and fold fitted by the same passes over the
cells, the calibrator chosen on out-of-fold predictions, and the result as a table that the scoring expressions load.

A fit is a row (fit, c, fold, beta): it leaves `fold` out (-1: none). One pass sums loss, gradient and curvature of all
fits at once, so a round of Newton's method is one aggregation whatever the number of fits, and what comes back to the
driver is one row a fit with (features + 1)^2 numbers at most. Empty input, and cells of one label only, give fits whose
intercept is bounded by the number of rounds; ties between strengths go to the smallest.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.functions import model as mdl
from bizlens.functions.numbers import clip, half_even, sigmoid
from bizlens.operators import model as om

STRENGTHS = (0.01, 0.1, 1.0, 10.0)  # fixed values: the grid
FOLDS = 4  # fixed value
NO_PENALTY = 1e6  # fixed value: strength of the calibrator's own fit
ROUNDS = 60
STEP = 1e-10  # a fit is done when no coefficient moves by more than this share of its size
FIT_SCHEMA = "fit int, c double, fold int, beta array<double>"


def _linear(beta: Column, cols: Sequence[str]) -> Column:
    z = beta[0]
    for i, c in enumerate(cols, 1):
        z = z + beta[i] * F.col(c)
    return z


def _sums(cells: DataFrame, fits: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Loss, gradient and upper triangle of the curvature of every fit, over the cells it may see."""
    seen = cells.join(F.broadcast(fits), F.col("fold") != F.col("left_out"))  # a row a fit
    z = seen.select("fit", "y", "w", *cols, _linear(F.col("beta"), cols).alias("z")).withColumn("p", sigmoid(F.col("z")))
    x = [F.lit(1.0), *[F.col(c) for c in cols]]
    # log(1 + e^z) - y z without overflow
    loss = F.greatest(F.col("z"), F.lit(0.0)) - F.col("y") * F.col("z") + F.log1p(F.exp(-F.abs("z")))
    slope, bend = F.col("w") * (F.col("p") - F.col("y")), F.col("w") * F.col("p") * (1 - F.col("p"))
    out = [F.sum(F.col("w") * loss).alias("loss")]
    out += [F.sum(slope * a).alias(f"g{i}") for i, a in enumerate(x)]
    out += [F.sum(bend * a * b).alias(f"h{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if i <= j]
    return z.groupBy("fit").agg(*out)


def fit_all(cells: DataFrame, cols: Sequence[str], fits: Sequence[tuple[float, int]]) -> DataFrame:
    """L2 logistic regressions on weighted cells (columns fold, y, w and `cols`), one per (strength, fold left out).

    Newton's method from zero with halved steps where the loss rises; the intercept is not penalised. Returns FIT_SCHEMA.
    """
    spark, k = cells.sparkSession, len(cols) + 1
    beta = [np.zeros(k) for _ in fits]
    tried = [b.copy() for b in beta]
    best = [math.inf] * len(fits)
    step = [np.zeros(k) for _ in fits]
    open_fits = set(range(len(fits)))
    for _ in range(ROUNDS):
        if not open_fits:
            break
        rows = spark.createDataFrame([(i, fits[i][1], [float(v) for v in tried[i]]) for i in sorted(open_fits)], "fit int, left_out int, beta array<double>")
        found = {r["fit"]: r for r in _sums(cells, rows, cols).collect()}  # one row a fit
        for i in sorted(open_fits):
            r, penalty = found.get(i), np.r_[0.0, np.full(k - 1, 1.0 / fits[i][0])]
            if r is None:  # no cell to learn from
                open_fits.discard(i)
                continue
            loss = r["loss"] + 0.5 * float(penalty @ tried[i] ** 2)
            size = np.max(np.abs(step[i]) / np.maximum(1.0, np.abs(tried[i])))
            if loss > best[i] and size > STEP:
                step[i] = step[i] / 2
                tried[i] = beta[i] + step[i]
                continue
            done = math.isfinite(best[i]) and size <= STEP
            beta[i], best[i] = tried[i], min(loss, best[i])
            if done:
                open_fits.discard(i)
                continue
            h = np.diag(penalty + 1e-12)
            for a in range(k):
                for b in range(a, k):
                    h[a, b] += r[f"h{a}_{b}"]
                    h[b, a] = h[a, b]
            g = np.array([r[f"g{a}"] for a in range(k)]) + penalty * beta[i]
            step[i] = -np.linalg.lstsq(h, g, rcond=None)[0]
            tried[i] = beta[i] + step[i]
    return spark.createDataFrame([(i, float(c), f, [float(v) for v in beta[i]]) for i, (c, f) in enumerate(fits)], FIT_SCHEMA)


def out_of_fold(cells: DataFrame, cols: Sequence[str], fits: DataFrame) -> DataFrame:
    """Each cell predicted, per strength, by the fit that never saw its fold."""
    mine = fits.where("fold >= 0").select("c", "fold", "beta")
    return cells.join(F.broadcast(mine), "fold").withColumn("p", sigmoid(_linear(F.col("beta"), cols))).select("c", "fold", *cols, "y", "w", "p")


def strength_grid(cells: DataFrame, cols: Sequence[str], strengths: Sequence[float] = STRENGTHS, folds: int = FOLDS) -> tuple[DataFrame, DataFrame]:
    """(fits of every strength and fold and of all rows, out-of-fold PR-AUC per strength with the chosen one marked)."""
    fits = fit_all(cells, cols, [(c, f) for c in strengths for f in range(-1, folds)])
    auc = om.ranking_metrics(out_of_fold(cells, cols, fits), model="c", weight="w").select("c", F.col("pr_auc").alias("oof_pr_auc"))
    top = auc.agg(F.max_by("c", F.struct("oof_pr_auc", -F.col("c"))).alias("best"))  # one row
    return fits, auc.crossJoin(F.broadcast(top)).select("c", "oof_pr_auc", (F.col("c") == F.col("best")).alias("chosen"))


# ---------------------------------------------------------------- calibration
def with_logit(scored: DataFrame) -> DataFrame:
    q = clip(F.col("p"), 1e-6, 1 - 1e-6)
    return scored.withColumn("logit", F.log(q / (1 - q)))


def fit_isotonic(scored: DataFrame) -> tuple[list[float], list[float]]:
    """Thresholds of the isotonic calibrator: never more than the distinct scores of cells."""
    fitted = IsotonicRegression(featuresCol="p", labelCol="y", weightCol="w", predictionCol="cal").fit(scored)
    return [float(v) for v in fitted.boundaries], [float(v) for v in fitted.predictions]


def calibrator_choice(oof: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Cross-validated Brier score of both calibrators on out-of-fold predictions (fold, y, w, p), the better one marked."""
    data = with_logit(oof.select("fold", "y", "w", "p"))
    sig = fit_all(data, ["logit"], [(NO_PENALTY, f) for f in range(folds)]).select("fold", "beta")
    rows = data.join(F.broadcast(sig), "fold").select("fold", "y", "w", sigmoid(_linear(F.col("beta"), ["logit"])).alias("p"), F.lit("sigmoid").alias("method"))
    for f in range(folds):
        xs, ys = fit_isotonic(data.where(F.col("fold") != f))
        rows = rows.unionByName(data.where(F.col("fold") == f).select("fold", "y", "w", mdl.calibrate_isotonic(F.col("p"), xs, ys).alias("p"), F.lit("isotonic").alias("method")))
    err = F.col("w") * (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    per = rows.groupBy("method", "fold").agg((F.sum(err) / F.sum("w")).alias("b"))
    cv = per.groupBy("method").agg(half_even(F.avg("b"), 6).alias("cv_brier"))
    best = cv.agg(F.min_by("method", F.struct("cv_brier", "method")).alias("best"))  # one row
    return cv.crossJoin(F.broadcast(best)).select("method", "cv_brier", (F.col("method") == F.col("best")).alias("chosen"))


# ---------------------------------------------------------------- the shipped model
def train(cells: DataFrame, stats: DataFrame) -> tuple[mdl.Model, dict[str, mdl.Model], dict]:
    """(shipped model, the same fit under each calibrator and none, what was chosen) from the development cells.

    `cells` are weighted cells with fold, y and the scaled features `model.RAW`; `stats` is the scaler's row.
    """
    fits, grid = strength_grid(cells, om.RAW)
    c = grid.where("chosen").first()["c"]
    mine = fits.where(F.col("c") == c)
    oof = with_logit(out_of_fold(cells, om.RAW, mine))
    method = calibrator_choice(oof).where("chosen").first()["method"]
    beta = mine.where("fold = -1").first()["beta"]
    b, a = fit_all(oof, ["logit"], [(NO_PENALTY, -1)]).first()["beta"]
    s = stats.first()
    scaler = {n: (float(s[f"mean_{n}"]), float(s[f"std_{n}"]) or 1.0) for n in om.NUMERIC}
    rate = cells.agg(F.sum(F.col("w") * F.col("y")) / F.sum("w")).first()[0]
    base = mdl.Model(scaler, tuple(beta[1:]), beta[0], ("none",), rate)
    forms = {"none": base, "sigmoid": base.calibrated("sigmoid", a, b), "isotonic": base.calibrated("isotonic", *fit_isotonic(oof))}
    return forms[method], forms, {"strength": c, "calibrator": method}


ARTIFACT = "model_id string, features array<string>, scaler map<string,struct<mean:double,std:double>>, coef array<double>, intercept double, method string, a double, b double, x array<double>, y array<double>, prevalence_train double"


def save_model(spark: SparkSession, m: mdl.Model, path: str, model_id: str = "lead_conversion") -> None:
    """The model as a one-row table, coefficients to six digits as they are shipped."""
    kind, *rest = m.calibration
    a, b = (round(rest[0], 6), round(rest[1], 6)) if kind == "sigmoid" else (None, None)
    xs, ys = ([round(v, 6) for v in rest[0]], [round(v, 6) for v in rest[1]]) if kind == "isotonic" else (None, None)
    row = (model_id, list(mdl.FEATURES), {n: tuple(v) for n, v in m.scaler.items()}, [round(v, 6) for v in m.coef], round(m.intercept, 6), kind, a, b, xs, ys, round(m.base_rate, 4))
    spark.createDataFrame([row], ARTIFACT).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> mdl.Model:
    r = spark.read.schema(ARTIFACT).parquet(path).first()
    if tuple(r["features"]) != mdl.FEATURES:
        raise ValueError(f"{path} was trained on other features: {r['features']}")
    cal = {"sigmoid": ("sigmoid", r["a"], r["b"]), "isotonic": ("isotonic", tuple(r["x"] or ()), tuple(r["y"] or ())), "none": ("none",)}[r["method"]]
    return mdl.Model({n: (v["mean"], v["std"]) for n, v in r["scaler"].items()}, tuple(r["coef"]), r["intercept"], cal, r["prevalence_train"])
