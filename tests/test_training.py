"""The model's choice and fit against plain numpy, and the written model against the one in memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bizlens.functions import model as mdl
from bizlens.operators import model as om
from bizlens.operators import training as tr

COLS = ["x_a", "x_b"]


def sample(n=400, seed=3):
    r = np.random.default_rng(seed)
    a, b = r.integers(0, 4, n) / 2.0, r.integers(-2, 3, n).astype(float)
    y = (r.random(n) < 1 / (1 + np.exp(-(0.8 * a - 0.5 * b - 0.6)))).astype(float)
    return a, b, y, np.arange(n) * 4 // n


def plain_fit(x, y, c, rounds=20_000, rate=0.02):
    """Gradient descent on the mean loss: slow, but nothing is shared with Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    beta, pen = np.zeros(x.shape[1]), np.r_[0.0, np.full(x.shape[1] - 1, 1.0 / c)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta - rate * (x.T @ (p - y) + pen * beta) / len(y) * 10
    return beta


@pytest.fixture(scope="module")
def cells(spark):
    a, b, y, fold = sample()
    rows = spark.createDataFrame([(int(f), float(u), float(v), float(t)) for u, v, t, f in zip(a, b, y, fold)], "fold int, x_a double, x_b double, y double")
    return om.training_cells(rows, ["fold", *COLS]).cache()


def test_all_fits_at_once_match_single_fits(spark, cells):
    a, b, y, fold = sample()
    wanted = [(0.01, -1), (1.0, 2), (10.0, 0)]
    got = {(r["c"], r["fold"]): r["beta"] for r in tr.fit_all(cells, COLS, wanted).collect()}
    for c, f in wanted:
        use = fold != f
        assert got[c, f] == pytest.approx(list(plain_fit(np.c_[a, b][use], y[use], c)), abs=1e-5), (c, f)


def test_out_of_fold_never_uses_its_own_fold(spark, cells):
    fits, grid = tr.strength_grid(cells, COLS)
    own = {(r["c"], r["fold"]): r["beta"] for r in fits.collect()}
    for r in tr.out_of_fold(cells, COLS, fits).collect():
        z = np.dot(own[r["c"], r["fold"]], [1.0, r["x_a"], r["x_b"]])
        assert r["p"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-12)
    marks = grid.collect()
    assert sorted(r["c"] for r in marks) == list(tr.STRENGTHS) and sum(r["chosen"] for r in marks) == 1
    best = max(r["oof_pr_auc"] for r in marks)
    assert [r["c"] for r in marks if r["chosen"]] == [min(r["c"] for r in marks if r["oof_pr_auc"] == best)]


def test_one_label_and_no_rows(spark, cells):
    only = tr.fit_all(cells.where("y = 1"), COLS, [(1.0, -1)]).first()["beta"]
    assert np.all(np.isfinite(only)) and only[0] > 5
    assert tr.fit_all(cells.where("false"), COLS, [(1.0, -1)]).first()["beta"] == [0.0, 0.0, 0.0]


def test_calibrator_choice_takes_the_smaller_error(spark, cells):
    fits, _ = tr.strength_grid(cells, COLS)
    rows = tr.calibrator_choice(tr.out_of_fold(cells, COLS, fits.where("c = 1.0"))).collect()
    assert {r["method"] for r in rows} == {"sigmoid", "isotonic"}
    assert min(rows, key=lambda r: r["cv_brier"])["chosen"] and sum(r["chosen"] for r in rows) == 1


@pytest.mark.parametrize("calibration", [("none",), ("sigmoid", 0.5, -0.7), ("isotonic", (0.1, 0.4, 0.4000001, 0.9), (0.05, 0.2, 0.3, 0.8))])
def test_written_model_scores_like_the_one_in_memory(spark, tmp_path, calibration):
    m = mdl.STORED.calibrated(*calibration)
    tr.save_model(spark, m, str(tmp_path / "m"))
    back = tr.load_model(spark, str(tmp_path / "m"))
    rows = spark.createDataFrame([(o, p, d, c) for o in mdl.OUTCOMES for p in (0, 3) for d in (2, 999) for c in (1, 9)], "previous_outcome string, prior_contacts int, days_since_last_contact int, contacts_this_campaign int")
    keys = rows.columns
    a = mdl.with_contributions(mdl.with_probability(rows, m), m=m).orderBy(*keys).collect()
    b = mdl.with_contributions(mdl.with_probability(rows, back), m=back).orderBy(*keys).collect()
    assert [r["p"] for r in a] == pytest.approx([r["p"] for r in b], abs=1e-6)
    assert [r["factors"] for r in a] == [r["factors"] for r in b]


def test_isotonic_between_and_beyond_thresholds(spark):
    ps = spark.createDataFrame([(0.0,), (0.1,), (0.25,), (0.4,), (0.95,), (None,)], "p double")
    got = [r.q for r in ps.select(mdl.calibrate_isotonic(F.col("p"), (0.1, 0.4, 0.9), (0.0, 0.3, 1.0)).alias("q")).collect()]
    assert got[:5] == pytest.approx([0.0, 0.0, 0.15, 0.3, 1.0]) and got[5] is None
