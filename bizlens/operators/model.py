"""Batch scoring queue, chronological split, training with blocked folds, and exact ranking metrics."""

from __future__ import annotations

from pyspark.ml import functions as MF
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizlens.functions import model as mdl
from bizlens.functions.numbers import half_even, ratio
from bizlens.operators.ranges import range_rank
from bizlens.operators.skew import two_level_cumsum

NUMERIC = ("prior_contacts", "days_since_last_contact", "contacts_this_campaign")
MAX_STEPS = 2000  # fixed value: far above what a fit needs to converge
TREES = 200  # fixed value: rounds of the boosted challenger


def feature_rows(rows: DataFrame) -> DataFrame:
    """Encoded features as columns x_<name>."""
    return rows.select("*", *[c.alias(f"x_{n}") for n, c in zip(mdl.FEATURES, mdl.encode(mdl.columns_of()))])


def scaler(features: DataFrame) -> DataFrame:
    """Mean and population deviation of the numeric features: one row."""
    return features.agg(*[f(F.col(f"x_{n}")).alias(f"{k}_{n}") for n in NUMERIC for k, f in (("mean", F.avg), ("std", F.stddev_pop))])


def scaled(features: DataFrame, stats: DataFrame) -> DataFrame:
    out = features.crossJoin(F.broadcast(stats))  # one row
    for n in NUMERIC:
        out = out.withColumn(f"x_{n}", (F.col(f"x_{n}") - F.col(f"mean_{n}")) / F.when(F.col(f"std_{n}") == 0, 1.0).otherwise(F.col(f"std_{n}")))
    return out.drop(*stats.columns)


def queue(leads: DataFrame, channel: Column, limit: int) -> DataFrame:
    """Open leads by probability x expected value, abstentions after them, cut to the first `limit` (a top-k report)."""
    miss = leads.withColumn("missing", F.concat_ws(", ", mdl.missing_fields(channel)))
    good = mdl.with_contributions(mdl.with_probability(miss.where("missing = ''")))
    good = good.withColumn("probability", half_even(F.col("p"), 3))
    good = good.withColumn("value", half_even(F.col("probability") * F.col("expected_value_inr").cast("double"), 2))
    cols = ["lead_id", "probability", "value", "factors", "missing"]
    best = good.select(*cols).orderBy(F.coalesce("value", F.lit(0.0)).desc(), "lead_id").limit(limit)
    rest = miss.where("missing <> ''").select("lead_id", F.lit(None).cast("double").alias("probability"), F.lit(None).cast("double").alias("value"),
                                              F.lit("").alias("factors"), F.concat(F.lit("Missing key fields: "), "missing").alias("missing")).orderBy("lead_id").limit(limit)
    w = Window.orderBy(F.col("probability").isNull(), F.coalesce("value", F.lit(0.0)).desc(), "lead_id")  # at most 2 x limit rows are left here
    out = best.unionByName(rest).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit)
    return out.withColumn("rank", F.when(F.col("probability").isNotNull(), F.col("pos")).cast("bigint")).drop("pos")


def chronological(rows: DataFrame, day: str, tie: str) -> DataFrame:
    """File position in time order, from 0."""
    return range_rank(rows, [], [F.col(day), F.col(tie)], "pos").withColumn("row_idx", F.col("pos") - 1).drop("pos")


def years_from_months(rows: DataFrame, first_year: int) -> DataFrame:
    """Year of each row when only the month is known: it goes up wherever the month falls below the row before it.

    The row before comes from an equi-join on the position; the few wrap points are then counted below each position.
    """
    prev = rows.select((F.col("row_idx") + 1).alias("row_idx"), F.col("month").alias("_pm"))
    wraps = rows.select("row_idx", "month").join(prev, "row_idx").where(F.col("month") < F.col("_pm")).agg(F.sort_array(F.collect_list("row_idx")).alias("_w"))  # one entry a year
    return rows.crossJoin(F.broadcast(wraps)).withColumn(
        "year", (F.lit(first_year) + F.size(F.filter("_w", lambda w: w <= F.col("row_idx")))).cast("bigint")).drop("_w")


def split(rows: DataFrame, from_year: int, hold_out: float = 0.2) -> DataFrame:
    """Rows from `from_year` on, renumbered, the last fifth marked as hold-out."""
    win = rows.where(F.col("year") >= from_year)
    span = win.agg(F.min("row_idx").alias("_lo"), F.count(F.lit(1)).alias("_n"))  # one row
    return win.crossJoin(F.broadcast(span)).withColumn("idx", F.col("row_idx") - F.col("_lo")).withColumn(
        "hold_out", F.col("idx") >= F.floor(F.lit(1 - hold_out) * F.col("_n"))).drop("_lo").withColumnRenamed("_n", "n_rows")


def block_of(idx: Column, n: Column, k: int) -> Column:
    """Contiguous fold of a row; the first n % k folds hold one row more."""
    size, extra = F.floor(n / k), n % k
    edge = extra * (size + 1)
    return F.when(idx < edge, F.floor(idx / (size + 1))).otherwise(extra + F.floor((idx - edge) / size)).cast("int")


# ---------------------------------------------------------------- metrics
def ranking_metrics(scored: DataFrame, model: str = "model", p: str = "p", y: str = "y", weight: str | None = None) -> DataFrame:
    """ROC-AUC and average precision per model, exact, from running counts over distinct scores."""
    w = F.col(weight) if weight else F.lit(1)
    hist = scored.groupBy(model, F.col(p).alias("p")).agg(F.sum(w).cast("bigint").alias("n"), F.sum(w * F.col(y)).cast("bigint").alias("pos"))
    c = two_level_cumsum(hist, [model], "p", {"seen": "n", "tp": "pos"}, descending=True)
    neg, all_neg = F.col("seen") - F.col("tp"), F.col("seen_all") - F.col("tp_all")
    own_neg = F.col("n") - F.col("pos")
    area = own_neg * (2 * F.col("tp") - F.col("pos"))  # twice the trapezoid of this score
    prec = F.col("pos") * ratio(F.col("tp"), F.col("seen"))
    g = c.groupBy(model).agg(F.sum(area).alias("area"), F.sum(prec).alias("ap"), F.max("tp_all").alias("P"), F.max(all_neg).alias("N"), F.max(neg).alias("_"))
    return g.select(model, half_even(ratio(F.col("ap"), F.col("P")), 6).alias("pr_auc"), half_even(ratio(F.col("area"), 2 * F.col("P") * F.col("N")), 6).alias("roc_auc"),
                    (F.col("P") + F.col("N")).alias("n"))


def calibration_metrics(scored: DataFrame, model: str = "model", p: str = "p", y: str = "y", tie: str = "idx", share: float = 0.10) -> DataFrame:
    """Brier score, prevalence, 10-bin calibration error and lift in the top tenth."""
    bins = scored.withColumn("bin", F.least(F.floor(F.col(p) * 10), F.lit(9)).cast("int")).groupBy(model, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("se"))
    base = bins.groupBy(model).agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum("se").alias("se"), F.sum(F.abs(F.col("sp") - F.col("sy"))).alias("gap"))
    ranks = range_rank(scored.select(model, p, y, tie), [model], [F.col(p).desc(), F.col(tie)], "place")
    k = F.greatest(F.lit(1), F.floor(F.col("n") * share))
    # n is one row per model
    top = ranks.join(F.broadcast(base.select(model, "n")), model).where(F.col("place") <= k).groupBy(model).agg(F.sum(y).alias("ty"), F.count(F.lit(1)).alias("tn"))
    prev = ratio(F.col("sy"), F.col("n"))
    return base.join(top, model).select(model, half_even(ratio(F.col("se"), F.col("n")), 6).alias("brier"), half_even(prev, 6).alias("prevalence"),
                                        half_even(ratio(F.col("gap"), F.col("n")), 6).alias("calibration_error"),
                                        half_even(ratio(F.col("ty"), F.col("tn")) / prev, 6).alias("lift_at_10pct"))


# ---------------------------------------------------------------- training
# Clipped features take few values, so rows with equal features and label are counted into weighted cells first (at most
# a few thousand per fold). Every fit then iterates over cells, whatever the number of rows.
RAW = [f"x_{n}" for n in mdl.FEATURES]


def training_cells(dev: DataFrame, keys: list[str]) -> DataFrame:
    return dev.groupBy(*keys, "y").agg(F.count(F.lit(1)).cast("double").alias("w"))


def with_vector(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df)


def fit_lr(cells: DataFrame, total: float, c: float):
    """L2 logistic regression whose penalty matches strength C on `total` rows."""
    return LogisticRegression(labelCol="y", weightCol="w", maxIter=MAX_STEPS, regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False).fit(cells)


def predict(model, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out.withColumn("p", F.get(MF.vector_to_array("probability"), F.lit(1))).drop("rawPrediction", "probability", "prediction")


def fit_trees(cells: DataFrame):
    return GBTClassifier(labelCol="y", weightCol="w", maxIter=TREES, maxDepth=3, stepSize=0.05, seed=0).fit(cells)
