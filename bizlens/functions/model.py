"""The stored conversion model as column expressions: encoding, scaling, score, calibration, contributions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.functions.numbers import clip, half_even, sigmoid
from bizlens.operators.skew import settle

# ---- fixed values: the stored model
FEATURES = ("failure", "success", "prior_contacts", "never_contacted", "days_since_last_contact", "contacts_this_campaign")
SCALER = {"prior_contacts": (0.34534172994999074, 0.5465225134066778), "days_since_last_contact": (0.2947768105204667, 1.4872653667627118),
          "contacts_this_campaign": (2.1231709575847377, 1.625362245415246)}
COEF = (-0.683869, -0.194246, 0.057684, -1.852317, -0.044509, -0.220599)
INTERCEPT = 0.327909
CALIBRATION = (0.504702, -0.740666)
REFERENCE = {"previous_outcome": "nonexistent", "prior_contacts": 0, "days_since_last_contact": 999, "contacts_this_campaign": 2}
BASE_RATE = 0.1777
OUTCOMES = ("nonexistent", "failure", "success")
NEVER = 999
# ---- end of fixed values


@dataclass(frozen=True)
class Model:
    """What scoring needs: scaler by numeric feature, weights in the order of FEATURES, and the calibration as
    ("none",), ("sigmoid", a, b) or ("isotonic", thresholds, values)."""

    scaler: dict
    coef: tuple
    intercept: float
    calibration: tuple
    base_rate: float

    def calibrated(self, *calibration) -> Model:
        return replace(self, calibration=calibration)

    def calibrate(self, p: Column) -> Column:
        kind, *rest = self.calibration
        return calibrate_sigmoid(p, *rest) if kind == "sigmoid" else calibrate_isotonic(p, *rest) if kind == "isotonic" else p


STORED = Model(SCALER, COEF, INTERCEPT, ("sigmoid", *CALIBRATION), BASE_RATE)
ATTRIBUTES = ("previous_outcome", "prior_contacts", "days_since_last_contact", "contacts_this_campaign")
GROUPS = {"contact_history": ATTRIBUTES[:3], "contacts_this_campaign": ATTRIBUTES[3:]}


def encode(attrs: dict[str, Column]) -> list[Column]:
    """Six unscaled features; 'never contacted' is a flag of its own and its 999 days become 0."""
    po, days = attrs["previous_outcome"], attrs["days_since_last_contact"]
    never = days >= NEVER
    cols = [(po == "failure"), (po == "success"), clip(attrs["prior_contacts"], 0, 7), never, F.when(never, 0).otherwise(clip(days, 0, 30)),
            clip(attrs["contacts_this_campaign"], 1, 10)]
    return [c.cast("double") for c in cols]


def missing_fields(channel: Column | None = None) -> Column:
    """Names of absent or invalid fields; a row with any is not scored."""
    tests = [F.when(channel.isNull() | (channel == ""), "channel")] if channel is not None else []
    tests += [F.when(F.col(a).isNull() | (~F.col(a).isin(*OUTCOMES) if a == "previous_outcome" else F.lit(False)), a) for a in ATTRIBUTES]
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def raw_probability(attrs: dict[str, Column], m: Model = STORED) -> Column:
    z = F.lit(m.intercept)
    for name, x, w in zip(FEATURES, encode(attrs), m.coef):
        if name in m.scaler:
            mean, std = m.scaler[name]
            x = (x - mean) / std
        z = z + F.lit(w) * x
    return sigmoid(z)


def calibrate_sigmoid(p: Column, a: float = CALIBRATION[0], b: float = CALIBRATION[1]) -> Column:
    q = clip(p, 1e-6, 1 - 1e-6)
    return sigmoid(F.lit(a) * F.log(q / (1 - q)) + F.lit(b))


def calibrate_isotonic(p: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise linear between stored thresholds, flat beyond the ends. The thresholds are two literal arrays, so the
    plan does not grow with their number."""
    x, y = F.array(*[F.lit(float(v)) for v in xs]), F.array(*[F.lit(float(v)) for v in ys])
    last = F.size(F.filter(x, lambda v: v <= p))  # thresholds at or below p
    x0, x1, y0, y1 = F.get(x, last - 1), F.get(x, last), F.get(y, last - 1), F.get(y, last)
    return F.when(p.isNull(), F.lit(None).cast("double")).when(last == 0, float(ys[0])).when(last == len(xs), float(ys[-1])).otherwise(y0 + (y1 - y0) * (p - x0) / (x1 - x0))


def columns_of(attrs: Sequence[str] = ATTRIBUTES) -> dict[str, Column]:
    return {a: F.col(a) for a in attrs}


def with_probability(rows: DataFrame, m: Model = STORED) -> DataFrame:
    return settle(rows.withColumn("raw_p", raw_probability(columns_of(), m))).withColumn("p", m.calibrate(F.col("raw_p")))


def with_contributions(rows: DataFrame, top: int = 4, least: float = 0.005, m: Model = STORED) -> DataFrame:
    """Effect of each group of attributes against the reference row, the largest first, as text."""
    cur = rows
    for name, members in GROUPS.items():
        alt = {a: F.lit(REFERENCE[a]) if a in members else F.col(a) for a in ATTRIBUTES}
        cur = cur.withColumn(f"alt_{name}", raw_probability(alt, m))
    cur = settle(cur)
    parts = []
    for name in GROUPS:
        cur = cur.withColumn(f"c_{name}", half_even(F.col("p") - m.calibrate(F.col(f"alt_{name}")), 3))
        parts.append(F.struct((-F.abs(f"c_{name}")).alias("size"), F.lit(name).alias("name"), F.col(f"c_{name}").alias("c")))
    kept = F.slice(F.filter(F.array_sort(F.array(*parts)), lambda x: x["size"] <= -least), 1, top)
    return cur.withColumn("factors", F.concat_ws("; ", F.transform(kept, lambda x: F.concat(x["name"], F.lit(" "), F.format_string("%.3f", x["c"]))))).drop(
        *[f"alt_{n}" for n in GROUPS], *[f"c_{n}" for n in GROUPS])
