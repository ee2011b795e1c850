"""Joins and ordered sums that stay distributed when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key with more rows than this is hot. At most total_rows / HOT_ROWS keys can be hot, so the table of hot keys
# has a proven size bound (10^12 rows -> at most 100,000 keys) and may be broadcast.
HOT_ROWS = 10_000_000
SALTS = 4096


def attach_by_key(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], count_col: str, spread: Column,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join `rows` with `keyed` (one row per key, `count_col` = rows of that key) in one pass over `rows`.

    Hot keys travel by broadcast; their rows get a salt from `spread` and match nothing in the shuffled join, so they
    are dealt over all tasks instead of meeting in one.
    """
    keys = list(keys)
    payload = [c for c in keyed.columns if c not in keys]
    hot = keyed.where(F.col(count_col) > hot_rows)
    cold = keyed.where(F.col(count_col) <= hot_rows)
    hot = hot.select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in payload])
    cold = cold.select(*keys, F.lit(0).alias("_salt"), *[F.col(c).alias(f"_cold_{c}") for c in payload])
    salt = F.when(F.col(f"_hot_{count_col}").isNull(), F.lit(0)).otherwise(
        (F.pmod(F.xxhash64(spread), F.lit(SALTS)) + 1).cast("int"))
    joined = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).join(cold, [*keys, "_salt"], "left")
    return joined.select(*rows.columns, *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in payload])


def order_bucket(value: Column) -> Column:
    """Order-preserving bucket of a number: about 0.8% wide on a log scale, mirrored below zero.

    A value range of nine decades needs under 2,700 buckets a side, so per-group bucket totals stay small.
    """
    v = value.cast("double")
    return (F.signum(v) * F.floor(F.log1p(F.abs(v)) * 128)).cast("bigint")


def two_level_cumsum(df: DataFrame, part: Sequence[str], value: str, sums: dict[str, str], descending: bool = False,
                     ties: Sequence[str] = ()) -> DataFrame:
    """Running sums over `value` order inside each `part`, without one task per part.

    Bucket totals give each bucket its offset (a small window); rows are then ordered only inside their bucket.
    `sums` maps output column -> input column. Adds `<output>` (inclusive running sum) and `<output>_all` (part total).
    `value` with `ties` must be unique inside a part; collapse equal values with a groupBy first.
    """
    part = list(part)
    sign = -1 if descending else 1
    keyed = df.withColumn("_bucket", order_bucket(F.col(value)) * sign)
    totals = keyed.groupBy(*part, "_bucket").agg(*[F.sum(src).alias(f"_t_{out}") for out, src in sums.items()])
    before = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*part)
    offsets = totals.select(
        *part, "_bucket",
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums],
        *[F.sum(f"_t_{o}").over(whole).alias(f"{o}_all") for o in sums])
    order = [F.col(value).desc() if descending else F.col(value).asc(), *[F.col(t).asc() for t in ties]]
    inside = Window.partitionBy(*part, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = keyed.join(offsets, [*part, "_bucket"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_o_{o}") + F.sum(src).over(inside)).alias(o) for o, src in sums.items()],
        *[F.col(f"{o}_all") for o in sums])


def exact_quantiles(df: DataFrame, part: Sequence[str], value: str, probs: dict[str, float],
                    weight: str | None = None) -> DataFrame:
    """Exact interpolated quantiles per part for values of any spread.

    `percentile` keeps every distinct value of a group in one buffer; here equal values are counted first (combined
    on the map side) and only ordered inside a bucket.
    """
    part = list(part)
    n = F.sum(weight) if weight else F.count(F.lit(1))
    hist = df.where(F.col(value).isNotNull()).groupBy(*part, F.col(value).alias("_v")).agg(n.cast("bigint").alias("_n"))
    ranked = two_level_cumsum(hist, part, "_v", {"_cum": "_n"})
    aggs = []
    for out, q in probs.items():
        pos = F.lit(float(q)) * (F.col("_cum_all") - 1)
        low = F.floor(pos)
        high = F.least(low + 1, F.col("_cum_all") - 1)

        def at(rank):
            return F.max(F.when((F.col("_cum") > rank) & (F.col("_cum") - F.col("_n") <= rank), F.col("_v").cast("double")))

        aggs += [at(low).alias(f"_lo_{out}"), at(high).alias(f"_hi_{out}"), F.max(pos - low).alias(f"_fr_{out}")]
    return ranked.groupBy(*part).agg(*aggs).select(
        *part,
        *[(F.col(f"_lo_{o}") + (F.col(f"_hi_{o}") - F.col(f"_lo_{o}")) * F.col(f"_fr_{o}")).alias(o) for o in probs])


def settle(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Compute this projection's columns once and let later filters read them.

    The optimizer pushes a filter below the projections it refers to and writes their expressions out in full, which
    grows without bound when derived columns build on each other. A generator is where that stops.
    """
    made = [c for c in df.columns if c not in keep]
    return df.select(*keep, F.inline(F.array(F.struct(*made))))


def settle_parts(df: DataFrame, columns: Sequence[Column], size: int = 0) -> DataFrame:
    """Adds columns, settled `size` at a time (0: all at once).

    Spark writes the projections between two generators into one Java method, and the JVM never compiles a method of more
    than 8,000 bytes but interprets it, several times slower. Short projections between generators stay below that.
    """
    for i in range(0, len(columns), size or len(columns)):
        held = df.columns
        df = settle(df.select("*", *columns[i:i + (size or len(columns))]), held)
    return df
