"""Exact positions in a total order, for parts of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizlens.sources.tables import materialise


def range_rank(df: DataFrame, part: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    """`df` with its position 1..n inside each part (columns), ordered by `order`, which has to end in something unique.

    Rows are dealt by range over part and order, with splitters that Spark samples, and sorted inside each range, so a
    part (or one value of its leading order columns) that holds most rows spans as many tasks as its size asks for. Rows
    of a range are numbered as they lie; the rows of a part in earlier ranges are its offset. What is added up for that
    has a row per range and one per part besides. A null is a part like others; nulls in the order come first unless it
    says otherwise. The input is written once, since sampling and dealing both read it.
    """
    part = list(part)
    dealt = materialise(df, "rank-input").repartitionByRange(*part, *order).sortWithinPartitions(*part, *order)
    rows = materialise(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_range", F.shiftright("_at", 33))
    ranges = rows.groupBy(*part, "_range").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(part)], F.col("_range").alias("_r"), "_low",
                            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_p{i}")) for i, c in enumerate(part)], F.col("_range") == F.col("_r"))
    return rows.join(offsets, same).select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_low") + 1).cast("bigint").alias(out))
