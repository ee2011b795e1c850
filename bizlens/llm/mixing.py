"""Temperature mixing of sources: shares to the power of an exponent, realised as whole passes and permuted blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from bizlens.llm.common import BLANK, text_or_empty, written_for_now

N_BLOCKS = 1024
#: Rows of the plan (source, block) that may be broadcast: 100 sources at least, about 5 MB.
PLAN_ROWS = 100 * N_BLOCKS
STEPS = 60


def token_count(text: Column) -> Column:
    """White-space words plus one end token."""
    return (F.regexp_count(text, F.lit(f"[^{BLANK}]+")) + 1).cast("bigint")


def block_of(doc_id: Column, seed: int, n_blocks: int = N_BLOCKS) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(n_blocks)).cast("int")


def summary(totals: DataFrame, exponent: float) -> tuple[float, float]:
    """Entropy in bits of the weights at this exponent, and the passes of the most repeated source when the least
    repeated one is read once. `totals`: source, tokens. One aggregate row reaches the driver."""
    log = F.log("tokens")
    r = totals.agg(
        F.max(log).alias("top"), F.min(log).alias("low")).first()
    if r["top"] is None:
        return 0.0, 1.0
    scaled = F.exp(F.lit(exponent) * (log - F.lit(r["top"])))
    s = totals.agg(F.sum(scaled).alias("z"), F.sum(scaled * F.lit(exponent) * (log - F.lit(r["top"]))).alias("u")).first()
    return (math.log(s["z"]) - s["u"] / s["z"]) / math.log(2), math.exp((1 - exponent) * (r["top"] - r["low"]))


def find_exponent(totals: DataFrame, target_entropy: float | None = None, max_passes: float | None = None, steps: int = STEPS) -> float:
    """The largest exponent in [0, 1] whose entropy reaches `target_entropy`, or the smallest that keeps every source
    within `max_passes`; both fall or rise with the exponent, so bisection finds it. With both, the repetition limit
    wins. All trial exponents of a bisection level are summed in one job: a grid of 32 points refines the bracket."""
    if target_entropy is None and max_passes is None:
        return 1.0
    log = F.log("tokens")
    top = totals.agg(F.max(log).alias("top"), F.min(log).alias("low")).first()
    if top["top"] is None:
        return 1.0
    floor = 0.0
    if max_passes is not None and top["top"] > top["low"]:  # the bracket of the repetition limit
        floor = bisect(lambda a: math.exp((1 - a) * (top["top"] - top["low"])) > max_passes, 0.0, 1.0, steps)
    if target_entropy is None:
        return floor
    lo, hi = 0.0, 1.0
    for _ in range(max(1, round(steps / 5))):
        grid = [lo + (hi - lo) * i / 32 for i in range(33)]
        scaled = [F.exp(F.lit(a) * (log - F.lit(top["top"]))) for a in grid]
        row = totals.agg(*[F.sum(x).alias(f"z{i}") for i, x in enumerate(scaled)],
                         *[F.sum(x * F.lit(a) * (log - F.lit(top["top"]))).alias(f"u{i}") for i, (a, x) in enumerate(zip(grid, scaled))]).first()
        entropy = [(math.log(row[f"z{i}"]) - row[f"u{i}"] / row[f"z{i}"]) / math.log(2) for i in range(33)]
        reach = [i for i in range(33) if entropy[i] >= target_entropy - 1e-12]
        at = reach[-1] if reach else 0
        lo, hi = grid[at], grid[min(at + 1, 32)]
        if lo == hi:
            break
    return max(lo, floor)


def bisect(too_low, lo: float, hi: float, steps: int) -> float:
    """The point where `too_low` turns false, from above."""
    if not too_low(lo):
        return lo
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if too_low(mid) else (lo, mid)
    return hi


def passes(blocks: DataFrame, target_entropy: float | None, max_passes: float | None, seed: int) -> DataFrame:
    """_source, _block, _weight and _times (how often its rows are read), a row per source and block, from `blocks`
    (source, block, tokens).

    The budget is the one at which the source that needs the fewest passes is read once, so no document is lost. A
    source's budget is its weight times the total; whole passes are taken first, the rest is filled with its blocks in
    an order permuted by the seed, as long as a block's middle lies within the budget. A source has N_BLOCKS blocks at
    most, whatever it holds, so ordering them is bounded.
    """
    totals = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    a = find_exponent(totals, target_entropy, max_passes)
    top = totals.agg(F.max(F.log("tokens")).alias("top")).first()["top"] or 0.0
    # weight is tokens ** a up to a constant, so passes are tokens ** (a - 1) relative to the largest source's
    need = totals.select("source", "tokens", F.exp(F.lit(a - 1.0) * (F.log("tokens") - F.lit(top))).alias("need"),
                         F.exp(F.lit(a) * (F.log("tokens") - F.lit(top))).alias("raw"))
    z = need.agg(F.sum("raw").alias("z"), F.sum("tokens").alias("t")).first()
    need = need.select("source", (F.col("tokens") / F.lit(float(z["t"] or 1))).alias("share"), (F.col("raw") / F.lit(z["z"] or 1.0)).alias("weight"),
                       F.floor(F.col("need") + 1e-9).cast("bigint").alias("n_full"),
                       (F.col("tokens") * (F.col("need") - F.floor(F.col("need") + 1e-9))).alias("rest"))
    permuted = Window.partitionBy("_source").orderBy(F.xxhash64(F.lit(seed + 1), "_source", "block"), "block")
    order = (blocks.select(F.coalesce("source", F.lit("\x00null")).alias("_source"), "block", "tokens")
             .withColumn("before", F.sum("tokens").over(permuted) - F.col("tokens")))
    keyed = need.select(F.coalesce("source", F.lit("\x00null")).alias("_source"), "weight", "n_full", "rest")
    again = (F.col("before") + F.col("tokens") / 2 <= F.col("rest")).cast("bigint")
    return order.join(keyed, "_source").select("_source", F.col("block").alias("_block"), F.col("weight").alias("_weight"), (F.col("n_full") + again).alias("_times"))


def mix_sources(docs: DataFrame, target_entropy: float | None = None, max_passes: float | None = 4.0, seed: int = 17,
                n_tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`docs` with each row as often as its source's weight asks for, plus _copy (0 = first pass), _block, _weight.

    Weights are token shares to the power of an exponent between 0 (even) and 1 (as found), bisected to reach
    `target_entropy` bits or to keep the most repeated source within `max_passes`. Every row comes at least once.

    A null source is a source of its own. Empty and null texts hold one token, the end. Rows that repeat an id fall in
    the same block. Ties between blocks follow the block number. Input columns of any name are kept; the three added
    ones replace input columns of their names. An empty table gives an empty result.

    Texts are counted in one scan. The plan has a row per source and block and is written before it is joined: up to
    PLAN_ROWS it is broadcast and no text is shuffled, beyond that rows meet it by source and block, so that a source
    with a third of all rows is dealt over N_BLOCKS keys.
    """
    own = ["_copy", "_block", "_weight", "_source", "_times"]
    docs = docs.drop(*own)
    count = token_count(text_or_empty(text_col)) if n_tokens is None else n_tokens
    counted = docs.select(F.col(source_col).alias("source"), block_of(F.col(id_col), seed).alias("block"), count.alias("n_tokens"))
    blocks, drop = written_for_now(counted.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")), "mixing-blocks")
    plan, _ = written_for_now(passes(blocks, target_entropy, max_passes, seed), "mixing-plan")
    drop()
    plan = F.broadcast(plan) if plan.count() <= PLAN_ROWS else plan.hint("merge")
    rows = docs.withColumns({"_source": F.coalesce(F.col(source_col), F.lit("\x00null")), "_block": block_of(F.col(id_col), seed)})
    return rows.join(plan, ["_source", "_block"]).select(*docs.columns, "_block", "_weight", F.explode(F.sequence(F.lit(0), (F.col("_times") - 1).cast("int"))).alias("_copy"))
