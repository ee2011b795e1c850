"""Filter interaction audit: five filters in every order, from additive counts of failure masks.

Duplicates (filter E) are found in two steps. A counting Bloom sketch of text fingerprints, merged over all partitions,
clears every text that has a counter of its own: it cannot repeat. Only the other texts are shuffled, grouped by their
full content, for the smallest id of each. Failure flags of a row then become one of 32 masks, and everything that is
asked about any order of the filters is a sum over masks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import text_or_empty, written_for_now
from bizlens.llm.textops import SAME, buffers, mix, row_slices, word_bounds, word_hashes

BATCH_BYTES = 1 << 20
FILTERS = "ABCDE"
#: The symbols of filter D.
SYMBOLS = "#$%&*|"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
SEGMENT = 1 << 16  # counters in one row of the merged sketch
ROWS_AT_ONCE = 1 << 20  # fingerprints that a task counts before it hands its counters on


@dataclass(frozen=True)
class Settings:
    """`cells_per_row` counters for each row, 2 ** `max_bits` at most: the merged sketch that is broadcast has one bit
    for each, 128 MB. Beyond that bound (67 million rows at 16 counters) it clears fewer texts, so that more of them
    are compared in full; the result is the same."""
    min_words: int = 100
    distinct_percent: int = 80
    upper_percent: int = 10
    cells_per_row: int = 16
    max_bits: int = 30


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Different words of each row, told apart by 64-bit hashes."""
    if not len(starts):
        return np.zeros(n_rows, np.int64)
    key = mix(word_hashes(data, starts, ends, SAME) ^ mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    return np.bincount(row[order[new]], minlength=n_rows)


def _masks(s: Settings):
    """Per row the bits 1, 2, 4 and 8 for failing A, B, C and D."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column("_text"))
            masks = [np.zeros(0, np.int32)]
            for i, j in row_slices(off, BATCH_BYTES):
                d, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                starts, ends, first = word_bounds(d, o)
                words = np.diff(first)
                distinct = distinct_words(d, starts, ends, np.repeat(np.arange(j - i), words), j - i)
                at = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit)])[o])
                points, upper, symbols = at((d & 0xC0) != 0x80), at(_UPPER[d]), at(_IS_SYMBOL[d])
                masks.append(((words < s.min_words) + 2 * (100 * distinct < s.distinct_percent * words)
                              + 4 * (100 * upper > s.upper_percent * points) + 8 * (symbols > 0)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_part"), pa.array(np.concatenate(masks)), b.column("_h"), b.column("_g")],
                                             names=["_id", "_part", "_mask", "_h", "_g"])
    return run


def fingerprints(text: Column) -> dict[str, Column]:
    """Two independent 64-bit hashes of the whole text."""
    return {"_h": F.xxhash64(text), "_g": F.xxhash64(F.lit(1), text)}


def _cells(h: np.ndarray, g: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return h.view(np.uint64) & np.uint64(size - 1), g.view(np.uint64) & np.uint64(size - 1)


def _count(size: int):
    """Counters of a task's fingerprints: by segment, the cells met once and those met more often."""
    def emit(parts: list[np.ndarray]) -> pa.RecordBatch:
        cell, n = np.unique(np.concatenate(parts), return_counts=True)
        seg = cell // SEGMENT
        at = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        low = (cell % SEGMENT).astype(np.uint16)
        cut = [*at.tolist(), len(cell)]
        pairs = [(low[x:y][n[x:y] == 1].tobytes(), low[x:y][n[x:y] > 1].tobytes()) for x, y in zip(cut[:-1], cut[1:])]
        return pa.RecordBatch.from_arrays([pa.array(seg[at].astype(np.int32)), pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())],
                                          names=["seg", "once", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            parts += _cells(b.column("_h").to_numpy(), b.column("_g").to_numpy(), size)
            held += b.num_rows
            if held >= ROWS_AT_ONCE:
                yield emit(parts)
                parts, held = [], 0
        if held:
            yield emit(parts)
    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of a segment added up, as one bit per counter that stands at two or more. Rows arrive sorted by segment."""
    def out(seg: int, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([np.packbits(n > 1, bitorder="little").tobytes()], pa.binary())], names=["seg", "bits"])

    seg, n = -1, None
    for b in batches:
        for s, once, more in zip(b.column("seg").to_pylist(), b.column("once"), b.column("more")):
            if s != seg:
                if n is not None:
                    yield out(seg, n)
                seg, n = s, np.zeros(SEGMENT, np.uint8)
            x = np.frombuffer(once.as_buffer(), np.uint16)
            n[x] = np.minimum(n[x] + 1, 2)
            n[np.frombuffer(more.as_buffer(), np.uint16)] = 2
    if n is not None:
        yield out(seg, n)


def counting_bloom(rows: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """The merged sketch of the columns _h and _g: one bit per counter, set where it stands at two or more.

    What reaches the driver is bounded by `max_bits`. A counter of one belongs to one row only, so a row with such a
    counter has a text that no other row has.
    """
    n = rows.count()
    size = 1 << min(s.max_bits, max(16, (n * s.cells_per_row - 1).bit_length()))
    merged = (rows.select("_h", "_g").mapInArrow(_count(size), "seg int, once binary, more binary")
              .repartition("seg").sortWithinPartitions("seg").mapInArrow(_merge, "seg int, bits binary").toArrow())
    out = np.zeros(size // 8, np.uint8)
    for seg, bits in zip(merged.column("seg").to_pylist(), merged.column("bits").to_pylist()):
        out[seg * (SEGMENT // 8):(seg + 1) * (SEGMENT // 8)] = np.frombuffer(bits, np.uint8)
    return out


def maybe_repeated(sketch) -> Column:
    """Whether both counters of a row stand at two or more; `sketch` is the broadcast merged sketch."""
    @F.pandas_udf("boolean")
    def test(h: pd.Series, g: pd.Series) -> pd.Series:
        bits = sketch.value
        a, b = _cells(h.to_numpy(np.int64), g.to_numpy(np.int64), len(bits) * 8)
        hit = lambda x: (bits[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1
        return pd.Series((hit(a) & hit(b)).astype(bool))
    return test(F.col("_h"), F.col("_g"))


def mask_counts(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
                part_col: str = "lang") -> DataFrame:
    """part, mask, n, n_good, n_toxic: rows by part and failure mask (A 1, B 2, C 4, D 8, E 16), with those labelled.

    Of rows with the same text all fail E but those of the smallest id. Groups of copies are added up by id and mask
    before they meet, so a text that a third of all rows share is a handful of rows by then.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col), F.lit("")).alias("_part"), text_or_empty(text_col).alias("_text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    flags, drop = written_for_now(base.select("_id", "_part", "_text", *[c.alias(k) for k, c in fingerprints(F.col("_text")).items()])
                                  .mapInArrow(_masks(s), f"_id {id_type}, _part string, _mask int, _h long, _g long"), "audit-flags")
    sketch = spark.sparkContext.broadcast(counting_bloom(flags, s))
    maybe = maybe_repeated(sketch)
    repeated = (base.select("_id", "_text", *[c.alias(k) for k, c in fingerprints(F.col("_text")).items()]).where(maybe)
                .groupBy("_h", "_g", "_text").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
                .where("_rows > 1").select("_h", "_g", "_first"))
    marks = labels.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("_good"),
                                                           F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("_toxic"))
    rows = (flags.withColumn("_maybe", maybe).join(marks, "_id", "left")
            .withColumns({"_good": F.coalesce("_good", F.lit(0)), "_toxic": F.coalesce("_toxic", F.lit(0))}))
    kind = ["_part", "_mask", "_good", "_toxic"]
    single = rows.where("not _maybe").groupBy(*kind).agg(F.count("*").alias("_n"))
    by_id = rows.where("_maybe").groupBy("_h", "_g", *kind, "_id").agg(F.count("*").alias("_n"))
    by_text = by_id.groupBy("_h", "_g", *kind).agg(
        F.sum("_n").alias("_all"), F.sum(F.when(F.col("_id").isNull(), F.col("_n")).otherwise(0)).alias("_no_id"),
        F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_n"))).alias("_low"))
    first = F.when(F.col("_low._id") == F.col("_first"), F.col("_low._n")).otherwise(0)
    split = by_text.join(repeated, ["_h", "_g"], "left").withColumn(
        "_pass", F.when(F.col("_first").isNull(), F.col("_all")).otherwise(F.col("_no_id") + first))
    both = split.select(*kind, F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("_pass").alias("n")),
                                                 F.struct(F.lit(16).alias("e"), (F.col("_all") - F.col("_pass")).alias("n")))).alias("_x"))
    every = single.unionByName(both.select("_part", (F.col("_mask") + F.col("_x.e")).alias("_mask"), "_good", "_toxic", F.col("_x.n").alias("_n")))
    counts, _ = written_for_now(every.groupBy(F.col("_part").alias("part"), F.col("_mask").alias("mask")).agg(
        F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_good")).alias("n_good"), F.sum(F.col("_n") * F.col("_toxic")).alias("n_toxic")), "audit-counts")
    drop()
    sketch.destroy()
    return counts


def _steps(spark) -> DataFrame:
    """The 600 steps of all orders of five filters: filter_order, step, before (filters that ran, as bits), own (bit)."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    rows = [("".join(p), k + 1, sum(bit[f] for f in p[:k]), bit[p[k]]) for p in permutations(FILTERS) for k in range(len(p))]
    return spark.createDataFrame(rows, "filter_order string, step int, before int, own int")


def filter_audit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step, with what the step's filter does there (see the README).

    Null texts are empty: they fail A only, and E after the first. A null part is the empty string. Rows that repeat an
    id count each; copies under the smallest id all pass E, and so does a row without an id, which no other row
    repeats. Labels of one id count once, as good or toxic if any of them says so; labels without a document count
    nowhere. Extra columns are ignored; an empty table gives no parts and so no rows.
    """
    counts = mask_counts(docs, labels, s, id_col, text_col, part_col)
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    pairs = [(sum(bit[x] for x in c), bit[f], factorial(len(c)) * factorial(len(FILTERS) - 1 - len(c)))
             for f in FILTERS for k in range(len(FILTERS)) for c in combinations([x for x in FILTERS if x != f], k)]
    # a mask meets the 80 pairs of a filter and the set of filters before it, whatever the number of documents
    pair = F.explode(F.array(*[F.struct(F.lit(a).alias("before"), F.lit(b).alias("own"), F.lit(w).cast("bigint").alias("orders")) for a, b, w in pairs]))
    met = counts.select("*", pair.alias("x")).select("part", "mask", "n", "n_good", "n_toxic", "x.*")
    fails = F.col("mask").bitwiseAND(F.col("own")) > 0
    gone = F.col("mask").bitwiseAND(F.col("before")) > 0
    total = lambda cond, col="n": F.sum(F.when(cond, F.col(col)).otherwise(F.lit(0))).cast("bigint")
    by_pair = met.groupBy("part", "before", "own", "orders").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"), total(fails & ~gone, "n_good").alias("good_lost"),
        total(fails & ~gone, "n_toxic").alias("toxic_lost"))
    share = by_pair.groupBy("part", "own").agg(F.sum(F.col("removed") * F.col("orders")).cast("bigint").alias("shapley"))
    steps = F.broadcast(_steps(docs.sparkSession))
    return (by_pair.join(share, ["part", "own"]).join(steps, ["before", "own"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
