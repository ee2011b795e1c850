"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.session import scratch_path
from bizlens.llm.textops import GRAM, LOWER, SPLIT, buffers, mix, row_slices, word_bounds, word_hashes

#: Words are runs of letters and digits; everything else only separates them.
LETTERS = np.where(SPLIT == 1, 1, 0).astype(np.uint8)
BATCH_BYTES = 1 << 20


@dataclass(frozen=True)
class Settings:
    """`max_rows` bounds the labelled rows that training reads, whatever the corpus holds; `shards` of them are trained
    side by side and averaged after each epoch."""
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.5
    epochs: int = 4
    shards: int = 4
    max_rows: int = 16_000
    toxic_weight: float = 1.5
    threshold: float = 0.7


def features(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of unigrams, bigrams and one-word skip-grams, and the row of each (sorted by row)."""
    starts, ends, first = word_bounds(data, off, LETTERS)
    w = word_hashes(data, starts, ends, LOWER)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    kinds, rows = [mix(w * GRAM[0])], [row]
    for gap in (1, 2):
        if len(w) > gap:
            same = row[:-gap] == row[gap:]
            kinds.append(mix(w[:-gap][same] * GRAM[2 * gap] + w[gap:][same] * GRAM[2 * gap + 1]))
            rows.append(row[:-gap][same])
    return (np.concatenate(kinds) >> np.uint64(64 - bits)).astype(np.int32), np.concatenate(rows)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; `z` and `n` hold one entry per bucket and the bias in the last."""

    def __init__(self, s: Settings, z: np.ndarray | None = None, n: np.ndarray | None = None):
        size = (1 << s.bits) + 1
        self.s = s
        self.z = np.zeros(size, np.float32) if z is None else z.copy()
        self.n = np.zeros(size, np.float32) if n is None else n.copy()

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n, s = self.z[at], self.n[at], self.s
        w = -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)
        return np.where(np.abs(z) <= s.l1, np.float32(0), w)

    def step(self, buckets: np.ndarray, label: int) -> None:
        at = np.append(buckets, len(self.z) - 1)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(dtype=np.float64), -35, 35)))
        g = np.float32((p - label) * (self.s.toxic_weight if label else 1.0))
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / np.float32(self.s.alpha) * w
        self.n[at] = n + g * g


def _featurise(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column("_text"))
            for i, j in row_slices(off, BATCH_BYTES):
                f, row = features(data[off[i]:off[j]], off[i:j + 1] - off[i], s.bits)
                key = np.unique((row.astype(np.int64) << 32) | f)
                cut = np.searchsorted(key >> 32, np.arange(j - i + 1))
                low = (key & 0xFFFFFFFF).astype(np.int32)
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_order"), part.column("_label"), pa.array([low[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary())],
                    names=["_order", "_label", "_buckets"])
    return run


def _spread(at, values, s: Settings, kind=np.float32) -> np.ndarray:
    out = np.zeros((1 << s.bits) + 1, kind)
    out[np.frombuffer(at, np.int32)] = np.frombuffer(values, np.float32)
    return out


def _train(s: Settings, state):
    """One epoch from the broadcast `state` (coordinates met so far, their z and n), or from nothing. A coordinate that
    was never met has neither, so only the others travel."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Ftrl(s, *([_spread(state.value[0], x, s) for x in state.value[1:]] if state else ())), 0
        for b in batches:
            for label, raw in zip(b.column("_label").to_pylist(), b.column("_buckets")):
                model.step(np.frombuffer(raw.as_buffer(), np.int32), label)
                seen += 1
        if seen:
            at = np.flatnonzero(model.n).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([seen]), *[pa.array([x.tobytes()], pa.binary()) for x in (at, model.z[at], model.n[at])]],
                                             names=["rows", "at", "z", "n"])
    return run


def fit(labelled: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """Weights (the bias last) from rows (_order long, _label int, _text string).

    `_order` must be a fixed hash of the row; it deals rows to shards and orders them. Features are written once, a
    folder per shard, and every epoch streams each folder through one task. Only `shards` model states, of a
    size bounded by `bits`, reach the driver; their average goes out as a broadcast that ends with the epoch. Without rows, or with one class only, the weights are what FTRL then learns
    (zeros for no rows).
    """
    rows = labelled.where("_label is not null").mapInArrow(_featurise(s), "_order long, _label int, _buckets binary")
    path = scratch_path(labelled.sparkSession, "llm-toxicity-train")
    rows.withColumn("_shard", F.pmod(F.col("_order"), F.lit(s.shards))).write.partitionBy("_shard").parquet(path)
    kept = labelled.sparkSession.read.schema("_order long, _label int, _buckets binary, _shard long").parquet(path)
    rows = reduce(DataFrame.unionAll, [kept.where(F.col("_shard") == k).drop("_shard").coalesce(1).sortWithinPartitions("_order") for k in range(s.shards)])
    state = z = n = None
    for _ in range(s.epochs):
        got = rows.mapInArrow(_train(s, state), "rows long, at binary, z binary, n binary").toArrow()
        if state:
            state.destroy()
        if not got.num_rows:
            return np.zeros((1 << s.bits) + 1, np.float32)
        seen = got.column("rows").to_pylist()
        at = [x.as_buffer() for x in got.column("at")]
        z, n = (sum(k / sum(seen) * _spread(i, x.as_buffer(), s, np.float64) for k, i, x in zip(seen, at, got.column(c))).astype(np.float32) for c in ("z", "n"))
        del got, at
        met = np.flatnonzero(n).astype(np.int32)
        state = labelled.sparkSession.sparkContext.broadcast((met.tobytes(), z[met].tobytes(), n[met].tobytes()))
    state.destroy()
    return Ftrl(s, z, n).weights()


def score_arrays(data: np.ndarray, off: np.ndarray, weights: np.ndarray, bits: int) -> np.ndarray:
    """Probability of every row: the summed weights of its distinct buckets."""
    total = np.full(len(off) - 1, float(weights[-1]))
    for i, j in row_slices(off, BATCH_BYTES):
        f, row = features(data[off[i]:off[j]], off[i:j + 1] - off[i], bits)
        live = np.flatnonzero(weights[f])
        key = np.unique((row[live].astype(np.int64) << 32) | f[live])
        np.add.at(total, i + (key >> 32), weights[key & 0xFFFFFFFF].astype(np.float64))
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _score(value, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = value
        weights = np.zeros((1 << s.bits) + 1, np.float32)
        weights[np.frombuffer(at, np.int32)] = np.frombuffer(w, np.float32)
        for b in batches:
            data, off = buffers(b.column("_text"))
            p = score_arrays(data, off, weights, s.bits)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(p), pa.array((p >= s.threshold).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])
    return run


def score(docs: DataFrame, weights: np.ndarray, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from the threshold on) of every row; only nonzero weights travel.

    Null and empty texts get the bias alone. Rows that repeat an id are scored each. Extra columns are ignored.
    """
    at = np.flatnonzero(weights).astype(np.int32)
    packed = (at.tobytes(), weights[at].astype(np.float32).tobytes())
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        _score(packed, s), f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")


def _keep(value, s: Settings, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = value
        weights = np.zeros((1 << s.bits) + 1, np.float32)
        weights[np.frombuffer(at, np.int32)] = np.frombuffer(w, np.float32)
        for b in batches:
            data, off = buffers(b.column(b.num_columns - 1))
            rest = b.select(b.schema.names[:-1])
            for i, j in row_slices(off, 2 * BATCH_BYTES):
                p = score_arrays(data[off[i]:off[j]], off[i:j + 1] - off[i], weights, s.bits)
                yield rest.slice(i, j - i).filter(pa.array(p < threshold))
    return run


def keep_clean(docs: DataFrame, weights: np.ndarray, s: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold; one scan, no shuffle. Null and empty texts
    get the bias alone; rows that repeat an id are judged each."""
    at = np.flatnonzero(weights).astype(np.int32)
    packed = (at.tobytes(), weights[at].astype(np.float32).tobytes())
    return docs.select("*", F.col(text_col).alias("_" + "_".join(docs.columns))).mapInArrow(_keep(packed, s, s.threshold), docs.schema)


def sample_labels(labels: DataFrame, allowed, s: Settings, label_col: str = "toxic", id_col: str = "doc_id") -> DataFrame:
    """doc_id, _order, _label of at most about `max_rows` labelled rows, drawn by a fixed hash of the id.

    The share to keep comes from one count; `limit` makes the bound strict. A null label or id is no training row; of
    rows that repeat an id the largest label counts.
    """
    rows = (labels.where(allowed & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
            .groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("_label"))
            .withColumn("_order", F.xxhash64(F.lit(5), F.col("doc_id").cast("string")).bitwiseAND(F.lit((1 << 62) - 1))))
    n = rows.count()
    share = min(1.0, s.max_rows / max(n, 1))
    return rows.where(F.col("_order") < F.lit(int(share * (1 << 62)))).limit(s.max_rows + s.max_rows // 10)


def toxicity(docs: DataFrame, labels: DataFrame, allowed, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on the labelled rows that `allowed` (a condition on the labels) admits, then score every document.

    The sampled labels are bounded by `max_rows`, so they are broadcast against the scan of the texts.
    """
    sample = sample_labels(labels, allowed, s, id_col=id_col)
    train = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "doc_id").select("_order", "_label", "_text")
    return score(docs, fit(train, s), s, id_col, text_col)
