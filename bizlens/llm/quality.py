"""Quality: repetition rules, and the log-likelihood ratio of hashed n-grams between trusted and raw text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.llm.textops import GRAM, SAME, SPLIT, WORD, buffers, grams, mix, row_slices, word_bounds, word_hashes

BATCH_BYTES = 1 << 20
#: The symbols that are counted.
SYMBOLS = "#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


@dataclass(frozen=True)
class Settings:
    """`max_trusted` bounds the trusted rows that are read, whatever the corpus holds; the raw side reads every row."""
    bits: int = 16
    smoothing: float = 4.0
    threshold: float = -0.1
    max_trusted: int = 30_000
    min_words: int = 20
    window: int = 8
    repeat_percent: int = 30


def buckets(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed unigrams and bigrams of every row (case kept; punctuation runs are tokens), and the row of each."""
    starts, ends, first = word_bounds(data, off, SPLIT)
    w = word_hashes(data, starts, ends, SAME)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    same = row[:-1] == row[1:]
    two = mix(w[:-1][same] * GRAM[0] + w[1:][same] * GRAM[1])
    h = np.concatenate([mix(w * GRAM[2]), two])
    return (h >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([row, row[:-1][same]])


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, trusted = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for b in batches:
            data, off = buffers(b.column("_text"))
            good = b.column("_trusted").to_numpy(zero_copy_only=False).astype(bool)
            for i, j in row_slices(off, BATCH_BYTES):
                h, row = buckets(data[off[i]:off[j]], off[i:j + 1] - off[i], bits)
                raw += np.bincount(h, minlength=1 << bits)
                if good[i:j].any():
                    trusted += np.bincount(h[good[i:j][row]], minlength=1 << bits)
        at = np.flatnonzero(raw)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(trusted[at])], names=["bucket", "raw", "trusted"])
    return run


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio of the trusted to the raw multinomial, one value per bucket.

    Raw counts come from every document. Trusted text is that of rows labelled `quality` 1: at most about `max_trusted`
    of them, drawn by a fixed hash of the id, so their ids may be broadcast. What reaches the driver has 2**bits rows.
    Trusted counts are smoothed with `smoothing` raw counts per bucket on average. Without trusted rows all ratios are 0.
    """
    rows = (labels.where((F.col("quality") == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
            .withColumn("_order", F.xxhash64(F.lit(9), F.col("_id").cast("string")).bitwiseAND(F.lit((1 << 62) - 1))))
    share = min(1.0, s.max_trusted / max(rows.count(), 1))
    sample = rows.where(F.col("_order") < F.lit(int(share * (1 << 62)))).limit(s.max_trusted + s.max_trusted // 10)
    marked = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
              .join(F.broadcast(sample.select("_id", F.lit(True).alias("_in"))), "_id", "left")
              .select("_text", F.coalesce("_in", F.lit(False)).alias("_trusted")))
    counts = (marked.mapInArrow(_count(s.bits), "bucket int, raw long, trusted long").groupBy("bucket")
              .agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toArrow())
    raw, trusted = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
    at = counts.column("bucket").to_numpy()
    raw[at], trusted[at] = counts.column("raw").to_numpy(), counts.column("trusted").to_numpy()
    if not trusted.sum():
        return np.zeros(1 << s.bits)
    q = raw / raw.sum()
    p = (trusted + s.smoothing * len(raw) * q) / (trusted.sum() + s.smoothing * len(raw))
    return np.log(np.where(raw > 0, p, 1) / np.where(raw > 0, q, 1))


def repeated_words(words: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Per row, the words that lie in a `window`-word run found twice or more in the row."""
    count = np.diff(first)
    h, at = grams(words, first, window)
    cover = np.zeros(len(words) + 1, np.int64)
    if len(h):
        key = mix(h ^ mix(at.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        again = order[same[1:] | same[:-1]]
        n = np.maximum(count - window + 1, 0)
        start = first[at[again]] + again - (np.cumsum(n) - n)[at[again]]
        np.add.at(cover, start, 1)
        np.add.at(cover, start + window, -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return hit[first[1:]] - hit[first[:-1]]


def _judge(weights: bytes, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = np.frombuffer(weights, np.float64)
        for b in batches:
            data, off = buffers(b.column("_text"))
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i, j in row_slices(off, BATCH_BYTES):
                d, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                starts, ends, first = word_bounds(d, o)
                at = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[o])
                h, row = buckets(d, o, s.bits)
                total = np.bincount(row, weights=ratio[h], minlength=j - i)
                n = np.bincount(row, minlength=j - i)
                lines = np.zeros(j - i, np.int64)
                raw = d.tobytes()
                for k in range(j - i):
                    split = [x for x in raw[o[k]:o[k + 1]].split(b"\n") if x.strip()]
                    lines[k] = len(split) - len(set(split))
                for col, v in zip(cols, (np.diff(first), at((WORD[d] > 0) & ((d & 0xC0) != 0x80)), at(_IS_SYMBOL[d]), lines,
                                         repeated_words(word_hashes(d, starts, ends, SAME), first, s.window), total / np.maximum(n, 1))):
                    col.append(v)
            n_words, chars, symbols, lines, repeats, llr = (np.concatenate(c) if c else np.zeros(0) for c in cols)
            failed = (n_words < s.min_words) | (100 * repeats > s.repeat_percent * n_words)
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), *[pa.array(x.astype(np.int64)) for x in (n_words, chars, symbols, lines, repeats)],
                 pa.array(failed), pa.array(~failed & (llr >= s.threshold)), pa.array(llr.astype(np.float64))],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"])
    return run


def quality_rules(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base_failed, kept and llr (mean log ratio per n-gram) of every document.

    A document is kept if it passes the base rules and its ratio reaches `threshold`; equal texts always get equal
    verdicts. Null and empty texts have no words, so they fail the base rules, with a ratio of 0. Rows that repeat an
    id are judged each. Extra columns are ignored; an empty table gives an empty result.
    """
    ratio = fit(docs, labels, s, id_col, text_col).astype(np.float64).tobytes()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        _judge(ratio, s), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                          "n_repeat_words long, base_failed boolean, kept boolean, llr double")
