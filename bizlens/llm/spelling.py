"""Spelling variants by permuterm: sorted rotations bring words that differ by one character together.

A word w of L characters, marked with a terminator, has L + 1 rotations. Two words that differ only in the character at
i have rotations that agree in everything but their last character, w[i]. A word that lacks the character has a whole
rotation equal to that common part. So each prefix range of the sorted rotations, its last character skipped, holds the
replacements of one position and the one word that results from deleting it. A range holds no more words than the
alphabet has letters, plus one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import written_for_now
from bizlens.llm.textops import LOWER, buffers, row_slices, word_hashes

BATCH_BYTES = 1 << 22
END = "$"  # the terminator; not a letter
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_LEAD = 0xC3  # first UTF-8 byte of U+00C0 to U+00FF, and of no other character
_TABLE = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _TABLE[_i] = _c


@dataclass(frozen=True)
class Settings:
    """A run whose crc32 with its document's id is divisible by `every` loses one character."""
    every: int = 97
    min_points: int = 5
    min_count: int = 3
    ratio: int = 2


def letter_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of ASCII letters and U+00C0 to U+00FF inside rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    lead = data == _LEAD
    ok = _ASCII_LETTER[data] | lead
    ok[1:] |= lead[:-1]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = ok[1:] != ok[:-1]
    edge[off] = True
    starts, ends = np.flatnonzero(ok & edge[:-1]), np.flatnonzero(ok & edge[1:]) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def crc_of_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each run (lower-cased) after what `state` has seen: a byte of all runs at a time, longest runs first."""
    order = np.argsort(starts - ends, kind="stable")
    at, lens = starts[order], (ends - starts)[order]
    crc = state[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    for k in range(int(lens[0]) if len(lens) else 0):
        n = int(np.searchsorted(-lens, -k, "left"))  # runs longer than k
        crc[:n] = _TABLE[(crc[:n] ^ LOWER[data[at[:n] + k]]) & np.uint32(0xFF)] ^ (crc[:n] >> np.uint32(8))
    out = np.empty(len(crc), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs as lower-cased strings."""
    lens = ends - starts
    off = np.concatenate([[0], np.cumsum(lens)])
    pos = np.arange(off[-1]) - np.repeat(off[:-1] - starts, lens)
    return pa.LargeStringArray.from_buffers(len(lens), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(LOWER[data[pos]].tobytes())).cast(pa.string())


def _count_words(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column("_text"))
            ids = b.column("_id").to_pylist()
            for i, j in row_slices(off, BATCH_BYTES):
                d, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                starts, ends, row = letter_runs(d, o)
                leads = np.concatenate([[0], np.cumsum(d == _LEAD)])
                points = ends - starts - (leads[ends] - leads[starts])
                long = points >= s.min_points  # a shorter run stays too short
                starts, ends, row, points = starts[long], ends[long], row[long], points[long]
                if not len(starts):
                    continue
                state = np.array([zlib.crc32(f"{x}:".encode() if x is not None else b":") for x in ids[i:j]], np.uint32)
                h = crc_of_runs(d, starts, ends, state[row])
                cut = h % s.every == 0
                key, at, n = np.unique(word_hashes(d, starts[~cut], ends[~cut], LOWER), return_index=True, return_counts=True)
                words, counts = gather(d, starts[~cut][at], ends[~cut][at]), n
                shorter = []
                for w, x in zip(gather(d, starts[cut], ends[cut]).to_pylist(), h[cut].tolist()):
                    if len(w) > s.min_points:
                        shorter.append(w[:x % len(w)] + w[x % len(w) + 1:])
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array(shorter, pa.string())]),
                                                  pa.array(np.concatenate([counts, np.ones(len(shorter), np.int64)]))], names=["word", "n"])
    return run


def word_counts(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n (occurrences in all documents) of the words that are long and frequent enough."""
    return (docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))
            .mapInArrow(_count_words(s), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= s.min_count))


def rotations(words: DataFrame) -> DataFrame:
    """key, whole, first, word, n: every rotation of every marked word, twice. As a whole, and without its last character
    (whole false; not where that is the terminator), where `first` marks the first of equal characters in a row, so that
    deleting any of them is found once."""
    size = F.length("word")
    at = F.explode(F.sequence(F.lit(0), 2 * size)).alias("j")
    rows = words.select("word", "n", size.alias("size"), at)
    i = F.when(F.col("j") < F.col("size"), F.col("j")).otherwise(F.col("j") - F.col("size"))
    rows = rows.select("word", "n", (F.col("j") >= F.col("size")).alias("whole"), i.alias("i"))
    rest = F.substr("word", F.when(F.col("whole"), F.col("i") + 1).otherwise(F.col("i") + 2))
    key = F.concat(rest, F.lit(END), F.substr("word", F.lit(1), F.col("i")))
    same = F.substr("word", F.col("i"), F.lit(1)) == F.substr("word", F.col("i") + 1, F.lit(1))
    return rows.select(key.alias("key"), "whole", ((F.col("i") == 0) | ~same).alias("first"), "word", "n")


def scan_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words from sorted rotations: rows word, n_near, near_n, near. A word gets, from each range that it shares,
    the number of its partners there and the largest of them. Within a range rows come by whole (false first), n
    (descending) and word; the last range of a batch waits for the next batch, as it may go on there."""
    held: pa.Table | None = None

    def scan(t: pa.Table) -> pa.RecordBatch | None:
        key = t.column("key").combine_chunks()
        new = np.concatenate([[True], ~np.asarray(pc.equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False), bool)])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(key)))
        keep = np.repeat(size > 1, size)
        if not keep.any():
            return None
        rows = np.flatnonzero(keep)
        size = size[size > 1]
        group = np.repeat(np.arange(len(size)), size)
        start = np.cumsum(size) - size
        whole = t.column("whole").to_numpy()[rows]
        first = t.column("first").to_numpy()[rows]
        order = np.arange(len(rows))
        shorter = np.add.reduceat(whole.astype(np.int64), start)  # 0 or 1: the word without the character
        longer = size - shorter
        firsts = np.add.reduceat((first & ~whole).astype(np.int64), start)
        best_first = np.minimum.reduceat(np.where(first & ~whole, order, len(rows)), start)
        found = []
        swap = ~whole & (longer[group] > 1)
        other = np.where(order == start[group], start[group] + 1, start[group])
        found.append((order[swap], (longer[group] - 1)[swap], other[swap]))
        drop = ~whole & first & (shorter[group] > 0)
        last = (start + size - 1)[group]
        found.append((order[drop], np.ones(int(drop.sum()), np.int64), last[drop]))
        add = whole & (firsts[group] > 0)
        found.append((order[add], firsts[group][add], best_first[group][add]))
        who, n_near, near = (np.concatenate(x) for x in zip(*found))
        if not len(who):
            return None
        word, n = t.column("word").combine_chunks(), t.column("n").combine_chunks()
        return pa.RecordBatch.from_arrays([word.take(pa.array(rows[who])), pa.array(n_near), n.take(pa.array(rows[near])), word.take(pa.array(rows[near]))],
                                          names=["word", "n_near", "near_n", "near"])

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        key = t.column("key")
        same = pc.equal(key, key[-1]).to_numpy()
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        held = t.slice(cut)
        if cut and (out := scan(t.slice(0, cut))) is not None:
            yield out
    if held is not None and (out := scan(held)) is not None:
        yield out


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, near_n, near: the number of near words of each word that has any, and the largest of them.

    No pair is made for each two words of a range, so the rows that leave it are as many as it holds at most twice.
    """
    sorted_rows = rotations(words).repartition("key").sortWithinPartitions("key", "whole", F.desc("n"), "word")
    found = sorted_rows.mapInArrow(scan_ranges, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("near")))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
            .select("word", "n_near", (-F.col("best.order")).alias("near_n"), F.col("best.near").alias("near")))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of every word with a form (columns word, form), by doubling the steps until none moves.

    A form occurs at least twice as often as its word, so there is no cycle and the chain of a word is no longer than
    the binary logarithm of the largest count: about five rounds at most.
    """
    now, drop = written_for_now(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved, drop_next = written_for_now(now.join(step, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        drop()
        now, drop = moved.select("word", "root"), drop_next
        if moved.where("_moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of every word that is long and frequent enough.

    A word's form is the largest of its near words (then the smallest in code-point order) if that occurs at least
    `ratio` times as often; its root is where following forms ends. Null and empty texts have no words. A null id
    counts as the empty text in the checksum; rows that repeat an id or a text count each. Words that occur equally
    often are no forms of each other. Extra columns are ignored; an empty table gives an empty result.
    """
    words, _ = written_for_now(word_counts(docs, s, id_col, text_col), "spelling-words")
    near, _ = written_for_now(near_words(words), "spelling-near")
    has = F.col("near_n") >= s.ratio * F.col("n")
    joined, _ = written_for_now(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")), "spelling-forms")
    root = roots(joined.where("form is not null").select("word", "form"))
    return joined.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
