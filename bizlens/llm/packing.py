"""Best-fit packing of tokenised documents into fixed-size sequences, certified by lower bounds."""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import text_or_empty, written

CACHE_WORDS = 100_000


@dataclass(frozen=True)
class Settings:
    """`part_pieces`: pieces dealt to a partition on average, which bounds a task; `rounds`: exchanges at most."""
    size: int = 2048
    part_pieces: int = 50_000
    rounds: int = 4
    seed: int = 3


class Encoder:
    """Byte-level BPE ids as little-endian bytes, with a bounded cache of space-led words.

    A token never contains a space other than as its first character unless it is white space only, so a text with
    single spaces between words splits before each space without changing its ids; other texts are encoded whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path.removesuffix(".json") + ".tiktoken", "rb"))}
        self.encode = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cache: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        words = text.split(" ")
        if len(words) < 2 or any(not w or w[0].isspace() for w in words[1:]):
            return self.whole(text)
        cache, out = self.cache, [self.whole(words[0])]
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in words[1:]:
            ids = cache.get(w)
            if ids is None:
                ids = self.whole(" " + w)
                if len(w) < 64:
                    cache[w] = ids
            out.append(ids)
        return b"".join(out)


def _pieces(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for b in batches:
            rows: list[tuple] = []
            for row, text in zip(b.column("_row").to_pylist(), b.column("_text").to_pylist()):
                ids = encode(text) + b"\0\0\0\0"
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    length = (n - start - 1) % size + 1 if start == 0 else size
                    rows.append((row, piece, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])))
                    start, piece = start + length, piece + 1
            row, piece, start, length, crc = zip(*rows) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(row, b.column("_row").type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def cut_documents(docs: DataFrame, tokenizer: str, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and a closing 0, cut from the end into full pieces."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_row"), text_or_empty(text_col).alias("_text")).mapInArrow(
        _pieces(tokenizer, s.size), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Bins that these lengths need at least: the best of the dual feasible functions
    u_k(x) = x if (k + 1) x / size is whole, else floor((k + 1) x / size) size / k, and
    f_e(x) = size over size - e, x from e on, 0 below it."""
    if not len(lengths):
        return 0
    value, count = np.unique(np.asarray(lengths, np.int64), return_counts=True)
    best = -(-int((value * count).sum()) // size)
    for e in np.unique(np.minimum(value, size - value)):
        if 0 < e <= size // 2:
            f = np.where(value > size - e, size, np.where(value >= e, value, 0))
            best = max(best, -(-int((f * count).sum()) // size))
    for k in range(1, 21):
        whole = (k + 1) * value % size == 0
        u = np.where(whole, value * k, (k + 1) * value // size * size)
        best = max(best, -(-int((u * count).sum()) // (size * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every piece, and the tokens in each bin. Longest first, each into the fullest bin that takes it."""
    bins, offsets, room = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    with_room: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0  # bit r is set while some bin has r tokens of room
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        n = int(lengths[i])
        fit = mask >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = with_room[r].pop()
            if not with_room[r]:
                mask ^= 1 << r
        else:
            r, b = size, len(room)
            room.append(size)
        bins[i], offsets[i] = b, size - r
        room[b] = r - n
        if r > n:
            if not with_room[r - n]:
                mask |= 1 << (r - n)
            with_room[r - n].append(b)
    return bins, offsets, size - np.array(room, np.int64)


def _pack(s: Settings, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        t = t.take(pa.array(np.lexsort([t.column("start").to_numpy(), t.column("_mix").to_numpy()])))
        lengths = t.column("length").to_numpy()
        bins, offsets, filled = best_fit_decreasing(lengths, s.size)
        certified = k == s.rounds - 1 or len(filled) == lower_bound(lengths, s.size)
        done = np.full(len(filled), True) if certified else filled == s.size
        number = (k << 56) + (TaskContext.get().partitionId() << 32) + bins
        out = t.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offsets)).append_column("_done", pa.array(done[bins]))
        yield from out.to_batches(max_chunksize=20_000)
    return run


def pack(pieces: DataFrame, s: Settings = Settings()) -> DataFrame:
    """`pieces` (a written table with doc_id, start, length) plus sequence_id and offset.

    Pieces are dealt by a hash into partitions of a bounded size, each packed best fit decreasing. A partition whose
    bin count equals its lower bound is certified and stays as it is; of the others the full bins stay and the rest is
    exchanged: dealt anew, into fewer partitions, and packed again. What is left in the last round keeps its bins.
    Full-length pieces are sequences of their own. Each round is written to the shared folder, so it is never repeated
    for a lost executor. Longest first, ties in the order of a hash; repeated rows are packed each.
    """
    names = pieces.columns
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    todo = pieces.where(F.col("length") < s.size).withColumn("_mix", F.xxhash64(*names))
    full = pieces.where(F.col("length") >= s.size)
    out = full.select(*names, (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    for k in range(s.rounds):
        parts = max(1, math.ceil(todo.count() / s.part_pieces))
        dealt = todo.repartition(parts, F.xxhash64(F.lit(s.seed + k), "_mix"))
        packed = written(dealt.mapInArrow(_pack(s, k), f"{kind}, _mix long, sequence_id long, offset long, _done boolean"), f"packing-{k}")
        out = out.unionAll(packed.where("_done").select(*names, "sequence_id", "offset"))
        todo = packed.where("not _done").select(*names, "_mix")
        if todo.isEmpty():
            break
    return out


def pack_documents(docs: DataFrame, tokenizer: str, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack every row: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the closing id alone. Rows that repeat an id are cut and packed each. Extra columns are
    ignored; an empty table gives an empty result.
    """
    return pack(written(cut_documents(docs, tokenizer, s, id_col, text_col), "packing-pieces"), s)
