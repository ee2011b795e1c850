"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihood by the scaled forward recursion."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import shuffles_freed, written
from bizlens.llm.textops import LOWER, as_long, buffers, row_slices, word_bounds, word_hashes

log = logging.getLogger(__name__)
BATCH_BYTES = 1 << 20
BLOCK = 2048  # symbols in one row of summed counts
RUN = 1 << 15  # cells (text by time) whose emissions are gathered at once


@dataclass(frozen=True)
class Settings:
    """`top`: words with an emission of their own; all others are emitted through one of 256 classes by their last two
    bytes and then by their count in the class. Every Baum-Welch iteration and every count reads all training texts;
    iterations go on until the summed log likelihood has gained less than `tolerance` of itself `patience` times in a
    row, as a plateau may hold one small gain before larger ones."""
    states: int = 8
    top: int = 60_000
    tolerance: float = 1e-4
    patience: int = 3
    cells: int = 1 << 20
    width: int = 512
    pull: float = 40.0
    seed: int = 11


CLASSES = 256


def word_arrays(data: np.ndarray, off: np.ndarray):
    """Hashes and rare-word classes of all words, and each row's first word."""
    starts, ends, first = word_bounds(data, off)
    h = word_hashes(data, starts, ends, LOWER).view(np.int64)
    last = LOWER[data[ends - 1]].astype(np.int64)
    before = np.where(ends - starts > 1, LOWER[data[np.maximum(ends - 2, 0)]].astype(np.int64), 0)
    return h, (last * 37 + before * 101) % CLASSES, first


# ---- counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held_h: list[np.ndarray] = []
    held_n: list[np.ndarray] = []
    held_c: list[np.ndarray] = []

    def merged():
        h, n, c = (np.concatenate(x) for x in (held_h, held_n, held_c))
        u, at, back = np.unique(h, return_index=True, return_inverse=True)
        return u, np.bincount(back, weights=n, minlength=len(u)).astype(np.int64), c[at]

    def out(h, n, c):
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c.astype(np.int32)), pa.array(n)], names=["h", "cls", "n"])

    for b in batches:
        data, off = buffers(b.column("_text"))
        for i, j in row_slices(off, 4 * BATCH_BYTES):
            h, c, _ = word_arrays(data[off[i]:off[j]], off[i:j + 1] - off[i])
            u, at, n = np.unique(h, return_index=True, return_counts=True)
            held_h.append(u), held_n.append(n), held_c.append(c[at])
            if sum(map(len, held_h)) > 2_000_000:
                h, n, c = merged()
                if len(h) > 1_000_000:
                    yield out(h, n, c)
                    held_h, held_n, held_c = [], [], []
                else:
                    held_h, held_n, held_c = [h], [n], [c]
    if held_h:
        yield out(*merged())


def word_counts(docs: DataFrame, training: Column, text_col: str = "text") -> DataFrame:
    """h, cls, n of every word of the training texts, whatever their number; a task sends each word about once."""
    rows = docs.where(training).select(F.col(text_col).alias("_text")).mapInArrow(_count, "h long, cls int, n long")
    return rows.groupBy("h").agg(F.first("cls").alias("cls"), F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Bounded tables: the `top` words, and totals of the rare words by class."""
    words: np.ndarray  # sorted hashes of the top words
    counts: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    n_docs: int
    n_tokens: int  # N, ends included
    n_types: int  # V, the end included

    @property
    def symbols(self) -> int:
        return len(self.words) + CLASSES + 1

    @property
    def end(self) -> int:
        return self.symbols - 1


def lexicon(counts: DataFrame, n_docs: int, s: Settings) -> Lexicon:
    """The most frequent words (ties by hash) and one row per class of the rest."""
    top = counts.orderBy(F.desc("n"), "h").limit(s.top).toArrow()
    h, n = top.column("h").to_numpy(), top.column("n").to_numpy()
    tokens, words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    if len(h):
        cut_n, cut_h = int(n[-1]), int(h[-1])
        rest = counts.where((F.col("n") < cut_n) | ((F.col("n") == cut_n) & (F.col("h") > cut_h)))
        for r in rest.groupBy("cls").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("w")).collect():
            tokens[r["cls"]], words[r["cls"]] = r["t"], r["w"]
    order = np.argsort(h)
    return Lexicon(h[order], n[order], tokens, words, n_docs, int(n.sum() + tokens.sum()) + n_docs, len(h) + int(words.sum()) + (n_docs > 0))


# ---- encoded texts


def _encode(lex: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_id = TaskContext.get().partitionId() << 33
        log_top = np.log10(lex.counts + 1.0)
        log_class = np.log10(lex.class_tokens + lex.class_words + 1.0)
        n_top = len(lex.words)
        for b in batches:
            data, off = buffers(b.column("_text"))
            for i, j in row_slices(off, 4 * BATCH_BYTES):
                h, c, first = word_arrays(data[off[i]:off[j]], off[i:j + 1] - off[i])
                k, n = j - i, np.diff(first)
                row = np.repeat(np.arange(k), n)
                at = np.searchsorted(lex.words, h)
                is_top = np.zeros(len(h), bool)
                if n_top:
                    at = np.minimum(at, n_top - 1)
                    is_top = lex.words[at] == h
                symbol = np.where(is_top, at, n_top + c).astype(np.uint16)
                base = np.bincount(row[is_top], weights=log_top[at[is_top]], minlength=k) + np.log10(lex.n_docs + 1.0)
                norm = -np.bincount(row[~is_top], weights=log_class[c[~is_top]], minlength=k)
                known = np.bincount(row[is_top], minlength=k) + int(lex.n_docs > 0)
                rare_row, rare = row[~is_top], h[~is_top]
                order = np.lexsort([rare, rare_row])
                rare_row, rare = rare_row[order], rare[order]
                new = np.ones(len(rare), bool)
                new[1:] = (rare[1:] != rare[:-1]) | (rare_row[1:] != rare_row[:-1])
                start = np.flatnonzero(new)
                times = np.diff(np.append(start, len(rare))).astype(np.int32)
                rare, cut = rare[start], np.searchsorted(rare_row[start], np.arange(k + 1))
                part = b.slice(i, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row_id + np.arange(k)), part.column("_id"), part.column("_train"), pa.array(n + 1), pa.array(base, pa.float64()), pa.array(norm.astype(np.float64)), pa.array(known),
                     pa.array([symbol[x:y].tobytes() for x, y in zip(first[:-1], first[1:])], pa.binary()),
                     pa.array([rare[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary()), pa.array([times[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary())],
                    names=["row", "doc_id", "train", "n_tokens", "base", "norm", "known", "symbols", "rare", "times"])
                row_id += k
    return run


def encode(docs: DataFrame, training: Column, lex: Lexicon, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), training.alias("_train"))
    return written(rows.mapInArrow(_encode(lex), f"row long, doc_id {kind}, train boolean, n_tokens long, base double, norm double, known long, "
                                                  "symbols binary, rare binary, times binary"), "hmm-encoded")


def _unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = np.array([len(x.as_buffer() or b"") // 8 if x.is_valid else 0 for x in b.column("rare")], np.int64)
        rare, times = (b"".join(x.as_py() for x in b.column(c)) for c in ("rare", "times"))
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(rare, np.int64)), pa.array(np.repeat(b.column("row").to_numpy(), n)), pa.array(np.frombuffer(times, np.int32))],
                                         names=["h", "row", "times"])


def rare_sums(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """row, rare_log (sum of log10(c + 1) over rare tokens) and rare_known: rare words meet their counts in a join."""
    rows = encoded.where(F.octet_length("rare") > 0).select("row", "rare", "times").mapInArrow(_unroll, "h long, row long, times int")
    return (rows.join(counts.select("h", "n"), "h", "left").groupBy("row")
            .agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))).alias("rare_log"),
                 F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known")))


# ---- the model


@dataclass
class Model:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # symbols x K


def groups_of(symbols: list[np.ndarray], end: int, s: Settings):
    """Texts as (rows, lengths, time-major symbol matrix), longest first, of bounded size; the end symbol closes each."""
    length = np.array([len(x) + 1 for x in symbols])
    order = np.argsort(-length, kind="stable")
    i = 0
    while i < len(order):
        width = int(max(1, min(s.width, s.cells // length[order[i]])))
        rows = order[i:i + width]
        m = np.full((len(rows), length[rows[0]]), end, np.int64)
        for k, r in enumerate(rows):
            m[k, :length[r] - 1] = symbols[r]
        yield rows, length[rows], np.ascontiguousarray(m.T)
        i += width


def runs_of(alive: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first step, end, columns) of consecutive steps with the same columns, of about `RUN` cells at most."""
    cuts = [0, *(np.flatnonzero(np.diff(alive)) + 1).tolist(), len(alive)]
    for x, y in zip(cuts[:-1], cuts[1:]):
        b = int(alive[x])
        step = max(1, RUN // b)
        for t in range(x, y, step):
            yield t, min(t + step, y), b


def _sum_states(a: np.ndarray, out: np.ndarray, half: np.ndarray, quarter: np.ndarray) -> None:
    """a.sum(1); eight states are added in numpy's own order, two by two, but over all columns at once."""
    if a.shape[1] != 8 or len(a) < 128:
        np.add.reduce(a, 1, out=out)
        return
    flat = a.reshape(-1)
    np.add(flat[0::2], flat[1::2], out=half)
    np.add(half[0::2], half[1::2], out=quarter)
    np.add(quarter[0::2], quarter[1::2], out=out)


def forward(model: Model, lengths: np.ndarray, m: np.ndarray, keep: bool = False):
    """Natural-log likelihood of every column of `m`; with `keep` also the scaled forward values (steps x columns x
    states) and scales of each run of steps."""
    k, kind = len(model.start), model.emit.dtype
    ll = np.zeros(m.shape[1])
    alive = np.searchsorted(-lengths, -np.arange(1, len(m) + 1), "right")  # columns that have a symbol at each time
    alphas, scales, a = [], [], None
    emit = np.ascontiguousarray(model.emit)
    for x, y, b in runs_of(alive):
        run = emit.take(m[x:y, :b], axis=0)  # emissions, which the forward values replace step by step
        c = np.empty((y - x, b), kind)
        moved, half, quarter = np.empty((b, k), kind), np.empty(b * 4, kind), np.empty(b * 2, kind)
        for now, scale in zip(run, c):
            now *= model.start if a is None else np.matmul(a[:b], model.move, out=moved)
            _sum_states(now, scale, half, quarter)
            now /= scale[:, None]
            a = now
        ll[:b] = np.add.reduce(np.concatenate([ll[None, :b], np.log(c)]), axis=0)
        if keep:
            alphas.append(run), scales.append(c)
    return ll, alphas, scales


def expect(model: Model, symbols: list[np.ndarray], end: int, s: Settings):
    """Expected starts, moves and emissions (symbols x K) and the log likelihood of some texts."""
    k, kind = len(model.start), model.emit.dtype
    start, move, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros((k, end + 1)), 0.0
    model = Model(model.start, model.move, np.ascontiguousarray(model.emit))
    for _, lengths, m in groups_of(symbols, end, s):
        ll, alphas, scales = forward(model, lengths, m, keep=True)
        total += ll.sum()
        cells = int(lengths.sum())
        gammas, seen = np.empty((k, cells), kind), np.empty(cells, np.int64)
        at, y, ahead = 0, len(m), np.zeros((0, k), kind)  # ahead: emission by backward value by scale of the step at y
        while alphas:
            run, c = alphas.pop(), scales.pop()
            n, b = c.shape
            here = m[y - n:y, :b]
            after, beta = model.emit.take(here, axis=0), np.ones((n, b, k), kind)
            if len(ahead):  # the columns that go on past this run
                move += run[-1][:len(ahead)].T @ ahead
                beta[-1, :len(ahead)] = ahead @ model.move.T
            for t in range(n - 1, -1, -1):
                z = after[t]
                z *= beta[t]
                z /= c[t][:, None]
                if t:
                    np.matmul(z, model.move.T, out=beta[t - 1])
            if n > 1:
                moves = np.matmul(run[:-1].transpose(0, 2, 1), after[1:])
                move = np.add.reduce(np.concatenate([move[None], moves[::-1]]), axis=0)
            run *= beta
            gammas[:, at:at + n * b] = run[::-1].reshape(-1, k).T
            seen[at:at + n * b] = here[::-1].reshape(-1)
            at, y, ahead = at + n * b, y - n, after[0]
        start += run[0].sum(0)
        for i in range(k):
            emit[i] += np.bincount(seen, weights=gammas[i], minlength=end + 1)
    return start, move * model.move, emit.T, total


def maximise(start, move, emit, unigram: np.ndarray, s: Settings, dtype=np.float64) -> Model:
    """Normalised counts; every state's emissions are pulled towards the unigram by `pull` counts, so none is zero."""
    k = len(start)
    return Model(((start + 1) / (start.sum() + k)).astype(dtype), ((move + 1) / (move.sum(1, keepdims=True) + k)).astype(dtype),
                 ((emit + s.pull * unigram[:, None]) / (emit.sum(0) + s.pull)).astype(dtype))


def first_model(unigram: np.ndarray, s: Settings) -> Model:
    rng = np.random.Generator(np.random.PCG64(s.seed))
    emit = unigram[:, None] * rng.gamma(2.0, size=(len(unigram), s.states))
    stay = np.full((s.states, s.states), 0.05 / max(1, s.states - 1))
    np.fill_diagonal(stay, 0.95 if s.states > 1 else 1.0)
    return Model(np.full(s.states, 1 / s.states), stay, emit / emit.sum(0))


def _symbols(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint16) for x in b.column("symbols")]


def _pack(arrays) -> bytes:
    return b"".join(np.ascontiguousarray(x, np.float64).tobytes() for x in arrays)


def _unpack(raw: bytes, symbols: int, k: int, dtype) -> Model:
    v = np.frombuffer(raw, np.float64)
    return Model(v[:k].astype(dtype), v[k:k + k * k].reshape(k, k).astype(dtype), v[k + k * k:].reshape(symbols, k).astype(dtype))


def _expect(raw: Broadcast, symbols: int, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _unpack(raw.value, symbols, s.states, np.float32)
        total = None
        for b in batches:
            got = expect(model, _symbols(b), symbols - 1, s)
            total = got if total is None else tuple(x + y for x, y in zip(total, got))
        if total is not None:
            start, move, emit, ll = total
            head = np.concatenate([start, move.ravel(), [ll]])
            values = [head, *[emit[i:i + BLOCK].ravel() for i in range(0, symbols, BLOCK)]]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32) - 1), pa.array([v.tobytes() for v in values], pa.binary())], names=["block", "counts"])
    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, v in zip(b.column("block").to_pylist(), b.column("counts")):
            x = np.frombuffer(v.as_py(), np.float64)
            total[k] = total[k] + x if k in total else x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["block", "counts"])


def baum_welch(training: DataFrame, model: Model, unigram: np.ndarray, s: Settings) -> tuple[Model, float]:
    """One iteration over all training texts, and their log likelihood under the model it starts from. Each task sends
    its counts in blocks of symbols; the blocks are summed in parallel, and the driver gets one model's worth of them.
    What an iteration leaves on disk goes with it."""
    spark = training.sparkSession
    raw = spark.sparkContext.broadcast(_pack((model.start, model.move, model.emit)))
    parts = -(-len(unigram) // BLOCK) + 1
    with shuffles_freed(spark):
        rows = training.select("symbols").mapInArrow(_expect(raw, len(unigram), s), "block int, counts binary")
        sums = rows.repartition(parts, "block").mapInArrow(_sum, "block int, counts binary").collect()
    raw.destroy()
    got = {r["block"]: np.frombuffer(r["counts"], np.float64) for r in sums}
    if not got:
        return model, 0.0
    k, head = s.states, got.pop(-1)
    emit = np.concatenate([got[i] for i in sorted(got)]).reshape(-1, k)
    return maximise(head[:k], head[k:k + k * k].reshape(k, k), emit, unigram, s), float(head[-1])


def train(encoded: DataFrame, lex: Lexicon, s: Settings) -> tuple[Model, np.ndarray]:
    u = np.ones(lex.symbols)
    u[:len(lex.words)] += lex.counts
    u[len(lex.words):-1] += lex.class_tokens
    u[-1] += lex.n_docs
    u /= u.sum()
    model = first_model(u, s)
    training = encoded.where("train")
    before, small, gains = -np.inf, 0, []
    while small < s.patience:
        model, now = baum_welch(training, model, u, s)
        gains.append((now - before) / -now if now < 0 else 0.0)
        small = small + 1 if gains[-1] <= s.tolerance else 0
        before = now
    log.info("Baum-Welch: %d iterations, relative gains %s", len(gains), " ".join(f"{g:.1e}" for g in gains[1:]))
    return model, u


def _score(raw: bytes, symbols: int, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _unpack(raw, symbols, s.states, np.float64)
        for b in batches:
            ll = np.zeros(b.num_rows)
            for rows, lengths, m in groups_of(_symbols(b), symbols - 1, s):
                ll[rows] = forward(model, lengths, m)[0]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("row", "doc_id", "train", "n_tokens", "base", "norm", "known")], pa.array(ll / np.log(10))],
                                             names=["row", "doc_id", "train", "n_tokens", "base", "norm", "known", "ll"])
    return run


def score_texts(docs: DataFrame, training: Column, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; learns where `training`.

    Words are told apart by a 64-bit hash. score is log10 P(text): the forward recursion over top words, rare classes
    and the end, plus each rare word's log10 ((c + 1) / (tokens + words + 1 of its class)), in which an unseen word has
    c = 0. base_score is the add-one unigram with the same treatment of unseen words.

    Null and empty texts are the end token alone. Rows that repeat an id are scored each. Without training rows the
    counts are 0 and the states keep their random start. Extra columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    counts = written(word_counts(docs, training, text_col), "hmm-counts")
    lex = lexicon(counts, docs.where(training).count(), s)
    encoded = encode(docs, training, lex, id_col, text_col)
    model, _ = train(encoded, lex, s)
    scored = encoded.drop("rare", "times").mapInArrow(
        _score(_pack((model.start, model.move, model.emit)), lex.symbols, s),
        f"row long, doc_id {kind}, train boolean, n_tokens long, base double, norm double, known long, ll double")
    zero = F.lit(0)
    out = scored.join(rare_sums(encoded, counts), "row", "left")
    rare = F.coalesce("rare_log", F.lit(0.0))
    return out.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("rare_known", zero)).cast("bigint").alias("n_known"),
        F.lit(lex.n_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + rare - F.col("n_tokens") * F.lit(float(np.log10(lex.n_tokens + lex.n_types + 1)))).alias("base_score"),
        (F.col("ll") + F.col("norm") + rare).alias("score"))
