"""Documents with similar sets of word shingles, by PartEnum signatures."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import shuffles_freed, written, written_for_now
from bizlens.llm.graph import connected_components
from bizlens.session import scratch_path
from bizlens.llm.textops import LOWER, as_long, buffers, grams, mix, row_slices, word_bounds, word_hashes

BATCH_BYTES = 1 << 20
ID_BUCKETS = 1 << 20
HELD_PAIRS = 1 << 18
SKETCH = 8  # 64-bit words of a parity sketch, at least
SENT = 64  # and at most of those that go to the signature groups


@dataclass(frozen=True)
class Settings:
    """Two sets link when 100 |A and B| >= percent |A or B|. `low_bits`: the first filter looks at 1 in 2**low_bits of
    the shingle domain. `slack` widens the first level of PartEnum so that empty parts seldom have to be sent."""
    words: int = 5
    percent: int = 80
    low_bits: int = 2
    slack: float = 1.15


# ---- sets


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows in row order, and each row's first (rows + 1 entries)."""
    starts, ends, first = word_bounds(data, off)
    h, at = grams(word_hashes(data, starts, ends, LOWER), first, words, whole_if_short=True)
    order = np.lexsort([h, at])
    h, at = h[order], at[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    h, at = h[new], at[new]
    return h, np.searchsorted(at, np.arange(len(off)))


def _identity(h: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every set."""
    one, two = (np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(c)))]) for c in (0x243F6A8885A308D3, 0x13198A2E03707344))
    return mix(one[cut[1:]] - one[cut[:-1]]), mix(two[cut[1:]] - two[cut[:-1]])


def _locally_shared(h: np.ndarray, cut: np.ndarray, ids: np.ndarray, low_bits: int):
    """For the low part of the domain: per row its size, how many of its shingles another set of this batch has too,
    the shingles that none has (still open), and one witness row per shared shingle.

    Rows whose set came before in the batch have nothing open and are no witness.
    """
    n = len(cut) - 1
    row = np.repeat(np.arange(n), np.diff(cut))
    _, where = np.unique(ids, return_index=True)
    leads = np.zeros(n, bool)
    leads[where] = True
    low = (h >> np.uint64(64 - low_bits) == 0) if low_bits else np.ones(len(h), bool)
    size = np.bincount(row[low], minlength=n)
    live = low & leads[row]
    s, r = h[live], row[live]
    order = np.argsort(s, kind="stable")
    s, r = s[order], r[order]
    new = np.ones(len(s) + 1, bool)
    new[1:-1] = s[1:] != s[:-1]
    shared = ~(new[:-1] & new[1:])
    count = np.bincount(r[shared], minlength=n)
    open_s, open_r = s[~shared], r[~shared]
    wit = shared & new[:-1]
    wit_s, wit_r = s[wit], r[wit]

    def packed(values, rows):
        order = np.argsort(rows, kind="stable")
        at = np.searchsorted(rows[order], np.arange(n + 1))
        values = values[order]
        return [values[x:y].tobytes() for x, y in zip(at[:-1], at[1:])]

    return size, count, packed(open_s, open_r), packed(wit_s, wit_r)


FOUND = "low long, shared long, open binary, witness binary"
SETS = f"doc_id long, n long, h1 long, h2 long, {FOUND}"
ITEMS = "doc_id long, n long, h1 long, h2 long, items binary"


def _found(h: np.ndarray, cut: np.ndarray, h1: np.ndarray, low_bits: int) -> list[pa.Array]:
    size, count, open_, witness = _locally_shared(h, cut, h1, low_bits)
    return [pa.array(size), pa.array(count), pa.array(open_, pa.binary()), pa.array(witness, pa.binary())]


def _sliced(b: pa.RecordBatch, words: int):
    """Slices of a batch (first and last row) with the sets in them."""
    data, off = buffers(b.column("_text"))
    for i, j in row_slices(off, 4 * BATCH_BYTES):
        parts = []
        for x, y in row_slices(off[i:j + 1], BATCH_BYTES):
            x, y = x + i, y + i
            parts.append(shingle_sets(data[off[x]:off[y]], off[x:y + 1] - off[x], words))
        h = np.concatenate([p[0] for p in parts])
        yield i, j, h, np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])


def _sets(s: Settings):
    """Of every row the identity of its set and what the low part of the domain tells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, h, cut in _sliced(b, s.words):
                h1, h2 = _identity(h, cut)
                cols = [b.column("_id").slice(i, j - i), pa.array(np.diff(cut)), as_long(h1), as_long(h2), *_found(h, cut, h1, s.low_bits)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "h1", "h2", "low", "shared", "open", "witness"])
    return run


def _items(s: Settings):
    """The sets themselves, of the rows whose set is the one asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, h, cut in _sliced(b, s.words):
                h1, h2 = (as_long(x) for x in _identity(h, cut))
                asked = pc.and_(pc.equal(h1, b.column("_h1").slice(i, j - i)), pc.equal(h2, b.column("_h2").slice(i, j - i)))
                items = pa.array([h[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("_id").slice(i, j - i), pa.array(np.diff(cut)), h1, h2, items], names=["doc_id", "n", "h1", "h2", "items"]).filter(asked)
    return run


def _resettled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Written sets with what the whole domain tells about them."""
    for b in batches:
        off = np.concatenate([[0], np.cumsum(pc.binary_length(b.column("items")).to_numpy(zero_copy_only=False))]).astype(np.int64)
        for i, j in row_slices(off, 4 * BATCH_BYTES):
            part = b.slice(i, j - i)
            h = np.frombuffer(b"".join(part.column("items").to_pylist()), np.uint64)
            found = _found(h, (off[i:j + 1] - off[i]) // 8, part.column("h1").to_numpy(), 0)
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", "n", "h1", "h2")] + found, names=["doc_id", "n", "h1", "h2", "low", "shared", "open", "witness"])


# ---- filter: a linked set shares at least `percent` of its shingles with other sets


def _unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, witness in (("open", 0), ("witness", 1)):
            raw = b.column(name).to_pylist()
            n = np.array([len(x) // 8 for x in raw], np.int64)
            if n.sum():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raw), np.int64)), pa.array(np.repeat(b.column("h1").to_numpy(), n)),
                                                  pa.array(np.full(int(n.sum()), witness, np.int8))], names=["s", "h1", "w"])


def _sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole key groups from batches sorted by `key`, with the first row of each group (groups + 1 entries)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        if held and k[0] == k[-1] == held[-1].column(key)[held[-1].num_rows - 1].as_py():
            held.append(b)
            continue
        last = int(np.searchsorted(k, k[-1]))
        done = pa.Table.from_batches([*held, b.slice(0, last)])
        held = [b.slice(last)]
        if done.num_rows:
            yield done, _edges(done.column(key).to_numpy())
    if held:
        done = pa.Table.from_batches(held)
        yield done, _edges(done.column(key).to_numpy())


def _edges(k: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, edge in _sorted_groups(batches, "s"):
        h1, w = t.column("h1").to_numpy(), t.column("w").to_numpy()
        several = np.minimum.reduceat(h1, edge[:-1]) != np.maximum.reduceat(h1, edge[:-1])
        several |= np.maximum.reduceat(w, edge[:-1]) > 0
        u, n = np.unique(h1[np.repeat(several, np.diff(edge)) & (w == 0)], return_counts=True)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], names=["h1", "found"])


def shared_enough(sets: DataFrame, s: Settings) -> DataFrame:
    """One row per distinct set (node = smallest id, n, h1, h2) that may have a partner.

    A set with a partner lacks at most n - ceil(percent n / 100) of its shingles in other sets, so among those in the
    low part no more are missing either. A batch settles the shingles that two of its own sets have and sends one
    witness for each, so a shingle that a third of all documents hold reaches the shuffle as a row per batch.
    """
    rows = sets.where("n > 0").select("h1", "open", "witness").mapInArrow(_unroll, "s long, h1 long, w tinyint")
    found = (rows.repartition("s").sortWithinPartitions("s").mapInArrow(_shared_rows, "h1 long, found long")
             .groupBy("h1").agg(F.sum("found").alias("found")))
    one = sets.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("low").alias("low"), F.sum("shared").alias("shared"))
    may_miss = F.col("n") - F.ceil(F.col("n") * s.percent / 100)
    return (one.where("node is not null").join(found, "h1", "left")
            .where(F.col("shared") + F.coalesce("found", F.lit(0)) >= F.col("low") - may_miss).select("node", "n", "h1", "h2"))


# ---- PartEnum


@lru_cache(maxsize=None)
def bands(percent: int, upto: int) -> tuple[tuple[int, int], ...]:
    """Size bands (low, high), each as wide as two linked sets may differ, up to the one that holds `upto`."""
    out, low = [], 1
    while not out or out[-1][1] < upto:
        out.append((low, low * 100 // percent))
        low = out[-1][1] + 1
    return tuple(out)


def parameters(k: int, slack: float) -> tuple[int, int, int]:
    """n1 first-level parts, n2 second-level parts in each, of which k2 may differ: for Hamming distance k."""
    if k == 0:
        return 1, 1, 0
    return max(1, int(np.ceil(slack * (k + 1) / 2))), 3, 1


def part_enum(items: np.ndarray, instance: int, k: int, n1: int, n2: int, k2: int) -> np.ndarray:
    """Signatures of a set such that two sets of Hamming distance k or less share one.

    The domain is cut into n1 x n2 parts by a hash. At most k // (k2 + 1) first-level parts hold more than k2
    differences; in each other one, some choice of n2 - k2 second-level parts holds none, and its content is a
    signature. Empty choices say little and are left out as long as fewer first-level parts offer one than must agree;
    two sets that both have more send them too.
    """
    cells = n1 * n2
    u = mix(items ^ mix(np.array([instance], np.uint64)))
    cell = ((u >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
    size = np.bincount(cell, minlength=cells).reshape(n1, n2)
    order = np.argsort(cell, kind="stable")
    run = np.concatenate([[np.uint64(0)], np.cumsum(mix(items[order] + np.uint64(0x9E3779B97F4A7C15)))])
    at = np.concatenate([[0], np.cumsum(size.ravel())])
    content = (run[at[1:]] - run[at[:-1]]).reshape(n1, n2)
    choices = list(combinations(range(n2), n2 - k2))
    filled = np.stack([size[:, c].sum(1) for c in choices], 1)
    weak = int((filled == 0).any(1).sum())
    sig = np.stack([content[:, c].sum(1, dtype=np.uint64) for c in choices], 1)
    name = (np.arange(n1 * len(choices), dtype=np.uint64) + (np.uint64(instance) << np.uint64(40))).reshape(n1, -1)
    sig = mix(sig ^ mix(name))
    send = filled > 0 if weak < n1 - k // (k2 + 1) else np.ones_like(filled, bool)
    return sig[send]


def signatures(items: np.ndarray, s: Settings) -> np.ndarray:
    """Signatures of a set for its own size band and the next, where its larger partners are."""
    n, out = len(items), []
    table = bands(s.percent, 1 << max(4, int(n).bit_length() + 1))
    i = next(x for x, (_, high) in enumerate(table) if n <= high)
    for instance in (i, i + 1):
        k = (100 - s.percent) * 2 * table[instance][1] // (100 + s.percent)
        out.append(part_enum(items, instance, k, *parameters(k, s.slack)))
    return np.unique(np.concatenate(out))


def sketch(items: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """Parity of the items in each of 64 * words cells; two sketches differ in no more bits than their sets in items. The
    xor of its halves is the sketch of half the words (a power of two)."""
    bit = np.bincount((mix(items) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bit.astype(np.uint8)).view(np.uint64)


def wide_sketch(items: np.ndarray) -> np.ndarray:
    """A parity sketch with a bit or more per item, so that it tells large sets apart as well."""
    return sketch(items, max(SKETCH, (1 << int(len(items) - 1).bit_length()) // 64))


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Sketches (the last axis), folded to at most so many words."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def least_distance(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the Hamming distance from two wide sketches; the longer is folded to the other's size."""
    return int(np.bitwise_count(folded(a, len(b)) ^ folded(b, len(a))).sum())


def levels(sketches: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every size from SKETCH words up: the sketches that have it, folded to it, and each one's row there (-1: none)."""
    words = pc.binary_length(sketches).to_numpy() // 8
    out, size = [], SKETCH
    while size <= words.max():
        has = np.flatnonzero(words >= size)
        place = np.full(len(words), -1)
        place[has] = np.arange(len(has))
        bits = np.empty((len(has), size), np.uint64)
        for w in np.unique(words[has]):
            raw = b"".join(sketches.take(pa.array(np.flatnonzero(words == w))).to_pylist())
            bits[words[has] == w] = folded(np.frombuffer(raw, np.uint64).reshape(-1, w), size)
        out.append((place, bits))
        size *= 2
    return out


def _widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        items = [np.frombuffer(x.as_py(), np.uint64) for x in b.column("items")]
        wide = [wide_sketch(x) for x in items]
        bits = [pa.array([x.tobytes() for x in some], pa.binary()) for some in (wide, [folded(x, SENT) for x in wide])]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "n", "items")), *bits], names=["node", "n", "items", "wide", "sketch"])


def _near(s: Settings):
    """Pairs that their sizes and wide sketches do not rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = (100 - s.percent) * (b.column("n1").to_numpy() + b.column("n2").to_numpy())
            far = np.array([least_distance(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(b.column("one"), b.column("two"))], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(far * (100 + s.percent) <= total))
    return run


def _signed(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in b.column("items")]
            for x in range(0, len(sets), 200):
                some = [signatures(i, s) for i in sets[x:x + 200]]
                n = np.array([len(g) for g in some])
                yield pa.RecordBatch.from_arrays([as_long(np.concatenate(some)), b.column("node").slice(x, len(some)).take(pa.array(np.repeat(np.arange(len(some)), n)))], names=["sig", "node"])
    return run


def _shared_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of signature groups with several nodes, and the least of each. A group is named by its members, so that
    groups of the same members, which near copies have by the hundred, become one; two that share a name by chance would
    only be compared as one. Rows are sorted by signature."""
    for t, edge in _sorted_groups(batches, "sig"):
        node, size = t.column("node").to_numpy(), np.diff(edge)
        low = np.minimum.reduceat(node, edge[:-1])
        name = np.add.reduceat(mix(node.view(np.uint64)), edge[:-1])
        several = np.flatnonzero(low != np.maximum.reduceat(node, edge[:-1]))
        once = np.zeros(len(size), bool)
        once[several[np.unique(name[several], return_index=True)[1]]] = True
        if once.any():
            rows = np.repeat(once, size)
            yield pa.RecordBatch.from_arrays([as_long(np.repeat(name, size)[rows]), pa.array(node[rows]), pa.array(np.repeat(low, size)[rows])], names=["sig", "node", "lead"])


def _several(column: str, least: str):
    """The rows of signature groups with more than one value of `column`, and the least one of the group as `least`.
    Rows are sorted by signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edge in _sorted_groups(batches, "sig"):
            x = t.column(column).to_numpy()
            low = np.minimum.reduceat(x, edge[:-1])
            size = np.diff(edge)
            keep = np.repeat(low != np.maximum.reduceat(x, edge[:-1]), size)
            if keep.any():
                at = pa.array(np.flatnonzero(keep))
                yield pa.RecordBatch.from_arrays([*(t.column(c).take(at).combine_chunks() for c in t.column_names), pa.array(np.repeat(low, size)[keep])], names=[*t.column_names, least])
    return run


def _across(s: Settings, small: int, most: int):
    """Pairs of a signature group that lie in different components and whose sizes and sketches allow a link.

    Of groups with more than `small` members only the `most` nearest partners of a member in a component are sent; a
    row with `cut` says that there are more. `most` = 0 sends all pairs of these groups and none of the others, which
    have been compared whole before.
    """
    def allowed(t, i, j):
        """Whether a link is possible, and a lower bound of the distance: by each size that both sketches have, for the
        pairs that the smaller sizes leave."""
        n, far = t[2], np.zeros(len(i), np.int64)
        ok = np.minimum(n[i], n[j]) * 100 >= s.percent * np.maximum(n[i], n[j])
        for place, bits in t[3]:
            at = np.flatnonzero(ok & (place[i] >= 0) & (place[j] >= 0))
            if not len(at):
                continue
            x, y = i[at], j[at]
            far[at] = np.bitwise_count(bits[place[x]] ^ bits[place[y]]).sum(1, dtype=np.int64)
            ok[at] = far[at] * (100 + s.percent) <= (100 - s.percent) * (n[x] + n[y])
        return ok, far

    def pairs(t, i, j, cut):
        node, comp = t[0], t[1]
        i, j = np.where(node[i] <= node[j], i, j), np.where(node[i] <= node[j], j, i)
        return np.stack([node[i], node[j], comp[i], comp[j], np.asarray(cut, np.int64)], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A pair shares many signatures, so a task sends it once for as many groups as fit in memory."""
        held, rows = [], 0
        for some in found(batches):
            held.append(some)
            rows += len(some)
            if rows > 2 * HELD_PAIRS:
                held = [np.unique(np.concatenate(held), axis=0)]
                rows = len(held[0])
                if rows > HELD_PAIRS:
                    yield batch(held[0])
                    held, rows = [], 0
        if held:
            yield batch(np.unique(np.concatenate(held), axis=0))

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(5)], names=["a", "b", "ca", "cb", "cut"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for table, edge in _sorted_groups(batches, "sig"):
            comp = table.column("component").to_numpy()
            mixed = np.minimum.reduceat(comp, edge[:-1]) != np.maximum.reduceat(comp, edge[:-1])
            if not mixed.any():
                continue
            size = np.diff(edge)
            rows = np.flatnonzero(np.repeat(mixed, size))
            table, size = table.take(pa.array(rows)), size[mixed]
            t = (*(table.column(c).to_numpy() for c in ("node", "component", "n")), levels(table.column("sketch").combine_chunks()))
            first = np.concatenate([[0], np.cumsum(size)])
            group = np.repeat(np.arange(len(size)), size)
            few = np.repeat(size <= small, size)
            for d in range(1, int(min(small, size.max())) if most else 0):  # members d places apart, all small groups at once
                i = np.flatnonzero(few[:-d] & (group[:-d] == group[d:]) & (t[1][:-d] != t[1][d:]))
                ok, _ = allowed(t, i, i + d)
                if ok.any():
                    yield pairs(t, i[ok], i[ok] + d, np.zeros(int(ok.sum())))
            for g in np.flatnonzero(size > small):
                x, y = int(first[g]), int(first[g + 1])
                for i in range(x, y):
                    j = np.arange(x, y) if most else np.arange(i + 1, y)
                    j = j[t[1][j] != t[1][i]]
                    ok, far = allowed(t, np.full(len(j), i), j)
                    j, far = j[ok], far[ok]
                    if not len(j):
                        continue
                    cut = np.zeros(len(j))
                    if most:
                        order = np.lexsort([far, t[1][j]])
                        j = j[order]
                        edge_j = _edges(t[1][j])
                        place = np.arange(len(j)) - np.repeat(edge_j[:-1], np.diff(edge_j))
                        keep = place < most
                        cut = np.repeat(np.diff(edge_j) > most, np.diff(edge_j))[keep]
                        j = j[keep]
                    yield pairs(t, np.full(len(j), i), j, cut)
    return run


def _linked(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("one"), b.column("two")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= s.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def verified(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs whose sets link. Wide sketches, a 64th of the sets in size, go first; sets travel only for what is left."""
    def beside(pairs, column, *more):
        one = sets.select(F.col("node").alias("a"), F.col(column).alias("one"), *[F.col(c).alias(f"{c}1") for c in more])
        two = sets.select(F.col("node").alias("b"), F.col(column).alias("two"), *[F.col(c).alias(f"{c}2") for c in more])
        return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "one", "two", *[f"{c}{i}" for c in more for i in (1, 2)])
    near = beside(pairs, "wide", "n").mapInArrow(_near(s), "a long, b long")
    return beside(near, "items").mapInArrow(_linked(s), "a long, b long")


def links(sets: DataFrame, s: Settings) -> DataFrame:
    """node, component for all nodes that link to a smaller one, directly or not.

    Every two sets that share a signature are settled: first each set is compared with the smallest member of its
    groups; then, wherever a group still spans several components, with the partners there that the sketches do not
    rule out: in large groups with the nearest ones first, and with all of them if that leaves components apart. Two
    members of one component need no comparison.

    Sets are signed once. Of the signatures those that several sets share are written, without the sets and once for groups
    of the same members; each later round reads them, keeps the groups that still span components, and only then attaches
    sizes and sketches.
    """
    shared, drop = written_for_now(sets.select("node", "items").mapInArrow(_signed(s), "sig long, node long").repartition("sig").sortWithinPartitions("sig")
                                   .mapInArrow(_shared_groups, "sig long, node long, lead long").dropDuplicates(["sig", "node"]), "jaccard-signatures")
    star = shared.where("lead <> node").groupBy(F.col("node").alias("b")).agg(F.min("lead").alias("a"))
    found = connected_components(verified(star, sets, s))
    sketches = sets.select("node", "n", "sketch")
    for most in (8, 0):
        placed = shared.select("sig", "node").join(found, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component"))
        mixed = (placed.repartition("sig").sortWithinPartitions("sig").mapInArrow(_several("component", "least"), "sig long, node long, component long, least long")
                 .drop("least").join(sketches, "node").select("sig", "node", "component", "n", "sketch"))
        cross = (mixed.repartition("sig").sortWithinPartitions("sig")
                 .mapInArrow(_across(s, 64, most), "a long, b long, ca long, cb long, cut long")
                 .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.first("ca").alias("ca"), F.first("cb").alias("cb"), F.max("cut").alias("cut")))
        cross = written(cross, "jaccard-pairs")
        more = written(verified(cross, sets, s), "jaccard-links")
        if not more.isEmpty():
            found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))
        # only pairs that were left out between components that are still apart call for the full round
        open_ = cross.where("cut > 0").select("ca", "cb").distinct()
        for c in ("ca", "cb"):
            open_ = open_.join(found.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
        if open_.where("ca <> cb").isEmpty():
            break
    drop()
    return found


def by_node(sets: DataFrame, left: DataFrame):
    """The sets that are left, as a table bucketed by node in the shared folder, which joins by node read in place, and
    what drops its name from the catalogue. One shuffle serves the join, the grouping and the buckets."""
    spark = sets.sparkSession
    path = scratch_path(spark, "llm-jaccard-left")
    name = "jaccard_" + path.rsplit("-", 1)[-1]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = left.select(F.col("node").alias("doc_id"), F.col("h1").alias("l1"), F.col("h2").alias("l2"))
    one = (sets.repartition(n, "doc_id").join(keys, "doc_id").where("h1 = l1 and h2 = l2").groupBy("doc_id", "h1", "h2")
           .agg(F.first("n").alias("n"), F.first("items").alias("items")).select(F.col("doc_id").alias("node"), "n", "items"))
    with shuffles_freed(spark):
        (one.mapInArrow(_widened, "node long, n long, items binary, wide binary, sketch binary").write.bucketBy(n, "node").sortBy("node")
         .option("path", path).format("parquet").saveAsTable(name))
    return spark.table(name), lambda: spark.sql(f"DROP TABLE IF EXISTS {name}")


def in_buckets_of(rows: DataFrame, id_col: str, nodes: DataFrame) -> DataFrame:
    """The rows whose id falls in a bucket of some node: a bounded table that spares most rows a shuffle. An exact join
    has to follow."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BUCKETS)).cast("int")
    asked = nodes.select(bucket("node").alias("_k")).distinct()
    return rows.withColumn("_k", bucket(id_col)).join(F.broadcast(asked), "_k", "left_semi").drop("_k")


def jaccard_join(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links reach) of every row.

    Equal sets are one node from the start. Sets that cannot have a partner are ruled out by two exact filters, the
    first on a fixed quarter of the shingle domain; PartEnum signatures then find the pairs, and each is compared.

    Null, empty and blank texts have an empty set and link with nothing. Rows that repeat an id are one node. A null id
    takes the component of the equal sets that have ids, and stays null without one. Extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    first = written(rows.mapInArrow(_sets(s), SETS), "jaccard-sets")
    may = written(shared_enough(first, s), "jaccard-may")
    asked = may.select(F.col("node").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    texts = in_buckets_of(rows, "_id", may).join(asked, "_id").select("_id", "_text", "_h1", "_h2")
    again, drop_again = written_for_now(texts.mapInArrow(_items(s), ITEMS), "jaccard-again")
    left = written(shared_enough(again.mapInArrow(_resettled, SETS), s), "jaccard-left-ids")
    sets, drop = by_node(in_buckets_of(again, "doc_id", left), left)
    drop_again()
    found = links(sets, s)
    drop()
    nodes = first.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("_n"), F.first("n").alias("n"))
    nodes = nodes.where("_n > 1 or node is not null").join(found, "node", "left").select("h1", "h2", "n", F.coalesce("component", "node").alias("component"))
    # joined on the size as well, so that both sides are dealt anew and a hot set can be split while it runs
    out = first.select("doc_id", "n", "h1", "h2").join(nodes, ["h1", "h2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
