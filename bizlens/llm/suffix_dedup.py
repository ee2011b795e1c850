"""Removal of long repeated substrings, by sorting suffixes deep-shallow around content-chosen anchors.

Every `length`-byte string contains an anchor: the position of its smallest k-gram hash. Equal strings have it at the
same place, so each occurrence is found among the suffixes of one bucket (those that start with the same k-gram), and
only one suffix in some `length - k` needs sorting. Around its anchor each occurrence keeps all bytes that a string
with this anchor can reach; the right contexts and the mirrored left contexts are sorted, and the two orders together
give the longest repeats on either side of every anchor.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import text_or_empty, written
from bizlens.llm.textops import as_long, buffers, mix, row_slices

PART = 4 << 20  # bytes of text a task turns into Python objects at a time


@dataclass(frozen=True)
class Settings:
    """`length`: bytes of a string that may not repeat. `gram`: bytes of an anchor. `shallow`: depth at which multikey
    quicksort hands over to blind tries. `bucket`: distinct contexts in a bucket beyond which it is split."""
    length: int = 400
    gram: int = 64
    shallow: int = 96
    bucket: int = 20_000
    segment: int = 1 << 19


# ---- sorting


def lcp(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the longest common prefix, given that `start` bytes agree."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    step = 64
    while a[start:start + step] == b[start:start + step]:
        start += step
        step *= 2
    n = min(start + step, n)
    x = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n - (x.bit_length() + 7) // 8


class _Node:
    __slots__ = ("depth", "kids", "leaf")

    def __init__(self, depth: int, kids: dict | None = None, leaf: list | None = None):
        self.depth, self.kids, self.leaf = depth, kids, leaf


def blind_trie(strings: list[bytes], ids: list[int], depth: int) -> tuple[list[int], list[int]]:
    """Order of strings that agree on `depth` bytes, and the common prefix of each with the one before it.

    The trie holds branching depths and bytes only: a new string goes down blindly to some leaf, one comparison with it
    gives the true depth, and the string branches off there.
    """
    root = None
    for i in ids:
        s = strings[i]
        if root is None:
            root = _Node(len(s), None, [i])
            continue
        node = root
        while node.leaf is None:
            c = s[node.depth] if node.depth < len(s) else -1
            node = node.kids.get(c) or next(iter(node.kids.values()))
        other = strings[node.leaf[0]]
        d = lcp(s, other, depth)
        if d == len(s) == len(other):
            node.leaf.append(i)
            continue
        parent, node = None, root
        while node.leaf is None and node.depth < d:
            parent, node = node, node.kids[s[node.depth] if node.depth < len(s) else -1]
        c = s[d] if d < len(s) else -1
        if node.leaf is None and node.depth == d:
            node.kids[c] = _Node(len(s), None, [i])
            continue
        o = other[d] if d < len(other) else -1
        fork = _Node(d, {o: node, c: _Node(len(s), None, [i])})
        if parent is None:
            root = fork
        else:
            parent.kids[s[parent.depth] if parent.depth < len(s) else -1] = fork
    order: list[int] = []
    shared: list[int] = []
    stack: list[tuple[_Node, int]] = [(root, depth)] if root else []
    while stack:
        node, before = stack.pop()
        if node.leaf is not None:
            for k, i in enumerate(node.leaf):
                order.append(i)
                shared.append(before if k == 0 else len(strings[i]))
            continue
        kids = [node.kids[c] for c in sorted(node.kids)]
        for k in range(len(kids) - 1, 0, -1):
            stack.append((kids[k], node.depth))
        stack.append((kids[0], before))
    return order, shared


def deep_shallow(strings: list[bytes], agreed: int, shallow: int) -> tuple[list[int], list[int]]:
    """Suffix order of `strings`, all of which agree on `agreed` bytes, and the common prefix of neighbours.

    Ternary quicksort on eight bytes at a time down to `shallow`; what still agrees there goes to a blind trie.
    """
    order: list[int] = []
    shared: list[int] = []
    stack = [(list(range(len(strings))), agreed)]
    while stack:
        ids, depth = stack.pop()
        if len(ids) > 1 and depth < shallow:
            keys = [strings[i][depth:depth + 8] for i in ids]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            less = [i for i, k in zip(ids, keys) if k < pivot]
            same = [i for i, k in zip(ids, keys) if k == pivot]
            more = [i for i, k in zip(ids, keys) if k > pivot]
            if more:
                stack.append((more, depth))
            if len(pivot) < 8:  # strings that end here are equal
                if less:
                    stack.append((less, depth))
                    stack.insert(-1, (same, shallow))
                else:
                    stack.append((same, shallow))
            else:
                stack.append((same, depth + 8))
                if less:
                    stack.append((less, depth))
            continue
        part, common = blind_trie(strings, ids, min(depth, min(len(strings[i]) for i in ids))) if len(ids) > 1 else (ids, [0])
        if part:
            common[0] = lcp(strings[order[-1]], strings[part[0]], agreed) if order else 0
            order += part
            shared += common
    return order, shared


def repeats(left: list[bytes], right: list[bytes], agreed: int, s: Settings) -> list[list[tuple[int, int]]]:
    """For contexts that meet at an anchor (`left` mirrored, `right` from the anchor on): per context the (back, ahead)
    extents of its repeats of `s.length` bytes or more in other contexts; any other such repeat lies within these.

    Contexts are joined in the order of falling common right parts. When two groups join, every member of the smaller
    one meets its neighbours in the left order of the larger: a partner with a longer common left part and no shorter
    right part does not exist.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in left]
    order_r, shared_r = deep_shallow(right, agreed, s.shallow)
    order_l, _ = deep_shallow(left, 0, s.shallow)
    rank = [0] * len(left)
    for k, i in enumerate(order_l):
        rank[i] = k
    group = list(range(len(left)))
    members: dict[int, list[int]] = {i: [rank[i]] for i in range(len(left))}

    def find(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for k in sorted(range(1, len(order_r)), key=lambda k: -shared_r[k]):
        ahead = shared_r[k]
        a, b = find(order_r[k - 1]), find(order_r[k])
        if len(members[a]) < len(members[b]):
            a, b = b, a
        big, small = members[a], members.pop(b)
        for r in small:
            at = bisect_left(big, r)
            i = order_l[r]
            for n in big[max(at - 1, 0):at + 1]:
                j = order_l[n]
                back = lcp(left[i], left[j])
                if back + ahead >= s.length:
                    out[i].append((back, ahead))
                    out[j].append((back, ahead))
        for r in small:
            insort(big, r)
        group[b] = a
    return out


# ---- anchors


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes from each position on (`gram` a power of two)."""
    h = data.astype(np.uint64) + np.uint64(1)
    base, width = 0x9E3779B97F4A7C15, 1
    while width < gram:
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base % 2**64, width * 2
    return mix(h)


def anchors(data: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all `length`-byte strings of `data`: position, first and last start of the strings it stands for."""
    span = s.length - s.gram + 1
    h = gram_hashes(data, s.gram)
    bits = np.uint64(20)
    v = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)  # equal hashes: the leftmost wins
    width = 1
    while width * 2 <= span:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    if width < span:
        v = np.minimum(v[:len(v) - (span - width)], v[span - width:])
    at = (v & np.uint64((1 << 20) - 1)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return at[first], first, np.append(first[1:], len(at)) - 1


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about `PART` bytes of text, so that what a task holds beside a batch does not grow with the batch."""
    for b in batches:
        for i, j in row_slices(buffers(b.column("_text"))[1], PART):
            yield b.slice(i, j - i)


ANCHORS = "row long, id long, pos long, back int, starts int, bucket long, c1 long, c2 long"


def _anchor_rows(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            data, off = buffers(b.column("_text"))
            raw = data.tobytes()
            rows, ids = b.column("_row").to_numpy(), b.column("_key").to_numpy()
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            digest = bytearray()
            held = 0

            def out():
                row, key, pos, back, starts, bucket = (np.concatenate(c) for c in cols)
                c = np.frombuffer(bytes(digest), np.int64).reshape(-1, 2)
                return pa.RecordBatch.from_arrays([pa.array(row), pa.array(key), pa.array(pos), pa.array(back.astype(np.int32)), pa.array(starts.astype(np.int32)), as_long(bucket),
                                                   pa.array(np.ascontiguousarray(c[:, 0])), pa.array(np.ascontiguousarray(c[:, 1]))],
                                                  names=["row", "id", "pos", "back", "starts", "bucket", "c1", "c2"])

            for k in range(len(rows)):
                lo, hi = int(off[k]), int(off[k + 1])
                for x in range(lo, hi - s.length + 1, s.segment):
                    y = min(x + s.segment + s.length - 1, hi)
                    d = data[x:y]
                    at, first, last = anchors(d, s)
                    key = gram_hashes_at(d, at, s)
                    for a, f, z in zip(at.tolist(), first.tolist(), last.tolist()):
                        digest += xxhash.xxh3_128_digest(raw[x + f:x + z + s.length], seed=a - f)
                    for c, v in zip(cols, (np.full(len(at), rows[k]), np.full(len(at), ids[k]), x - lo + at, at - first, last - first + 1, key)):
                        c.append(v)
                    held += len(at)
                    if held > 50_000:
                        yield out()
                        cols, held = [[] for _ in range(6)], 0
                        digest = bytearray()
            if held:
                yield out()
    return run


def gram_hashes_at(data: np.ndarray, at: np.ndarray, s: Settings) -> np.ndarray:
    """Bucket keys of some positions."""
    windows = np.lib.stride_tricks.sliding_window_view(data, s.gram)[at].astype(np.uint64) + np.uint64(1)
    powers = np.uint64(0xD6E8FEB86659FD93) ** np.arange(s.gram, dtype=np.uint64)
    return mix((windows * powers).sum(1, dtype=np.uint64))


# ---- contexts of buckets with more than one of them


def _contexts(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            cols: list[list] = [[] for _ in range(6)]
            size = 0
            for text, picks in zip(b.column("_text").to_pylist(), b.column("_picks").to_pylist()):
                raw = text.encode()
                for p in picks:
                    f = p["pos"] - p["back"]
                    x = raw[f:f + p["starts"] - 1 + s.length]
                    for c, v in zip(cols, (p["bucket"], p["c1"], p["c2"], p["back"], p["starts"], x)):
                        c.append(v)
                    size += len(x)
                if size > 8 << 20:
                    yield _context_batch(cols)
                    cols, size = [[] for _ in range(6)], 0
            if cols[0]:
                yield _context_batch(cols)
    return run


CONTEXTS = "bucket long, c1 long, c2 long, back int, starts int, bytes binary"


def _context_batch(cols: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in CONTEXTS.split(", ")])


def _halve(width: int, s: Settings):
    """Split contexts by how far their strings reach back from the anchor: (0 to width / 2, the rest of width).

    All strings of such a part share more bytes than those of the whole, and these make the new bucket key, so
    contexts that agree around the anchor only are told apart.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = width // 2
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for bucket, c1, c2, back, starts, raw in zip(*[b.column(x.split()[0]).to_pylist() for x in CONTEXTS.split(", ")]):
                last = back - starts + 1  # from the last start to the anchor
                base = back // width * width
                for x, y in ((base, base + half - 1), (base + half, base + width - 1)):
                    far, near = min(back, y), max(last, x)
                    if far < near:
                        continue
                    core = raw[back - x:max(back - y + s.length, 0)]
                    key = xxhash.xxh3_64_intdigest(core, seed=(bucket ^ (x * 0x9E3779B1)) & (2**63 - 1)) - 2**63
                    for c, v in zip(cols, (key, c1, c2, far, far - near + 1, raw[back - far:back - near + s.length])):
                        c.append(v)
            if cols[0]:
                yield _context_batch(cols)
    return run


def _sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    names = [x.split()[0] for x in CONTEXTS.split(", ")]
    held: list[tuple] = []
    for b in batches:
        for r in zip(*[b.column(x).to_pylist() for x in names]):
            if held and held[0][0] != r[0]:
                yield held
                held = []
            if not held or held[-1][:3] != r[:3]:  # rows that repeat a text bring its contexts again
                held.append(r)
    if held:
        yield held


def _covered(s: Settings):
    """(c1, c2, back, ahead) of all repeats that distinct contexts of a bucket have in common."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in range(4)]
        for rows in _sorted_buckets(batches):
            if len(rows) < 2:
                continue
            left = [r[5][:r[3]][::-1] for r in rows]
            right = [r[5][r[3]:] for r in rows]
            agreed = s.gram if len({x[:s.gram] for x in right}) == 1 else 0  # 0: two k-grams of one hash
            for r, found in zip(rows, repeats(left, right, agreed, s)):
                for back, ahead in _widest(found):
                    for c, v in zip(cols, (r[1], r[2], back, ahead)):
                        c.append(v)
            if len(cols[0]) > 20_000:
                yield _covered_batch(cols)
                cols = [[] for _ in range(4)]
        if cols[0]:
            yield _covered_batch(cols)
    return run


def _covered_batch(cols: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["c1", "c2", "back", "ahead"])


def _widest(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The extents as one: all hold the anchor, so they overlap."""
    return [(max(b for b, _ in found), max(a for _, a in found))] if found else []


# ---- the job


def _cut(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            cols: list[list] = [[] for _ in range(5)]
            for text, spans in zip(b.column("_text").to_pylist(), b.column("_spans").to_pylist()):
                raw = text.encode()
                merged: list[list[int]] = []
                for x, y in sorted((v["from"], v["to"]) for v in spans or ()):
                    if merged and x <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], y)
                    else:
                        merged.append([x, y])
                kept = hashlib.sha256()
                at = 0
                for x, y in merged:
                    kept.update(raw[at:x])
                    at = y
                kept.update(raw[at:])
                for c, v in zip(cols, (len(raw), sum(y - x for x, y in merged), len(merged), kept.hexdigest(), merged)):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
    return run


def split_large(contexts: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Contexts in buckets of at most `s.bucket` where they differ, and the (c1, c2, back, ahead) settled meanwhile.

    Only large buckets are halved. Parts that are equal need no sorting: all their strings repeat, one of them goes on
    as a partner for the others. In the end a part stands for one string, whose key is the string itself.
    """
    settled = contexts.select("c1", "c2", "back", F.lit(0).alias("ahead")).limit(0)
    width = 1 << (s.length - s.gram).bit_length()
    while width > 1:
        hot = written(contexts.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > s.bucket).select("bucket"), "suffix-hot")
        if hot.isEmpty():
            break
        halves = written(contexts.join(hot, "bucket", "left_semi").mapInArrow(_halve(width, s), CONTEXTS).withColumn("_same", F.sha2("bytes", 256)), "suffix-halves")
        part = ["bucket", "back", "starts", "_same"]
        equal = halves.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("c1", "c2")).alias("_one"))
        joined = halves.join(equal, part)
        settled = settled.unionByName(joined.where("_n > 1").select("c1", "c2", "back", (F.col("starts") - 1 - F.col("back") + s.length).alias("ahead")))
        names = contexts.columns
        contexts = contexts.join(hot, "bucket", "left_anti").select(*names).unionByName(joined.where("c1 = _one.c1 and c2 = _one.c2").select(*names))
        width //= 2
    return contexts, settled


def suffix_dedup(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans ([from, to) byte offsets removed) of every row.

    A byte goes if a `length`-byte string over it also starts anywhere else, in the same text or another. One scan
    writes the anchors. An anchor whose whole context occurs twice needs no sorting; equal contexts count as one, so a
    text with a million copies is sorted once. Buckets with several distinct contexts fetch their bytes, are sorted
    deep-shallow, and the repeats found go back to all anchors with that context.

    Null and empty texts lose nothing. Texts shorter than `length` bytes have no string that counts. Rows that repeat
    an id, or have none, are texts of their own and repeat each other. Extra columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(-1)).alias("_key"), text_or_empty(text_col).alias("_text"))
    texts = texts.withColumn("_row", F.xxhash64("_text"))
    same = texts.where(F.octet_length("_text") >= s.length).select("_row", "_key", "_text")
    marks = written(same.mapInArrow(_anchor_rows(s), ANCHORS), "suffix-anchors")
    classes = written(marks.groupBy("bucket", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "id", "pos", "back", "starts")).alias("at")), "suffix-classes")
    several = classes.groupBy("bucket").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("bucket")
    picks = (classes.join(several, "bucket", "left_semi").groupBy(F.col("at.row").alias("_row"), F.col("at.id").alias("_key"))
             .agg(F.collect_list(F.struct("bucket", "c1", "c2", "at.pos", "at.back", "at.starts")).alias("_picks")))
    contexts, settled = split_large(written(same.join(picks, ["_row", "_key"]).select("_text", "_picks").mapInArrow(_contexts(s), CONTEXTS), "suffix-contexts"), s)
    found = contexts.repartition("bucket").sortWithinPartitions("bucket", "c1", "c2").mapInArrow(_covered(s), "c1 long, c2 long, back int, ahead int")
    found = found.unionByName(settled).groupBy("c1", "c2").agg(F.max("back").alias("back"), F.max("ahead").alias("ahead"))
    whole = F.col("n") > 1
    known = (classes.join(found, ["c1", "c2"], "left").where(whole | F.col("back").isNotNull())
             .select("c1", "c2", "bucket", F.when(whole, F.col("at.back")).otherwise(F.col("back")).alias("_back"),
                     F.when(whole, F.col("at.starts") - 1 - F.col("at.back") + s.length).otherwise(F.col("ahead")).alias("_ahead")))
    # a set: n rows of one text and id (or none) have the same spans, and each of them would get all n times
    spans = (marks.join(known, ["c1", "c2", "bucket"]).groupBy(F.col("row").alias("_row"), F.col("id").alias("_key"))
             .agg(F.collect_set(F.struct((F.col("pos") - F.col("_back")).alias("from"), (F.col("pos") + F.col("_ahead")).alias("to"))).alias("_spans")))
    return texts.join(spans, ["_row", "_key"], "left").select("_id", "_text", "_spans").mapInArrow(
        _cut(s), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<bigint>>")
