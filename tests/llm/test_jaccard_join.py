"""The n-gram Jaccard join against comparing all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from bizlens.llm import graph
from bizlens.llm import jaccard_join as jj
from tests.llm.conftest import documents, rows


def brute(pairs, percent=80):
    """(n_shingles, component) per row; ids are distinct."""
    sets = []
    for _, t in pairs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    ids = [i for i, _ in pairs]
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    low = defaultdict(lambda: None)
    for a, i in enumerate(ids):
        r = find(a)
        low[r] = i if low[r] is None else min(low[r], i)
    return {i: (len(sets[a]), low[find(a)]) for a, i in enumerate(ids)}


def near_copies(seed, n=120):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(3000)]
    text = lambda k: [rnd.choice(vocab) for _ in range(k)]
    bases = [text(rnd.choice([1, 3, 4, 5, 7, 9, 20, 60, 200, 500])) for _ in range(12)]
    passage = text(60)
    out = []
    for i in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6, 9])):
            if len(w) > 1:
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
        if rnd.random() < 0.2:
            w = w[rnd.randint(0, 4):]
        if rnd.random() < 0.2:
            w = passage + text(rnd.choice([2, 5, 10, 14, 18]))
        out.append((rnd.choice([" ", "  ", "\n"]).join(w).upper() if rnd.random() < 0.1 else " ".join(w)))
    return out + [None, "", " \t\n", "A", "a", "a\x0bb", "A b"]


@pytest.mark.parametrize("seed,low_bits", [(1, 2), (2, 0), (3, 2)])
def test_against_all_pairs(spark, seed, low_bits):
    pairs = [(7 * i % 1009, t) for i, t in enumerate(near_copies(seed))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(jj.jaccard_join(documents(spark, pairs), jj.Settings(low_bits=low_bits)))}
    assert got == brute(pairs)


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(jj.jaccard_join(docs))}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_null_and_repeated_ids_and_empty_table(spark):
    got = rows(jj.jaccard_join(documents(spark, [(4, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (2, "A B C D E F"), (None, "q r s"), (None, None)])))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == sorted(
        [("4", 2, "2"), ("None", 2, "2"), ("4", 2, "2"), ("2", 2, "2"), ("None", 1, "None"), ("None", 0, "None")])
    assert jj.jaccard_join(documents(spark, []).where("false")).count() == 0


def test_part_enum_loses_no_pair():
    rng = np.random.default_rng(5)
    for _ in range(300):
        size = int(rng.integers(1, 400))
        a = rng.integers(0, 2**63, size, dtype=np.uint64)
        k = 2 * size * 20 // 180
        change = int(rng.integers(0, k // 2 + 1))
        b = np.concatenate([a[change:], rng.integers(0, 2**63, change, dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert len(np.intersect1d(jj.signatures(a, jj.Settings()), jj.signatures(b, jj.Settings())))
            far = int(np.bitwise_count(jj.sketch(a) ^ jj.sketch(b)).sum())
            assert far <= len(a) + len(b) - 2 * both


def test_large_sets_are_told_apart_in_their_group():
    rng = np.random.default_rng(6)
    far = [rng.integers(0, 2**63, 1500, dtype=np.uint64) for _ in range(3)]
    near = np.concatenate([far[0][100:], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    sets = [*far, near, far[0][:1400]]  # 0 links with 3 and 4
    bits = [jj.folded(jj.wide_sketch(x), jj.SENT).tobytes() for x in sets]
    n = len(sets)
    group = pa.RecordBatch.from_arrays([pa.array([7] * n), pa.array(range(n)), pa.array(range(n)), pa.array([len(x) for x in sets]), pa.array(bits, pa.binary())],
                                       names=["sig", "node", "component", "n", "sketch"])
    pairs = lambda small, most: {(a, b) for p in jj._across(jj.Settings(), small, most)([group]) for a, b in zip(p.column("a").to_pylist(), p.column("b").to_pylist())}
    assert pairs(64, 8) == {(0, 3), (0, 4), (3, 4)}
    assert pairs(2, 0) == {(0, 3), (0, 4), (3, 4)}
    assert pairs(64, 0) == set()  # compared whole in the first round
    again = [group.set_column(0, "sig", pa.array([s] * n)) for s in range(50)]
    assert sum(p.num_rows for p in jj._across(jj.Settings(), 2, 8)(again)) == 3


def test_groups_of_the_same_members_are_one():
    groups = [(1, [5, 9]), (2, [5, 9]), (3, [5, 8, 9]), (4, [6]), (8, [9, 5]), (9, [8, 9])]
    rows_ = [(s, x) for s, nodes in groups for x in nodes]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows_[i:i + 4])], names=["sig", "node"]) for i in range(0, len(rows_), 4)]
    got = pa.Table.from_batches(jj._shared_groups(iter(batches))).to_pylist()
    members = defaultdict(set)
    for r in got:
        members[r["sig"]].add((r["node"], r["lead"]))
    assert sorted(map(sorted, members.values())) == [[(5, 5), (8, 5), (9, 5)], [(5, 5), (9, 5)], [(8, 8), (9, 8)]]


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(50)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in rows(graph.connected_components(spark.createDataFrame(edges, "a long, b long")))}
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    assert got == {x: find(x) for x in list(up) if find(x) != x}
