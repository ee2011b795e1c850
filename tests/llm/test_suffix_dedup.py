"""Suffix dedup against brute force over all strings."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from bizlens.llm import suffix_dedup as sd
from tests.llm.conftest import documents, rows


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, np.int64)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i] += 1
                gone[i + length if i + length < len(gone) else -1] -= 1
        covered = np.cumsum(gone[:-1]) > 0 if len(r) else np.zeros(0, bool)
        kept = bytes(b for b, g in zip(r, covered) if not g)
        spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum()) if len(r) else 0
        out.append((len(r), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts_with_repeats(seed, n=60, passage=500):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(2, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    base = [text(rnd.randint(1, 300)) for _ in range(n)]
    shared = [text(passage // 6) for _ in range(3)]
    out = []
    for t in base:
        kind = rnd.randint(0, 6)
        if kind == 0:
            t = t + rnd.choice(shared) + text(20)
        elif kind == 1:
            t = rnd.choice(base)
        elif kind == 2:
            o = rnd.choice(base)
            cut = rnd.randint(0, len(o))
            t = o[:cut] + "#" + o[cut:]
        elif kind == 3:
            s = rnd.choice(shared)
            t = text(5) + s[rnd.randint(0, 50):len(s) - rnd.randint(0, 50)]
        elif kind == 4:
            t = (text(3) + "xy") * rnd.randint(1, 60)
        out.append(t)
    return out + [None, "", " ", "a" * 900, "a" * 399, "é" * 200, "é" * 201]


@pytest.mark.parametrize("seed,bucket,shallow", [(1, 20_000, 96), (2, 2, 64), (3, 3, 200)])
def test_against_brute_force(spark, seed, bucket, shallow):
    texts = texts_with_repeats(seed)
    got = {r["doc_id"]: r for r in rows(sd.suffix_dedup(documents(spark, texts), sd.Settings(bucket=bucket, shallow=shallow)))}
    for i, want in enumerate(brute(texts, 400)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, i


def test_segments_and_repeated_ids(spark):
    texts = texts_with_repeats(5, 20)
    texts = [(i % 7 if i % 3 else None, t) for i, t in enumerate(texts)]
    got = rows(sd.suffix_dedup(documents(spark, texts), sd.Settings(segment=700)))
    want = sorted((str(i), *w) for (i, _), w in zip(texts, brute([t for _, t in texts], 400)))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_empty_table(spark):
    assert sd.suffix_dedup(documents(spark, []).where("false")).count() == 0


def test_deep_shallow_sorts():
    rnd = random.Random(3)
    for _ in range(50):
        strings = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 40))).encode() * rnd.randint(1, 3) for _ in range(60)]
        order, shared = sd.deep_shallow(strings, 0, rnd.choice([0, 8, 16, 64]))
        assert [strings[i] for i in order] == sorted(strings)
        for k in range(1, len(order)):
            a, b = strings[order[k - 1]], strings[order[k]]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert shared[k] == n


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r for r in rows(sd.suffix_dedup(docs))}
    for (i, _), want in zip(data, brute([t for _, t in data], 400)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, i


def test_repeated_rows_get_each_span_once(spark, monkeypatch):
    rnd = random.Random(7)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(3000))

    def cut(s):  # n_spans: spans handed to the row, before they are merged
        def run(batches):
            for b in batches:
                n = pa.array([len(x or ()) for x in b.column("_spans").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("_id"), n, n, n, pa.array([""] * len(n)), pa.array([[]] * len(n), pa.list_(pa.list_(pa.int64())))],
                                                 names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
        return run

    def most(n):
        return max(r["n_spans"] for r in rows(sd.suffix_dedup(documents(spark, [(None, text)] * n))))

    monkeypatch.setattr(sd, "_cut", cut)
    assert most(12) == most(2) > 0


def test_tasks_hold_a_part_of_a_batch(monkeypatch):
    monkeypatch.setattr(sd, "PART", 1 << 18, raising=False)
    rnd = random.Random(8)
    texts = [rnd.randbytes(4000).hex() if i % 5 else None for i in range(1500)] + ["", rnd.randbytes(250_000).hex()]
    n = len(texts)
    size = sum(len((t or "").encode()) for t in texts)
    text = pa.array([t or "" for t in texts])
    spans = pa.array([[{"from": 3, "to": 500}] if t and len(t) > 600 else None for t in texts])
    picks = pa.array([[{"bucket": 1, "c1": i, "c2": i, "pos": 300, "back": 300, "starts": 9}] for i in range(n)])
    ids = pa.array(range(n), pa.int64())
    jobs = {sd._anchor_rows: {"_row": ids, "_key": ids, "_text": text}, sd._contexts: {"_text": text, "_picks": picks}, sd._cut: {"_id": ids, "_text": text, "_spans": spans}}
    for job, cols in jobs.items():
        b = pa.RecordBatch.from_pydict(cols)
        list(job(sd.Settings())(iter([b.slice(0, 3)])))  # what is made once does not count
        tracemalloc.start()
        made = sum(x.num_rows for x in job(sd.Settings(segment=1 << 14))(iter([b])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert made >= n - 1 and most < size / 2, (job.__name__, made, most, size)
