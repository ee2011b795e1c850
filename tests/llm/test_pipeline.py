"""The stages of the corpus pipeline on odd rows: every unique text stays once, whatever the ids are."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from bizlens.llm import mixing, toxicity
from tests.llm.conftest import rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, _row string, component_id long"


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "web", 0, 1, "clash", 2) for i, t in pairs], DOCS).repartition(3)


def pairs_of(df):
    assert df.columns == list(cp.COLUMNS)
    return sorted(((r["doc_id"], r["text"]) for r in rows(df)), key=str)


def plain(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_stage_keeps_every_text_once(spark, sf):
    pairs = [(5, "a b"), (5, "ab"), (5, "qrstuv"), (3, "q r s t u v"), (7, "only here"), (7, "q r s t u v"), (9, "same"), (9, "same"), (9, "sa me"), (None, "same"), (None, "none"), (None, "none"),
             (11, None), (12, ""), (13, " "), (14, "long " * 40_000), (15, "long " * 40_000)]
    got = pairs_of(cp.drop_exact_copies(spark, docs_of(spark, pairs), sf))
    assert got == sorted([(5, "a b"), (3, "q r s t u v"), (7, "only here"), (9, "sa me"), (None, "none"), (13, " "), (14, "long " * 40_000)], key=str)


def test_exact_stage_against_brute_force(spark, sf):
    rng = random.Random(4)
    pairs = [(rng.choice([None, *range(30)]), " ".join(rng.choices("abc", k=rng.randint(1, 3))) + rng.choice(["", " ", "\n"])) for _ in range(300)]
    got = pairs_of(cp.drop_exact_copies(spark, docs_of(spark, pairs), sf))
    best = {}
    for i, t in pairs:
        key = (-len(t), i is None, i or 0)
        best[plain(t)] = min(best.get(plain(t), key), key)
    assert sorted(plain(t) for _, t in got) == sorted(best)
    assert all(best[plain(t)] == (-len(t), i is None, i or 0) for i, t in got)


def test_jaccard_stage_keeps_one_of_each_group(spark, sf):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base = [[word() for _ in range(120)] for _ in range(6)]
    near = lambda k: " ".join([*base[k][:-1], word()])
    pairs = [(5, near(0)), (5, near(1)), (4, near(0)), (4, near(2)), (None, near(1)), (None, near(3)), (9, near(2)), (8, near(4)), (8, near(4)), (8, near(5)), (3, None), (2, "two words"), (2, "other words")]
    got = pairs_of(cp.drop_near_copies(spark, docs_of(spark, pairs), sf))
    group = lambda t: next((k for k in range(6) if t and t.startswith(" ".join(base[k][:100]))), t)
    assert sorted(((i, group(t)) for i, t in got), key=str) == sorted([(4, 0), (5, 1), (4, 2), (None, 3), (8, 4), (8, 5), (3, None), (2, "two words"), (2, "other words")], key=str)


def test_toxicity_stage_on_clashing_names(spark):
    df = docs_of(spark, [(1, "kind words"), (1, "vile words"), (None, None)]).withColumn("_text_read", F.lit(3))
    s = toxicity.Settings()
    data = np.frombuffer(b"vile", np.uint8)
    weights = np.zeros((1 << s.bits) + 1, np.float32)
    weights[toxicity.features(data, np.array([0, 4]), s.bits)[0]] = 9
    kept = toxicity.keep_clean(df, weights, s)
    assert kept.columns == df.columns and sorted((r["doc_id"], r["text"]) for r in rows(kept) if r["doc_id"]) == [(1, "kind words")]


@pytest.mark.parametrize("plan_rows", [0, mixing.PLAN_ROWS])
def test_mixing_plan_is_the_small_side(spark, monkeypatch, plan_rows):
    monkeypatch.setattr(mixing, "PLAN_ROWS", plan_rows)
    df = spark.range(4000).selectExpr("id as doc_id", "'w w w' as text", "if(id % 3 = 0, 'small', if(id % 50 = 1, null, 'big')) as source", "'x' as _times")
    out = mixing.mix_sources(df, max_passes=2.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("BuildRight" in plan and "BuildLeft" not in plan) if plan_rows else "SortMergeJoin" in plan
    n = {r["source"]: r["n"] for r in rows(out.groupBy("source").agg(F.count("*").alias("n")))}
    ids = {r["source"]: r["n"] for r in rows(df.groupBy("source").agg(F.count("*").alias("n")))}
    assert n["big"] == ids["big"] and ids["small"] < n["small"] <= 2 * ids["small"] and n[None] <= 2.1 * ids[None]
    assert out.select("doc_id").distinct().count() == 4000


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES])
def test_stages_of_nothing(spark, sf, stage):
    assert stage(spark, docs_of(spark, [(1, "x")]).where("false"), sf).count() == 0


def test_nodes_follow_ids_and_tell_rows_apart(spark):
    def nodes(pairs):
        df = cp.with_row(docs_of(spark, pairs))
        return df.select("doc_id", "text", cp.node_of(df).alias("node"), "_row").collect()

    few = nodes([(7, "a"), (7, "b"), (2, "c"), (None, "d"), (10**12, "e")])
    assert len({r.node for r in few}) == 5
    assert [r.doc_id for r in sorted(few, key=lambda r: r.node)] == [2, 7, 7, 10**12, None]
    wide = nodes([(-(2**62), "a"), (2**62, "b"), (5, "c"), (5, "d")])  # ids that leave no room
    assert len({r.node for r in wide}) == 4 and all(r.node == r._row for r in wide)
