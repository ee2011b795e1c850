"""Product mentions and positions by range, against plain Python and on lopsided inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from bizlens.functions.text import PLAIN_WORDS
from bizlens.operators import mentions as mt
from bizlens.operators import ranges
from bizlens.operators.ranges import range_rank


def plain(text, products):
    """The product with most name words inside the text, then the first."""
    best = None
    for pos, name in products:
        words = [w for w in re.findall("[a-z0-9]+", name.lower()) if len(w) > 2 and w not in PLAIN_WORDS]
        hits = sum(w in (text or "").lower() for w in words)
        if hits:
            best = max(best or (0, 0, ""), (hits, -pos, name))
    return best and best[2]


def frames(spark, products, messages):
    return (spark.createDataFrame([(b, i, t) for b, i, t in messages], "business_id long, msg_no long, text string").repartition(4),
            spark.createDataFrame([(b, n, p) for b, p, n in products], "business_id long, name string, first_key long").repartition(3))


def test_mentions_against_every_product(spark):
    rng = random.Random(7)
    words = ["red", "blue", "mug", "mugs", "candle", "the", "tee", "box", "old", "gold", "marigold", "xl", "käse", "10", "100", "soy", "wax"]
    products = [(b, p, " ".join(rng.choices(words, k=rng.randint(1, 5)))) for b in (1, 2) for p in range(60)]
    products += [(1, 900, "Red red RED mug"), (1, 901, "red red gold"), (2, 902, ""), (2, 903, "the tee")]
    texts = [" ".join(rng.choices(words + ["love", "this", "Marigolds", "REDmug"], k=rng.randint(0, 9))) for _ in range(150)] + [None, "", "re", "RED", "is the red red gold in stock?", "x" * 20_000 + "candle"]
    messages = [(rng.choice([1, 2, 3]), i, rng.choice(texts)) for i in range(400)]
    got = {(r.business_id, r.msg_no): r["product"] for r in mt.mentions(*frames(spark, products, messages)).collect()}
    want = {(b, i): plain(t, [(p, n) for c, p, n in products if c == b]) for b, i, t in messages}
    assert got == {k: v for k, v in want.items() if v} and len(got) > 200


def test_mentions_in_a_catalogue_of_100_000(spark):
    """One business, every name with a word that all names share, and a third of all messages the same."""
    products = spark.range(100_000).selectExpr("1L as business_id", "concat('shirt ', lpad(conv(id, 10, 36), 4, '0'), ' ', lpad(conv(id * 7919 % 100000, 10, 36), 4, '0')) as name", "id as first_key")
    messages = spark.range(3000).selectExpr("1L as business_id", "id as msg_no", "if(id % 3 = 0, 'any shirt 000A 14LN left?', concat('SHIRT ', lpad(conv(id * 31, 10, 36), 4, '0'))) as text")
    got = {r.msg_no: r["product"] for r in mt.mentions(messages, products).collect()}
    names = [r.name for r in products.orderBy("first_key").select("name").collect()]
    assert len(got) == 3000
    assert got[0] == plain("any shirt 000A 14LN left?", list(enumerate(names)))
    assert got[1000] == plain(messages.where("msg_no = 1000").first().text, list(enumerate(names)))


@pytest.mark.parametrize("part", [[], ["g"]])
def test_range_rank_of_one_value(spark, part):
    """All rows agree in everything but the last order column: still several ranges, and exact positions."""
    df = spark.range(30_000).selectExpr("if(id % 10 < 9, 'hot', null) as g", "5 as v", "id as k").repartition(4)
    ranked = range_rank(df, part, [F.col("v").desc(), F.col("k")])
    rows = ranked.collect()
    assert ranked.columns == ["g", "v", "k", "rank"] and len(rows) == 30_000
    groups = {}
    for r in rows:
        groups.setdefault(r.g if part else 0, []).append((r.k, r["rank"]))
    for found in groups.values():
        assert [x for _, x in sorted(found)] == list(range(1, len(found) + 1))


def test_range_rank_uses_several_tasks(spark, monkeypatch):
    df = spark.range(200_000).selectExpr("1 as g", "id as k")
    written = []
    real = ranges.materialise
    monkeypatch.setattr(ranges, "materialise", lambda d, name: written.append(real(d, name)) or written[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # 200,000 narrow rows would be one task else
    try:
        range_rank(df, ["g"], [F.col("k")]).count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in written[-1].groupBy(F.shiftright("_at", 33)).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 120_000


def test_range_rank_of_nothing(spark):
    assert range_rank(spark.range(0).selectExpr("1 as g", "id as k"), ["g"], [F.col("k")]).count() == 0
