"""Cell reading, rounding, quantiles and ranks against plain Python."""

import random
import statistics
from datetime import datetime
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bizlens.functions import clean as cl
from bizlens.functions import text as tx
from bizlens.functions.numbers import half_even
from bizlens.operators import imports as im
from bizlens.operators.ranges import range_rank
from bizlens.operators.skew import attach_by_key, exact_quantiles, two_level_cumsum


def test_half_even_is_correctly_rounded(spark):
    rng = random.Random(7)
    xs = [rng.randint(0, 10 ** 6) / 10 ** k for k in (3, 5) for _ in range(500)] + [k / 32 for k in range(64)] + [2.675, 0.285, 0.265, -0.125]
    rows = spark.createDataFrame(pd.DataFrame({"x": xs})).select("x", half_even(F.col("x"), 2).alias("a"), half_even(F.col("x"), 4).alias("b"), half_even(F.col("x"), 0).alias("c")).collect()
    assert all((r.a, r.b, r.c) == (round(r.x, 2), round(r.x, 4), round(r.x)) for r in rows)


@pytest.mark.parametrize("cell,expected,iso", [
    ("2026-09-01", datetime(2026, 9, 1), True), ("2026-9-1 07:05", datetime(2026, 9, 1, 7, 5), True), ("2026-09-01T10:30:00Z", datetime(2026, 9, 1, 10, 30), True),
    ("03/10/2026", datetime(2026, 10, 3), False), ("3-1-2026 10:00", datetime(2026, 1, 3, 10), False), ("01/02/70", datetime(1970, 2, 1), False), ("01/02/26", datetime(2026, 2, 1), False),
    ("31/02/2026", None, None), ("not a date", None, None), ("", None, None)])
def test_dates(spark, cell, expected, iso):
    r = spark.createDataFrame([(cell,)], "c string").select(F.date_format(cl.parse_date(F.col("c"))["ts"], "yyyy-MM-dd HH:mm").alias("t"), cl.parse_date(F.col("c"))["iso"].alias("i")).first()
    assert r.t == (expected.strftime("%Y-%m-%d %H:%M") if expected else None) and (expected is None or r.i == iso)


def test_money_and_words(spark):
    cells = ["Rs. 1,299", "₹899.50", "INR 10", "-5", "abc", "", "nan", "1e3"]
    got = [r.v for r in spark.createDataFrame([(c,) for c in cells], "c string").select(cl.parse_money(F.col("c")).alias("v")).collect()]
    assert got == [1299.0, 899.5, 10.0, None, None, None, None, 1000.0]
    rel = {"my friend": "friend", "Friend of a friend": "friend_of_friend", "FoF": "friend_of_friend", "found on insta": "stranger", "": "unknown", "cousin": "unknown", "family": "friend"}
    got = {r.c: r.v for r in spark.createDataFrame([(c,) for c in rel], "c string").select("c", cl.relationship(F.col("c")).alias("v")).collect()}
    assert got == rel


def test_quantiles_match_interpolation(spark):
    rng = random.Random(3)
    rows = [(g, round(rng.lognormvariate(3, 2), 2) * rng.choice((1, 1, -1))) for g in ("a", "b") for _ in range(301)]
    q = {r.g: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"m": 0.5, "p90": 0.9}).collect()}
    for g in ("a", "b"):
        v = sorted(x for k, x in rows if k == g)
        assert q[g].m == pytest.approx(statistics.median(v)) and q[g].p90 == pytest.approx(v[270])
    twelve = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5, 6, 7, 8, 30, 38, 39, 50)], "v double")
    assert exact_quantiles(twelve, [], "v", {"p": 0.9}).first().p == pytest.approx(38.9)


def test_running_sums_and_ranks_do_not_depend_on_partitioning(spark):
    rows = [("a", float(i * i % 97) + i / 1000, i % 5) for i in range(400)]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "g string, v double, n int").repartition(parts)
        got = {r.v: r.c for r in two_level_cumsum(df, ["g"], "v", {"c": "n"}, descending=True).collect()}
        run = 0
        for _, v, n in sorted(rows, key=lambda r: -r[1]):
            run += n
            assert got[v] == run
        ranks = sorted((r.n, r.v, r["rank"]) for r in range_rank(df, ["g"], [F.col("n"), F.col("v")]).collect())
        assert [r[2] for r in ranks] == list(range(1, 401))


def test_attach_by_key_keeps_every_row_of_a_hot_key(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "k string, i int")
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    out = attach_by_key(rows, keyed, ["k"], "n", F.col("i"), hot_rows=50).collect()
    assert len(out) == 300 and {r["first"] for r in out if r.k == "hot"} == {1} and all(r["first"] == r.i for r in out if r.k != "hot")


def test_redaction_and_chat_lines(spark):
    line = "Call +91 98765 43210 or 9876543210, mail a.b@x-y.co.in, ask @Riya.K and me@home not 198765432101"
    text = spark.createDataFrame([(line,)], "t string").select(tx.redact(F.col("t")).alias("r")).first().r
    import hashlib
    alias = "@user_" + hashlib.sha1(("bizlens" + "riya.k").encode()).hexdigest()[:6]
    assert text == f"Call [phone] or [phone], mail [email], ask {alias} and me@home not 198765432101"
    rows = spark.createDataFrame([("@riya (dm): price?",), ("[04/10/26, 9:41 am] Riya S: hi",), ("hello",)], "l string").select(tx.chat_line(F.col("l"), F.lit("2026-01-01").cast("date")).alias("m")).collect()
    assert [(r.m and (r.m.channel, str(r.m.date), r.m.text)) for r in rows] == [("dm", "2026-01-01", "price?"), ("whatsapp", "2026-10-04", "hi"), None]


def test_intents(spark):
    cases = {"How much is it?": ["buying_question"], "collab? price list": ["not_a_lead"], "love your page": ["general_praise"], "this one, can you put my name": ["custom_request", "product_interest"],
             "hm": ["general_praise"], "obsessed": ["product_interest"]}
    got = {r.t: r.i for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", tx.intents(F.col("t")).alias("i")).collect()}
    assert got == cases
    own = spark.createDataFrame([("hm", ["custom_request"]), ("hm", ["nonsense"])], "t string, l array<string>").select(tx.intents(F.col("t"), F.col("l")).alias("i")).collect()
    assert [r.i for r in own] == [["custom_request"], ["general_praise"]]


def test_mapping_suggestion_is_the_greedy_choice(spark):
    cols = ["Order No.", "Odrer Date", "Grand total", "Buyer", "Notes", "Trafic source"]
    got = {r.field: (r.column, r.confidence) for r in im.suggest_mapping(spark.createDataFrame([("s", c) for c in cols], "import_id string, column string"), "orders").collect() if r.column}
    norm = lambda c: " ".join("".join(ch if ch.isalnum() else " " for ch in c.lower()).split())
    cands = []
    for f in im.SPECS["orders"]:
        names = [f.name.replace("_", " "), *f.synonyms]
        for c in cols:
            s = 1.0 if norm(c) in names else max(SequenceMatcher(None, norm(c), n).ratio() for n in names)
            if s >= 0.72:
                cands.append((-s, f.name, c))
    want, used = {}, set()
    for s, f, c in sorted(cands):
        if f not in want and c not in used:
            want[f] = (c, round(-s, 2))
            used.add(c)
    assert got == want


def test_chat_text_is_redacted_in_both_layouts(spark):
    lines = ["@riya (dm): call me 9876543210 mail a@b.com", "[04/10/26, 9:41 am] Riya: ask @some.one or +91 98765 43210"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [r[0] for r in df.select(tx.chat_line(F.col("line"), F.current_date())["text"]).collect()]
    assert got[0] == "call me [phone] mail [email]" and got[1].endswith("or [phone]") and "some.one" not in got[1]


def test_money_takes_plain_numbers_only(spark):
    df = spark.createDataFrame([(x,) for x in ["12d", "5f", "0x10p1", "1e3", "12.", ".5", "NaN"]], "t string")
    assert [r[0] for r in df.select(cl.parse_money(F.col("t"))).collect()] == [None, None, None, 1000.0, 12.0, 0.5, None]
