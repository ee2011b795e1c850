"""Sheets as people export them, and keys that do not collide."""

import hashlib
import random

from pyspark.sql import functions as F

from bizlens.operators.imports import pseudonym, short_alias
from bizlens.sources import records
from bizlens.sources.sheets import batch_ids, read_sheet


def test_columns_in_another_order_and_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Order ID,Amount,Note\nA1,100,"two\nlines"\nA2,150,plain\n')
    (tmp_path / "b.csv").write_text("Amount,Order ID\n200,B1\n")
    rows = {r["Order ID"]: r for r in read_sheet(spark, str(tmp_path)).collect()}
    assert {k: (r["Amount"], r["Note"], r["source_row"]) for k, r in rows.items()} == {
        "A1": ("100", "two\nlines", 2), "A2": ("150", "plain", 3), "B1": ("200", "", 2)}


def test_latin_1_file_beside_a_utf_8_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Order ID,City\nA1,Pun\u00e9\n".encode())
    (tmp_path / "b.csv").write_bytes("Order ID,City\nB1,Pun\u00e9\n".encode("latin-1"))
    assert {(r["Order ID"], r["City"]) for r in read_sheet(spark, str(tmp_path)).collect()} == {("A1", "Pun\u00e9"), ("B1", "Pun\u00e9")}


def odd_sheet(seed, rows):
    """Cells with quoted line breaks, separators, doubled and stray quotes, blank lines and breaks over many lines."""
    r = random.Random(seed)
    kinds = [lambda: "plain", lambda: "", lambda: '"a,b"', lambda: '"two\nlines"', lambda: '"x ""y"" z"', lambda: '5" pipe', lambda: '"' + "long\n\n" * r.randint(1, 60) + 'end"',
             lambda: '"\r\nwindows"', lambda: "caf\u00e9", lambda: '""']
    lines = ["id,first,second"]
    for i in range(rows):
        lines.append(f"{i},{r.choice(kinds)()},{r.choice(kinds)()}")
        if r.random() < 0.1:
            lines.append("")
    return "\n".join(lines) + r.choice(["", "\n"])


def test_one_file_read_by_many_tasks_gives_the_rows_of_one_task(spark, tmp_path):
    (tmp_path / "1.csv").write_bytes(odd_sheet(1, 120).encode())
    (tmp_path / "2.csv").write_bytes(odd_sheet(2, 20).replace("\r\n", "\n").replace("\n", "\r\n").encode())
    whole = spark.read.schema("id string, a string, b string").csv(str(tmp_path), header=True, quote='"', escape='"', multiLine=True)
    want = sorted((r["f"], r["id"], r["a"], r["b"]) for r in whole.select(F.col("_metadata.file_path").alias("f"), "id", F.coalesce(F.trim("a"), F.lit("")).alias("a"), F.coalesce(F.trim("b"), F.lit("")).alias("b")).collect())
    assert len(want) == 140
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (700, 150):  # the second is below the length of many records
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
            got = read_sheet(spark, str(tmp_path)).collect()
            assert sorted((r["import_id"], r["id"], r["first"], r["second"]) for r in got) == want
            assert all(r["source_row"] == int(r["id"]) + 2 for r in got)
        found, _ = records.read_records(spark, str(tmp_path), small_table=0)
        assert found.count() == 142  # without the broadcast, header rows included
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_quote_that_never_ends_takes_the_rest_and_empty_files_give_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"open\n2,more\n')
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.csv").write_text("note,id\n")
    assert [(r["id"], r["note"], r["source_row"]) for r in read_sheet(spark, str(tmp_path)).collect()] == [("1", "open\n2,more", 2)]


def test_two_people_with_one_short_alias_stay_apart(spark):
    seen, pair = {}, None
    for i in range(100_000):
        short = hashlib.sha1(f"bizlensperson {i}".encode()).hexdigest()[:6]
        if short in seen:
            pair = (f"person {seen[short]}", f"person {i}")
            break
        seen[short] = i
    df = spark.createDataFrame([(p,) for p in pair], "name string")
    r = df.agg(F.countDistinct(short_alias(F.col("name"), "user")).alias("short"), F.countDistinct(pseudonym(F.col("name"), "user")).alias("keys")).first()
    assert (r["short"], r["keys"]) == (1, 2)


def test_file_identity_is_the_whole_digest(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x,y\n1,2\n")
    r = batch_ids(spark, str(tmp_path / "a.csv"), "orders").first()
    digest = hashlib.sha1(b"x,y\n1,2\n").hexdigest()
    assert (r["import_id"], r["label"]) == ("imp_orders_" + digest, "imp_orders_" + digest[:8])
