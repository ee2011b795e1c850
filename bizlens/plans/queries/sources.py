"""Section A queries: whole tables are written as files to the shared folder and read back through the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizlens.operators import facts as fx
from bizlens.operators import imports as im
from bizlens.plans import bindings as bd
from bizlens.plans.bindings import Tables
from bizlens.session import scratch_path
from bizlens.sources import sheets


def _text(df):
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def a01(s, d):
    o = _text(Tables(s, d).read("orders").select("o_orderkey", "o_custkey", F.concat(F.lit(" "), "o_orderpriority", F.lit(', "noted" ')).alias("note"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("status")))
    path = scratch_path(s, "orders-csv")
    o.write.csv(path, header=True, quote='"', escape='"')
    r = sheets.read_sheet(s, path)
    per_file = r.groupBy("import_id").agg(F.count(F.lit(1)).alias("n"), F.max("source_row").alias("m"), F.countDistinct("source_row").alias("u"))
    ok = per_file.agg(F.min(((F.col("m") == F.col("n") + 1) & (F.col("u") == F.col("n"))).cast("int")).alias("dense"))  # one row
    return r.crossJoin(F.broadcast(ok)).select("o_orderkey", "o_custkey", "note", "status", F.col("dense").cast("bigint").alias("rows_dense"))


def a02(s, d):
    c = bd.contact_history(Tables(s, d)).select("order_id", F.col("previous_outcome").alias("poutcome"), F.col("prior_contacts").alias("previous"), F.col("days_since_last_contact").alias("pdays"),
                                                F.col("contacts_this_campaign").alias("campaign"), F.when(F.col("y") == 1, "yes").otherwise("no").alias("y"))
    path = scratch_path(s, "contacts-csv")
    _text(c).write.csv(path, header=True, sep=";")
    return sheets.read_sheet(s, path, sep=";", encoding="UTF-8").groupBy("poutcome", "y").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("pdays").cast("bigint")).alias("pdays"))


def a03(s, d):
    w = bd.event_windows(Tables(s, d)).groupBy(F.year("window_start").alias("season")).agg(F.sort_array(F.collect_list(F.struct("name", "window_start", "window_end"))).alias("races"))  # twelve a season
    path = scratch_path(s, "calendar-json")
    w.write.option("maxRecordsPerFile", 1).json(path)  # one document a file
    return sheets.read_documents(s, path, "season int, races array<struct<name:string,window_start:string,window_end:string>>", "races")


def a05(s, d):
    t = Tables(s, d)
    weekly = fx.weekly_orders(t.orders()).select("business_id", F.col("week").cast("string").alias("week"), "orders")
    path = scratch_path(s, "weekly")
    sheets.write_partitioned(weekly, path, ["business_id"])
    sheets.write_partitioned(weekly.where("business_id = 3").withColumn("orders", F.col("orders") * 10), path, ["business_id"])
    return s.read.parquet(path).select(F.col("business_id").cast("bigint").alias("business_id"), "week", "orders")


def a06(s, d):
    o = Tables(s, d).order_business().select("business_id", "order_id", "status")
    held, new = o.where("status <> 'F'").withColumn("src", F.lit("held")), o.where("status <> 'O'").withColumn("src", F.lit("new"))
    return im.attach_new(held, new, ["business_id", "order_id"]).select("business_id", "order_id", "src")


def a06_costs(s, d):
    p = Tables(s, d).products()
    held = p.select("business_id", "name", F.col("price").alias("full"))
    new = p.where(F.col("first_key") % 2 == 0).select("business_id", "name", (F.col("price") * 2).alias("full"))
    return im.attach_costs(held, new, ["business_id", "name"])


QUERIES = {
    "a01_delimited_scan": a01, "a02_labelled_file": a02, "a03_json_documents": a03,
    "a04_batch_identity": lambda s, d: Tables(s, d).read("documents").withColumn("content", F.col("text").cast("binary")).select(
        "doc_id", sheets.batch_id(F.col("content"), "orders").alias("import_id"), sheets.batch_label(F.col("content"), "orders").alias("label")),
    "a05_partitioned_sink": a05, "a06_attach_new": a06, "a06_attach_costs": a06_costs,
}
