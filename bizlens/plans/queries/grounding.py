"""Section O queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizlens.operators import facts as fx
from bizlens.operators import grounding as gr
from bizlens.plans.bindings import Tables
from bizlens.plans.queries.diagnosis import facts

KEYS = ["business_id", "week_no", "doc_fact"]
NUMERIC = ["value", "baseline", "numerator", "denominator", "sample_size"]


def place():
    return F.array_position(F.array(*[F.lit(i) for i in fx.FACT_IDS]), F.col("fact_id"))


def documents_of(f):
    """A sentence per fact; every ninth holds a wrong number, some suggest ads, some cite an unknown fact or are too short."""
    k = F.col("business_id") * 100 + F.col("week_no") * 23 + place()
    wrong = F.when(k % 9 == 0, F.format_string(" Expect %.1f next week.", F.col("sample_size") + 7777.5)).otherwise("")
    ads = F.when(k % 7 == 0, " You could run ads.").otherwise("")
    text = F.concat(F.lit("On "), "period_to", F.lit(" the "), F.regexp_replace("kpi", "_", " "), F.lit(" stood at "), F.col("value").cast("string"), F.lit(" from a sample of "),
                    F.col("sample_size").cast("string"), F.lit("."), wrong, ads)
    return f.select("business_id", "week_no", F.col("fact_id").alias("doc_fact"), F.when(k % 31 == 0, "Too short").otherwise(text).alias("text"),
                    F.when(k % 11 == 0, F.concat(F.col("fact_id"), F.lit("_old"))).otherwise(F.col("fact_id")).alias("fact_id"), F.lit(1).alias("cited"), (F.col("business_id") % 3 != 0).alias("no_paid_ads"))


def packets(f):
    return f.withColumn("doc_fact", F.col("fact_id"))


def o01(s, d):
    docs = Tables(s, d).read("documents").select("doc_id", gr.numbers_in(F.col("text")).alias("n"))
    return docs.select("doc_id", F.posexplode("n").alias("pos", "token"))


def o02(s, d):
    return gr.number_pool(packets(facts(s, d)), KEYS, NUMERIC, ["period_from", "origin", "dimension"]).withColumn("v", F.col("v").cast("double"))


def bad(f):
    packet = packets(f).withColumn("label", F.regexp_replace("kpi", "_", " "))
    return gr.ungrounded(documents_of(f), gr.number_pool(packet, KEYS, NUMERIC, ["label"]), KEYS)


def o04(s, d):
    f = facts(s, d)
    docs = documents_of(f)
    unknown = gr.unknown_citations(docs.select(*KEYS, "fact_id"), f.select("business_id", "week_no", F.col("fact_id").alias("doc_fact"), "fact_id"), KEYS)
    return gr.text_errors(docs.drop("fact_id"), unknown, bad(f), KEYS)


def o04_answers(s, d):
    """The sentences as answers, those of even weeks without a citation."""
    f = facts(s, d)
    docs = documents_of(f).withColumn("cited", F.col("week_no") % 2)
    unknown = gr.unknown_citations(docs.where("cited > 0").select(*KEYS, "fact_id"), f.select("business_id", "week_no", F.col("fact_id").alias("doc_fact"), "fact_id"), KEYS)
    return gr.answer_errors(docs.drop("fact_id"), unknown, bad(f), KEYS)


def o05(s, d):
    c = Tables(s, d).read("conversations").where(F.col("role") == "user")
    texts = ["How many new customers came from outside my circle?", "Is my margin or profit falling, what do I earn?", "Why are deliveries late and slow?", "Do people come back, how often do they repeat?",
             "Can we keep up or are orders turned away?", "What is the weather?"]
    k = F.col("conv_id") * 3 + F.col("turn")
    q = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), (F.col("conv_id") % 5).alias("business_id"), (F.col("turn") % 4 + 1).alias("week_no"),
                 F.get(F.array(*[F.lit(t) for t in texts]), (k % 6).cast("int")).alias("question"))
    return gr.retrieve(q, facts(s, d).withColumn("place", place()))


QUERIES = {
    "o01_numbers_in_text": o01, "o02_number_pool": o02, "o03_ungrounded_numbers": lambda s, d: bad(facts(s, d)), "o04_text_errors": o04,
    "o04_answer_errors": o04_answers, "o05_fact_retrieval": o05,
}
