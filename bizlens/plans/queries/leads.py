"""Section G queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizlens.functions import text as tx
from bizlens.operators import leads as ld
from bizlens.operators import order_metrics as om
from bizlens.operators.imports import pseudonym, short_alias
from bizlens.plans import bindings as bd
from bizlens.plans.bindings import Tables
from bizlens.plans.queries.order_metrics import sessions
from bizlens.sources.tables import stored

LEARN_DAY = "2024-02-05"


def lead_table(s, d):
    t = Tables(s, d)
    none = F.lit(None).cast("string")
    leads = t.leads().withColumn("product", none).withColumn("product_text", F.when(F.col("user_id") % 17 == 4, "mug")).withColumn("intents", F.array("intent"))
    return leads.join(t.profile().select("business_id", "serves_cities", "serves_sizes"), "business_id")


def daily(s, d):
    t = Tables(s, d)
    return stored(s, d, "daily-list", lambda: ld.daily_list(lead_table(s, d), t.lead_signals(), t.lead_snapshots()))


def day(df):
    return df.select(*[F.col(c).cast("string").alias(c) if t == "date" else F.concat_ws(",", c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def lines(s, d):
    return bd.chat_lines(Tables(s, d))


def messages(s, d):
    default = F.date_add(F.lit("2026-09-01").cast("date"), (F.col("conv_id") % 20).cast("int"))
    return lines(s, d).select("business_id", "msg_no", tx.chat_line(F.col("line"), default).alias("m")).where("m is not null").select("business_id", "msg_no", "m.*")


def read(s, d):
    t = Tables(s, d)
    return stored(s, d, "read-messages", lambda: ld.read_messages(stored(s, d, "messages", lambda: messages(s, d)), t.products(), t.profile()))


def held(s, d):
    """Earlier leads: those of the first half of the conversations' people, as held before this batch."""
    m = messages(s, d).where(F.col("msg_no") % 3 == 0).groupBy("business_id", "handle_ref").agg(F.min("msg_no").alias("k"))
    return m.select("business_id", "handle_ref", F.lit("dm").alias("source"), F.lit("2026-08-01").cast("date").alias("created"), F.lit(None).cast("string").alias("product"),
                    F.when(F.col("k") % 2 == 0, "S").alias("size"), F.lit(None).cast("string").alias("design"), F.lit("Surat").alias("city"), F.array(F.lit("general_praise")).alias("intents"))


def g01(s, d):
    t = Tables(s, d)
    return t.read("documents").select("doc_id", tx.redact(F.col("text")).alias("text")).unionByName(
        lines(s, d).select((-F.col("msg_no") - 1).alias("doc_id"), tx.redact(F.col("line")).alias("text")))


def g07(s, d):
    r = read(s, d)
    sig = ld.message_signals(r).groupBy("business_id", "handle_ref").agg(
        F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws("@", "type", F.col("date").cast("string"))))).alias("signals"))  # at most six types a person
    return day(ld.messages_to_leads(r, held(s, d)).join(sig, ["business_id", "handle_ref"], "left"))


def g12(s, d):
    t = Tables(s, d)
    texts = t.events().groupBy("user_id", "day").agg(F.max(F.col("event_id")).alias("e"))
    m = texts.select((F.col("user_id") % 5).alias("business_id"), bd.lead_id(F.col("user_id"), F.col("day")).alias("lead_id"), F.col("day").alias("date"),
                     F.concat(F.lit("message "), F.col("e").cast("string")).alias("text"))
    return day(ld.last_activity(t.lead_signals(), m, t.lead_snapshots()))


def corrections(s, d):
    e = Tables(s, d).events().where(F.col("event_type").isin("error", "signup"))
    k = F.col("event_id")
    return e.select(bd.lead_id(F.col("user_id"), F.col("day")).alias("lead_id"), k.alias("at"),
                    F.when(k % 3 == 0, "relationship").when(k % 3 == 1, "outcome").otherwise("intents").alias("field"),
                    F.when(k % 3 == 0, F.when(k % 2 == 0, "stranger").otherwise("enemy")).when(k % 3 == 1, F.when(k % 4 < 2, "ordered").otherwise("open"))
                    .otherwise(F.when(k % 5 == 0, "maybe").when(k % 5 == 1, "custom_request,buying_question").when(k % 5 == 2, "buying_question,maybe").otherwise("buying_question")).alias("value"),
                    F.when((k % 3 == 1) & (k % 5 < 2), F.date_add("day", 3)).alias("outcome_date"))


def corrected(s, d):
    return ld.apply_corrections(Tables(s, d).leads(), corrections(s, d), F.lit(LEARN_DAY).cast("date"))


def g14(s, d):
    fixed, refused = corrected(s, d)
    a = fixed.select("lead_id", "relationship", "outcome", "intent", F.col("outcome_date").cast("string").alias("outcome_date"), F.array_join("intents", ",").alias("intents"), "intents_corrected",
                     F.lit("lead").alias("kind"))
    return a.unionByName(refused.select("lead_id", F.col("field").alias("relationship"), F.col("value").alias("outcome"), F.col("at").cast("string").alias("intent"), F.lit("refused").alias("kind")),
                         allowMissingColumns=True)


def g14_closed(s, d):
    """Leads closed on each day before the learning day, as they stand after the owner's corrections."""
    fixed, _ = corrected(s, d)
    closed = fixed.where(F.col("outcome").isin("ordered", "not_ordered") & (F.col("outcome_date") < F.lit(LEARN_DAY).cast("date")))
    return closed.groupBy("business_id", F.col("outcome_date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("closed"), F.count(F.when(F.col("outcome") == "ordered", 1)).alias("ordered"))


def learning(s, d):
    return ld.learning_rows(lead_table(s, d), Tables(s, d).lead_signals(), F.lit(LEARN_DAY).cast("date"))


def g19(s, d):
    return ld.contact_attributes(learning(s, d)).select("lead_id", "score", "previous_outcome", F.col("prior_contacts").cast("bigint").alias("prior_contacts"),
                                                        F.col("days_since_last_contact").cast("bigint").alias("days_since_last_contact"))


QUERIES = {
    "g01_redaction": g01,
    "g02_pseudonym": lambda s, d: Tables(s, d).read("customer").select("c_custkey", pseudonym(F.col("c_name"), "user").alias("person_key"), short_alias(F.col("c_name"), "user").alias("alias")),
    "g03_chat_lines": lambda s, d: day(messages(s, d)),
    "g04_intents": lambda s, d: day(messages(s, d).select("msg_no", tx.intents(F.col("text")).alias("intents"))),
    "g05_details": lambda s, d: read(s, d).select("msg_no", "size", "city", "product", "design"),
    "g06_signals": lambda s, d: read(s, d).select("msg_no", F.posexplode("signals").alias("pos", "signal")).select("msg_no", F.col("pos").cast("bigint").alias("pos"), "signal"),
    "g07_people": g07,
    "g08_fit": lambda s, d: ld.fit(lead_table(s, d)).select("lead_id", "disqualified_reason", F.col("deliverable").cast("string").alias("deliverable")),
    "g09_g10_score": lambda s, d: daily(s, d).select("business_id", "lead_id", F.col("as_of").cast("string").alias("as_of"), "score", "group", F.concat_ws("; ", "reasons").alias("reasons")),
    "g11_ranked_list": lambda s, d: ld.ranked(daily(s, d)).select("business_id", "lead_id", F.col("as_of").cast("string").alias("as_of"), "group", "score", "rank"),
    "g12_last_activity": g12,
    "g13_group_counts": lambda s, d: day(ld.group_counts(daily(s, d))),
    "g14_corrections": g14, "g14_closed_by_day": g14_closed,
    "g15_conversion_by_group": lambda s, d: ld.conversion_by_group(learning(s, d)),
    "g16_conversion_by_signal": lambda s, d: ld.conversion_by_signal(learning(s, d)),
    "g17_health_checks": lambda s, d: ld.health_checks(ld.conversion_by_group(learning(s, d))),
    "g18_spearman": lambda s, d: ld.spearman(ld.challenger(learning(s, d)), "business_id", "score", "p"),
    "g19_contact_attributes": g19,
    "g20_direction_checks": lambda s, d: ld.direction_checks(om.conversion_by_segment(sessions(s, d))),
}
