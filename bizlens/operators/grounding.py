"""Checks on tables of generated text: every number and citation must come from the facts it was written from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values
NUMBER = r"(?U)(?<![\w.])\d[\d,]*(?:\.\d+)?"
DATE = r"(?U)\b\d{4}-\d{2}-\d{2}(?:T[\d:]+Z?)?\b"
PAID_ADS = (r"(?i)\b(paid ads?|run(ning)? ads?|instagram ads?|facebook ads?|sponsored (post|ads?)|boost(ing)? (your|a|the) post|paid (promotion|shoutout))\b")
MIN_LENGTH, MAX_LENGTH, MAX_CITED = 20, 900, 12
MAX_FACTS = 4
# words that ask for a KPI
KPI_WORDS = {
    "stranger_share": ("stranger", "strangers", "new people", "new customers", "outside my circle", "friends", "reach"),
    "stranger_orders_per_week": ("stranger", "strangers", "new people", "new customers"),
    "orders_by_source": ("friends", "where do my orders come from", "source"),
    "reach_per_post": ("reach", "views", "seen", "post"),
    "lead_to_order_rate": ("conversion", "convert", "interested", "enquiries", "dms"),
    "orders_per_1000_reach": ("conversion", "convert"),
    "margin_pct": ("margin", "profit", "earn", "make per order"),
    "margin_per_order": ("margin", "profit", "earn", "make per order"),
    "unit_cost_full": ("cost", "costs"),
    "discount_share": ("discount", "discounts"),
    "repeat_customer_share": ("repeat", "come back", "return", "again"),
    "days_between_orders": ("repeat", "come back", "how often"),
    "orders_per_week": ("orders", "sales", "how many orders"),
    "dispatch_delay_days": ("dispatch", "delivery", "late", "slow", "ship"),
    "orders_turned_away": ("turned away", "capacity", "too many orders", "keep up"),
    "capacity_utilisation": ("capacity", "keep up", "limit"),
    "stockouts": ("stock", "stock-out", "ran out"),
}
# ---- end of fixed values

KEY = "decimal(28,9)"


def kpi_words() -> list[tuple[str, str]]:
    return [(kpi, word) for kpi, words in KPI_WORDS.items() for word in words]


def numbers_in(text: Column) -> Column:
    """Number tokens of a text, dates left out, commas removed."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), DATE, " "), F.lit(NUMBER), F.lit(0)), lambda t: F.regexp_replace(t, ",", ""))


def number_pool(facts: DataFrame, keys: list[str], numeric: list[str], texts: list[str]) -> DataFrame:
    """Every number of an evidence row: its values, and numbers inside its strings."""
    vals = F.array(*[F.col(c).cast("double") for c in numeric])
    inside = F.transform(F.concat(*[numbers_in(F.col(c)) for c in texts]), lambda t: t.try_cast("double")) if texts else F.array().cast("array<double>")
    return facts.select(*keys, F.explode(F.concat(vals, inside)).alias("v")).where("v is not null").distinct()


def allowed_forms(pool: DataFrame, keys: list[str]) -> DataFrame:
    """The ways a pooled number may be written: as it is or rounded to 0..3 decimals, and as a percentage when small."""
    v = F.abs("v")
    base = pool.select(*keys, F.explode(F.filter(F.array(v, F.when(v <= 1.5, v * 100)), lambda x: x.isNotNull())).alias("f"))
    forms = F.array(F.col("f"), *[F.bround("f", d) for d in range(4)])
    return base.select(*keys, F.explode(forms).alias("form")).select(*keys, F.col("form").cast(KEY).alias("form")).distinct()


def ungrounded(docs: DataFrame, pool: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Numbers of each document that no pooled number explains; 0 and 1 always pass."""
    found = docs.select(*keys, F.explode(numbers_in(F.col(text))).alias("token")).withColumn("form", F.col("token").try_cast("double").cast(KEY))
    found = found.where(~F.col("form").isin(0, 1))
    return found.join(allowed_forms(pool, keys), [*keys, "form"], "left_anti").select(*keys, "token")


def unknown_citations(cited: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return cited.join(known, [*keys, "fact_id"], "left_anti")


def text_errors(docs: DataFrame, unknown: DataFrame, bad_numbers: DataFrame, keys: list[str]) -> DataFrame:
    """Error list per document: length and count limits, unknown citations, ungrounded numbers, forbidden phrases.

    A document that breaks a limit reports only that, as the other checks assume a well-formed one.
    """
    u = unknown.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("fact_id")), ",").alias("unknown"))
    n = bad_numbers.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("token")), ",").alias("numbers"))
    j = docs.join(u, keys, "left").join(n, keys, "left")
    size = F.when((F.length("text") < MIN_LENGTH) | (F.length("text") > MAX_LENGTH) | (F.col("cited") < 1) | (F.col("cited") > MAX_CITED), "schema")
    rest = F.concat_ws("; ", F.when(F.col("unknown").isNotNull(), F.concat(F.lit("unknown evidence_ids: "), "unknown")),
                       F.when(F.col("numbers").isNotNull(), F.concat(F.lit("numbers not in the evidence packet: "), "numbers")),
                       F.when(F.col("no_paid_ads") & F.col("text").rlike(PAID_ADS), "constraint violation: suggests paid ads"))
    return j.select(*keys, F.coalesce(size, rest).alias("errors"))


def answer_errors(answers: DataFrame, unknown: DataFrame, bad_numbers: DataFrame, keys: list[str]) -> DataFrame:
    """Error list per answer (`text`, `cited` = number of citations): length, unknown citations, ungrounded numbers, and numbers
    without any citation. A null text is empty, which breaks the length limit; such an answer reports only that."""
    u = unknown.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("fact_id")), ",").alias("unknown"))
    n = bad_numbers.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("token")), ",").alias("numbers"))
    j = answers.join(u, keys, "left").join(n, keys, "left").withColumn("_text", F.coalesce("text", F.lit("")))
    uncited = F.col("numbers").isNull() & (F.coalesce("cited", F.lit(0)) == 0) & (F.size(numbers_in(F.col("_text"))) > 0)
    rest = F.concat_ws("; ", F.when(F.col("unknown").isNotNull(), F.concat(F.lit("unknown citations: "), "unknown")),
                       F.when(F.col("numbers").isNotNull(), F.concat(F.lit("numbers not in the evidence packet: "), "numbers")), F.when(uncited, "numbers without a cited fact"))
    return j.select(*keys, F.when(~F.length("_text").between(1, MAX_LENGTH), "schema").otherwise(rest).alias("errors"))


def retrieve(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """Up to four facts per question by keyword hits, facts in table order on ties.

    Hits are counted per (question, KPI) against a fixed word list first, so only matching KPIs meet the fact table.
    """
    spark = questions.sparkSession
    words = spark.createDataFrame([(k, rf"(?U)\b\Q{w}\E") for k, w in kpi_words()], "kpi string, pattern string")  # about 60 fixed rows
    q = F.lower("question")
    hits = questions.join(F.broadcast(words)).where(F.regexp_like(q, F.col("pattern"))).groupBy("question_id", "business_id", "week_no", "kpi").agg(F.count(F.lit(1)).alias("hits"))
    j = hits.join(facts.select("business_id", "week_no", "kpi", "fact_id", "place"), ["business_id", "week_no", "kpi"])
    w = Window.partitionBy("question_id").orderBy(F.col("hits").desc(), "place")  # at most 23 facts a question
    return j.withColumn("pos", F.row_number().over(w).cast("bigint")).where(F.col("pos") <= MAX_FACTS).select("question_id", "fact_id", "hits", "pos")
