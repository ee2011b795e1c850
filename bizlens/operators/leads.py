"""Lead intake, scoring as of any day, the ranked daily list, and the weekly check of what predicts orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.functions import model as mdl
from bizlens.functions import text as tx
from bizlens.functions.numbers import half_even, ratio
from bizlens.sources.tables import materialise
from bizlens.operators.mentions import mentions
from bizlens.operators.ranges import range_rank
from bizlens.operators.skew import two_level_cumsum

# ---- fixed values
POINTS = {"price_question": 40, "bought_before": 30, "story_reply": 20, "saved_or_shared": 15, "comment": 10, "follow_or_like": 5}
STRANGER_BONUS = 10
DECAY_DAYS, DECAY_POINTS = 30, -20
HOT, WARM = 50, 20
MIN_OUTCOMES = 30
RELATIONSHIPS = ("friend", "friend_of_friend", "stranger", "unknown")
OUTCOMES = ("open", "ordered", "not_ordered")
# ---- end of fixed values


# ---------------------------------------------------------------- messages
def read_messages(messages: DataFrame, products: DataFrame, serves: DataFrame) -> DataFrame:
    """Intents, asked-for details and signals per message; `msg_no` is unique inside a business."""
    m = messages.join(serves.select("business_id", "serves_cities"), "business_id", "left").join(mentions(messages, products), ["business_id", "msg_no"], "left")
    t = F.col("text")
    m = m.select(*messages.columns, tx.intents(t).alias("intents"), tx.asked_size(t).alias("size"), tx.asked_city(t, F.col("serves_cities")).alias("city"),
                 "product", tx.asked_design(t).alias("design"))
    return m.withColumn("signals", tx.signals(F.col("channel"), F.col("intents")))


def messages_to_leads(read: DataFrame, held: DataFrame) -> DataFrame:
    """One row per person: first non-null details, intents in first-seen order, and whether the lead was held already.

    Every 'first' is the minimum of (message position, value), so a person's messages combine on the map side.
    """
    counted = ~F.array_contains("intents", "not_a_lead")
    pos = F.col("msg_no")
    firsts = [F.min(F.when(counted & F.col(c).isNotNull(), F.struct(pos, F.col(c).alias("v"))))["v"].alias(c) for c in ("product", "size", "design", "city")]
    order = [F.min(F.when(F.array_contains("intents", i), F.struct(pos, F.array_position("intents", i).alias("p")))).alias(f"i_{i}") for i in tx.INTENTS]
    g = read.groupBy("business_id", "handle_ref").agg(F.min(F.struct(pos, F.col("channel"), F.col("date"))).alias("first"), F.count(F.lit(1)).alias("messages"), *firsts, *order)
    seen = F.array_sort(F.filter(F.array(*[F.when(F.col(f"i_{i}").isNotNull(), F.struct(F.col(f"i_{i}").alias("at"), F.lit(i).alias("name"))) for i in tx.INTENTS]), lambda x: x.isNotNull()))
    new = g.select("business_id", "handle_ref", F.col("first.channel").alias("source"), F.col("first.date").alias("created"), "messages", "product", "size", "design", "city",
                   F.transform(seen, lambda x: x["name"]).alias("intents"))
    h = held.select("business_id", "handle_ref", F.col("source").alias("h_source"), F.col("created").alias("h_created"), *[F.col(c).alias(f"h_{c}") for c in ("product", "size", "design", "city")],
                    F.col("intents").alias("h_intents"))
    both = new.join(h, ["business_id", "handle_ref"], "full_outer")
    none = F.array().cast("array<string>")
    return both.select(
        "business_id", "handle_ref", F.coalesce("h_source", "source").alias("source"), F.coalesce("h_created", "created").alias("created"),
        F.coalesce("messages", F.lit(0)).alias("new_messages"), *[F.coalesce(f"h_{c}", c).alias(c) for c in ("product", "size", "design", "city")],
        F.array_distinct(F.concat(F.coalesce("h_intents", none), F.coalesce("intents", none))).alias("intents"),
        F.when(F.col("h_created").isNull(), "created").when(F.col("messages").isNotNull(), "updated").otherwise("kept").alias("change"))


def message_signals(read: DataFrame) -> DataFrame:
    """Each signal type of a person once, dated by the message that first earned it."""
    s = read.select("business_id", "handle_ref", "msg_no", "date", F.explode("signals").alias("type"))
    return s.groupBy("business_id", "handle_ref", "type").agg(F.min(F.struct("msg_no", "date"))["date"].alias("date"))


# ---------------------------------------------------------------- fit and score
def fit(leads: DataFrame) -> DataFrame:
    """Adds `disqualified_reason` and `deliverable` (null = needs a check) from what was asked and what is served."""
    c = F.col
    reason = (F.when(c("city").isNotNull() & (F.size("serves_cities") > 0) & ~F.array_contains("serves_cities", c("city")), F.concat(F.lit("city: cannot deliver to "), c("city")))
              .when(c("size").isNotNull() & (F.size("serves_sizes") > 0) & ~F.array_contains("serves_sizes", c("size")), F.concat(F.lit("size: "), c("size"), F.lit(" is not available")))
              .when(c("design").isNotNull() & F.array_contains("intents", "custom_request"), F.lit(None))
              .when(c("product").isNull() & c("product_text").isNotNull() & ~F.array_contains("intents", "custom_request"),
                    F.concat(F.lit("design: "), c("product_text"), F.lit(" is not something the owner makes"))))
    check = c("design").isNotNull() & F.array_contains("intents", "custom_request")
    return leads.withColumn("disqualified_reason", reason).withColumn(
        "deliverable", F.when(c("disqualified_reason").isNotNull(), F.lit(False)).when(check, F.lit(None)).otherwise(F.lit(True)))


def visible_signals(signals: DataFrame, views: DataFrame) -> DataFrame:
    """Signal flags and the last signal day per (lead, view day). `views` has (business_id, lead_id, as_of)."""
    days = signals.groupBy("business_id", "lead_id").agg(*[F.min(F.when(F.col("type") == t, F.col("date"))).alias(f"first_{t}") for t in POINTS], F.array_sort(F.collect_set("date")).alias("days"))
    v = views.join(days, ["business_id", "lead_id"], "left")
    before = F.filter(F.coalesce("days", F.array().cast("array<date>")), lambda d: d < F.col("as_of"))
    return v.select(*views.columns, *[F.coalesce(F.col(f"first_{t}") < F.col("as_of"), F.lit(False)).alias(f"has_{t}") for t in POINTS], F.array_max(before).alias("last_signal"))


def score(rows: DataFrame) -> DataFrame:
    """Adds `score`, `group` and `reasons` to rows with signal flags, relationship, intents and the fit."""
    stranger = F.coalesce(F.col("relationship") == "stranger", F.lit(False))
    stale = F.coalesce(F.col("last_signal") <= F.date_sub("as_of", DECAY_DAYS), F.lit(False))
    any_type = F.lit(False)
    total = F.lit(0)
    for t, p in POINTS.items():
        any_type, total = any_type | F.col(f"has_{t}"), total + F.when(F.col(f"has_{t}"), p).otherwise(0)
    total = total + F.when(stranger, STRANGER_BONUS).otherwise(0) + F.when(stale, DECAY_POINTS).otherwise(0)
    out = rows.withColumn("not_a_lead", F.array_contains("intents", "not_a_lead") & ~any_type).withColumn("score", F.when(~F.col("not_a_lead"), total).cast("bigint"))
    group = (F.when(F.col("not_a_lead"), "not_a_lead").when(F.col("disqualified_reason").isNotNull(), "disqualified").when(F.col("score") >= HOT, "hot")
             .when(F.col("score") >= WARM, "warm").otherwise("cold"))
    parts = [F.when(F.col(f"has_{t}"), F.lit(f"{t} +{p}")) for t, p in POINTS.items()]
    parts += [F.when(stranger, F.lit(f"stranger +{STRANGER_BONUS}")), F.when(stale, F.lit(f"decay {DECAY_POINTS}"))]
    return out.withColumn("group", group).withColumn("reasons", F.filter(F.array(*parts), lambda x: x.isNotNull()))


def scored(leads: DataFrame, signals: DataFrame, views: DataFrame) -> DataFrame:
    """Leads scored at each (lead, as_of) of `views`."""
    flagged = visible_signals(signals, views)
    return score(fit(leads).join(flagged, ["business_id", "lead_id"]))


def daily_list(leads: DataFrame, signals: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Open leads with a visible signal, scored and ranked per (business, snapshot day)."""
    first = signals.groupBy("business_id", "lead_id").agg(F.min("date").alias("first_signal"))
    open_views = leads.select("business_id", "lead_id", "outcome", "outcome_date").join(first, ["business_id", "lead_id"]).join(snapshots, "business_id").where(
        (F.col("first_signal") < F.col("as_of")) & ~F.coalesce(F.col("outcome").isin("ordered", "not_ordered") & (F.col("outcome_date") < F.col("as_of")), F.lit(False)))
    return scored(leads, signals, open_views.select("business_id", "lead_id", "as_of")).where("group <> 'not_a_lead'")


GROUP_ORDER = {"hot": 0, "warm": 1, "cold": 2, "disqualified": 3}


def group_position() -> Column:
    return F.when(F.col("group") == "hot", 0).when(F.col("group") == "warm", 1).when(F.col("group") == "cold", 2).otherwise(3)


def ranked(listed: DataFrame) -> DataFrame:
    """Position in the day's list: group, score, strangers first, latest signal, id. Disqualified leads have none."""
    order = [group_position(), F.col("score").desc(), F.when(F.col("relationship") == "stranger", 0).otherwise(1), F.col("last_signal").desc(), F.col("lead_id")]
    listed = materialise(listed, "listed")  # both halves read it
    good = range_rank(listed.where("group <> 'disqualified'"), ["business_id", "as_of"], order)
    return good.unionByName(listed.where("group = 'disqualified'").withColumn("rank", F.lit(None).cast("bigint")))


def last_activity(signals: DataFrame, messages: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Latest visible message and signal day per lead and snapshot."""
    s = signals.select("business_id", "lead_id", "date", F.lit(None).cast("string").alias("text"))
    m = messages.select("business_id", "lead_id", "date", "text")
    both = s.unionByName(m).join(snapshots, "business_id").where(F.col("date") < F.col("as_of"))
    return both.groupBy("business_id", "lead_id", "as_of").agg(
        F.max(F.when(F.col("text").isNotNull(), F.struct("date", "text")))["text"].alias("last_message"), F.max(F.when(F.col("text").isNull(), F.col("date"))).alias("last_activity"))


def group_counts(listed: DataFrame) -> DataFrame:
    return listed.groupBy("business_id", "as_of", "group", "disqualified_reason").agg(F.count(F.lit(1)).alias("leads"))


def apply_corrections(leads: DataFrame, corrections: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """The owner's latest valid correction per lead and field, and the refused corrections (lead_id, at, field, value, outcome_date).

    `intents` takes a comma-separated list of known intents; the lead's `intent` becomes the first of it. An outcome takes its
    date with it: none where the lead is open again, else the day the owner gave or the day before `as_of`. Adds `intents` and
    `intents_corrected`. Of corrections at the same time the largest value holds; a null field or value is refused.
    """
    listed = F.split("value", ",")
    ok = ((F.col("field") == "relationship") & F.col("value").isin(*RELATIONSHIPS)) | ((F.col("field") == "outcome") & F.col("value").isin(*OUTCOMES)) | (
        (F.col("field") == "intents") & (F.size(F.array_except(listed, F.array(*[F.lit(i) for i in tx.INTENTS]))) == 0))
    fields = ("relationship", "outcome", "intents")
    last = corrections.where(ok).groupBy("lead_id").agg(*[F.max(F.when(F.col("field") == f, F.struct("at", "value", "outcome_date"))).alias(f"_{f}") for f in fields])
    outcome, intents = F.col("_outcome.value"), F.split("_intents.value", ",")
    day = F.when(outcome.isNull(), F.col("outcome_date")).when(outcome != "open", F.coalesce("_outcome.outcome_date", F.date_sub(as_of, 1)))
    fixed = leads.join(last, "lead_id", "left").withColumns({
        "relationship": F.coalesce("_relationship.value", "relationship"), "outcome": F.coalesce(outcome, "outcome"), "outcome_date": day,
        "intent": F.coalesce(intents[0], "intent"), "intents": F.coalesce(intents, F.array("intent")), "intents_corrected": intents.isNotNull()})
    return fixed.drop(*[f"_{f}" for f in fields]), corrections.where(~F.coalesce(ok, F.lit(False)))


# ---------------------------------------------------------------- learning
def learning_rows(leads: DataFrame, signals: DataFrame, day: Column) -> DataFrame:
    """Closed leads scored as they looked when their outcome happened."""
    closed = leads.where(F.col("outcome").isin("ordered", "not_ordered") & (F.col("outcome_date") < day))
    views = closed.select("business_id", "lead_id", F.least(day, F.col("outcome_date")).alias("as_of"))
    rows = scored(closed, signals, views).where("group in ('hot', 'warm', 'cold')")
    return rows.withColumn("won", (F.col("outcome") == "ordered").cast("int"))


def conversion_by_group(rows: DataFrame) -> DataFrame:
    g = rows.groupBy("business_id", "group").agg(F.count(F.lit(1)).alias("leads"), F.sum("won").alias("ordered"))
    return g.withColumn("conversion", half_even(ratio(F.col("ordered"), F.col("leads")), 4))


def conversion_by_signal(rows: DataFrame) -> DataFrame:
    """Conversion with and without each signal, lift against overall, and the suggestion once 30 leads have it."""
    flags = {**{t: F.col(f"has_{t}") for t in POINTS}, "stranger": F.col("relationship") == "stranger"}
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("won").alias("w")]
    for t, f in flags.items():
        aggs += [F.count(F.when(f, 1)).alias(f"n_{t}"), F.coalesce(F.sum(F.when(f, F.col("won"))), F.lit(0)).alias(f"w_{t}")]
    wide = rows.groupBy("business_id").agg(*aggs)
    long = wide.select("business_id", "n", "w", F.explode(F.array(*[
        F.struct(F.lit(t).alias("signal"), F.col(f"n_{t}").alias("ni"), F.col(f"w_{t}").alias("wi"), F.lit(POINTS.get(t, STRANGER_BONUS)).cast("bigint").alias("points_now")) for t in flags])).alias("s")).select(
        "business_id", "n", "w", "s.*")
    lift = ratio(ratio(F.col("wi"), F.col("ni")), ratio(F.col("w"), F.col("n")))
    enough = (F.col("ni") >= MIN_OUTCOMES) & (F.col("w") > 0)
    return long.select(
        "business_id", "signal", F.col("ni").alias("leads_with_signal"), half_even(ratio(F.col("wi"), F.col("ni")), 4).alias("conversion_with"),
        half_even(ratio(F.col("w") - F.col("wi"), F.col("n") - F.col("ni")), 4).alias("conversion_without"), "points_now",
        F.when(enough, half_even(lift, 2)).alias("lift_vs_overall"),
        F.when(~enough, "not enough outcomes yet").when(lift > 1.3, "raise").when(lift < 0.7, "lower").otherwise("keep").alias("suggestion"))


def health_checks(by_group: DataFrame) -> DataFrame:
    def conv(g):
        return F.max(F.when(F.col("group") == g, F.col("conversion")))

    p = by_group.groupBy("business_id").agg(conv("hot").alias("hc"), conv("warm").alias("wc"), conv("cold").alias("cc")).where("hc is not null and wc is not null and cc is not null")
    return p.select("business_id", ((F.col("hc") > F.col("wc")) & (F.col("wc") > F.col("cc"))).alias("hot_over_warm_over_cold"), (F.abs(F.col("hc") - F.col("wc")) > 0.05).alias("hot_differs_from_warm"))


def contact_attributes(rows: DataFrame) -> DataFrame:
    """What the contact-history model can see of a lead: a past purchase and how recent the last signal was."""
    b = F.col("has_bought_before")
    return rows.withColumn("previous_outcome", F.when(b, "success").otherwise("nonexistent")).withColumn("prior_contacts", F.when(b, 1).otherwise(0)).withColumn(
        "days_since_last_contact", F.when(b, F.greatest(F.lit(0), F.datediff("as_of", "last_signal"))).otherwise(999)).withColumn("contacts_this_campaign", F.lit(1))


def spearman(rows: DataFrame, part: str, x: str, y: str) -> DataFrame:
    """Rank correlation per group with average ranks on ties; null under 3 rows. Works on counts of equal values."""
    pairs = rows.groupBy(part, x, y).agg(F.count(F.lit(1)).alias("n"))

    def ranks(c, out):
        cum = two_level_cumsum(pairs.groupBy(part, c).agg(F.sum("n").alias("m")), [part], c, {"cum": "m"})
        return cum.select(part, c, (F.col("cum") - (F.col("m") - 1) / 2).alias(out))

    r = pairs.join(ranks(x, "ra"), [part, x]).join(ranks(y, "rb"), [part, y])
    n, a, b = F.col("n"), F.col("ra"), F.col("rb")
    s = r.groupBy(part).agg(F.sum("n").alias("leads"), F.sum(n * a).alias("sa"), F.sum(n * b).alias("sb"), F.sum(n * a * b).alias("sab"), F.sum(n * a * a).alias("saa"), F.sum(n * b * b).alias("sbb"))
    k = F.col("leads")
    num = F.col("sab") - F.col("sa") * F.col("sb") / k
    den = F.sqrt((F.col("saa") - F.col("sa") * F.col("sa") / k) * (F.col("sbb") - F.col("sb") * F.col("sb") / k))
    return s.select(part, "leads", F.when((k >= 3) & (den > 0), half_even(num / den, 3)).alias("spearman"))


def challenger(rows: DataFrame) -> DataFrame:
    """Learning rows with the contact-history model's probability."""
    return mdl.with_probability(contact_attributes(rows))


def direction_checks(by_segment: DataFrame) -> DataFrame:
    """Which design directions a conversion profile supports."""
    def conv(seg, val):
        return F.max(F.when((F.col("segment") == seg) & (F.col("value") == val), F.col("conversion")))

    p = by_segment.agg(conv("page_value", "page_value > 0").alias("hi"), conv("page_value", "page_value = 0").alias("lo"),
                       conv("visitor_type", "New_Visitor").alias("new"), conv("visitor_type", "Returning_Visitor").alias("old"))
    return p.select(F.explode(F.array(
        F.struct(F.lit("intent outweighs light interest").alias("direction"), (F.col("hi") > 5 * F.col("lo")).alias("supported")),
        F.struct(F.lit("new people behave differently").alias("direction"), (F.col("new") != F.col("old")).alias("supported")))).alias("d")).select("d.*")
