"""Text expressions: redaction, chat lines, intents and what a message asks for. Patterns and word lists are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bizlens.operators.imports import pseudonym, short_alias

# ---- fixed values
EMAIL = r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+"
PHONE = r"(?U)(?<!\d)(?:\+?91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}(?!\d)"
HANDLE = r"(?U)(?<![\w.])@([A-Za-z0-9_.]{2,30})"
APP_LINE = r"(?i)^\s*@?([A-Za-z0-9_.]{2,30})\s*\((dm|comment|story|whatsapp)\)\s*:\s*(.+)$"
EXPORT_LINE = r"(?i)^\s*\[?(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}),?\s+\d{1,2}:\d{2}(?::\d{2})?\s*(?:[ap]m)?\]?\s*(?:-\s*)?([^:]{1,40}):\s*(.+)$"
NOT_A_LEAD = (r"(?i)\b(collab(oration)?|promote|promotion|sponsor(ed)?|supplier|wholesale offer|follow back|boost your|"
              r"buy followers|ads? agency|paid partnership|dm for)\b")
BUYING = (r"(?i)\b(price|cost|how much|rate|rates|available|availability|in stock|stock|size|sizes|deliver(y|ed)?|ship(ping)?|"
          r"cod|can i (get|order|buy)|do you have|i want to (order|buy)|want to order|order)\b")
CUSTOM = r"(?i)\b(custom(ised|ized)?|personali[sz]ed|my name|name on|with my|design for me|make one)\b"
INTEREST = (r"(?i)(\bfire\b|\bwant (this|it)\b|\bneed (this|it)\b|\bso good\b|\bstunning\b|\bobsessed\b|this one|🔥|😍|\blove (this|the)\b)")
PRAISE = (r"(?i)\b(love your page|great page|nice page|awesome page|amazing page|beautiful page|love your work|good work|nice work)\b")
SIZE = r"(?i)(?:\bsize\s*(xxl|xl|xs|s|m|l)\b|\bin\s+(xxl|xl|xs|s|m|l)\b|\b(xxl|xl|xs)\b)"
CITIES = ("Pune", "Mumbai", "Delhi", "Bangalore", "Bengaluru", "Hyderabad", "Chennai", "Kolkata", "Ahmedabad", "Jaipur", "Lucknow", "Nagpur",
          "Surat", "Kochi", "Indore", "Chandigarh", "Goa", "Bhopal", "Patna")
PLAIN_WORDS = ("tee", "box", "the", "for")
INTENTS = ("buying_question", "product_interest", "general_praise", "custom_request", "not_a_lead")
EXPORT_DATES = ("d/M/yy", "d/M/yyyy", "d-M-yy", "d-M-yyyy")
# ---- end of fixed values


def redact(text: Column) -> Column:
    """E-mail addresses, then phone numbers, then @handles taken out; a handle becomes its stable alias.

    Handles are replaced between the pieces the pattern splits off, so no Python runs and the whole text is covered.
    """
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), EMAIL, "[email]"), PHONE, "[phone]")
    pieces, handles = F.split(t, HANDLE, -1), F.regexp_extract_all(t, F.lit(HANDLE), F.lit(1))
    joined = F.zip_with(pieces, handles, lambda p, h: F.concat(p, F.when(h.isNotNull(), F.concat(F.lit("@"), short_alias(h, "user"))).otherwise("")))
    return F.when(t.contains("@"), F.array_join(joined, "")).otherwise(t)


def chat_line(line: Column, default_day: Column) -> Column:
    """Struct(handle_ref, channel, date, redacted text) of a chat line in one of two layouts; null for any other line."""
    app, export = line.rlike(APP_LINE), line.rlike(EXPORT_LINE)
    raw = F.regexp_extract(line, EXPORT_LINE, 1)
    day = None
    for p in EXPORT_DATES:
        shape = "^" + p.replace("d", r"\d{1,2}", 1).replace("M", r"\d{1,2}").replace("yyyy", r"\d{4}").replace("yy", r"\d{2}") + "$"
        parsed = F.to_date(F.try_to_timestamp(raw, F.lit(p)))
        if p.count("y") == 2:
            parsed = F.when(F.year(parsed) >= 2069, F.add_months(parsed, -1200)).otherwise(parsed)
        day = F.when(raw.rlike(shape), parsed) if day is None else day.when(raw.rlike(shape), parsed)
    first = F.struct(F.concat(F.lit("@"), pseudonym(F.regexp_extract(line, APP_LINE, 1), "user")).alias("handle_ref"), F.lower(F.regexp_extract(line, APP_LINE, 2)).alias("channel"),
                     default_day.alias("date"), redact(F.trim(F.regexp_extract(line, APP_LINE, 3))).alias("text"))
    second = F.struct(F.concat(F.lit("@"), pseudonym(F.regexp_extract(line, EXPORT_LINE, 2), "user")).alias("handle_ref"), F.lit("whatsapp").alias("channel"),
                      F.coalesce(day, default_day).alias("date"), redact(F.trim(F.regexp_extract(line, EXPORT_LINE, 3))).alias("text"))
    return F.when(app, first).when(export, second)


def intents(text: Column, labelled: Column | None = None) -> Column:
    """Intent labels of a message. `labelled` may bring another labeller's array: used when it is non-empty and valid."""
    t = F.coalesce(text, F.lit(""))
    found = F.filter(F.array(F.when(t.rlike(BUYING), "buying_question"), F.when(t.rlike(CUSTOM), "custom_request"), F.when(t.rlike(INTEREST), "product_interest")),
                     lambda x: x.isNotNull())
    rules = F.when(t.rlike(NOT_A_LEAD), F.array(F.lit("not_a_lead"))).when(F.size(found) > 0, found).otherwise(F.array(F.lit("general_praise")))
    if labelled is None:
        return rules
    valid = F.coalesce((F.size(labelled) > 0) & F.forall(labelled, lambda x: x.isin(*INTENTS)), F.lit(False))
    return F.when(valid, labelled).otherwise(rules)


def asked_size(text: Column) -> Column:
    hit = F.coalesce(*[F.when(F.regexp_extract(text, SIZE, i) != "", F.regexp_extract(text, SIZE, i)) for i in (1, 2, 3)])
    return F.upper(hit)


def asked_city(text: Column, served: Column | None = None) -> Column:
    """The longest known city the message names; cities of equal length are tried in list order."""
    known = sorted(CITIES, key=len, reverse=True)
    names = F.array(*[F.lit(c) for c in known])
    if served is not None:
        extra = F.array_except(served, names)
        names = F.concat(names, extra)
        names = F.transform(F.array_sort(F.transform(names, lambda c: F.struct((-F.length(c)).alias("n"), F.array_position(F.array(*[F.lit(k) for k in known]), c).alias("p"), c.alias("c")))),
                            lambda x: x["c"])
    return F.get(F.filter(names, lambda c: F.regexp_like(text, F.concat(F.lit(r"(?i)\b\Q"), c, F.lit(r"\E\b")))), F.lit(0))


def asked_design(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike(r"(?:design|with)\s+([a-z0-9 ]{3,30}?)(?:\?|\.|,|$)") & low.contains("my name"), "custom name")


def name_words(name: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*PLAIN_WORDS))


def signals(channel: Column, labels: Column) -> Column:
    """Signals a message earns, in order."""
    has = lambda x: F.array_contains(labels, x)
    strong = F.filter(F.array(
        F.when(has("buying_question"), "price_question"), F.when(has("custom_request"), "comment"),
        F.when(has("product_interest"), F.when(channel == "story", "story_reply").otherwise("comment"))), lambda x: x.isNotNull())
    out = F.when(F.size(strong) > 0, strong).when(has("general_praise"), F.array(F.lit("follow_or_like"))).otherwise(F.array().cast("array<string>"))
    return F.when(has("not_a_lead"), F.array().cast("array<string>")).otherwise(out)
