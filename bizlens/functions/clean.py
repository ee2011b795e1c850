"""Column expressions that read one messy cell: header text, dates, money, whole numbers and dictionary words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: accepted date layouts, in the order they are tried; word lists; limits
ISO_LAYOUTS = ("yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s'Z'", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m", "yyyy-M-d")
DAY_FIRST_LAYOUTS = ("d/M/yyyy H:m:s", "d/M/yyyy H:m", "d/M/yyyy", "d-M-yyyy H:m", "d-M-yyyy", "d/M/yy")
UNIT_REPAIR_LIMIT = 15000
PAID_CHANNELS = ("instagram", "google")

CHANNEL_WORDS = {
    "instagram": "instagram", "ig": "instagram", "insta": "instagram", "instagram ads": "instagram",
    "google": "google", "google ads": "google", "google cpc": "google", "adwords": "google", "cpc": "google",
    "email": "email", "e mail": "email", "newsletter": "email",
    "whatsapp": "whatsapp", "wa": "whatsapp", "whatsapp business": "whatsapp",
    "": "website", "direct": "website", "none": "website", "website": "website", "organic": "website", "web": "website",
    "referral": "referral", "friend": "referral", "friends": "referral",
    "instagram dm": "instagram_dm", "website form": "website_form",
}
PAYMENT_WORDS = {"cod": "cod", "cash on delivery": "cod", "upi": "prepaid", "card": "prepaid", "prepaid": "prepaid",
                 "razorpay": "prepaid", "netbanking": "prepaid", "wallet": "prepaid"}
STATUS_WORDS = {"delivered": "delivered", "rto": "rto", "returned to origin": "rto", "returned": "returned",
                "return": "returned", "cancelled": "cancelled", "canceled": "cancelled"}
STAGE_WORDS = {"new": "new", "qualified": "qualified", "won": "won", "lost": "lost", "closed won": "won", "closed lost": "lost"}
FRIEND_WORDS = ("friend", "family", "relative", "classmate")
STRANGER_WORDS = ("stranger", "new", "found", "insta", "online", "cold", "unknown person", "saw your", "reel", "discovered")
FRIEND_OF_FRIEND_WORDS = ("friend of", "friends friend", "friend s friend", "mutual")
# ---- end of fixed values


def norm_header(text: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def layout_shape(layout: str) -> str:
    """Regular expression of the texts a layout can read, e.g. `d/M/yyyy` -> one or two digits, slash, ..."""
    return re.sub("yyyy|yy|[MdHms]", lambda m: {"yyyy": r"\d{4}", "yy": r"\d{2}"}.get(m.group(), r"\d{1,2}"), layout.replace("'", ""))


def any_shape(layouts: tuple) -> str:
    return "^(?:" + "|".join(layout_shape(p) for p in sorted(layouts, key=len)) + r")\z"


def parse_date(text: Column) -> Column:
    """Struct(ts, iso): the moment and whether it was written in an ISO layout; ts is null when it is no date.

    The layouts' shapes do not overlap. A cell of one of them is brought into ISO order and cast, which reads digits
    without a formatter, raises nothing for a day that does not exist, and stays small enough for the JVM to compile.
    """
    t = F.trim(text)
    year_last = F.regexp_replace(t, r"^(\d{1,2})[/-](\d{1,2})[/-](\d+)", "$3-$2-$1")
    # two-digit years from 69 on belong to the 1900s
    short = F.concat(F.when(F.substring_index(t, "/", -1).try_cast("int") < 69, "20").otherwise("19"), year_last)
    iso = F.when(t.rlike(any_shape(ISO_LAYOUTS)), F.replace(t, F.lit("Z"), F.lit("")).try_cast("timestamp"))
    day_first = F.when(t.rlike(any_shape(DAY_FIRST_LAYOUTS)), F.when(t.rlike(any_shape(("d/M/yy",))), short).otherwise(year_last).try_cast("timestamp"))
    return F.struct(F.coalesce(iso, day_first).alias("ts"), iso.isNotNull().alias("iso"))


def parse_money(text: Column) -> Column:
    """Amount without currency marks and thousands commas; null for blank, text or negative."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, "(?i)(₹|rs\\.?|inr)", ""), ",", ""))
    v = F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), bare.try_cast("double"))
    # most cells are blank or plain digits, for which nothing has to be taken out
    return F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?\z"), text.try_cast("double")).when(text != "", F.when(v >= 0, v))


def is_minor_units(amount: Column) -> Column:
    """An order amount that only makes sense divided by 100."""
    return (amount > UNIT_REPAIR_LIMIT) & (amount % 100 == 0) & (amount / 100 <= UNIT_REPAIR_LIMIT)


def dictionary(text: Column, words: dict, default: str) -> Column:
    """Normalised word looked up in a small fixed table, as a map literal."""
    pairs = []
    for k, v in words.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.create_map(*pairs)[norm_header(text)], F.lit(default))


def relationship(text: Column) -> Column:
    return relationship_of(norm_header(text))


def relationship_of(t: Column) -> Column:
    """How the buyer knows the seller, from normalised text; friend of a friend is tested before friend, friend before stranger."""

    def has(words):
        out = F.lit(False)
        for w in words:
            out = out | t.contains(w)
        return out

    fof = has(FRIEND_OF_FRIEND_WORDS) | F.array_contains(F.split(t, " "), "fof")
    return (F.when(t == "", "unknown").when(fof, "friend_of_friend").when(has(FRIEND_WORDS), "friend")
            .when(has(STRANGER_WORDS), "stranger").otherwise("unknown"))
