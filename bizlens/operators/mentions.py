"""Which product of its business a message asks for: an inverted index of character n-grams over the words of product
names, then an exact search for the name that shares most words with the message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.functions import text as tx
from bizlens.sources.tables import materialise

GRAM = 3  # telling words have at least as many characters
KEY = ["business_id", "msg_no"]


def grams(text: Column) -> Column:
    """The different character n-grams of a text."""
    at = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(at, lambda i: F.substr(text, i, F.lit(GRAM)))))


def name_tokens(products: DataFrame) -> DataFrame:
    """business_id, pos, name and tokens of each product: its telling words, each with the number of its occurrence in
    the name ("red#1", "red#2"), so that a word that a name repeats counts as often."""
    words = tx.name_words(F.col("name"))
    numbered = F.transform(words, lambda w, i: F.concat(w, F.lit("#"), (F.size(F.filter(F.slice(words, 1, i + 1), lambda x: x == w))).cast("string")))
    return products.select("business_id", F.col("first_key").alias("pos"), "name", numbered.alias("tokens")).where(F.size("tokens") > 0)


def token_table(named: DataFrame) -> DataFrame:
    """business_id, token, word, n_products and first (position and name of its first product) of every token."""
    t = named.select("business_id", F.explode("tokens").alias("token"), F.struct(F.col("pos"), F.col("name")).alias("at"))
    return (t.groupBy("business_id", "token").agg(F.count(F.lit(1)).alias("n_products"), F.min("at.pos").alias("pos"))
            .withColumn("word", F.substring_index("token", "#", 1)))


def word_index(tokens: DataFrame) -> DataFrame:
    """business_id, gram, word: every word under the one of its n-grams that fewest words of the business have."""
    words = tokens.select("business_id", "word").distinct()
    pairs = words.select("business_id", "word", F.explode(grams(F.col("word"))).alias("gram"))
    found_in = pairs.groupBy("business_id", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = pairs.join(found_in, ["business_id", "gram"]).groupBy("business_id", "word").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    return rarest.select("business_id", "gram", "word")


def words_in(texts: DataFrame, index: DataFrame) -> DataFrame:
    """business_id, low (text) and words: the indexed words that each text holds anywhere. Only n-grams and a hash of the
    text meet the index; candidates are then looked for in the text itself."""
    keyed = texts.withColumn("_id", F.xxhash64("business_id", "low"))
    asked = keyed.select("business_id", "_id", F.explode(grams(F.col("low"))).alias("gram"))
    maybe = asked.join(index, ["business_id", "gram"]).groupBy("business_id", "_id").agg(F.collect_set("word").alias("_maybe"))  # as many as fit in a text
    met = keyed.join(maybe, ["business_id", "_id"]).withColumn("words", F.filter("_maybe", lambda w: F.contains(F.col("low"), w)))
    return met.where(F.size("words") > 0).select("business_id", "low", F.array_sort("words").alias("words"))


def best_products(asked: DataFrame, named: DataFrame, tokens: DataFrame) -> DataFrame:
    """business_id, words, product: for each set of words the product with most tokens among them, then the first.

    With n tokens matched, a product that shares h of them has one of the n - h + 1 rarest. So the products of the rarest
    token are looked at first; the best of them says how many further tokens can hold a better one, or one as good that
    comes earlier. A product that shares a single token is the first of some token, which the token table knows. Lists of
    frequent tokens are read only where nothing rarer decides.
    """
    t = tokens.select("business_id", "word", F.struct("n_products", "token", "pos").alias("t"))
    sets = (asked.select("business_id", "words", F.explode("words").alias("word")).join(t, ["business_id", "word"])
            .groupBy("business_id", "words").agg(F.array_sort(F.collect_list("t")).alias("ts")))
    sets = materialise(sets.select("business_id", "words", F.transform("ts", lambda x: x["token"]).alias("tokens"), F.size("ts").alias("n"),
                                   F.array_min(F.transform("ts", lambda x: x["pos"])).alias("single")), "asked-words")
    lists = materialise(named.select("business_id", F.explode("tokens").alias("token"), "pos", F.col("tokens").alias("own")), "product-lists")

    def search(rows: DataFrame) -> DataFrame:
        """The best product (shared tokens, minus position) among those of `token`."""
        shared = F.size(F.array_intersect("tokens", "own"))
        return (rows.join(lists, ["business_id", "token"]).groupBy("business_id", "words")
                .agg(F.max(F.struct(shared.alias("hits"), (-F.col("pos")).alias("minus"))).alias("best")))

    first = search(sets.where("n > 1").select("business_id", "words", "tokens", F.element_at("tokens", 1).alias("token")))
    more = sets.join(first, ["business_id", "words"]).withColumn("upto", F.col("n") - F.greatest(F.col("best.hits"), F.lit(2)) + 1)
    again = search(more.where("upto > 1").select("business_id", "words", "tokens", F.explode(F.slice("tokens", 2, F.col("upto") - 1)).alias("token")))
    single = sets.select("business_id", "words", F.struct(F.lit(1).alias("hits"), (-F.col("single")).alias("minus")).alias("best"))
    best = single.unionByName(first).unionByName(again).groupBy("business_id", "words").agg(F.max("best").alias("best"))
    names = named.groupBy("business_id", "pos").agg(F.max("name").alias("product"))
    return best.select("business_id", "words", (-F.col("best.minus")).alias("pos")).join(names, ["business_id", "pos"]).select("business_id", "words", "product")


def mentions(messages: DataFrame, products: DataFrame) -> DataFrame:
    """business_id, msg_no, product of every message that names one.

    A product counts the words of its name (three characters and more, without plain ones) that the message holds in
    any case, inside longer words too; most hits win, then the earliest product. Texts are looked up once each, however
    many messages repeat them. Null texts and products without telling words match nothing.
    """
    named = materialise(name_tokens(products), "product-tokens")
    tokens = materialise(token_table(named), "token-table")
    read = messages.select(*KEY, F.lower("text").alias("low")).where("low is not null")
    texts = materialise(words_in(read.select("business_id", "low").distinct(), word_index(tokens)), "text-words")
    best = best_products(texts.select("business_id", "words").distinct(), named, tokens)
    found = texts.join(best, ["business_id", "words"]).select("business_id", "low", "product")
    return read.join(found, ["business_id", "low"]).select(*KEY, "product")
