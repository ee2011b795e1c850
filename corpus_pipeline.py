"""A training corpus from `documents`: drop toxic texts, exact and near copies, mix the sources, pack into sequences.

Every stage decides on rows, not on ids: rows that repeat an id with another text are documents of their own, and of rows
that agree in id and text one stays. Null texts are empty: one empty document passes the exact stage. A null id is an id
like others. Columns other than COLUMNS are dropped; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm import exact_dedup, jaccard_join, mixing, packing
from bizlens.llm import toxicity as tox
from bizlens.llm.common import table
from bizlens.llm.queries import MAX_PASSES, tokenizer
from bizlens.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_row(docs: DataFrame) -> DataFrame:
    """`docs` with _row, a hash of id and text: together with the id it tells rows apart."""
    return docs.select(*COLUMNS, F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("_row"))


def node_of(rows: DataFrame) -> Column:
    """A number of its own for every row of `rows` (with _row), in the order of the ids wherever they leave room for it:
    copies mostly follow their original, and the Jaccard join compares with the smallest of a group first. The bits
    below the id come from _row; where they do not tell all rows apart, or the ids leave none, it is _row itself."""
    span = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, high = span["low"] or 0, span["high"] or 0
    room = 62 - (high + 1 - low).bit_length()
    if room >= 8:
        node = F.shiftleft(F.coalesce(F.col("doc_id"), F.lit(high + 1)) - F.lit(low), room).bitwiseOR(F.col("_row").bitwiseAND(F.lit((1 << room) - 1)))
        if rows.groupBy(node.alias("_node")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return node
    return F.col("_row")


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """`docs` (with _row) without the rows in `dropped` (id, row), and each of the others once."""
    gone = dropped.select(F.col("doc_id").alias("_id"), F.col("row").alias("_gone")).distinct()
    rest = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (docs["_row"] == gone["_gone"]), "left_anti")
    return rest.dropDuplicates(["doc_id", "_row"]).select(*COLUMNS)


def rows_at_a_time(spark: SparkSession, n: int) -> None:
    """Rows in an Arrow batch from now on: few where whole texts go to Python workers and back, more where a stage
    reduces each batch to something small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on all labels of documents at hand, does not call toxic."""
    rows_at_a_time(spark, 1_000)
    settings = tox.Settings()
    sample = tox.sample_labels(table(spark, sf_dir, "labels"), F.lit(True), settings)
    train = docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(sample), "doc_id").select("_order", "_label", "_text")
    return tox.keep_clean(docs, tox.fit(train, settings), settings).select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of texts that are equal without white space."""
    rows = with_row(docs)
    return without(rows, exact_dedup.exact_dedup(rows, row_col="_row").where("not kept").select("doc_id", "row"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of every group of linked documents (a row without an id only where no other is in the group)."""
    rows_at_a_time(spark, 1_000)
    rows = with_row(docs)
    node = node_of(rows)
    found = jaccard_join.jaccard_join(rows.withColumn("_node", node), id_col="_node").select(F.col("doc_id").alias("node"), "component_id")
    groups = found.where("node <> component_id").select("component_id").distinct()
    members = found.join(groups, "component_id").join(rows.select(node.alias("node"), "doc_id", F.col("_row").alias("row")), "node").drop("node").distinct()
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"))
    return without(rows, members.join(first, "component_id").where(F.col("row") != F.col("first.row")).select("doc_id", "row"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources again until the weights or the limit of passes are met."""
    return mixing.mix_sources(docs, max_passes=MAX_PASSES).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a training sequence."""
    rows_at_a_time(spark, 1_000)
    return packing.pack_documents(docs, tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("source mixing", mix),
    ("best-fit packing", pack),
]

#: The fitted classifier, the link graph and the tokenizer have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(docs: DataFrame, stage) -> DataFrame:
        path = scratch_path(spark, "pipeline")
        stage[1](spark, docs, sf_dir).write.parquet(path)
        return spark.read.parquet(path)

    return reduce(step, STAGES, table(spark, sf_dir, "documents"))
