"""Exact duplicates by progressive refinement: length, then a hash of the beginning, then the digest of all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import BLANK_CHARS, text_or_empty

PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.translate(text, BLANK_CHARS, "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One narrow row per document from one scan; the text itself never enters a shuffle.

    Columns: the id, row (what `row_col` names, else a constant), n_points (code points of the original), n_bytes (length of the normalised text in bytes),
    head (64-bit hash of its first PREFIX_CHARS characters) and text_sha256.
    """
    norm = normalised(text_or_empty(text_col))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.col(row_col) if row_col else F.lit(0)).alias("row"),
        F.length(text_or_empty(text_col)).cast("bigint").alias("n_points"),
        F.octet_length(norm).alias("n_bytes"),
        F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)).alias("head"),
        F.sha2(norm, 256).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every document.

    `row_col` may name a number that tells apart rows which repeat an id with another text: it then comes back as column
    `row`, and of equal texts under the smallest id only that with the largest number stays.

    Each step only looks at what the step before could not tell apart: lengths that occur once are settled, then
    (length, head) pairs that occur once, and only the documents left are grouped by digest. Counting combines on the
    map side, so a group that holds a third of all rows reaches the shuffle as a row per task.

    Of equal texts the one with the most code points stays, then the smallest id. Null and blank-only texts normalise
    to the empty text and are one group. Rows that repeat an id are one document: all its rows carry the same verdict,
    and each counts in group_size; if their texts differ only in white space, those with fewer code points go. A null
    id comes last in a tie. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = fingerprints(docs, id_col, text_col, row_col)
    lengths = rows.groupBy("n_bytes").agg(F.count(F.lit(1)).alias("_same")).where("_same > 1").select("n_bytes")
    heads = (rows.join(lengths, "n_bytes", "left_semi").groupBy("n_bytes", "head")
             .agg(F.count(F.lit(1)).alias("_same")).where("_same > 1").select("n_bytes", "head"))
    left = rows.join(heads, ["n_bytes", "head"], "left_semi")
    best = F.max(F.struct("n_points", (-F.col("doc_id")).alias("minus"), "row")).alias("best")
    groups = (left.groupBy("text_sha256").agg(best, F.count(F.lit(1)).alias("_size"), F.first("n_bytes").alias("n_bytes"))
              .where("_size > 1"))
    # joined on the length as well, so that both sides are dealt anew and a hot group can be split while it runs
    out = rows.join(groups, ["text_sha256", "n_bytes"], "left")
    keep = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(-F.col("best.minus"))
    stays = F.col("best").isNull() | (F.col("doc_id").eqNullSafe(keep) & (F.col("n_points") == F.col("best.n_points")) & (F.col("row") == F.col("best.row")))
    return out.select("doc_id", *(["row"] if row_col else []), keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("bigint").alias("group_size"),
                      stays.alias("kept"), "text_sha256")
