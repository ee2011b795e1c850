"""Small helpers of the operators: shared folders, written tables, input columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.session import scratch_path

#: ASCII white space, as a character class and as the characters themselves.
BLANK = r"\x20\x09-\x0D"
BLANK_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go as soon as each has ended, as nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back, which cuts the lineage and survives lost executors."""
    return written_for_now(df, name)[0]


def written_for_now(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """As `written`, with what deletes the table once nothing is left to read it."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    with shuffles_freed(spark):
        df.write.parquet(path)

    def drop() -> None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return spark.read.schema(df.schema).parquet(path), drop


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n
