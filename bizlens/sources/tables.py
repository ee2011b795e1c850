"""Written tables between jobs: facts feed diagnosis, diagnosis feeds actions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bizlens.session import scratch_path

#: Path and schema of the tables that `stored` has written, by application, name and state of the source folder.
_STORED: dict[tuple, tuple] = {}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: later stages scan a small table instead of repeating its
    plan, and an executor lost afterwards costs nothing that has to be recomputed."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def folder_state(spark: SparkSession, folder: str) -> tuple:
    """Name, size and time of change of every table in a folder; it changes when a table is replaced or added to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple((x.getPath().getName(), fs.getContentSummary(x.getPath()).getLength(), x.getModificationTime()) for x in fs.listStatus(path))


def stored(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` derived from the tables in `folder`: written by the first job of the application that needs it,
    read by all later ones, as orders, facts and verdicts are stages that many queries start from. It is derived anew
    when the source tables change or the written table is gone."""
    key = (spark.sparkContext.applicationId, name, folder, folder_state(spark, folder))
    if key not in _STORED or not _exists(spark, _STORED[key][0]):
        df = build()
        path = scratch_path(spark, name)
        df.write.parquet(path)
        _STORED[key] = (path, df.schema)
    path, schema = _STORED[key]
    return spark.read.schema(schema).parquet(path)


def spread_small(df: DataFrame) -> DataFrame:
    """Deal rows over all cores when the input has fewer splits than cores (a small file before costly parsing).

    A large input already has more splits than cores and passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
