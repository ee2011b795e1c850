"""Sheet files and JSON documents in; clean, quarantine and fact tables out."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.sources import records


def _names(header: bytes, sep: str, encoding: str) -> list[str]:
    text = header.decode(encoding, "replace").replace("\r\n", "\n").removesuffix("\r")
    return [n.lstrip("\ufeff").strip() for n in next(csv.reader([text], delimiter=sep))]


def read_sheet(spark: SparkSession, paths: str | Sequence[str], sep: str = ",", encoding: str = "auto") -> DataFrame:
    """All cells as trimmed text (blank = ''), with `import_id` (the file) and `source_row` (position in it, first data row = 2).

    Files are matched by column name; a column that a file lacks is blank there. Under `auto`, a file that is not valid
    UTF-8 is Latin-1. A quoted cell may span lines, and one large file is still read by many tasks (`records`). Lines end
    with a line feed; where the header's has a carriage return before it, those inside cells become line feeds. All layouts are read in one pass; one row a layout reaches the driver.
    """
    if encoding.upper().replace("_", "-").startswith(("UTF-16", "UTF-32")):
        raise ValueError("sheets are read in encodings that keep ASCII bytes")
    found, layouts = records.read_records(spark, paths, sep, encoding)
    heads = layouts.collect()
    names = {r["layout"]: _names(bytes(r["header"]), sep, encoding if encoding != "auto" else "utf-8" if r["utf8"] else "iso-8859-1") for r in heads}
    if not names:
        raise ValueError("no header row found")
    windows = F.col("layout").isin([r["layout"] for r in heads if r["header"].endswith(b"\r")])
    record = F.when(windows, F.replace("record", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("record"))
    rows = found.where("number > 0").withColumn("_c", records.cells(record, max(map(len, names.values())), sep))
    places: dict[str, dict[int, list[int]]] = {}
    for layout, columns in names.items():
        for n in dict.fromkeys(columns):
            places.setdefault(n, {}).setdefault(columns.index(n), []).append(layout)

    def cell(at: dict[int, list[int]]) -> Column:
        held = [F.when(F.col("layout").isin(keys), F.col(f"_c.c{i}")) for i, keys in at.items()]
        return F.coalesce(F.trim(F.coalesce(*held)), F.lit(""))

    return rows.select(F.col("file").alias("import_id"), (F.col("number") + 1).alias("source_row"), *[cell(at).alias(n) for n, at in places.items()])


def batch_ids(spark: SparkSession, paths: str | Sequence[str], kind: str) -> DataFrame:
    """Identity of each uploaded file from its content, with the short form that people see."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", batch_id(F.col("content"), kind).alias("import_id"), batch_label(F.col("content"), kind).alias("label"))


def batch_id(content: Column, kind: str) -> Column:
    """Key of an upload: kind and the whole SHA-1 of its bytes."""
    return F.concat(F.lit(f"imp_{kind}_"), F.sha1(content))


def batch_label(content: Column, kind: str) -> Column:
    """The identity cut to 8 hex digits; never a key, as different files may share one."""
    return F.substring(batch_id(content, kind), 1, len(f"imp_{kind}_") + 8)


def read_documents(spark: SparkSession, paths, schema: str, explode: str | None = None) -> DataFrame:
    """Nested JSON documents; `explode` names a list field whose entries become rows."""
    docs = spark.read.schema(schema).json(paths, multiLine=True)
    return docs.select(F.explode(explode).alias("item")).select("item.*") if explode else docs


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace only the partitions present in `df`; rows are gathered per partition value first, salted so that one
    large business is written by several tasks."""
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c not in by]), F.lit(16))
    df.repartition(*[F.col(c) for c in by], salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
