"""Records of delimited text whose quoted cells may hold line breaks, read by many tasks a file.

A block (split) starts at a line, but whether that line starts a record or goes on inside a quoted cell depends on all
earlier blocks. So the first scan reads every block under both assumptions and keeps a row a block: the state in which
each assumption ends, and how many records end under it. Composing these over the blocks of a file gives every block
its true state and the number of records before it; the second scan then cuts records and numbers them. A record
across blocks comes out in pieces under one number, which are joined; no other text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bizlens.sources.tables import materialise

BLOCKS = "file string, block long, inside_after_start long, inside_after_inside long, ends_after_start long, ends_after_inside long, utf8 boolean, header binary"
PIECES = "file string, number long, layout long, whole boolean, block long, record string"
#: Blocks that may travel to every task (about 100 bytes each); with more, lines are joined with them by file and block.
SMALL_TABLE = 500_000


def still_inside(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether a quoted cell is open after `line`, given whether one was open before it.

    A quote opens a cell only as its first character; two quotes inside are one literal quote. A quote that is followed
    by anything but blanks and the separator is stray: the rest of the cell is plain text."""
    at = 0
    while True:
        if not inside:
            if line[at:at + 1] != b'"':
                at = line.find(sep, at)
                if at < 0:
                    return False
                at += len(sep)
                continue
            at += 1
        at = line.find(b'"', at)
        if at < 0:
            return True
        if line[at + 1:at + 2] == b'"':
            at, inside = at + 2, True
            continue
        at = line.find(sep, at + 1)
        if at < 0:
            return False
        at, inside = at + len(sep), False


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(file, block, columns after these) of every line, in order."""
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def _utf8(line: bytes) -> bool:
    if line.isascii():
        return True
    try:
        line.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _summaries(sep: bytes):
    names = [f.split(" ")[0] for f in BLOCKS.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 5, pa.bool_(), pa.binary()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, ends, open_, utf8, header, lead = None, [], [], [], True, None, []
        for file, block, line in _lines(batches):
            if (file, block) != now:
                if now:
                    yield out([(*now, *map(int, state), *ends, utf8, header)])
                # whether a record has begun, under either assumption: only then does an empty line go on with it
                now, state, ends, open_, utf8, header, lead = (file, block), [False, True], [0, 0], [False, True], True, None, []
            utf8 = utf8 and _utf8(line)
            filled, quoted = line not in (b"", b"\r"), b'"' in line
            if block == 0 and header is None and (lead or filled):
                lead.append(line)
            for i in (0, 1):
                if quoted:
                    state[i] = still_inside(line, state[i], sep)
                open_[i] = open_[i] or filled
                if open_[i] and not state[i]:
                    ends[i] += 1
                    open_[i] = False
            if lead and header is None and not state[0]:
                header = b"\n".join(lead)
        if now:
            yield out([(*now, *map(int, state), *ends, utf8, header)])
    return run


def _cut(sep: bytes, encoding: str):
    names = [f.split(" ")[0] for f in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, now, held = [], 0, None, []

        def piece(whole: bool) -> int:
            raw = b"\n".join(held)
            text = raw.decode(codec, "replace")
            rows.append((now[0], number, layout, whole, now[1], text.removesuffix("\r") if whole else text))
            held.clear()
            return len(raw)

        def out() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for file, block, line, starts_inside, before, utf8, key in _lines(batches):
            if (file, block) != now:
                if held:
                    size += piece(False)
                if starts_inside is None:
                    raise ValueError(f"block {block} of {file} was not there in the first scan: the file or the size of splits changed")
                now, layout, inside, number, broken = (file, block), key, bool(starts_inside), before, bool(starts_inside)
                codec = encoding if encoding != "auto" else "utf-8" if utf8 else "iso-8859-1"
            if b'"' in line:
                inside = still_inside(line, inside, sep)
            if not (held or broken) and line in (b"", b"\r"):
                continue
            held.append(line)
            if not inside:
                size += piece(not broken)
                number, broken = number + 1, False
                if size > 4 << 20 or len(rows) >= 10_000:
                    yield out()
                    rows, size = [], 0
        if held:
            piece(False)
        if rows:
            yield out()
    return run


def _resolved(blocks: DataFrame) -> DataFrame:
    """State at both ends and number of earlier records of every block; of its file, whether it is UTF-8 throughout, the header
    and a key of it.

    A block keeps the state, flips it, or sets it whatever it was; the state is that of the last setting block before,
    flipped as often as blocks after that one flip. One row a block is sorted by file."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("inside_after_start") == F.col("inside_after_inside")
    flips = F.when(~sets & (F.col("inside_after_start") == 1), 1).otherwise(0)
    counted = blocks.withColumn("_flips", F.sum(flips).over(Window.partitionBy("file").orderBy("block")))
    last = F.last(F.when(sets, F.struct("inside_after_start", "_flips")), ignorenulls=True).over(before)
    flipped = F.coalesce(F.last("_flips").over(before), F.lit(0)) - F.coalesce(last["_flips"], F.lit(0))
    state = counted.withColumn("starts_inside", F.pmod(F.coalesce(last["inside_after_start"], F.lit(0)) + flipped, F.lit(2)))
    told = state.select("file", "block", "starts_inside", "utf8", "header", *[
        F.when(F.col("starts_inside") == 1, F.col(f"{c}_after_inside")).otherwise(F.col(f"{c}_after_start")).alias(c) for c in ("inside", "ends")])
    file = Window.partitionBy("file")
    head = F.max("header").over(file)  # only the first block of a file has one
    utf8 = F.min("utf8").over(file)
    return told.select("file", "block", "starts_inside", F.col("inside").alias("ends_inside"), F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("before"),
                       utf8.alias("utf8"), "header", F.xxhash64(head, utf8).alias("layout"))


def read_records(spark: SparkSession, paths, sep: str = ",", encoding: str = "auto", small_table: int = SMALL_TABLE) -> tuple[DataFrame, DataFrame]:
    """(records, layouts): `file`, `number` (from 0, the header row included), `layout` and `record` (the raw text) of every record,
    and `layout`, `header` (bytes) and `utf8` of every distinct header row.

    Lines end with a line feed or carriage return and line feed, inside cells too. Empty lines between records do not count. A quoted cell that never ends takes the rest of its file. Under `auto`, a file
    that is not valid UTF-8 anywhere is Latin-1 as a whole; other encodings must keep ASCII bytes as they are.
    """
    cut = sep.encode("ascii")
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line")]
    lines = spark.read.option("lineSep", "\n").text(paths).select(*meta)
    blocks = materialise(_resolved(materialise(lines.mapInArrow(_summaries(cut), BLOCKS), "sheet-splits")), "sheet-blocks")
    few = blocks.count() <= small_table

    def pieces(of: DataFrame) -> DataFrame:
        states = of.select("file", "block", "starts_inside", "before", "utf8", "layout")
        if few:
            told = lines.join(F.broadcast(states), ["file", "block"], "left" if of is blocks else "inner")
        else:
            told = lines.withColumn("_at", F.monotonically_increasing_id()).join(states, ["file", "block"], "left" if of is blocks else "inner")
            told = told.sortWithinPartitions("file", "block", "_at")
        return told.select("file", "block", "line", "starts_inside", "before", "utf8", "layout").mapInArrow(_cut(cut, encoding), PIECES)

    columns = ["file", "number", "layout", "record"]
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "record"))), lambda p: p["record"])
    across = pieces(blocks.where("starts_inside = 1 or ends_inside = 1")).where("not whole")
    broken = across.groupBy("file", "number", "layout").agg(F.regexp_replace(F.array_join(parts, "\n"), "\r$", "").alias("record"))
    return pieces(blocks).where("whole").select(*columns).unionByName(broken.select(*columns)), blocks.where("header is not null").select("layout", "header", "utf8").distinct()


def cells(record: Column, n: int, sep: str) -> Column:
    """The first `n` cells of a record as a struct c0, c1, ...; those it lacks are null."""
    return F.from_csv(record, ", ".join(f"c{i} string" for i in range(n)), {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
