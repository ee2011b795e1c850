"""WARC archives: deduplicating writer, and a reader that salvages what follows damaged bytes."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm.common import text_or_empty, written
from bizlens.session import scratch_path

# Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
END = b"\r\n\r\n"
CUT = "gzip member cut off"


@dataclass(frozen=True)
class Settings:
    """`file_bytes`: an archive is closed at this size, which bounds what a reading task holds."""
    file_bytes: int = 16 << 20
    min_revisit_bytes: int = 100
    level: int = 3
    date: str = "2024-01-01T00:00:00Z"


# ---- records


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record with its block digest and length; line breaks in header values become spaces."""
    lines = [f"{k}: {' '.join(v.splitlines())}" for k, v in headers]
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + END + block + END


def _parse(raw, at: int) -> tuple[dict, bytes, int]:
    """Headers, block and end of the record at `at`; ValueError names the failed check."""
    if raw[at:at + len(VERSION)] != VERSION:
        raise ValueError("no version line")
    head_end = raw.find(END, at)
    if head_end < 0:
        raise ValueError("headers not closed")
    headers = {}
    for line in raw[at:head_end].split(b"\r\n")[1:]:
        name, sep, value = line.partition(b":")
        if not sep:
            raise ValueError("bad header line")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit() or "warc-type" not in headers:
        raise ValueError("length or type missing")
    start = head_end + len(END)
    end = start + int(length)
    if raw[end:end + len(END)] != END:
        raise ValueError("block not closed")
    block = raw[start:end]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha256:") and digest[7:] != hashlib.sha256(block).hexdigest():
        raise ValueError("block digest differs")
    return headers, block, end + len(END)


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """Content and end of the gzip member at `at`; of a damaged one what comes before the damage, how far that was read,
    and what failed."""
    d, out, pos = zlib.decompressobj(31), [], at
    try:
        while not d.eof and pos < len(data):
            out.append(d.decompress(data[pos:pos + 65536]))
            pos += 65536
    except zlib.error:
        return *_before_damage(data, at), "bad gzip member"
    if not d.eof:
        return b"".join(out), len(data), CUT
    return b"".join(out), min(pos, len(data)) - len(d.unused_data), ""


def _before_damage(data: bytes, at: int) -> tuple[bytes, int]:
    """What a member that does not decompress gives up to the byte that fails; the slice with that byte is read bytewise."""
    d, out, pos, step = zlib.decompressobj(31), [], at, 65536
    while True:
        kept = d.copy() if step > 1 else None
        try:
            out.append(d.decompress(data[pos:pos + step]))
            pos += step
        except zlib.error:
            if kept is None:
                return b"".join(out), pos
            d, step = kept, 1


def _inside(raw: bytes) -> Iterator[tuple[str, int, int, str, dict, bytes]]:
    """As `salvage`, for the content of a member, where only version lines start a record."""
    pos, start, reason = 0, None, ""
    while 0 <= pos < len(raw):
        try:
            headers, block, end = _parse(raw, pos)
        except ValueError as e:
            if start is None:
                start, reason = pos, str(e)
            pos = raw.find(VERSION, pos + 1)
            continue
        if start is not None:
            yield "gap", start, pos - start, reason, {}, b""
            start = None
        yield "record", pos, end - pos, "", headers, block
        pos = end
    if start is not None:
        yield "gap", start, len(raw) - start, reason, {}, b""


def _read_at(data: bytes, at: int) -> tuple[list[tuple], int, str]:
    """Rows of the member or the plain record at `at`, where it ends, and what damaged it. ValueError if it has content
    and no record in it passes. A damaged member gives only records whose digest was compared, and a cut one not the
    record at the cut."""
    if data[at:at + 3] != MAGIC:
        headers, block, end = _parse(data, at)
        return [("record", at, end - at, "", headers, block)], end, ""
    raw, end, damage = _member(data, at)
    rows = []
    for kind, x, n, reason, h, block in _inside(raw):
        if kind == "record" and damage and not h.get("warc-block-digest", "").startswith("sha256:"):
            kind, reason = "gap", "no digest in a damaged member"
        elif kind == "record" and damage == CUT and x + n == len(raw):
            kind, reason = "gap", damage
        rows.append((kind, at, end - at, "", h, block) if kind == "record" else (kind, at + x, n, reason, {}, b""))
    if (raw or damage) and not any(r[0] == "record" for r in rows):
        raise ValueError(damage or rows[0][3])
    return rows, end, damage


def salvage(data: bytes) -> Iterator[tuple[str, int, int, str, dict, bytes]]:
    """("record", offset, length, "", headers, block) and ("gap", offset, length, reason, {}, b"") in file order.

    Where a check fails, the next member or version line that passes all checks is searched for, and the bytes up to it
    are one gap, named after the first failed check. In a member the search goes on inside its content: a gap there has
    the member's offset plus the inner one and its length in the content. Records of a damaged member come before the
    gap that runs from the member's start to what is found next.
    """
    pos, start, reason = 0, None, ""
    taken, reach = [], 0  # records of the last damaged member, and how far its bytes were read
    while pos < len(data):
        try:
            rows, end, damage = _read_at(data, pos)
        except ValueError as e:
            if start is None:
                start, reason = pos, str(e)
            pos = _next(data, pos + 1)
            continue
        if pos < reach and data[pos:pos + 3] != MAGIC and rows[0][4:] in taken:  # the member holds it uncompressed
            pos = _next(data, end)
            continue
        if start is not None:
            yield "gap", start, pos - start, reason, {}, b""
            start = None
        yield from rows
        if damage:
            start, reason, taken, reach = pos, damage, [r[4:] for r in rows if r[0] == "record"], end
            pos = _next(data, pos + 1)
        else:
            pos = end
    if start is not None:
        yield "gap", start, len(data) - start, reason, {}, b""


def _next(data: bytes, at: int) -> int:
    """Where the next member or version line may start; the end if there is none."""
    return min([x for x in (data.find(MAGIC, at), data.find(VERSION, at)) if x >= 0], default=len(data))


# ---- Spark jobs


def _open(path: str):
    """Store and folder of a path. Its streams need compression=None, as they would go by the ending .gz themselves."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def digests(pages: DataFrame, s: Settings = Settings(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every page with its payload digest and length and the role of its record.

    Of equal payloads of `min_revisit_bytes` or more the smallest id is the response; counting combines on the map
    side. Rows that repeat that id are all responses. A null id is never the response of others; a group of null ids
    only has responses only.
    """
    html = text_or_empty(html_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html"),
                        F.octet_length(html).cast("bigint").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest"))
    groups = (rows.where(F.col("payload_bytes") >= s.min_revisit_bytes).groupBy("payload_digest")
              .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"), F.first("payload_bytes").alias("payload_bytes")).where("_n > 1"))
    # the length is in the key so that both sides are dealt anew and a hot payload can be split while it runs
    out = rows.join(groups.drop("_n"), ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return out.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, F.col("_first")).alias("refers_to"))


def _writer(folder: str, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        system, base = _open(folder)
        done: list[tuple[str, int, int]] = []
        sink = name = None
        size = count = 0

        def close():
            nonlocal sink, size, count
            if sink is not None:
                sink.close()
                done.append((name, count, size))
                sink, size, count = None, 0, 0

        for b in batches:
            cols = [b.column(c) for c in ("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")]
            for i in range(b.num_rows):
                page, url, html, length, digest, first = (c[i].as_py() for c in cols)
                block = b"" if first is not None else html.encode()
                headers = [("WARC-Type", "revisit" if first is not None else "response"),
                           ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url}')}>"), ("WARC-Date", s.date),
                           ("WARC-Target-URI", url), ("Content-Type", "text/html"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Payload-Length", str(length))]
                headers += [("Page-ID", str(page))] * (page is not None)
                if first is not None:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Refers-To-Page-ID", str(first))]
                z = zlib.compressobj(s.level, zlib.DEFLATED, 31)
                raw = z.compress(record(headers, block)) + z.flush()
                if sink is None:
                    name = f"part-{ctx.partitionId():06d}-{len(done):04d}-{ctx.taskAttemptId()}.warc.gz"
                    sink = system.open_output_stream(f"{base}/{name}", compression=None)
                sink.write(raw)
                size, count = size + len(raw), count + 1
                if size >= s.file_bytes:
                    close()
        close()
        if done:
            names, counts, sizes = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["name", "records", "bytes"])
    return run


def write_archives(rows: DataFrame, folder: str, s: Settings = Settings()) -> DataFrame:
    """Write `digests` rows as archives into `folder`, tasks side by side; the manifest (name, records, bytes) is a
    written table. Names hold the task attempt, and only attempts that ended are in the manifest, so files of lost or
    repeated attempts are never read."""
    system, base = _open(folder)
    system.create_dir(base)
    return written(rows.mapInArrow(_writer(folder, s), "name string, records long, bytes long"), "warc-manifest")


RECORDS = ("kind string, path string, offset long, length long, reason string, page_id string, record_type string, url string, "
           "payload_digest string, payload_bytes long, refers_to string, block binary")


def _rows(path: str, data: bytes) -> Iterator[tuple]:
    for kind, at, n, reason, h, block in salvage(data):
        if kind == "gap":
            yield kind, path, at, n, reason, None, None, None, None, None, None, None
        else:
            revisit = h["warc-type"] == "revisit"
            digest = h.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(block).hexdigest()
            size = int(h["payload-length"]) if revisit and h.get("payload-length", "").isdigit() else len(block)
            yield (kind, path, at, n, None, h.get("page-id"), h["warc-type"], h.get("warc-target-uri"), digest, size, h.get("refers-to-page-id"), block)


def _batches(rows: Iterator[tuple], with_block: bool) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]
    buffer: list[tuple] = []
    held = 0

    def batch():
        cols = list(zip(*buffer))
        if not with_block:
            cols[-1] = (None,) * len(buffer)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    for r in rows:
        buffer.append(r)
        held += len(r[-1] or b"")
        if held > 8 << 20 or len(buffer) >= 5000:
            yield batch()
            buffer, held = [], 0
    if buffer:
        yield batch()


def _complete(name: str, records: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """The rows of an archive; ValueError at a gap, or at the end where their number is not the manifest's."""
    n = 0
    for r in rows:
        if r[0] == "gap":
            raise ValueError(f"{name}: {r[4]} at {r[2]}")
        n += 1
        yield r
    if n != records:
        raise ValueError(f"{name}: {n} records read, {records} written")


def read_written(manifest: DataFrame, folder: str, with_block: bool = True, complete: bool = False) -> DataFrame:
    """Records and gaps of the archives in a manifest; each task reads whole archives of a bounded size. With `complete`
    a gap, or another number of records than the manifest has, fails the query."""
    def run(batches):
        system, base = _open(folder)
        for b in batches:
            for name, records in zip(b.column("name").to_pylist(), b.column("records").to_pylist()):
                with system.open_input_stream(f"{base}/{name}", compression=None) as f:
                    rows = _rows(name, f.read())
                yield from _batches(_complete(name, records, rows) if complete else rows, with_block)
    n = max(1, manifest.count())
    return manifest.select("name", "records").repartition(min(n, 1 << 16), "name").mapInArrow(run, RECORDS)


def read_archives(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """Records and gaps of all archives below `path`, in any store that Spark reads."""
    def run(batches):
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content")):
                yield from _batches(_rows(name, data.as_py()), with_block)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, s: Settings = Settings(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page as a record, read the archives back, and give page_id, payload_bytes, payload_digest,
    record_type and refers_to as the archives have them.

    Null payloads are empty; null ids come back null. Rows that repeat an id give a record each. Extra columns are
    ignored; an empty table gives an empty result. An archive that is damaged or short when it is read fails the query.
    """
    kind = pages.schema[id_col].dataType
    folder = scratch_path(pages.sparkSession, "llm-warc")
    manifest = write_archives(digests(pages, s, id_col, url_col, html_col), folder, s)
    got = read_written(manifest, folder, with_block=False, complete=True)
    return got.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                                               F.col("refers_to").cast(kind).alias("refers_to"))
