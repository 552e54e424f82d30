"""WARC archives: a writer with revisit records and a splittable reader.

Each record is a gzip member of its own. The reader deals byte ranges of the
files to tasks: a task scans its range for the gzip magic, validates a candidate
by decoding the record header behind it, and owns the records that start inside
its range, reading on past its end to finish the last one. Ranges need no index
and any task can be run again.

Files are opened through pyarrow's filesystems, so the folder may be a shared
mount or a store that pyarrow knows. A writing task puts its file under a new
name and names it in its result; files of failed attempts are never read.

The reader computes length and digest of each response's payload anew; where the
header says otherwise the record is damaged, and the read fails by name. A revisit
has those of the payload it stands for in its header.

Edge cases: null html counts as an empty payload; of records with equal payloads
of at least ``min_bytes`` bytes that with the smallest page_id is the response,
the others revisit it. Where several rows have that page_id, the response is the
one with the first url, of entire rows that repeat any one, and the rest
revisit it. Smaller payloads are responses; rows with a null page_id are written
with an empty record id and come back as null, revisits where another row has
the payload and a page_id, else responses; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, passing, python_ready, stored

MAGIC = b"\x1f\x8b\x08"
READ = 1 << 20
SPLIT = 16 << 20
FILES = "path string, n_bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, path string, start long"


def _open(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, full_digest: str, full_bytes: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit carries no payload."""
    kind = "revisit" if refers_to is not None else "response"
    of = lambda i: f"<urn:page:{'' if i is None else i}>"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", of(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    fields += [("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Payload-Digest", f"sha1:{full_digest}"), ("X-Payload-Length", str(full_bytes))]
    if refers_to is not None:
        fields += [("WARC-Refers-To", of(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (b"" if refers_to is not None else payload)
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + pack.flush()


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size = None, f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    system, at = _open(path)
                    system.create_dir(at.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(at, compression=None)
                payload = (html or "").encode("utf-8", "surrogatepass")
                data = record(page_id, url, payload, digest(payload), len(payload), refers_to)
                size += len(data)
                out.write(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], ["path", "n_bytes"])

    return write


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to) of each row; refers_to is set for revisits."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    key = F.unhex(F.sha2(F.col("html").cast("binary"), 256))
    keyed = rows.where(F.octet_length("html") >= min_bytes).select(key.alias("key"), "page_id", "url")
    counted = keyed.groupBy("key", "page_id", "url").agg(F.count(F.lit(1)).alias("n"))
    # A null page_id is never referred to, the smallest of the others is.
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "n"))
    first = counted.groupBy("key").agg(F.min(known).alias("f"), F.sum("n").alias("all")).where("`all` > 1 AND f IS NOT NULL")
    first = stored(first.select("key", F.col("f.page_id").alias("first"), F.col("f.url").alias("at"), F.col("f.n").alias("n")), "payloads")
    if first.isEmpty():
        return rows.withColumn("refers_to", F.lit(None).cast("long"))
    joined = rows.withColumn("key", F.when(F.octet_length("html") >= min_bytes, key)).join(first, "key", "left")
    leads = F.col("page_id").eqNullSafe(F.col("first")) & F.col("url").eqNullSafe(F.col("at"))
    refers = F.when(F.col("first").isNotNull() & ~leads, F.col("first"))
    out = ["page_id", "url", "html"]
    if first.where("n > 1").isEmpty():
        return joined.select(*out, refers.alias("refers_to"))
    # Entire rows that repeat: one of them, by a number that is stored with it, is the response.
    again = F.col("first").isNotNull() & leads & (F.col("n") > 1)
    same = stored(joined.where(again).select(*out, "key", F.monotonically_increasing_id().alias("row")), "repeated")
    lead = stored(same.groupBy("key").agg(F.min("row").alias("lead")), "leads").withColumnRenamed("key", "of")
    one = same.join(lead, F.col("key") == F.col("of")).select(*out, F.when(F.col("row") != F.col("lead"), F.col("page_id")).alias("refers_to"))
    return joined.where(~again).select(*out, refers.alias("refers_to")).unionByName(one)


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives under ``folder``; returns (path, n_bytes) of the files."""
    spark = pages.sparkSession
    python_ready(spark)
    return stored(revisits(pages, min_bytes).mapInArrow(_writer(folder), FILES), "archives")


def _number(value: str) -> int | None:
    value = value.removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def _header(data: bytes) -> tuple[dict[str, str], int] | None:
    """The fields of a WARC header and where it ends, if ``data`` begins with one."""
    if not data.startswith(b"WARC/1."):
        return None
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]
    fields = dict(line.split(": ", 1) for line in lines if ": " in line)
    return (fields, end + 4) if "WARC-Type" in fields and fields.get("Content-Length", "").isdigit() else None


class _Window:
    """Bytes of a file from ``base`` on, read forward as asked for."""

    def __init__(self, file, base: int) -> None:
        self.file, self.base, self.data, self.ended = file, base, b"", False
        file.seek(base)

    def need(self, upto: int) -> None:
        while self.base + len(self.data) < upto and not self.ended:
            more = self.file.read(READ)
            self.ended = not more
            self.data += more

    def drop(self, upto: int) -> None:
        if upto - self.base >= READ:
            self.data, self.base = self.data[upto - self.base :], upto


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The decoded gzip member that begins at ``at`` and its end; None if it isn't a record."""
    unpack, parts, pos, checked = zlib.decompressobj(31), [], at, False
    try:
        while not unpack.eof:
            window.need(pos + 1)
            chunk = window.data[pos - window.base : pos - window.base + (1 << 16)]
            if not chunk:
                return None
            parts.append(unpack.decompress(chunk))
            pos += len(chunk)
            if not checked and len(head := b"".join(parts)) >= 8:
                if not head.startswith(b"WARC/1."):
                    return None
                checked = True
    except zlib.error:
        return None
    return b"".join(parts), pos - len(unpack.unused_data)


def read_range(path: str, start: int, end: int) -> Iterator[tuple]:
    """The records of ``path`` that begin in [start, end)."""
    system, at = _open(path)
    with system.open_input_file(at) as file:
        window, pos = _Window(file, start), start
        while pos < end:
            window.need(min(pos + READ, end + len(MAGIC) - 1))
            found = window.data.find(MAGIC, pos - window.base)
            if found < 0:
                pos = max(pos, window.base + len(window.data) - len(MAGIC) + 1)
                if window.ended or window.base + len(window.data) >= end + len(MAGIC) - 1:
                    return
                continue
            begin = window.base + found
            if begin >= end:
                return
            got = _member(window, begin)
            parsed = got and _header(got[0])
            if not parsed:
                pos = begin + 1
                continue
            fields, body = parsed
            block = got[0][body : body + int(fields["Content-Length"])]
            payload = block.partition(b"\r\n\r\n")[2]
            refers = fields.get("WARC-Refers-To")
            said = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if not refers and said != (len(payload), digest(payload)):
                raise ValueError(f"{path}: the record at byte {begin} has not the payload that its header names")
            yield (
                _number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], _number(refers) if refers else None,
                *said, None if refers else payload, path, begin,
            )
            pos = got[1]
            window.drop(pos)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            rows, size = [], 0
            for row in read_range(path, start, end):
                rows.append(row)
                size += len(row[6] or b"")
                if len(rows) >= 500 or size >= 8 << 20:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)


def read(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """All records of ``files`` (path, n_bytes), one task for each ``split`` bytes or so."""
    starts = files.where("n_bytes > 0").select("path", F.explode(F.expr(f"sequence(0L, n_bytes - 1, {split}L)")).alias("start"), "n_bytes")
    ranges = stored(starts.select("path", "start", F.least(F.col("start") + split, "n_bytes").alias("end")), "ranges")
    tasks = max(1, ranges.count())
    return ranges.repartition(tasks, "path", "start").mapInArrow(_reader, RECORDS)


def round_trip(pages: DataFrame, min_bytes: int = 0, split: int = SPLIT) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and read them back."""
    spark = pages.sparkSession
    return read(write(pages, passing(spark, new_path(spark, "warc")), min_bytes), split)
