"""WARC archives: written member by member, and read in parallel from byte ranges.

Every record is a gzip member of its own. The writer hands members to Spark's text writer, which
puts files through the job's commit, on any file system, and ends each line with a byte that can
be chosen: a zero. A member's last byte is the highest of its length's four, a zero below 16 MiB,
so the line's end is that byte; a longer record is followed by an empty member, which ends in a
zero. The reader cuts files into ranges. A task looks for the gzip magic from its range's start,
takes a candidate for a record only if it decodes to a WARC header, and owns the records that
start inside its range, the last of which it follows beyond the end.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm.hot import bounded, release
from lumenloom.scratch import cut, drop, new_path

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 8 << 20
_READ, _FEED = 1 << 20, 1 << 14
_BATCH_BYTES = 16 << 20
#: Bytes of ranges that a task of a large cluster reads.
TASK_BYTES = 1 << 30
#: Digests of 20 bytes and ids that are broadcast; more are joined by a shuffle.
BROADCAST_DIGESTS, SALTS = 1_000_000, 16
_EMPTY_MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
_ID = "<urn:lumenloom:page:{}>"
_OWN_ID = re.escape(_ID).replace(r"\{\}", r"(-?\d+)")
#: The type of a row for a member that doesn't inflate, or whose payload hasn't the digest that it names.
CORRUPT = "corrupt"
RECORDS = "page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit that names the response and has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    name = lambda x: _ID.format("" if x is None else x)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


def _members(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for page_id, url, html, best, revisit in zip(*batch.columns, strict=True):
                out.append(member(page_id.as_py(), url.as_py(), html.as_py().encode(), best.as_py(), revisit.as_py(), date)[:-1])
                size += len(out[-1])
                if size > _BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return run


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write a record for each row of ``pages(page_id, url, html)`` below ``path``.

    Of equal payloads of ``least_bytes`` or more the row with the largest id is the response and
    the others revisit it; shorter payloads are all responses. Null html and urls are empty. A
    null id is smaller than any other; rows that share the largest id are all responses. Other
    columns are left out; an empty table gives no record.
    """
    bounded(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    # digests are grouped without the payloads, which stay where they are read as long as the repeated ones are few
    repeated = own.groupBy("sha").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1").select("sha", "best")
    repeated = cut(repeated, "repeated")
    few = repeated.count() <= BROADCAST_DIGESTS
    both = own.join(F.broadcast(repeated), "sha", "left") if few else _salted(own, repeated)
    once = ~F.coalesce(F.octet_length("html") >= least_bytes, F.lit(False)) | F.col("best").isNull()
    revisit = ~once & ~F.col("page_id").eqNullSafe(F.col("best"))
    rows = both.select("page_id", "url", "html", "best", revisit.alias("revisit")).mapInArrow(_members(date), "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)
    drop(repeated)


def _salted(own: DataFrame, repeated: DataFrame) -> DataFrame:
    """The same join by a shuffle: each digest is dealt SALTS times, so the copies of one payload go to as many tasks."""
    salts = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return own.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salts, ["sha", "salt"], "left").drop("salt")


class _File:
    """A file behind a Hadoop-style path, read by offset and kept in a window."""

    def __init__(self, path: str):
        import pyarrow.fs as fs

        if path.startswith("file:"):
            system, path = fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
        else:
            system, path = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(path)
        self.size = self.file.size()
        self.at, self.data = 0, b""

    def read(self, at: int, n: int) -> bytes:
        """n bytes from ``at``; fewer at the file's end."""
        n = max(0, min(n, self.size - at))
        if not self.at <= at <= at + n <= self.at + len(self.data):
            self.at, self.data = at, self.file.read_at(min(max(n, _READ), self.size - at), at)
        return self.data[at - self.at : at - self.at + n]


def _starts_record(file: _File, at: int) -> bool:
    """Whether what stands here decodes as a gzip member that begins with a WARC header."""
    try:
        return zlib.decompressobj(31).decompress(file.read(at, 1024), 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _next_record(file: _File, at: int, stop: int) -> int | None:
    """The first record that starts in ``at .. stop - 1``."""
    while at < stop:
        window = file.read(at, min(_READ, stop - at + len(MAGIC) - 1))
        k = window.find(MAGIC)
        while 0 <= k < stop - at:
            if _starts_record(file, at + k):
                return at + k
            window = file.read(at, len(window))
            k = window.find(MAGIC, k + 1)
        at += max(1, len(window) - len(MAGIC) + 1)
    return None


class Corrupt(ValueError):
    """A member that doesn't inflate to its check sum."""


def _inflate(file: _File, at: int) -> tuple[bytes, int]:
    """A member's content and where it ends. ``EOFError`` if the file ends first."""
    unpacker, out = zlib.decompressobj(31), []
    while not unpacker.eof:
        chunk = file.read(at, _FEED)
        if not chunk:
            raise EOFError("a gzip member is cut off")
        try:
            out.append(unpacker.decompress(chunk))
        except zlib.error as e:
            raise Corrupt(str(e)) from e
        at += len(chunk)
    return b"".join(out), at - len(unpacker.unused_data)


def _headers(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(name: str | None) -> int | None:
    """The page that one of this writer's record ids names; ids of other writers name none."""
    found = re.fullmatch(_OWN_ID, name or "")
    return int(found[1]) if found and -(1 << 63) <= int(found[1]) < 1 << 63 else None


def _whole(text: str | None) -> int | None:
    return int(text) if text and text.strip().isdigit() else None


def parse_record(content: bytes) -> tuple:
    """A row of ``RECORDS``.

    A response's digest is computed; if the record names another SHA-1 digest, its payload isn't
    what was written: the row is of type ``corrupt`` and has the digest that the record names. Of
    other records (``warcinfo``, ``request``, ``metadata`` and so on) the size is that of the
    block and the digest the one they name, if any. Header names may come in any case and order.
    """
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = _headers(head)
    length = _whole(fields.get("content-length"))
    block = rest if length is None else rest[:length]
    http, _, payload = block.partition(b"\r\n\r\n")
    label, _, said = fields.get("warc-payload-digest", "").partition(":")
    known = said.upper() if label.lower() == "sha1" and said else None
    kind, size, body = fields.get("warc-type", ""), len(block), None
    if kind == "response":
        own, size, body = digest(payload), len(payload), payload
        if known is not None and known != own:
            kind, body = CORRUPT, None
        else:
            known = own
    elif kind == "revisit":
        size = _whole(_headers(http).get("content-length"))
    return _page(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), size, known, _page(fields.get("warc-refers-to")), body


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            file, rows, size = _File(path), [], 0
            at = _next_record(file, start, stop)
            while at is not None:
                try:
                    content, end = _inflate(file, at)
                except EOFError:  # nothing can follow in this file
                    rows.append((None, "truncated", None, None, None, None, None))
                    break
                except Corrupt:  # what it held is lost; records behind it are not
                    rows.append((None, CORRUPT, None, None, None, None, None))
                    at = _next_record(file, at + 1, stop)
                    continue
                rows.append(parse_record(content))
                size += len(content)
                if size > _BATCH_BYTES:
                    yield _table(rows)
                    rows, size = [], 0
                # the next record starts where this one ends; after anything else it is looked for
                at = end if end < stop and _starts_record(file, end) else _next_record(file, end, stop)
            if rows:
                yield _table(rows)
    release()


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of all archives below ``path``, by ranges of ``range_bytes``.

    Files without records and empty files give none; a member that is cut off gives a row of type
    ``truncated``, one that is damaged a row of type ``corrupt``, and the search goes on behind its
    first byte. Only record ids of ``write_warc`` give a page id. Ranges are dealt so that a task reads TASK_BYTES on a large set of archives.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, F.col("length")).alias("stop"))
    n, total = ranges.agg(F.count("*"), F.sum(F.col("stop") - F.col("start"))).first()  # of listed files; contents are not read
    tasks = min(n, max(spark.sparkContext.defaultParallelism * 16, -(-(total or 0) // TASK_BYTES)))
    return ranges.repartition(max(1, tasks)).mapInArrow(_ranges, RECORDS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
