"""WARC archives: a writer, and a splittable reader.

Each record is a gzip member of its own. The writer lets Spark's text sink write the members, so that the commit protocol of
any Hadoop file system applies: a member always ends in a zero byte (the high byte of its length, or an empty member
added after one of 16 MB or more), which the sink adds as its line end.

The reader deals the archives' byte ranges over tasks, whatever the files' sizes. A task scans its range for the gzip
magic, validates each candidate by decoding it up to the WARC header, owns the records that start inside its range, and
reads past its end to finish the last. A magic inside a member is passed over, since members are decoded from one end to the next;
the one at the start of a range is refused unless it decodes to a WARC header. A header may have any length, as it holds
the url.

Records with equal payloads: the one with the largest id is a response, the others are revisits that refer to it. A
revisit's HTTP header keeps the payload's length, so what a revisit stands for is read without a join.

Defined results: a null html has an empty payload; a null url an empty target; a null page id takes part in its group, is
written as `null` and is a revisit wherever the group has another id; of rows that share the largest id each is a response.
Extra columns are ignored; an empty table gives an empty table. A record that breaks off, or that begins as WARC and has no end of
its header, stops the reader with an error. Ids are whole numbers or cast to them.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.llm._common import width, work_dir

MAGIC = b"\x1f\x8b\x08"
LEVEL = 4
RANGE = 16 << 20
BLOCK = 1 << 18
#: A digest's pages, and pages without an id, are dealt over so many parts of a join.
SALTS = 32
_EMPTY = zlib.compressobj(1, zlib.DEFLATED, 31)
EMPTY_MEMBER = _EMPTY.compress(b"") + _EMPTY.flush()
PREFIX = "urn:x-page:"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    return out if out.endswith(b"\0") else out + EMPTY_MEMBER


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload  # a revisit's HTTP header keeps the payload's length
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{PREFIX}{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~' + chr(39))}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([f"WARC-Refers-To: <{PREFIX}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            out = []
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                out.append(member(record(page_id, url, payload, refers_to))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def write(pages: DataFrame, path: str) -> None:
    """A response or revisit record for each row of pages(page_id, url, html), as archives in the folder path.

    Ids and digests are grouped and, where a digest has several pages, joined back to its members salt by salt; only
    the revisits' ids and digests then meet the pages, by id, so a payload that many pages share fills no task.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = rows.select("page_id", F.sha1(payload).alias("sha"))
    groups = keyed.groupBy("sha").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).filter("n > 1 and largest is not null").drop("n")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = keyed.distinct().withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["sha", "salt"])
    revisits = members.filter(~F.col("page_id").eqNullSafe(F.col("largest"))).select("page_id", F.col("sha").alias("_sha"), F.col("largest").alias("refers_to"))
    # null ids are one key: they are dealt over salts by the partition that they are read in
    spread = F.when(F.col("page_id").isNull(), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(0)
    copies = F.when(F.col("page_id").isNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    revisits = revisits.withColumn("_salt", F.explode(copies)).withColumnRenamed("page_id", "_page_id")
    keyed_rows = rows.withColumn("_sha1", F.sha1(payload)).withColumn("_spread", spread)
    same = F.col("page_id").eqNullSafe(F.col("_page_id")) & (F.col("_sha1") == F.col("_sha")) & (F.col("_spread") == F.col("_salt"))
    records = keyed_rows.join(revisits.hint("merge"), same, "left").select("page_id", "url", "html", "refers_to")
    members = records.mapInArrow(_members, "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.option("lineSep", "\0").text(path)
    _named(pages.sparkSession, path)


def _named(spark: SparkSession, path: str) -> None:
    """The sink's files get the names archives have."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-"):
            fs.rename(status.getPath(), hadoop.Path(folder, f"{name.split('.')[0]}.warc.gz"))


class _Source:
    """Bytes of a file from a position on, read in blocks."""

    def __init__(self, file, at: int) -> None:
        self.file, self.at, self.held = file, at, bytearray()
        file.seek(at)

    def more(self) -> bool:
        block = self.file.read(BLOCK)
        self.held += block
        return bool(block)

    def drop(self, n: int) -> None:
        del self.held[:n]
        self.at += n


def decoded(source: _Source) -> tuple[bytes, int] | None:
    """(record, compressed length) of the member at the source's position; None if it isn't a WARC record. A member that
    begins as one and breaks off or has no end of its header is an error: no record is passed over in silence."""
    z = zlib.decompressobj(31)
    out, checked, taken = bytearray(), False, 0
    while True:
        if taken == len(source.held) and not source.more():
            if checked:
                raise ValueError(f"the archive ends inside the record at byte {source.at}")
            return None
        chunk = bytes(source.held[taken : taken + BLOCK])
        taken += len(chunk)
        try:
            out += z.decompress(chunk)
        except zlib.error as e:
            if checked:
                raise ValueError(f"the record at byte {source.at} is damaged") from e
            return None
        if not checked and (len(out) >= 8 or z.eof):
            if not out.startswith(b"WARC/1."):
                return None
            checked = True
        if z.eof:
            if b"\r\n\r\n" not in out:
                raise ValueError(f"the record at byte {source.at} has no end of its header")
            return bytes(out), taken - len(z.unused_data)


def scan(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(position, record) of the records that start in [start, end)."""
    source = _Source(file, start)
    while True:
        found = source.held.find(MAGIC)
        while found < 0:
            source.drop(max(0, len(source.held) - 2))
            if source.at >= end or not source.more():
                return
            found = source.held.find(MAGIC)
        source.drop(found)
        if source.at >= end:
            return
        if one := decoded(source):
            yield source.at, one[0]
            source.drop(one[1])
        else:
            source.drop(1)


def _fields(head: bytes) -> dict[str, str]:
    parts = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in parts}


def parsed(whole: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers (names in lower case), the payload (the block without its HTTP header) and the length that the HTTP header
    gives the payload, which a revisit keeps; without one, that of the payload."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    headers = _fields(head)
    block = rest[: int(headers.get("content-length", 0))]
    if not headers.get("content-type", "").startswith("application/http"):
        return headers, block, len(block)
    http, _, payload = block.partition(b"\r\n\r\n")
    length = _fields(http).get("content-length", "")
    return headers, payload, int(length) if length.isdigit() else len(payload)


def _opened(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system.open_input_file(name)


def _page(uri: str | None) -> int | None:
    name = (uri or "").strip("<>").removeprefix(PREFIX)
    return int(name) if name.lstrip("-").isdigit() else None


def _scanned(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * payloads]
    names = ["page_id", "url", "path", "record_type", "payload_bytes", "payload_digest", "refers_to", *["payload"] * payloads]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(zip(*rows, strict=True), kinds, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names)

    for batch in batches:
        for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows, held = [], 0
            uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path
            with _opened(uri) as file:
                for _, whole in scan(file, start, end):
                    h, payload, length = parsed(whole)
                    kind = h.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    own = kind == "response"
                    mark = digest(payload) if own else h.get("warc-payload-digest", "").removeprefix("sha1:")
                    to = None if own else _page(h.get("warc-refers-to"))
                    row = _page(h.get("warc-record-id")), h.get("warc-target-uri"), path, kind, len(payload) if own else length, mark, to
                    rows.append((*row, payload if own else None) if payloads else row)
                    held += len(payload) * payloads
                    if len(rows) >= 4096 or held >= 1 << 24:
                        yield table(rows)
                        rows, held = [], 0
            if rows:
                yield table(rows)


def read(spark: SparkSession, path: str, *, payloads: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """The response and revisit records of the archives in path; payload is null in a revisit."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length").filter("length > 0")
    starts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = starts.select("path", "start", F.least(F.col("start") + range_bytes, F.col("length")).alias("end")).repartition(width(spark))
    schema = "page_id long, url string, path string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads
    return ranges.mapInArrow(lambda b: _scanned(b, payloads), schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """pages written to archives in the shared folder and read back."""
    spark = pages.sparkSession
    path = work_dir(spark)
    write(pages, path)
    return read(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
