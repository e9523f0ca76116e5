"""What a message store's raw columns hold, as columns: times, texts in binary archives, links, identifiers."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from 1970 to 2001, above which a value counts nanoseconds, and class names that are no text.
EPOCH_2001, NANOSECONDS = 978307200, 10**12
CLASS_NAMES = ("NSString", "NSAttributedString", "NSDictionary", "NSObject", "NSNumber", "NSMutableString", "NSMutableAttributedString", "streamtyped")
_RUN = re.compile(rb"[\x20-\x7e]+")


def unix_seconds(date: Column) -> Column:
    """Seconds or nanoseconds since 2001 -> epoch seconds."""
    return F.when(date > NANOSECONDS, F.floor(date / 1_000_000_000)).otherwise(date).cast("bigint") + EPOCH_2001


def url_in(payload: Column) -> Column:
    """The first run of printable characters that begins with http, where it is a whole link."""
    run = F.regexp_extract(F.decode(payload, "ISO-8859-1"), "http[\\x20-\\x7e]*", 0)
    return F.when(run.rlike("^https?://[^\\s]+$"), run)


def bare_guid(guid: Column) -> Column:
    """A reaction's target without its part prefix (p:0/..., bp:...)."""
    return F.regexp_replace(guid, "^(p:[0-9]+/|bp:)", "")


def handle_key(handle: Column) -> Column:
    """E-mail addresses in lower case; numbers by their last ten digits."""
    digits = F.regexp_replace(handle, "[^0-9]", "")
    return F.when(handle.contains("@"), F.lower(F.trim(handle))).otherwise(F.right(digits, F.lit(10)))


def media_flags(mime: Column) -> Column:
    kind = F.coalesce(F.lower(mime), F.lit(""))
    return F.struct(kind.startswith("image/").cast("int").alias("is_image"), kind.startswith("video/").cast("int").alias("is_video"))


def archived_text(blob: bytes | None) -> str | None:
    """The text of a typed stream: after a class mark and a plus sign stands a length of one, two or four bytes, then
    UTF-8. A string with many control characters is passed over; without any, the longest printable run is taken."""
    if blob is None or len(blob) < 16:
        return None
    for mark in re.finditer(b"NSString", blob):
        plus = blob.find(b"+", mark.end(), mark.end() + 17)
        head = blob[plus + 1 : plus + 6]
        if plus < 0 or not head:
            continue
        wide = {0x81: 2, 0x82: 4}.get(head[0], 0)
        if head[0] >= 0x80 and not wide or len(head) < 1 + wide:
            continue
        size = int.from_bytes(head[1 : 1 + wide], "little") if wide else head[0]
        body = blob[plus + 2 + wide : plus + 2 + wide + size]
        if not size or len(body) < size:
            continue
        text = body.decode("utf-8", "replace")
        if sum(c < "\t" or "\r" < c < " " for c in text) <= max(2, len(text) / 50):
            return text
    runs = [r.decode() for r in _RUN.findall(blob) if r.decode() not in CLASS_NAMES]
    longest = max(runs, key=len, default="")
    return longest if len(longest) >= 2 else None


def text_of(blob: Column) -> Column:
    """`archived_text` as a column: its byte search has no counterpart among built-in functions."""

    def decode(x: pa.Array) -> pa.Array:
        return pa.array([archived_text(v) for v in x.to_pylist()], pa.string())

    return F.arrow_udf(decode, "string")(blob)
