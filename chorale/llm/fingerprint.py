"""Document fingerprints from prefix polynomial hashes.

A text's code points are hashed once into two prefix arrays, modulo the primes P and Q. A span's hash is then two
subtractions and two products, so any two spans are compared in constant time, and the longest common extension of
two positions is found by binary search. The fingerprint holds the text's length, its whole hash, and a sketch for each of
its layers: the SKETCH least distinct hashes of its spans of a window's length (a shorter text is one span). All texts
have a layer of WINDOW code points; short ones have finer layers besides (LAYERS). Equal texts have equal
fingerprints; the share of common values among the least of both, in the finest layer that two fingerprints have in
common, estimates the likeness of two texts.

Every row also gets what span equality and common extensions say of its edited text and of the next one: how many
code points the text and its edited form have in common from the start, how many the text and the next one, and
whether the edited text's end is the next one's start.

`with_next` gives every row the row after it in descending id. Rows are dealt over ranges of ids; each range gets a copy
of the next range's first row, so the texts move once and no task holds more than a row and its neighbour.

Defined results: a null text is empty; the empty text has an empty sketch and likeness 1 to itself alone. Repeated rows and
rows of one id follow one another in the order of their texts. Null ids come last. A table of one row is its own
neighbour. Extra columns are ignored; an empty table gives an empty table. Ids are whole numbers or cast to them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm._common import mixed, width

WINDOW = 24
SKETCH = 64
#: (window, the texts of fewer code points that have this layer too), ever finer.
LAYERS = ((4, 512), (1, 8))
#: Two primes and a base for each.
P, Q = 2147483647, 2147483629
BASES = (1103515245, 1566083941)

_STEPS: dict[int, np.ndarray] = {}


def _powers(which: int, n: int) -> np.ndarray:
    """Powers of a base (0, 1) or of its inverse (2, 3), by doubling."""
    have = _STEPS.get(which)
    if have is None or len(have) < n:
        mod = (P, Q)[which % 2]
        base = BASES[which % 2] if which < 2 else pow(BASES[which % 2], -1, mod)
        have = np.ones(1, dtype=np.uint64)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), mod)) % np.uint64(mod)])
        _STEPS[which] = have
    return have[:n]


class PrefixHash:
    """Prefix arrays of a text's code points; `head` of another one are taken over for its first code points."""

    def __init__(self, points: np.ndarray, head: PrefixHash | None = None, kept: int = 0) -> None:
        self.n, self.prefix = len(points), []
        for which, mod in enumerate((P, Q)):
            terms = (points[kept:].astype(np.uint64) + np.uint64(1)) * _powers(which, self.n)[kept:] % np.uint64(mod)
            out = np.empty(self.n + 1, dtype=np.uint64)
            out[: kept + 1] = head.prefix[which][: kept + 1] if head is not None else 0
            np.cumsum(terms, out=out[kept + 1 :])
            out[kept + 1 :] += out[kept]
            out[kept + 1 :] %= np.uint64(mod)
            self.prefix.append(out)

    def whole(self) -> tuple[int, int]:
        return int(self.prefix[0][-1]), int(self.prefix[1][-1])

    def spans(self, width: int, start: int = 0) -> np.ndarray:
        """64-bit values of all spans of a width from start on, brought to power 0: equal in any texts where the spans are."""
        n = self.n - width + 1
        if n <= start:
            return np.zeros(0, dtype=np.uint64)
        out = []
        for which, mod in enumerate((P, Q)):
            m, prefix = np.uint64(mod), self.prefix[which]
            difference = (prefix[start + width :] + m - prefix[start:n]) % m
            out.append(difference * _powers(which + 2, n)[start:] % m)
        return out[0] << np.uint64(32) | out[1]

    def equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        """Whether the spans of a length at i and, in other, at j are equal."""
        for which, mod in enumerate((P, Q)):
            a = (int(self.prefix[which][i + length]) - int(self.prefix[which][i])) * pow(BASES[which], j, mod)
            b = (int(other.prefix[which][j + length]) - int(other.prefix[which][j])) * pow(BASES[which], i, mod)
            if (a - b) % mod:
                return False
        return True

    def common_extension(self, i: int, other: PrefixHash, j: int) -> int:
        """The length of the longest span that begins at i here and at j in other, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(i, other, j, middle):
                low = middle
            else:
                high = middle - 1
        return low


def points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")


def windows(n: int) -> list[int]:
    """The windows of a text of n code points, coarse to fine."""
    return [WINDOW, *(window for window, below in LAYERS if n < below)]


def span_values(h: PrefixHash, window: int) -> np.ndarray:
    return mixed(h.spans(min(window, h.n))) if h.n else np.zeros(0, dtype=np.uint64)


def least(values: np.ndarray) -> np.ndarray:
    """The SKETCH least distinct values, ascending."""
    n = len(values)
    if n > 8 * SKETCH:
        bound = np.uint64(min((1 << 64) - 1, int((1 << 64) * (3 * SKETCH / n))))
        few = np.unique(values[values <= bound])
        if len(few) >= SKETCH:
            return few[:SKETCH]
    return np.unique(values)[:SKETCH]


def written(h: PrefixHash, sketches: list[np.ndarray]) -> str:
    a, b = h.whole()
    return ".".join([f"{h.n:x}", f"{a:08x}{b:08x}", *(s.astype(">u8").tobytes().hex() for s in sketches)])


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of common values among the least of both sketches of the finest common layer; 1 for equal
    fingerprints."""
    if a == b:
        return 1.0
    layers = list(zip(a.split(".")[2:], b.split(".")[2:], strict=False))[-1]
    x, y = ({s[i : i + 16] for i in range(0, len(s), 16)} for s in layers)
    if not x or not y:
        return 0.0
    both = sorted(x | y)[: max(len(x), len(y))]
    return sum(v in x and v in y for v in both) / len(both)


class Print:
    """A text's hash, span values and fingerprint."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""
        self.points = points(self.text)
        self.hash = PrefixHash(self.points)
        self.values = span_values(self.hash, WINDOW)
        finer = [span_values(self.hash, w) for w in windows(self.hash.n)[1:]]
        self.fingerprint = written(self.hash, [least(v) for v in (self.values, *finer)])

    def edited(self, other: str) -> tuple[str, PrefixHash, str]:
        """The text with its last third replaced by the start of other, its hash and fingerprint; the kept part's hashes are
        taken over."""
        n = self.hash.n
        kept = n - n // 3
        text = self.text[:kept] + other[: n // 3]
        h = PrefixHash(points(text), self.hash, kept)
        if min(h.n, n, kept) < WINDOW:
            values = span_values(h, WINDOW)
        else:
            old = kept - WINDOW + 1
            values = np.concatenate([self.values[:old], mixed(h.spans(WINDOW, old))])
        finer = [span_values(h, w) for w in windows(h.n)[1:]]
        return text, h, written(h, [least(v) for v in (values, *finer)])


KINDS = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(), "near_next": pa.float64(), "common_edited": pa.int64(), "common_next": pa.int64(), "edited_by_next": pa.bool_(),
}


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, with each range's copy of its next row last (halo)."""
    rows: list[tuple] = []
    last: tuple | None = None

    def done(one: Print, following: Print) -> tuple:
        text, h, edited = one.edited(following.text)
        kept = one.hash.n - one.hash.n // 3
        return (
            one.hash.n, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), one.fingerprint, edited,
            likeness(one.fingerprint, edited), likeness(one.fingerprint, following.fingerprint),
            one.hash.common_extension(0, h, 0), one.hash.common_extension(0, following.hash, 0), h.equal(kept, following.hash, 0, h.n - kept),
        )

    def table() -> pa.RecordBatch:
        columns = zip(zip(*rows, strict=True), KINDS.values(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], list(KINDS))

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            for bucket, halo, doc_id, text in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("_range", "_halo", "doc_id", "text")), strict=True):
                if halo and (last is None or last[0] != bucket):
                    continue  # this range's last row has met its neighbour already
                one = Print(text)
                if last is not None and last[0] == bucket:
                    rows.append((last[1], *done(last[2], one)))
                last = None if halo else (bucket, doc_id, one)
            if len(rows) >= 512:
                yield table()
                rows = []
    if rows:
        yield table()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_edited, common_next and
    edited_by_next for every row."""
    spark = docs.sparkSession
    n = 2 * width(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shares = [i / n for i in range(1, n)]
    cuts = sorted(set(base.agg(F.percentile_approx("doc_id", shares, 20 * n).alias("c")).first()["c"] or []), reverse=True)
    # range 0 has the largest ids; null ids go to the last
    steps = F.lit(len(cuts))
    for_ids = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c >= F.col("doc_id"))), steps)
    ranged = base.withColumn("_range", F.when(F.col("doc_id").isNull(), steps).otherwise(for_ids).cast("int"))
    tops = sorted((r["_range"], r["top"]) for r in ranged.groupBy("_range").agg(F.max("doc_id").alias("top")).collect())  # a row per range
    before = {tops[i][0]: (tops[i - 1][0], tops[i][1]) for i in range(len(tops))}
    halos = spark.createDataFrame([(r, to, top) for r, (to, top) in before.items()] or [(-1, -1, -1)], "_range int, _to int, _top long")
    copies = ranged.join(F.broadcast(halos), "_range")
    places = F.array(
        F.struct(F.col("_range").alias("_range"), F.lit(False).alias("_halo")),
        F.when(F.col("doc_id").eqNullSafe(F.col("_top")), F.struct(F.col("_to").alias("_range"), F.lit(True).alias("_halo"))),
    )
    dealt = copies.select("doc_id", "text", F.explode(F.filter(places, lambda x: x.isNotNull())).alias("_place")).select("_place.*", "doc_id", "text")
    sorted_rows = dealt.repartitionById(n, F.col("_range")).sortWithinPartitions("_range", "_halo", F.col("doc_id").desc_nulls_last(), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return sorted_rows.mapInArrow(_prints, schema + ", common_edited long, common_next long, edited_by_next boolean")
