"""Best-fit packing of token sequences by exact-complement hashing.

Lengths are packed, not pieces: the histogram of piece lengths has at most `capacity` rows, whatever the corpus, so the
plan is made on the driver. The sums of one, two and three available lengths are indexed. From the longest length down,
the gap it leaves is looked up in the index, and the combination that fills it exactly is consumed as often as
the counts allow; the index is refreshed as lengths run out. What finds no exact partner is packed best-fit, longest
first. The plan's rank ranges are then joined to the pieces' ranks within their length, which gives every piece its
sequence and place without moving texts or tokens.

Token ids are those of the `tokenizers` file byte_bpe_50k.json with add_special_tokens=False (see _tokens.py).

Defined results: a null or empty text is the end id alone. Null ids and repeated rows are packed as rows of their own;
extra columns are ignored; an empty table gives an empty table. A text of any length is encoded whole.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm._common import materialize, ranked_within
from chorale.llm._tokens import encoder

def _pieces(batches: Iterator[pa.RecordBatch], capacity: int, end_id: int, keep_ids: bool, path: str | None) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    end = np.array([end_id], dtype="<u4")
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            which, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                tokens = np.concatenate([own.ids(text).astype("<u4", copy=False), end]) if text else end
                n = len(tokens)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    which.append(i)
                    piece.append(p)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(tokens[a:b]))
                    if keep_ids:
                        ids.append(tokens[a:b].astype(np.int32))
            columns = [
                part.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)


class Sums:
    """A hash index from sums to the combinations of one, two or three available lengths that have them.

    Each sum holds its combination with the largest first length. Counts only fall, so an entry whose lengths have run
    out is replaced by the next one below it, and an entry is never looked at twice: all refreshing together costs at
    most capacity ** 2 steps for the pairs and as many for the triples.
    """

    def __init__(self, counts: np.ndarray, parts: int) -> None:
        self.counts, self.parts = counts, parts
        n = len(counts)
        self.pairs, self.triples = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)  # the first length of a sum's entry
        have = np.flatnonzero(counts)
        for a in have.tolist():
            sums = a + have[: np.searchsorted(have, a, side="right")]
            self.pairs[sums[sums < n]] = a
        some = np.flatnonzero(self.pairs)
        for a in have.tolist():
            sums = a + some[some < n - a]
            self.triples[sums] = a

    def _pair(self, total: int, but: int = 0) -> tuple[int, int] | None:
        """Two available lengths with this sum, one of length `but` put aside."""
        a = int(self.pairs[total])
        while 2 * a >= total > 0 and a:
            b = total - a
            if b and self.counts[a] > (a == b) and self.counts[b]:
                break
            a -= 1
        self.pairs[total] = a if 2 * a >= total else 0
        while 2 * a >= total > 0 and a:  # entries that fail for `but` alone stay in the index
            b = total - a
            if b and self.counts[a] > (a == b) + (a == but) and self.counts[b] > (b == but):
                return a, b
            a -= 1
        return None

    def find(self, total: int) -> tuple[int, ...] | None:
        """Available lengths, at most `parts`, with this sum."""
        if total > 0 and self.counts[total]:
            return (total,)
        if self.parts > 1 and (pair := self._pair(total)):
            return pair
        a = int(self.triples[total]) if self.parts > 2 else 0
        while a:
            if self.counts[a] and (pair := self._pair(total - a, a)):
                break
            a -= 1
        self.triples[total] = a if self.parts > 2 else 0
        return (a, *pair) if a else None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, how many such sequences) for a histogram of lengths: of the plans that fill gaps with
    up to three, two or one, that with the fewest sequences."""
    return min((_planned(histogram, capacity, parts) for parts in (3, 2, 1)), key=lambda made: sum(n for _, n in made))


def _planned(histogram: dict[int, int], capacity: int, parts: int) -> list[tuple[tuple[int, ...], int]]:
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    made: list[tuple[tuple[int, ...], int]] = []
    left: dict[int, int] = {}
    if counts[capacity]:
        made.append(((capacity,), int(counts[capacity])))
        counts[capacity] = 0
    sums = Sums(counts, parts)
    for top in range(capacity - 1, 0, -1):
        while counts[top]:
            counts[top] -= 1
            found = sums.find(capacity - top)
            counts[top] += 1
            if found is None:  # nor will it later: counts only fall
                left[top] = int(counts[top])
                counts[top] = 0
                break
            pattern = (top, *found)
            times = min(int(counts[x]) // pattern.count(x) for x in set(pattern))
            made.append((pattern, times))
            for x in pattern:
                counts[x] -= times
    return made + _best_fit(left, capacity)


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over (length, count): the open sequences are kept by their gap."""
    gaps: list[int] = []
    held: dict[int, dict[tuple[int, ...], int]] = {}

    def put(pattern: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(pattern)
        if gap not in held:
            held[gap] = {}
            insort(gaps, gap)
        held[gap][pattern] = held[gap].get(pattern, 0) + n

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                pattern, there = held[gap].popitem()
                if not held[gap]:
                    del held[gap]
                    gaps.remove(gap)
                used = min(n, there)
                if there > used:
                    put(pattern, there - used)
                put((*pattern, length), used)
                n -= used
            else:
                each = min(n, capacity // length)
                put((length,) * each, n // each)
                n -= n // each * each
    return [(p, n) for gap in gaps for p, n in held[gap].items()]


def _placements(made: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank of each range, ascending; its first sequence; the place in the sequence."""
    ranges: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for pattern, times in made:
        offset = 0
        for length in pattern:
            ranges.setdefault(length, []).append((used.get(length, 0), base, offset))
            used[length] = used.get(length, 0) + times
            offset += length
        base += times
    return {length: tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) for length, rows in ranges.items()}


def _place(batches: Iterator[pa.RecordBatch], placed) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy()
        length, rank = get("length"), get("rank")
        sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
        for x in np.unique(length).tolist():
            rows = np.flatnonzero(length == x)
            first, base, place = placed.value[x]
            at = np.searchsorted(first, rank[rows], side="right") - 1
            sequence[rows], offset[rows] = base[at] + rank[rows] - first[at], place[at]
        out = batch.drop_columns(["rank"])
        yield out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, keep_ids: bool = False, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with keep_ids its ids."""
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    pieces = materialize(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(lambda b: _pieces(b, capacity, end_id, keep_ids, ranks_path), schema))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    placed = docs.sparkSession.sparkContext.broadcast(_placements(plan(histogram, capacity)))
    ranked = ranked_within(pieces, "length", ["doc_id", "piece", "ids_crc32"])
    order = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    return ranked.select(*order, "rank").mapInArrow(lambda b: _place(b, placed), f"{schema}, sequence_id long, offset long")
