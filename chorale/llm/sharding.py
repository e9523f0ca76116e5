"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered in the order of (id, crc32, size), the number is permuted within [0, rows) by a keyed Feistel network
over the next power of four (walking until the value falls below rows), and the permuted number p gives
shard p mod shards and slot p div shards: counts differ by one at most, slots have no gap, and shard and slot of any
row number can be computed, or traced back, without the data. Only ids, sizes and checksums move; texts stay.

Defined results: a null text has size `overhead` and checksum 0; null ids come first; repeated rows are rows of their
own (equal ones may swap numbers, and those equal in all three lie in one range of the numbering: three numbers a row); extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm._common import mixed, numbered

ROUNDS = 6


def _half_bits(rows: int) -> int:
    return max(1, ((max(rows, 2) - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, bits: int, key: int, rounds: range) -> np.ndarray:
    low = np.uint64((1 << bits) - 1)
    forward = rounds.step > 0
    left, right = x >> np.uint64(bits), x & low
    for r in rounds:
        salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (1 << 64) - 1)
        if forward:
            left, right = right, left ^ (mixed(right ^ salt) & low)
        else:
            left, right = right ^ (mixed(left ^ salt) & low), left
    return left << np.uint64(bits) | right


def permute(numbers: np.ndarray, rows: int, key: int, *, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of [0, rows), or its inverse, at the numbers given."""
    bits, rounds = _half_bits(rows), range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    out = _network(numbers.astype(np.uint64), bits, key, rounds)
    while (outside := out >= rows).any():
        out[outside] = _network(out[outside], bits, key, rounds)
    return out.astype(np.int64)


def shard_and_slot(numbers: np.ndarray, rows: int, shards: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    p = permute(numbers, rows, key)
    return p % shards, p // shards


def _deal(batches: Iterator[pa.RecordBatch], rows: int, shards: int, key: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shard, slot = shard_and_slot(batch.column(batch.num_columns - 1).to_numpy(), rows, shards, key)
        out = batch.drop_columns(["row_number"])
        yield out.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(slot))


def shard(docs: DataFrame, *, shards: int, key: int = 1, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row; the law is `rows`, so grown_shard is null."""
    text = F.col(text_col).cast("string")
    meta = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    ordered = numbered(meta, ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "row_number")
    rows = (ordered.agg(F.max("row_number")).first()[0] or 0) + 1  # of the table that numbering wrote, not of the input
    schema = f"doc_id {meta.schema['doc_id'].dataType.simpleString()}, size long, text_crc32 long, shard int, slot long"
    dealt = ordered.mapInArrow(lambda b: _deal(b, rows, shards, key), schema)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
