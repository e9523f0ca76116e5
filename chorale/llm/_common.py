"""What the operators of this subpackage share: durable tables, row numbers, components, streamed groups, hashed words."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# ---------------------------------------------------------------- durable tables


_OWN: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where it is unset, a session on this machine alone gets a temporary
    folder, and one on a cluster is refused: its machines would each write to a folder of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "") or ""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "root" not in _OWN:
        _OWN["root"] = tempfile.mkdtemp(prefix="chorale-")
        atexit.register(shutil.rmtree, _OWN["root"], ignore_errors=True)
    return _OWN["root"]


def work_dir(spark: SparkSession) -> str:
    """A fresh folder name in the shared folder, removed when the process ends."""
    path = f"{_root(spark)}/chorale-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may have ended: the folder is then left to the cluster's own cleaning
        pass


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, which cuts lineage and survives lost executors, and the table's folder."""
    spark = df.sparkSession
    path = work_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame) -> DataFrame:
    return stored(df)[0]


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't use, in any case."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- row numbers


def numbered(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """df with a gapless number from 0 in the order of the columns given, without a single-task window.

    A range partitioning sorts the rows, each partition counts its own, and the partitions' counts (one row per
    partition, so bounded by the partitioning) give the offsets. Rows equal in all of order may swap numbers.
    """
    spark = df.sparkSession
    n = width(spark)
    placed = materialize(
        df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order])
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
        .withColumn("_at", F.monotonically_increasing_id())
    )
    counts = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n")).collect()
    total, offsets = 0, []
    for part, rows in sorted((r["_part"], r["_n"]) for r in counts):
        offsets.append((part, total))
        total += rows
    table = spark.createDataFrame(offsets or [(0, 0)], "_part long, _offset long")
    numbered_rows = (
        placed.withColumn("_part", F.shiftright("_at", 33))
        .join(F.broadcast(table), "_part")
        .withColumn(name, F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_offset", "_at")
    )
    return numbered_rows


def ranked_within(df: DataFrame, key: str, order: list[str], name: str = "rank") -> DataFrame:
    """df with a gapless rank from 0 within each key. Hot keys are dealt over salts by the hash of the order columns;
    ranks run salt by salt, so no task sees more than a key's share of one salt."""
    spark = df.sparkSession
    salts = 4 * width(spark)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    counts = salted.groupBy(key, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = Window.partitionBy(key, "_salt").orderBy(*order)
    return (
        salted.withColumn("_local", F.row_number().over(local) - 1)
        .join(starts, [key, "_salt"])
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_salt", "_start", "_local")
    )


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the smallest node reachable.

    Each round hooks every node onto its smallest neighbour, jumps pointers once and contracts the edges; the edge
    table shrinks until none is left. Rounds are written to the shared folder, and a round's tables go when the next
    ones are written. Nothing is collected but whether a table is empty.
    """
    spark = edges.sparkSession
    both = edges.filter("a is not null and b is not null and a != b")
    both, both_at = stored(both.select("a", "b").union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels, labels_at = None, None
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).filter("node is not null").distinct()
    while True:
        hooks, hooks_at = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("to")))
        if hooks.isEmpty():
            break
        up = hooks.select(F.col("node").alias("to"), F.col("to").alias("up"))
        jumped, jumped_at = stored(hooks.join(up, "to").select("node", F.col("up").alias("to")))
        moved = labels.withColumnRenamed("component", "at") if labels is not None else nodes.select("node", F.col("node").alias("at"))
        to = jumped.select(F.col("node").alias("at"), "to")
        old_labels, old_both = labels_at, both_at
        labels, labels_at = stored(moved.join(to, "at", "left").select("node", F.coalesce("to", "at").alias("component")))
        left, right = jumped.select(F.col("node").alias("a"), F.col("to").alias("x")), jumped.select(F.col("node").alias("b"), F.col("to").alias("y"))
        contracted = both.join(left, "a").join(right, "b").filter("x != y")
        both, both_at = stored(contracted.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        for path in (hooks_at, jumped_at, old_both, old_labels):
            if path:
                remove(spark, path)
    return labels if labels is not None else nodes.select("node", F.col("node").alias("component"))


# ---------------------------------------------------------------- streamed groups


def streamed_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of whole groups from batches sorted by keys: each table holds one or more complete groups, in order.

    Only the last group of a batch waits for the next one, so memory holds a batch and one group.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        tail = tuple(c[-1] for c in columns)
        same = np.ones(batch.num_rows, dtype=bool)
        for c, value in zip(columns, tail, strict=True):
            same &= c == value
        cut = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if held and (cut or tuple(c[0] for c in columns) != last):
            if cut:
                held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
        last = tail
    if held:
        yield pa.Table.from_batches(held)


# ---------------------------------------------------------------- hashed words of whole texts

#: The white space that parts words, as bytes.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: A text slab's bytes are hashed at once, in arrays of 8 bytes for each; a longer single text makes a slab of its own.
SLAB = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES)] = True
_TABLE = np.random.Generator(np.random.Philox(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, SLAB + 1)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes and its rows' offsets in them; nulls are empty. No text becomes a Python string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=8 * column.offset)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slabs(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about SLAB bytes together, at least one row each."""
    row, n = 0, len(offsets) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLAB, side="right")) - 1)
        yield row, min(to, n)
        row = min(to, n)


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a slab, their count per row as pointers (rows + 1), and the mask of white space.

    A word's hash is a span of one prefix array of a polynomial over random byte values, brought back to power 0.
    """
    n, rows = len(data), len(offsets) - 1
    space = _SPACE[data]
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(rows + 1, dtype=np.int64), space
    power, inverse = _powers(n + 1)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_TABLE[_LOWER[data] if lower else data] * power[:n], out=prefix[1:])
    word = ~space
    begins = word.copy()
    begins[1:] &= space[:-1]
    firsts = offsets[:-1]
    firsts = firsts[firsts < n]
    begins[firsts] = word[firsts]
    ends = word.copy()
    ends[:-1] &= space[1:]
    lasts = offsets[1:] - 1
    lasts = lasts[lasts >= 0]
    ends[lasts] = word[lasts]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = mixed((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, offsets), space
