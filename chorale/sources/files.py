"""Files beside the tables: JSON maps, JSON lines, NumPy arrays, configuration, packed artifacts; and the sinks that
write them. Paths are any that Spark's readers open, but for the small driver-side files that say so."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The largest artifact that is packed or verified whole, in bytes; it is held by one task.
ARTIFACT_BYTES = 1 << 30
NPY_MAGIC = b"\x93NUMPY"


# ---------------------------------------------------------------- sources


def _there(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop))


def json_map(spark: SparkSession, path: str, value: str = "double") -> DataFrame:
    """A JSON object as rows of (key, value); a missing or malformed file has no rows."""
    if not _there(spark, path):
        return spark.createDataFrame([], f"key string, value {value}")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file by a given schema; lines that don't parse are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_strings(text: Column) -> Column:
    """An array of strings from a JSON array; from anything else, what commas or bars part, trimmed and not empty."""
    text = F.trim(text)
    parts = F.transform(F.split(text, "[,|]"), lambda s: F.trim(s))
    loose = F.filter(parts, lambda s: s != "")
    return F.coalesce(F.when(text.startswith("["), F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))), loose, F.array().cast("array<string>"))


def npy_header(head: bytes) -> tuple[np.dtype, tuple[int, ...], int]:
    """(type, shape, where the data begin) of an array file's first bytes."""
    if not head.startswith(NPY_MAGIC):
        raise ValueError("not an array file")
    wide = head[6] >= 2
    size = int.from_bytes(head[8:12] if wide else head[8:10], "little")
    begin = (12 if wide else 10) + size
    fields = ast.literal_eval(head[begin - size : begin].decode("latin-1"))
    if fields["fortran_order"]:
        raise ValueError("columns first isn't supported")
    return np.dtype(fields["descr"]), tuple(fields["shape"]), begin


def npy(spark: SparkSession, path: str, *, rows_per_task: int = 1 << 16) -> DataFrame:
    """(row, value) of an array file: value is a number for one dimension, an array for two. Tasks read row ranges, so
    neither a task nor the driver holds the file; the driver reads its header alone."""
    with _opened(path) as file:
        kind, shape, begin = npy_header(file.read(1 << 16))
    flat = "bigint" if kind.kind in "iu" else "double"
    width = int(np.prod(shape[1:], dtype=np.int64)) if len(shape) > 1 else 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                n = min(rows_per_task, shape[0] - at)
                with _opened(path) as file:
                    file.seek(begin + at * width * kind.itemsize)
                    raw = np.frombuffer(file.read(n * width * kind.itemsize), dtype=kind).astype(np.int64 if flat == "bigint" else np.float64)
                value = pa.array(raw) if len(shape) == 1 else pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(raw))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), value], ["row", "value"])

    starts = spark.range(0, shape[0], rows_per_task, max(1, -(-shape[0] // rows_per_task)))
    return starts.mapInArrow(read, f"row bigint, value {flat if len(shape) == 1 else f'array<{flat}>'}")


def _opened(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return system.open_input_file(name)


def config(path: str | None, environment: dict[str, str], defaults: dict) -> dict:
    """Settings: the defaults, then a small driver-side JSON file's, then those of the environment (upper case, dots as
    underscores), each cast to its default's type. Unknown names are refused."""
    given = json.loads(Path(path).read_text()) if path and Path(path).exists() else {}
    if unknown := set(given) - set(defaults):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    out = defaults | given
    for name, default in defaults.items():
        if (value := environment.get(name.upper().replace(".", "_"))) is not None:
            out[name] = value.lower() in ("1", "true", "yes") if isinstance(default, bool) else value if default is None else type(default)(value)
    return out


# ---------------------------------------------------------------- sinks


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Drop, create and insert: df takes the place of the table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows inserted, or put in the place of those with their keys (null keys are equal). Of new rows that
    share their keys, the greatest stays. No row of old is moved but by its keys."""
    columns = old.columns
    latest = Window.partitionBy(*keys).orderBy(F.struct(*[c for c in columns if c not in keys]).desc() if len(columns) > len(keys) else F.lit(1))
    fresh = new.select(*columns).withColumn("_at", F.row_number().over(latest)).filter("_at = 1").drop("_at")
    gone = fresh.select(*[F.col(k).alias(f"_{k}") for k in keys])
    match = [old[k].eqNullSafe(gone[f"_{k}"]) for k in keys]
    return old.join(gone, match, "left_anti").unionByName(fresh)


def upsert(new: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """`upserted` for a stored table: written as a new version beside it and then renamed, so a failed job loses nothing."""
    spark = new.sparkSession
    if not _there(spark, path):
        return replace_table(upserted(new.limit(0), new, keys), path)
    old = spark.read.parquet(path)
    upserted(old, new, keys).write.mode("overwrite").parquet(f"{path}.next")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(hadoop(f"{path}.last"), True)
    fs.rename(hadoop(path), hadoop(f"{path}.last"))
    fs.rename(hadoop(f"{path}.next"), hadoop(path))
    return spark.read.schema(old.schema).parquet(path)


def updated(df: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns that changes (one row per key) holds set for the rows with its keys."""
    columns = [c for c in changes.columns if c not in keys]
    to = changes.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    j = df.join(to, keys, "left")
    return j.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def append_log(rows: DataFrame, path: str) -> None:
    """An audit log: rows appended as JSON lines; nothing written before is touched."""
    rows.write.mode("append").json(path)


def report(df: DataFrame, path: str) -> None:
    """A small result (at most 10,000 rows, else refused) as one JSON file of the driver's."""
    rows = df.limit(10_001).toJSON().collect()
    if len(rows) > 10_000:
        raise ValueError("a report has at most 10,000 rows; write a table instead")
    Path(path).write_text("[" + ",\n".join(rows) + "]\n")


# ---------------------------------------------------------------- artifacts


def packed(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes, sha256, gz) of the files in a folder, each compressed whole; larger than ARTIFACT_BYTES: refused."""
    import gzip

    def pack(x: pa.Array) -> pa.Array:
        return pa.array([None if b is None else gzip.compress(b, 9, mtime=0) for b in x.to_pylist()], pa.binary())

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    whole = F.when(F.col("length") <= ARTIFACT_BYTES, F.col("content")).otherwise(F.raise_error(F.lit("an artifact is too large to be packed whole")))
    return files.select("path", F.col("length").alias("bytes"), F.sha2(whole, 256).alias("sha256"), F.arrow_udf(pack, "binary")(whole).alias("gz"))


def verified(artifacts: DataFrame, head: bytes = b"", least_bytes: int = 0) -> DataFrame:
    """artifacts(gz, sha256) inflated, with `ok`: whether checksum, first bytes and size are what they should be."""
    import zlib

    def inflate(x: pa.Array) -> pa.Array:
        out = []
        for b in x.to_pylist():
            try:
                out.append(None if b is None else zlib.decompress(b, 31))
            except zlib.error:
                out.append(None)
        return pa.array(out, pa.binary())

    plain = artifacts.withColumn("content", F.arrow_udf(inflate, "binary")(F.col("gz")))
    ok = (F.sha2("content", 256) == F.col("sha256")) & (F.length("content") >= least_bytes)
    if head:
        ok &= F.substring("content", 1, len(head)) == F.lit(head)
    return plain.withColumn("ok", F.coalesce(ok, F.lit(False)))


def with_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """df in a fixed schema: columns that are absent are null, others are cast."""
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
