"""Mixing sources to target weights by entropy balancing.

Each source's token constraint sum(rate * size) = target is met by the rates nearest to 1 in relative entropy that
do not exceed `most`: rate = min(most, exp(multiplier * size / mean size)), one multiplier per source. The dual is convex and
its Hessian diagonal, so Newton's iterations (kept inside a bracket) solve all sources at once; each iteration is
one distributed aggregate over the table of (source, size, count), which is far smaller than the documents. Sums are
taken in whole thousandths of words, so reruns agree to the bit.

Rates become copies by carrying the rounding error along a source's documents, longest first, so that short ones even out
what is left. Sources are dealt over blocks of about BLOCK documents by the hash of id, size and text; each block carries its
own error and is streamed, so a block of any size (rows equal in all three share one) takes bounded memory.

`mix` moves ids and sizes only. `mixed` decides on these too and joins what is decided to the documents, which move once, evenly
dealt, and never pass through Python. The join goes by two 64-bit hashes of id, source and text; rows equal in all three are
counted off within their key and share what the key takes, so rows that share an id, or have none, are rows of their own.
Newton's iterations that don't meet the goals are an error.

Targets: sources in the order of their code points, null last, weigh 3, 1, 2 in turn, share `share` of all sizes by
weight, stop at `most` times their size, and what is above is reshared by weight until none is. That fixed
point is a water level: target = min(most * size, level * weight).

Defined results: a null or blank text has size 0 and is taken 0 times; null sources are one source; repeated rows are rows of
their own; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorale.llm._common import SPACES, materialize, numbered, slabs, utf8, width

BLOCK = 8192
WEIGHTS = (3, 1, 2)
ITERATIONS = 90
TOLERANCE = 1e-6
#: Tables of sources are broadcast up to so many rows; beyond, they are joined by shuffle.
FEW = 100_000


def n_words(text: Column) -> Column:
    space = np.zeros(256, dtype=bool)
    space[list(SPACES)] = True

    def count(x: pa.Array) -> pa.Array:
        data, offsets = utf8(x)
        out = [np.zeros(0, dtype=np.int64)]
        for a, b in slabs(offsets):
            at = offsets[a : b + 1] - offsets[a]
            inside = ~space[data[offsets[a] : offsets[b]]]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            firsts = at[:-1][at[:-1] < len(inside)]
            begins[firsts] = inside[firsts]
            total = np.append(0, np.cumsum(begins))
            out.append(total[at[1:]] - total[at[:-1]])
        return pa.array(np.concatenate(out), pa.int64())

    return F.arrow_udf(count, "long")(text)


def targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """sources(source, size) with weight and target."""
    n = len(WEIGHTS)
    # code points and UTF-8 bytes sort alike; nulls go last by their flag
    keyed = sources.withColumn("_null", F.col("source").isNull().cast("int"))
    turn = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    weighed = materialize(numbered(keyed, ["_null", "source"], "_rank").withColumn("weight", F.get(turn, (F.col("_rank") % n).cast("int"))))
    cap = F.col("size") * most
    budget = share * (weighed.agg(F.sum("size")).first()[0] or 0)
    level = 0.0
    while True:  # every round stops more sources, and the level rises with them
        s = weighed.agg(
            F.sum(F.when(cap <= F.col("weight") * level, cap).otherwise(0.0)).alias("full"),
            F.sum(F.when(cap <= F.col("weight") * level, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not s["open"] or (new := (budget - s["full"]) / s["open"]) <= level * (1 + 1e-12):
            break
        level = new
    return weighed.select("source", "size", F.least(cap, F.col("weight") * level).alias("target"))


def _step(table: DataFrame, most: float) -> DataFrame:
    """What each source takes at its multiplier and how fast that grows, in whole thousandths of words."""
    x = F.col("size") / F.col("mean")
    raw = F.exp(F.least(F.col("lambda") * x, F.lit(50.0)))
    rate = F.least(raw, F.lit(most))
    whole = lambda c: F.sum(F.floor(c * 1000 + 0.5).cast("decimal(38,0)")).cast("double") / 1000
    return table.groupBy("source").agg(
        whole(F.col("n") * F.col("size") * rate).alias("taken"),
        whole(F.when(raw < most, F.col("n") * F.col("size") * rate * x).otherwise(0.0)).alias("slope"),
    )


def multipliers(histogram: DataFrame, goals: DataFrame, most: float) -> DataFrame:
    """(source, lambda) that meet the goals, which lie above 0 and below what the sources can give at most. A goal is met
    within TOLERANCE and the sums' rounding, or where no smaller step is left; every third step halves the bracket."""
    start = goals.withColumns({"lambda": F.lit(0.0), "low": F.lit(-50.0), "high": F.lit(50.0)})
    state = materialize(start)
    few = state.count() <= FEW
    for i in range(ITERATIONS):
        at = state.select(F.col("source").alias("_s"), "mean", "lambda")
        joined = histogram.join(F.broadcast(at) if few else at, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        now = _step(joined, most)
        both = state.join(now.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        error = F.col("taken") - F.col("target")
        low = F.when(error < 0, F.col("lambda")).otherwise(F.col("low"))
        high = F.when(error < 0, F.col("high")).otherwise(F.col("lambda"))
        newton = F.col("lambda") - error / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high) & F.lit(i % 3 != 2)
        near = (F.abs(error) <= TOLERANCE * F.col("target") + 0.001) | (high - low <= 1e-12)
        moved = F.when(near, F.col("lambda")).when(inside, newton).otherwise((low + high) / 2)
        state = materialize(both.select("source", "size", "target", "mean", moved.alias("lambda"), low.alias("low"), high.alias("high"), near.alias("near")))
        if state.filter("not near").isEmpty():
            return state.select("source", "lambda")
    raise ValueError(f"{state.filter('not near').count()} sources miss their targets after {ITERATIONS} iterations")


def _taken(batches: Iterator[pa.RecordBatch], most: float) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by block, with their copies; the error is carried from row to row of a block."""
    limit, last, error = int(most), None, 0.0
    for batch in batches:
        a, b, size, rate = (batch.column(batch.schema.get_field_index(c)).to_numpy().tolist() for c in ("_source", "_block", "size", "_rate"))
        copies = np.zeros(len(size), dtype=np.int64)
        for i, block in enumerate(zip(a, b, strict=True)):
            if block != last:
                last, error = block, 0.0
            if size[i]:
                due = rate[i] * size[i] + error
                copies[i] = min(max(int(due / size[i] + 0.5), 0), limit)
                error = due - copies[i] * size[i]
        yield batch.append_column("copies", pa.array(copies))


def _rated(sized: DataFrame, share: float, most: float) -> DataFrame:
    """(_s, source_size, target, mean, docs, lambda) of every source of sized(source, size)."""
    histogram = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("size"), F.sum("n").alias("docs"))
    goals = targets(sources.select("source", "size"), share, most)
    counted = goals.join(sources.select(F.col("source").alias("_s"), "docs"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    counted = materialize(counted.withColumn("mean", F.greatest(F.col("size") / F.col("docs"), F.lit(1e-9))))
    open_goals = counted.filter((F.col("target") > 0) & (F.col("target") < most * F.col("size")))
    solved = multipliers(histogram, open_goals.select("source", "size", "target", "mean"), most)
    full = counted.join(solved.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return materialize(full.select(F.col("source").alias("_s"), F.col("size").alias("source_size"), "target", "mean", "docs", F.coalesce("lambda", F.lit(0.0)).alias("lambda")))


def _copied(rows: DataFrame, per: DataFrame, most: float) -> DataFrame:
    """rows(doc_id, source, size, _hash, ...) with source_size, target and copies."""
    joined = rows.join(F.broadcast(per) if per.count() <= FEW else per, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    tilted = F.least(F.lit(most), F.exp(F.least(F.col("lambda") * F.col("size") / F.col("mean"), F.lit(50.0))))
    exact = F.when(F.col("target") >= most * F.col("source_size"), F.lit(most)).otherwise(tilted)
    dealt = joined.withColumns({
        "_rate": F.floor(exact * 1e6 + 0.5) / 1e6,
        "_source": F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()),
        "_block": F.pmod(F.xxhash64("doc_id", "size", "_hash"), F.ceil(F.col("docs") / BLOCK)).cast("long"),
    }).drop("mean", "docs", "lambda")
    order = ["_source", "_block", F.desc("size"), "doc_id", "_hash"]
    ordered = dealt.repartition(width(rows.sparkSession), "_source", "_block").sortWithinPartitions(*order)
    schema = T.StructType([*ordered.schema.fields, T.StructField("copies", T.LongType())])
    return ordered.mapInArrow(lambda b: _taken(b, most), schema)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    text = F.col(text_col).cast("string")
    return [F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("_hash")]


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken) for every row."""
    sized = materialize(docs.select(*_sized(docs, id_col, text_col, source_col)))
    out = _copied(sized, _rated(sized.select("source", "size"), share, most), most)
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, 0 to `most` times."""
    text = F.col(text_col).cast("string")
    # the literal starts a second hash of the text beside _hash
    key = F.xxhash64(F.lit(1), text, F.col(source_col).cast("string"), F.col(source_col).isNull(), id_col, F.col(id_col).isNull())
    sized = materialize(docs.select(*_sized(docs, id_col, text_col, source_col), key.alias("_key")))
    decided = _copied(sized, _rated(sized.select("source", "size"), share, most), most)
    per_key = decided.groupBy("_key", "_hash").agg(F.count("*").alias("_n"), F.sum("copies").alias("_total")).filter("_total > 0")
    rows = docs.filter(text.isNotNull()).select(F.struct(*docs.columns).alias("_row"), key.alias("_key"), F.xxhash64(text).alias("_hash"))
    place = F.count("*").over(Window.partitionBy("_key", "_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.join(per_key, ["_key", "_hash"]).withColumn("_place", place)
    copies = F.expr("_total div _n + if(_place <= _total % _n, 1, 0)").cast("long")
    return placed.select("_row", copies.alias("copies")).filter("copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")
