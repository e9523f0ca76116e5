"""Quality rules with host verdicts.

Each whole text is measured; a document fails the base rules when it has too few words, or too many of them lie in
repeated three-word windows. Failures are counted by host (one pre-aggregated row per host), the hosts' failure rates
are shrunk towards the corpus by a beta prior fitted to the hosts by moments (weighted by documents), and every
document of a host whose shrunk rate exceeds max_host_rate is rejected as well. `measure` reports each row's host's
shrunk rate beside the verdict, so other cuts need no second run.

Defined results: a null or blank text has no words and fails; documents without a host (null) are one host; repeated
rows count each time; extra columns are ignored by `measure` and kept by `filtered`; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from chorale.llm._common import free, hashed_words, materialize, slabs, utf8

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
#: Tables of hosts are broadcast up to so many rows; beyond, they are joined by shuffle, each host dealt over SALTS parts.
BROADCAST_HOSTS = 100_000
SALTS = 32
#: Fixed values.
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(SYMBOLS)] = 1


def _dup_lines(raw: bytes) -> int:
    seen, n = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(b" \t\n\r\x0b\x0c"):
            seen.add(line)
    return n


def _repeat_words(windows: np.ndarray) -> int:
    """Words in windows (hashes of three words each, in order) that occur twice or more."""
    s = np.sort(windows)
    again = s[1:][s[1:] == s[:-1]]
    if not len(again):
        return 0
    again = again[np.append(True, again[1:] != again[:-1])]
    at = np.minimum(np.searchsorted(again, windows), len(again) - 1)
    hit = again[at] == windows
    cover = np.zeros(len(windows) + 2, dtype=bool)
    for i in range(3):
        cover[i : i + len(windows)] |= hit
    return int(cover.sum())


def measured(text: pa.Array) -> pa.StructArray:
    data, offsets = utf8(text)
    out = {m: [] for m in MEASURES}
    for a, b in slabs(offsets):
        at = offsets[a : b + 1] - offsets[a]
        raw = data[offsets[a] : offsets[b]]
        words, ptr, space = hashed_words(raw, at, lower=False)
        windows = words[:-2] * np.uint64(0x9E3779B97F4A7C15) + words[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[2:] * np.uint64(0x165667B19E3779F9) if len(words) > 2 else words[:0]
        chars = np.append(0, np.cumsum(~space & ((raw & 0xC0) != 0x80)))
        symbols = np.append(0, np.cumsum(_SYMBOL[raw]))
        out["n_words"] += np.diff(ptr).tolist()
        out["word_chars"] += (chars[at[1:]] - chars[at[:-1]]).tolist()
        out["n_symbols"] += (symbols[at[1:]] - symbols[at[:-1]]).tolist()
        whole = raw.tobytes()
        out["n_dup_lines"] += [_dup_lines(whole[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        out["n_repeat_words"] += [_repeat_words(windows[x : y - 2]) if y - x > 2 else 0 for x, y in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array(out[m], pa.int64()) for m in MEASURES], list(MEASURES))


def _measures(text: Column) -> Column:
    def measures(x: pa.Array) -> pa.Array:
        return measured(x)

    return F.arrow_udf(measures, StructType([StructField(m, LongType()) for m in MEASURES]))(text)


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_rates(judged: DataFrame) -> DataFrame:
    """(host, rate) of every host of judged(host, failed): its shrunk failure rate."""
    hosts = materialize(judged.groupBy("host").agg(F.count("*").alias("n"), F.count_if("failed").alias("f")))
    s = hosts.agg(F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum(F.col("f") * F.col("f") / F.col("n")).alias("ff")).first()
    if not s["n"]:
        return hosts.select("host", F.lit(0.0).alias("rate")).limit(0)
    mean = s["f"] / s["n"]
    variance = max(s["ff"] / s["n"] - mean * mean, 1e-9)
    strength = min(max(mean * (1 - mean) / variance - 1, 1.0), 1e6)
    rate = (F.col("f") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.select("host", rate.alias("rate"))


def _by_host(rows: DataFrame, host: str, hosts: DataFrame, how: str) -> DataFrame:
    """rows joined to hosts, which has other column names. A host of any share of the rows fills no task: hosts are broadcast below
    a checked number, and else each is dealt over SALTS parts."""
    hosts = materialize(hosts)
    name, salt, part = hosts.columns[0], free(rows, "_salt"), free(rows, "_part")
    if hosts.count() <= BROADCAST_HOSTS:
        return rows.join(F.broadcast(hosts), rows[host].eqNullSafe(hosts[name]), how)
    dealt = hosts.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(SALTS)).cast("int"))
    return salted.join(dealt, salted[host].eqNullSafe(dealt[name]) & (F.col(salt) == F.col(part)), how).drop(salt, part)


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(doc_id, the measures, base_failed, kept, host_rate) for every row."""
    m = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), _measures(F.col(text_col).cast("string")).alias("m"))
    base = materialize(m.select("doc_id", "host", "m.*").withColumn("base_failed", _failed()))
    rates = host_rates(base.select("host", F.col("base_failed").alias("failed")))
    out = _by_host(base, "host", rates.select(F.col("host").alias("_host"), "rate"), "left")
    kept = ~F.col("base_failed") & (F.col("rate") <= max_rate)
    return out.select("doc_id", *MEASURES, "base_failed", kept.alias("kept"), (F.floor(F.col("rate") * 1e6 + 0.5) / 1e6).alias("host_rate"))


def filtered(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """docs without the rejected rows. Texts are measured twice, which costs less than moving them to join verdicts."""

    def failed(text: pa.Array) -> pa.Array:
        m = measured(text)
        words, repeated = (m.field(i).to_numpy() for i in (0, 4))
        return pa.array((words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words))

    test = F.arrow_udf(failed, BooleanType())(F.col(text_col).cast("string"))
    rates = host_rates(docs.select(F.col(host_col).alias("host"), test.alias("failed")))
    bad = rates.filter(F.col("rate") > max_rate).select(F.col("host").alias(free(docs, "_host")))
    return _by_host(docs.filter(~test), host_col, bad, "left_anti")
