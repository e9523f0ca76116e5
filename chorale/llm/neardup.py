"""MinHash near-duplicates by a multi-index Hamming join.

A document's set holds the distinct hashes of its shingles (k words, A-Z lowered; fewer words: the whole sequence as
one). Its signature has 4 * chunks MinHash values of 16 bits each. Two signatures that differ in at most
2 * chunks - 1 values agree, by pigeonhole, in three of the four values of some chunk: so each chunk is indexed under
its four leave-one-out keys, which enumerates the one error a chunk may have, and every pair within that distance
shares a bucket. The number of chunks is the least for which a pair at the similarity threshold exceeds the distance
with a probability under MISS. Links within the distance make groups; the exact similarity on full sets decides
inside each group, so groups that the signatures bring together wrongly fall apart again.

Copies with equal sets are one class throughout (a group of any size costs one row). A bucket of more than BUCKET
rows, or a group of more than GROUP rows or SHINGLES shingles, is dealt over tiles of about that size. In a few
rounds, PIVOTS of its rows are sent to every tile and compared with all rows; rows linked through pivots become one body
that needs no further comparison inside. Only rows outside it then meet every tile, in chunks of a tile's size. So every
pair is covered that a body doesn't already link, a task holds a chunk and a tile at most, and a group of one body
costs its rows once a round; rows in no body cost their number times the group's, as an exact answer needs.

Classes have numbers of their own, so ids play no part until the components are named by their smallest id.

Defined results: null, empty or blank text: an empty set, linked with nothing. Rows that share an id are one
document, and what links one of them links all (but for its empty texts). Rows with a null id link like others but never name
a component; among themselves alone, their component is null. `deduplicated` leaves one row of each component and of each
id, and of a component without an id; rows with a null id and an empty set all stay. Extra columns are ignored. An empty
table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorale.llm._common import components, free, hashed_words, materialize, mixed, slabs, streamed_groups, utf8, width

MISS = 1e-5
BUCKET = 4096
GROUP = 256
SHINGLES = 1 << 18
PIVOTS = 8
ROUNDS = 6
#: More rounds are made while rows of more than so many tiles are in no body.
LEFT = 64
#: Tables of hot buckets or groups are broadcast up to so many rows; beyond, they are joined over SALTS parts.
FEW = 100_000
SALTS = 32
_MIXERS = np.random.Generator(np.random.Philox(7)).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def chunks_for(percent: int) -> int:
    """The least number of four-value chunks that keeps a pair at the threshold within the distance, but for MISS."""
    p, c = 1 - percent / 100, 1
    while sum(math.comb(4 * c, i) * p**i * (1 - p) ** (4 * c - i) for i in range(2 * c, 4 * c + 1)) > MISS:
        c += 1
    return c


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' sorted distinct shingle hashes, one after another, and pointers to each row's."""
    words, at, _ = hashed_words(data, offsets, lower=True)
    n = len(words)
    shingle = np.zeros(max(0, n - k + 1), dtype=np.uint64)
    for i in range(k):
        shingle += words[i : n - k + 1 + i] * _MIXERS[i]
    shingle = mixed(shingle)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        m = b - a
        if m >= k:
            s = np.sort(shingle[a : b - k + 1])
            fresh = np.empty(len(s), dtype=bool)
            fresh[0] = True
            np.not_equal(s[1:], s[:-1], out=fresh[1:])
            out.append(s[fresh])
        elif m:
            out.append(mixed((words[a:b] * _MIXERS[:m]).sum(dtype=np.uint64, keepdims=True) + np.uint64(m)))
        else:
            out.append(shingle[:0])
    ptr = np.zeros(len(out) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in out], out=ptr[1:])
    return (np.concatenate(out) if out else shingle[:0]), ptr


def digests(sets: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums for each set; with its size they stand for it."""
    some = np.diff(ptr) > 0
    d1, d2 = np.zeros(len(some), dtype=np.uint64), np.zeros(len(some), dtype=np.uint64)
    if some.any():
        d1[some] = np.add.reduceat(mixed(sets ^ _MIXERS[100]), ptr[:-1][some])
        d2[some] = np.add.reduceat(mixed(sets ^ _MIXERS[101]), ptr[:-1][some])
    return d1.view(np.int64), d2.view(np.int64)


def _digested(batches: Iterator[pa.RecordBatch], k: int, text: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches with each row's set size and digests, as columns of these names."""
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        for a, b in slabs(offsets):
            part = offsets[a : b + 1]
            sets, ptr = shingle_sets(data[part[0] : part[-1]], part - part[0], k)
            out = batch.slice(a, b - a)
            for name, column in zip(names, (np.diff(ptr), *digests(sets, ptr)), strict=True):
                out = out.append_column(name, pa.array(column))
            yield out


def _sign(batches: Iterator[pa.RecordBatch], values: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for a, b in slabs(offsets):
            part = offsets[a : b + 1]
            sets, ptr = shingle_sets(data[part[0] : part[-1]], part - part[0], k)
            size = np.diff(ptr)
            some = size > 0
            heads = ptr[:-1][some]
            d1, d2 = digests(sets, ptr)
            signature = np.zeros((b - a, values), dtype="<u2")
            if len(heads):
                for i in range(values):
                    least = np.minimum.reduceat((sets ^ _MIXERS[200 + 2 * i]) * _MIXERS[201 + 2 * i], heads)
                    signature[some, i] = mixed(least) >> np.uint64(48)
            rows = [r.tobytes() for r in signature]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(size), pa.array(d1), pa.array(d2), pa.array(rows, pa.binary())],
                ["id", "n", "d1", "d2", "sig"],
            )


def _keys(batches: Iterator[pa.RecordBatch], chunks: int) -> Iterator[pa.RecordBatch]:
    """Four keys for each chunk: what is left of it when one of its values is put aside."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u2").reshape(batch.num_rows, -1).astype(np.uint64)
        keys = []
        for c in range(chunks):
            for out in range(4):
                x = np.full(batch.num_rows, c * 4 + out, dtype=np.uint64)
                for i in (j for j in range(4) if j != out):
                    x = x << np.uint64(16) | sig[:, 4 * c + i]
                keys.append(mixed(x).view(np.int64))
        table = np.stack(keys, axis=1)
        for at in range(0, batch.num_rows, 1024):
            part = table[at : at + 1024]
            ids = np.repeat(np.arange(at, at + len(part)), part.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(part.reshape(-1)), batch.column(0).take(pa.array(ids))], ["key", "rep"])


def _with_tiles(df: DataFrame, key: str, big: DataFrame, none: int = 1) -> DataFrame:
    """df with the tiles of big(key, tiles), `none` for other keys. A key of any share of the rows fills no task."""
    if big.count() <= FEW:
        out = df.join(F.broadcast(big), key, "left")
    else:
        dealt = big.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = df.withColumn("_salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(dealt, [key, "_salt"], "left").drop("_salt")
    return out.withColumn("tiles", F.coalesce("tiles", F.lit(none).cast("long")))


def _runs(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the groups of a table sorted by keys begin, and its length."""
    change = np.zeros(table.num_rows, dtype=bool)
    change[0] = True
    for k in keys:
        c = table.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def _near(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of each bucket's pairs within the distance. A breadth-first search that compares a signature with
    those not yet reached: nearly linear where rows are alike."""
    for table in streamed_groups(batches, ["key"]):
        runs = _runs(table, ["key"])
        ids = table.column("rep").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype="<u2").reshape(len(ids), -1)
        size = np.diff(runs)
        first = np.repeat(runs[:-1], size)
        near = np.concatenate([(sig[a : a + 65536] != sig[first[a : a + 65536]]).sum(axis=1) <= distance for a in range(0, len(ids), 65536)])
        links = near & (first != np.arange(len(ids)))
        found = [np.stack([ids[first[links]], ids[links]], axis=1)]
        for g in np.flatnonzero((np.add.reduceat(~near, runs[:-1]) > 0) & (size > 2)):
            rows = np.arange(runs[g], runs[g + 1])
            todo, rest = rows[near[rows]].tolist()[1:], rows[~near[rows]]
            while len(rest):
                at = todo.pop() if todo else int(rest[0])
                if at == rest[0]:
                    rest = rest[1:]
                    if not len(rest):
                        break
                hit = (sig[rest] != sig[at]).sum(axis=1) <= distance
                if hit.any():
                    found.append(np.stack([np.full(int(hit.sum()), ids[at]), ids[rest[hit]]], axis=1))
                    todo += rest[hit].tolist()
                    rest = rest[~hit]
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


# ---------------------------------------------------------------- large buckets and groups

Kernel = Callable[[list[bytes], list[bytes]], np.ndarray]


def near_signatures(queries: list[bytes], rows: list[bytes], distance: int) -> np.ndarray:
    """Which rows (second axis) are within the distance of which queries."""
    q, r = (np.frombuffer(b"".join(x), dtype="<u2").reshape(len(x), -1) for x in (queries, rows))
    return np.stack([(r != one).sum(axis=1) <= distance for one in q])


def similar_sets(queries: list[bytes], rows: list[bytes], percent: int) -> np.ndarray:
    """Which rows (second axis) are similar to which queries; exact."""
    sets = [np.frombuffer(x, dtype=np.uint64) for x in (*rows, *queries)]
    size = np.array([len(x) for x in sets])
    flat, code = np.unique(np.concatenate(sets), return_inverse=True)
    ptr = np.append(0, np.cumsum(size))
    n = len(rows)
    codes, heads, mark = code[: ptr[n]], ptr[:n], np.zeros(len(flat), dtype=bool)
    out = np.zeros((len(queries), n), dtype=bool)
    for i in range(len(queries)):
        own = code[ptr[n + i] : ptr[n + i + 1]]
        mark[own] = True
        both = np.add.reduceat(mark[codes].astype(np.int64), heads)
        mark[own] = False
        out[i] = 100 * both >= percent * (size[:n] + size[n + i] - both)
    return out


def spanning(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (query, row) that connect what all hits connect: each row to its first query, and, for each set of queries that
    rows have, the first query to the others (given as -1 - query)."""
    rows = np.flatnonzero(hits.any(axis=0))
    some = hits[:, rows]
    first = some.argmax(axis=0)
    _, kinds = np.unique(np.packbits(some, axis=0), axis=1, return_index=True)
    q, other = [first], [rows]
    for k in kinds.tolist():
        more = np.flatnonzero(some[:, k])[1:]
        q.append(np.full(len(more), first[k]))
        other.append(-1 - more)
    return np.concatenate(q), np.concatenate(other)


def _compared(batches: Iterator[pa.RecordBatch], kernel: Kernel) -> Iterator[pa.RecordBatch]:
    """The links between the queries (which come first) and the rows of each chunk and tile. Pivots (slot > 0) give all of
    theirs; other queries' are replaced by as many as connect the same rows."""
    keys = ["grp", "chunk", "tile"]
    for table in streamed_groups(batches, keys):
        runs, out = _runs(table, keys), []
        grp, rep, slot, load = (table.column(c) for c in ("grp", "rep", "slot", "load"))
        grp, rep, slot = grp.to_numpy(), rep.to_numpy(), slot.to_numpy()
        for a, b in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
            middle = a + int((slot[a:b] >= 0).sum())
            if a < middle < b:
                hits = kernel(load.slice(a, middle - a).to_pylist(), load.slice(middle, b - middle).to_pylist())
                if slot[a]:
                    q, r = (x + at for x, at in zip(np.nonzero(hits), (a, middle), strict=True))
                else:
                    q, r = spanning(hits)
                    q, r = q + a, np.where(r < 0, a - 1 - r, r + middle)
                q, r = q[rep[q] != rep[r]], r[rep[q] != rep[r]]
                out.append((grp[q], slot[q], rep[q], rep[r]))
        for part in out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in part], ["grp", "slot", "a", "b"])


def _main(entries: pa.Array) -> pa.Array:
    """Of each group's (pivots' bits, in its body, rows): the bits of the pivots that its body reaches, or, without a body,
    those of the largest set of linked rows."""
    out = []
    for group in entries.to_pylist():
        bodies: list[list] = []
        for e in group:
            whole = [e["mask"], e["body"], e["n"]]
            for other in [x for x in bodies if x[0] & whole[0]]:
                bodies.remove(other)
                whole = [whole[0] | other[0], whole[1] or other[1], whole[2] + other[2]]
            bodies.append(whole)
        if any(e["body"] for e in group):
            out.append(sum(x[0] for x in bodies if x[1]))
        else:
            out.append(max(bodies, key=lambda x: (x[2], -x[0]))[0])
    return pa.array(out, pa.int64())


def _connected(members: DataFrame, kernel: Kernel, tile_rows: int) -> DataFrame:
    """Links (a, b) that connect all rows that links of the kernel connect, in each group of members(grp, rep, load, tiles)."""
    n = width(members.sparkSession)
    members = materialize(members.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles"))))

    def compared(queries: DataFrame, rows: DataFrame) -> DataFrame:
        order = ["grp", "chunk", "tile", "slot", "rep", "load"]
        every = queries.select(*order).union(rows.withColumn("slot", F.lit(-1)).select(*order))
        dealt = every.repartition(n, "grp", "chunk", "tile").sortWithinPartitions("grp", "chunk", "tile", F.desc("slot"))
        return materialize(dealt.mapInArrow(lambda b: _compared(b, kernel), "grp long, slot int, a long, b long"))

    over_tiles = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    first = F.lit(0).cast("long")
    rest, body, found, left = members.select("grp", "rep", "tiles"), None, [], 0.0
    for i in range(ROUNDS):
        slot = 1 + F.pmod(F.xxhash64("rep", F.lit(i)), F.lit(PIVOTS)).cast("int")
        pivots = materialize(rest.groupBy("grp", slot.alias("slot")).agg(F.min("rep").alias("rep"), F.max("tiles").alias("tiles")))
        queries = pivots.join(members.select("grp", "rep", "load"), ["grp", "rep"]).withColumn("tile", over_tiles).withColumn("chunk", first)
        hits = compared(queries, members.withColumn("chunk", first))
        reached = hits.select("grp", "slot", "a", F.col("b").alias("rep")).union(pivots.select("grp", "slot", F.col("rep").alias("a"), "rep"))
        bit = F.bit_or(F.expr("shiftleft(1L, slot)")).alias("mask")
        masks = reached.groupBy("grp", "rep").agg(bit, F.min(F.struct("slot", "a")).alias("first"))
        flagged = masks.join(body.withColumn("body", F.lit(True)), ["grp", "rep"], "left") if body is not None else masks.withColumn("body", F.lit(False))
        flagged = materialize(flagged.select("grp", "rep", "mask", F.col("first.a").alias("a"), F.coalesce("body", F.lit(False)).alias("body")))
        # each row is linked to its first pivot, and of each set of pivots that rows have, the first to the others
        counts = materialize(flagged.groupBy("grp", "mask", "body").agg(F.count("*").alias("n"), F.min("a").alias("a")))  # at most 2 ** (PIVOTS + 1) rows a group
        bits = F.explode(F.expr(f"filter(sequence(1, {PIVOTS}), x -> (mask & shiftleft(1L, x)) != 0)"))
        chained = counts.select("grp", "a", bits.alias("slot")).join(pivots.select("grp", "slot", "rep"), ["grp", "slot"])
        found.append(flagged.select("a", F.col("rep").alias("b")).union(chained.select("a", F.col("rep").alias("b"))).distinct())
        entries = counts.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("mask", "body", "n"))).alias("entries"))
        main = materialize(entries.select("grp", F.arrow_udf(_main, "long")("entries").alias("tiles")))
        joined = _with_tiles(flagged, "grp", main).filter(F.col("tiles").bitwiseAND(F.col("mask")) != 0).select("grp", "rep")
        body = materialize(joined if body is None else joined.union(body).distinct())
        rest = materialize(rest.join(body.union(pivots.select("grp", "rep")), ["grp", "rep"], "left_anti"))
        left = rest.count() / tile_rows
        if left <= LEFT:
            break
    if left:
        chunks = materialize(rest.groupBy("grp").agg(F.ceil(F.count("*") / tile_rows).cast("long").alias("tiles")))
        own = _with_tiles(rest.withColumnRenamed("tiles", "_tiles"), "grp", chunks).withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(ROUNDS)), F.col("tiles")))
        queries = own.select("grp", "rep", "chunk", F.col("_tiles").alias("tiles"), F.lit(0).alias("slot")).withColumn("tile", over_tiles)
        queries = queries.join(members.select("grp", "rep", "load"), ["grp", "rep"])
        # only groups with such rows are compared again: their key has a chunk 0 at least
        every = _with_tiles(members.drop("tiles"), "grp", chunks, none=0).withColumn("chunk", F.explode(F.expr("filter(sequence(0L, tiles), x -> x < tiles)")))
        found.append(compared(queries, every).select("a", "b"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def linked(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning links (smallest id of the part, id) between sets with 100 * intersection >= percent * union; ids are
    distinct. Exact: each set is compared with all that are not yet reached."""
    n = len(ids)
    flat, code = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    ptr = np.append(0, np.cumsum(size))
    own = [code[a:b] for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
    mark = np.zeros(len(flat), dtype=bool)
    rest = np.arange(n)
    out = []
    while len(rest):
        part, todo, rest = [int(rest[0])], [int(rest[0])], rest[1:]
        stale, codes, heads = True, code, ptr[:-1]
        while todo and len(rest):
            at = todo.pop()
            if stale:
                codes = np.concatenate([own[i] for i in rest])
                heads = np.append(0, np.cumsum(size[rest])[:-1])
                stale = False
            mark[own[at]] = True
            both = np.add.reduceat(mark[codes].astype(np.int64), heads)
            mark[own[at]] = False
            hit = 100 * both >= percent * (size[rest] + size[at] - both)
            if hit.any():
                new = rest[hit].tolist()
                part += new
                todo += new
                rest, stale = rest[~hit], True
        root = min(ids[i] for i in part)
        out += [(root, x) for x in {ids[i] for i in part} - {root}]
    return out


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The sets of classes, one row for each. A row's id may stand for other texts too: those not of its class go. The rows of
    an id come to one task, so a class that was given already is known there."""
    seen: set[int] = set()
    for batch in batches:
        get = lambda c: batch.column(batch.schema.get_field_index(c))
        data, offsets = utf8(get("text"))
        n, d1, d2, reps = (get(c).to_numpy() for c in ("n", "d1", "d2", "rep"))
        for a, b in slabs(offsets):
            part = offsets[a : b + 1]
            sets, ptr = shingle_sets(data[part[0] : part[-1]], part - part[0], k)
            x, y = digests(sets, ptr)
            rows, loads = [], []
            for i in np.flatnonzero((np.diff(ptr) == n[a:b]) & (x == d1[a:b]) & (y == d2[a:b])).tolist():
                if (rep := int(reps[a + i])) not in seen:
                    seen.add(rep)
                    rows.append(a + i)
                    loads.append(sets[ptr[i] : ptr[i + 1]].tobytes())
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(get(c).take(take) for c in ("grp", "rep", "tiles")), pa.array(loads, pa.binary())], ["grp", "rep", "tiles", "load"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The links of whole groups of sets."""
    for table in streamed_groups(batches, ["grp"]):
        runs, ids, out = _runs(table, ["grp"]), table.column("rep").to_pylist(), []
        load = table.column("load")
        for a, b in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
            own = dict(zip(ids[a:b], (np.frombuffer(x, dtype=np.uint64) for x in load.slice(a, b - a).to_pylist()), strict=True))
            if len(own) > 1:
                out += linked(list(own), list(own.values()), percent)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])


def _twins(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id."""
    named = signed.filter("n > 0 and id is not null").select("id", "d1", "d2", "n")
    several = named.groupBy("id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("d1", "d2", "n") for f in (F.min, F.max)])
    several = materialize(several.filter("min_d1 != max_d1 or min_d2 != max_d2 or min_n != max_n").select("id"))
    own = materialize(named.join(several, "id").distinct().join(classes.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"]).select("id", "rep"))
    return own.join(own.groupBy("id").agg(F.min("rep").alias("a")), "id").filter("a != rep").select("a", F.col("rep").alias("b"))


def _classified(docs: DataFrame, id_col: str, text_col: str, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, d1, d2) of every row, and (d1, d2, n, part, component) of every class: its component's number and smallest id."""
    spark = docs.sparkSession
    chunks = chunks_for(percent)
    values, distance, width_ = 4 * chunks, 2 * chunks - 1, width(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(texts.mapInArrow(lambda b: _sign(b, values, k), "id long, n long, d1 long, d2 long, sig binary"))
    classes = signed.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("id"), F.any_value("sig").alias("sig"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()))  # written once, so the numbers hold
    keys = materialize(classes.select("rep", "sig").repartition(width_).mapInArrow(lambda b: _keys(b, chunks), "key long, rep long"))
    shared = materialize(keys.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1"))
    signatures = classes.select("rep", "sig")
    buckets = keys.join(shared.filter(F.col("rows") <= BUCKET).select("key"), "key").join(signatures, "rep")
    buckets = buckets.select("key", "rep", "sig").repartition(width_, "key").sortWithinPartitions("key", "rep")
    near = buckets.mapInArrow(lambda b: _near(b, distance), "a long, b long").distinct()
    hot = materialize(shared.filter(F.col("rows") > BUCKET).select("key", F.ceil(F.col("rows") / BUCKET).cast("long").alias("tiles")))
    if not hot.isEmpty():
        rows = _with_tiles(keys, "key", hot).filter("tiles > 1").join(signatures, "rep")
        rows = rows.select(F.col("key").alias("grp"), "rep", F.col("sig").alias("load"), "tiles")
        near = near.union(_connected(rows, lambda q, r: near_signatures(q, r, distance), BUCKET))
    groups = materialize(components(materialize(near)).select(F.col("node").alias("rep"), F.col("component").alias("grp")))
    sized = groups.join(classes.drop("sig"), "rep")
    tiles = F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / SHINGLES)).cast("long")
    hot = materialize(sized.groupBy("grp").agg(tiles.alias("tiles")).filter("tiles > 1"))
    placed = _with_tiles(sized, "grp", hot)
    full = texts.join(placed.filter("id is not null").hint("shuffle_hash"), "id")
    # classes of null ids alone: their texts are found by digest, one for each class
    nameless = texts.filter("id is null").select("text").mapInArrow(lambda b: _digested(b, k, "text", ["n", "d1", "d2"]), "text string, n long, d1 long, d2 long")
    nameless = nameless.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("text").alias("text")).join(placed.filter("id is null").drop("id"), ["d1", "d2", "n"])
    order = ["grp", "rep", "tiles", "n", "d1", "d2", "text"]
    full = full.select(*order).union(nameless.select(*order))
    sets = materialize(full.mapInArrow(lambda b: _sets(b, k), "grp long, rep long, tiles long, load binary"))
    small = sets.filter("tiles = 1").drop("tiles").repartition(width_, "grp").sortWithinPartitions("grp", "rep")
    links = small.mapInArrow(lambda b: _confirm(b, percent), "a long, b long").union(_twins(signed, classes))
    if not hot.isEmpty():
        links = links.union(_connected(sets.filter("tiles > 1"), lambda q, r: similar_sets(q, r, percent), GROUP))
    found = materialize(components(materialize(links)).select(F.col("node").alias("rep"), F.col("component").alias("part")))
    parts = found.join(classes.select("rep", "id"), "rep").groupBy("part").agg(F.min("id").alias("smallest"))
    named = classes.drop("sig").join(found.join(parts, "part"), "rep", "left")
    component = F.when(F.col("part").isNull(), F.col("id")).otherwise(F.col("smallest"))
    return signed, named.select("d1", "d2", "n", F.coalesce("part", "rep").alias("part"), component.alias("component"))


def _components(signed: DataFrame, named: DataFrame) -> DataFrame:
    out = signed.select("id", "n", "d1", "d2").join(named.drop("part"), ["d1", "d2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs; see the module's text for the defined results."""
    return _components(*_classified(docs, id_col, text_col, percent, k))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, k: int = 5) -> DataFrame:
    """docs with one row of each component: of its smallest id, or any where no row has an id; see the module's text."""
    signed, named = _classified(docs, id_col, text_col, percent, k)
    named = materialize(named)
    key, text = docs[id_col].cast("long"), F.struct(F.col(text_col).cast("string"))
    row, name, words = free(docs, "_row"), free(docs, "_id"), free(docs, "_text")
    digest = [free(docs, c) for c in ("_n", "_d1", "_d2")]
    one = F.min_by(F.struct(*docs.columns), text).alias(row)  # the row of the least text
    ids = _components(signed, named).filter("doc_id is not null").groupBy(F.col("doc_id").alias(name))
    ids = materialize(ids.agg(F.min("kept").alias("kept"), F.count("*").alias("rows")).filter("not kept or rows > 1"))
    plain = docs.filter(key.isNotNull()).join(ids.select(name).hint("shuffle_hash"), key == F.col(name), "left_anti")
    repeated = docs.join(ids.filter("kept").select(name), key == F.col(name), "left_semi").groupBy(key.alias(name)).agg(one).select(f"{row}.*")
    nameless = docs.filter(key.isNull()).withColumn(words, F.col(text_col).cast("string"))
    schema = T.StructType([*nameless.schema.fields, *(T.StructField(c, T.LongType()) for c in digest)])
    nameless = nameless.mapInArrow(lambda b: _digested(b, k, words, digest), schema)
    empty = nameless.filter(F.col(digest[0]) == 0).select(*docs.columns)
    n, d1, d2 = digest
    classes = nameless.filter(F.col(n) > 0).groupBy(F.col(n).alias("n"), F.col(d1).alias("d1"), F.col(d2).alias("d2")).agg(one, F.min(words).alias("text"))
    alone = classes.join(named.filter("component is null"), ["n", "d1", "d2"]).groupBy("part").agg(F.min_by(row, "text").alias(row)).select(f"{row}.*")
    return plain.union(repeated).union(empty).union(alone)
