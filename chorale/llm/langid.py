"""Language identification of mixed-language text.

The model holds, for every language learned, the log-probabilities of letter bigrams, trigrams and quadrigrams (with word edges)
in BUCKETS hashed classes each, and the share of each script among its letters. Script ranges narrow a word's
candidates to the languages that use its script; the word's score for a language is the sum over its n-grams; and
the Viterbi path over a text's words, with a penalty for each switch, labels its spans. A document's language is the
one whose spans hold most letters; its score is their share of all letters.

A text keeps one language throughout, exactly as Viterbi would label it, when all its words together gain no more than the
penalty by leaving it; only other texts are decoded step by step, many at a time.

Training reads at most `per_language` labelled rows of each language, those with the least hash of their id; the counts
(at most 3 * BUCKETS numbers a language) are summed by Spark. Labels are a set of languages: tables with a row for each
are broadcast, and more than LANGUAGES of them are refused with an error. Every row is predicted from its text alone.

Defined results: a null text, or one without a letter, is `und` with score 0. With no labelled row at all, every text is `und`.
A row with a null id can't be drawn for training; it is predicted like any other.
Repeated rows are predicted alike; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

BUCKETS = 1 << 15
GRAMS = 3
PENALTY = 12.0
PER_LANGUAGE = 1500
LANGUAGES = 512
MIN_SCRIPT_SHARE = 0.01
#: Where scripts begin and end, by code point (Unicode blocks).
SCRIPTS = (
    ("Latin", 0x0041, 0x024F), ("Greek", 0x0370, 0x03FF), ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F),
    ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x06FF), ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF),
    ("Tamil", 0x0B80, 0x0BFF), ("Thai", 0x0E00, 0x0E7F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF),
    ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x1F00, 0x1FFF), ("Hiragana", 0x3040, 0x309F), ("Katakana", 0x30A0, 0x30FF),
    ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
)
NAMES = ("Other", *dict.fromkeys(s for s, _, _ in SCRIPTS))
SLAB = 1 << 20
#: N-grams are formed for about so many code points at once, so a text of any length needs few temporary arrays.
CHUNK = 1 << 17

_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter, and its script."""
    if not _TABLES:
        letters = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), dtype=bool)
        script = np.zeros(0x110000, dtype=np.uint8)
        for name, a, b in SCRIPTS:
            script[a : b + 1] = NAMES.index(name)
        _TABLES["letters"], _TABLES["scripts"] = letters, script
    return _TABLES["letters"], _TABLES["scripts"]


class Model(NamedTuple):
    languages: tuple[str, ...]
    grams: np.ndarray  # (GRAMS * BUCKETS, languages) float32
    scripts: np.ndarray  # (scripts, languages) bool


def _grams(points: np.ndarray, letters: np.ndarray) -> list[np.ndarray]:
    """At each code point, the classes of the n-grams that end there; what is no letter is an edge (0)."""
    c = np.where(letters, points, 0).astype(np.uint64)
    back = [c]
    for i in (1, 2, 3):
        p = np.zeros_like(c)
        p[i:] = c[:-i]
        back.append(np.where(back[-1] == 0, 0, p) if i > 1 else p)
    out, h = [], back[0]
    for i in range(1, GRAMS + 1):
        h = h * np.uint64(0x100000001B3) + back[i] + np.uint64(1)
        x = h * np.uint64(0x9E3779B97F4A7C15)
        out.append((x >> np.uint64(49)).astype(np.int64) + (i - 1) * BUCKETS)
    return out


def _batched(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about SLAB code points: their points lowered, one after another with a gap, and pointers."""
    row = 0
    while row < len(texts):
        parts, size, at = [], [0], row
        while row < len(texts) and (row == at or size[-1] < SLAB):
            x = np.frombuffer(((texts[row] or "").lower() + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
            parts.append(x)
            size.append(size[-1] + len(x))
            row += 1
        yield at, row, np.concatenate(parts), np.array(size, dtype=np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    is_letter, script_of = _tables()
    grams: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b, points, ptr in _batched(texts):
            letters = is_letter[points]
            for i in range(a, b):
                have = grams.setdefault(langs[i], np.zeros(GRAMS * BUCKETS + len(NAMES), dtype=np.int64))
                begin, end = int(ptr[i - a]), int(ptr[i - a + 1])
                for at in range(begin, end, CHUNK):
                    # the n-grams that end in this chunk reach GRAMS code points back
                    back, to = max(begin, at - GRAMS), min(at + CHUNK, end)
                    own = letters[at:to]
                    for g in _grams(points[back:to], letters[back:to]):
                        have += np.bincount(g[at - back :][own], minlength=len(have))
                    have[GRAMS * BUCKETS :] += np.bincount(script_of[points[at:to]][own], minlength=len(NAMES))
    for lang, have in grams.items():
        some = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(have[some])], ["lang", "class", "n"])


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from the rows with a text and a label."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    # a language's share of the hash range that holds about three times the ids wanted; only these are ranked, so a
    # language with a third of all rows is no larger a task than any other
    drawn = rows.select("lang", "id").withColumn("_u", F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40))
    sizes = [(r["lang"], r["_n"]) for r in drawn.groupBy("lang").agg(F.count("*").alias("_n")).limit(LANGUAGES + 1).collect()]
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels: not a set of languages")
    table = labelled.sparkSession.createDataFrame(sizes, "lang string, _n long")
    near = drawn.join(F.broadcast(table), "lang").filter(F.col("_u") < 3.0 * per_language / F.col("_n"))
    order = Window.partitionBy("lang").orderBy("_u", "id")
    chosen = near.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= per_language).select("id", "lang")
    # at most per_language ids for each language: small enough to broadcast, so texts don't move
    sample = rows.join(F.broadcast(chosen.distinct()), ["id", "lang"], "left_semi")
    counts = sample.select("text", "lang").mapInArrow(_counted, "lang string, class int, n long").groupBy("lang", "class").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # at most 3 * BUCKETS numbers a language, as arrays
    names = found.column("lang").to_numpy()
    languages, which = np.unique(names.astype(str), return_inverse=True) if len(names) else (names, names.astype(np.int64))
    languages = tuple(languages.tolist())
    table = np.zeros((GRAMS * BUCKETS + len(NAMES), len(languages)))
    table[found.column("class").to_numpy(), which] = found.column("n").to_numpy()
    grams, scripts = table[: GRAMS * BUCKETS] + 0.5, table[GRAMS * BUCKETS :]
    for g in range(GRAMS):
        part = grams[g * BUCKETS : (g + 1) * BUCKETS]
        part /= part.sum(axis=0)
    shares = scripts / np.maximum(scripts.sum(axis=0), 1)
    return Model(languages, np.log(grams).astype(np.float32), shares >= MIN_SCRIPT_SHARE)


def _word_scores(points: np.ndarray, ptr: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, languages) scores, letters of each word, pointers to each row's words, where each word begins."""
    is_letter, script_of = _tables()
    letters = is_letter[points]
    begins = letters.copy()
    begins[1:] &= ~letters[:-1]
    start = np.flatnonzero(begins)
    at = np.searchsorted(start, ptr)
    if not len(start):
        return np.zeros((0, len(model.languages)), dtype=np.float32), np.zeros(0, dtype=np.int64), at, start
    words, size = np.empty((len(start), len(model.languages)), dtype=np.float32), np.empty(len(start), dtype=np.int64)
    a = 0
    while a < len(start):  # whole words, about CHUNK code points: no n-gram reaches over a word's edge
        b = max(a + 1, int(np.searchsorted(start, start[a] + CHUNK)))
        s = slice(start[a], start[b] if b < len(start) else len(points))
        own = np.flatnonzero(letters[s])
        heads = np.searchsorted(own, start[a:b] - start[a])
        scores = np.zeros((len(own), len(model.languages)), dtype=np.float32)
        for g in _grams(points[s], letters[s]):
            scores += model.grams[g[own]]
        words[a:b] = np.add.reduceat(scores, heads, axis=0)
        size[a:b] = np.diff(np.append(heads, len(own)))
        a = b
    able = model.scripts[script_of[points[start]]]
    able |= ~able.any(axis=1, keepdims=True)
    # a long word counts as one of twelve letters at most, so that no single token outweighs a passage
    words *= np.minimum(1, 12 / size)[:, None].astype(np.float32)
    words[~able] = -np.inf
    return words, size, at, start


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best labels of each (words, languages) table, all stepped together."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(scores)
    at = 0
    while at < len(order):
        longest = len(scores[order[at]])
        group = order[at : at + max(1, min(512, (1 << 20) // max(longest, 1)))]
        at += len(group)
        n, k = len(group), scores[0].shape[1]
        length = np.array([len(scores[i]) for i in group])
        grid = np.zeros((longest, n, k), dtype=np.float32)
        for j, i in enumerate(group):
            grid[: length[j], j] = scores[i]
        best, jump, source = grid[0].astype(np.float64), np.zeros((longest, n, k), dtype=bool), np.zeros((longest, n), dtype=np.int16)
        live = n
        for t in range(1, longest):
            while length[live - 1] <= t:
                live -= 1
            b = best[:live]
            top = b.argmax(axis=1)
            other = b[np.arange(live), top][:, None] - penalty
            jump[t, :live] = other > b
            source[t, :live] = top
            best[:live] = np.maximum(b, other) + grid[t, :live]
        for j, i in enumerate(group):
            labels = np.empty(length[j], dtype=np.int64)
            now = int(best[j].argmax())
            for t in range(length[j] - 1, -1, -1):
                labels[t] = now
                if jump[t, j, now]:
                    now = int(source[t, j])
            out[i] = labels
    return out


def label(scores: np.ndarray, at: np.ndarray, penalty: float) -> list[np.ndarray | int]:
    """For each row its words' labels, or one label where Viterbi gives the same to all."""
    out: list[np.ndarray | int] = []
    hard: list[int] = []
    best = scores.max(axis=1) if len(scores) else np.zeros(0)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if a == b:
            out.append(-1)
            continue
        rows = scores[a:b]
        k = int(rows.sum(axis=0, dtype=np.float64).argmax())
        out.append(k)
        gain = np.append(0.0, np.cumsum(best[a:b] - rows[:, k], dtype=np.float64))
        # gains are never negative, so the best stretch to leave for is the whole text at most
        if gain[-1] > penalty:
            hard.append(i)
    for i, labels in zip(hard, viterbi([scores[at[i] : at[i + 1]] for i in hard], penalty) if hard else (), strict=True):
        out[i] = labels
    return out


def spans_of(text: str, model: Model, penalty: float = PENALTY) -> list[tuple[int, int, str]]:
    """(start, end, language) of the spans of a text; a span runs from its first word to the next span's."""
    if not model.languages:
        return []
    x = np.frombuffer("".join(c.lower() if len(c.lower()) == 1 else c for c in text).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    scores, _, at, start = _word_scores(x, np.array([0, len(x)]), model)
    found = label(scores, at, penalty)[0]
    if isinstance(found, int):
        return [] if found < 0 else [(int(start[0]), len(text), model.languages[found])]
    edges = [0, *(np.flatnonzero(np.diff(found)) + 1).tolist()]
    ends = [*(int(start[e]) for e in edges[1:]), len(text)]
    return [(int(start[e]), end, model.languages[found[e]]) for e, end in zip(edges, ends, strict=True)]


RESULT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def predictor(docs: DataFrame, model: Model, penalty: float = PENALTY):
    """A column function: text -> struct(lang_pred, score). The model is broadcast; its size is bounded by its classes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(text: pa.Array) -> pa.Array:
        m = shared.value
        langs, scores = [], []
        texts = text.to_pylist()
        if not m.languages:
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        else:
            for a, b, points, ptr in _batched(texts):
                words, size, at, _ = _word_scores(points, ptr, m)
                for i, found in enumerate(label(words, at, penalty)):
                    if isinstance(found, int):
                        langs.append("und" if found < 0 else m.languages[found])
                        scores.append(0.0 if found < 0 else 1.0)
                    else:
                        held = np.bincount(found, weights=size[at[i] : at[i + 1]], minlength=len(m.languages))
                        langs.append(m.languages[int(held.argmax())])
                        scores.append(float(held.max() / held.sum()))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return lambda text: F.arrow_udf(predict, RESULT)(text)


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", penalty: float = PENALTY) -> Column:
    return predictor(docs, model, penalty)(F.col(text_col).cast("string"))
