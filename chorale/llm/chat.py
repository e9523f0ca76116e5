"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: for each turn <|turn|>role<|text|>text<|end|>. Control strings (the template's and
other templates') inside roles and texts are escaped by a tilde after their first character, one more where tildes
stand there already, which is undone exactly. The marks are single tokens of the encoder, and no token crosses
one. The rendered text is encoded once with offsets; turns and tokens are both sorted, so binary search finds the
tokens of each assistant span, and these alone bear loss.

Rows are dealt by conversation and streamed in the order of their turns. Since no token crosses a mark, a conversation of
more than CHARS characters is encoded and written in parts of whole turns, so memory holds one part. A single turn is
held and encoded whole (Arrow bounds it at 2 GB), and a conversation, whose turns have an order, is read by one task.

Defined results: null texts and roles are empty; null conversation ids are one conversation; turns that are null come
first, equal ones in the order of role and text; repeated rows are turns of their own; extra columns are ignored; an empty table
gives an empty table. Ids and turns are whole numbers or cast to them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm._common import width
from chorale.llm._tokens import encoder

#: This template's marks, and control strings of other templates, escaped like them.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_CONTROL = re.compile(r"[<\[](?=~*(?:\||/?s>|/?INST\]))")
_ESCAPED = re.compile(r"([<\[])~(?=~*(?:\||/?s>|/?INST\]))")
_PARTS = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)
CHARS = 1 << 20
SCHEMA = "conv_id long, part int, text string, ids array<int>, loss_mask array<boolean>, starts array<int>, ends array<int>"


def escape(s: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "~", s)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendered turns, and where each one's text lies."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def masked(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """The tokens that lie in one of the spans; starts, ends and spans are sorted."""
    edges = np.zeros(len(starts) + 1, dtype=np.int64)
    a, b = np.array(spans, dtype=np.int64).reshape(-1, 2).T
    first, last = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left")
    some = first < last
    np.add.at(edges, first[some], 1)
    np.add.at(edges, last[some], -1)
    return np.cumsum(edges[:-1]) > 0


def under_mask(text: str, mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The text under each run of masked tokens that lies between marks."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    firsts, lasts = starts[edges[::2]].tolist(), ends[edges[1::2] - 1].tolist()
    return [text[a:b] for a, b in zip(firsts, lasts, strict=True)]


def _formatted(batches: Iterator[pa.RecordBatch], loss_roles: frozenset[str], path: str | None) -> Iterator[pa.RecordBatch]:
    own = encoder(path, (TURN, TEXT, END))
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = ["conv_id", "part", "text", "ids", "loss_mask", "starts", "ends"]
    rows: list[tuple] = []
    turns: list[tuple[str, str]] = []
    now, part, size, first = None, 0, 0, True

    def close() -> None:
        text, spans = render(turns)
        ids = own.ids(text)
        starts, ends = own.offsets(text, ids)
        mask = masked(starts, ends, [s for s, (role, _) in zip(spans, turns, strict=True) if role in loss_roles])
        rows.append((now, part, text, ids.astype(np.int32), mask, starts.astype(np.int32), ends.astype(np.int32)))

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if turns and (conv != now or size >= CHARS):
                close()
                part = part + 1 if conv == now else 0
                turns, size = [], 0
                if sum(len(r[2]) for r in rows) >= CHARS:
                    yield table()
                    rows = []
            now = conv
            turns.append((role or "", text or ""))
            size += len(role or "") + len(text or "")
    if turns:
        close()
    if rows:
        yield table()


def format_conversations(conversations: DataFrame, *, loss_roles: frozenset[str] = frozenset({"assistant"}), tokenizer_path: str | None = None) -> DataFrame:
    """One row per conversation (or part of a very long one): the rendered text, its ids, their offsets and loss mask."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    ordered = rows.repartition(width(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(lambda b: _formatted(b, loss_roles, tokenizer_path), SCHEMA)


def read_back(text: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(body)) for role, body in _PARTS.findall(text)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    now = None

    def close() -> None:
        conv, n, turns, chars, loss, formatted = now
        out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

    for batch in batches:
        get = lambda c: batch.column(batch.schema.get_field_index(c))
        lists = [get(c) for c in ("loss_mask", "starts", "ends")]
        at = [x.offsets.to_numpy() for x in lists]
        mask, starts, ends = (x.values.to_numpy(zero_copy_only=False) for x in lists)
        for i, (conv, part, text) in enumerate(zip(*(get(c).to_pylist() for c in ("conv_id", "part", "text")), strict=True)):
            if part == 0:
                if now is not None:
                    close()
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, body in read_back(text):
                now[1] += 1
                now[2].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            own = [slice(x[i], x[i + 1]) for x in at]
            for piece in under_mask(text, mask[own[0]], starts[own[1]], ends[own[2]]):
                plain = unescape(piece)
                now[3] += len(plain)
                now[4].update(plain.encode("utf-8", "surrogatepass"))
            now[5] += len(text)
    if now is not None:
        close()
    if out:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame) -> DataFrame:
    """What formatted rows hold, read back from their texts, offsets and masks. Parts of a conversation follow one another in
    their partition, as `format_conversations` leaves them."""
    return formatted.drop("ids").mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
