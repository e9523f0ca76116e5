"""Token ids of the fixed byte-level vocabulary, with the places of tokens in the text.

The vocabulary's ranks file is read by `tiktoken`, which gives the ids of the `tokenizers` file of the same vocabulary (tested on
whole tables and on random text) in a quarter of the time, as arrays. The file's added tokens, and marks given by the caller,
have ids of their own wherever they stand in a text.

Texts of any length are encoded whole. Runs of white space beyond LONG characters are passed to the merges as the one
piece that the pattern makes of them, since matching the pattern's look-ahead over them exhausts the matcher's stack.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np

#: The characters that the pattern takes for white space.
_SPACE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LONG = 1 << 15
_RUNS = re.compile(f"[{_SPACE}]{{{LONG},}}")
_ENCODERS: dict[tuple, Encoder] = {}


class Encoder:
    def __init__(self, path: str | None, marks: tuple[str, ...]) -> None:
        import public_tokenizers
        import tiktoken

        added = {}
        if path is None:
            with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
                added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        first = max([*ranks.values(), *added.values()]) + 1
        added |= {mark: first + i for i, mark in enumerate(marks)}
        self._own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self._bytes = np.zeros(first + len(marks), dtype=np.int64)
        for token, i in [*ranks.items(), *((mark.encode(), i) for mark, i in added.items())]:
            self._bytes[i] = len(token)

    def _parts(self, text: str) -> Iterator[np.ndarray]:
        at = 0
        for run in _RUNS.finditer(text):
            # before other text, the run's last character belongs to what follows
            end = run.end() - (run.end() < len(text))
            yield self._own.encode_to_numpy(text[at : run.start()], allowed_special="all")
            yield np.array(self._own._encode_single_piece(text[run.start() : end]), dtype=np.uint32)
            at = end
        yield self._own.encode_to_numpy(text[at:], allowed_special="all")

    def ids(self, text: str) -> np.ndarray:
        if len(text) < LONG:
            return self._own.encode_to_numpy(text, allowed_special="all")
        return np.concatenate(list(self._parts(text)))

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each token begins and ends in the text's characters; a character is in every token that holds a byte of it."""
        ends = np.cumsum(self._bytes[ids])
        starts = ends - self._bytes[ids]
        if text.isascii():
            return starts, ends
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
        return chars[starts + 1] - 1, chars[ends]


def encoder(path: str | None = None, marks: tuple[str, ...] = ()) -> Encoder:
    """The encoder of the fixed vocabulary, or of another ranks file (which has no added tokens); one for each process."""
    key = (path, marks)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, marks)
    return _ENCODERS[key]
