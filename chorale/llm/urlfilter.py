"""URL verdicts by a broadcast trie over reversed host labels and path segments.

A rule has a host, a path prefix and a verdict. It fits its host and every subdomain, if the url's path starts with
the rule's path (the last segment may be a part of the url's). Of the rules that fit, that with the most host
labels wins, then that with the longest path; of an allow and a block rule that are equal, block wins. No rule: the default
verdict.

The trie is broadcast in parts of RULES rules, each with one pass over the urls that keeps the better match, so a list of any
length is held whole and no broadcast exceeds its bound.

Defined results: a null url, or one without `://`, has an empty host and path and the default verdict. Rows are
judged one by one, so repeated rows, extra columns (kept) and empty tables need no rule.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.llm._common import free

RULES = 200_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str = ""

    def __str__(self) -> str:
        return self.host + self.path


class Node:
    """One host label or path segment: its children, the rules that end inside a segment below it, its own rule."""

    __slots__ = ("hosts", "paths", "prefixes")

    def __init__(self) -> None:
        self.hosts: dict[str, Node] = {}
        self.paths: dict[str, Node] = {}
        self.prefixes: dict[str, Rule] = {}


def build(rules: Sequence[Rule]) -> Node:
    root = Node()
    for rule in rules:
        node = root
        for label in reversed(rule.host.lower().split(".")) if rule.host else ():
            node = node.hosts.setdefault(label, Node())
        *whole, last = rule.path.split("/")
        for segment in whole:
            node = node.paths.setdefault(segment, Node())
        old = node.prefixes.get(last)
        if old is None or rule.verdict == "block":
            node.prefixes[last] = rule
    return root


def _longest_path(node: Node, segments: list[str]) -> Rule | None:
    best = None
    for i, segment in enumerate(segments):
        if node.prefixes:
            best = next((r for n in range(len(segment), -1, -1) if (r := node.prefixes.get(segment[:n]))), best)
        below = node.paths.get(segment) if i + 1 < len(segments) else None
        if below is None:
            return best
        node = below
    return best


def match(root: Node, host: str, path: str) -> tuple[int, Rule] | None:
    """(host labels matched, rule) of the longest match."""
    segments, best, node, depth = path.split("/"), None, root, 0
    labels = host.split(".") if host else []
    while node is not None:
        if found := _longest_path(node, segments):
            best = depth, found
        node = node.hosts.get(labels[-1 - depth]) if depth < len(labels) else None
        depth += 1
    return best


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    after = F.when(url.contains("://"), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    rest = F.regexp_extract(after, r"(?s)^([^/?#]*)([^?#]*)", 1), F.regexp_extract(after, r"(?s)^([^/?#]*)([^?#]*)", 2)
    return F.translate(rest[0], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), rest[1]


def _judge(batches: Iterator[pa.RecordBatch], trie, rank_name: str) -> Iterator[pa.RecordBatch]:
    root = trie.value
    for batch in batches:
        get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
        rank, rule, verdict = get(rank_name), get("rule"), get("verdict")
        known: dict[tuple[str, str], tuple | None] = {}  # each distinct host and path of a batch is looked up once
        for i, place in enumerate(zip(get("host"), get("path"), strict=True)):
            if place not in known:
                found = match(root, *place)
                known[place] = found and ([found[0], len(found[1].path), int(found[1].verdict == "block")], str(found[1]), found[1].verdict)
            if (new := known[place]) and (rank[i] is None or new[0] > rank[i]):
                rank[i], rule[i], verdict[i] = new
        out = batch.drop_columns(["rule", "verdict", rank_name])
        for name, column, kind in (("rule", rule, pa.string()), ("verdict", verdict, pa.string()), (rank_name, rank, pa.list_(pa.int32()))):
            out = out.append_column(name, pa.array(column, kind))
        yield out


def judge(pages: DataFrame, rules: Sequence[Rule], *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict; columns of these names are replaced, all others kept."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    rank = free(pages, "_rank")
    none = F.lit(None)
    out = pages.withColumns({"host": host, "path": path, "rule": none.cast("string"), "verdict": none.cast("string"), rank: none.cast("array<int>")})
    out = out.select(*[c for c in out.columns if c not in ("rule", "verdict", rank)], "rule", "verdict", rank)
    for at in range(0, len(rules), RULES):
        trie = spark.sparkContext.broadcast(build(rules[at : at + RULES]))
        out = out.mapInArrow(lambda b, t=trie: _judge(b, t, rank), out.schema)
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default))).drop(rank)
