"""Greedy selection, segmentation, decoding, streaming de-duplication."""

from __future__ import annotations

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from chorale.operators import greedy, segmentation
from chorale.sources import decoding


def test_greedy():
    assert greedy.spaced([5, 7, 11, 1, 16], lambda x: x, 5, 3) == [5, 11, 16]
    assert greedy.non_overlapping([(0, 9), (5, 14), (10, 19)], lambda s: s, 10, 0.35, 3) == [(0, 9), (10, 19), (5, 14)]
    rows = [("a", 10.0), ("a", 9.9), ("b", 9.8)]
    assert greedy.penalised(rows, lambda r: r[1], lambda r: r[0], 0.3, 2) == [("a", 10.0), ("b", 9.8)]
    assert greedy.diverse(rows, lambda r: r[1], lambda a, b: float(a[0] == b[0]), 0.32, 3) == [("a", 10.0), ("b", 9.8), ("a", 9.9)]
    assert greedy.capped(list("aaaabb"), lambda x: x, 2, 3, 5) == ["a", "a", "b", "b"]


def test_topic_cuts():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.05, (50, 4)) + np.eye(4)[i] for i in (0, 1, 2)])
    cuts = segmentation.topic_cuts(x)
    assert len(cuts) >= 2 and {50, 100} <= {min((50, 100), key=lambda c: abs(c - k)) for k in cuts if min(abs(k - 50), abs(k - 100)) <= 2}
    assert segmentation.topic_cuts(x[:40]) == []


def plain_communities(nodes, edges, most=9):
    """Labels one node and neighbour at a time."""
    label = {x: x for x, _, _ in nodes}
    for _ in range(24):
        for x, _, _ in sorted(nodes, key=lambda t: (-t[1], t[0])):
            votes = {}
            for a, b, w in edges:
                for here, there in ((a, b), (b, a)):
                    if here == x:
                        votes[label[there]] = votes.get(label[there], 0) + w
            if votes:
                label[x] = min(votes, key=lambda v: (-votes[v], v))
    names = sorted(set(label.values()), key=lambda v: (-sum(x == v for x in label.values()), v))
    number = {x: min(names.index(v), most - 1) for x, v in label.items()}
    if len(set(number.values())) >= 3:
        return number
    weight = {}
    for _, n, c in nodes:
        weight[c] = weight.get(c, 0) + n
    kinds = sorted(weight, key=lambda c: (-weight[c], c))
    return {x: min(kinds.index(c), most - 1) for x, _, c in nodes}


def test_communities():
    rng = np.random.default_rng(3)
    clique = lambda xs: [(a, b, 3.0) for i, a in enumerate(xs) for b in xs[i + 1 :]]
    edges = clique([1, 2, 3, 10]) + clique([4, 5, 6]) + clique([7, 8, 9]) + [(3, 4, 1.0), (6, 7, 1.0)]
    found = segmentation.communities([(x, 1, "k") for x in range(1, 11)], edges)
    assert [found[x] for x in range(1, 11)] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 0]
    two = [(x, x, "odd" if x % 2 else "even") for x in range(1, 7)]
    assert segmentation.communities(two, clique([1, 2, 3]) + clique([4, 5, 6])) == {1: 1, 2: 0, 3: 1, 4: 0, 5: 1, 6: 0}
    for _ in range(40):
        n = int(rng.integers(3, 30))
        nodes = [(int(x), int(rng.integers(1, 6)), "abc"[int(rng.integers(3))]) for x in rng.choice(100, n, replace=False)]
        edges = [(nodes[int(a)][0], nodes[int(b)][0], float(rng.integers(1, 5))) for a, b in rng.integers(0, n, (n, 2)) if a != b]
        assert segmentation.communities(nodes, edges) == plain_communities(nodes, edges)


def modularity(labels, edges):
    total = 2 * sum(w for _, _, w in edges)
    degree = [sum(w * ((a == x) + (b == x)) for a, b, w in edges) for x in range(len(labels))]
    inside = 2 * sum(w for a, b, w in edges if labels[a] == labels[b]) / total
    return inside - sum((sum(degree[x] for x in range(len(labels)) if labels[x] == c) / total) ** 2 for c in set(labels))


def test_modular():
    rng = random.Random(3)
    for _ in range(30):
        edges = [(a, b, rng.choice([0.3, 1.0, 2.0])) for a in range(6) for b in range(a) if rng.random() < 0.5]
        if edges:
            best = max(modularity(x, edges) for x in itertools.product(range(4), repeat=6))
            found = segmentation.modular(6, edges)
            assert modularity(found, edges) >= max(0.0, best - 0.1) - 1e-9
            assert found == segmentation.modular(6, edges)
    cliques = [(a + k, b + k, 1.0) for k in (0, 5, 10) for a in range(5) for b in range(a)] + [(4, 5, 0.5), (9, 10, 0.5)]
    found = segmentation.modular(15, cliques)
    assert len(set(found)) == 3 and all(len(set(found[k : k + 5])) == 1 for k in (0, 5, 10))
    assert segmentation.modular(3, []) == [0, 1, 2]


def test_threads():
    ids, ts, axes = np.arange(40) + 100, np.arange(40) * 10.0, np.eye(2)
    vectors, none = axes[np.arange(40) % 2], np.full(40, -1)
    assert segmentation.threads(ids, ts, vectors, none, tau=3600) == [ids[::2].tolist(), ids[1::2].tolist()]
    alone = segmentation.threads(ids[:4], np.arange(4) * 1e6, vectors[:4], none[:4])
    assert alone == [ids[:4].tolist()]
    reply = np.where(np.arange(5) == 4, 100, -1)
    assert segmentation.threads(ids[:5], np.zeros(5), np.eye(5), reply) == [ids[:5].tolist()]


def test_archived_text(spark):
    head = b"\x04\x0bstreamtyped\x81\xe8\x03\x84\x01@\x84\x84\x84\x12NSAttributedString\x00\x84\x84\x08NSObject\x00\x85\x92\x84\x84\x84\x08NSString\x01\x94\x84\x01+"
    long = "ü" * 100
    blobs = [head + b"\x05hello\x86", head + b"\x81" + (200).to_bytes(2, "little") + long.encode(), head + b"\x00\x86", b"\x00" * 20 + b"plain text here\x00NSString\x00", None, b"short"]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(blobs)], "i int, b binary")
    got = [r["t"] for r in df.orderBy("i").select(decoding.text_of(F.col("b")).alias("t")).collect()]
    assert got[0] == "hello" and got[1] == long and got[3] == "plain text here" and got[4:] == [None, None]


def test_links_and_handles(spark):
    df = spark.createDataFrame([(bytearray(b"\x00\x01http://a.b/c?d\x00x"), " Me@X.org "), (bytearray(b"none"), "+1 604 555 0199")], "p binary, h string")
    got = df.select(decoding.url_in(F.col("p")).alias("u"), decoding.handle_key(F.col("h")).alias("k")).collect()
    assert [tuple(r) for r in got] == [("http://a.b/c?d", "me@x.org"), (None, "6045550199")]
