"""Primitives against worked examples."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorale.functions import scope, stats, text, timeutil
from chorale.operators import models, sequence


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("r")).first()["r"]


def log(spark, rows):
    """(ts, is_from_me) -> messages of one chat."""
    return spark.createDataFrame([(i, 1, ts, me, 1) for i, (ts, me) in enumerate(rows)], "id long, chat_id int, ts long, is_from_me int, word_count long")


def test_turns_pairs_restarts(spark):
    m = log(spark, [(0, 1), (60, 1), (300, 0), (10000, 1)])
    t = sequence.turns(m)
    got = t.orderBy("turn").collect()
    assert [(r["ts"], r["end_ts"], r["n_msgs"], r["is_from_me"]) for r in got] == [(0, 60, 2, 1), (300, 300, 1, 0), (10000, 10000, 1, 1)]
    pairs = sequence.reply_pairs(t, 6 * 3600).orderBy("turn").collect()
    assert [(r["is_from_me"], r["latency"]) for r in pairs] == [(1, 240), (0, 9700)]
    assert sequence.restarts(m).count() == 0
    r = sequence.restarts(log(spark, [(0, 1), (10000, 1), (40000, 0)])).collect()
    assert [(x["gap"], x["from_sender"], x["is_from_me"]) for x in r] == [(30000, 1, 0)]


def test_turn_gap_is_strict_and_restart_gap_is_not(spark):
    assert sequence.turns(log(spark, [(0, 1), (1200, 1), (2401, 1)])).count() == 2
    assert sequence.restarts(log(spark, [(0, 1), (21600, 1), (43199, 1)])).count() == 1


def test_next_other(spark):
    m = sequence.next_other(log(spark, [(0, 1), (5, 1), (9, 0), (9, 1), (20, 0)])).orderBy("id").collect()
    assert [r["other_ts"] for r in m] == [9, 9, 9, 20, None]


@pytest.mark.parametrize(
    ("kind", "want"),
    [("text_turn", [0, 1]), ("visible_message", [0, 1, 2, 3]), ("reaction_add", [4, 5, 6]), ("reaction_remove", [7, 8]), ("object_message", [2, 3]), ("segmentable_text", [0]), ("all_row", list(range(9)))],
)
def test_kinds(spark, kind, want):
    rows = list(enumerate([None, 0, 2, 3, 2000, 2001, 2006, 3000, 3001]))
    df = spark.createDataFrame([(i, a, "" if i == 1 else "x") for i, a in rows], "id int, amt int, text string")
    assert [r["id"] for r in df.filter(scope.kind_filter(kind)).orderBy("id").collect()] == want


def test_local_time(spark):
    rows = [(1704092400, "2023-12-31", 23), (1710063000, "2024-03-10", 1), (1710066600, "2024-03-10", 3)]
    df = spark.createDataFrame([(r[0],) for r in rows], "ts long")
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = df.select(timeutil.ymd(F.col("ts")).alias("d"), timeutil.hour(F.col("ts")).alias("h")).collect()
        assert [(r["d"], r["h"]) for r in got] == [r[1:] for r in rows]
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    start, end = scope.month_bounds("2024-03")
    assert end - start == 31 * 86400 - 3600
    assert scope.day_end("2024-03-10") - scope.day_start("2024-03-10") == 23 * 3600


def test_scope_parsing():
    for raw in (4, "4", '"4"'):
        assert scope.Scope.parse({"phase": raw}).phase == 4
    assert scope.Scope.parse({"phase": "x", "from": "2024-1-1", "sender": "who"}) == scope.Scope()
    phases = {1: ("2023-11", "2023-11")}
    s = scope.Scope(phase=1).within(phases)
    assert (s.from_, s.to) == ("2023-11-01", "2023-11-30")
    assert scope.Scope(from_="2023-11-10", phase=1).within(phases).from_ == "2023-11-10"


def test_tokens_and_negation(spark):
    assert one(spark, text.base_tokens(F.col("t"), 2), t="I’m going, but 'excited'!") == ["i'm", "going", "but", "excited"]
    assert one(spark, text.negated(text.base_tokens(F.col("t"), 1)), t="not really feeling sad today") == ["not", "really_NEG", "feeling_NEG", "sad_NEG", "today_NEG"]
    assert one(spark, text.negated(text.base_tokens(F.col("t"), 1)), t="never a b no c d e f g") == ["never", "a_NEG", "b_NEG", "no", "c_NEG", "d_NEG", "e_NEG", "f_NEG", "g"]
    assert one(spark, text.ngrams(F.col("t"), 2), t=["a", "b", "c"]) == ["a b", "b c"] and one(spark, text.ngrams(F.col("t"), 3), t=["a"]) == []


@pytest.mark.parametrize(
    ("t", "kind", "want"),
    [("I love you", "warmth", True), ("I don't love that", "warmth", False), ("sorry, when is dinner?", "repair", False), ("I'm sorry", "repair", True), ("Sorry I was cold when you called", "repair", True), ("I'm sorry, when is dinner?", "repair", False), ("I am sorry, that came out wrong", "repair", True), ("my bad", "repair", True), ("no thanks", "gratitude", False), ("thank you", "gratitude", True), ("not safe", "care", False), ("not funny", "humor", False), ("I feel sad", "strain", True)],
)
def test_lexicons(spark, t, kind, want):
    assert one(spark, text.lexicon_match(F.col("t"), kind), t=t) is want


@pytest.mark.parametrize(("t", "att", "want"), [("how are you?", False, "care"), ("where should we meet?", False, "logistics"), ("", True, "object"), ("hmm", False, "ambient"), ("is it?", False, "question"), ("love you", False, "affection"), ("lol", False, "play")])
def test_moves(spark, t, att, want):
    assert one(spark, text.move(F.col("t"), F.col("a")), t=t, a=att) == want


def test_redaction(spark):
    r = one(spark, text.redacted(F.col("t")), t="mail a.b@c.org or call 604-555-0199, 12 St. John's Main Terrace on Monday with Ana, Jo and Mayra")
    assert (r["emails"], r["phones"], r["addresses"], r["names"]) == (1, 1, 1, 2)
    assert r["text"] == "mail [redacted-email] or call [redacted-phone], [redacted-address] on Monday with [redacted-name], Jo and [redacted-name]"


def test_syllables_and_sentences(spark):
    assert [one(spark, text.syllables(F.col("t")), t=w) for w in ("make", "banana", "the", "")] == [1, 3, 1, 0]
    assert one(spark, text.sentences(F.col("t")), t="One. Two!  Three? four") == ["One.", "Two!", "Three?", "four"]
    # places in the list are no characters to trim
    assert one(spark, text.sentences(F.col("t")), t="0 of 10. 11 came back. 22 left") == ["0 of 10.", "11 came back.", "22 left"]


def test_medians_and_rounding(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "x long")
    assert df.agg(stats.median_upper("x"), stats.median_mean("x"), stats.quantile_floor("x", 0.5), stats.quantile_round("x", 0.5), stats.quantile_linear("x", 0.25)).first()[:] == (3, 2.5, 2, 3, 1.75)
    assert one(spark, stats.js_round(F.col("x"), 0), x=-2.5) == -2.0


def test_contiguous_ranges_against_brute_force():
    import itertools

    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 2)) + np.repeat([0, 5, 1], 4)[:, None]
    cost = lambda a, b: ((x[a:b] - x[a:b].mean(axis=0)) ** 2).sum()
    best = min((c for c in itertools.combinations(range(1, 12), 2) if min(c[0], c[1] - c[0], 12 - c[1]) >= 2), key=lambda c: cost(0, c[0]) + cost(c[0], c[1]) + cost(c[1], 12))
    assert models.contiguous_ranges(x, 3, 2) == [(0, best[0] - 1), (best[0], best[1] - 1), (best[1], 11)]
    assert models.contiguous_ranges(x[:5], 3, 2) == [(0, 4)]


def test_auc_and_generator():
    y, s = np.array([0, 0, 1, 1]), np.array([0.1, 0.4, 0.35, 0.8])
    assert models.auc(s, y) == 0.75
    point, low, high = models.bootstrap_auc(s, y, samples=50, block=2)
    assert low <= point <= high and models.bootstrap_auc(s, y, samples=50, block=2) == (point, low, high)
    draw = models.Mulberry32(1)
    assert [round(draw(), 6) for _ in range(2)] == [0.627074, 0.002736]


def test_logistic_and_k_means():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(-2, 1, (60, 1)), rng.normal(2, 1, (60, 1))])
    y = np.repeat([0, 1], 60)
    w, b = models.logistic(x, y)
    assert (((x @ w + b) > 0) == y).mean() > 0.95
    twice = models.logistic(x, y, np.full(120, 2.0))
    assert np.allclose(twice[0], w) and twice[1] == pytest.approx(b)
    labels, _ = models.k_means(np.concatenate([x, x + 50]), 2, 20)
    assert len(set(labels[:120])) == 1 and labels[0] != labels[-1]
