"""Inflections on logs made by hand."""

import pytest

from chorale.plans import inflections

COLUMNS = "id long, ts long, is_from_me int, amt int, word_count long, has_attachment int, text string"


def log(spark, days):
    """A log with each day's texts, as (text, times) pairs."""
    rows = [(day, text) for day, texts in enumerate(days) for text, times in texts for _ in range(times)]
    return spark.createDataFrame([(i, day * 86400 + i % 86400, i % 2, None, 1, 0, text) for i, (day, text) in enumerate(rows)], COLUMNS)


def found(spark, days):
    return {(r["day"], r["kind"]): r for r in inflections.inflections(log(spark, days)).collect()}


def test_storm(spark):
    got = found(spark, [[("ok", 20)]] * 10 + [[("ok", 10), ("I am so tired", 10)]] * 10)
    # a week without strain before day 9, half of each day after it
    storm = got[9, "storm"]
    assert (storm["past"], storm["future"], storm["past_rate"], storm["future_rate"]) == (140, 140, 0.0, 50.0)
    assert storm["score"] == 50 * 0.8 + 2.5
    assert {kind for _, kind in got} == {"storm"}
    # the first week, and the last week and a day, have no whole weeks around them
    assert {day for day, _ in got} == {7, 8, 9, 10, 11}


def test_repair_needs_strain_before(spark):
    calm, hurt, mended = [("ok", 20)], [("ok", 19), ("that hurt", 1)], [("ok", 15), ("thank you", 5)]
    assert found(spark, [calm] * 10 + [mended] * 10) == {}
    got = found(spark, [hurt] * 10 + [mended] * 10)
    assert got[9, "repair"]["score"] == 25 * 0.75 + 2.5
    assert {kind for _, kind in got} == {"repair"}


@pytest.mark.parametrize(("before", "after", "kind"), [(5, 25, "surge"), (25, 5, "lull"), (2, 25, None), (25, 13, None)])
def test_volume(spark, before, after, kind):
    got = found(spark, [[("ok", before)]] * 10 + [[("ok", after)]] * 10)
    assert {k for day, k in got if day == 9} == ({kind} if kind else set())


def test_days_without_messages_count_and_no_log_has_none(spark):
    days = [[("ok", 25)]] * 10 + [[]] * 9 + [[("ok", 1)]]
    assert found(spark, days)[9, "lull"]["future"] == 0
    assert inflections.inflections(log(spark, [])).count() == 0
