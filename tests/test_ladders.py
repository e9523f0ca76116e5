"""The ladders' worked examples."""

import pytest
from pyspark.sql import functions as F

from chorale.functions import ladders, text


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("said", "bids"),
    [
        ("How are you?", ["question", "care"]),
        ("I’m sorry, can’t wait to see you tonight", ["logistics", "affection", "repair"]),
        ("let’s hang out", ["invitation"]),
        ("see HTTPS://example.org", ["shared_object"]),
        ("planned", []),
        ("", []),
        (None, []),
    ],
)
def test_bids(spark, said, bids):
    t = F.col("t").cast("string")
    assert one(spark, ladders.kinds_of(ladders.BIDS, t, F.lit(False)), t=said) == bids


def test_an_attachment_is_a_shared_object_without_text(spark):
    assert one(spark, ladders.kinds_of(ladders.BIDS, F.col("t").cast("string"), F.lit(True)), t=None) == ["shared_object"]


@pytest.mark.parametrize(
    ("said", "opener", "loop"),
    [
        ("Sorry, are you ok?", "repair", "repair"),
        ("are you okay", "care", "care"),
        ("are you there", "question", "question"),
        ("dinner tonight?", "planning", "logistics"),
        ("lol", "play", None),
        ("a https://x.org", "object", None),
        ("ahttps://x.org", None, None),
        ("omw", "arrival", None),
        ("i just ate", "status", None),
        ("I'll send it", None, "task"),
        ("really?", "question", "question"),
        ("hm", None, None),
    ],
)
def test_first_kinds(spark, said, opener, loop):
    assert one(spark, ladders.first_kind(ladders.OPENERS, F.col("t"), F.lit(False)), t=said) == opener
    assert one(spark, ladders.first_kind(ladders.LOOPS, F.col("t"), F.lit(False)), t=said) == loop


@pytest.mark.parametrize(("said", "shape"), [("Could you?", "can_could"), ("well, does it", "do_did"), ("whatever?", "other"), ("is it when", "are_is"), ("Who", "who")])
def test_question_shapes(spark, said, shape):
    assert one(spark, ladders.question_shape(F.col("t")), t=said) == shape


def test_rituals(spark):
    assert one(spark, ladders.kinds_of(ladders.RITUALS, F.col("t"), F.lit(False)), t="Goodnight, love you, sleep well") == ["night", "love", "sleep"]


def test_emoji(spark):
    said = "a \U0001f600\U0001f600 \U0001f469‍\U0001f680 ❤️ ⬛\U0001f7e9 1 ➡️"
    assert one(spark, ladders.emoji(F.col("t")), t=said) == ["\U0001f600", "\U0001f600", "\U0001f469‍\U0001f680", "❤️"]


def test_hits_count_phrases_twice(spark):
    assert one(spark, ladders.hits(F.col("t"), ("love", "miss"), ("thank you", "means a lot")), t="Love love thank you") == 4
    assert one(spark, ladders.hits(F.col("t").cast("string"), ("love",), ("thank you",)), t=None) == 0


@pytest.mark.parametrize(("said", "bare"), [("see  https://a.b/c?d=1  now", "see now"), ("at example.com/menu ok", "at ok"), ("no links", "no links"), ("http://x.org", "")])
def test_without_links(spark, said, bare):
    assert one(spark, ladders.without_links(F.col("t")), t=said) == bare


def test_preview(spark):
    assert one(spark, ladders.preview(F.col("t"), 6), t="ab  cd\nef") == "ab cd…"
    assert one(spark, ladders.preview(F.col("t"), 8), t=" ab  cd\nef ") == "ab cd ef"


@pytest.mark.parametrize(
    ("method", "sample", "low", "high", "f1", "caveats", "label"),
    [
        ("statistical", 80, 0.1, 0.2, None, 0, "high"),
        ("statistical", 80, -0.1, 0.2, None, 0, "low"),
        ("statistical", 80, 0.1, 0.2, 0.7, 0, "medium"),
        ("heuristic", 500, None, None, None, 0, "medium"),
        ("statistical", 79, -0.2, -0.1, 0.9, 2, "medium"),
        ("statistical", 29, 0.1, 0.2, 0.9, 0, "low"),
        ("statistical", 500, 0.1, 0.2, 0.9, 3, "low"),
        ("speculative", 500, 0.1, 0.2, 0.9, 0, "low"),
    ],
)
def test_confidence(spark, method, sample, low, high, f1, caveats, label):
    c = {k: F.lit(v).cast("double") for k, v in {"low": low, "high": high, "f1": f1}.items()}
    assert one(spark, ladders.confidence(F.lit(method), F.lit(sample), c["low"], c["high"], c["f1"], F.lit(caveats)), t=0) == label


def test_smoothing_and_window_lift(spark):
    assert one(spark, ladders.smoothed_rate(F.lit(0), F.lit(0), F.lit(0.25)), t=0) == 0.25
    assert one(spark, ladders.window_lift(F.lit(3), F.lit(6), F.lit(3), F.lit(6)), t=0) == 0.0
    assert one(spark, ladders.window_lift(F.lit(6), F.lit(6), F.lit(0), F.lit(6)), t=0) == pytest.approx(2 * 3.700439718)


@pytest.mark.parametrize(
    ("said", "kind", "want"),
    [("what time is dinner", "planning", True), ("when should we go", "planning", True), ("no plan", "planning", False), ("want to cuddle", "affection", True), ("don't kiss", "affection", False), ("a kiss's worth", "affection", True)],
)
def test_lexicons(spark, said, kind, want):
    assert one(spark, text.lexicon_match(F.col("t"), kind), t=said) is want
