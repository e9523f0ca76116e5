"""Whether a reply has what its source has: nine features of turns, by direction, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorale.functions import ladders
from chorale.functions import text as texts
from chorale.functions.scope import kind_filter
from chorale.functions.stats import js_round
from chorale.operators import sequence
from chorale.plans.dialect import MESSAGES, bounded, rounded
from chorale.sources.tables import PHRASES, phrased

#: The words that show a register, and how many sources a direction needs.
REGISTERS = {
    "warmth": "love|miss|proud|sweet|cute|beautiful|handsome|excited|cuddle|snuggle|kiss|sweetheart|darling|adorable|lovely|heart|thank you|thanks|appreciate|grateful|thankful",
    "humor": "lol|lmao|haha|hehe|funny|silly|wild|ridiculous|joke|hilarious",
    "strain": "sad|anxious|anxiety|worried|worry|scared|afraid|hurt|cry|crying|upset|stress|stressed|hard|tired|exhausted|lonely|overwhelmed|frustrated|rough|bad day",
    "repair": "sorry|apologize|apologise|forgive|my bad|misunderstood|didn'?t mean|didnt mean|should have|i understand|that makes sense|talk about|hope you|feel better|sleep well|take care|checking in",
    "planning": "when|where|tonight|tomorrow|today|time|meet|come over|coming over|dinner|lunch|plans?|schedule|ride|pickup|pick up|drop off|book|reservation",
}
LEAST_SOURCES, REPLY_WITHIN, LONG = 35, 86400, 0.75
FEATURES = ("length", "questions", *REGISTERS, "emoji", "attachments")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns with a 0 or 1 for each feature. A turn's text is its messages' in order, without links, so a phrase may reach over
    two of them; a turn is long that has more words than three quarters of its sender's, found from the counts by words."""
    m = sequence.turn_ids(phrased(spark, d).filter(kind_filter("visible_message")))
    said = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "(?i)https?://[^ \\t\\r\\n]+", " ")
    parts = F.array_sort(F.collect_list(F.struct("ts", "id", said.alias("said"))))
    t = m.groupBy("chat_id", "turn").agg(
        F.first("is_from_me").alias("is_from_me"),
        F.min("ts").alias("ts"),
        F.max("ts").alias("end_ts"),
        F.min_by("id", F.struct("ts", "id")).alias("id"),
        F.sum("word_count").alias("words"),
        F.max("has_attachment").alias("attachments"),
        F.regexp_replace(F.array_join(parts["said"], " "), "[ \\t\\r\\n]+", " ").alias("text"),
    )
    by = Window.partitionBy("is_from_me")
    counts = t.groupBy("is_from_me", "words").agg(F.count("*").alias("n"))
    counts = counts.withColumns({"upto": F.sum("n").over(by.orderBy("words")), "of": F.sum("n").over(by)})
    limit = counts.filter(F.col("upto") > F.floor((F.col("of") - 1) * LONG)).groupBy("is_from_me").agg(F.min("words").alias("limit"))
    flags = {
        "length": F.col("words") > F.col("limit"),
        "questions": F.col("text").contains("?"),
        **{name: texts.has(F.col("text"), words) for name, words in REGISTERS.items()},
        "emoji": F.col("text").rlike(ladders.PICTOGRAPH),
    }
    return t.join(F.broadcast(limit), "is_from_me").withColumns({name: test.cast("int") for name, test in flags.items()})


def mirror_effects(spark: SparkSession, d: str) -> DataFrame:
    """By direction and feature: how often a reply has the feature at all and after a source with it, the difference and the
    ratio (0 below 35 such sources), phi (0 where it is undefined), and the middle waits after sources with and without it."""
    t = _turns(spark, d)
    w = sequence.ordered()
    p = t.withColumns({f"reply_{x}": F.lead(x).over(w) for x in ("ts", "is_from_me", *FEATURES)}).withColumn("wait", F.col("reply_ts") - F.col("end_ts"))
    p = p.filter((F.col("reply_is_from_me") != F.col("is_from_me")) & F.col("wait").between(0, REPLY_WITHIN))
    way = F.when(F.col("is_from_me") == 1, "me_to_them").otherwise("them_to_me").alias("direction")
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).alias("a"), F.col(f"reply_{x}").alias("b")) for x in FEATURES]))
    g = p.select(way, "wait", each.alias("f")).select("direction", "wait", "f.*").groupBy("direction", "feature").agg(
        F.count("*").alias("n"),
        F.sum("a").alias("high"),
        F.sum("b").alias("replies"),
        F.sum(F.col("a") * F.col("b")).alias("both"),
        # of an even number, the upper middle one
        *[F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN a = {a} THEN wait END DESC)").alias(name) for name, a in (("wait_high", 1), ("wait_low", 0))],
    )
    n, high, replies, both = F.col("n"), F.col("high"), F.col("replies"), F.col("both")
    base, rate = replies / n, F.when(high >= LEAST_SOURCES, both / high)
    spread = (high * (n - high)).cast("double") * (replies * (n - replies))
    phi = F.when((n >= 3) & (spread > 0), (both * n - high * replies) / F.sqrt(spread)).otherwise(0.0)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return g.select(
        "direction",
        "feature",
        "high",
        js_round(base).alias("base"),
        js_round(zero(rate)).alias("rate"),
        js_round(zero(rate - base)).alias("delta"),
        js_round(zero(F.when(base > 0, rate / base))).alias("lift"),
        js_round(phi).alias("phi"),
        F.coalesce("wait_high", F.lit(0).cast("double")).alias("wait_high"),
        F.coalesce("wait_low", F.lit(0).cast("double")).alias("wait_low"),
    )


_SAID = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES) + "]"
_FLAGS = {
    "length": "words > limit_",
    "questions": "contains(text, '?')",
    **{name: f"regexp_matches(lower(text), {bounded(words)})" for name, words in REGISTERS.items()},
    "emoji": f"regexp_matches(text, '{ladders.PICTOGRAPH}')",
    "attachments": "attached = 1",
}
ORACLE_SQL = {
    "mirror_effects": rf"""WITH {MESSAGES}, v0 AS (SELECT *, CASE WHEN word_count < 150 THEN {_SAID}[(id + k) % {len(PHRASES)} + 1] END AS text FROM messages WHERE amt IS NULL OR amt < 2000),
v1 AS (SELECT *, CASE WHEN lag(is_from_me) OVER w <> is_from_me OR ts - lag(ts) OVER w > 1200 THEN 1 ELSE 0 END AS cut FROM v0 WINDOW w AS (PARTITION BY chat_id ORDER BY ts, id)),
v2 AS (SELECT *, sum(cut) OVER (PARTITION BY chat_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS turn FROM v1),
t0 AS (SELECT chat_id, turn, min(is_from_me) AS is_from_me, min(ts) AS ts, max(ts) AS end_ts, arg_min(id, (ts, id)) AS id, sum(word_count) AS words, max(has_attachment) AS attached,
  regexp_replace(string_agg(regexp_replace(coalesce(text, ''), 'https?://[^ \t\r\n]+', ' ', 'gi'), ' ' ORDER BY ts, id), '[ \t\r\n]+', ' ', 'g') AS text FROM v2 GROUP BY 1, 2),
lim AS (SELECT is_from_me, list_sort(list(words))[CAST(floor((count(*) - 1) * {LONG}) AS INT) + 1] AS limit_ FROM t0 GROUP BY 1),
t AS (SELECT chat_id, turn, ts, id, end_ts, is_from_me, [{', '.join(f'CASE WHEN {test} THEN 1 ELSE 0 END' for test in (_FLAGS[x] for x in FEATURES))}] AS f FROM t0 JOIN lim USING (is_from_me)),
p0 AS (SELECT *, lead(f) OVER w AS r, lead(is_from_me) OVER w AS by_me, lead(ts) OVER w - end_ts AS wait FROM t WINDOW w AS (PARTITION BY chat_id ORDER BY ts, id)),
p AS (SELECT CASE WHEN is_from_me = 1 THEN 'me_to_them' ELSE 'them_to_me' END AS direction, wait, unnest([{', '.join(f"'{x}'" for x in FEATURES)}]) AS feature, unnest(f) AS a, unnest(r) AS b FROM p0 WHERE by_me <> is_from_me AND wait BETWEEN 0 AND {REPLY_WITHIN}),
g AS (SELECT direction, feature, count(*) AS n, CAST(sum(a) AS BIGINT) AS high, avg(b) AS base, coalesce(avg(b) FILTER (a = 1), 0) AS cond, corr(a, b) AS phi, list_sort(list(wait) FILTER (a = 1))[count(*) FILTER (a = 1) // 2 + 1] AS wait_high, list_sort(list(wait) FILTER (a = 0))[count(*) FILTER (a = 0) // 2 + 1] AS wait_low, stddev_pop(a) * stddev_pop(b) AS sd FROM p GROUP BY 1, 2)
SELECT direction, feature, high, {rounded('base')} AS base, {rounded(f'CASE WHEN high >= {LEAST_SOURCES} THEN cond ELSE 0 END')} AS rate, {rounded(f'CASE WHEN high >= {LEAST_SOURCES} THEN cond - base ELSE 0 END')} AS delta,
 {rounded(f'CASE WHEN high >= {LEAST_SOURCES} AND base > 0 THEN cond / base ELSE 0 END')} AS lift, {rounded('CASE WHEN n >= 3 AND sd > 0 THEN phi ELSE 0 END')} AS phi, coalesce(CAST(wait_high AS DOUBLE), 0) AS wait_high, coalesce(CAST(wait_low AS DOUBLE), 0) AS wait_low FROM g""",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
