"""Days that stand out, the weeks around them, and chats among all: every feature, kind and metric beside its SQL.

Daily and per-chat sums come first, so the windows over a whole log see days, and those over a cohort one row a chat."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorale.functions import ladders
from chorale.functions import text as texts
from chorale.functions.scope import kind_filter
from chorale.functions.stats import js_round
from chorale.plans.dialect import MESSAGES, SEGMENTS, bounded, rounded
from chorale.sources.tables import PHRASES, phrased, segments, uneven

DAY = 86400
KINDS = ("warmth", "strain", "repair", "gratitude", "care", "humor")
#: What each kind's texts hold as whole words.
SIGNS = {kind: "|".join(part for parts in texts.LEXICONS[kind] for part in parts) for kind in KINDS}
#: A day's features and their weights, and the weight in messages of a rate's prior.
FEATURES = {"volume": 1.1, "words": 0.9, "tempo": 1.0, "affect": 1.0, "strain": 1.15, "repair": 0.95, "attachments": 0.85, "semantic": 1.2, "entropy": 0.75, "sender": 0.7}
PRIOR, CONTEXT_DAYS, OUTLIER, RANKED_MESSAGES, RANKED_WORDS = 30, 30, 5, 8, 500
#: The days on either side of an inflection, the days between two of a kind, and how many of a kind are kept.
REACH, APART, MOST = 7, 5, 18


def _daily(m: DataFrame) -> DataFrame:
    """Sums of the visible messages by day, with the texts that show each kind."""
    signs = [F.count_if(texts.has(F.col("text"), pattern)).alias(f"n_{kind}") for kind, pattern in SIGNS.items()]
    visible = m.filter(kind_filter("visible_message")).withColumn("day", F.floor(F.col("ts") / DAY).cast("bigint"))
    return visible.groupBy("day").agg(
        F.count("*").alias("n"),
        F.sum("is_from_me").alias("me"),
        F.sum("word_count").alias("words"),
        F.sum("has_attachment").alias("attached"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        *signs,
    )


def _places(s: DataFrame) -> DataFrame:
    """By the day on which segments start: the evenness of their messages over categories, and their mean coordinates."""
    day = Window.partitionBy("day")
    c = s.groupBy(F.floor(F.col("start_ts") / DAY).cast("bigint").alias("day"), "category").agg(
        F.sum("n_msgs").alias("c"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.count("*").alias("k")
    )
    p = F.col("c") / F.sum("c").over(day)
    c = c.withColumn("part", -p * F.log(p))
    spread = F.when(F.count("*") > 1, F.sum("part") / F.log(F.count("*"))).otherwise(0.0)
    return c.groupBy("day").agg(spread.alias("spread"), (F.sum("x") / F.sum("k")).alias("x"), (F.sum("y") / F.sum("k")).alias("y"))


def _features(days: DataFrame, places: DataFrame) -> DataFrame:
    """One row per day with messages. A day's departure is its distance from the mean of the days with segments before it,
    thirty at most; it is 0 for the first and for days without one, as their spread is."""
    before = Window.partitionBy().orderBy("day").rowsBetween(-CONTEXT_DAYS, -1)
    far = F.sqrt(F.pow(F.col("x") - F.avg("x").over(before), 2) + F.pow(F.col("y") - F.avg("y").over(before), 2))
    placed = days.select("day").join(places, "day").select("day", "spread", F.coalesce(far, F.lit(0.0)).alias("far"))
    affect = reduce(Column.__add__, [F.col(f"n_{k}") for k in KINDS])
    totals = days.agg(*[(F.sum(x) / F.sum("n")).alias(name) for name, x in (("r_affect", affect), ("r_strain", F.col("n_strain")), ("r_repair", F.col("n_repair")), ("r_me", F.col("me")))])
    j = days.join(placed, "day", "left").na.fill(0.0, ["spread", "far"]).join(F.broadcast(totals))
    smoothed = lambda part, base: ladders.smoothed_rate(part, F.col("n"), F.col(base), PRIOR)
    support = F.col("n") / (F.col("n") + PRIOR)
    return j.select(
        "day",
        "n",
        F.col("words").alias("n_words"),
        F.log1p("n").alias("volume"),
        F.log1p("words").alias("words"),
        (F.col("n") / F.greatest(F.lit(1.0), (F.col("end_ts") - F.col("start_ts")) / 3600 + 1)).alias("tempo"),
        smoothed(affect, "r_affect").alias("affect"),
        smoothed(F.col("n_strain"), "r_strain").alias("strain"),
        smoothed(F.col("n_repair"), "r_repair").alias("repair"),
        F.log1p("attached").alias("attachments"),
        (F.col("far") * support).alias("semantic"),
        (F.col("spread") * support).alias("entropy"),
        (F.abs(smoothed(F.col("me"), "r_me") - F.col("r_me")) * 2).alias("sender"),
    )


def outlier_days(spark: SparkSession, d: str) -> DataFrame:
    """Days by how far ten features exceed their medians in robust scales: the score, the feature that adds most (the first of
    equals, null where none adds), and whether the day has enough messages or words to be ranked."""
    f = _features(_daily(phrased(spark, d)), _places(segments(spark, d)))
    q = f.agg(*[F.percentile(x, F.array(*[F.lit(p) for p in (0.5, 0.25, 0.75, 0.9, 0.95)])).alias(f"q_{x}") for x in FEATURES])
    j = f.join(F.broadcast(q))
    mad = j.agg(*[F.percentile(F.abs(F.col(x) - F.col(f"q_{x}")[0]), 0.5).alias(f"mad_{x}") for x in FEATURES])
    j = j.join(F.broadcast(mad))
    for x, weight in FEATURES.items():
        at, m = F.col(f"q_{x}"), F.col(f"mad_{x}")
        scale = F.greatest(1.4826 * F.when(m == 0, 1e-6).otherwise(m), (at[2] - at[1]) / 1.349, F.abs(at[3] - at[0]) / 1.2816, F.abs(at[4] - at[0]) / 1.6449, F.lit(1e-6))
        j = j.withColumn(f"z_{x}", js_round(F.greatest((F.col(x) - at[0]) / scale, F.lit(0.0)) * weight, 3))
    most = F.greatest(*[F.col(f"z_{x}") for x in FEATURES])
    strongest = F.coalesce(*[F.when((F.col(f"z_{x}") == most) & (most > 0), x) for x in FEATURES])
    total = reduce(Column.__add__, [F.pow(F.col(f"z_{x}"), 2) for x in FEATURES])
    scored = j.withColumn("score", js_round(F.sqrt(total), 3))
    ranked = (F.col("n") >= RANKED_MESSAGES) | (F.col("n_words") >= RANKED_WORDS)
    return scored.select("day", "n", F.col("n_words").alias("words"), "score", strongest.alias("strongest"), ranked.alias("ranked"), (ranked & (F.col("score") >= OUTLIER)).alias("outlier"))


def _week_sums(days: DataFrame) -> DataFrame:
    """Every day of the axis with the sums of the seven days before it and the seven after."""
    axis = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    names = ["n", *[f"n_{k}" for k in KINDS]]
    dense = axis.join(days, "day", "left").na.fill(0, names)
    w = Window.partitionBy().orderBy("day")
    sums = [F.sum(c).over(w.rowsBetween(a, b)).alias(f"{side}_{c}") for c in names for side, a, b in (("past", -REACH, -1), ("future", 1, REACH))]
    whole = Window.partitionBy()
    s = dense.select("day", (F.col("day") - F.min("day").over(whole)).alias("i"), F.count("*").over(whole).alias("days"), *sums)
    return s.filter((F.col("i") >= REACH) & (F.col("i") < F.col("days") - REACH - 1) & (F.col("past_n") + F.col("future_n") >= 80))


def _per_100(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(0.0)


def inflections(m: DataFrame) -> DataFrame:
    """Days after which a log of texts surges, lulls, strains or mends: a row for each kind that a day is, by the weeks around it."""
    s = _week_sums(_daily(m))
    past, future = F.col("past_n"), F.col("future_n")
    up, down, delta = (future + 20) / (past + 20), (past + 20) / (future + 20), future - past
    strain = [_per_100(F.col(f"{side}_n_strain"), F.col(f"{side}_n")) for side in ("past", "future")]
    mending = [F.col(f"{side}_n_repair") + F.col(f"{side}_n_care") + F.col(f"{side}_n_gratitude") for side in ("past", "future")]
    mend = [_per_100(m + F.col(f"{side}_n_warmth") * 0.35, F.col(f"{side}_n")) for m, side in zip(mending, ("past", "future"))]
    volume = [past / REACH, future / REACH]
    bonus = lambda x: F.least(x, F.lit(2.5))
    kinds = {
        "surge": ((past >= 30) & (future >= 120) & (up >= 1.65) & (delta >= 75), F.log2(up) * 3 + bonus(delta / 180), volume),
        "lull": ((past >= 120) & (future <= past * 0.48) & (down >= 1.75) & (-delta >= 75), F.log2(down) * 3 + bonus(-delta / 180), volume),
        "storm": (
            (future >= 80) & (F.col("future_n_strain") >= 8) & (strain[1] >= F.greatest(F.lit(4.2), strain[0] + 1.4)),
            (strain[1] - strain[0]) * 0.8 + bonus(F.col("future_n_strain") / 8),
            strain,
        ),
        "repair": ((F.col("past_n_strain") >= 4) & (future >= 70) & (mending[1] >= 8) & (mend[1] >= mend[0] + 1.2), (mend[1] - mend[0]) * 0.75 + bonus(mending[1] / 8), mend),
    }
    found = [
        F.when(
            test,
            F.struct(F.lit(kind).alias("kind"), js_round(score, 3).alias("score"), js_round(rates[0], 3).alias("past_rate"), js_round(rates[1], 3).alias("future_rate")),
        )
        for kind, (test, score, rates) in kinds.items()
    ]
    e = s.select("day", past.alias("past"), future.alias("future"), F.explode(F.array_compact(F.array(*found))).alias("e"))
    return e.select("day", "past", "future", "e.*")


def omen_events(spark: SparkSession, d: str) -> DataFrame:
    return inflections(uneven(phrased(spark, d)))


def spaced_events(spark: SparkSession, d: str) -> DataFrame:
    """Inflections of each kind, the strongest first (then the greater change, then the earlier), five days apart at least and
    eighteen at most. A kind's candidates are days, which a log of any size has few of."""
    key = F.struct((-F.col("score")).alias("by"), (-F.abs(F.col("future") - F.col("past"))).alias("change"), "day", "score")
    kinds = omen_events(spark, d).groupBy("kind").agg(F.array_sort(F.collect_list(key)).alias("c"))
    none = F.slice(F.col("c"), 1, 0)
    take = lambda got, c: F.when((F.size(got) < MOST) & ~F.exists(got, lambda t: F.abs(t["day"] - c["day"]) < APART), F.concat(got, F.array(c))).otherwise(got)
    taken = kinds.select("kind", F.explode(F.aggregate("c", none, take)).alias("t"))
    return taken.select("kind", "t.day", "t.score")


#: The metrics of a chat's own side; of the last, less is more, and its z is taken of logarithms.
RATES = {
    "me_share": ("me", "total"), "words_per_me_text": ("words", "texts"), "chars_per_me_text": ("chars", "texts"), "question_rate": ("questions", "texts"),
    "exclaim_rate": ("exclaims", "texts"), "emoji_per_me_text": ("emoji", "texts"), "attachment_rate": ("attached", "me"), "tapback_rate": ("tapbacks", "me"),
    "link_rate": ("links", "texts"), "reply_rate": ("replies", "me"),
}
REPLY = "median_reply_me_sec"


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    """One row per chat and metric. A rate of nothing is 0; a chat without a reply of its own has no row of the last metric."""
    tapback = F.coalesce(F.col("amt").between(2000, 2005), F.lit(False))
    m = phrased(spark, d).withColumns({"tapback": tapback, "said": F.coalesce(F.col("text"), F.lit(""))})
    # the message before among those that are no reaction
    w = Window.partitionBy("chat_id", "tapback").orderBy("ts", "id")
    m = m.withColumns({"gap": F.col("ts") - F.lag("ts").over(w), "by": F.lag("is_from_me").over(w)})
    mine = F.col("is_from_me") == 1
    m = m.withColumn("answer", F.when(mine & ~F.col("tapback") & (F.col("by") == 0) & (F.col("gap") > 0) & (F.col("gap") < DAY), F.col("gap")))
    words = F.size(F.regexp_extract_all(F.lower("said"), F.lit("[a-z0-9']+"), F.lit(0)))
    own = lambda x: F.sum(F.when(mine, x).otherwise(0))
    c = m.groupBy("chat_id").agg(
        F.count("*").alias("total"),
        F.count_if(mine).alias("me"),
        F.count_if(mine & (F.col("said") != "")).alias("texts"),
        own(words).alias("words"),
        own(F.length("said")).alias("chars"),
        own(F.size(ladders.emoji(F.col("said")))).alias("emoji"),
        *[F.count_if(mine & test).alias(name) for name, test in (("questions", F.col("said").contains("?")), ("exclaims", F.col("said").contains("!")), ("attached", F.col("has_attachment") == 1), ("tapbacks", F.col("tapback")), ("links", F.col("said").rlike("(?i)https?://")), ("replies", F.col("reply_to_id").isNotNull()))],
        # of an even number, the upper middle one
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY answer DESC)").alias(REPLY),
    )
    values = [F.struct(F.lit(name).alias("metric"), F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0).alias("value")) for name, (a, b) in RATES.items()]
    values.append(F.struct(F.lit(REPLY).alias("metric"), F.col(REPLY).alias("value")))
    return c.select("chat_id", F.explode(F.array(*values)).alias("m")).select("chat_id", "m.*").filter("value is not null")


def cohort_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Each chat against all others by eleven metrics: their quartiles, its percentile, standing, robust z and ranks. The others'
    quartiles are at most one place from all chats', so six values a metric give them for every chat; where their middle half is
    of one value, the scale is their standard deviation, else 1."""
    by = Window.partitionBy("metric")
    z = F.when(F.col("metric") == REPLY, F.log1p("value")).otherwise(F.col("value"))
    p = _profiles(spark, d).withColumn("t", z)
    p = p.withColumns(
        {
            "at": F.row_number().over(by.orderBy("value", "chat_id")) - 1,
            "n": F.count("*").over(by),
            "low": F.rank().over(by.orderBy("value")),
            "high": F.rank().over(by.orderBy(F.desc("value"))),
        }
    ).filter("n > 1")
    spot = lambda q: F.floor((F.col("n") - 2) * q + 0.5)
    quarters = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    places = p.groupBy("metric").agg(
        F.sum("t").alias("sum"),
        F.sum(F.col("t") * F.col("t")).alias("squares"),
        *[F.max(F.when(F.col("at") == spot(q) + k, F.struct("value", "t"))).alias(f"{name}_{k}") for name, q in quarters.items() for k in (0, 1)],
    )
    j = p.join(F.broadcast(places), "metric")
    j = j.withColumns({name: F.when(F.col("at") <= spot(q), F.col(f"{name}_1")).otherwise(F.col(f"{name}_0")) for name, q in quarters.items()})
    others = F.col("n") - 1
    mean = (F.col("sum") - F.col("t")) / others
    variance = (F.col("squares") - F.col("t") * F.col("t")) / others - mean * mean
    # what rounding leaves of no variance is none
    deviation = F.when(variance > 1e-12 * (1 + mean * mean), F.sqrt(variance)).otherwise(1.0)
    middle = F.col("p75.t") - F.col("p25.t")
    scale = F.when(others < 2, 1.0).when(middle > 0, middle / 1.349).otherwise(deviation)
    percentile = (F.col("n") - F.col("high")) / others * 100
    return j.select(
        "chat_id",
        "metric",
        js_round(F.col("value")).alias("value"),
        *[js_round(F.col(f"{name}.value")).alias(name) for name in quarters],
        js_round(percentile).alias("percentile"),
        js_round(F.when(F.col("metric") == REPLY, 100 - percentile).otherwise(percentile)).alias("standing"),
        js_round((F.col("t") - F.col("median.t")) / scale, 2).alias("z"),
        F.col("high").alias("rank_high"),
        F.col("low").alias("rank_low"),
        F.col("n").alias("cohort"),
    )


_PHRASES = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES) + "]"
_TEXT = f"CASE WHEN word_count < 150 THEN {_PHRASES}[(id + k) % {len(PHRASES)} + 1] END AS text"
_SIGNS = ", ".join(f"count(*) FILTER (regexp_matches(lower(text), {bounded(pattern)})) AS n_{kind}" for kind, pattern in SIGNS.items())


def _daily_sql(ts: str) -> str:
    return f"""days AS (SELECT CAST(floor(ts / {DAY}) AS BIGINT) AS day, count(*) AS n, CAST(sum(is_from_me) AS BIGINT) AS me, CAST(sum(word_count) AS BIGINT) AS words, CAST(sum(has_attachment) AS BIGINT) AS attached,
  min(ts) AS start_ts, max(ts) AS end_ts, {_SIGNS} FROM (SELECT * REPLACE ({ts} AS ts), {_TEXT} FROM messages WHERE amt IS NULL OR amt < 2000) GROUP BY 1)"""


def _outlier_sql() -> str:
    affect = " + ".join(f"n_{k}" for k in KINDS)
    rate = lambda part, base: f"(({part}) + {base} * {PRIOR}) / (n + {PRIOR})"
    support = f"n / (n + {PRIOR})"
    values = {
        "volume": "ln(1 + n)", "words": "ln(1 + n_words)", "tempo": "n / greatest(1.0, (end_ts - start_ts) / 3600 + 1)", "affect": rate(affect, "r_affect"), "strain": rate("n_strain", "r_strain"),
        "repair": rate("n_repair", "r_repair"), "attachments": "ln(1 + attached)", "semantic": f"far * ({support})", "entropy": f"spread * ({support})", "sender": f"abs({rate('me', 'r_me')} - r_me) * 2",
    }
    q = ", ".join(f"quantile_cont({x}, 0.5) AS {x}50, quantile_cont({x}, 0.25) AS {x}25, quantile_cont({x}, 0.75) AS {x}75, quantile_cont({x}, 0.9) AS {x}90, quantile_cont({x}, 0.95) AS {x}95" for x in FEATURES)
    mad = ", ".join(f"median(abs({x} - {x}50)) AS {x}m" for x in FEATURES)
    scale = lambda x: f"greatest(1.4826 * CASE WHEN {x}m = 0 THEN 1e-6 ELSE {x}m END, ({x}75 - {x}25) / 1.349, abs({x}90 - {x}50) / 1.2816, abs({x}95 - {x}50) / 1.6449, 1e-6)"
    z = ", ".join(f"{rounded(f'greatest(({x} - {x}50) / {scale(x)}, 0) * {w}', 3)} AS z_{x}" for x, w in FEATURES.items())
    most = "greatest(" + ", ".join(f"z_{x}" for x in FEATURES) + ")"
    strongest = f"CASE WHEN {most} <= 0 THEN NULL " + " ".join(f"WHEN z_{x} = {most} THEN '{x}'" for x in FEATURES) + " END"
    score = rounded("sqrt(" + " + ".join(f"pow(z_{x}, 2)" for x in FEATURES) + ")", 3)
    return f"""WITH {SEGMENTS}, {_daily_sql('ts')},
sc AS (SELECT CAST(floor(start_ts / {DAY}) AS BIGINT) AS day, category, sum(n_msgs) AS c, sum(x) AS x, sum(y) AS y, count(*) AS k FROM segments GROUP BY 1, 2),
sp AS (SELECT day, CASE WHEN count(*) > 1 THEN -sum(c / total * ln(c / total)) / ln(count(*)) ELSE 0 END AS spread, sum(x) / sum(k) AS x, sum(y) / sum(k) AS y FROM (SELECT *, sum(c) OVER (PARTITION BY day) AS total FROM sc) GROUP BY 1),
pl AS (SELECT day, spread, coalesce(sqrt(pow(x - avg(x) OVER w, 2) + pow(y - avg(y) OVER w, 2)), 0) AS far FROM sp JOIN (SELECT day FROM days) USING (day) WINDOW w AS (ORDER BY day ROWS BETWEEN {CONTEXT_DAYS} PRECEDING AND 1 PRECEDING)),
rates AS (SELECT sum({affect}) / sum(n) AS r_affect, sum(n_strain) / sum(n) AS r_strain, sum(n_repair) / sum(n) AS r_repair, sum(me) / sum(n) AS r_me FROM days),
b AS (SELECT days.* RENAME (words AS n_words), coalesce(spread, 0) AS spread, coalesce(far, 0) AS far, rates.* FROM days LEFT JOIN pl USING (day), rates),
f AS (SELECT day, n, n_words, {', '.join(f'{x} AS {name}' for name, x in values.items())} FROM b), q AS (SELECT {q} FROM f), j AS (SELECT * FROM f, q), m AS (SELECT {mad} FROM j), zs AS (SELECT day, n, n_words, {z} FROM j, m),
s AS (SELECT day, n, n_words AS words, {score} AS score, {strongest} AS strongest, n >= {RANKED_MESSAGES} OR n_words >= {RANKED_WORDS} AS ranked FROM zs) SELECT *, ranked AND score >= {OUTLIER} AS outlier FROM s"""


_SHIFTED = f"(ts - ts % {16 * DAY} + CASE WHEN ts % {16 * DAY} < {12 * DAY} THEN 2 * (ts % {16 * DAY}) // 3 ELSE {8 * DAY} + 2 * (ts % {16 * DAY} - {12 * DAY}) END)"
_SIDES = ", ".join(f"CAST(sum({c}) OVER {side} AS BIGINT) AS {side}_{c}" for c in ("n", *[f"n_{k}" for k in KINDS]) for side in ("past", "future"))
_MENDING = {side: f"({side}_n_repair + {side}_n_care + {side}_n_gratitude)" for side in ("past", "future")}
_EVENTS = f"""{MESSAGES}, {_daily_sql(_SHIFTED)}, ax AS (SELECT unnest(range((SELECT min(day) FROM days), (SELECT max(day) + 1 FROM days))) AS day),
dense AS (SELECT ax.day, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('n', *[f'n_{k}' for k in KINDS]))} FROM ax LEFT JOIN days USING (day)),
wk AS (SELECT day, day - min(day) OVER () AS i, count(*) OVER () AS days, {_SIDES} FROM dense WINDOW past AS (ORDER BY day ROWS BETWEEN {REACH} PRECEDING AND 1 PRECEDING), future AS (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND {REACH} FOLLOWING)),
r AS (SELECT *, past_n AS past, future_n AS future, {', '.join(f"CASE WHEN {s}_n > 0 THEN {s}_n_strain / {s}_n * 100 ELSE 0 END AS {s}_strain, CASE WHEN {s}_n > 0 THEN ({_MENDING[s]} + {s}_n_warmth * 0.35::DOUBLE) / {s}_n * 100 ELSE 0 END AS {s}_mend" for s in ('past', 'future'))}
  FROM wk WHERE i >= {REACH} AND i < days - {REACH} - 1 AND past_n + future_n >= 80),
ev AS (SELECT day, past, future, 'surge' AS kind, log2((future + 20) / (past + 20)) * 3 + least((future - past) / 180, 2.5) AS s, past / {REACH} AS a, future / {REACH} AS b FROM r
    WHERE past >= 30 AND future >= 120 AND (future + 20) / (past + 20) >= 1.65 AND future - past >= 75
  UNION ALL SELECT day, past, future, 'lull', log2((past + 20) / (future + 20)) * 3 + least((past - future) / 180, 2.5), past / {REACH}, future / {REACH} FROM r
    WHERE past >= 120 AND future <= past * 0.48 AND (past + 20) / (future + 20) >= 1.75 AND past - future >= 75
  UNION ALL SELECT day, past, future, 'storm', (future_strain - past_strain) * 0.8 + least(future_n_strain / 8, 2.5), past_strain, future_strain FROM r
    WHERE future >= 80 AND future_n_strain >= 8 AND future_strain >= greatest(4.2, past_strain + 1.4)
  UNION ALL SELECT day, past, future, 'repair', (future_mend - past_mend) * 0.75 + least({_MENDING['future']} / 8, 2.5), past_mend, future_mend FROM r
    WHERE past_n_strain >= 4 AND future >= 70 AND {_MENDING['future']} >= 8 AND future_mend >= past_mend + 1.2),
events_of AS (SELECT day, past, future, kind, {rounded('s', 3)} AS score, {rounded('a', 3)} AS past_rate, {rounded('b', 3)} AS future_rate FROM ev)"""

_COUNTS = {"questions": "contains(said, '?')", "exclaims": "contains(said, '!')", "attached": "has_attachment = 1", "tapbacks": "tapback", "links": "regexp_matches(said, 'https?://', 'i')", "replies": "reply_to_id IS NOT NULL"}
_T = f"CASE WHEN metric = '{REPLY}' THEN ln(1 + value) ELSE value END"
_PLACE = lambda q, x="value": f"list_sort(list(o.{x}))[CAST(floor((count(*) - 1) * {q} + 0.5) AS INT) + 1]"

ORACLE_SQL = {
    "outlier_days": _outlier_sql(),
    "omen_events": f"WITH {_EVENTS} SELECT day, past, future, kind, score, past_rate, future_rate FROM events_of",
    "spaced_events": f"""WITH {_EVENTS}, c AS (SELECT kind, list([day, score] ORDER BY score DESC, abs(future - past) DESC, day) AS c FROM events_of GROUP BY 1),
t AS (SELECT kind, unnest(list_reduce(list_concat([c[1:0]], list_transform(c, lambda x: [x])), lambda got, x: CASE WHEN len(got) < {MOST} AND len(list_filter(got, lambda g: abs(g[1] - x[1][1]) < {APART})) = 0 THEN list_concat(got, x) ELSE got END)) AS t FROM c)
SELECT kind, CAST(t[1] AS BIGINT) AS day, t[2] AS score FROM t""",
    "cohort_metrics": f"""WITH {MESSAGES}, x AS (SELECT *, coalesce(amt BETWEEN 2000 AND 2005, false) AS tapback, coalesce(text, '') AS said FROM (SELECT *, {_TEXT} FROM messages)),
y AS (SELECT *, ts - lag(ts) OVER w AS gap, lag(is_from_me) OVER w AS by_me FROM x WINDOW w AS (PARTITION BY chat_id, tapback ORDER BY ts, id)),
c AS (SELECT chat_id, count(*) AS total, count(*) FILTER (is_from_me = 1) AS me, count(*) FILTER (is_from_me = 1 AND said <> '') AS texts,
  sum(len(regexp_extract_all(lower(said), '[a-z0-9'']+'))) FILTER (is_from_me = 1) AS words, sum(length(said)) FILTER (is_from_me = 1) AS chars,
  sum(len(list_filter(regexp_extract_all(said, '{ladders.EMOJI}'), lambda e: NOT list_contains([{', '.join(f"'{g}'" for g in ladders.GAME_GRID)}], e)))) FILTER (is_from_me = 1) AS emoji,
  {', '.join(f'count(*) FILTER (is_from_me = 1 AND {test}) AS {name}' for name, test in _COUNTS.items())},
  list_sort(list(gap) FILTER (is_from_me = 1 AND NOT tapback AND by_me = 0 AND gap > 0 AND gap < {DAY})) AS gaps, gaps[len(gaps) // 2 + 1] AS {REPLY} FROM y GROUP BY 1),
p0 AS ({' UNION ALL '.join(f"SELECT chat_id, '{name}' AS metric, CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END AS value FROM c" for name, (a, b) in RATES.items())} UNION ALL SELECT chat_id, '{REPLY}', {REPLY} FROM c WHERE {REPLY} IS NOT NULL),
p AS (SELECT *, {_T} AS t FROM p0),
g AS (SELECT a.chat_id, a.metric, a.value, a.t, {_PLACE(0.25)} AS p25, {_PLACE(0.5)} AS median, {_PLACE(0.75)} AS p75, {_PLACE(0.5, 't')} AS center, {_PLACE(0.75, 't')} - {_PLACE(0.25, 't')} AS middle, stddev_pop(o.t) AS sd,
  count(*) AS others, count(*) FILTER (o.value <= a.value) AS under, count(*) FILTER (o.value > a.value) AS above, count(*) FILTER (o.value < a.value) AS below FROM p a JOIN p o ON o.metric = a.metric AND o.chat_id <> a.chat_id GROUP BY ALL)
SELECT chat_id, metric, {rounded('value')} AS value, {rounded('p25')} AS p25, {rounded('median')} AS median, {rounded('p75')} AS p75, {rounded('under / others * 100')} AS percentile,
 {rounded(f"CASE WHEN metric = '{REPLY}' THEN 100 - under / others * 100 ELSE under / others * 100 END")} AS standing,
 {rounded('(t - center) / CASE WHEN others < 2 THEN 1 WHEN middle > 0 THEN middle / 1.349 WHEN sd > 1e-6 THEN sd ELSE 1 END', 2)} AS z, CAST(above + 1 AS INT) AS rank_high, CAST(below + 1 AS INT) AS rank_low, others + 1 AS cohort FROM g""",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
