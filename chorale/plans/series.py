"""Days as a dense axis: rolling frames, outliers, rhythms, recurrence, change points. Sums come first, per chat and day."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorale.functions.scope import kind_filter
from chorale.functions.stats import js_round
from chorale.operators import models
from chorale.plans.dialect import MESSAGES, SEGMENTS, rounded
from chorale.sources.tables import messages, segments, table


def _by_chat() -> Window:
    return Window.partitionBy("chat_id").orderBy("day")


def _days(spark: SparkSession, d: str) -> DataFrame:
    """Every chat's days from its first to its last, with zeros for days without a message."""
    m = messages(spark, d).filter(kind_filter("visible_message")).withColumn("day", F.floor(F.col("ts") / 86400).cast("bigint"))
    sums = m.groupBy("chat_id", "day").agg(
        F.count("*").alias("n"), F.sum("is_from_me").alias("me"), F.sum("word_count").alias("words"), F.sum("has_attachment").alias("attachments"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")
    )
    axis = sums.groupBy("chat_id").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("chat_id", F.explode(F.sequence("a", "b")).alias("day"))
    return axis.join(sums, ["chat_id", "day"], "left").na.fill(0, ["n", "me", "words", "attachments"])


def _whole_days(spark: SparkSession, d: str) -> DataFrame:
    """Days over all chats: few rows, so that windows over all of them are small."""
    per = _days(spark, d).groupBy("day").agg(*[F.sum(c).alias(c) for c in ("n", "me", "words", "attachments")], F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    return per.withColumn("i", F.col("day") - F.min("day").over(Window.partitionBy()))


def dense_days(spark: SparkSession, d: str) -> DataFrame:
    return _days(spark, d).select("chat_id", "day", "n", "me", "words", "attachments")


def rolling_frames(spark: SparkSession, d: str) -> DataFrame:
    """What lies in the three days up to a day, the three before these, and the two after."""
    s = lambda a, b: F.sum("n").over(_by_chat().rowsBetween(a, b))
    f = _days(spark, d).select("chat_id", "day", s(-2, 0).alias("past"), F.coalesce(s(-5, -3), F.lit(0)).alias("previous"), F.coalesce(s(1, 2), F.lit(0)).alias("future"))
    return f.filter("past >= 8")


def moving_average(spark: SparkSession, d: str) -> DataFrame:
    """Centred over up to 45 days either side, truncated at the ends."""
    w = _by_chat().rowsBetween(-45, 45)
    return _days(spark, d).select("chat_id", "day", js_round(F.sum("n").over(w) / F.count("*").over(w)).alias("mean"))


def quiet_days(spark: SparkSession, d: str) -> DataFrame:
    f = _whole_days(spark, d).select("day", "n", "words")
    q = f.agg(*[F.percentile(x, F.array(F.lit(0.5), F.lit(0.25))).alias(f"q_{x}") for x in ("n", "words")])
    short = lambda x: F.greatest((F.col(f"q_{x}")[0] - F.col(x)) / F.greatest(F.col(f"q_{x}")[0] - F.col(f"q_{x}")[1], F.lit(1.0)), F.lit(0.0))
    return f.join(F.broadcast(q)).select("day", "n", "words", js_round(0.8 * short("n") + 0.2 * short("words"), 4).alias("score")).filter("score >= 0.5")


def rhythm_periodogram(spark: SparkSession, d: str) -> DataFrame:
    """The strength of each whole period from 2 to 180 days, at most the axis' length, in the z-scores of daily volume."""
    z = _whole_days(spark, d).select("i", "n")
    s = z.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), F.count("*").alias("days"))
    x = z.join(F.broadcast(s)).withColumn("x", (F.col("n") - F.col("mean")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")))
    p = x.withColumn("period", F.explode(F.sequence(F.lit(2), F.least(F.lit(180), F.col("days").cast("int")))))
    angle = 2 * math.pi * F.col("i") / F.col("period")
    return p.groupBy("period").agg(js_round(F.sqrt(F.pow(F.sum(F.col("x") * F.cos(angle)), 2) + F.pow(F.sum(F.col("x") * F.sin(angle)), 2)) / F.first("days"), 4).alias("strength"))


def phase_means(spark: SparkSession, d: str) -> DataFrame:
    return _whole_days(spark, d).groupBy((F.col("i") % 7).alias("phase")).agg(js_round(F.sum("n") / F.count("*")).alias("mean"))


def lag_correlation(spark: SparkSession, d: str) -> DataFrame:
    """How both sides' daily volumes go together, shifted by days."""
    x = _whole_days(spark, d).select("i", F.log1p("me").alias("a"), F.log1p(F.col("n") - F.col("me")).alias("b"))
    left = x.select("i", "a").withColumn("lag", F.explode(F.sequence(F.lit(-14), F.lit(14))))
    j = left.join(x.select(F.col("i").alias("j"), "b"), F.col("i") + F.col("lag") == F.col("j"))
    return j.groupBy("lag").agg(js_round(F.when(F.count("*") >= 3, F.coalesce(F.corr("a", "b"), F.lit(0.0))).otherwise(0.0), 4).alias("r"))


def day_windows_5x2(spark: SparkSession, d: str) -> DataFrame:
    """Windows of five days, one begun every second day of a chat."""
    x = _days(spark, d).withColumn("i", F.col("day") - F.min("day").over(Window.partitionBy("chat_id")))
    starts = x.withColumn("start", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.col("i") - k), lambda s: (s >= 0) & (s % 2 == 0))))
    return starts.groupBy("chat_id", "start").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.count("*").alias("days")).filter("days = 5")


def _corr(a: str, b: str) -> Column:
    """Pearson's r; 0 below three pairs or where a side doesn't vary."""
    varies = (F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()) >= 3) & (F.stddev_pop(F.when(F.col(b).isNotNull(), F.col(a))) > 0) & (F.stddev_pop(F.when(F.col(a).isNotNull(), F.col(b))) > 0)
    return F.when(varies, F.corr(a, b)).otherwise(0.0)


def order_windows_56x14(spark: SparkSession, d: str) -> DataFrame:
    """Windows of eight weeks over the days of the orders, one begun every second week: volume, active days, its memory of seven
    days before, and how customers of even and odd keys go together. A day lies in four windows at most."""
    o = table(spark, d, "orders").withColumn("day", F.datediff("o_orderdate", F.lit("1970-01-01")).cast("bigint"))
    sums = o.groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("o_custkey") % 2 == 0).alias("even"))
    axis = sums.agg(F.min("day").alias("a"), F.max("day").alias("b")).select("a", "b", F.explode(F.sequence("a", "b")).alias("day"))
    x = axis.join(sums, "day", "left").na.fill(0, ["n", "even"]).withColumns({"i": F.col("day") - F.col("a"), "last": F.col("b") - F.col("a") - 55})
    first = F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.floor(F.col("i") / 14) * 14 - 14 * k), lambda s: (s >= 0) & (s <= F.col("last")))
    y = x.withColumn("start", F.explode(first)).withColumns({"v": F.log1p("n"), "p": F.log1p("even"), "q": F.log1p(F.col("n") - F.col("even"))})
    y = y.withColumn("earlier", F.lag("v", 7).over(Window.partitionBy("start").orderBy("i")))
    g = y.groupBy("start").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("active"), js_round(_corr("v", "earlier"), 4).alias("memory"), js_round(_corr("p", "q"), 4).alias("synchrony"))
    return g.filter("n >= 70")


def day_recurrence(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of days eight or more apart, the nearest 7.5 % of which recur: a few hundred days at most, whatever the log."""
    x = _whole_days(spark, d).select("i", F.log1p("n").alias("a"), F.log1p("words").alias("b"))
    y = x.select(F.col("i").alias("j"), F.col("a").alias("c"), F.col("b").alias("e"))
    p = x.join(F.broadcast(y), F.col("j") - F.col("i") >= 8).select("i", "j", F.sqrt(F.pow(F.col("a") - F.col("c"), 2) + F.pow(F.col("b") - F.col("e"), 2)).alias("distance"))
    limit = p.agg(F.percentile("distance", 0.075).alias("limit"))
    return p.join(F.broadcast(limit)).filter(js_round(F.col("distance")) <= js_round(F.col("limit"))).select("i", "j", js_round(F.col("distance"), 4).alias("distance"))


def turning_points_js(spark: SparkSession, d: str) -> DataFrame:
    """Jensen-Shannon divergence in bits of a day's categories from those of the six days before."""
    return _divergent(spark, d).groupBy("day").agg(js_round(F.sum(F.col("part")), 5).alias("divergence"), F.first("total").alias("total"))


def _divergent(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).groupBy(F.floor(F.col("start_ts") / 86400).cast("bigint").alias("day"), "category").agg(F.count("*").alias("n"))
    axis = s.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    grid = axis.join(F.broadcast(s.select("category").distinct())).join(s, ["day", "category"], "left").na.fill(0, ["n"])
    base = F.coalesce(F.sum("n").over(Window.partitionBy("category").orderBy("day").rowsBetween(-6, -1)), F.lit(0))
    day = Window.partitionBy("day")
    g = grid.withColumn("base", base).withColumns({"total": F.sum("n").over(day), "base_total": F.sum("base").over(day)}).filter("total >= 10 and base_total >= 10")
    p, q = F.col("n") / F.col("total"), F.col("base") / F.col("base_total")
    m = (p + q) / 2
    part = F.when(p > 0, 0.5 * p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, 0.5 * q * F.log2(q / m)).otherwise(0.0)
    return g.withColumns({"p": p, "q": q}).withColumn("part", part)


def category_surges(spark: SparkSession, d: str) -> DataFrame:
    g = _divergent(spark, d).withColumn("delta", js_round(F.col("p") - F.col("q")))
    return g.filter("n >= 2 and delta >= 0.06").select("day", "category", "n", "delta")


def novelty(spark: SparkSession, d: str) -> DataFrame:
    """How far a segment lies from the mean of the forty before it in its chat."""
    w = Window.partitionBy("chat_id").orderBy("start_ts", "segment_id").rowsBetween(-40, -1)
    s = segments(spark, d).select("segment_id", "x", "y", F.avg("x").over(w).alias("mx"), F.avg("y").over(w).alias("my"))
    return s.filter("mx is not null").select("segment_id", js_round(F.sqrt(F.pow(F.col("x") - F.col("mx"), 2) + F.pow(F.col("y") - F.col("my"), 2)), 3).alias("novelty"))


def seasons_dp(spark: SparkSession, d: str) -> DataFrame:
    """The days in at most six stretches of least squared error over category shares (dynamic programming on the days)."""
    s = segments(spark, d).groupBy(F.floor(F.col("start_ts") / 86400).cast("bigint").alias("day")).pivot("category", ["click", "error", "purchase", "signup", "view"]).agg(F.count("segment_id")).na.fill(0)
    return models.seasons(s, "day", 6, 4)


_DAYS = f"""{MESSAGES}, d0 AS (SELECT chat_id, CAST(floor(ts / 86400) AS BIGINT) AS day, count(*) AS n, sum(is_from_me) AS me, sum(word_count) AS words, sum(has_attachment) AS attachments, min(ts) AS start_ts, max(ts) AS end_ts
  FROM messages WHERE amt IS NULL OR amt < 2000 GROUP BY 1, 2),
ax AS (SELECT chat_id, unnest(range(a, b + 1)) AS day FROM (SELECT chat_id, min(day) AS a, max(day) AS b FROM d0 GROUP BY 1)),
days AS (SELECT chat_id, day, coalesce(n, 0) AS n, CAST(coalesce(me, 0) AS BIGINT) AS me, CAST(coalesce(words, 0) AS BIGINT) AS words, CAST(coalesce(attachments, 0) AS BIGINT) AS attachments, start_ts, end_ts FROM ax LEFT JOIN d0 USING (chat_id, day))"""
_WHOLE = f"""{_DAYS}, whole AS (SELECT *, day - min(day) OVER () AS i FROM (SELECT day, CAST(sum(n) AS BIGINT) AS n, CAST(sum(me) AS BIGINT) AS me, CAST(sum(words) AS BIGINT) AS words, CAST(sum(attachments) AS BIGINT) AS attachments, min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM days GROUP BY 1))"""
_GRID = f"""{SEGMENTS}, c AS (SELECT CAST(floor(start_ts / 86400) AS BIGINT) AS day, category, count(*) AS n FROM segments GROUP BY 1, 2), ax AS (SELECT unnest(range((SELECT min(day) FROM c), (SELECT max(day) + 1 FROM c))) AS day),
g0 AS (SELECT ax.day, k.category, coalesce(c.n, 0) AS n FROM ax CROSS JOIN (SELECT DISTINCT category FROM c) k LEFT JOIN c ON c.day = ax.day AND c.category = k.category),
g1 AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY category ORDER BY day ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0) AS base FROM g0),
g2 AS (SELECT *, sum(n) OVER (PARTITION BY day) AS total, sum(base) OVER (PARTITION BY day) AS base_total FROM g1), g3 AS (SELECT *, n / total AS p, base / base_total AS q FROM g2 WHERE total >= 10 AND base_total >= 10)"""


ORACLE_SQL = {
    "dense_days": f"WITH {_DAYS} SELECT chat_id, day, n, me, words, attachments FROM days",
    "rolling_frames": f"""WITH {_DAYS}, f AS (SELECT chat_id, day, CAST(sum(n) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS past, CAST(coalesce(sum(n) OVER (w ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING), 0) AS BIGINT) AS previous,
 CAST(coalesce(sum(n) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0) AS BIGINT) AS future FROM days WINDOW w AS (PARTITION BY chat_id ORDER BY day)) SELECT * FROM f WHERE past >= 8""",
    "moving_average": f"WITH {_DAYS} SELECT chat_id, day, {rounded('avg(n) OVER (PARTITION BY chat_id ORDER BY day ROWS BETWEEN 45 PRECEDING AND 45 FOLLOWING)')} AS mean FROM days",
    "quiet_days": f"""WITH {_WHOLE}, q AS (SELECT median(n) AS a, quantile_cont(n, 0.25) AS b, median(words) AS c, quantile_cont(words, 0.25) AS d FROM whole),
s AS (SELECT day, n, words, {rounded('0.8 * greatest((a - n) / greatest(a - b, 1.0), 0) + 0.2 * greatest((c - words) / greatest(c - d, 1.0), 0)', 4)} AS score FROM whole, q) SELECT * FROM s WHERE score >= 0.5""",
    "rhythm_periodogram": f"""WITH {_WHOLE}, s AS (SELECT avg(n) AS mean, stddev_pop(n) AS sd, count(*) AS days FROM whole), x AS (SELECT i, (n - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS x, days FROM whole, s), p AS (SELECT CAST(unnest(range(2, 181)) AS INT) AS period)
SELECT period, {rounded('sqrt(pow(sum(x * cos(2 * pi() * i / period)), 2) + pow(sum(x * sin(2 * pi() * i / period)), 2)) / any_value(days)', 4)} AS strength FROM x, p WHERE period <= days GROUP BY 1""",
    "phase_means": f"WITH {_WHOLE} SELECT i % 7 AS phase, {rounded('sum(n) / count(*)')} AS mean FROM whole GROUP BY 1",
    "lag_correlation": f"""WITH {_WHOLE}, x AS (SELECT i, ln(1 + me) AS a, ln(1 + n - me) AS b FROM whole), l AS (SELECT CAST(unnest(range(-14, 15)) AS INT) AS lag)
SELECT lag, {rounded('CASE WHEN count(*) >= 3 THEN coalesce(corr(u.a, v.b), 0) ELSE 0 END', 4)} AS r FROM x u, l, x v WHERE u.i + lag = v.i GROUP BY 1""",
    "day_windows_5x2": f"""WITH {_DAYS}, x AS (SELECT *, day - min(day) OVER (PARTITION BY chat_id) AS i FROM days), s AS (SELECT chat_id, i AS start FROM x WHERE i % 2 = 0)
SELECT s.chat_id, s.start, CAST(sum(n) AS BIGINT) AS n, CAST(sum(words) AS BIGINT) AS words, count(*) AS days FROM s JOIN x ON x.chat_id = s.chat_id AND x.i BETWEEN s.start AND s.start + 4 GROUP BY 1, 2 HAVING count(*) = 5""",
    "order_windows_56x14": f"""WITH o AS (SELECT date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, count(*) AS n, count(*) FILTER (o_custkey % 2 = 0) AS even FROM orders GROUP BY 1),
ax AS (SELECT unnest(range((SELECT min(day) FROM o), (SELECT max(day) + 1 FROM o))) AS day), x AS (SELECT day - min(day) OVER () AS i, coalesce(n, 0) AS n, coalesce(even, 0) AS even, ln(1 + coalesce(n, 0)) AS v FROM ax LEFT JOIN o USING (day)),
s AS (SELECT i AS start FROM x WHERE i % 14 = 0 AND i + 56 <= (SELECT count(*) FROM x)),
y AS (SELECT start, x.n, x.v, e.v AS earlier, ln(1 + x.even) AS p, ln(1 + x.n - x.even) AS q FROM s JOIN x ON x.i BETWEEN start AND start + 55 LEFT JOIN x e ON e.i = x.i - 7 AND e.i >= start)
SELECT start, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (n > 0) AS active,
 {rounded('CASE WHEN count(earlier) >= 3 AND stddev_pop(v) FILTER (earlier IS NOT NULL) > 0 AND stddev_pop(earlier) > 0 THEN corr(v, earlier) ELSE 0 END', 4)} AS memory,
 {rounded('CASE WHEN stddev_pop(p) > 0 AND stddev_pop(q) > 0 THEN corr(p, q) ELSE 0 END', 4)} AS synchrony FROM y GROUP BY 1 HAVING sum(n) >= 70""",
    "day_recurrence": f"""WITH {_WHOLE}, p AS (SELECT u.i, v.i AS j, sqrt(pow(ln(1 + u.n) - ln(1 + v.n), 2) + pow(ln(1 + u.words) - ln(1 + v.words), 2)) AS distance FROM whole u JOIN whole v ON v.i - u.i >= 8), l AS (SELECT quantile_cont(distance, 0.075) AS top FROM p)
SELECT i, j, {rounded('distance', 4)} AS distance FROM p, l WHERE {rounded('distance')} <= {rounded('top')}""",
    "turning_points_js": f"""WITH {_GRID} SELECT day, {rounded('sum(CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2)) ELSE 0 END)', 5)} AS divergence, CAST(any_value(total) AS BIGINT) AS total FROM g3 GROUP BY 1""",
    "category_surges": f"WITH {_GRID}, s AS (SELECT day, category, n, {rounded('p - q')} AS delta FROM g3) SELECT * FROM s WHERE n >= 2 AND delta >= 0.06",
    "novelty": f"""WITH {SEGMENTS}, s AS (SELECT segment_id, x, y, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM segments WINDOW w AS (PARTITION BY chat_id ORDER BY start_ts, segment_id ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING))
SELECT segment_id, {rounded('sqrt(pow(x - mx, 2) + pow(y - my, 2))', 3)} AS novelty FROM s WHERE mx IS NOT NULL""",
}
_KINDS = ("click", "error", "purchase", "signup", "view")
_CUTS = " ".join(f"JOIN w s{k} ON s{k}.a = s{k - 1}.b + 1" for k in range(2, 7))
#: Every way to cut the days in six is tried; the first of the least error counts. Fewer than 24 days are one stretch.
ORACLE_SQL["seasons_dp"] = f"""WITH {SEGMENTS}, dd AS (SELECT CAST(floor(start_ts / 86400) AS BIGINT) AS day, {', '.join(f"count(*) FILTER (category = '{k}') AS {k}" for k in _KINDS)} FROM segments GROUP BY 1),
rn AS (SELECT row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS days, day, {' + '.join(_KINDS)} AS total, {', '.join(f"{k} / greatest({' + '.join(_KINDS)}, 1) AS {k}" for k in _KINDS)} FROM dd),
w AS (SELECT a.i AS a, b.i AS b, a.day AS start, b.day AS stop, CAST(sum(r.total) AS BIGINT) AS n, {' + '.join(f'var_pop(r.{k}) * count(*)' for k in _KINDS)} AS cost FROM rn a JOIN rn b ON b.i >= a.i + 3 JOIN rn r ON r.i BETWEEN a.i AND b.i GROUP BY ALL),
best AS (SELECT [{', '.join(f"{{'start': s{k}.start, 'stop': s{k}.stop, 'n': s{k}.n}}" for k in range(1, 7))}] AS cuts FROM w s1 {_CUTS} WHERE s1.a = 1 AND s6.b = (SELECT max(i) FROM rn) ORDER BY {' + '.join(f's{k}.cost' for k in range(1, 7))} LIMIT 1),
u AS (SELECT unnest(cuts) AS c, unnest(range(6)) AS season FROM best)
SELECT season, c.start AS start, c.stop AS "end", c.n AS n FROM u UNION ALL SELECT 0, min(day), max(day), CAST(sum(total) AS BIGINT) FROM rn WHERE days < 24 HAVING count(*) > 0"""
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
