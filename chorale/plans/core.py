"""Counts, gaps, turns and replies over the message log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorale.functions import stats, timeutil
from chorale.functions.scope import KINDS, Scope, kind_filter
from chorale.functions.stats import js_round
from chorale.operators import sequence
from chorale.plans.dialect import EPISODES, LOCAL, MESSAGES, PAIRS, TURNS, rounded
from chorale.sources.tables import messages

SCOPE = Scope("2024-01-05", "2024-01-20", "me")
#: The scope's bounds as epoch seconds: midnights in Vancouver.
START, END = 1704441600, 1705824000


def text_turns(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).filter(kind_filter("text_turn"))


def kind_counts(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).withColumn("text", F.lit("x"))
    counts = m.agg(*[F.count_if(kind_filter(k)).alias(k) for k in KINDS])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in KINDS])).alias("r")).select("r.*")


def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    return SCOPE.apply(messages(spark, d)).groupBy("chat_id").agg(F.count("*").alias("n"), F.sum("word_count").alias("words"))


def message_stats(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).filter(kind_filter("visible_message"))
    return m.groupBy("chat_id").agg(
        F.count("*").alias("n"), F.sum("is_from_me").alias("n_me"), F.sum(1 - F.col("is_from_me")).alias("n_them"),
        F.sum("word_count").alias("words"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("has_attachment").alias("attachments"),
        F.countDistinct("category").alias("n_categories"),
    )


def _sides(df: DataFrame, *by) -> DataFrame:
    return df.groupBy(*by).agg(F.sum("is_from_me").alias("me"), F.sum(1 - F.col("is_from_me")).alias("them"), F.count("*").alias("total"))


def monthly_counts(spark: SparkSession, d: str) -> DataFrame:
    return _sides(messages(spark, d).filter(kind_filter("visible_message")), timeutil.ym(F.col("ts")).alias("ym"))


def daily_counts(spark: SparkSession, d: str) -> DataFrame:
    return _sides(messages(spark, d).filter(kind_filter("visible_message")), timeutil.ymd(F.col("ts")).alias("ymd"))


def hour_weekday_heatmap(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).filter(kind_filter("visible_message"))
    return m.groupBy(timeutil.weekday_sunday0(F.col("ts")).alias("dow"), timeutil.hour(F.col("ts")).alias("hour")).agg(F.count("*").alias("n"))


def daypart_counts(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    part = timeutil.daypart(timeutil.hour(F.col("ts")))
    return m.groupBy(timeutil.weekday_monday0(F.col("ts")).alias("weekday"), part.alias("daypart")).agg(F.count("*").alias("n"))


def longest_gap(spark: SparkSession, d: str) -> DataFrame:
    g = sequence.gaps(text_turns(spark, d)).filter("gap is not null")
    best = g.groupBy("chat_id").agg(F.max_by(F.struct("gap", "id", "ts"), F.struct("gap", -F.col("id"))).alias("b"))
    return best.select("chat_id", F.col("b.gap").alias("gap"), F.col("b.id").alias("id"), F.col("b.ts").alias("ts"))


def busiest_day(spark: SparkSession, d: str) -> DataFrame:
    days = text_turns(spark, d).groupBy("chat_id", timeutil.ymd(F.col("ts")).alias("ymd")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("chat_id").orderBy(F.desc("n"), "ymd")
    return days.withColumn("at", F.row_number().over(w)).filter("at = 1").drop("at")


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    return sequence.gaps(text_turns(spark, d)).filter("gap > 0")


def median_gap_upper(spark: SparkSession, d: str) -> DataFrame:
    return _gaps(spark, d).groupBy("chat_id").agg(stats.median_upper("gap").alias("median_gap"), F.count("*").alias("n"))


def median_gap_avg(spark: SparkSession, d: str) -> DataFrame:
    return _gaps(spark, d).groupBy("chat_id").agg(js_round(stats.median_mean("gap")).alias("median_gap"))


def gap_quantiles_linear(spark: SparkSession, d: str) -> DataFrame:
    g = _gaps(spark, d).groupBy("chat_id")
    return g.agg(*[js_round(stats.quantile_linear("gap", q)).alias(f"p{round(q * 100)}") for q in (0.1, 0.25, 0.75, 0.9, 0.95)])


def gap_quantiles_index(spark: SparkSession, d: str) -> DataFrame:
    g = _gaps(spark, d).groupBy("chat_id")
    return g.agg(*[f("gap", q).alias(f"{n}_{round(q * 100)}") for n, f in (("floor", stats.quantile_floor), ("round", stats.quantile_round)) for q in (0.25, 0.9)])


def turns(spark: SparkSession, d: str) -> DataFrame:
    return sequence.turns(text_turns(spark, d)).select("chat_id", "turn", "id", "is_from_me", "ts", "end_ts", "n_msgs", "n_words")


def turn_summary(spark: SparkSession, d: str) -> DataFrame:
    t = sequence.turns(text_turns(spark, d))
    return t.groupBy("chat_id", "is_from_me").agg(
        F.count("*").alias("n_turns"), F.sum("n_msgs").alias("n_msgs"), F.max("n_msgs").alias("most_msgs"), js_round(F.sum("n_words") / F.count("*")).alias("mean_words")
    )


def reply_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = sequence.reply_pairs(sequence.turns(text_turns(spark, d)), 86400)
    return p.select("chat_id", "id", "is_from_me", "reply_ts", "latency")


def reply_latency_by_direction(spark: SparkSession, d: str) -> DataFrame:
    p = sequence.reply_pairs(sequence.turns(text_turns(spark, d)), 86400)
    way = F.when(F.col("is_from_me") == 1, "me_to_them").otherwise("them_to_me")
    return p.groupBy(way.alias("direction")).agg(F.count("*").alias("n"), stats.median_upper("latency").alias("median_latency"))


def reply_windows(spark: SparkSession, d: str) -> DataFrame:
    t = sequence.turns(text_turns(spark, d))
    p = sequence.reply_pairs(t, 172800)
    return p.groupBy("chat_id").agg(*[F.count_if(F.col("latency") <= h * 3600).alias(f"within_{h}h") for h in (6, 24, 48)])


def restarts(spark: SparkSession, d: str) -> DataFrame:
    return sequence.restarts(text_turns(spark, d)).select("chat_id", "id", "ts", "gap", "from_sender", F.col("is_from_me").alias("to_sender"))


def episodes_2h(spark: SparkSession, d: str) -> DataFrame:
    e = sequence.episodes(messages(spark, d))
    return e.groupBy("chat_id", "episode").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n"))


def runs_longest(spark: SparkSession, d: str) -> DataFrame:
    r = sequence.runs(text_turns(spark, d)).groupBy("chat_id", "run").agg(
        F.count("*").alias("n"), F.first("is_from_me").alias("is_from_me"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")
    ).filter("n >= 5")
    w = Window.partitionBy("chat_id").orderBy(F.desc("n"), "run")
    return r.withColumn("at", F.row_number().over(w)).filter("at <= 18").drop("at")


def next_other_reply(spark: SparkSession, d: str) -> DataFrame:
    m = sequence.next_other(text_turns(spark, d))
    return m.select("chat_id", "id", (F.col("other_ts") - F.col("ts")).alias("wait")).filter("wait <= 86400")


def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).filter(kind_filter("browsable_message") & (F.col("id") < 500))
    return m.orderBy(F.desc("id")).limit(50).select("id", "ts", "chat_id", "is_from_me")


def offset_page(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).filter(kind_filter("browsable_message") & (F.col("has_attachment") == 1))
    page = m.orderBy(F.desc("ts"), F.desc("id")).offset(20).limit(30).select("id", "ts")
    return page.join(F.broadcast(m.agg(F.count("*").alias("total"))))


def jump_to_date(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).filter(kind_filter("visible_message") & (F.col("ts") >= START))
    return m.orderBy("ts", "id").limit(1).select("id", "ts", "chat_id")


def evidence_lookup(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).filter(F.col("id").isin([3, 14, 15, 92, 65, 35, 89, 79, 32, 384])).select("id", "ts", "chat_id", "category", "word_count")


def browse_filters(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    filters = {"all": kind_filter("browsable_message"), "with_attachment": kind_filter("browsable_message") & (F.col("has_attachment") == 1), "tapbacks": kind_filter("reaction_add"), "replies": F.col("reply_to_id").isNotNull()}
    parts = [m.filter(c).groupBy("chat_id").agg(F.count("*").alias("n")).withColumn("filter", F.lit(k)) for k, c in filters.items()]
    return reduce(DataFrame.unionByName, parts)


def dynamics_daily(spark: SparkSession, d: str) -> DataFrame:
    p = sequence.reply_pairs(sequence.turns(text_turns(spark, d)), 86400)
    return p.groupBy(timeutil.ymd(F.col("ts")).alias("ymd"), "is_from_me").agg(F.count("*").alias("n"), stats.median_upper("latency").alias("median_latency"))


def top_lulls(spark: SparkSession, d: str) -> DataFrame:
    r = sequence.restarts(text_turns(spark, d))
    return r.orderBy(F.desc("gap"), "chat_id", "id").limit(15).select("chat_id", "id", "gap", "from_sender", F.col("is_from_me").alias("to_sender"))


_TEXT = "(amt IS NULL OR amt = 0)"
_GAPS = f"""{MESSAGES}, g0 AS (SELECT *, ts - lag(ts) OVER (PARTITION BY chat_id ORDER BY ts, id) AS gap FROM messages WHERE {_TEXT}),
gaps AS (SELECT * FROM g0 WHERE gap > 0)"""
_SIDES = "CAST(sum(is_from_me) AS BIGINT) AS me, CAST(sum(1 - is_from_me) AS BIGINT) AS them, count(*) AS total"
_VISIBLE = "(amt IS NULL OR amt < 2000)"

ORACLE_SQL = {
    "kind_counts": f"""WITH {MESSAGES}, c AS (SELECT count(*) FILTER ({_TEXT}) a, count(*) FILTER ({_VISIBLE}) b, count(*) FILTER (amt >= 2000 AND amt < 3000) c,
 count(*) FILTER (amt >= 3000 AND amt < 4000) d, count(*) FILTER (amt > 0 AND amt < 2000) e, count(*) f FROM messages)
SELECT 'text_turn' AS kind, a AS n FROM c UNION ALL SELECT 'segmentable_text', a FROM c UNION ALL SELECT 'visible_message', b FROM c UNION ALL SELECT 'reaction_add', c FROM c
UNION ALL SELECT 'reaction_remove', d FROM c UNION ALL SELECT 'object_message', e FROM c UNION ALL SELECT 'all_row', f FROM c""",
    "scope_filter": f"WITH {MESSAGES} SELECT chat_id, count(*) AS n, CAST(sum(word_count) AS BIGINT) AS words FROM messages WHERE ts >= {START} AND ts < {END} AND is_from_me = 1 GROUP BY chat_id",
    "message_stats": f"""WITH {MESSAGES} SELECT chat_id, count(*) AS n, CAST(sum(is_from_me) AS BIGINT) AS n_me, CAST(sum(1 - is_from_me) AS BIGINT) AS n_them, CAST(sum(word_count) AS BIGINT) AS words,
 min(ts) AS first_ts, max(ts) AS last_ts, CAST(sum(has_attachment) AS BIGINT) AS attachments, count(DISTINCT category) AS n_categories FROM messages WHERE {_VISIBLE} GROUP BY chat_id""",
    "monthly_counts": f"WITH {MESSAGES} SELECT strftime({LOCAL}, '%Y-%m') AS ym, {_SIDES} FROM messages WHERE {_VISIBLE} GROUP BY 1",
    "daily_counts": f"WITH {MESSAGES} SELECT strftime({LOCAL}, '%Y-%m-%d') AS ymd, {_SIDES} FROM messages WHERE {_VISIBLE} GROUP BY 1",
    "hour_weekday_heatmap": f"WITH {MESSAGES} SELECT CAST(dayofweek({LOCAL}) AS INT) AS dow, CAST(hour({LOCAL}) AS INT) AS hour, count(*) AS n FROM messages WHERE {_VISIBLE} GROUP BY 1, 2",
    "daypart_counts": f"""WITH {MESSAGES}, h AS (SELECT CAST(isodow({LOCAL}) - 1 AS INT) AS weekday, hour({LOCAL}) AS h FROM messages)
SELECT weekday, CASE WHEN h BETWEEN 5 AND 10 THEN 'morning' WHEN h BETWEEN 11 AND 16 THEN 'afternoon' WHEN h BETWEEN 17 AND 21 THEN 'evening' ELSE 'night' END AS daypart, count(*) AS n FROM h GROUP BY 1, 2""",
    "longest_gap": f"WITH {MESSAGES}, g AS (SELECT chat_id, id, ts, ts - lag(ts) OVER (PARTITION BY chat_id ORDER BY ts, id) AS gap FROM messages WHERE {_TEXT}) SELECT chat_id, gap, id, ts FROM g WHERE gap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY gap DESC, id) = 1",
    "busiest_day": f"WITH {MESSAGES} SELECT chat_id, strftime({LOCAL}, '%Y-%m-%d') AS ymd, count(*) AS n FROM messages WHERE {_TEXT} GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY n DESC, ymd) = 1",
    "median_gap_upper": f"WITH {_GAPS} SELECT chat_id, list_sort(list(gap))[count(*) // 2 + 1] AS median_gap, count(*) AS n FROM gaps GROUP BY chat_id",
    "median_gap_avg": f"WITH {_GAPS} SELECT chat_id, {rounded('median(gap)')} AS median_gap FROM gaps GROUP BY chat_id",
    "gap_quantiles_linear": f"WITH {_GAPS} SELECT chat_id, " + ", ".join(f"{rounded(f'quantile_cont(gap, {q})')} AS p{round(q * 100)}" for q in (0.1, 0.25, 0.75, 0.9, 0.95)) + " FROM gaps GROUP BY chat_id",
    "gap_quantiles_index": f"WITH {_GAPS} SELECT chat_id, " + ", ".join(f"list_sort(list(gap))[CAST(floor((count(*) - 1) * {q}{r}) AS BIGINT) + 1] AS {n}_{round(q * 100)}" for n, r in (("floor", ""), ("round", " + 0.5")) for q in (0.25, 0.9)) + " FROM gaps GROUP BY chat_id",
    "turns": f"WITH {TURNS} SELECT * FROM turns",
    "turn_summary": f"WITH {TURNS} SELECT chat_id, is_from_me, count(*) AS n_turns, CAST(sum(n_msgs) AS BIGINT) AS n_msgs, max(n_msgs) AS most_msgs, {rounded('sum(n_words) / count(*)')} AS mean_words FROM turns GROUP BY 1, 2",
    "reply_pairs": f"WITH {PAIRS} SELECT chat_id, id, is_from_me, reply_ts, latency FROM pairs",
    "reply_latency_by_direction": f"WITH {PAIRS} SELECT CASE WHEN is_from_me = 1 THEN 'me_to_them' ELSE 'them_to_me' END AS direction, count(*) AS n, list_sort(list(latency))[count(*) // 2 + 1] AS median_latency FROM pairs GROUP BY 1",
    "reply_windows": f"WITH {PAIRS.replace('86400', '172800')} SELECT chat_id, count(*) FILTER (latency <= 21600) AS within_6h, count(*) FILTER (latency <= 86400) AS within_24h, count(*) FILTER (latency <= 172800) AS within_48h FROM pairs GROUP BY chat_id",
    "restarts": f"WITH {MESSAGES} SELECT * FROM (SELECT chat_id, id, ts, ts - lag(ts) OVER w AS gap, lag(is_from_me) OVER w AS from_sender, is_from_me AS to_sender FROM messages WHERE {_TEXT} WINDOW w AS (PARTITION BY chat_id ORDER BY ts, id)) WHERE gap >= 21600",
    "episodes_2h": f"WITH {EPISODES} SELECT chat_id, episode, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n FROM episodes GROUP BY 1, 2",
    "runs_longest": f"""WITH {MESSAGES}, r0 AS (SELECT *, CASE WHEN lag(is_from_me) OVER (PARTITION BY chat_id ORDER BY ts, id) <> is_from_me THEN 1 ELSE 0 END AS cut FROM messages WHERE {_TEXT}),
r1 AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY chat_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM r0)
SELECT chat_id, run, count(*) AS n, min(is_from_me) AS is_from_me, min(ts) AS start_ts, max(ts) AS end_ts FROM r1 GROUP BY 1, 2 HAVING count(*) >= 5 QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY n DESC, run) <= 18""",
    "next_other_reply": f"""WITH {MESSAGES}, t AS (SELECT * FROM messages WHERE {_TEXT}), n AS (SELECT a.chat_id, a.id, min(b.ts) - a.ts AS wait FROM t a JOIN t b ON a.chat_id = b.chat_id AND a.is_from_me <> b.is_from_me
 AND (b.ts > a.ts OR (b.ts = a.ts AND b.id > a.id)) GROUP BY a.chat_id, a.id, a.ts) SELECT * FROM n WHERE wait <= 86400""",
    "keyset_page": f"WITH {MESSAGES} SELECT id, ts, chat_id, is_from_me FROM messages WHERE {_VISIBLE} AND id < 500 ORDER BY id DESC LIMIT 50",
    "offset_page": f"WITH {MESSAGES}, f AS (SELECT * FROM messages WHERE {_VISIBLE} AND has_attachment = 1) SELECT id, ts, (SELECT count(*) FROM f) AS total FROM f ORDER BY ts DESC, id DESC LIMIT 30 OFFSET 20",
    "jump_to_date": f"WITH {MESSAGES} SELECT id, ts, chat_id FROM messages WHERE {_VISIBLE} AND ts >= {START} ORDER BY ts, id LIMIT 1",
    "evidence_lookup": f"WITH {MESSAGES} SELECT id, ts, chat_id, category, word_count FROM messages WHERE id IN (3, 14, 15, 92, 65, 35, 89, 79, 32, 384)",
    "browse_filters": f"""WITH {MESSAGES} SELECT chat_id, 'all' AS filter, count(*) AS n FROM messages WHERE {_VISIBLE} GROUP BY 1 UNION ALL SELECT chat_id, 'with_attachment', count(*) FROM messages WHERE {_VISIBLE} AND has_attachment = 1 GROUP BY 1
UNION ALL SELECT chat_id, 'tapbacks', count(*) FROM messages WHERE amt >= 2000 AND amt < 3000 GROUP BY 1 UNION ALL SELECT chat_id, 'replies', count(*) FROM messages WHERE reply_to_id IS NOT NULL GROUP BY 1""",
    "dynamics_daily": f"WITH {PAIRS} SELECT strftime({LOCAL}, '%Y-%m-%d') AS ymd, is_from_me, count(*) AS n, list_sort(list(latency))[count(*) // 2 + 1] AS median_latency FROM pairs GROUP BY 1, 2",
    "top_lulls": f"WITH {MESSAGES} SELECT * FROM (SELECT chat_id, id, ts - lag(ts) OVER w AS gap, lag(is_from_me) OVER w AS from_sender, is_from_me AS to_sender FROM messages WHERE {_TEXT} WINDOW w AS (PARTITION BY chat_id ORDER BY ts, id)) WHERE gap >= 21600 ORDER BY gap DESC, chat_id, id LIMIT 15",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
