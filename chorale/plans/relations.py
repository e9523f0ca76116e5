"""Joins between messages, reactions, replies, segments and their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorale.functions.scope import Scope, kind_filter
from chorale.functions.stats import js_round
from chorale.operators import sequence
from chorale.plans.core import END, START
from chorale.plans.dialect import EPISODES, LINKS, MESSAGES, SEGMENTS, rounded
from chorale.sources.tables import links, messages, segments, table

PHASES = {1: ("2023-12", "2023-12"), 2: ("2024-01", "2024-01")}


def thread_replies(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    source = m.select(F.col("id").alias("reply_to_id"), F.col("chat_id").alias("source_chat"), F.col("ts").alias("source_ts"), F.col("is_from_me").alias("source_me"))
    joined = m.filter("reply_to_id is not null").join(source, "reply_to_id")
    return joined.select("id", "reply_to_id", "chat_id", "source_chat", (F.col("ts") - F.col("source_ts")).alias("delay"), (F.col("is_from_me") == F.col("source_me")).cast("int").alias("same_sender"))


def tapback_targets(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    reactions = m.filter(kind_filter("reaction_add") & F.col("reply_to_id").isNotNull()).select(F.col("reply_to_id").alias("target"), "amt", F.col("is_from_me").alias("by_me"))
    targets = m.filter(kind_filter("visible_message")).select(F.col("id").alias("target"), "category")
    return reactions.join(targets, "target").groupBy("category", "amt", "by_me").agg(F.count("*").alias("n"))


def segment_detail(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).select("segment_id", "chat_id", "start_ts", "end_ts", "n_msgs", "n_me", "n_them", "topic_id", "category", js_round(F.col("x")).alias("x"), js_round(F.col("y")).alias("y"))


def segment_preview(spark: SparkSession, d: str) -> DataFrame:
    """The first three categories of each segment in order, by rank and ordered concatenation."""
    e = sequence.episodes(messages(spark, d))
    w = Window.partitionBy("chat_id", "episode").orderBy("ts", "id")
    top = e.withColumn("at", F.row_number().over(w)).filter("at <= 3")
    joined = top.groupBy("chat_id", "episode").agg(F.array_sort(F.collect_list(F.struct("at", "category"))).alias("c"))
    return joined.select("chat_id", "episode", F.array_join(F.col("c.category"), " / ").alias("preview"))


def segments_in_scope_semi(spark: SparkSession, d: str) -> DataFrame:
    e = sequence.episodes(messages(spark, d))
    firsts = e.groupBy("chat_id", "episode").agg(F.count("*").alias("n_msgs"))
    active = Scope("2024-01-05", "2024-01-20", "them").apply(e.filter(kind_filter("text_turn"))).select("chat_id", "episode")
    return firsts.join(active, ["chat_id", "episode"], "left_semi")


def chats_without_reactions_anti(spark: SparkSession, d: str) -> DataFrame:
    """Days of a chat on which nobody reacted."""
    m = messages(spark, d).withColumn("day", F.floor(F.col("ts") / 86400).cast("bigint"))
    days = m.groupBy("chat_id", "day").agg(F.count("*").alias("n"))
    return days.join(m.filter(kind_filter("reaction_add")).select("chat_id", "day"), ["chat_id", "day"], "left_anti")


def attachment_interval_join(spark: SparkSession, d: str) -> DataFrame:
    """The segment whose time span holds an attachment: the last start at or before it, by a running fill, then the end checked."""
    m = messages(spark, d).filter("has_attachment = 1").select("chat_id", "ts", F.col("id").alias("attachment_id"))
    s = segments(spark, d).select("chat_id", F.col("start_ts").alias("ts"), F.struct("segment_id", "end_ts").alias("seg"))
    both = s.withColumn("attachment_id", F.lit(None).cast("bigint")).unionByName(m.withColumn("seg", F.lit(None).cast(s.schema["seg"].dataType)))
    w = Window.partitionBy("chat_id").orderBy("ts", F.col("attachment_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("seg", F.last("seg", ignorenulls=True).over(w)).filter("attachment_id is not null and ts <= seg.end_ts")
    return filled.select("attachment_id", "chat_id", F.col("seg.segment_id").alias("segment_id"))


def reply_within_4h_24h(spark: SparkSession, d: str) -> DataFrame:
    """For each message, how many follow within 4 and 24 hours, and how many of them are the other sender's."""
    m = messages(spark, d).filter(kind_filter("text_turn"))
    four, day = sequence.following(m, 14400), sequence.following(m, 86400)
    me = lambda w: F.sum("is_from_me").over(w)
    all_ = lambda w: F.count("*").over(w)
    other = lambda w: F.when(F.col("is_from_me") == 1, all_(w) - me(w)).otherwise(me(w))
    return m.select("id", "chat_id", (all_(four) - 1).alias("n_4h"), (all_(day) - 1).alias("n_24h"), other(four).alias("other_4h"), other(day).alias("other_24h"))


def phase_scope(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    first = Scope(phase=1).within(PHASES).apply(m).agg(F.count("*").alias("n")).withColumn("scope", F.lit("phase 1"))
    narrowed = Scope(from_="2024-01-05", phase=2).within(PHASES).apply(m).agg(F.count("*").alias("n")).withColumn("scope", F.lit("phase 2 from the 5th"))
    return first.unionByName(narrowed)


def segment_links(spark: SparkSession, d: str) -> DataFrame:
    return links(segments(spark, d)).select("chat_id", "from_id", "to_id", "gap", "from_category", "to_category")


def category_transitions(spark: SparkSession, d: str) -> DataFrame:
    ls = links(segments(spark, d))
    return ls.groupBy("from_category", "to_category").agg(F.count("*").alias("n"), js_round(F.sum("gap") / F.count("*")).alias("mean_gap"))


def transition_lift(spark: SparkSession, d: str) -> DataFrame:
    """Transitions against what independent ends would give."""
    counts = links(segments(spark, d)).groupBy("from_category", "to_category").agg(F.count("*").alias("n"))
    a, b = Window.partitionBy("from_category"), Window.partitionBy("to_category")
    total = counts.agg(F.sum("n").alias("total"))
    out = counts.withColumns({"from_n": F.sum("n").over(a), "to_n": F.sum("n").over(b)}).join(F.broadcast(total))
    expected = F.col("from_n") * F.col("to_n") / F.col("total")
    return out.select("from_category", "to_category", "n", js_round(F.col("n") / expected).alias("lift"))


def category_share(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).withColumn("day", F.floor(F.col("start_ts") / 86400).cast("bigint"))
    counts = s.groupBy("day", "category").agg(F.count("*").alias("n"))
    return counts.select("day", "category", "n", js_round(F.col("n") / F.sum("n").over(Window.partitionBy("day"))).alias("share"))


def category_pivot(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).withColumn("day", F.floor(F.col("start_ts") / 86400).cast("bigint"))
    kinds = ["click", "error", "purchase", "signup", "view"]
    wide = s.groupBy("day").pivot("category", kinds).agg(F.count("n_msgs")).na.fill(0)
    return wide.withColumn("total", sum((F.col(k) for k in kinds), F.lit(0).cast("bigint")))


def category_summary(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    return s.groupBy("category").agg(F.count("*").alias("n_segments"), F.sum("n_msgs").alias("n_msgs"), js_round(F.sum("n_msgs") / F.count("*")).alias("mean_msgs"), F.min("start_ts").alias("first_ts"), F.max("end_ts").alias("last_ts"))


def gravity(spark: SparkSession, d: str) -> DataFrame:
    """How much more often a category's segments are begun by one side than segments are in general."""
    e = sequence.episodes(messages(spark, d))
    first = e.groupBy("chat_id", "episode").agg(F.min_by("is_from_me", F.struct("ts", "id")).alias("starter"))
    s = segments(spark, d).join(first, ["chat_id", "episode"])
    per = s.groupBy("category").agg(F.count("*").alias("n"), F.sum("starter").alias("started"), F.sum("n_me").alias("me"), F.sum("n_msgs").alias("msgs")).filter("n >= 12")
    whole = s.agg((F.sum("starter") / F.count("*")).alias("start_share"), (F.sum("n_me") / F.sum("n_msgs")).alias("msg_share"))
    pull = 0.65 * (F.col("started") / F.col("n") - F.col("start_share")) + 0.35 * (F.col("me") / F.col("msgs") - F.col("msg_share"))
    return per.join(F.broadcast(whole)).select("category", "n", js_round(pull).alias("pull"))


def topic_majority_label(spark: SparkSession, d: str) -> DataFrame:
    """A topic's category by the weighted majority of its segments."""
    s = segments(spark, d)
    votes = s.groupBy("topic_id", "category").agg(F.sum("n_msgs").alias("weight"))
    w = Window.partitionBy("topic_id").orderBy(F.desc("weight"), "category")
    total = Window.partitionBy("topic_id")
    ranked = votes.withColumns({"at": F.row_number().over(w), "share": js_round(F.col("weight") / F.sum("weight").over(total))})
    return ranked.filter("at = 1").select("topic_id", "category", "weight", "share")


def topic_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of a topic's categories in bits, and as a share of its most."""
    c = segments(spark, d).groupBy("topic_id", "category").agg(F.count("*").alias("n"))
    p = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("topic_id")))
    h = F.sum(-F.col("p") * F.log2("p"))
    return p.groupBy("topic_id").agg(F.count("*").alias("classes"), js_round(h).alias("bits"), js_round(F.when(F.count("*") > 1, h / F.log2(F.count("*"))).otherwise(0.0)).alias("normalised"))


def constellation_edges(spark: SparkSession, d: str) -> DataFrame:
    """The digraph of topics: weight, gap, lift over independent ends, score."""
    ls = links(segments(spark, d)).filter("from_topic != to_topic")
    e = ls.groupBy("from_topic", "to_topic").agg(F.count("*").alias("weight"), F.sum("gap").alias("gap"))
    out = e.withColumns({"o": F.sum("weight").over(Window.partitionBy("from_topic")), "i": F.sum("weight").over(Window.partitionBy("to_topic"))})
    out = out.join(F.broadcast(e.agg(F.sum("weight").alias("t"))))
    lift = F.col("weight") * F.col("t") / (F.col("o") * F.col("i"))
    return out.filter("weight >= 2").select("from_topic", "to_topic", "weight", js_round(F.col("gap") / F.col("weight")).alias("mean_gap"), js_round(lift).alias("lift"), js_round(F.col("weight") * F.log2(1 + lift)).alias("score"))


def broker_scores(spark: SparkSession, d: str) -> DataFrame:
    """Topics that bind communities: here a topic's community is its majority category."""
    label = topic_majority_label(spark, d).select("topic_id", F.col("category").alias("community"))
    e = links(segments(spark, d)).filter("from_topic != to_topic").groupBy("from_topic", "to_topic").agg(F.count("*").alias("w"))
    ends = e.select(F.col("from_topic").alias("topic_id"), F.col("to_topic").alias("other"), "w").unionByName(e.select(F.col("to_topic").alias("topic_id"), F.col("from_topic").alias("other"), "w"))
    far = label.select(F.col("topic_id").alias("other"), F.col("community").alias("far"))
    j = ends.join(F.broadcast(label), "topic_id").join(F.broadcast(far), "other")
    cross = F.sum(F.when(F.col("community") != F.col("far"), F.col("w")).otherwise(0))
    kinds = F.countDistinct(F.when(F.col("community") != F.col("far"), F.col("far")))
    return j.groupBy("topic_id").agg(cross.alias("cross_weight"), F.sum("w").alias("all_weight"), js_round(cross / F.sum("w") * F.log1p(cross) * F.greatest(kinds, F.lit(1))).alias("score"))


def atlas_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Segments on a 42 x 26 grid over their scaled coordinates."""
    s = segments(spark, d).select("category", "start_ts", "x", "y")
    b = s.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    unit = lambda v, lo, hi: F.when(F.col(hi) > F.col(lo), (F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(0.5)
    t = s.join(F.broadcast(b)).withColumns({"col": F.least(F.floor(unit("x", "x0", "x1") * 42), F.lit(41)), "row": F.least(F.floor(unit("y", "y0", "y1") * 26), F.lit(25))})
    per = t.groupBy("col", "row", "category").agg(F.count("*").alias("n"), F.sum("start_ts").alias("ts"))
    return per.groupBy("col", "row").agg(F.sum("n").alias("n"), F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("dominant"), F.count("*").alias("n_categories"), F.floor(F.sum("ts") / F.sum("n")).alias("mean_ts"))


def atlas_islands(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    c = s.groupBy("topic_id").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy")).filter("n >= 10")
    far = F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2))
    return s.join(F.broadcast(c), "topic_id").groupBy("topic_id").agg(F.first("n").alias("n"), js_round(F.first("cx"), 4).alias("cx"), js_round(F.first("cy"), 4).alias("cy"), js_round(F.avg(far), 4).alias("radius"))


def link_bridges(spark: SparkSession, d: str) -> DataFrame:
    """Links that leap far on the map within a day."""
    s = segments(spark, d)
    a = s.select(F.col("segment_id").alias("from_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = s.select(F.col("segment_id").alias("to_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    j = links(s).filter("gap < 86400").join(a, "from_id").join(b, "to_id")
    far = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    return j.withColumn("distance", js_round(far, 4)).filter("distance > 60").select("from_id", "to_id", "gap", "distance")


#: The offsets of the survival curve.
SURVIVAL = (3, 6, 9, 12, 18, 24, 30, 36, 42, 48, 54, 60)


def survival_curve(spark: SparkSession, d: str) -> DataFrame:
    """Of a chat's topics that began so many days before the log's last day, how many lasted as long."""
    day = F.floor(F.col("start_ts") / 86400)
    s = segments(spark, d).groupBy("chat_id", "topic_id").agg(F.min(day).alias("a"), F.max(day).alias("b"))
    s = s.join(F.broadcast(s.agg(F.max("b").alias("edge"))))
    offsets = s.withColumn("offset", F.explode(F.array(*[F.lit(x) for x in SURVIVAL]))).filter(F.col("a") + F.col("offset") <= F.col("edge"))
    alive = F.count_if(F.col("b") - F.col("a") >= F.col("offset"))
    return offsets.groupBy("offset").agg(alive.alias("alive"), F.count("*").alias("n"), js_round(alive / F.count("*")).alias("rate"))


def dormancy_returns(spark: SparkSession, d: str) -> DataFrame:
    """A topic of a chat that returns after at least three days without it."""
    s = segments(spark, d).withColumn("day", F.floor(F.col("start_ts") / 86400).cast("bigint")).select("chat_id", "topic_id", "day").distinct()
    w = Window.partitionBy("chat_id", "topic_id").orderBy("day")
    r = s.withColumn("gap", F.col("day") - F.lag("day").over(w)).filter("gap >= 3")
    return r.groupBy("topic_id").agg(F.count("*").alias("returns"), F.max("gap").alias("longest"))


def topic_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Days on which a topic is back with 3 or more segments after 2 or more days away, over all chats."""
    s = segments(spark, d).withColumn("day", F.floor(F.col("start_ts") / 86400).cast("bigint"))
    c = s.groupBy("topic_id", "day").agg(F.count("*").alias("n"))
    w = Window.partitionBy("topic_id").orderBy("day")
    return c.withColumn("gap", F.col("day") - F.lag("day").over(w)).filter("n >= 3 and (gap is null or gap >= 2)")


def interface_schema_probe(spark: SparkSession, d: str) -> DataFrame:
    """An optional column is read where the table has it, and is null where not."""
    o = table(spark, d, "orders")
    extra = F.col("o_comment") if "o_comment" in o.columns else F.lit(None).cast("string")
    return o.select("o_orderkey", extra.alias("comment")).groupBy("comment").agg(F.count("*").alias("n"))


_DAY = "CAST(floor(start_ts / 86400) AS BIGINT)"
_KINDS = ("click", "error", "purchase", "signup", "view")

ORACLE_SQL = {
    "thread_replies": f"WITH {MESSAGES} SELECT a.id, a.reply_to_id, a.chat_id, b.chat_id AS source_chat, a.ts - b.ts AS delay, CAST(a.is_from_me = b.is_from_me AS INT) AS same_sender FROM messages a JOIN messages b ON a.reply_to_id = b.id",
    "tapback_targets": f"WITH {MESSAGES} SELECT b.category, a.amt, a.is_from_me AS by_me, count(*) AS n FROM messages a JOIN messages b ON a.reply_to_id = b.id WHERE a.amt >= 2000 AND a.amt < 3000 AND (b.amt IS NULL OR b.amt < 2000) GROUP BY ALL",
    "segment_detail": f"WITH {SEGMENTS} SELECT segment_id, chat_id, start_ts, end_ts, n_msgs, n_me, n_them, topic_id, category, {rounded('x')} AS x, {rounded('y')} AS y FROM segments",
    "segment_preview": f"WITH {EPISODES}, r AS (SELECT chat_id, episode, category, row_number() OVER (PARTITION BY chat_id, episode ORDER BY ts, id) AS pos FROM episodes) SELECT chat_id, episode, string_agg(category, ' / ' ORDER BY pos) AS preview FROM r WHERE pos <= 3 GROUP BY 1, 2",
    "segments_in_scope_semi": f"WITH {EPISODES}, s AS (SELECT chat_id, episode, count(*) AS n_msgs FROM episodes GROUP BY 1, 2) SELECT * FROM s WHERE EXISTS (SELECT 1 FROM episodes e WHERE e.chat_id = s.chat_id AND e.episode = s.episode AND (e.amt IS NULL OR e.amt = 0) AND e.is_from_me = 0 AND e.ts >= {START} AND e.ts < {END})",
    "chats_without_reactions_anti": f"WITH {MESSAGES}, d AS (SELECT *, CAST(floor(ts / 86400) AS BIGINT) AS day FROM messages) SELECT chat_id, day, count(*) AS n FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.chat_id = d.chat_id AND e.day = d.day AND e.amt >= 2000 AND e.amt < 3000) GROUP BY 1, 2",
    "attachment_interval_join": f"WITH {SEGMENTS} SELECT m.id AS attachment_id, m.chat_id, s.segment_id FROM messages m JOIN segments s ON m.chat_id = s.chat_id AND m.ts BETWEEN s.start_ts AND s.end_ts WHERE m.has_attachment = 1 QUALIFY row_number() OVER (PARTITION BY m.id ORDER BY s.start_ts DESC) = 1",
    "reply_within_4h_24h": f"""WITH {MESSAGES}, t AS (SELECT * FROM messages WHERE amt IS NULL OR amt = 0) SELECT a.id, a.chat_id, count(*) FILTER (b.ts <= a.ts + 14400) - 1 AS n_4h, count(*) - 1 AS n_24h,
 count(*) FILTER (b.ts <= a.ts + 14400 AND b.is_from_me <> a.is_from_me) AS other_4h, count(*) FILTER (b.is_from_me <> a.is_from_me) AS other_24h FROM t a JOIN t b ON a.chat_id = b.chat_id AND b.ts BETWEEN a.ts AND a.ts + 86400 GROUP BY a.id, a.chat_id""",
    "phase_scope": f"WITH {MESSAGES} SELECT 'phase 1' AS scope, count(*) AS n FROM messages WHERE ts >= 1701417600 AND ts < 1704096000 UNION ALL SELECT 'phase 2 from the 5th', count(*) FROM messages WHERE ts >= {START} AND ts < 1706774400",
    "segment_links": f"WITH {LINKS} SELECT chat_id, from_id, to_id, gap, from_category, to_category FROM links",
    "category_transitions": f"WITH {LINKS} SELECT from_category, to_category, count(*) AS n, {rounded('sum(gap) / count(*)')} AS mean_gap FROM links GROUP BY 1, 2",
    "transition_lift": f"WITH {LINKS}, c AS (SELECT from_category, to_category, count(*) AS n FROM links GROUP BY 1, 2) SELECT from_category, to_category, n, {rounded('n / (sum(n) OVER (PARTITION BY from_category) * sum(n) OVER (PARTITION BY to_category) / sum(n) OVER ())')} AS lift FROM c",
    "category_share": f"WITH {SEGMENTS}, c AS (SELECT {_DAY} AS day, category, count(*) AS n FROM segments GROUP BY 1, 2) SELECT day, category, n, {rounded('n / sum(n) OVER (PARTITION BY day)')} AS share FROM c",
    "category_pivot": f"WITH {SEGMENTS} SELECT {_DAY} AS day, " + ", ".join(f"count(*) FILTER (category = '{k}') AS {k}" for k in _KINDS) + ", count(*) AS total FROM segments GROUP BY 1",
    "category_summary": f"WITH {SEGMENTS} SELECT category, count(*) AS n_segments, CAST(sum(n_msgs) AS BIGINT) AS n_msgs, {rounded('sum(n_msgs) / count(*)')} AS mean_msgs, min(start_ts) AS first_ts, max(end_ts) AS last_ts FROM segments GROUP BY 1",
    "gravity": f"""WITH {SEGMENTS}, f AS (SELECT chat_id, episode, arg_min(is_from_me, (ts, id)) AS starter FROM episodes GROUP BY 1, 2), s AS (SELECT * FROM segments JOIN f USING (chat_id, episode)),
w AS (SELECT sum(starter) / count(*) AS ss, sum(n_me) / sum(n_msgs) AS ms FROM s) SELECT category, count(*) AS n, {rounded('0.65 * (sum(starter) / count(*) - any_value(ss)) + 0.35 * (sum(n_me) / sum(n_msgs) - any_value(ms))')} AS pull FROM s, w GROUP BY 1 HAVING count(*) >= 12""",
    "topic_majority_label": f"WITH {SEGMENTS}, v AS (SELECT topic_id, category, CAST(sum(n_msgs) AS BIGINT) AS weight FROM segments GROUP BY 1, 2) SELECT topic_id, category, weight, {rounded('weight / sum(weight) OVER (PARTITION BY topic_id)')} AS share FROM v QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, category) = 1",
    "topic_entropy": f"WITH {SEGMENTS}, c AS (SELECT topic_id, category, count(*) AS n FROM segments GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY topic_id) AS p FROM c) SELECT topic_id, count(*) AS classes, {rounded('sum(-p * log2(p))')} AS bits, {rounded('CASE WHEN count(*) > 1 THEN sum(-p * log2(p)) / log2(count(*)) ELSE 0 END')} AS normalised FROM p GROUP BY 1",
    "constellation_edges": f"""WITH {LINKS}, e AS (SELECT from_topic, to_topic, count(*) AS weight, sum(gap) AS gap FROM links WHERE from_topic <> to_topic GROUP BY 1, 2),
f AS (SELECT *, weight * sum(weight) OVER () / (sum(weight) OVER (PARTITION BY from_topic) * sum(weight) OVER (PARTITION BY to_topic)) AS lift FROM e)
SELECT from_topic, to_topic, weight, {rounded('gap / weight')} AS mean_gap, {rounded('lift')} AS lift, {rounded('weight * log2(1 + lift)')} AS score FROM f WHERE weight >= 2""",
    "broker_scores": f"""WITH {LINKS}, v AS (SELECT topic_id, category, sum(n_msgs) AS weight FROM segments GROUP BY 1, 2), lab AS (SELECT topic_id, category FROM v QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, category) = 1),
e AS (SELECT from_topic AS a, to_topic AS b, count(*) AS w FROM links WHERE from_topic <> to_topic GROUP BY 1, 2), ends AS (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e),
j AS (SELECT a AS topic_id, w, x.category AS near, y.category AS far FROM ends JOIN lab x ON a = x.topic_id JOIN lab y ON b = y.topic_id)
SELECT topic_id, CAST(sum(CASE WHEN near <> far THEN w ELSE 0 END) AS BIGINT) AS cross_weight, CAST(sum(w) AS BIGINT) AS all_weight,
 {rounded('sum(CASE WHEN near <> far THEN w ELSE 0 END) / sum(w) * ln(1 + sum(CASE WHEN near <> far THEN w ELSE 0 END)) * greatest(count(DISTINCT CASE WHEN near <> far THEN far END), 1)')} AS score FROM j GROUP BY 1""",
    "atlas_tiles": f"""WITH {SEGMENTS}, b AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM segments),
t AS (SELECT least(CAST(floor(CASE WHEN x1 > x0 THEN (x - x0) / (x1 - x0) ELSE 0.5 END * 42) AS BIGINT), 41) AS col, least(CAST(floor(CASE WHEN y1 > y0 THEN (y - y0) / (y1 - y0) ELSE 0.5 END * 26) AS BIGINT), 25) AS row, category, start_ts FROM segments, b),
p AS (SELECT col, row, category, count(*) AS n, sum(start_ts) AS ts FROM t GROUP BY 1, 2, 3) SELECT col, row, CAST(sum(n) AS BIGINT) AS n, arg_min(category, (-n, category)) AS dominant, count(*) AS n_categories, CAST(floor(sum(ts) / sum(n)) AS BIGINT) AS mean_ts FROM p GROUP BY 1, 2""",
    "atlas_islands": f"WITH {SEGMENTS}, c AS (SELECT topic_id, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM segments GROUP BY 1 HAVING count(*) >= 10) SELECT topic_id, any_value(n) AS n, {rounded('any_value(cx)', 4)} AS cx, {rounded('any_value(cy)', 4)} AS cy, {rounded('avg(sqrt(pow(x - cx, 2) + pow(y - cy, 2)))', 4)} AS radius FROM segments JOIN c USING (topic_id) GROUP BY 1",
    "link_bridges": f"WITH {LINKS}, j AS (SELECT from_id, to_id, gap, {rounded('sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))', 4)} AS distance FROM links l JOIN segments a ON l.from_id = a.segment_id JOIN segments b ON l.to_id = b.segment_id WHERE gap < 86400) SELECT * FROM j WHERE distance > 60",
    "survival_curve": f"""WITH {SEGMENTS}, s AS (SELECT chat_id, topic_id, min({_DAY}) AS a, max({_DAY}) AS b FROM segments GROUP BY 1, 2), o AS (SELECT unnest([{", ".join(map(str, SURVIVAL))}]) AS "offset")
SELECT "offset", count(*) FILTER (b - a >= "offset") AS alive, count(*) AS n, {rounded('count(*) FILTER (b - a >= "offset") / count(*)')} AS rate FROM s, o WHERE a + "offset" <= (SELECT max(b) FROM s) GROUP BY 1""",
    "dormancy_returns": f"WITH {SEGMENTS}, d AS (SELECT DISTINCT chat_id, topic_id, {_DAY} AS day FROM segments), g AS (SELECT topic_id, day - lag(day) OVER (PARTITION BY chat_id, topic_id ORDER BY day) AS gap FROM d) SELECT topic_id, count(*) AS returns, max(gap) AS longest FROM g WHERE gap >= 3 GROUP BY 1",
    "topic_arrivals": f"WITH {SEGMENTS}, c AS (SELECT topic_id, {_DAY} AS day, count(*) AS n FROM segments GROUP BY 1, 2), g AS (SELECT *, day - lag(day) OVER (PARTITION BY topic_id ORDER BY day) AS gap FROM c) SELECT * FROM g WHERE n >= 3 AND (gap IS NULL OR gap >= 2)",
    "interface_schema_probe": "SELECT CAST(NULL AS VARCHAR) AS comment, count(*) AS n FROM orders GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
