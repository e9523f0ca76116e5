"""Who does what after whom: moves, predictions, information, loops, ignition, recovery.

The log's categories stand for the kinds of a message's move, as its texts are invented; the ladders of patterns that
find kinds in English are in functions/text.py and tested there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorale.functions import stats, text, timeutil
from chorale.functions.scope import kind_filter
from chorale.functions.stats import js_round
from chorale.operators import sequence
from chorale.plans.dialect import ASCII_TOKENS, LOCAL, MESSAGES, TEXT_MESSAGES, bounded, rounded
from chorale.sources.tables import messages, text_messages

W = sequence.ordered


def _moves(spark: SparkSession, d: str) -> DataFrame:
    """Episodes of moves: adjacent ones of one sender and kind are one."""
    e = sequence.episodes(messages(spark, d).filter(kind_filter("visible_message")))
    w = Window.partitionBy("chat_id", "episode").orderBy("ts", "id")
    new = F.coalesce((F.lag("is_from_me").over(w) != F.col("is_from_me")) | (F.lag("category").over(w) != F.col("category")), F.lit(True))
    m = e.withColumn("_new", new.cast("int")).withColumn("at", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sender = F.when(F.col("is_from_me") == 1, "me").otherwise("them")
    return m.groupBy("chat_id", "episode", "at").agg(F.min("ts").alias("ts"), F.max("ts").alias("end_ts"), F.min("id").alias("id"), F.first(F.concat(sender, F.lit(":"), F.col("category"))).alias("move"), F.count("*").alias("n"))


def collapsed_moves(spark: SparkSession, d: str) -> DataFrame:
    return _moves(spark, d).groupBy("move").agg(F.count("*").alias("moves"), F.sum("n").alias("messages"), F.max("n").alias("longest"))


def move_transitions(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("chat_id", "episode").orderBy("at")
    p = _moves(spark, d).withColumn("next", F.lead("move").over(w)).filter("next is not null")
    c = p.groupBy("move", "next").agg(F.count("*").alias("n"))
    c = c.withColumns({"out": F.sum("n").over(Window.partitionBy("move")), "into": F.sum("n").over(Window.partitionBy("next"))}).join(F.broadcast(c.agg(F.sum("n").alias("total"))))
    lift = F.col("n") * F.col("total") / (F.col("out") * F.col("into"))
    return c.filter("n >= 5").select("move", "next", "n", js_round(lift).alias("lift"))


def move_paths3(spark: SparkSession, d: str) -> DataFrame:
    """Paths of three moves against what their parts would give."""
    m = _moves(spark, d)
    w = Window.partitionBy("chat_id", "episode").orderBy("at")
    paths = m.select("move", F.lead("move", 1).over(w).alias("b"), F.lead("move", 2).over(w).alias("c")).filter("c is not null")
    total = paths.agg(F.count("*").alias("total"))
    base = m.groupBy("move").agg(F.count("*").alias("k"))
    kinds = base.agg(F.sum("k").alias("all"), F.count("*").alias("v"))
    n = paths.groupBy("move", "b", "c").agg(F.count("*").alias("n")).filter("n >= 10")
    p = lambda x: (F.col(x) + 1) / (F.col("all") + F.col("v"))
    j = n.join(F.broadcast(total)).join(F.broadcast(kinds))
    for col, name in (("move", "ka"), ("b", "kb"), ("c", "kc")):
        j = j.join(F.broadcast(base.select(F.col("move").alias(col), F.col("k").alias(name))), col)
    lift = F.col("n") / (F.col("total") * p("ka") * p("kb") * p("kc"))
    score = F.log2(lift) * F.sqrt("n") + F.col("n") / 80
    return j.withColumn("lift", js_round(lift)).filter("lift >= 1.25").select(F.concat_ws(" > ", "move", "b", "c").alias("path"), "n", "lift", js_round(score, 4).alias("score"))


#: Fixed value: the longest context.
CONTEXT = 8


def next_move_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The likeliest next move after each context of two to eight moves."""
    w = Window.partitionBy("chat_id", "episode").orderBy("at")
    m = _moves(spark, d)
    recent = F.collect_list("move").over(w.rowsBetween(-CONTEXT, -1))
    c = m.select("move", recent.alias("past")).withColumn("k", F.explode(F.sequence(F.lit(2), F.lit(CONTEXT)))).filter(F.size("past") >= F.col("k"))
    c = c.groupBy(F.array_join(F.slice("past", -F.col("k"), F.col("k")), " > ").alias("context"), "move").agg(F.count("*").alias("n"))
    by = Window.partitionBy("context")
    c = c.withColumns({"support": F.sum("n").over(by), "at": F.row_number().over(by.orderBy(F.desc("n"), "move"))})
    return c.filter("at = 1 and support >= 6 and n >= 3").select("context", F.col("move").alias("next"), "n", "support", js_round(F.col("n") / F.col("support")).alias("p")).filter("p >= 0.38")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Replies within a day: the kinds of both messages, by direction."""
    w = W()
    m = messages(spark, d).filter(kind_filter("visible_message"))
    p = m.select("chat_id", "id", "ts", "is_from_me", "category", F.lead("category").over(w).alias("reply"), F.lead("is_from_me").over(w).alias("by_me"), F.lead("ts").over(w).alias("reply_ts"), "word_count", F.lead("word_count").over(w).alias("reply_words"), F.lead("has_attachment").over(w).alias("reply_att"), "has_attachment")
    way = F.when(F.col("is_from_me") == 1, "me_to_them").otherwise("them_to_me")
    return p.filter((F.col("by_me") != F.col("is_from_me")) & (F.col("reply_ts") - F.col("ts") <= 86400)).withColumn("direction", way)


def mutual_information(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of replies, what is left of it once the source's kind is known, and the difference, in bits."""
    c = _pairs(spark, d).groupBy("direction", "category", "reply").agg(F.count("*").alias("n"))
    way, src, rep = Window.partitionBy("direction"), Window.partitionBy("direction", "category"), Window.partitionBy("direction", "reply")
    p = c.withColumns({"total": F.sum("n").over(way), "x": F.sum("n").over(src), "y": F.sum("n").over(rep)})
    h_y = -F.sum(F.col("n") / F.col("total") * F.log2(F.col("y") / F.col("total")))
    h_yx = -F.sum(F.col("n") / F.col("total") * F.log2(F.col("n") / F.col("x")))
    return p.groupBy("direction").agg(F.sum("n").alias("pairs"), js_round(h_y).alias("reply_entropy"), js_round(h_yx).alias("conditional_entropy"), js_round(F.greatest(h_y - h_yx, F.lit(0.0))).alias("bits"))


def channel_cells(spark: SparkSession, d: str) -> DataFrame:
    c = _pairs(spark, d).groupBy("direction", "category", "reply").agg(F.count("*").alias("n"))
    way, src, rep = Window.partitionBy("direction"), Window.partitionBy("direction", "category"), Window.partitionBy("direction", "reply")
    p = F.col("n") / F.sum("n").over(way)
    lift = F.col("n") * F.sum("n").over(way) / (F.sum("n").over(src) * F.sum("n").over(rep))
    return c.select("direction", "category", "reply", "n", js_round(p).alias("p"), js_round(lift).alias("lift"), js_round(p * F.log2(lift)).alias("bits"))


def cue_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words of a text that make a long reply likelier: rate, lift and bits."""
    w = W()
    t = text_messages(spark, d)
    p = t.select("id", "text", "is_from_me", F.lead("is_from_me").over(w).alias("by"), F.length(F.lead("text").over(w)).alias("reply_chars")).filter("by != is_from_me")
    p = p.withColumn("long", (F.col("reply_chars") > 400).cast("int"))
    base = p.agg(F.count("*").alias("pairs"), F.sum("long").alias("longs"))
    k = p.select("long", F.explode(F.array_distinct(text.ascii_tokens(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("long").alias("hits"))
    rate, whole = F.col("hits") / F.col("n"), F.col("longs") / F.col("pairs")
    return k.filter("n >= 10 and hits >= 4").join(F.broadcast(base)).withColumn("lift", js_round(rate / whole)).filter("lift >= 1.1").select("word", "n", "hits", "lift", js_round(F.col("hits") / F.col("pairs") * F.log2(rate / whole)).alias("bits"))


def resonance_cells(spark: SparkSession, d: str) -> DataFrame:
    """Kinds that evoke a kind in reply: cells of twelve pairs or more, lift 1.05 or more, and how fast they come."""
    p = _pairs(spark, d).withColumn("fast", (F.col("reply_ts") - F.col("ts") <= 3600).cast("int"))
    c = p.groupBy("category", "reply").agg(F.count("*").alias("n"), F.sum("fast").alias("fast"))
    total = c.agg(F.sum("n").alias("total"))
    c = c.withColumns({"x": F.sum("n").over(Window.partitionBy("category")), "y": F.sum("n").over(Window.partitionBy("reply"))}).join(F.broadcast(total))
    lift = F.col("n") * F.col("total") / (F.col("x") * F.col("y"))
    return c.withColumn("lift", js_round(lift)).filter("n >= 12 and lift >= 1.05").select("category", "reply", "n", "lift", js_round(F.col("fast") / F.col("n")).alias("fast_rate"))


def bids_by_type(spark: SparkSession, d: str) -> DataFrame:
    """A message's category as its bid: how many the other side answers within one and six hours."""
    m = sequence.next_other(messages(spark, d).filter(kind_filter("visible_message")))
    wait = F.col("other_ts") - F.col("ts")
    return m.groupBy("category", "is_from_me").agg(F.count("*").alias("n"), F.count_if(wait <= 3600).alias("in_1h"), F.count_if(wait <= 21600).alias("in_6h"), F.count_if(wait.isNull() | (wait >= 86400)).alias("hanging"), js_round(F.count_if(wait <= 21600) / F.count("*")).alias("rate"))


QUESTION_WORDS = ("how", "what", "when", "where", "why", "who", "can", "could", "would", "should", "do", "did", "are", "is", "will")


def question_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a question mark or an English question word first, by their first word's shape."""
    t = text_messages(spark, d)
    first = F.get(text.ascii_tokens(F.col("text")), 0)
    shape = F.when(first.isin("how", "what", "when", "where", "why", "who", "will"), first).when(first.isin("can", "could"), "can_could").when(first.isin("would", "should"), "would_should").when(first.isin("do", "does", "did"), "do_did").when(first.isin("are", "is"), "are_is").otherwise("other")
    return t.filter(F.col("text").contains("?") | first.isin(*QUESTION_WORDS)).groupBy("is_from_me", shape.alias("shape")).agg(F.count("*").alias("n"))


def _loops(spark: SparkSession, d: str) -> DataFrame:
    """purchase and signup as open questions: the first reply within 48 h, and follow-ups of the same kind before it."""
    m = sequence.next_other(messages(spark, d).filter(kind_filter("visible_message")), "word_count")
    later = m.select("chat_id", F.col("is_from_me").alias("s"), F.col("category").alias("c"), F.col("ts").alias("t"), F.col("id").alias("i"))
    o = m.filter(F.col("category").isin("purchase", "signup")).withColumn("reply_s", F.when(F.col("other_ts") - F.col("ts") <= 172800, F.col("other_ts") - F.col("ts")))
    # the same kind again within 12 h: hour buckets make the range join an equi-join
    size = 43200
    left = o.withColumn("bucket", F.explode(F.array(F.floor(F.col("ts") / size), F.floor(F.col("ts") / size) + 1)))
    right = later.withColumn("bucket", F.floor(F.col("t") / size)).withColumnRenamed("chat_id", "chat")
    end = F.least(F.col("ts") + size, F.coalesce(F.col("other_ts"), F.col("ts") + size))
    after = (F.col("t") > F.col("ts")) | ((F.col("t") == F.col("ts")) & (F.col("i") > F.col("id")))
    cond = (left["chat_id"] == F.col("chat")) & (left["bucket"] == right["bucket"]) & (F.col("s") == F.col("is_from_me")) & (F.col("c") == F.col("category")) & after & (F.col("t") < end)
    n = left.join(right, cond).groupBy("id").agg(F.count("*").alias("follow_ups"))
    return o.join(n, "id", "left").na.fill(0, ["follow_ups"])


def open_loops(spark: SparkSession, d: str) -> DataFrame:
    """Loops by what became of them: how soon a reply came, and how much it says."""
    score = F.least(F.lit(1.0), F.col("other_word_count") / 100)
    status = F.when(F.col("reply_s").isNull(), "open").when((F.col("follow_ups") > 0) & ((F.col("reply_s") > 21600) | (score < 0.75)), "reopened").when((F.col("reply_s") <= 21600) & (score >= 0.55), "closed").when(score >= 0.75, "closed").otherwise("delayed")
    return _loops(spark, d).groupBy("category", status.alias("status")).agg(F.count("*").alias("n"), F.sum("follow_ups").alias("follow_ups"))


def loop_debt(spark: SparkSession, d: str) -> DataFrame:
    """What stays open by chat: two for each open loop, one and a half for a reopened one, one for a delayed one."""
    o = _loops(spark, d)
    n_open = F.count_if(F.col("reply_s").isNull())
    reopened = F.count_if(F.col("reply_s").isNotNull() & (F.col("follow_ups") > 0))
    delayed = F.count_if(F.col("reply_s").isNotNull() & (F.col("follow_ups") == 0) & (F.col("reply_s") > 21600))
    return o.groupBy("chat_id").agg(F.count("*").alias("n"), js_round(2.0 * n_open + 1.5 * reopened + delayed + 0.35 * F.greatest(F.count("*") - 4, F.lit(0))).alias("debt"))


def ignition_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Messages after a silence of six hours: what follows within 4 and 24 hours, and whether it caught fire."""
    m = messages(spark, d).filter(kind_filter("visible_message"))
    four, day = sequence.following(m, 14400), sequence.following(m, 86400)
    other = lambda w: F.when(F.col("is_from_me") == 1, F.sum(1 - F.col("is_from_me")).over(w)).otherwise(F.sum("is_from_me").over(w))
    g = sequence.next_other(m).withColumns({"gap": F.col("ts") - F.lag("ts").over(W()), "m4": F.count("*").over(four), "o4": other(four), "m24": F.count("*").over(day)})
    a = g.filter("gap >= 21600").withColumn("reply_s", F.when(F.col("other_ts") - F.col("ts") <= 86400, F.col("other_ts") - F.col("ts")))
    lit = F.col("reply_s").isNotNull() & (((F.col("reply_s") <= 7200) & (F.col("m4") >= 8) & (F.col("o4") >= 2)) | (F.col("m24") >= 20) | ((F.col("m4") >= 16) & (F.col("o4") >= 4)))
    return a.select("chat_id", "id", "gap", "reply_s", "m4", "o4", "m24", lit.cast("int").alias("ignited"))


def repair_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Episodes of errors (gaps over 2 h): the first purchase, view or click in the day after, before the next episode."""
    m = messages(spark, d)
    e = sequence.episodes(m.filter("category = 'error'"))
    ep = e.groupBy("chat_id", "episode").agg(F.max("ts").alias("end_ts"), F.min("ts").alias("start_ts"))
    w = Window.partitionBy("chat_id").orderBy("start_ts")
    ep = ep.withColumn("until", F.least(F.col("end_ts") + 86400, F.coalesce(F.lead("start_ts").over(w), F.col("end_ts") + 86400)))
    good = m.filter(F.col("category").isin("purchase", "view", "click")).select("chat_id", "ts", "id", "category")
    size = 86400
    left = ep.withColumn("bucket", F.explode(F.array(F.floor(F.col("end_ts") / size), F.floor(F.col("end_ts") / size) + 1)))
    right = good.withColumn("bucket", F.floor(F.col("ts") / size))
    j = left.join(right, ["chat_id", "bucket"]).filter("ts > end_ts and ts <= until")
    first = j.groupBy("chat_id", "episode").agg(F.min_by(F.struct("ts", "category"), F.struct("ts", "id")).alias("r"))
    out = ep.join(first, ["chat_id", "episode"], "left")
    return out.select("chat_id", "end_ts", (F.col("r.ts") - F.col("end_ts")).alias("recovery_s"), F.col("r.category").alias("kind"))


def support_rate(spark: SparkSession, d: str) -> DataFrame:
    """After an error, whether the other side's first message within 6 h is a purchase or click; none at all is null."""
    m = messages(spark, d)
    back = Window.partitionBy("chat_id").orderBy(F.desc("ts"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda who: F.last(F.when(F.col("is_from_me") == who, F.struct("ts", "category")), ignorenulls=True).over(back)
    s = m.withColumns({"a": last(1), "b": last(0)}).withColumn("o", F.when(F.col("is_from_me") == 1, F.col("b")).otherwise(F.col("a")))
    hit = F.when(F.col("o.ts") - F.col("ts") <= 21600, F.col("o.category").isin("purchase", "click").cast("int"))
    return s.filter("category = 'error'").withColumn("hit", hit).groupBy("chat_id").agg(F.count("*").alias("n"), F.count("hit").alias("answered"), js_round(F.avg("hit")).alias("rate"))


def gesture_draws(spark: SparkSession, d: str) -> DataFrame:
    """Which kinds of message draw reactions: rate among those that a reaction points to, and the log-odds against the rest."""
    m = messages(spark, d)
    reacted = m.filter(kind_filter("reaction_add") & F.col("reply_to_id").isNotNull()).select(F.col("reply_to_id").alias("id")).distinct().withColumn("hit", F.lit(1))
    j = m.filter(kind_filter("visible_message")).join(reacted, "id", "left")
    c = j.groupBy("category").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    t = c.agg(F.sum("n").alias("all_n"), F.sum("hits").alias("all_hits"))
    a, b = F.col("hits") + 1.5, F.col("n") - F.col("hits") + 1.5
    e, f = F.col("all_hits") - F.col("hits") + 1.5, F.col("all_n") - F.col("all_hits") - (F.col("n") - F.col("hits")) + 1.5
    z = (F.log(a / b) - F.log(e / f)) / F.sqrt(1 / a + 1 / b + 1 / e + 1 / f)
    return c.join(F.broadcast(t)).select("category", "n", "hits", js_round(F.col("hits") / F.col("n")).alias("rate"), js_round(z, 4).alias("z"))


def object_channel(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).filter("has_attachment = 1")
    day = F.floor(F.col("ts") / 86400).cast("bigint")
    return m.groupBy(day.alias("day"), "is_from_me").agg(F.count("*").alias("n"), F.countDistinct("category").alias("kinds"))


def score_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Messages whose score is high, in sessions parted by six hours, with the switches of sender and the longest alternation."""
    m = messages(spark, d).filter("value >= 60")
    s = sequence.episodes(m, 21600, "session")
    w = Window.partitionBy("chat_id", "session").orderBy("ts", "id")
    s = s.withColumn("switch", F.coalesce((F.lag("is_from_me").over(w) != F.col("is_from_me")).cast("int"), F.lit(0)))
    s = s.withColumn("run", F.sum(1 - F.col("switch")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    alternating = s.groupBy("chat_id", "session", "run").agg(F.count("*").alias("k")).groupBy("chat_id", "session").agg(F.max("k").alias("alternating"))
    per = s.groupBy("chat_id", "session").agg(F.count("*").alias("n"), F.sum("switch").alias("switches"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    return per.join(alternating, ["chat_id", "session"])


def score_context(spark: SparkSession, d: str) -> DataFrame:
    """How many messages lie within twenty minutes of a high score, itself included."""
    w = Window.partitionBy("chat_id").orderBy("ts").rangeBetween(-1200, 1200)
    m = messages(spark, d).withColumn("around", F.count("*").over(w))
    return m.filter("value >= 60").select("id", "chat_id", "around")


def weekly_rates(spark: SparkSession, d: str) -> DataFrame:
    """Local weeks (Mondays) of each chat with twelve messages or more: shares of kinds."""
    m = messages(spark, d).filter(kind_filter("visible_message"))
    return m.groupBy("chat_id", timeutil.week_key(F.col("ts")).alias("week")).agg(F.count("*").alias("n"), js_round(F.avg("is_from_me")).alias("me"), *[js_round(F.count_if(F.col("category") == k) / F.count("*")).alias(k) for k in ("click", "view", "purchase", "signup")]).filter("n >= 12")


def insight_shift(spark: SparkSession, d: str) -> DataFrame:
    """The last ten days against the ten before, by chat."""
    m = messages(spark, d).filter(kind_filter("visible_message"))
    end = m.agg(F.max("ts").alias("last"))
    a = m.join(F.broadcast(end)).withColumn("age", F.floor((F.col("last") - F.col("ts")) / 864000))
    return a.groupBy("chat_id").agg(F.count_if(F.col("age") == 0).alias("recent"), F.count_if(F.col("age") == 1).alias("before")).withColumn("change", js_round((F.col("recent") - F.col("before")) / F.greatest(F.col("before"), F.lit(1))))


_VISIBLE = "(amt IS NULL OR amt < 2000)"
_MOVES = f"""{MESSAGES}, v0 AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY chat_id ORDER BY ts, id) > 7200 THEN 1 ELSE 0 END AS cut FROM messages WHERE {_VISIBLE}),
v1 AS (SELECT *, sum(cut) OVER (PARTITION BY chat_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS episode FROM v0),
v2 AS (SELECT *, CASE WHEN lag(is_from_me) OVER w = is_from_me AND lag(category) OVER w = category THEN 0 ELSE 1 END AS new FROM v1 WINDOW w AS (PARTITION BY chat_id, episode ORDER BY ts, id)),
v3 AS (SELECT *, sum(new) OVER (PARTITION BY chat_id, episode ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS at_ FROM v2),
moves AS (SELECT chat_id, episode, at_, min(CASE WHEN is_from_me = 1 THEN 'me' ELSE 'them' END || ':' || category) AS move, count(*) AS n FROM v3 GROUP BY 1, 2, 3)"""
_PAIRS = f"""{MESSAGES}, q0 AS (SELECT chat_id, id, ts, is_from_me, category, lead(category) OVER w AS reply, lead(is_from_me) OVER w AS by_me, lead(ts) OVER w AS reply_ts, word_count, lead(word_count) OVER w AS reply_words, has_attachment,
 lead(has_attachment) OVER w AS reply_att FROM messages WHERE {_VISIBLE} WINDOW w AS (PARTITION BY chat_id ORDER BY ts, id)),
replies AS (SELECT *, CASE WHEN is_from_me = 1 THEN 'me_to_them' ELSE 'them_to_me' END AS direction FROM q0 WHERE by_me <> is_from_me AND reply_ts - ts <= 86400)"""
_NEXT = f"""{MESSAGES}, x AS (SELECT * FROM messages WHERE {_VISIBLE}), nx AS (SELECT a.id, min(b.ts) AS other_ts FROM x a JOIN x b ON a.chat_id = b.chat_id AND a.is_from_me <> b.is_from_me AND (b.ts > a.ts OR (b.ts = a.ts AND b.id > a.id)) GROUP BY 1),
waits AS (SELECT x.*, other_ts, other_ts - ts AS wait FROM x LEFT JOIN nx USING (id))"""
_LOOPS = f"""{_NEXT}, said AS (SELECT id, CASE WHEN is_from_me = 1 THEN them ELSE me END AS reply_words FROM (SELECT id, is_from_me, last_value(CASE WHEN is_from_me = 0 THEN word_count END IGNORE NULLS) OVER w AS them,
 last_value(CASE WHEN is_from_me = 1 THEN word_count END IGNORE NULLS) OVER w AS me FROM x WINDOW w AS (PARTITION BY chat_id ORDER BY ts DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
loops AS (SELECT a.id, a.chat_id, a.category, s.reply_words, CASE WHEN a.wait <= 172800 THEN a.wait END AS reply_s, count(b.id) AS follow_ups FROM waits a JOIN said s ON s.id = a.id LEFT JOIN x b ON a.chat_id = b.chat_id AND a.is_from_me = b.is_from_me
 AND a.category = b.category AND (b.ts > a.ts OR (b.ts = a.ts AND b.id > a.id)) AND b.ts < least(a.ts + 43200, coalesce(a.other_ts, a.ts + 43200)) WHERE a.category IN ('purchase', 'signup') GROUP BY ALL)"""


ORACLE_SQL = {
    "collapsed_moves": f"WITH {_MOVES} SELECT move, count(*) AS moves, CAST(sum(n) AS BIGINT) AS messages, max(n) AS longest FROM moves GROUP BY 1",
    "move_transitions": f"""WITH {_MOVES}, p AS (SELECT move, lead(move) OVER (PARTITION BY chat_id, episode ORDER BY at_) AS next FROM moves), c AS (SELECT move, next, count(*) AS n FROM p WHERE next IS NOT NULL GROUP BY 1, 2),
l AS (SELECT *, n * sum(n) OVER () / (sum(n) OVER (PARTITION BY move) * sum(n) OVER (PARTITION BY next)) AS lift FROM c) SELECT move, next, n, {rounded('lift')} AS lift FROM l WHERE n >= 5""",
    "move_paths3": f"""WITH {_MOVES}, p AS (SELECT move AS a, lead(move, 1) OVER w AS b, lead(move, 2) OVER w AS c FROM moves WINDOW w AS (PARTITION BY chat_id, episode ORDER BY at_)), q AS (SELECT * FROM p WHERE c IS NOT NULL), k AS (SELECT move, count(*) AS k FROM moves GROUP BY 1),
v AS (SELECT sum(k) AS al, count(*) AS v FROM k), n AS (SELECT a, b, c, count(*) AS n FROM q GROUP BY 1, 2, 3 HAVING count(*) >= 10),
l AS (SELECT n.a, n.b, n.c, n.n, n.n / ((SELECT count(*) FROM q) * ((x.k + 1) / (al + v)) * ((y.k + 1) / (al + v)) * ((z.k + 1) / (al + v))) AS lift FROM n, v, k x, k y, k z WHERE x.move = n.a AND y.move = n.b AND z.move = n.c)
SELECT a || ' > ' || b || ' > ' || c AS path, n, {rounded('lift')} AS lift, {rounded('log2(lift) * sqrt(n) + n / 80', 4)} AS score FROM l WHERE {rounded('lift')} >= 1.25""",
    "next_move_contexts": f"""WITH {_MOVES}, p AS (SELECT move, {", ".join(f"lag(move, {i}) OVER w AS b{i}" for i in range(1, CONTEXT + 1))} FROM moves WINDOW w AS (PARTITION BY chat_id, episode ORDER BY at_)),
x AS ({" UNION ALL ".join("SELECT move, " + " || ' > ' || ".join(f"b{i}" for i in range(k, 0, -1)) + f" AS context FROM p WHERE b{k} IS NOT NULL" for k in range(2, CONTEXT + 1))}),
c AS (SELECT context, move, count(*) AS n FROM x GROUP BY 1, 2), s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY context) AS BIGINT) AS support, row_number() OVER (PARTITION BY context ORDER BY n DESC, move) AS r FROM c)
SELECT context, move AS next, n, support, {rounded('n / support')} AS p FROM s WHERE r = 1 AND support >= 6 AND n >= 3 AND {rounded('n / support')} >= 0.38""",
    "mutual_information": f"""WITH {_PAIRS}, c AS (SELECT direction, category, reply, count(*) AS n FROM replies GROUP BY 1, 2, 3), p AS (SELECT *, sum(n) OVER (PARTITION BY direction) AS t, sum(n) OVER (PARTITION BY direction, category) AS x, sum(n) OVER (PARTITION BY direction, reply) AS y FROM c),
h AS (SELECT direction, CAST(sum(n) AS BIGINT) AS pairs, -sum(n / t * log2(y / t)) AS hy, -sum(n / t * log2(n / x)) AS hyx FROM p GROUP BY 1) SELECT direction, pairs, {rounded('hy')} AS reply_entropy, {rounded('hyx')} AS conditional_entropy, {rounded('greatest(hy - hyx, 0)')} AS bits FROM h""",
    "channel_cells": f"""WITH {_PAIRS}, c AS (SELECT direction, category, reply, count(*) AS n FROM replies GROUP BY 1, 2, 3), p AS (SELECT *, sum(n) OVER (PARTITION BY direction) AS t, sum(n) OVER (PARTITION BY direction, category) AS x, sum(n) OVER (PARTITION BY direction, reply) AS y FROM c)
SELECT direction, category, reply, n, {rounded('n / t')} AS p, {rounded('n * t / (x * y)')} AS lift, {rounded('n / t * log2(n * t / (x * y))')} AS bits FROM p""",
    "cue_tokens": f"""WITH {TEXT_MESSAGES}, p AS (SELECT id, text, is_from_me, lead(is_from_me) OVER w AS by_me, length(lead(text) OVER w) AS chars FROM text_messages WINDOW w AS (PARTITION BY chat_id ORDER BY ts, id)), q AS (SELECT *, CASE WHEN chars > 400 THEN 1 ELSE 0 END AS long FROM p WHERE by_me <> is_from_me),
b AS (SELECT count(*) AS pairs, sum(long) AS longs FROM q), k AS (SELECT long, unnest(list_distinct({ASCII_TOKENS})) AS word FROM q), c AS (SELECT word, count(*) AS n, CAST(sum(long) AS BIGINT) AS hits FROM k GROUP BY 1 HAVING count(*) >= 10 AND sum(long) >= 4)
SELECT word, n, hits, {rounded('(hits / n) / (longs / pairs)')} AS lift, {rounded('hits / pairs * log2((hits / n) / (longs / pairs))')} AS bits FROM c, b WHERE {rounded('(hits / n) / (longs / pairs)')} >= 1.1""",
    "resonance_cells": f"""WITH {_PAIRS}, c AS (SELECT category, reply, count(*) AS n, count(*) FILTER (reply_ts - ts <= 3600) AS fast FROM replies GROUP BY 1, 2), l AS (SELECT *, n * sum(n) OVER () / (sum(n) OVER (PARTITION BY category) * sum(n) OVER (PARTITION BY reply)) AS lift FROM c)
SELECT category, reply, n, {rounded('lift')} AS lift, {rounded('fast / n')} AS fast_rate FROM l WHERE n >= 12 AND {rounded('lift')} >= 1.05""",
    "bids_by_type": f"WITH {_NEXT} SELECT category, is_from_me, count(*) AS n, count(*) FILTER (wait <= 3600) AS in_1h, count(*) FILTER (wait <= 21600) AS in_6h, count(*) FILTER (wait IS NULL OR wait >= 86400) AS hanging, {rounded('count(*) FILTER (wait <= 21600) / count(*)')} AS rate FROM waits GROUP BY 1, 2",
    "question_shapes": f"""WITH {TEXT_MESSAGES}, f AS (SELECT is_from_me, text, {ASCII_TOKENS}[1] AS w FROM text_messages) SELECT is_from_me, CASE WHEN w IN ('how', 'what', 'when', 'where', 'why', 'who', 'will') THEN w WHEN w IN ('can', 'could') THEN 'can_could'
 WHEN w IN ('would', 'should') THEN 'would_should' WHEN w IN ('do', 'does', 'did') THEN 'do_did' WHEN w IN ('are', 'is') THEN 'are_is' ELSE 'other' END AS shape, count(*) AS n FROM f WHERE contains(text, '?') OR w IN ({", ".join(f"'{w}'" for w in QUESTION_WORDS)}) GROUP BY 1, 2""",
    "open_loops": f"""WITH {_LOOPS}, s AS (SELECT *, least(1.0, reply_words / 100) AS score FROM loops) SELECT category, CASE WHEN reply_s IS NULL THEN 'open' WHEN follow_ups > 0 AND (reply_s > 21600 OR score < 0.75) THEN 'reopened' WHEN reply_s <= 21600 AND score >= 0.55 THEN 'closed'
 WHEN score >= 0.75 THEN 'closed' ELSE 'delayed' END AS status, count(*) AS n, CAST(sum(follow_ups) AS BIGINT) AS follow_ups FROM s GROUP BY 1, 2""",
    "loop_debt": f"""WITH {_LOOPS} SELECT chat_id, count(*) AS n, {rounded('2.0 * count(*) FILTER (reply_s IS NULL) + 1.5 * count(*) FILTER (reply_s IS NOT NULL AND follow_ups > 0) + count(*) FILTER (reply_s > 21600 AND follow_ups = 0) + 0.35 * greatest(count(*) - 4, 0)')} AS debt FROM loops GROUP BY 1""",
    "ignition_attempts": f"""WITH {_NEXT}, g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY chat_id ORDER BY ts, id) AS gap FROM waits), c AS (SELECT a.chat_id, a.id, a.gap, CASE WHEN a.wait <= 86400 THEN a.wait END AS reply_s, count(*) FILTER (b.ts <= a.ts + 14400) AS m4,
 count(*) FILTER (b.ts <= a.ts + 14400 AND b.is_from_me <> a.is_from_me) AS o4, count(*) AS m24 FROM g a JOIN x b ON a.chat_id = b.chat_id AND b.ts BETWEEN a.ts AND a.ts + 86400 WHERE a.gap >= 21600 GROUP BY ALL)
SELECT *, CASE WHEN reply_s IS NOT NULL AND ((reply_s <= 7200 AND m4 >= 8 AND o4 >= 2) OR m24 >= 20 OR (m4 >= 16 AND o4 >= 4)) THEN 1 ELSE 0 END AS ignited FROM c""",
    "repair_recovery": f"""WITH {MESSAGES}, e0 AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY chat_id ORDER BY ts, id) > 7200 THEN 1 ELSE 0 END AS cut FROM messages WHERE category = 'error'),
e1 AS (SELECT *, sum(cut) OVER (PARTITION BY chat_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS episode FROM e0), ep AS (SELECT chat_id, episode, min(ts) AS start_ts, max(ts) AS end_ts FROM e1 GROUP BY 1, 2),
u AS (SELECT *, least(end_ts + 86400, coalesce(lead(start_ts) OVER (PARTITION BY chat_id ORDER BY start_ts), end_ts + 86400)) AS until FROM ep),
j AS (SELECT u.chat_id, u.episode, arg_min(m.ts, (m.ts, m.id)) AS rts, arg_min(m.category, (m.ts, m.id)) AS kind FROM u JOIN messages m ON m.chat_id = u.chat_id AND m.ts > u.end_ts AND m.ts <= u.until AND m.category IN ('purchase', 'view', 'click') GROUP BY 1, 2)
SELECT u.chat_id, u.end_ts, j.rts - u.end_ts AS recovery_s, j.kind FROM u LEFT JOIN j ON u.chat_id = j.chat_id AND u.episode = j.episode""",
    "support_rate": f"""WITH {MESSAGES}, n AS (SELECT a.id, arg_min(b.ts, (b.ts, b.id)) AS ots, arg_min(b.category, (b.ts, b.id)) AS ocat FROM messages a JOIN messages b ON a.chat_id = b.chat_id AND a.is_from_me <> b.is_from_me AND (b.ts > a.ts OR (b.ts = a.ts AND b.id > a.id)) WHERE a.category = 'error' GROUP BY 1),
h AS (SELECT m.chat_id, CASE WHEN n.ots - m.ts <= 21600 THEN CASE WHEN n.ocat IN ('purchase', 'click') THEN 1 ELSE 0 END END AS hit FROM messages m LEFT JOIN n USING (id) WHERE m.category = 'error') SELECT chat_id, count(*) AS n, count(hit) AS answered, {rounded('avg(hit)')} AS rate FROM h GROUP BY 1""",
    "gesture_draws": f"""WITH {MESSAGES}, r AS (SELECT DISTINCT reply_to_id AS id FROM messages WHERE amt >= 2000 AND amt < 3000 AND reply_to_id IS NOT NULL), c AS (SELECT category, count(*) AS n, count(r.id) AS hits FROM messages m LEFT JOIN r ON m.id = r.id WHERE {_VISIBLE} GROUP BY 1),
t AS (SELECT sum(n) AS nn, sum(hits) AS hh FROM c), z AS (SELECT *, hits + 1.5 AS a, n - hits + 1.5 AS b, hh - hits + 1.5 AS e, nn - hh - (n - hits) + 1.5 AS f FROM c, t)
SELECT category, n, hits, {rounded('hits / n')} AS rate, {rounded('(ln(a / b) - ln(e / f)) / sqrt(1 / a + 1 / b + 1 / e + 1 / f)', 4)} AS z FROM z""",
    "object_channel": f"WITH {MESSAGES} SELECT CAST(floor(ts / 86400) AS BIGINT) AS day, is_from_me, count(*) AS n, count(DISTINCT category) AS kinds FROM messages WHERE has_attachment = 1 GROUP BY 1, 2",
    "score_episodes": f"""WITH {MESSAGES}, s0 AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY chat_id ORDER BY ts, id) > 21600 THEN 1 ELSE 0 END AS cut FROM messages WHERE value >= 60),
s1 AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY chat_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM s0), s2 AS (SELECT *, CASE WHEN lag(is_from_me) OVER w <> is_from_me THEN 1 ELSE 0 END AS switch FROM s1 WINDOW w AS (PARTITION BY chat_id, session ORDER BY ts, id)),
s3 AS (SELECT *, sum(1 - switch) OVER (PARTITION BY chat_id, session ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS run FROM s2), a AS (SELECT chat_id, session, max(k) AS alternating FROM (SELECT chat_id, session, run, count(*) AS k FROM s3 GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT chat_id, session, count(*) AS n, CAST(sum(switch) AS BIGINT) AS switches, min(ts) AS start_ts, max(ts) AS end_ts, any_value(alternating) AS alternating FROM s3 JOIN a USING (chat_id, session) GROUP BY 1, 2""",
    "score_context": f"WITH {MESSAGES} SELECT a.id, a.chat_id, count(*) AS around FROM messages a JOIN messages b ON a.chat_id = b.chat_id AND b.ts BETWEEN a.ts - 1200 AND a.ts + 1200 WHERE a.value >= 60 GROUP BY 1, 2",
    "weekly_rates": f"WITH {MESSAGES} SELECT chat_id, strftime(date_trunc('week', {LOCAL}), '%Y-%m-%d') AS week, count(*) AS n, {rounded('avg(is_from_me)')} AS me, " + ", ".join(f"{rounded(f'''count(*) FILTER (category = '{k}') / count(*)''')} AS {k}" for k in ("click", "view", "purchase", "signup")) + f" FROM messages WHERE {_VISIBLE} GROUP BY 1, 2 HAVING count(*) >= 12",
    "insight_shift": f"WITH {MESSAGES}, v AS (SELECT * FROM messages WHERE {_VISIBLE}), a AS (SELECT chat_id, floor(((SELECT max(ts) FROM v) - ts) / 864000) AS age FROM v), c AS (SELECT chat_id, count(*) FILTER (age = 0) AS recent, count(*) FILTER (age = 1) AS before FROM a GROUP BY 1) SELECT *, {rounded('(recent - before) / greatest(before, 1)')} AS change FROM c",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
