"""Segmentation, scoring of segments, greedy selections, discovery of candidates, decoding of raw columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorale.functions import text
from chorale.functions.stats import js_round
from chorale.operators import greedy, segmentation, sequence
from chorale.plans import series
from chorale.plans.dialect import ASCII_TOKENS, CORPUS, MESSAGES, SEGMENTS, rounded
from chorale.sources import decoding
from chorale.sources.tables import corpus, links, messages, segments, table


def temporal_segments(spark: SparkSession, d: str) -> DataFrame:
    s = segmentation.temporal(messages(spark, d))
    return s.groupBy("chat_id", "segment").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n"))


def capsule_scores(spark: SparkSession, d: str) -> DataFrame:
    """What makes a segment worth keeping: length, novelty, balance, confidence, rarity of its category."""
    w = Window.partitionBy("chat_id").orderBy("start_ts", "segment_id").rowsBetween(-40, -1)
    s = segments(spark, d).filter("n_msgs >= 2").withColumns({"mx": F.avg("x").over(w), "my": F.avg("y").over(w), "length": F.log1p("n_msgs")})
    s = s.withColumn("novelty", F.coalesce(F.sqrt(F.pow(F.col("x") - F.col("mx"), 2) + F.pow(F.col("y") - F.col("my"), 2)), F.lit(0.15)))
    counts = s.groupBy("category").agg(F.count("*").alias("kin"))
    tops = s.agg(F.greatest(F.max("length"), F.lit(1.0)).alias("top_length"), F.greatest(F.max("novelty"), F.lit(1.0)).alias("top_novelty"), F.log1p(F.count("*")).alias("all_log"))
    j = s.join(F.broadcast(counts), "category").join(F.broadcast(tops))
    balance = F.least("n_me", "n_them") / F.col("n_msgs")
    score = 0.34 * F.col("length") / F.col("top_length") + 0.24 * F.col("novelty") / F.col("top_novelty") + 0.18 * balance + 0.14 * 0.5 + 0.1 * (1 - F.log1p("kin") / F.col("all_log")) + 0.06
    return j.select("segment_id", "chat_id", "category", "topic_id", js_round(score).alias("score"))


def capsules_diverse(spark: SparkSession, d: str) -> DataFrame:
    """Eighteen capsules of the best 420, each less alike to those before."""

    def pick(t: pd.DataFrame) -> pd.DataFrame:
        rows = t.sort_values(["score", "segment_id"], ascending=[False, True]).to_dict("records")
        alike = lambda a, b: 0.35 * (a["category"] == b["category"]) + 0.35 * (a["topic_id"] == b["topic_id"])
        taken = greedy.diverse(rows, lambda r: r["score"], alike, 0.32, 18)
        return pd.DataFrame([(i + 1, r["segment_id"], r["score"]) for i, r in enumerate(taken)], columns=["rank", "segment_id", "score"])

    pool = capsule_scores(spark, d).orderBy(F.desc("score"), "segment_id").limit(420)
    return pool.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(pick, "rank long, segment_id long, score double")


def topic_communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the topics' graph, which has one node per topic whatever the log's size. Topics without an edge have a label
    of their own."""

    def label(edges: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        own = list(nodes[["topic_id", "n", "category"]].itertuples(index=False, name=None))
        found = segmentation.communities(own, list(edges[["a", "b", "w"]].itertuples(index=False, name=None)))
        return pd.DataFrame(sorted(found.items()), columns=["topic_id", "community"])

    s = segments(spark, d)
    by = Window.partitionBy("topic_id").orderBy(F.desc("k"), "category")
    kinds = s.groupBy("topic_id", "category").agg(F.count("*").alias("k")).withColumns({"n": F.sum("k").over(Window.partitionBy("topic_id")), "at": F.row_number().over(by)})
    nodes = kinds.filter("at = 1").select(F.lit(1).alias("_one"), F.col("topic_id").cast("long").alias("topic_id"), "n", "category")
    e = links(s).filter("from_topic != to_topic").groupBy(F.col("from_topic").cast("long").alias("a"), F.col("to_topic").cast("long").alias("b")).agg(F.count("*").alias("w"))
    both = e.withColumn("_one", F.lit(1)).groupBy("_one").cogroup(nodes.groupBy("_one"))
    return both.applyInPandas(label, "topic_id long, community long")


#: For a log whose messages are minutes apart; `threads` has the defaults for chats.
THREAD_LEAST, THREAD_TAU = 30, 7200.0


def conversation_threads(spark: SparkSession, d: str) -> DataFrame:
    """Threads inside long segments, one task per segment: it holds the segment's vectors and 25 links a message at most."""

    def parted(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["ts", "id"])
        vectors = np.stack(t["embedding"].to_numpy()).astype(float)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        found = segmentation.threads(t["id"].to_numpy(), t["ts"].to_numpy(), vectors, t["reply_to_id"].fillna(-1).to_numpy(), tau=THREAD_TAU)
        chat, episode = t["chat_id"].iloc[0], t["episode"].iloc[0]
        return pd.DataFrame([(chat, episode, i, len(x), x) for i, x in enumerate(found)], columns=["chat_id", "episode", "thread", "n_msgs", "msg_ids"])

    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    e = sequence.episodes(messages(spark, d), gap=86400).join(F.broadcast(v.agg(F.count("*").alias("vectors"))))
    sized = e.withColumn("n", F.count("*").over(Window.partitionBy("chat_id", "episode"))).filter(F.col("n") >= THREAD_LEAST)
    m = sized.join(v, F.col("id") % F.col("vectors") == F.col("vec_id")).select("chat_id", "episode", "id", "ts", "reply_to_id", "embedding")
    return m.groupBy("chat_id", "episode").applyInPandas(parted, "chat_id int, episode long, thread int, n_msgs long, msg_ids array<long>")


def lifecycles(spark: SparkSession, d: str) -> DataFrame:
    """A topic of a chat by the shape of its days; the first rule that holds."""
    s = segments(spark, d).withColumn("day", F.floor(F.col("start_ts") / 86400).cast("bigint"))
    per = s.groupBy("chat_id", "topic_id", "day").agg(F.count("*").alias("n"))
    gap = F.col("day") - F.lag("day").over(Window.partitionBy("chat_id", "topic_id").orderBy("day"))
    t = per.withColumn("gap", gap).groupBy("chat_id", "topic_id").agg(F.sum("n").alias("segments"), F.count("*").alias("days"), F.max("n").alias("peak"), F.min("day").alias("first"), F.max("day").alias("last"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest"))
    t = t.join(F.broadcast(s.agg(F.max("day").alias("edge"))))
    span = F.col("last") - F.col("first") + 1
    kind = F.when((F.col("edge") - F.col("last") >= 10) & (F.col("days") >= 2), "faded").when((F.col("edge") - F.col("first") <= 9) & (F.col("segments") >= 2), "newcomer")
    kind = kind.when((F.col("days") <= 2) & (F.col("segments") >= 3) & (F.col("peak") >= F.greatest(F.lit(2.0), F.col("segments") * 0.35)), "comet")
    kind = kind.when((F.col("longest") >= 8), "resurrected").when((span >= 14) & (F.col("days") / span >= 0.28), "evergreen").otherwise("other")
    return t.select("chat_id", "topic_id", "segments", "days", "peak", "longest", kind.alias("archetype"))


def recurrence_diagonals(spark: SparkSession, d: str) -> DataFrame:
    """Runs of two or more recurring pairs that advance together."""
    p = series.day_recurrence(spark, d).withColumn("diagonal", F.col("j") - F.col("i"))
    w = Window.partitionBy("diagonal").orderBy("i")
    r = p.withColumn("run", F.col("i") - F.row_number().over(w))
    return r.groupBy("diagonal", "run").agg(F.min("i").alias("start"), F.count("*").alias("length")).filter("length >= 2").select("diagonal", "start", "length")


def forecast_labels(spark: SparkSession, d: str) -> DataFrame:
    """Whether the two days after are quiet, busy or a surge, by thresholds from the first 72 % of days alone."""
    f = series.rolling_frames(spark, d)
    days = f.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    f = f.join(F.broadcast(days)).withColumn("train", F.col("day") <= F.col("a") + F.floor((F.col("b") - F.col("a")) * 0.72)).drop("a", "b")
    ratio = (F.col("future") + 10) / (F.col("past") + 10)
    t = f.filter("train").agg(F.percentile("future", 0.24).alias("quiet_at"), F.percentile("future", 0.78).alias("busy_at"), F.percentile(ratio, 0.78).alias("surge_at"))
    j = f.join(F.broadcast(t))
    return j.select("chat_id", "day", "train", (F.col("future") <= F.col("quiet_at")).alias("quiet"), (F.col("future") >= F.col("busy_at")).alias("busy"), (js_round(ratio) >= js_round(F.col("surge_at"))).alias("surge"))


def sliding_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within 25 places of each other in a segment, by an equi-join on the segment and a place, not a range."""
    w = Window.partitionBy("chat_id", "episode").orderBy("ts", "id")
    e = sequence.episodes(messages(spark, d)).select("chat_id", "episode", "id", "ts", "category", F.row_number().over(w).alias("at"))
    left = e.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(25)))).withColumn("to", F.col("at") + F.col("step"))
    right = e.select("chat_id", "episode", F.col("at").alias("to"), F.col("ts").alias("ts2"), F.col("category").alias("category2"))
    j = left.join(right, ["chat_id", "episode", "to"])
    return j.groupBy("category", "category2", "step").agg(F.count("*").alias("n"), js_round(F.sum(F.col("ts2") - F.col("ts")) / F.count("*")).alias("mean_gap"))


def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth message of a chat, as a plot takes them (the sampling is the operator)."""
    w = Window.partitionBy("chat_id").orderBy("ts", "id")
    return messages(spark, d).withColumn("at", F.row_number().over(w) - 1).filter("at % 20 = 0").select("chat_id", "id", "at")


def excerpt_positions(spark: SparkSession, d: str) -> DataFrame:
    """Of each segment the first two, those at a third and two thirds, and the last two messages."""
    by = Window.partitionBy("chat_id", "episode")
    e = sequence.episodes(messages(spark, d)).withColumns({"at": F.row_number().over(by.orderBy("ts", "id")) - 1, "n": F.count("*").over(by)})
    wanted = F.array(F.lit(0), F.lit(1), F.floor(F.col("n") * 0.34), F.floor(F.col("n") * 0.66), F.col("n") - 2, F.col("n") - 1)
    return e.filter(F.array_contains(wanted, F.col("at").cast("bigint"))).select("chat_id", "episode", "id", "at")


def candidate_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Threads worth a look: customers joined to their nation and orders, at least ten of them, merged by nation and segment."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")).filter("n >= 10")
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    j = o.join(c, "c_custkey")
    return j.groupBy("n_name", "c_mktsegment").agg(F.sum("n").alias("orders"), F.countDistinct("c_custkey").alias("customers"), F.date_format(F.min("a"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("b"), "yyyy-MM-dd").alias("last_day"))


#: A term's category and weight. The terms are frequent words of the corpus.
LEXICON = (("the", "plain", 0.4), ("that", "plain", 0.6), ("with", "link", 1.0), ("and", "link", 0.5), ("und", "link", 0.5), ("der", "article", 0.7), ("les", "article", 0.7), ("que", "relative", 0.8), ("por", "cause", 1.2), ("pour", "cause", 1.2))


def category_scores(spark: SparkSession, d: str) -> DataFrame:
    """A text's category by weighted terms, each counted three times at most; ambiguous where the margin is small."""
    lexicon = spark.createDataFrame(LEXICON, "word string, kind string, weight double")
    w = corpus(spark, d).select("id", F.explode(text.ascii_tokens(F.col("text"))).alias("word")).join(F.broadcast(lexicon), "word")
    c = w.groupBy("id", "kind", "word").agg(F.least(F.count("*"), F.lit(3)).alias("n"), F.first("weight").alias("weight"))
    s = c.groupBy("id", "kind").agg(js_round(F.sum(F.col("n") * F.col("weight"))).alias("score"))
    by = Window.partitionBy("id").orderBy(F.desc("score"), "kind")
    r = s.withColumns({"at": F.row_number().over(by), "second": F.coalesce(F.lead("score").over(by), F.lit(0.0)), "other": F.lead("kind").over(by)}).filter("at = 1")
    margin = F.col("score") - F.col("second")
    confidence = F.least(F.lit(0.97), 0.45 + 0.42 * margin / F.greatest(F.col("score"), F.lit(1.0)) + 0.12 * F.tanh(F.col("score") / 8))
    status = F.when(F.col("score") < 1, "weak").when(margin < 0.1, "ambiguous").otherwise("classified")
    return r.select("id", "kind", "score", F.col("other").alias("secondary"), js_round(confidence).alias("confidence"), status.alias("status"))


def store_projection(spark: SparkSession, d: str) -> DataFrame:
    """Raw store columns made from events and read back: nanosecond dates, guids with prefixes, MIME flags, handles."""
    e = messages(spark, d)
    raw = e.select("id", "ts", F.when(F.col("id") % 2 == 0, (F.col("ts") - 978307200) * 1000000000).otherwise(F.col("ts") - 978307200).alias("date"), F.concat(F.when(F.col("id") % 3 == 0, "p:1/").when(F.col("id") % 3 == 1, "bp:").otherwise(""), F.col("id").cast("string")).alias("guid"), F.when(F.col("k") % 3 == 0, "image/png").when(F.col("k") % 3 == 1, "VIDEO/mp4").alias("mime"))
    f = decoding.media_flags(F.col("mime"))
    return raw.select("id", decoding.unix_seconds(F.col("date")).alias("ts"), decoding.bare_guid(F.col("guid")).alias("guid"), f["is_image"].alias("is_image"), f["is_video"].alias("is_video"), decoding.handle_key(F.concat(F.lit("+1 (604) 555-"), F.lpad((F.col("id") % 10000).cast("string"), 4, "0"))).alias("handle"))


_EP = f"""{MESSAGES}, e0 AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY chat_id ORDER BY ts, id) > 7200 THEN 1 ELSE 0 END AS cut FROM messages),
ep AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY chat_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM e0)"""
_FRAMES = series.ORACLE_SQL["rolling_frames"].replace("SELECT * FROM f WHERE past >= 8", "")
_LEXICON = ", ".join(f"('{w}', '{k}', {x})" for w, k, x in LEXICON)

ORACLE_SQL = {
    "temporal_segments": f"""WITH {MESSAGES}, g AS (SELECT chat_id, id, ts, ts - lag(ts) OVER (PARTITION BY chat_id ORDER BY ts, id) AS gap FROM messages),
u AS (SELECT *, coalesce(median(CASE WHEN gap > 0 THEN gap END) OVER (PARTITION BY chat_id ORDER BY ts, id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), 600) AS usual FROM g),
c AS (SELECT *, CASE WHEN gap > greatest(43200, 5 * usual) THEN 1 ELSE 0 END AS cut FROM u), s AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY chat_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM c)
SELECT chat_id, segment, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n FROM s GROUP BY 1, 2""",
    "capsule_scores": f"""WITH {SEGMENTS}, s AS (SELECT *, ln(1 + n_msgs) AS length, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM segments WHERE n_msgs >= 2 WINDOW w AS (PARTITION BY chat_id ORDER BY start_ts, segment_id ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, coalesce(sqrt(pow(x - mx, 2) + pow(y - my, 2)), 0.15) AS novelty, count(*) OVER (PARTITION BY category) AS kin, count(*) OVER () AS n_all, greatest(max(length) OVER (), 1) AS top_length FROM s), t AS (SELECT *, greatest(max(novelty) OVER (), 1) AS top_novelty FROM n)
SELECT segment_id, chat_id, category, topic_id, {rounded('0.34 * length / top_length + 0.24 * novelty / top_novelty + 0.18 * least(n_me, n_them) / n_msgs + 0.07 + 0.1 * (1 - ln(1 + kin) / ln(1 + n_all)) + 0.06')} AS score FROM t""",
    "lifecycles": f"""WITH {SEGMENTS}, p AS (SELECT chat_id, topic_id, CAST(floor(start_ts / 86400) AS BIGINT) AS day, count(*) AS n FROM segments GROUP BY 1, 2, 3), g AS (SELECT *, day - lag(day) OVER (PARTITION BY chat_id, topic_id ORDER BY day) AS gap FROM p),
t AS (SELECT chat_id, topic_id, CAST(sum(n) AS BIGINT) AS segments, count(*) AS days, max(n) AS peak, min(day) AS a, max(day) AS b, coalesce(max(gap), 0) AS longest, (SELECT max(day) FROM p) AS edge FROM g GROUP BY 1, 2)
SELECT chat_id, topic_id, segments, days, peak, longest, CASE WHEN edge - b >= 10 AND days >= 2 THEN 'faded' WHEN edge - a <= 9 AND segments >= 2 THEN 'newcomer' WHEN days <= 2 AND segments >= 3 AND peak >= greatest(2, segments * 0.35) THEN 'comet'
 WHEN longest >= 8 THEN 'resurrected' WHEN b - a + 1 >= 14 AND days / (b - a + 1) >= 0.28 THEN 'evergreen' ELSE 'other' END AS archetype FROM t""",
    "recurrence_diagonals": f"WITH p AS ({series.ORACLE_SQL['day_recurrence']}), r AS (SELECT j - i AS diagonal, i, i - row_number() OVER (PARTITION BY j - i ORDER BY i) AS run FROM p) SELECT diagonal, min(i) AS start, count(*) AS length FROM r GROUP BY diagonal, run HAVING count(*) >= 2",
    "forecast_labels": f"""{_FRAMES}, f8 AS (SELECT * FROM f WHERE past >= 8), b AS (SELECT min(day) AS a, max(day) AS z FROM f8), g AS (SELECT f8.*, day <= a + floor((z - a) * 0.72) AS train, (future + 10) / (past + 10) AS ratio FROM f8, b),
t AS (SELECT quantile_cont(future, 0.24) AS q, quantile_cont(future, 0.78) AS u, quantile_cont(ratio, 0.78) AS s FROM g WHERE train) SELECT chat_id, day, train, future <= q AS quiet, future >= u AS busy, {rounded('ratio')} >= {rounded('s')} AS surge FROM g, t""",
    "sliding_neighbours": f"""WITH {_EP}, r AS (SELECT *, row_number() OVER (PARTITION BY chat_id, episode ORDER BY ts, id) AS place FROM ep)
SELECT a.category, b.category AS category2, CAST(b.place - a.place AS INT) AS step, count(*) AS n, {rounded('sum(b.ts - a.ts) / count(*)')} AS mean_gap FROM r a JOIN r b ON a.chat_id = b.chat_id AND a.episode = b.episode AND b.place BETWEEN a.place + 1 AND a.place + 25 GROUP BY 1, 2, 3""",
    "stride_sample": f"WITH {MESSAGES}, r AS (SELECT chat_id, id, CAST(row_number() OVER (PARTITION BY chat_id ORDER BY ts, id) - 1 AS INT) AS at FROM messages) SELECT * FROM r WHERE at % 20 = 0".replace(" AS at FROM", ' AS "at" FROM').replace("WHERE at %", 'WHERE "at" %'),
    "excerpt_positions": f"""WITH {_EP}, r AS (SELECT chat_id, episode, id, CAST(row_number() OVER (PARTITION BY chat_id, episode ORDER BY ts, id) - 1 AS INT) AS "at", count(*) OVER (PARTITION BY chat_id, episode) AS n FROM ep)
SELECT chat_id, episode, id, "at" FROM r WHERE "at" IN (0, 1, floor(n * 0.34), floor(n * 0.66), n - 2, n - 1)""",
    "candidate_discovery": """WITH o AS (SELECT o_custkey, count(*) AS n, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1 HAVING count(*) >= 10)
SELECT n_name, c_mktsegment, CAST(sum(n) AS BIGINT) AS orders, count(DISTINCT c_custkey) AS customers, strftime(min(a), '%Y-%m-%d') AS first_day, strftime(max(b), '%Y-%m-%d') AS last_day FROM o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
    "category_scores": f"""WITH {CORPUS}, k AS (SELECT id, unnest({ASCII_TOKENS}) AS word FROM corpus), lx(word, kind, weight) AS (VALUES {_LEXICON}), c AS (SELECT id, kind, word, least(count(*), 3) AS n, any_value(weight) AS weight FROM k JOIN lx USING (word) GROUP BY 1, 2, 3),
s AS (SELECT id, kind, {rounded('sum(n * CAST(weight AS DOUBLE))')} AS score FROM c GROUP BY 1, 2), r AS (SELECT id, kind, score, row_number() OVER w AS pos, coalesce(lead(score) OVER w, 0) AS second, lead(kind) OVER w AS secondary FROM s WINDOW w AS (PARTITION BY id ORDER BY score DESC, kind))
SELECT id, kind, score, secondary, {rounded('least(0.97, 0.45 + 0.42 * (score - second) / greatest(score, 1.0) + 0.12 * tanh(score / 8))')} AS confidence, CASE WHEN score < 1 THEN 'weak' WHEN score - second < 0.1 THEN 'ambiguous' ELSE 'classified' END AS status FROM r WHERE pos = 1""",
    "store_projection": f"WITH {MESSAGES} SELECT id, ts, CAST(id AS VARCHAR) AS guid, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS is_image, CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END AS is_video, '604555' || lpad(CAST(id % 10000 AS VARCHAR), 4, '0') AS handle FROM messages",
}
#: One capsule a step: by score less the greatest likeness to those taken, the first of equals.
ORACLE_SQL["capsules_diverse"] = f"""WITH RECURSIVE scored AS ({ORACLE_SQL['capsule_scores']}),
pool AS (SELECT *, row_number() OVER (ORDER BY score DESC, segment_id) AS place FROM scored QUALIFY place <= 420),
steps AS (SELECT 0 AS step, [0]::BIGINT[] AS taken, CAST(0 AS BIGINT) AS place
  UNION ALL SELECT step + 1, list_append(taken, best), best FROM (SELECT step, taken, (SELECT p.place FROM pool p WHERE NOT list_contains(taken, p.place)
    ORDER BY p.score - 0.32::DOUBLE * coalesce((SELECT max(0.35::DOUBLE * CAST(q.category = p.category AS INT) + 0.35::DOUBLE * CAST(q.topic_id = p.topic_id AS INT)) FROM pool q WHERE list_contains(taken, q.place)), 0) DESC, p.place LIMIT 1) AS best
    FROM steps WHERE step < 18) WHERE best IS NOT NULL)
SELECT CAST(step AS BIGINT) AS rank, segment_id, score FROM steps JOIN pool USING (place)"""
QUERIES = {name: globals()[name] for name in [*ORACLE_SQL, "topic_communities", "conversation_threads"]}
