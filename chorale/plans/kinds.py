"""Kinds of texts by ladders, what answers them, and the scores and reports that are built on such counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorale.functions import ladders
from chorale.functions import text as texts
from chorale.functions.scope import kind_filter
from chorale.functions.stats import js_round
from chorale.functions.timeutil import ym
from chorale.operators import sequence
from chorale.plans import series
from chorale.plans.dialect import LOCAL, MESSAGES, SEGMENTS, bounded, rounded
from chorale.sources.tables import PHRASES, messages, phrased, segments

#: Kinds of words that are counted with their phrases.
COUNTED = {kind: (words, tuple(p for p in phrases if p.replace(" ", "").isalpha())) for kind, (words, phrases) in texts.LEXICONS.items()}
EXCLUDED, SENSITIVE, LEAST_MESSAGES = "purchase", "error", 2
#: Days are windows with an event where a chat has this many times its mean of messages.
SURGE = 1.25
#: How often a rate's cap may fall to, and the share of chats' weeks under it.
CAP_FLOOR, CAP_SHARE = 0.03, 0.9


def _visible(spark: SparkSession, d: str) -> DataFrame:
    return phrased(spark, d).filter(kind_filter("visible_message"))


def _attached() -> Column:
    return F.col("has_attachment") == 1


def bid_types(spark: SparkSession, d: str) -> DataFrame:
    """Bids by type and sender, a text counting for every type that it is, and how soon the other side writes."""
    m = sequence.next_other(_visible(spark, d)).withColumn("wait", F.col("other_ts") - F.col("ts"))
    b = m.select("is_from_me", "wait", F.explode(ladders.kinds_of(ladders.BIDS, F.col("text"), _attached())).alias("bid"))
    return b.groupBy("bid", "is_from_me").agg(F.count("*").alias("n"), F.count_if(F.col("wait") <= 3600).alias("in_1h"), F.count_if(F.col("wait") <= 21600).alias("in_6h"), F.count_if(F.col("wait").isNull() | (F.col("wait") >= 86400)).alias("hanging"))


def question_shapes(spark: SparkSession, d: str) -> DataFrame:
    """My questions by shape: both sides are read for the answers, and the sender is chosen after."""
    m = sequence.next_other(_visible(spark, d)).filter("is_from_me = 1")
    q = m.filter(ladders.is_kind(ladders.BIDS[0], F.col("text"), _attached())).withColumn("shape", ladders.question_shape(F.col("text")))
    return q.groupBy("shape").agg(F.count("*").alias("n"), F.count_if(F.col("other_ts") - F.col("ts") <= 21600).alias("in_6h"))


def opener_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What is said after a silence."""
    r = sequence.restarts(_visible(spark, d))
    kind = F.coalesce(ladders.first_kind(ladders.OPENERS, F.col("text"), _attached()), F.lit("ambient"))
    return r.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("is_from_me").alias("me"), F.max("gap").alias("longest"))


def loop_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What messages leave open, and which the other side takes up within two days."""
    m = sequence.next_other(_visible(spark, d)).withColumn("kind", ladders.first_kind(ladders.LOOPS, F.col("text"), _attached())).filter("kind is not null")
    wait = F.col("other_ts") - F.col("ts")
    return m.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(wait <= 172800).alias("taken_up"), F.sum(F.when(wait <= 172800, wait)).alias("wait_s"))


def ritual_patterns(spark: SparkSession, d: str) -> DataFrame:
    m = _visible(spark, d).select("is_from_me", "ts", F.explode(ladders.kinds_of(ladders.RITUALS, F.col("text"), F.lit(False))).alias("ritual"))
    day = F.floor(F.col("ts") / 86400)
    return m.groupBy("ritual").agg(F.count("*").alias("n"), F.sum("is_from_me").alias("me"), F.count_distinct(day).alias("days"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def word_phrase_hits(spark: SparkSession, d: str) -> DataFrame:
    """Weekly hits of word lists, a phrase counting twice."""
    m = _visible(spark, d).withColumn("week", F.floor(F.col("ts") / 604800))
    return m.groupBy("chat_id", "week").agg(F.count("*").alias("n"), *[F.sum(ladders.hits(F.col("text"), *lists)).alias(kind) for kind, lists in COUNTED.items()])


def capped_rates(spark: SparkSession, d: str) -> DataFrame:
    """The log's weekly rates of hits as shares of the rate that nine weeks in ten don't exceed; there are as many rows as weeks."""
    w = word_phrase_hits(spark, d).groupBy("week").agg(*[F.sum(c).alias(c) for c in ("n", *COUNTED)])
    caps = w.agg(*[F.greatest(F.expr(f"element_at(array_sort(collect_list({k} / n)), cast(floor((count(1) - 1) * {CAP_SHARE}) as int) + 1)"), F.lit(CAP_FLOOR)).alias(f"{k}_cap") for k in COUNTED])
    share = lambda k: js_round(F.least(F.greatest(F.col(k) / F.col("n") / F.col(f"{k}_cap"), F.lit(0.0)), F.lit(1.0)))
    return w.join(F.broadcast(caps)).select("week", *[share(k).alias(k) for k in COUNTED])


def lexicon_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Messages by the lexicons that they match, negations and apologies for logistics seen to; one of several counts for each."""
    kinds = F.array_compact(F.array(*[F.when(texts.lexicon_match(F.col("text"), kind), kind) for kind in texts.LEXICONS]))
    m = _visible(spark, d).filter("text is not null").select("is_from_me", F.explode(kinds).alias("kind"))
    return m.groupBy("kind", "is_from_me").agg(F.count("*").alias("n"))


def emoji_top(spark: SparkSession, d: str) -> DataFrame:
    e = _visible(spark, d).select(F.explode(ladders.emoji(F.col("text"))).alias("emoji"))
    return e.groupBy("emoji").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "emoji").limit(30)


def text_hygiene(spark: SparkSession, d: str) -> DataFrame:
    bare = ladders.without_links(F.col("text"))
    return _visible(spark, d).filter("text is not null").groupBy(bare.alias("bare"), ladders.preview(F.col("text"), 20).alias("preview")).agg(F.count("*").alias("n"))


def window_odds(spark: SparkSession, d: str) -> DataFrame:
    """Words of a chat's days with a surge against those of its other days."""
    m = _visible(spark, d).withColumn("day", F.floor(F.col("ts") / 86400))
    days = m.groupBy("chat_id", "day").agg(F.count("*").alias("n"))
    days = days.withColumn("event", (F.col("n") >= SURGE * F.avg("n").over(Window.partitionBy("chat_id"))).cast("int")).select("chat_id", "day", "event")
    totals = days.agg(F.sum("event").alias("of_events"), F.sum(1 - F.col("event")).alias("of_neutral"))
    said = m.select("chat_id", "day", F.explode(F.array_distinct(texts.ascii_tokens(F.col("text")))).alias("word")).distinct()
    c = said.join(days, ["chat_id", "day"]).groupBy("word").agg(F.sum("event").alias("events"), F.sum(1 - F.col("event")).alias("neutral"))
    lift = ladders.window_lift(F.col("events"), F.col("of_events"), F.col("neutral"), F.col("of_neutral"))
    return c.join(F.broadcast(totals)).select("word", "events", "neutral", js_round(lift).alias("lift"), js_round(lift * F.sqrt("events")).alias("score"))


def smoothed_rates(spark: SparkSession, d: str) -> DataFrame:
    """A category's share of messages with attachments, drawn towards the log's by the weight of thirty messages."""
    c = messages(spark, d).groupBy("chat_id", "category").agg(F.count("*").alias("n"), F.sum("has_attachment").alias("part"))
    base = c.agg((F.sum("part") / F.sum("n")).alias("base"))
    return c.join(F.broadcast(base)).select("chat_id", "category", "n", js_round(ladders.smoothed_rate(F.col("part"), F.col("n"), F.col("base"))).alias("rate"), js_round(F.col("n") / (F.col("n") + 30)).alias("support"))


def method_confidence(spark: SparkSession, d: str) -> DataFrame:
    """How far each chat's difference in attachments from the log's may be trusted, for three kinds of method."""
    c = messages(spark, d).groupBy("chat_id", "category").agg(F.count("*").alias("n"), F.avg("has_attachment").alias("p"))
    base = messages(spark, d).agg(F.avg("has_attachment").alias("base"))
    half = 1.96 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    x = c.join(F.broadcast(base)).select("chat_id", "category", "n", (F.col("p") - F.col("base") - half).alias("low"), (F.col("p") - F.col("base") + half).alias("high"))
    x = x.withColumn("method", F.explode(F.array(F.lit("statistical"), F.lit("heuristic"), F.lit("speculative"))))
    return x.select("chat_id", "category", "method", ladders.confidence(F.col("method"), F.col("n"), F.col("low"), F.col("high"), F.lit(None).cast("double"), F.lit(0)).alias("confidence"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Segments with a status, and what is known of their topics: every fourth topic has no category, every third no label."""
    s = segments(spark, d).withColumn("status", F.when(F.col("n_msgs") < LEAST_MESSAGES, "uncertain").when(F.col("topic_id") != 5, "classified"))
    n = s.groupBy("topic_id", "category").agg(F.count("*").alias("_n"))
    topics = n.groupBy("topic_id").agg(F.min_by("category", F.struct(-F.col("_n"), "category")).alias("topic_category"), F.sum("_n").alias("n_segments"))
    cats = topics.filter("topic_id % 4 != 0").select("topic_id", "topic_category")
    names = topics.filter("topic_id % 3 != 0").select("topic_id", F.concat(F.lit("topic "), F.col("topic_id").cast("string")).alias("topic_label"))
    return s.join(F.broadcast(cats), "topic_id", "left").join(F.broadcast(names), "topic_id", "left")


def segment_labels(spark: SparkSession, d: str) -> DataFrame:
    """Each segment's label: its own category, its topic's, its topic's name. Topics of the excluded category go, those of none
    stay; the sensitive category goes."""
    s = _labelled(spark, d).filter(F.col("topic_category").isNull() | ~F.col("topic_category").isin(EXCLUDED))
    label = F.coalesce(F.when(F.col("status") == "classified", F.col("category")), "topic_category", "topic_label", F.lit("unlabeled"))
    return s.select("segment_id", "chat_id", "topic_id", "status", label.alias("label")).filter(F.col("label") != SENSITIVE)


def unclassified_segments(spark: SparkSession, d: str) -> DataFrame:
    """What has no category, or none that is settled: a null status is none."""
    s = _labelled(spark, d).filter(F.col("category").isNull() | ~F.col("status").eqNullSafe("classified"))
    return s.select("segment_id", "chat_id", "topic_id", "n_msgs", "status")


def message_labels(spark: SparkSession, d: str) -> DataFrame:
    """Messages by what their segment is labelled, those outside of any label counted too."""
    e = sequence.episodes(messages(spark, d)).select("id", "chat_id", "episode")
    s = _labelled(spark, d).filter("status = 'classified'").select("chat_id", "episode", "category", "topic_label")
    return e.join(s, ["chat_id", "episode"], "left").groupBy("category", "topic_label").agg(F.count("*").alias("n"))


def topic_positions(spark: SparkSession, d: str) -> DataFrame:
    """Topics with the mean place of those of their segments that have one; the condition is the join's, so all topics stay."""
    s = segments(spark, d)
    topics = s.groupBy("topic_id").agg(F.count("*").alias("n_segments"))
    placed = s.filter("n_msgs >= 3").groupBy("topic_id").agg(F.count("*").alias("n_placed"), js_round(F.sum("x") / F.count("*")).alias("x"), js_round(F.sum("y") / F.count("*")).alias("y"))
    return topics.join(placed, "topic_id", "left")


def chat_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Chats with the numbers of their messages and attachments; chats without attachments have 0."""
    m = messages(spark, d)
    n = m.groupBy("chat_id").agg(F.count("*").alias("n_messages"), F.count_distinct("category").alias("n_members"))
    a = m.filter("has_attachment = 1 and amt is null").groupBy("chat_id").agg(F.count("*").alias("n_attachments"))
    return n.join(a, "chat_id", "left").na.fill(0, ["n_attachments"])


def month_path(spark: SparkSession, d: str) -> DataFrame:
    """Where a month's segments lie, and what they are mostly."""
    s = segments(spark, d).withColumn("ym", ym(F.col("start_ts")))
    c = s.groupBy("ym", "category").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    return c.groupBy("ym").agg(js_round(F.sum("x") / F.sum("n")).alias("x"), js_round(F.sum("y") / F.sum("n")).alias("y"), F.sum("n").alias("segments"), F.min_by("category", F.struct(-F.col("n"), "category")).alias("category"))


def attachment_density(spark: SparkSession, d: str) -> DataFrame:
    """The eighty segments with the most attachments."""
    e = sequence.episodes(messages(spark, d)).filter("has_attachment = 1")
    n = e.groupBy("chat_id", "episode").agg(F.count("*").alias("n"), F.min("category").alias("label"))
    s = segments(spark, d).select("chat_id", "episode", "segment_id", js_round(F.col("x")).alias("x"), js_round(F.col("y")).alias("y"))
    top = n.join(s, ["chat_id", "episode"]).orderBy(F.desc("n"), "segment_id").limit(80)
    return top.select("segment_id", "x", "y", "n", "label", js_round(F.greatest(F.lit(5.0), F.least(F.lit(24.0), 4 + F.sqrt("n") * 4))).alias("radius"))


def autocorrelation_week(spark: SparkSession, d: str) -> DataFrame:
    """Daily volume against that of the same day a week on; 0 where there are ten days or fewer."""
    x = series._whole_days(spark, d).select("i", "n")
    later = x.select((F.col("i") - 7).alias("i"), F.col("n").alias("later"))
    days = x.agg(F.count("*").alias("days"))
    r = x.join(later, "i").agg(F.corr("n", "later").alias("r"))
    return days.join(r).select("days", js_round(F.when(F.col("days") <= 10, 0.0).otherwise(F.coalesce("r", F.lit(0.0)))).alias("r"))


def recurrence_rates(spark: SparkSession, d: str) -> DataFrame:
    """The share of pairs of days that recur, and of these the shares beside another on a diagonal and on a line."""
    days = series._whole_days(spark, d).agg(F.count("*").alias("days"))
    diagonal = Window.partitionBy(F.col("j") - F.col("i")).orderBy("i")
    line = Window.partitionBy("i").orderBy("j")
    near = lambda c, w: F.coalesce(F.lag(c).over(w) == F.col(c) - 1, F.lit(False)) | F.coalesce(F.lead(c).over(w) == F.col(c) + 1, F.lit(False))
    r = series.day_recurrence(spark, d).select("i", "j", near("i", diagonal).alias("on_diagonal"), near("j", line).alias("on_line"))
    n = r.agg(F.count("*").alias("recurrent"), F.count_if("on_diagonal").alias("dia"), F.count_if("on_line").alias("lam"))
    pairs = F.greatest(F.col("days") - 8, F.lit(0)) * F.greatest(F.col("days") - 7, F.lit(0)) / 2
    share = lambda a, b: js_round(F.when(b > 0, a / b).otherwise(0.0))
    return days.join(n).select("recurrent", share(F.col("recurrent"), pairs).alias("rate"), share(F.col("dia"), F.col("recurrent")).alias("determinism"), share(F.col("lam"), F.col("recurrent")).alias("laminarity"))


def robust_scales(spark: SparkSession, d: str) -> DataFrame:
    """Each chat's scale of daily volume: the quartiles' distance over 1.349, else the deviation, else 1."""
    x = series._days(spark, d)
    spread = F.percentile("n", 0.75) - F.percentile("n", 0.25)
    s = x.groupBy("chat_id").agg(F.count("*").alias("days"), spread.alias("spread"), F.stddev_pop("n").alias("sd"))
    return s.select("chat_id", js_round(F.when(F.col("days") < 2, 1.0).when(F.col("spread") > 0, F.col("spread") / 1.349).when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).alias("scale"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(_quoted(i) for i in items) + "]"


_BODY = "translate(lower(coalesce(text, '')), '’‘', '''''')"


def _is(kind: ladders.Kind) -> str:
    tests = []
    if kind.words:
        tests.append(f"regexp_matches(body, {bounded(kind.words)})")
    if kind.opening:
        tests.append(f"regexp_matches(body, {_quoted('^(' + kind.opening + ')([^a-z0-9_]|$)')})")
    if kind.asks:
        tests.append("contains(body, '?')")
    if kind.link:
        tests.append(f"regexp_matches(body, {_quoted(kind.link)})")
    if kind.attached:
        tests.append("has_attachment = 1")
    return " OR ".join(tests)


def _all(ladder) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_is(k)} THEN '{k.name}' END" for k in ladder) + "], lambda k: k IS NOT NULL)"


def _first(ladder) -> str:
    return "CASE " + " ".join(f"WHEN {_is(k)} THEN '{k.name}'" for k in ladder) + " END"


_SAID = f"""{MESSAGES}, said AS (SELECT *, {_BODY} AS body FROM (SELECT *, CASE WHEN word_count < 150 THEN {_list(PHRASES)}[(id + k) % {len(PHRASES)} + 1] END AS text FROM messages) WHERE amt IS NULL OR amt < 2000)"""
_ANSWERED = f"""{_SAID}, sides AS (SELECT *, min(CASE WHEN is_from_me = 1 THEN ts END) OVER w AS by_me, min(CASE WHEN is_from_me = 0 THEN ts END) OVER w AS by_them FROM said
  WINDOW w AS (PARTITION BY chat_id ORDER BY ts, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
answered AS (SELECT *, CASE WHEN is_from_me = 1 THEN by_them ELSE by_me END - ts AS wait FROM sides)"""
_SHAPE = f"regexp_extract(body, '(^|[^a-z0-9_])({ladders.SHAPE_WORDS})([^a-z0-9_]|$)', 2)"
_HITS = ", ".join(
    f"CAST(sum(len(list_filter(regexp_extract_all(body, '[a-z0-9'']+'), lambda t: list_contains({_list(words)}, t)))" + "".join(f" + CASE WHEN contains(body, {_quoted(p)}) THEN 2 ELSE 0 END" for p in phrases) + f") AS BIGINT) AS {kind}"
    for kind, (words, phrases) in COUNTED.items()
)
_WEEKS = f"{_SAID}, weeks AS (SELECT chat_id, CAST(floor(ts / 604800) AS BIGINT) AS week, count(*) AS n, {_HITS} FROM said GROUP BY 1, 2)"
_LABELLED = f"""{SEGMENTS}, s AS (SELECT *, CASE WHEN n_msgs < {LEAST_MESSAGES} THEN 'uncertain' WHEN topic_id <> 5 THEN 'classified' END AS status FROM segments),
tc AS (SELECT topic_id, arg_min(category, (-n, category)) AS topic_category FROM (SELECT topic_id, category, count(*) AS n FROM s GROUP BY ALL) WHERE topic_id % 4 <> 0 GROUP BY 1),
tl AS (SELECT DISTINCT topic_id, 'topic ' || topic_id AS topic_label FROM s WHERE topic_id % 3 <> 0),
labelled AS (SELECT * FROM s LEFT JOIN tc USING (topic_id) LEFT JOIN tl USING (topic_id))"""

_TOKENS = """list_filter(list_transform(string_split(regexp_replace(translate(lower(text), '’‘', ''''''), '[^a-z0-9'' ]', ' ', 'g'), ' '), lambda w: regexp_replace(w, '^''+|''+$', '', 'g')), lambda w: length(w) BETWEEN 1 AND 40)"""


def _matched(kind: str) -> str:
    """A word counts as negated where one of the four before it negates."""
    words, phrases = texts.LEXICONS[kind]
    negated = f"list_has_any(w[greatest(i - {texts.NEGATION_WINDOW}, 1):i - 1], {_list(texts.NEGATORS)})"
    found = lambda how: f"len(list_filter(range(1, len(w) + 1), lambda i: list_contains({_list(words)}, w[i]) AND {how} {negated})) > 0"
    veto = f"WHEN regexp_matches(lower(text), {bounded(texts.LOGISTICS_APOLOGY)}) THEN false " if kind == "repair" else ""
    return f"CASE {veto}WHEN {found('NOT')} THEN true WHEN {found('')} THEN false ELSE regexp_matches(lower(text), {bounded('|'.join((*words, *phrases)))}) END"


ORACLE_SQL = {
    "lexicon_kinds": f"""WITH {_SAID}, t AS (SELECT text, {_TOKENS} AS w FROM (SELECT DISTINCT text FROM said WHERE text IS NOT NULL)),
k AS (SELECT text, unnest(list_filter([{', '.join(f"CASE WHEN {_matched(kind)} THEN '{kind}' END" for kind in texts.LEXICONS)}], lambda x: x IS NOT NULL)) AS kind FROM t)
SELECT kind, is_from_me, count(*) AS n FROM said JOIN k USING (text) GROUP BY 1, 2""",
    "bid_types": f"""WITH {_ANSWERED}, b AS (SELECT is_from_me, wait, unnest({_all(ladders.BIDS)}) AS bid FROM answered)
SELECT bid, is_from_me, count(*) AS n, count(*) FILTER (wait <= 3600) AS in_1h, count(*) FILTER (wait <= 21600) AS in_6h, count(*) FILTER (wait IS NULL OR wait >= 86400) AS hanging FROM b GROUP BY 1, 2""",
    "question_shapes": f"""WITH {_ANSWERED}, q AS (SELECT wait, {_SHAPE} AS word FROM answered WHERE is_from_me = 1 AND ({_is(ladders.BIDS[0])}))
SELECT CASE word {' '.join(f"WHEN '{w}' THEN '{s}'" for w, s in ladders.SHAPES.items())} WHEN '' THEN 'other' ELSE word END AS shape, count(*) AS n, count(*) FILTER (wait <= 21600) AS in_6h FROM q GROUP BY 1""",
    "opener_kinds": f"""WITH {_SAID}, g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY chat_id ORDER BY ts, id) AS gap FROM said)
SELECT coalesce({_first(ladders.OPENERS)}, 'ambient') AS kind, count(*) AS n, CAST(sum(is_from_me) AS BIGINT) AS me, max(gap) AS longest FROM g WHERE gap >= {sequence.RESTART_GAP} GROUP BY 1""",
    "loop_kinds": f"""WITH {_ANSWERED}, l AS (SELECT wait, {_first(ladders.LOOPS)} AS kind FROM answered)
SELECT kind, count(*) AS n, count(*) FILTER (wait <= 172800) AS taken_up, CAST(sum(wait) FILTER (wait <= 172800) AS BIGINT) AS wait_s FROM l WHERE kind IS NOT NULL GROUP BY 1""",
    "ritual_patterns": f"""WITH {_SAID}, r AS (SELECT is_from_me, ts, unnest({_all(ladders.RITUALS)}) AS ritual FROM said)
SELECT ritual, count(*) AS n, CAST(sum(is_from_me) AS BIGINT) AS me, count(DISTINCT floor(ts / 86400)) AS days, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY 1""",
    "word_phrase_hits": f"WITH {_WEEKS} SELECT * FROM weeks",
    "capped_rates": f"""WITH {_WEEKS}, whole AS (SELECT week, CAST(sum(n) AS BIGINT) AS n, {', '.join(f"CAST(sum({k}) AS BIGINT) AS {k}" for k in COUNTED)} FROM weeks GROUP BY 1), caps AS (SELECT {', '.join(f"greatest(list_sort(list({k} / n))[CAST(floor((count(*) - 1) * {CAP_SHARE}) AS INT) + 1], {CAP_FLOOR}) AS {k}_cap" for k in COUNTED)} FROM whole)
SELECT week, {', '.join(f"{rounded(f'least(greatest({k} / n / {k}_cap, 0), 1)')} AS {k}" for k in COUNTED)} FROM whole, caps""",
    "emoji_top": f"""WITH {_SAID}, e AS (SELECT unnest(regexp_extract_all(text, '{ladders.EMOJI}')) AS emoji FROM said)
SELECT emoji, count(*) AS n FROM e WHERE NOT list_contains({_list(ladders.GAME_GRID)}, emoji) GROUP BY 1 ORDER BY n DESC, emoji LIMIT 30""",
    "text_hygiene": rf"""WITH {_SAID}, h AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^ \t\r\n]+', ' ', 'gi'), '\b[a-z0-9.-]+\.(com|ca|org|net|app|io|dev|co)/?[^ \t\r\n]*', ' ', 'gi'), '[ \t\r\n]+', ' ', 'g')) AS bare,
  trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS clean FROM said WHERE text IS NOT NULL)
SELECT bare, CASE WHEN length(clean) <= 20 THEN clean ELSE rtrim(substring(clean, 1, 19)) || '…' END AS preview, count(*) AS n FROM h GROUP BY 1, 2""",
    "window_odds": f"""WITH {_SAID}, m AS (SELECT *, CAST(floor(ts / 86400) AS BIGINT) AS day FROM said), dd AS (SELECT chat_id, day, count(*) AS n FROM m GROUP BY 1, 2),
e AS (SELECT chat_id, day, CASE WHEN n >= {SURGE} * avg(n) OVER (PARTITION BY chat_id) THEN 1 ELSE 0 END AS event FROM dd), tot AS (SELECT sum(event) AS oe, sum(1 - event) AS onn FROM e),
w AS (SELECT DISTINCT chat_id, day, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) AS word FROM m), c AS (SELECT word, CAST(sum(event) AS BIGINT) AS events, CAST(sum(1 - event) AS BIGINT) AS neutral FROM w JOIN e USING (chat_id, day) GROUP BY 1),
l AS (SELECT *, log2(((events + 0.5) / (oe - events + 0.5)) / ((neutral + 0.5) / (onn - neutral + 0.5))) AS v FROM c, tot)
SELECT word, events, neutral, {rounded('v')} AS lift, {rounded('v * sqrt(events)')} AS score FROM l""",
    "smoothed_rates": f"""WITH {MESSAGES}, c AS (SELECT chat_id, category, count(*) AS n, sum(has_attachment) AS part FROM messages GROUP BY 1, 2), b AS (SELECT sum(part) / sum(n) AS base FROM c)
SELECT chat_id, category, n, {rounded('(part + base * 30.0) / (n + 30.0)')} AS rate, {rounded('n / (n + 30)')} AS support FROM c, b""",
    "method_confidence": f"""WITH {MESSAGES}, b AS (SELECT avg(has_attachment) AS base FROM messages), c AS (SELECT chat_id, category, count(*) AS n, avg(has_attachment) AS p FROM messages GROUP BY 1, 2),
x AS (SELECT chat_id, category, n, p - base AS diff, 1.96 * sqrt(p * (1 - p) / n) AS half, unnest(['statistical', 'heuristic', 'speculative']) AS method FROM c, b)
SELECT chat_id, category, method, CASE WHEN method = 'speculative' OR n < 30 THEN 'low' WHEN diff + half < 0 OR diff - half > 0 THEN CASE WHEN n >= 80 AND method <> 'heuristic' THEN 'high' ELSE 'medium' END ELSE 'low' END AS confidence FROM x""",
    "segment_labels": f"""WITH {_LABELLED}, l AS (SELECT segment_id, chat_id, topic_id, status, coalesce(CASE WHEN status = 'classified' THEN category END, topic_category, topic_label, 'unlabeled') AS label FROM labelled WHERE topic_category IS NULL OR topic_category NOT IN ('{EXCLUDED}'))
SELECT * FROM l WHERE label <> '{SENSITIVE}'""",
    "unclassified_segments": f"WITH {_LABELLED} SELECT segment_id, chat_id, topic_id, n_msgs, status FROM labelled WHERE category IS NULL OR status IS DISTINCT FROM 'classified'",
    "message_labels": f"""WITH {_LABELLED}, c AS (SELECT chat_id, episode, category, topic_label FROM labelled WHERE status = 'classified')
SELECT c.category, c.topic_label, count(*) AS n FROM episodes e LEFT JOIN c USING (chat_id, episode) GROUP BY 1, 2""",
    "topic_positions": f"""WITH {SEGMENTS}, t AS (SELECT topic_id, count(*) AS n_segments FROM segments GROUP BY 1)
SELECT t.topic_id, t.n_segments, CASE WHEN count(s.segment_id) > 0 THEN count(s.segment_id) END AS n_placed, {rounded('avg(s.x)')} AS x, {rounded('avg(s.y)')} AS y FROM t LEFT JOIN segments s ON s.topic_id = t.topic_id AND s.n_msgs >= 3 GROUP BY 1, 2""",
    "chat_metadata": f"WITH {MESSAGES} SELECT chat_id, count(*) AS n_messages, count(DISTINCT category) AS n_members, count(*) FILTER (has_attachment = 1 AND amt IS NULL) AS n_attachments FROM messages GROUP BY 1",
    "month_path": f"""WITH {SEGMENTS}, c AS (SELECT strftime({LOCAL.replace('ts', 'start_ts')}, '%Y-%m') AS ym, category, count(*) AS n, sum(x) AS x, sum(y) AS y FROM segments GROUP BY 1, 2)
SELECT ym, {rounded('sum(x) / sum(n)')} AS x, {rounded('sum(y) / sum(n)')} AS y, CAST(sum(n) AS BIGINT) AS segments, arg_min(category, (-n, category)) AS category FROM c GROUP BY 1""",
    "attachment_density": f"""WITH {SEGMENTS}, n AS (SELECT chat_id, episode, count(*) AS n, min(category) AS label FROM episodes WHERE has_attachment = 1 GROUP BY 1, 2)
SELECT segment_id, {rounded('x')} AS x, {rounded('y')} AS y, n, label, {rounded('greatest(5.0, least(24.0, 4 + sqrt(n) * 4))')} AS radius FROM n JOIN segments USING (chat_id, episode) ORDER BY n DESC, segment_id LIMIT 80""",
    "autocorrelation_week": f"""WITH {series._WHOLE}, r AS (SELECT corr(a.n, b.n) AS r FROM whole a JOIN whole b ON b.i = a.i + 7)
SELECT (SELECT count(*) FROM whole) AS days, {rounded('CASE WHEN (SELECT count(*) FROM whole) <= 10 THEN 0 ELSE coalesce(r, 0) END')} AS r FROM r""",
    "recurrence_rates": f"""WITH {series._WHOLE}, p AS (SELECT u.i, v.i AS j, sqrt(pow(ln(1 + u.n) - ln(1 + v.n), 2) + pow(ln(1 + u.words) - ln(1 + v.words), 2)) AS distance FROM whole u JOIN whole v ON v.i - u.i >= 8), l AS (SELECT quantile_cont(distance, 0.075) AS top FROM p),
r AS (SELECT i, j FROM p, l WHERE {rounded('distance')} <= {rounded('top')}), c AS (SELECT EXISTS (SELECT 1 FROM r b WHERE (b.i = a.i - 1 AND b.j = a.j - 1) OR (b.i = a.i + 1 AND b.j = a.j + 1)) AS dia,
  EXISTS (SELECT 1 FROM r b WHERE b.i = a.i AND (b.j = a.j - 1 OR b.j = a.j + 1)) AS lam FROM r a)
SELECT count(*) AS recurrent, {rounded('CASE WHEN (SELECT count(*) FROM p) > 0 THEN count(*) / (SELECT count(*) FROM p) ELSE 0 END')} AS rate, {rounded('CASE WHEN count(*) > 0 THEN count(*) FILTER (dia) / count(*) ELSE 0 END')} AS determinism,
{rounded('CASE WHEN count(*) > 0 THEN count(*) FILTER (lam) / count(*) ELSE 0 END')} AS laminarity FROM c""",
    "robust_scales": f"""WITH {series._DAYS}, s AS (SELECT chat_id, count(*) AS days, quantile_cont(n, 0.75) - quantile_cont(n, 0.25) AS spread, stddev_pop(n) AS sd FROM days GROUP BY 1)
SELECT chat_id, {rounded('CASE WHEN days < 2 THEN 1.0 WHEN spread > 0 THEN spread / 1.349 WHEN sd > 0 THEN sd ELSE 1.0 END')} AS scale FROM s""",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
