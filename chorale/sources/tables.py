"""The driver's tables in the shapes that the analyses read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.functions.timeutil import epoch
from chorale.operators import sequence


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an ordered message log of 25 chats."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    reply = F.col("event_id") - 1 - k
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        epoch(F.col("ts")).alias("ts"),
        (F.col("user_id") % 25).cast("int").alias("chat_id"),
        F.when(F.col("event_type").isin("click", "view", "purchase"), 1).otherwise(0).alias("is_from_me"),
        k.alias("k"),
        F.when(F.col("event_type") == "error", 2000 + k % 6).when((F.col("event_type") == "signup") & (k % 4 == 0), 3).alias("amt"),
        F.when(k % 10 == 0, 1).otherwise(0).alias("has_attachment"),
        F.floor("value").cast("bigint").alias("word_count"),
        F.when((k % 7 == 0) & (reply >= 0), reply).alias("reply_to_id"),
        F.col("event_type").alias("category"),
        F.col("value"),
    )


#: What the messages of `phrased` say, by their k: plain English, as the tables' own texts hold none.
PHRASES = (
    "How are you feeling today?", "I'm sorry, I didn't mean that", "Sorry, when is dinner?", "good morning love 🌞", "What time should we meet tonight?",
    "lol that is so funny 😂😂", "love you, sleep well ❤️", "On my way, leaving now", "look at this https://example.org/a/b?c=1 wow", "wanna come over and hang out?",
    "thank you so much 👍", "just got home safe", "can you remind me tomorrow", "I feel so tired and stressed", "not sad, only hungry",
    "Wordle 4/6 🟩⬛🟨", "are you okay?", "miss you 👩‍🚀", "ok", "could you send me the address",
    "see   example.com/menu  for lunch plans", "I don’t love this", "proud of you darling", "Why not? We will see", "is the game on",
)


def phrased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """messages, each saying the phrase of its k and place; a sender's long message says nothing."""
    at = (F.col("id") + F.col("k")) % len(PHRASES) + 1
    return messages(spark, sf_dir).withColumn("text", F.when(F.col("word_count") < 150, F.element_at(F.array(*[F.lit(p) for p in PHRASES]), at.cast("int"))))


def uneven(m: DataFrame) -> DataFrame:
    """The same messages in uneven time: of every sixteen days, the first twelve pass in eight and the last four in eight."""
    day, span = 86400, 16 * 86400
    at = F.col("ts") % span
    quick, slow = F.floor(at * 2 / 3), 8 * day + 2 * (at - 12 * day)
    return m.withColumn("ts", (F.col("ts") - at + F.when(at < 12 * day, quick).otherwise(slow)).cast("bigint"))


def text_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as a message log with texts."""
    c, t = F.col("conv_id"), F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        (c * 1000 + t).alias("id"),
        c.alias("chat_id"),
        (F.lit(1700000000) + c * 7200 + t * (60 + 37 * (c % 50))).alias("ts"),
        (F.col("role") == "user").cast("int").alias("is_from_me"),
        F.when(F.col("role") == "system", 3).alias("amt"),
        F.col("text"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as texts of two senders over twelve months."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        (F.col("doc_id") % 2).cast("int").alias("is_from_me"),
        (F.col("doc_id") % 12).cast("int").alias("month"),
        F.col("lang").alias("category"),
        F.col("source").alias("topic"),
        F.col("text"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of messages (gaps over 2 h) with their dominant topic and category, and coordinates."""
    m = sequence.episodes(messages(spark, sf_dir), gap=7200)
    return segments_of(m)


def dominant(counts: Column, key: str) -> Column:
    """The most frequent key of an array of structs with a count n; ties go to the least."""
    total = lambda k: F.aggregate(F.filter(counts, lambda c: c[key].eqNullSafe(k)), F.lit(0).cast("bigint"), lambda t, c: t + c["n"])
    ranked = F.transform(F.array_distinct(counts[key]), lambda k: F.struct((-total(k)).alias("n"), k.alias("key")))
    return F.array_min(ranked)["key"]


def segments_of(m: DataFrame) -> DataFrame:
    """One pass over the messages: counts by topic and category within a segment, of which there are 60 at most, then segments."""
    by = ["chat_id", "episode"]
    parts = m.groupBy(*by, (F.col("k") % 12).alias("topic_id"), "category").agg(
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.min_by("id", F.struct("ts", "id")).alias("segment_id"),
        F.count("*").alias("n"),
        F.sum("is_from_me").alias("n_me"),
        F.sum(1 - F.col("is_from_me")).alias("n_them"),
        F.sum("k").alias("sum_k"),
        F.sum(F.floor("value").cast("bigint")).alias("sum_value"),
    )
    base = parts.groupBy(*by).agg(
        F.min_by("segment_id", F.struct("start_ts", "segment_id")).alias("segment_id"),
        F.min("start_ts").alias("start_ts"),
        F.max("end_ts").alias("end_ts"),
        F.sum("n").alias("n_msgs"),
        *[F.sum(c).alias(c) for c in ("n_me", "n_them", "sum_k", "sum_value")],
        F.collect_list(F.struct("topic_id", "category", "n")).alias("_counts"),
    )
    return base.withColumns(
        {
            "topic_id": dominant(F.col("_counts"), "topic_id"),
            "category": dominant(F.col("_counts"), "category"),
            "x": F.col("sum_k") / F.col("n_msgs"),
            "y": F.col("sum_value") / F.col("n_msgs"),
        }
    ).drop("_counts")


def links(seg: DataFrame, max_gap: int = 259200) -> DataFrame:
    """Each segment and the next of its chat, where the gap is at most 72 h."""
    return sequence.linked(seg, max_gap)
