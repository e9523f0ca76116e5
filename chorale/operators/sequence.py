"""Ordered-sequence operators. Windows are partitioned by chat and ordered by (ts, id); a chat is the unit of order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN_GAP, EPISODE_GAP, RESTART_GAP = 1200, 7200, 21600


def ordered(by: str = "chat_id") -> Window:
    return Window.partitionBy(by).orderBy("ts", "id")


def gaps(m: DataFrame) -> DataFrame:
    """m with the seconds since the chat's previous row (null at its first)."""
    return m.withColumn("gap", F.col("ts") - F.lag("ts").over(ordered()))


def islands(m: DataFrame, cut: Column, name: str) -> DataFrame:
    """m with the number, from 0, of the run that a row belongs to; a row with cut begins one."""
    return m.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int")).withColumn(name, F.sum("_cut").over(ordered().rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def turn_ids(m: DataFrame, gap: int = TURN_GAP) -> DataFrame:
    """A turn ends where the sender changes or the gap exceeds the limit."""
    w = ordered()
    return islands(m, (F.lag("is_from_me").over(w) != F.col("is_from_me")) | (F.col("ts") - F.lag("ts").over(w) > gap), "turn")


def turns(m: DataFrame, gap: int = TURN_GAP, words: str = "word_count") -> DataFrame:
    """One row per turn, with id the first message's."""
    return turn_ids(m, gap).groupBy("chat_id", "turn").agg(
        F.min_by("id", F.struct("ts", "id")).alias("id"),
        F.first("is_from_me").alias("is_from_me"),
        F.min("ts").alias("ts"),
        F.max("ts").alias("end_ts"),
        F.count("*").alias("n_msgs"),
        F.sum(words).alias("n_words"),
    )


def reply_pairs(t: DataFrame, within: int) -> DataFrame:
    """A turn and the next, of the other sender, that starts at most `within` seconds after its end."""
    w = ordered()
    paired = t.withColumns({"reply_ts": F.lead("ts").over(w), "reply_from_me": F.lead("is_from_me").over(w), "reply_turn": F.lead("turn").over(w)})
    latency = F.col("reply_ts") - F.col("end_ts")
    return paired.withColumn("latency", latency).filter((F.col("reply_from_me") != F.col("is_from_me")) & latency.between(0, within))


def restarts(m: DataFrame, gap: int = RESTART_GAP) -> DataFrame:
    """Rows that follow a silence of at least gap seconds, with the sender before it."""
    w = ordered()
    return m.withColumns({"gap": F.col("ts") - F.lag("ts").over(w), "from_sender": F.lag("is_from_me").over(w)}).filter(F.col("gap") >= gap)


def episodes(m: DataFrame, gap: int = EPISODE_GAP, name: str = "episode") -> DataFrame:
    w = ordered()
    return islands(m, F.col("ts") - F.lag("ts").over(w) > gap, name)


def runs(m: DataFrame) -> DataFrame:
    """Same-sender runs without a gap rule."""
    return islands(m, F.lag("is_from_me").over(ordered()) != F.col("is_from_me"), "run")


def next_other(m: DataFrame, *also: str) -> DataFrame:
    """m with the time of the other sender's next message, and further columns of it as other_<name>: a running last value in
    reverse order, so linear."""
    back = Window.partitionBy("chat_id").orderBy(F.desc("ts"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda who: F.last(F.when(F.col("is_from_me") == who, F.struct("ts", *also)), ignorenulls=True).over(back)
    both = m.withColumns({"_me": last(1), "_them": last(0)}).withColumn("_other", F.when(F.col("is_from_me") == 1, F.col("_them")).otherwise(F.col("_me")))
    return both.withColumns({f"other_{c}": F.col(f"_other.{c}") for c in ("ts", *also)}).drop("_me", "_them", "_other")


def following(m: DataFrame, seconds: int) -> Window:
    """The rows after, up to so many seconds later, as a range frame; the row itself and its peers are in it."""
    return Window.partitionBy("chat_id").orderBy("ts").rangeBetween(0, seconds)


def linked(seg: DataFrame, max_gap: int) -> DataFrame:
    w = Window.partitionBy("chat_id").orderBy("start_ts", "segment_id")
    out = seg.select(
        "chat_id",
        F.col("segment_id").alias("from_id"),
        F.lead("segment_id").over(w).alias("to_id"),
        (F.lead("start_ts").over(w) - F.col("end_ts")).alias("gap"),
        F.col("category").alias("from_category"),
        F.lead("category").over(w).alias("to_category"),
        F.col("topic_id").alias("from_topic"),
        F.lead("topic_id").over(w).alias("to_topic"),
    )
    return out.filter(F.col("to_id").isNotNull() & F.col("gap").between(0, max_gap))


def prior_mean(x: str, rows: int, w: Window) -> Column:
    """The mean of the rows before, without the current one."""
    return F.avg(x).over(w.rowsBetween(-rows, -1))
