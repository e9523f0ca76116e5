"""SQL fragments of the oracles: the driver's tables in the shapes that the analyses read, for DuckDB."""

from __future__ import annotations

MESSAGES = """m0 AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
messages AS (SELECT event_id AS id, epoch_us(ts) // 1000000 AS ts, CAST(user_id % 25 AS INT) AS chat_id,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 1 ELSE 0 END AS is_from_me, k,
  CASE WHEN event_type = 'error' THEN 2000 + k % 6 WHEN event_type = 'signup' AND k % 4 = 0 THEN 3 END AS amt,
  CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS has_attachment, CAST(floor(value) AS BIGINT) AS word_count,
  CASE WHEN k % 7 = 0 AND event_id - 1 - k >= 0 THEN event_id - 1 - k END AS reply_to_id,
  event_type AS category, value FROM m0)"""

LOCAL = "timezone('America/Vancouver', to_timestamp(ts))"

TEXT_MESSAGES = """text_messages AS (SELECT conv_id * 1000 + turn AS id, conv_id AS chat_id,
  1700000000 + conv_id * 7200 + turn * (60 + 37 * (conv_id % 50)) AS ts,
  CASE WHEN role = 'user' THEN 1 ELSE 0 END AS is_from_me, CASE WHEN role = 'system' THEN 3 END AS amt, text FROM conversations)"""

CORPUS = """corpus AS (SELECT doc_id AS id, CAST(doc_id % 2 AS INT) AS is_from_me, CAST(doc_id % 12 AS INT) AS month,
  lang AS category, source AS topic, text FROM documents)"""

TURNS = f"""{MESSAGES},
t0 AS (SELECT *, CASE WHEN lag(is_from_me) OVER w <> is_from_me OR ts - lag(ts) OVER w > 1200 THEN 1 ELSE 0 END AS cut
  FROM messages WHERE amt IS NULL OR amt = 0 WINDOW w AS (PARTITION BY chat_id ORDER BY ts, id)),
t1 AS (SELECT *, sum(cut) OVER (PARTITION BY chat_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS turn FROM t0),
turns AS (SELECT chat_id, CAST(turn AS BIGINT) AS turn, arg_min(id, (ts, id)) AS id, min(is_from_me) AS is_from_me, min(ts) AS ts, max(ts) AS end_ts,
  count(*) AS n_msgs, CAST(sum(word_count) AS BIGINT) AS n_words FROM t1 GROUP BY chat_id, turn)"""

PAIRS = f"""{TURNS},
p0 AS (SELECT *, lead(ts) OVER w AS reply_ts, lead(is_from_me) OVER w AS reply_from_me FROM turns WINDOW w AS (PARTITION BY chat_id ORDER BY ts, id)),
pairs AS (SELECT *, reply_ts - end_ts AS latency FROM p0 WHERE reply_from_me <> is_from_me AND reply_ts - end_ts BETWEEN 0 AND 86400)"""

EPISODES = f"""{MESSAGES},
e0 AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY chat_id ORDER BY ts, id) > 7200 THEN 1 ELSE 0 END AS cut FROM messages),
episodes AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY chat_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM e0)"""

SEGMENTS = f"""{EPISODES},
s_topic AS (SELECT chat_id, episode, arg_min(key, (-n, key)) AS topic_id FROM (SELECT chat_id, episode, k % 12 AS key, count(*) AS n FROM episodes GROUP BY ALL) GROUP BY ALL),
s_cat AS (SELECT chat_id, episode, arg_min(key, (-n, key)) AS category FROM (SELECT chat_id, episode, category AS key, count(*) AS n FROM episodes GROUP BY ALL) GROUP BY ALL),
s_base AS (SELECT chat_id, episode, min(ts) AS start_ts, max(ts) AS end_ts, arg_min(id, (ts, id)) AS segment_id, count(*) AS n_msgs,
  CAST(sum(is_from_me) AS BIGINT) AS n_me, CAST(sum(1 - is_from_me) AS BIGINT) AS n_them, CAST(sum(k) AS BIGINT) AS sum_k,
  CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS sum_value FROM episodes GROUP BY ALL),
segments AS (SELECT b.*, t.topic_id, c.category, sum_k / n_msgs AS x, sum_value / n_msgs AS y FROM s_base b
  JOIN s_topic t USING (chat_id, episode) JOIN s_cat c USING (chat_id, episode))"""

LINKS = f"""{SEGMENTS},
l0 AS (SELECT chat_id, segment_id AS from_id, lead(segment_id) OVER w AS to_id, lead(start_ts) OVER w - end_ts AS gap, category AS from_category,
  lead(category) OVER w AS to_category, topic_id AS from_topic, lead(topic_id) OVER w AS to_topic FROM segments
  WINDOW w AS (PARTITION BY chat_id ORDER BY start_ts, segment_id)),
links AS (SELECT * FROM l0 WHERE to_id IS NOT NULL AND gap BETWEEN 0 AND 259200)"""

ASCII_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]{2,}')"
LETTER_TOKENS = "list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) BETWEEN 2 AND 24)"


def rounded(x: str, digits: int = 6) -> str:
    k = 10**digits
    return f"(floor(({x}) * {k}.0 + 0.5) / {k}.0)"


def bounded(pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"'(^|[^A-Za-z0-9_])({quoted})([^A-Za-z0-9_]|$)'"
