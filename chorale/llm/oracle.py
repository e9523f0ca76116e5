"""DuckDB SQL for the queries of this subpackage that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from chorale.llm import quality
from chorale.llm.queries import CONTROL_CONVERSATION, DUPLICATE_PERCENT, URL_RULES

_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"regexp_extract_all(coalesce({x}, ''), '[^\x20\x09-\x0D]+')"
#: A control string's first character, then what may follow it; a tilde goes between.
_CONTROL = r"[<\[]~*(?:\||/?s>|/?INST\])"

_RULES = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)
_EXTRA = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in CONTROL_CONVERSATION)

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, hex, array_to_string(list_transform(range(0, 8), lambda g: list_reduce(list_prepend('', list_transform([15, 10, 5, 0],
 lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, CAST(g * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(s AS INT)) & 31) + 1 AS INT), 1))), lambda x, y: x || y)), '') AS payload_digest FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS top FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM m""",
    "op3_chat": f"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES {_EXTRA}) v(conv_id, turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(23 + length(role) + length(text) + len(regexp_extract_all(role, '{_CONTROL}')) + len(regexp_extract_all(text, '{_CONTROL}'))) AS BIGINT) AS formatted_chars FROM c GROUP BY 1""",
    "op6_quality": rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents), w AS (SELECT doc_id, {_WORDS.format(x='text')} AS w FROM d),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w), g AS (SELECT doc_id, pos, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, word, b, c) AS k FROM g WHERE c IS NOT NULL), v AS (SELECT DISTINCT doc_id, pos + i AS pos FROM r, (SELECT unnest([0, 1, 2]) AS i) WHERE k > 1),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM v GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT d.doc_id, d.source, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
 CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n_repeat_words, 0) AS n_repeat_words FROM d JOIN w USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM f GROUP BY 1), s AS (SELECT sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) AS sq FROM h),
q AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(sq - mean * mean, 1e-9) - 1, 1.0), 1e6) AS strength FROM s),
bad AS (SELECT source, (f + mean * strength) / (n + strength) AS rate, (f + mean * strength) / (n + strength) > {quality.MAX_HOST_RATE} AS bad FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept, floor(rate * 1e6 + 0.5) / 1e6 AS host_rate FROM f JOIN bad ON f.source IS NOT DISTINCT FROM bad.source""",
    "op9_urlfilter": f"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_UPPER}, {_LOWER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u), r(verdict, rhost, rpath) AS (VALUES {_RULES}),
m AS (SELECT page_id, rhost || rpath AS rule, verdict FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY len(string_split(rhost, '.')) DESC, length(rpath) DESC, verdict DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)""",
    "op10_neardup": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(x=f'translate(text, {_UPPER}, {_LOWER})')} AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
g AS (SELECT doc_id, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS s FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
s AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM g WHERE s IS NOT NULL UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= {DUPLICATE_PERCENT} * (x.n + y.n - both_)),
reach AS (SELECT doc_id, doc_id AS far FROM documents UNION SELECT reach.doc_id, l.b FROM reach JOIN l ON reach.far = l.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(far) AS component_id, d.doc_id = min(far) AS kept FROM documents d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY 1""",
}
