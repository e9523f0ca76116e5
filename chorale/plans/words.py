"""Words, n-grams, sentences, search and lexicons over texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorale.functions import stats, text
from chorale.functions.stats import js_round
from chorale.plans.dialect import ASCII_TOKENS, CORPUS, LETTER_TOKENS, TEXT_MESSAGES, bounded, rounded
from chorale.sources.tables import corpus, text_messages

#: The terms that the search and lexicon queries look for: frequent words of the corpus, as its prose is invented.
TERMS = ("the", "that", "with", "der", "pour", "ciónque")
TERM_LEXICON = ("with", "was", "und", "avec", "por")
PHRASE = "of the"


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    return c.select("id", "is_from_me", "month", F.explode(text.ascii_tokens(F.col("text"))).alias("word"))


def top_words(spark: SparkSession, d: str) -> DataFrame:
    counts = _tokens(spark, d).groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("is_from_me").alias("senders"))
    return counts.orderBy(F.desc("n"), "word").limit(200)


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    w = F.explode(text.base_tokens(F.col("text"), 2, 24)).alias("word")
    return corpus(spark, d).select("is_from_me", w).groupBy("word").agg(F.count_if(F.col("is_from_me") == 1).alias("me"), F.count_if(F.col("is_from_me") == 0).alias("them"))


def _sided(spark: SparkSession, d: str, n: int = 1) -> DataFrame:
    tokens = text.letter_tokens(F.col("text"))
    grams = F.explode(text.ngrams(tokens, n) if n > 1 else tokens).alias("gram")
    c = corpus(spark, d).select("is_from_me", grams)
    return c.groupBy("gram").agg(F.count_if(F.col("is_from_me") == 1).alias("me"), F.count_if(F.col("is_from_me") == 0).alias("them"))


def _divergence(counts: DataFrame, least: int) -> DataFrame:
    totals = counts.agg(F.sum("me").alias("n_me"), F.sum("them").alias("n_them"))
    z = stats.log_odds_z(F.col("me"), F.col("them"), F.col("n_me"), F.col("n_them"))
    return counts.filter(F.col("me") + F.col("them") >= least).join(F.broadcast(totals)).select("gram", "me", "them", js_round(z, 4).alias("z"))


def word_divergence(spark: SparkSession, d: str) -> DataFrame:
    return _divergence(_sided(spark, d), 10)


def phrase_divergence(spark: SparkSession, d: str) -> DataFrame:
    return _divergence(_sided(spark, d, 2), 5)


def iconic_words(spark: SparkSession, d: str) -> DataFrame:
    """Words that both senders use far more than a baseline: a corpus word's Zipf value is here 1 + its length mod 5, 0 is unknown."""
    counts = _sided(spark, d).filter("me + them >= 10")
    totals = _sided(spark, d).agg(F.sum("me").alias("n_me"), F.sum("them").alias("n_them"))
    raw = (F.length("gram") % 6).cast("double")
    zipf = F.when(raw == 0, 1.0).otherwise(raw)
    base = F.pow(F.lit(10.0), zipf - 9)
    lift = F.least(F.col("me") / F.col("n_me") / base, F.col("them") / F.col("n_them") / base)
    return counts.join(F.broadcast(totals)).withColumn("lift", lift).filter("lift > 0").select("gram", "me", "them", js_round(F.log10("lift"), 4).alias("iconic"))


def bigram_counts(spark: SparkSession, d: str) -> DataFrame:
    return _sided(spark, d, 2).filter("me + them >= 10")


def trigram_counts(spark: SparkSession, d: str) -> DataFrame:
    return _sided(spark, d, 3).filter("me + them >= 5")


def gram_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Counts by sender and for both, with the floor applied to each row."""
    g = corpus(spark, d).select("is_from_me", F.explode(text.ngrams(text.letter_tokens(F.col("text")), 2)).alias("gram"))
    by = g.groupingSets([["gram", "is_from_me"], ["gram"]], "gram", "is_from_me").agg(F.count("*").alias("n"))
    return by.filter("n >= 10").select("gram", F.coalesce(F.when(F.col("is_from_me") == 1, "me").when(F.col("is_from_me") == 0, "them"), F.lit("all")).alias("sender"), "n")


def collocations_llr_pmi_t(spark: SparkSession, d: str) -> DataFrame:
    pairs = corpus(spark, d).select(F.explode(text.pairs(text.letter_tokens(F.col("text")))).alias("p")).select("p.w1", "p.w2")
    # both not null, said outright: the counts below and their totals then share one exchange, so texts are read once
    g = pairs.filter("w1 is not null and w2 is not null").groupBy("w1", "w2").agg(F.count("*").alias("c12"))
    first, second = g.groupBy("w1").agg(F.sum("c12").alias("c1")), g.groupBy("w2").agg(F.sum("c12").alias("c2"))
    j = g.filter("c12 >= 10").join(first, "w1").join(second, "w2").join(F.broadcast(g.agg(F.sum("c12").alias("total"))))
    j = j.withColumn("gram", F.concat_ws(" ", "w1", "w2"))
    a, n = F.col("c12").cast("double"), F.col("total").cast("double")
    b, c = F.col("c1") - a, F.col("c2") - a
    rest = n - F.col("c1") - F.col("c2") + a
    expected = F.col("c1") * F.col("c2") / n
    llr = 2 * (stats.log_term(a, (a + b) * (a + c) / n) + stats.log_term(b, (a + b) * (b + rest) / n) + stats.log_term(c, (c + rest) * (a + c) / n) + stats.log_term(rest, (c + rest) * (b + rest) / n))
    return j.select("gram", "c12", js_round(llr, 3).alias("llr"), js_round(F.log2((a / n) / ((F.col("c1") / n) * (F.col("c2") / n))), 4).alias("pmi"), js_round((a - expected) / F.sqrt(a), 4).alias("tscore"))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    s = corpus(spark, d).select("is_from_me", F.explode(text.sentences(F.col("text"))).alias("s"))
    return s.withColumn("words", F.size(F.regexp_extract_all(F.lower("s"), F.lit("[a-z0-9]+"), F.lit(0))))


def sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d).filter("words > 0")
    return s.groupBy("is_from_me").agg(
        F.count("*").alias("n"), js_round(F.sum("words") / F.count("*")).alias("mean_words"), js_round(stats.median_mean("words")).alias("median_words"),
        stats.quantile_floor("words", 0.9).alias("p90_words"), js_round(F.count_if(F.col("s").endswith("?")) / F.count("*")).alias("question_rate"),
        js_round(F.count_if(F.col("s").endswith("!")) / F.count("*")).alias("exclaim_rate"),
    )


def sentence_hist(spark: SparkSession, d: str) -> DataFrame:
    """Counts by length, with the buckets that nothing falls into."""
    edges = ((1, 3, "1-3"), (4, 7, "4-7"), (8, 12, "8-12"), (13, 20, "13-20"), (21, 40, "21-40"), (41, 1 << 30, "41+"))
    s = _sentences(spark, d).filter("words > 0")
    bucket = F.coalesce(*[F.when(F.col("words").between(a, b), F.lit(name)) for a, b, name in edges])
    counts = s.groupBy("is_from_me", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(m, name) for m in (0, 1) for _, _, name in edges], "is_from_me int, bucket string")
    return every.join(counts, ["is_from_me", "bucket"], "left").na.fill(0, ["n"])


def symbol_top(spark: SparkSession, d: str) -> DataFrame:
    """The symbols that texts hold most, by code point ranges (the emoji query on a corpus without emoji)."""
    s = corpus(spark, d).select("is_from_me", F.explode(F.regexp_extract_all("text", F.lit(r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E -⯿]"), F.lit(0))).alias("symbol"))
    return s.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("is_from_me").alias("me")).orderBy(F.desc("n"), "symbol").limit(30)


def pii_redaction_counts(spark: SparkSession, d: str) -> DataFrame:
    r = corpus(spark, d).select("category", text.redacted(F.col("text")).alias("r"))
    return r.groupBy("category").agg(F.sum("r.emails").alias("emails"), F.sum("r.phones").alias("phones"), F.sum("r.addresses").alias("addresses"), F.sum("r.names").alias("names"))


def lexicon_rates(spark: SparkSession, d: str) -> DataFrame:
    """Texts by month and sender with a word of the list, and how many such words they hold."""
    hits = F.size(F.filter(text.ascii_tokens(F.col("text")), lambda w: w.isin(*TERM_LEXICON)))
    c = corpus(spark, d).withColumn("hits", hits)
    return c.groupBy("month", "is_from_me").agg(F.count("*").alias("n"), F.count_if(F.col("hits") > 0).alias("texts"), F.sum("hits").alias("hits"), js_round(F.count_if(F.col("hits") > 0) / F.count("*")).alias("rate"))


def negation_tags(spark: SparkSession, d: str) -> DataFrame:
    """Words within four after a negator; the corpus's `no` and `not` are negators."""
    t = text_messages(spark, d).select("id", F.explode(text.negated(text.base_tokens(F.col("text"), 1, 40))).alias("w"))
    return t.groupBy("id").agg(F.count_if(F.col("w").endswith("_NEG")).alias("tagged"), F.count("*").alias("n"))


def search_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Texts with the phrase as whole words, with the text around its first place."""
    padded = F.concat(F.lit(" "), F.array_join(text.ascii_tokens(F.col("text")), " "), F.lit(" "))
    c = corpus(spark, d).withColumn("p", padded).withColumn("at", F.instr("p", f" {PHRASE} ")).filter("at > 0")
    return c.select("id", F.substring("p", F.greatest(F.col("at") - 20, F.lit(1)), F.lit(40 + len(PHRASE))).alias("snippet")).orderBy(F.desc("id")).limit(100)


def search_bm25(spark: SparkSession, d: str) -> DataFrame:
    """The texts that best match any of the terms, by BM25 (k1 1.2, b 0.75)."""
    t = _tokens(spark, d)
    size = t.groupBy("id").agg(F.count("*").alias("size"))
    corpus_stats = size.agg(F.count("*").alias("docs"), F.avg("size").alias("mean"))
    tf = t.filter(F.col("word").isin(*TERMS)).groupBy("id", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    j = tf.join(F.broadcast(df), "word").join(size, "id").join(F.broadcast(corpus_stats))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("size") / F.col("mean")))
    return j.groupBy("id").agg(js_round(F.sum(part), 4).alias("score")).orderBy(F.desc("score"), "id").limit(50)


def lexical_cosine_monthly(spark: SparkSession, d: str) -> DataFrame:
    """How alike both senders' word counts are, month by month."""
    c = _tokens(spark, d).groupBy("month", "word").agg(F.count_if(F.col("is_from_me") == 1).alias("a"), F.count_if(F.col("is_from_me") == 0).alias("b"))
    a, b = F.sum(F.col("a") * F.col("a")), F.sum(F.col("b") * F.col("b"))
    cosine = F.when((a > 0) & (b > 0), F.sum(F.col("a") * F.col("b")) / F.sqrt(a.cast("double") * b)).otherwise(0.0)
    return c.groupBy("month").agg(js_round(cosine).alias("cosine"), F.sum("a").alias("me_tokens"), F.sum("b").alias("them_tokens"))


def signature_words(spark: SparkSession, d: str) -> DataFrame:
    c = _tokens(spark, d).groupBy("word").agg(F.count_if(F.col("is_from_me") == 1).alias("me"), F.count_if(F.col("is_from_me") == 0).alias("them"))
    totals = c.agg(F.sum("me").alias("n_me"), F.sum("them").alias("n_them"), F.count("*").alias("vocabulary"))
    z = stats.flat_log_odds_z(F.col("me"), F.col("them"), F.col("n_me"), F.col("n_them"), F.col("vocabulary"))
    return c.filter("me + them >= 25 and me >= 2 and them >= 2").join(F.broadcast(totals)).select("word", "me", "them", js_round(z, 4).alias("z"))


def word_adoption(spark: SparkSession, d: str) -> DataFrame:
    """Words that one side takes up at least two months after the other."""
    c = _tokens(spark, d).groupBy("word", "month").agg(F.count_if(F.col("is_from_me") == 1).alias("me"), F.count_if(F.col("is_from_me") == 0).alias("them"))
    per = c.groupBy("word").agg(F.min(F.when(F.col("me") >= 2, F.col("month"))).alias("me_first"), F.min(F.when(F.col("them") >= 2, F.col("month"))).alias("them_first"), F.sum("me").alias("me"), F.sum("them").alias("them"))
    kept = per.filter("me_first is not null and them_first is not null and abs(me_first - them_first) >= 2 and me + them >= 40 and me >= 8 and them >= 8")
    return kept.select("word", "me_first", "them_first", "me", "them", F.when(F.col("me_first") < F.col("them_first"), "me").otherwise("them").alias("leader"))


def echo_returns(spark: SparkSession, d: str) -> DataFrame:
    """Bigrams of 5 to 180 texts that come back after four months or more without them."""
    g = corpus(spark, d).select("month", F.explode(F.array_distinct(text.ngrams(text.ascii_tokens(F.col("text")), 2))).alias("gram"))
    by = g.groupBy("gram", "month").agg(F.count("*").alias("n"))
    w = Window.partitionBy("gram")
    r = by.withColumns({"uses": F.sum("n").over(w), "gap": F.col("month") - F.lag("month").over(w.orderBy("month"))}).filter("uses between 5 and 180 and gap >= 4")
    return r.groupBy("gram").agg(F.first("uses").alias("uses"), F.count("*").alias("returns"), F.max("gap").alias("longest"))


def ritual_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Two- and three-word phrases, once a text, that occur in 35 texts, 3 months or more."""
    t = text.ascii_tokens(F.col("text"))
    grams = F.array_distinct(F.concat(text.ngrams(t, 2), text.ngrams(t, 3)))
    g = corpus(spark, d).select("id", "month", F.explode(grams).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("texts"), F.countDistinct("month").alias("months")).filter("texts >= 35 and months >= 3")


def move_kinds(spark: SparkSession, d: str) -> DataFrame:
    m = text_messages(spark, d)
    return m.withColumn("move", text.move(F.col("text"), F.lit(False))).groupBy("is_from_me", "move").agg(F.count("*").alias("n"))


def opener_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first words of conversations, by how often they open one."""
    m = text_messages(spark, d).filter("amt is null")
    first = m.groupBy("chat_id").agg(F.min_by("text", F.struct("ts", "id")).alias("text"))
    return first.withColumn("opener", F.get(text.ascii_tokens(F.col("text")), 0)).filter("opener is not null").groupBy("opener").agg(F.count("*").alias("n"))


_GRAMS = f"""{CORPUS}, t AS (SELECT id, is_from_me, month, {LETTER_TOKENS} AS w FROM corpus)"""


def _grams(tokens: str, n: int) -> str:
    """The n-grams of a token list, by windows over positions: slices of long lists would be copied again and again."""
    joined = "word" + "".join(f" || ' ' || lead(word, {i}) OVER w" for i in range(1, n))
    return f"""SELECT * FROM (SELECT id, is_from_me, month, {joined} AS gram FROM (SELECT id, is_from_me, month, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM {tokens}) WINDOW w AS (PARTITION BY id ORDER BY pos)) WHERE gram IS NOT NULL"""


_GRAM = {n: f"{_GRAMS}, g AS ({_grams('t', n)})" for n in (1, 2, 3)}
_COUNTS = "c AS (SELECT gram, count(*) FILTER (is_from_me = 1) AS me, count(*) FILTER (is_from_me = 0) AS them FROM g GROUP BY 1)"
_AT = f"{CORPUS}, k AS (SELECT id, is_from_me, month, unnest({ASCII_TOKENS}) AS word FROM corpus)"


def _z(least: int) -> str:
    a = "(100.0 * ((me + them) / (n_me + n_them)))"
    delta = f"(ln((me + {a}) / (n_me + 100.0 - me - {a})) - ln((them + {a}) / (n_them + 100.0 - them - {a})))"
    z = f"{delta} / sqrt(1 / (me + {a}) + 1 / (them + {a}))"
    return f"n AS (SELECT sum(me) AS n_me, sum(them) AS n_them FROM c) SELECT gram, me, them, {rounded(z, 4)} AS z FROM c, n WHERE me + them >= {least}"


_SENT = f"""{CORPUS}, s0 AS (SELECT is_from_me, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?]+)\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS s FROM corpus),
s AS (SELECT *, len(regexp_extract_all(lower(s), '[a-z0-9]+')) AS words FROM s0)"""
_TERMS = ", ".join(f"'{t}'" for t in TERMS)
_LEXICON = ", ".join(f"'{t}'" for t in TERM_LEXICON)
_PERSONAL = {k: "'" + v.replace("WORD", r"\b").replace("'", "''") + "'" for k, v in text.PERSONAL.items()}
_BASE = """list_filter(list_transform(string_split(regexp_replace(translate(lower(text), '’‘', ''''''), '[^a-z0-9'' ]', ' ', 'g'), ' '), lambda w: regexp_replace(w, '^''+|''+$', '', 'g')), lambda w: length(w) BETWEEN {a} AND {b})"""


def _moves() -> str:
    out = []
    for kind, pattern in text.MOVES:
        if kind == "question":
            test = f"contains(text, '?') OR regexp_matches(lower(text), '^({text.QUESTION_OPENERS})([^A-Za-z0-9_]|$)')"
        elif kind == "object":
            test = f"regexp_matches(lower(text), {bounded('photo|picture|pic|screenshot|link|look at|lookit|sent you')}) OR regexp_matches(lower(text), 'https?://')"
        else:
            test = f"regexp_matches(lower(text), {bounded(pattern)})"
        out.append(f"WHEN {test} THEN '{kind}'")
    return " ".join(out)


_NEG = ", ".join("'" + w.replace("'", "''") + "'" for w in text.NEGATORS)

ORACLE_SQL = {
    "top_words": f"WITH {_AT} SELECT word, count(*) AS n, count(DISTINCT is_from_me) AS senders FROM k GROUP BY 1 ORDER BY n DESC, word LIMIT 200",
    "token_counts": f"WITH {CORPUS}, k AS (SELECT is_from_me, unnest({_BASE.format(a=2, b=24)}) AS word FROM corpus) SELECT word, count(*) FILTER (is_from_me = 1) AS me, count(*) FILTER (is_from_me = 0) AS them FROM k GROUP BY 1",
    "word_divergence": f"WITH {_GRAM[1]}, {_COUNTS}, {_z(10)}",
    "phrase_divergence": f"WITH {_GRAM[2]}, {_COUNTS}, {_z(5)}",
    "iconic_words": f"""WITH {_GRAM[1]}, {_COUNTS}, n AS (SELECT sum(me) AS n_me, sum(them) AS n_them FROM c),
l AS (SELECT gram, me, them, pow(10.0, CASE WHEN length(gram) % 6 = 0 THEN 1.0 ELSE length(gram) % 6 END - 9) AS base, n_me, n_them FROM c, n WHERE me + them >= 10),
f AS (SELECT *, least(me / n_me / base, them / n_them / base) AS lift FROM l) SELECT gram, me, them, {rounded('log10(lift)', 4)} AS iconic FROM f WHERE lift > 0""",
    "bigram_counts": f"WITH {_GRAM[2]}, {_COUNTS} SELECT * FROM c WHERE me + them >= 10",
    "trigram_counts": f"WITH {_GRAM[3]}, {_COUNTS} SELECT * FROM c WHERE me + them >= 5",
    "gram_grouping_sets": f"WITH {_GRAM[2]} SELECT gram, CASE WHEN is_from_me = 1 THEN 'me' ELSE 'them' END AS sender, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= 10 UNION ALL SELECT gram, 'all', count(*) FROM g GROUP BY 1 HAVING count(*) >= 10",
    "collocations_llr_pmi_t": f"""WITH {_GRAM[2]}, c AS (SELECT gram, split_part(gram, ' ', 1) AS w1, split_part(gram, ' ', 2) AS w2, CAST(count(*) AS DOUBLE) AS c12 FROM g GROUP BY 1),
x AS (SELECT *, sum(c12) OVER (PARTITION BY w1) AS c1, sum(c12) OVER (PARTITION BY w2) AS c2, sum(c12) OVER () AS n FROM c),
y AS (SELECT *, c1 - c12 AS b, c2 - c12 AS cc, n - c1 - c2 + c12 AS r FROM x WHERE c12 >= 10),
e AS (SELECT *, c1 * c2 / n AS ea, c1 * (n - c2) / n AS eb, (n - c1) * c2 / n AS ec, (n - c1) * (n - c2) / n AS ed FROM y)
SELECT gram, CAST(c12 AS BIGINT) AS c12, {rounded("2 * (" + " + ".join(f"CASE WHEN {o} > 0 AND {x} > 0 THEN {o} * ln({o} / {x}) ELSE 0 END" for o, x in (("c12", "ea"), ("b", "eb"), ("cc", "ec"), ("r", "ed"))) + ")", 3)} AS llr,
 {rounded('log2((c12 / n) / ((c1 / n) * (c2 / n)))', 4)} AS pmi, {rounded('(c12 - c1 * c2 / n) / sqrt(c12)', 4)} AS tscore FROM e""",
    "sentence_stats": f"""WITH {_SENT} SELECT is_from_me, count(*) AS n, {rounded('sum(words) / count(*)')} AS mean_words, {rounded('median(words)')} AS median_words, CAST(list_sort(list(words))[CAST(floor((count(*) - 1) * 0.9) AS BIGINT) + 1] AS INT) AS p90_words,
 {rounded("count(*) FILTER (suffix(s, '?')) / count(*)")} AS question_rate, {rounded("count(*) FILTER (suffix(s, '!')) / count(*)")} AS exclaim_rate FROM s WHERE words > 0 GROUP BY 1""",
    "sentence_hist": f"""WITH {_SENT}, e AS (SELECT * FROM (VALUES (1, 3, '1-3'), (4, 7, '4-7'), (8, 12, '8-12'), (13, 20, '13-20'), (21, 40, '21-40'), (41, 1000000000, '41+')) v(a, b, bucket), (VALUES (0), (1)) u(is_from_me))
SELECT e.is_from_me, e.bucket, count(s.words) AS n FROM e LEFT JOIN s ON s.is_from_me = e.is_from_me AND s.words BETWEEN e.a AND e.b GROUP BY 1, 2""",
    "symbol_top": f"WITH {CORPUS}, k AS (SELECT is_from_me, unnest(regexp_extract_all(text, '[\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E\\x{{2000}}-\\x{{2BFF}}]')) AS symbol FROM corpus) SELECT symbol, count(*) AS n, CAST(sum(is_from_me) AS BIGINT) AS me FROM k GROUP BY 1 ORDER BY n DESC, symbol LIMIT 30",
    "pii_redaction_counts": f"""WITH {CORPUS}, a AS (SELECT category, text, regexp_replace(text, {_PERSONAL['email']}, '[redacted-email]', 'g') AS one FROM corpus),
b AS (SELECT *, regexp_replace(one, {_PERSONAL['phone']}, '[redacted-phone]', 'g') AS two FROM a), c AS (SELECT *, regexp_replace(two, {_PERSONAL['address']}, '[redacted-address]', 'g') AS three FROM b)
SELECT category, CAST(sum(len(regexp_extract_all(text, {_PERSONAL['email']}))) AS BIGINT) AS emails, CAST(sum(len(regexp_extract_all(one, {_PERSONAL['phone']}))) AS BIGINT) AS phones,
  CAST(sum(len(regexp_extract_all(two, {_PERSONAL['address']}))) AS BIGINT) AS addresses,
  CAST(sum(len(list_filter(regexp_extract_all(three, {_PERSONAL['name']}), lambda w: w NOT IN ({', '.join(f"'{w}'" for w in text.NO_NAMES)})))) AS BIGINT) AS names FROM c GROUP BY 1""",
    "lexicon_rates": f"WITH {CORPUS}, h AS (SELECT month, is_from_me, len(list_filter({ASCII_TOKENS}, lambda w: w IN ({_LEXICON}))) AS hits FROM corpus) SELECT month, is_from_me, count(*) AS n, count(*) FILTER (hits > 0) AS texts, CAST(sum(hits) AS BIGINT) AS hits, {rounded('count(*) FILTER (hits > 0) / count(*)')} AS rate FROM h GROUP BY 1, 2",
    "negation_tags": f"""WITH {TEXT_MESSAGES}, w AS (SELECT id, {_BASE.format(a=1, b=40)} AS w FROM text_messages), p AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
q AS (SELECT *, word IN ({_NEG}) AS neg, max(CASE WHEN word IN ({_NEG}) THEN pos END) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM p)
SELECT id, count(*) FILTER (NOT neg AND pos - last <= 4) AS tagged, count(*) AS n FROM q GROUP BY 1""",
    "search_phrase": f"WITH {CORPUS}, p AS (SELECT id, ' ' || array_to_string({ASCII_TOKENS}, ' ') || ' ' AS p FROM corpus), a AS (SELECT *, instr(p, ' {PHRASE} ') AS pos FROM p) SELECT id, substring(p, greatest(pos - 20, 1), {40 + len(PHRASE)}) AS snippet FROM a WHERE pos > 0 ORDER BY id DESC LIMIT 100",
    "search_bm25": f"""WITH {_AT}, z AS (SELECT id, count(*) AS size FROM k GROUP BY 1), s AS (SELECT count(*) AS docs, avg(size) AS mean FROM z), tf AS (SELECT id, word, count(*) AS tf FROM k WHERE word IN ({_TERMS}) GROUP BY 1, 2),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1) SELECT id, {rounded('sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)))', 4)} AS score FROM tf JOIN df USING (word) JOIN z USING (id), s GROUP BY 1 ORDER BY score DESC, id LIMIT 50""",
    "lexical_cosine_monthly": f"""WITH {_AT}, c AS (SELECT month, word, count(*) FILTER (is_from_me = 1) AS a, count(*) FILTER (is_from_me = 0) AS b FROM k GROUP BY 1, 2)
SELECT month, {rounded('CASE WHEN sum(a * a) > 0 AND sum(b * b) > 0 THEN sum(a * b) / sqrt(CAST(sum(a * a) AS DOUBLE) * sum(b * b)) ELSE 0 END')} AS cosine, CAST(sum(a) AS BIGINT) AS me_tokens, CAST(sum(b) AS BIGINT) AS them_tokens FROM c GROUP BY 1""",
    "signature_words": f"""WITH {_AT}, c AS (SELECT word, count(*) FILTER (is_from_me = 1) AS me, count(*) FILTER (is_from_me = 0) AS them FROM k GROUP BY 1), n AS (SELECT sum(me) AS n_me, sum(them) AS n_them, count(*) AS v FROM c)
SELECT word, me, them, {rounded('(ln((me + 0.1) / (n_me - me + 0.1 * v)) - ln((them + 0.1) / (n_them - them + 0.1 * v))) / sqrt(1 / (me + 0.1) + 1 / (them + 0.1))', 4)} AS z FROM c, n WHERE me + them >= 25 AND me >= 2 AND them >= 2""",
    "word_adoption": f"""WITH {_AT}, c AS (SELECT word, month, count(*) FILTER (is_from_me = 1) AS me, count(*) FILTER (is_from_me = 0) AS them FROM k GROUP BY 1, 2),
p AS (SELECT word, min(month) FILTER (me >= 2) AS me_first, min(month) FILTER (them >= 2) AS them_first, CAST(sum(me) AS BIGINT) AS me, CAST(sum(them) AS BIGINT) AS them FROM c GROUP BY 1)
SELECT *, CASE WHEN me_first < them_first THEN 'me' ELSE 'them' END AS leader FROM p WHERE abs(me_first - them_first) >= 2 AND me + them >= 40 AND me >= 8 AND them >= 8""",
    "echo_returns": f"""WITH {CORPUS}, t AS (SELECT id, is_from_me, month, {ASCII_TOKENS} AS w FROM corpus), g AS (SELECT DISTINCT id, month, gram FROM ({_grams('t', 2)})),
c AS (SELECT gram, count(*) AS uses, count(DISTINCT month) AS months FROM g GROUP BY 1 HAVING count(*) BETWEEN 5 AND 180 AND count(DISTINCT month) >= 2),
b AS (SELECT DISTINCT gram, uses, month FROM g JOIN c USING (gram)), r AS (SELECT *, month - lag(month) OVER (PARTITION BY gram ORDER BY month) AS gap FROM b)
SELECT gram, any_value(uses) AS uses, count(*) AS returns, max(gap) AS longest FROM r WHERE gap >= 4 GROUP BY 1""",
    "ritual_phrases": f"""WITH {CORPUS}, t AS (SELECT id, is_from_me, month, {ASCII_TOKENS} AS w FROM corpus), g AS (SELECT DISTINCT id, month, gram FROM ({_grams('t', 2)} UNION ALL {_grams('t', 3)}))
SELECT gram, count(*) AS texts, count(DISTINCT month) AS months FROM g GROUP BY 1 HAVING count(*) >= 35 AND count(DISTINCT month) >= 3""",
    "move_kinds": f"WITH {TEXT_MESSAGES}, k AS (SELECT is_from_me, CASE {_moves()} ELSE 'ambient' END AS move FROM text_messages) SELECT is_from_me, move, count(*) AS n FROM k GROUP BY 1, 2",
    "opener_lines": f"WITH {TEXT_MESSAGES}, f AS (SELECT chat_id, arg_min(text, (ts, id)) AS text FROM text_messages WHERE amt IS NULL GROUP BY 1), o AS (SELECT {ASCII_TOKENS}[1] AS opener FROM f) SELECT opener, count(*) AS n FROM o WHERE opener IS NOT NULL GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
