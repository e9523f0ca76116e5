"""Graphs, clusters, classifiers and comparisons over embeddings, labels and topics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chorale.functions import stats
from chorale.functions.stats import js_round
from chorale.operators import models
from chorale.operators.models import dot
from chorale.plans.dialect import LINKS, MESSAGES, rounded
from chorale.sources.tables import links, messages, segments, table


def pagerank(spark: SparkSession, d: str) -> DataFrame:
    e = links(segments(spark, d)).filter("from_topic != to_topic").groupBy(F.col("from_topic").alias("a"), F.col("to_topic").alias("b")).agg(F.count("*").alias("w"))
    return models.page_rank(e, 0.84, 42).select(F.col("node").alias("topic_id"), js_round(F.col("rank")).alias("rank"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return v.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v")).withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v"))))


def _centroids(v: DataFrame) -> DataFrame:
    """One array per label: a mean for each dimension, put together in order."""
    e = v.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    c = e.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select("label", F.col("c.x").alias("c"))
    return c.withColumn("cnorm", F.sqrt(dot(F.col("c"), F.col("c"))))


def centroid_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's nearest label centroid by cosine, and the softmax of its similarities times twelve."""
    v = _vectors(spark, d)
    c = _centroids(v).withColumnRenamed("label", "candidate")
    s = v.join(F.broadcast(c)).select("vec_id", "label", "candidate", (dot(F.col("v"), F.col("c")) / (F.col("norm") * F.col("cnorm"))).alias("s"))
    per = s.groupBy("vec_id", "label").agg(F.max_by("candidate", F.struct(js_round(F.col("s"), 9), -F.col("candidate"))).alias("found"), F.max("s").alias("top"), F.sum(F.exp(12 * F.col("s"))).alias("z"))
    return per.select("vec_id", "label", "found", js_round(F.exp(12 * F.col("top")) / F.col("z"), 5).alias("p"))


def confusion_f1(spark: SparkSession, d: str) -> DataFrame:
    c = centroid_classifier(spark, d)
    hit = (F.col("label") == F.col("found")).cast("int")
    gold = c.groupBy("label").agg(F.count("*").alias("gold"), F.sum(hit).alias("tp"))
    found = c.groupBy(F.col("found").alias("label")).agg(F.count("*").alias("predicted"))
    j = gold.join(found, "label", "left").na.fill(0, ["predicted"])
    p, r = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0), F.col("tp") / F.col("gold")
    return j.select("label", "gold", "predicted", "tp", js_round(p).alias("precision"), js_round(r).alias("recall"), js_round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)).alias("f1"))


def representatives(spark: SparkSession, d: str) -> DataFrame:
    """The five vectors closest to their label's centroid."""
    v = _vectors(spark, d)
    s = v.join(F.broadcast(_centroids(v)), "label").select("label", "vec_id", js_round(dot(F.col("v"), F.col("c")) / (F.col("norm") * F.col("cnorm")), 6).alias("similarity"))
    w = Window.partitionBy("label").orderBy(F.desc("similarity"), "vec_id")
    return s.withColumn("at", F.row_number().over(w)).filter("at <= 5")


#: A label's vectors are dealt over so many parts, each of which keeps a query's nearest.
PARTS = 16


def nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """For every vector whose id is divisible by 100, its six nearest among all of its label. The label's vectors are dealt over
    parts and its queries go to each; a part keeps six a query, and the last ranking sees six of each part."""
    v = _vectors(spark, d)
    q = v.filter("vec_id % 100 = 0").select("label", F.col("vec_id").alias("id"), F.col("v").alias("av"), F.col("norm").alias("an"))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    b = v.select("label", F.col("vec_id").alias("other"), F.col("v").alias("bv"), F.col("norm").alias("bn"), F.pmod(F.xxhash64("vec_id"), F.lit(PARTS)).cast("int").alias("part"))
    s = b.join(q, ["label", "part"]).filter("id != other").select("id", "part", "other", js_round(dot(F.col("av"), F.col("bv")) / (F.col("an") * F.col("bn")), 6).alias("similarity"))
    for by in (["id", "part"], ["id"]):
        s = s.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("similarity"), "other"))).filter("at <= 6")
    return s.select("id", "other", "similarity", "at")


RESAMPLES = 5


def label_stability(spark: SparkSession, d: str) -> DataFrame:
    """How well a label's members are found again by centroids from 80 % of them: the mean and least Jaccard, and the mean
    number found, over five resamples that each leave another fifth of the ids out."""
    v = _vectors(spark, d).select("vec_id", "label", F.transform("v", lambda x: x / F.col("norm")).alias("v"))
    fold = F.explode(F.sequence(F.lit(0), F.lit(RESAMPLES - 1))).alias("fold")
    e = v.select("vec_id", "label", "v", fold).filter(F.col("vec_id") % RESAMPLES != F.col("fold")).select("fold", "label", F.posexplode("v").alias("i", "x"))
    means = e.groupBy("fold", "label", "i").agg(F.avg("x").alias("x")).groupBy("fold", "label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"))
    c = means.select("fold", F.col("label").alias("k"), F.col("c.x").alias("c")).withColumn("cnorm", F.sqrt(dot(F.col("c"), F.col("c"))))
    s = v.join(F.broadcast(c)).select("vec_id", "label", "fold", "k", js_round(dot(F.col("v"), F.col("c")) / F.col("cnorm"), 9).alias("s"))
    found = s.groupBy("vec_id", "label", "fold").agg(F.max_by("k", F.struct("s", -F.col("k"))).alias("k"))
    ends = found.select("fold", "label", F.lit(1).alias("own"), (F.col("label") == F.col("k")).cast("int").alias("both"))
    ends = ends.union(found.select("fold", F.col("k").alias("label"), F.lit(0).alias("own"), (F.col("label") == F.col("k")).cast("int").alias("both")))
    own, both, hits = F.sum("own"), F.sum(F.col("own") * F.col("both")), F.sum(1 - F.col("own"))
    per = ends.groupBy("label", "fold").agg((both / (own + hits - both)).alias("jaccard"), hits.alias("members"))
    return per.groupBy("label").agg(js_round(F.avg("jaccard")).alias("jaccard_mean"), js_round(F.min("jaccard")).alias("jaccard_min"), js_round(F.avg("members")).alias("member_count_mean"))


def kmeans_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Six clusters of all vectors, by the distributed k-means of Spark's ML library; the exact seeded form is in operators/models.py."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=6, maxIter=36, seed=94337, predictionCol="cluster").fit(v).transform(v).select("vec_id", "cluster")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with a score between 0 and 1 that rises with their length."""
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("chars"))
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "quality", "chars", (F.col("chars") / (F.col("chars") + 1000)).alias("score"))


def auc_rank(spark: SparkSession, d: str) -> DataFrame:
    """By rank sums over score classes: ties share their mean rank, which needs no order of rows."""
    c = _scored(spark, d).groupBy("chars").agg(F.sum("quality").alias("pos"), F.sum(1 - F.col("quality")).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(F.lit(0)).orderBy("chars").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return c.withColumn("below", below).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), js_round(wins / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    """Predicted and observed rates by tenths of the score, beside the lift of the top fifth of scores over all."""
    s = _scored(spark, d)
    cut = s.agg(F.percentile("chars", 0.8).alias("cut"))
    top = s.join(F.broadcast(cut)).agg(js_round(F.avg(F.when(F.col("chars") >= F.col("cut"), F.col("quality"))) / F.avg("quality")).alias("top_lift"))
    b = F.least(F.floor(F.col("score") * 10), F.lit(9)).alias("bin")
    bins = s.groupBy(b).agg(F.count("*").alias("n"), F.sum("quality").alias("positives"), js_round(F.avg("score")).alias("predicted"), js_round(F.sum("quality") / F.count("*")).alias("observed"))
    return bins.join(F.broadcast(top))


#: The distribution function of Poisson(1), in millionths.
POISSON = (367_879, 735_759, 919_699, 981_012, 996_340, 999_406, 999_917)


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """The AUC's interval from 500 resamples of blocks of 14 ids: a block's weight in a sample is a Poisson draw from its
    hash, so every task draws alike, and what is shuffled is one row per sample and score class."""
    s = _scored(spark, d).withColumn("block", F.floor(F.col("doc_id") / 14))
    draws = s.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(500))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", "block", "sample")), 1, 8), 16, 10).cast("long") % 1_000_000
    weight = sum((F.when(u >= x, 1).otherwise(0) for x in POISSON), F.lit(0))
    c = draws.withColumn("w", weight).groupBy("sample", "chars").agg(F.sum(F.col("w") * F.col("quality")).alias("pos"), F.sum(F.col("w") * (1 - F.col("quality"))).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("sample").orderBy("chars").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pos, neg = F.sum("pos"), F.sum("neg")
    a = c.withColumn("below", below).groupBy("sample").agg(F.when((pos > 0) & (neg > 0), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (pos * neg)).otherwise(0.5).alias("auc"))
    ci = a.agg(js_round(stats.quantile_floor("auc", 0.025)).alias("low"), js_round(stats.quantile_floor("auc", 0.975)).alias("high"))
    return auc_rank(spark, d).select("auc").join(F.broadcast(ci))


def logistic_fit(spark: SparkSession, d: str) -> DataFrame:
    """Weights of quality on length and its logarithm, trained on the lower 72 % of ids. Rows are first counted by length
    and label, at most 8,000 classes, so the gradient runs over counts however large the table."""

    def fit(t: pd.DataFrame) -> pd.DataFrame:
        n = t["n"].to_numpy(dtype=float)
        x = np.stack([t["chars"] / 4000, np.log1p(t["chars"])], axis=1)
        mean = np.average(x, axis=0, weights=n)
        sd = np.maximum(np.sqrt(np.average((x - mean) ** 2, axis=0, weights=n)), 1e-3)
        weights, bias = models.logistic((x - mean) / sd, t["quality"].to_numpy(dtype=float), n)
        return pd.DataFrame({"feature": ["length", "log_length", "bias"], "weight": [*weights, bias]})

    s = _scored(spark, d)
    train = s.join(F.broadcast(s.agg(F.percentile("doc_id", 0.72).alias("cut")))).filter("doc_id <= cut")
    return train.groupBy("chars", "quality").agg(F.count("*").alias("n")).withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(fit, "feature string, weight double")


MATCHES, YEARS = 5, 2


def knn_matches(spark: SparkSession, d: str) -> DataFrame:
    """For each message after six hours of silence with an attachment, the five most alike ones without: nearest by gap and
    words, among those of its sender and class of gap at most two years off; where these are fewer than five, of any
    year; where these are too few as well, of its sender. Which set a message needs is counted first, cell by cell."""
    w = Window.partitionBy("chat_id").orderBy("ts", "id")
    gap_class = F.when(F.col("gap") < 28800, 0).when(F.col("gap") < 43200, 1).otherwise(2)
    m = messages(spark, d).withColumn("gap", F.col("ts") - F.lag("ts").over(w)).filter("gap >= 21600").withColumns({"gap_class": gap_class, "year": F.year(F.timestamp_seconds("ts"))})
    t = m.filter("has_attachment = 1").select("is_from_me", "gap_class", "year", F.col("id").alias("treated"), F.col("gap").alias("tg"), F.col("word_count").alias("tw"), F.col("ts").alias("tt"))
    c = m.filter("has_attachment = 0").select("is_from_me", "gap_class", F.col("year").alias("cy"), F.col("id").alias("control"), "gap", "word_count", "ts")
    # one row for each sender, class and year: few, whatever the log
    cells = c.groupBy("is_from_me", "gap_class", "cy").agg(F.count("*").alias("k"))
    near = F.coalesce(F.sum(F.when(F.abs(F.col("cy") - F.col("year")) <= YEARS, F.col("k"))), F.lit(0))
    keys = t.select("is_from_me", "gap_class", "year").distinct().join(F.broadcast(cells), ["is_from_me", "gap_class"], "left").groupBy("is_from_me", "gap_class", "year")
    tiers = keys.agg(F.when(near >= MATCHES, 1).when(F.coalesce(F.sum("k"), F.lit(0)) >= MATCHES, 2).otherwise(3).alias("tier"))
    tiered = t.join(F.broadcast(tiers), ["is_from_me", "gap_class", "year"])
    cell = tiered.filter("tier < 3").join(c, ["is_from_me", "gap_class"]).filter((F.col("tier") == 2) | (F.abs(F.col("cy") - F.col("year")) <= YEARS))
    sender = tiered.filter("tier = 3").drop("gap_class").join(c.drop("gap_class"), "is_from_me")
    columns = ["treated", "control", "tg", "tw", "tt", "gap", "word_count", "ts"]
    distance = F.sqrt(F.pow((F.col("gap") - F.col("tg")) / 3600, 2) + 0.5 * F.pow((F.col("word_count") - F.col("tw")) / 10, 2))
    j = cell.select(*columns).union(sender.select(*columns)).withColumn("distance", js_round(distance))
    r = Window.partitionBy("treated").orderBy("distance", F.abs(F.col("ts") - F.col("tt")), "control")
    return j.withColumn("at", F.row_number().over(r)).filter(F.col("at") <= MATCHES).select("treated", "control", "distance", "at")


def matched_effects(spark: SparkSession, d: str) -> DataFrame:
    """What treated messages have over their controls, on the mean of each one's matches."""
    k = knn_matches(spark, d)
    m = messages(spark, d).select("id", "word_count")
    j = k.join(m.select(F.col("id").alias("treated"), F.col("word_count").alias("t")), "treated").join(m.select(F.col("id").alias("control"), F.col("word_count").alias("c")), "control")
    per = j.groupBy("treated").agg(F.first("t").alias("t"), F.sum("c").alias("c"), F.count("*").alias("k"))
    delta = F.col("t") - F.col("c") / F.col("k")
    return per.agg(F.count("*").alias("treated"), js_round(F.avg(delta)).alias("effect"), js_round(F.coalesce(F.stddev_samp(delta), F.lit(0.0)), 4).alias("sd"))


def balance_smd(spark: SparkSession, d: str) -> DataFrame:
    """Standardised mean differences of words between messages with and without an attachment, by chat."""
    g = messages(spark, d).groupBy("chat_id").agg(
        *[f(F.when(F.col("has_attachment") == x, F.col("word_count"))).alias(f"{n}{x}") for x in (0, 1) for n, f in (("mean", F.avg), ("var", F.var_samp))], F.sum("has_attachment").alias("treated")
    )
    sd = F.sqrt((F.col("var0") + F.col("var1")) / 2)
    smd = js_round(F.when(sd > 0, (F.col("mean1") - F.col("mean0")) / sd).otherwise(0.0))
    return g.filter("treated >= 2").select("chat_id", smd.alias("smd"), F.when(F.abs(smd) <= 0.1, "good").when(F.abs(smd) <= 0.25, "watch").otherwise("poor").alias("verdict"))


def cohort_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The three chats most like each, by the root mean square of standardised metrics: one row per chat, so pairs are few."""
    c = messages(spark, d).groupBy("chat_id").agg(F.avg("is_from_me").alias("a"), F.avg("word_count").alias("b"), F.avg("has_attachment").alias("c"))
    s = c.agg(*[f(x).alias(f"{n}_{x}") for x in "abc" for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = c.join(F.broadcast(s)).select("chat_id", *[((F.col(x) - F.col(f"m_{x}")) / F.when(F.col(f"s_{x}") == 0, 1.0).otherwise(F.col(f"s_{x}"))).alias(x) for x in "abc"])
    o = z.select(F.col("chat_id").alias("other"), *[F.col(x).alias(f"{x}2") for x in "abc"])
    distance = F.sqrt(sum((F.pow(F.col(x) - F.col(f"{x}2"), 2) for x in "abc"), F.lit(0.0)) / 3)
    j = z.join(F.broadcast(o), F.col("chat_id") != F.col("other")).select("chat_id", "other", js_round(distance).alias("distance"))
    w = Window.partitionBy("chat_id").orderBy("distance", "other")
    return j.withColumn("at", F.row_number().over(w)).filter("at <= 3").withColumn("similarity", js_round(F.exp(-F.col("distance") / 2.35)))


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Counts by category before and after the middle of the month, side by side, with the change in percent."""
    m = messages(spark, d)
    a = m.filter("ts < 1705363200").groupBy("category").agg(F.count("*").alias("before"))
    b = m.filter("ts >= 1705363200").groupBy("category").agg(F.count("*").alias("after"))
    j = a.join(b, "category", "full_outer").na.fill(0, ["before", "after"])
    return j.withColumn("change", js_round(F.when(F.col("before") > 0, 100.0 * (F.col("after") - F.col("before")) / F.col("before"))))


_VEC = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), e AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
cen AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM e GROUP BY 1, 2) GROUP BY 1)"""
_COS = "list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c, c)))"
_CLASS = f"""{_VEC}, s AS (SELECT vec_id, v.label, cen.label AS k, {_COS} AS s FROM v, cen), cls AS (SELECT vec_id, label, arg_max(k, ({rounded('s', 9)}, -k)) AS found, max(s) AS top, sum(exp(12 * s)) AS z FROM s GROUP BY 1, 2)"""
_SCORED = "sc AS (SELECT doc_id, quality, n_chars AS chars, n_chars / (n_chars + 1000) AS score FROM labels JOIN documents USING (doc_id))"
_MATCH = f"""{MESSAGES}, g0 AS (SELECT *, ts - lag(ts) OVER (PARTITION BY chat_id ORDER BY ts, id) AS gap FROM messages),
g AS (SELECT *, CASE WHEN gap < 28800 THEN 0 WHEN gap < 43200 THEN 1 ELSE 2 END AS gc, year(to_timestamp(ts)) AS y FROM g0 WHERE gap >= 21600),
b AS (SELECT t.id AS treated, c.id AS control, sqrt(pow((c.gap - t.gap) / 3600, 2) + 0.5 * pow((c.word_count - t.word_count) / 10, 2)) AS raw, abs(c.ts - t.ts) AS dt, t.word_count AS tw, c.word_count AS cw,
 CASE WHEN t.gc <> c.gc THEN 3 WHEN abs(t.y - c.y) > {YEARS} THEN 2 ELSE 1 END AS ring FROM g t JOIN g c ON t.is_from_me = c.is_from_me WHERE t.has_attachment = 1 AND c.has_attachment = 0),
tr AS (SELECT treated, CASE WHEN count(*) FILTER (ring = 1) >= {MATCHES} THEN 1 WHEN count(*) FILTER (ring <= 2) >= {MATCHES} THEN 2 ELSE 3 END AS tier FROM b GROUP BY 1),
j AS (SELECT b.*, {rounded('raw')} AS distance FROM b JOIN tr USING (treated) WHERE ring <= tier),
knn AS (SELECT *, row_number() OVER (PARTITION BY treated ORDER BY distance, dt, control) AS at_ FROM j QUALIFY at_ <= {MATCHES})"""
_RANKS = "r0 AS (SELECT node, 1.0 / count(*) OVER () AS r FROM nodes)"


def _pagerank_sql() -> str:
    rounds = [
        f"r{i + 1} AS (SELECT n.node, 0.16 / c.k + 0.84 * coalesce(i.s, 0) + 0.84 * (SELECT coalesce(sum(r), 0) FROM r{i} WHERE node NOT IN (SELECT a FROM o)) / c.k AS r FROM nodes n CROSS JOIN c LEFT JOIN (SELECT e.b, sum(r{i}.r * e.w / o.t) AS s FROM e JOIN o ON e.a = o.a JOIN r{i} ON r{i}.node = e.a GROUP BY 1) i ON i.b = n.node)"
        for i in range(42)
    ]
    return f"""WITH {LINKS}, e AS MATERIALIZED (SELECT from_topic AS a, to_topic AS b, count(*) AS w FROM links WHERE from_topic <> to_topic GROUP BY 1, 2), o AS MATERIALIZED (SELECT a, sum(w) AS t FROM e GROUP BY 1),
nodes AS MATERIALIZED (SELECT a AS node FROM e UNION SELECT b FROM e), c AS MATERIALIZED (SELECT count(*) AS k FROM nodes), {_RANKS.replace(' AS (', ' AS MATERIALIZED (')}, {", ".join(r.replace(' AS (', ' AS MATERIALIZED (', 1) for r in rounds)} SELECT node AS topic_id, {rounded('r')} AS rank FROM r42"""


ORACLE_SQL = {
    "pagerank": _pagerank_sql(),
    "centroid_classifier": f"WITH {_CLASS} SELECT vec_id, label, found, {rounded('exp(12 * top) / z', 5)} AS p FROM cls",
    "confusion_f1": f"""WITH {_CLASS}, gd AS (SELECT label, count(*) AS gold, count(*) FILTER (label = found) AS tp FROM cls GROUP BY 1), pr AS (SELECT found AS label, count(*) AS predicted FROM cls GROUP BY 1),
m AS (SELECT gd.label, gold, coalesce(predicted, 0) AS predicted, tp, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, tp / gold AS r FROM gd LEFT JOIN pr ON gd.label = pr.label)
SELECT label, gold, predicted, tp, {rounded('p')} AS precision, {rounded('r')} AS recall, {rounded('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END')} AS f1 FROM m""",
    "representatives": f"WITH {_VEC}, s AS (SELECT v.label, vec_id, {rounded(_COS)} AS similarity FROM v JOIN cen ON v.label = cen.label) SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS INT) AS at FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) <= 5",
    "label_stability": f"""WITH u0 AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM u0),
fl AS (SELECT CAST(unnest(range({RESAMPLES})) AS INT) AS fold), e AS (SELECT vec_id, label, fold, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u, fl WHERE vec_id % {RESAMPLES} <> fold),
c AS (SELECT fold, label AS k, list(x ORDER BY i) AS c FROM (SELECT fold, label, i, avg(x) AS x FROM e GROUP BY 1, 2, 3) GROUP BY 1, 2),
p AS (SELECT vec_id, label, fold, arg_max(k, (s, -k)) AS k FROM (SELECT vec_id, label, fold, k, {rounded('list_dot_product(v, c) / sqrt(list_dot_product(c, c))', 9)} AS s FROM u, c) GROUP BY 1, 2, 3),
n AS (SELECT label, fold, count(*) FILTER (own) AS own, count(*) FILTER (NOT own) AS hits, count(*) FILTER (own AND both_) AS both_ FROM (SELECT label, fold, true AS own, label = k AS both_ FROM p UNION ALL SELECT k, fold, false, label = k FROM p) GROUP BY 1, 2)
SELECT label, {rounded('avg(both_ / (own + hits - both_))')} AS jaccard_mean, {rounded('min(both_ / (own + hits - both_))')} AS jaccard_min, {rounded('avg(hits)')} AS member_count_mean FROM n GROUP BY 1""",
    "auc_rank": f"WITH {_SCORED}, c AS (SELECT chars, sum(quality) AS pos, sum(1 - quality) AS neg FROM sc GROUP BY 1), w AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives, {rounded('sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg))')} AS auc FROM w",
    "calibration_bins": f"""WITH {_SCORED}, q AS (SELECT quantile_cont(chars, 0.8) AS cut FROM sc), t AS (SELECT {rounded('avg(quality) FILTER (chars >= cut) / avg(quality)')} AS top_lift FROM sc, q)
SELECT bin, n, positives, predicted, observed, top_lift FROM (SELECT least(CAST(floor(score * 10) AS BIGINT), 9) AS bin, count(*) AS n, CAST(sum(quality) AS BIGINT) AS positives, {rounded('avg(score)')} AS predicted, {rounded('sum(quality) / count(*)')} AS observed FROM sc GROUP BY 1), t""",
    "bootstrap_ci": f"""WITH {_SCORED}, s AS (SELECT CAST(unnest(range(1, 501)) AS INT) AS sample), b AS (SELECT DISTINCT doc_id // 14 AS block FROM sc), u AS (SELECT block, sample, CAST('0x' || substr(md5(block || ':' || sample), 1, 8) AS BIGINT) % 1000000 AS u FROM b, s),
w AS (SELECT block, sample, {" + ".join(f"(u >= {x})::INT" for x in POISSON)} AS w FROM u), c AS (SELECT sample, chars, sum(w * quality) AS pos, sum(w * (1 - quality)) AS neg FROM sc JOIN w ON doc_id // 14 = block GROUP BY 1, 2),
d AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY sample ORDER BY chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
a AS (SELECT sample, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) ELSE 0.5 END AS auc FROM d GROUP BY 1), l AS (SELECT list(auc ORDER BY auc) AS x FROM a),
c0 AS (SELECT chars, sum(quality) AS pos, sum(1 - quality) AS neg FROM sc GROUP BY 1), w0 AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c0)
SELECT (SELECT {rounded('sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg))')} FROM w0) AS auc, {rounded('x[CAST(floor(499 * 0.025) AS INT) + 1]')} AS low, {rounded('x[CAST(floor(499 * 0.975) AS INT) + 1]')} AS high FROM l""",
    "nearest_neighbours": f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT a.vec_id AS id, b.vec_id AS other, {rounded('list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))')} AS similarity FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT id, other, similarity, CAST(row_number() OVER w AS INT) AS "at" FROM s WINDOW w AS (PARTITION BY id ORDER BY similarity DESC, other) QUALIFY row_number() OVER w <= 6""",
    "knn_matches": f"WITH {_MATCH} SELECT treated, control, distance, CAST(at_ AS INT) AS at FROM knn",
    "matched_effects": f"WITH {_MATCH}, d AS (SELECT treated, any_value(tw) - sum(cw) / count(*) AS delta FROM knn GROUP BY 1) SELECT count(*) AS treated, {rounded('avg(delta)')} AS effect, {rounded('coalesce(stddev_samp(delta), 0)', 4)} AS sd FROM d",
    "balance_smd": f"""WITH {MESSAGES}, g AS (SELECT chat_id, avg(word_count) FILTER (has_attachment = 0) AS m0, avg(word_count) FILTER (has_attachment = 1) AS m1, var_samp(word_count) FILTER (has_attachment = 0) AS v0, var_samp(word_count) FILTER (has_attachment = 1) AS v1, sum(has_attachment) AS t FROM messages GROUP BY 1),
s AS (SELECT chat_id, {rounded('CASE WHEN sqrt((v0 + v1) / 2) > 0 THEN (m1 - m0) / sqrt((v0 + v1) / 2) ELSE 0 END')} AS smd FROM g WHERE t >= 2) SELECT chat_id, smd, CASE WHEN abs(smd) <= 0.1 THEN 'good' WHEN abs(smd) <= 0.25 THEN 'watch' ELSE 'poor' END AS verdict FROM s""",
    "cohort_neighbours": f"""WITH {MESSAGES}, c AS (SELECT chat_id, avg(is_from_me) AS a, avg(word_count) AS b, avg(has_attachment) AS c FROM messages GROUP BY 1), s AS (SELECT avg(a) ma, stddev_pop(a) sa, avg(b) mb, stddev_pop(b) sb, avg(c) mc, stddev_pop(c) sc FROM c),
z AS (SELECT chat_id, (a - ma) / CASE WHEN sa = 0 THEN 1 ELSE sa END AS a, (b - mb) / CASE WHEN sb = 0 THEN 1 ELSE sb END AS b, (c - mc) / CASE WHEN sc = 0 THEN 1 ELSE sc END AS c FROM c, s),
j AS (SELECT x.chat_id, y.chat_id AS other, {rounded('sqrt((pow(x.a - y.a, 2) + pow(x.b - y.b, 2) + pow(x.c - y.c, 2)) / 3)')} AS distance FROM z x JOIN z y ON x.chat_id <> y.chat_id)
SELECT *, CAST(row_number() OVER (PARTITION BY chat_id ORDER BY distance, other) AS INT) AS at, {rounded('exp(-distance / 2.35)')} AS similarity FROM j QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY distance, other) <= 3""",
    "snapshot_diff": f"WITH {MESSAGES}, c AS (SELECT category, count(*) FILTER (ts < 1705363200) AS before, count(*) FILTER (ts >= 1705363200) AS after FROM messages GROUP BY 1) SELECT *, {rounded('CASE WHEN before > 0 THEN 100.0 * (after - before) / before END')} AS change FROM c",
}
QUERIES = {name: globals()[name] for name in [*ORACLE_SQL, "kmeans_vectors", "logistic_fit"]}
