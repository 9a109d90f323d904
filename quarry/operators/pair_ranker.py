"""A learned pair scorer (R10): features of (query, document) pairs, weights from ordered pairs, scored in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.vectors import cosine, round_half_away
from quarry.operators.common import rank_within
from quarry.operators.rerank import bm25_plus, token_overlap

FEATURES = ["bm25", "similarity", "overlap", "length"]
PARTNERS = 20  # negatives that a positive is held against in training, drawn by a hash


def pair_features(run: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, topic: str = "topic", id_col: str = "id") -> DataFrame:
    """``topic, id`` and ``FEATURES`` of every candidate (topic, id, text): BM25Plus of the topic's query (topic, query) among
    the topic's candidates, cosine of the candidate's vector (id, embedding) to the topic's (topic, vector), share of
    the query's words, log of the text's length. Missing texts and vectors count as 0."""
    own = run.select(F.col(topic).alias("topic"), F.col(id_col).alias("id"), "text")
    q = queries.select(F.col(topic).alias("topic"), "query")
    scores = bm25_plus(q.select("topic", F.col("topic").alias("query_id"), "query"), own, None, group="topic").select("topic", "id", F.col("score").alias("bm25"))
    v = (own.select("topic", "id").join(vectors.select(F.col(id_col).alias("id"), "embedding"), "id").join(query_vectors.select(F.col(topic).alias("topic"), "vector"), "topic")
         .select("topic", "id", round_half_away(cosine("embedding", "vector"), 6).alias("similarity")))
    out = (own.join(q, "topic", "left").select("topic", "id", token_overlap("query", "text").alias("overlap"), F.log1p(F.length(F.coalesce("text", F.lit(""))).cast("double")).alias("length"))
           .join(scores, ["topic", "id"], "left").join(v, ["topic", "id"], "left"))
    return out.select(F.col("topic").alias(topic), F.col("id").alias(id_col), *[F.coalesce(f, F.lit(0.0)).alias(f) for f in FEATURES])


def _scaled(pairs: DataFrame, features: list[str], topic: str) -> DataFrame:
    """Features relative to the topic's mean, in its standard deviations (0 where all are equal)."""
    stats = pairs.groupBy(topic).agg(*[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    z = [F.when(F.col(f"_s_{f}") > 1e-12, (F.col(f) - F.col(f"_m_{f}")) / F.col(f"_s_{f}")).otherwise(0.0).alias(f) for f in features]
    return pairs.join(stats, topic).select(*[c for c in pairs.columns if c not in features], *z)


def fit(pairs: DataFrame, features: list[str], label: str, topic: str = "topic", id_col: str = "id") -> dict[str, float]:
    """Weights by which a topic's positive pairs come before its negative ones: logistic regression, without
    intercept, on the differences of each positive and up to ``PARTNERS`` negatives of its topic, in both directions.

    Negatives are dealt to ``PARTNERS`` slots by a hash; a positive meets the smallest of each slot, so training
    rows grow with the positives, not with their product with the negatives."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    z = _scaled(pairs, features, topic)
    pos = z.where(F.col(label) == 1).select(topic, *[F.col(f).alias(f"p_{f}") for f in features])
    neg = (z.where(F.col(label) == 0).withColumn("_slot", F.pmod(F.xxhash64(id_col), F.lit(PARTNERS)))
           .groupBy(topic, "_slot").agg(F.min(F.struct(F.xxhash64(id_col, F.lit(1)).alias("h"), *features)).alias("n")))
    rows = pos.join(neg, topic).select(*[(F.col(f"p_{f}") - F.col(f"n.{f}")).alias(f) for f in features])
    both = rows.withColumn("label", F.lit(1.0)).unionByName(rows.select(*[(-F.col(f)).alias(f) for f in features]).withColumn("label", F.lit(0.0)))
    if both.isEmpty():
        raise ValueError("no topic has positive and negative pairs")
    model = LogisticRegression(fitIntercept=False, regParam=0.01, maxIter=50, standardization=False).fit(
        VectorAssembler(inputCols=list(features), outputCol="features").transform(both))
    return dict(zip(features, (float(w) for w in model.coefficients)))


def rank(pairs: DataFrame, weights: dict[str, float], k: int | None = None, topic: str = "topic", id_col: str = "id") -> DataFrame:
    """``topic, id, score, rank``: the weighted sum of the topic-relative features; ties by id."""
    z = _scaled(pairs, list(weights), topic)
    score = sum((F.col(f) * F.lit(w) for f, w in weights.items()), F.lit(0.0))
    return rank_within(z.select(topic, id_col, round_half_away(score, 6).alias("score")), topic, [F.col("score").desc(), F.col(id_col).asc()], k)


def order_quality(ranked: DataFrame, cores: DataFrame, topic: str = "topic", id_col: str = "id") -> float:
    """Share of a topic's (core, other) pairs in the right order, mean over the topics that have both."""
    own = ranked.join(cores.select(topic, id_col).distinct().withColumn("_c", F.lit(1)), [topic, id_col], "left")
    per = own.groupBy(topic).agg(F.sum(F.when(F.col("_c") == 1, F.col("rank"))).alias("r"), F.sum("_c").alias("p"), F.count("*").alias("n"))
    per = per.where("p > 0 and p < n").select((1 - (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))
    return per.agg(F.avg("auc")).first()[0] or 0.0
