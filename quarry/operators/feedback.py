"""Relevance feedback for screening.

One call = one screening round over all topics: the labelled table is the
state between rounds (written by the caller), candidates are scored with the
same blocked scorer as search, keyed by topic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import tokens
from quarry.functions.vectors import dot, mean_vector, round_half_away, scale, vsub
from quarry.operators.clean import dedupe_content, label_members
from quarry.operators.common import broadcast_if_small, materialize, rank_within

MAX_LABELLED = 20_000  # labelled rows of one topic that a model is trained on in one task; more is an error
SHRINKAGE = 0.1        # share of the within-class scatter that is replaced by its mean variance
NB_ALPHA = 3.822       # fixed value: smoothing of the reference's text classifier


def candidate_pool(run: DataFrame, works: DataFrame, cps: DataFrame, topic: str = "topic",
                   id_col: str = "id") -> DataFrame:
    """a topic's candidates that exist in the corpus, labelled (included 1/0),
    one row per content (smallest id), with their run score and rank."""
    cand = works.select(id_col, "title", "abstract").join(run.select(topic, id_col, "score", "rank"), id_col)
    labelled = label_members(cand, cps.select(topic, id_col), on=[topic])
    return dedupe_content(labelled, cols=(topic, "title", "abstract"), id_col=id_col)


def split_pool(pool: DataFrame, vectors: DataFrame, id_col: str = "id", label: str = "included"):
    """positive and negative rows of a pool, with their vectors."""
    with_v = pool.join(vectors.select(id_col, "embedding"), id_col)
    return with_v.filter(F.col(label) == 1), with_v.filter(F.col(label) == 0)


def feedback_vector(pos: DataFrame, neg: DataFrame, topic: str = "topic", vec_col: str = "embedding") -> DataFrame:
    """per topic ``2 * mean(pos) - mean(neg)``, or ``mean(pos)`` without negatives.

    Topics without positives get no row (the reference raises an error)."""
    mp = mean_vector(pos, [topic], vec_col, "_p")
    mn = mean_vector(neg, [topic], vec_col, "_n")
    j = mp.join(mn, topic, "left")
    return j.select(topic, F.when(F.col("_n").isNull(), F.col("_p"))
                    .otherwise(vsub(scale("_p", 2.0), "_n")).alias("vector"))


def rank_by_feedback(pool_vectors: DataFrame, labelled: DataFrame, n: int = 1, topic: str = "topic",
                     id_col: str = "id", label: str = "included") -> DataFrame:
    """score the unlabelled candidates of each topic against the feedback vector
    of the labelled ones; the next n per topic."""
    from quarry.operators.search import search
    lab = labelled.select(topic, id_col, label)
    lv = lab.join(pool_vectors.select(topic, id_col, "embedding"), [topic, id_col])
    q = feedback_vector(lv.filter(F.col(label) == 1), lv.filter(F.col(label) == 0), topic)
    todo = pool_vectors.join(lab, [topic, id_col], "left_anti")
    hits = search(q.withColumn("_qid", F.col(topic)), todo.select(id_col, "embedding", topic), n,
                  query_id="_qid", key=topic)
    return hits.drop("_qid")


def _features(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return df.withColumn("features", array_to_vector(F.transform(vec_col, lambda x: x.cast("double"))))


def rank_by_classifier(pool_vectors: DataFrame, labelled: DataFrame, kind: str = "svm", n: int = 10,
                       id_col: str = "id", label: str = "included", seed: int = 42) -> DataFrame:
    """train on the labelled vectors of one review, score the rest, next n.

    ``svm`` = LinearSVC (raw margin), ``mlp`` = MultilayerPerceptronClassifier
    (positives oversampled to balance, as it takes no weights), ``gbt`` =
    GBTClassifier (class weights).  Classes are weighted by inverse frequency
    where the estimator accepts weights."""
    from pyspark.ml.classification import GBTClassifier, LinearSVC, MultilayerPerceptronClassifier
    from pyspark.ml.functions import vector_to_array
    lab = labelled.select(id_col, label)
    train = _features(pool_vectors.join(lab, id_col)).withColumn("label", F.col(label).cast("double"))
    counts = {r[0]: r[1] for r in train.groupBy("label").count().collect()}
    n_pos, n_neg = counts.get(1.0, 0), counts.get(0.0, 0)
    if n_pos == 0 or n_neg == 0:
        raise ValueError("classifier ranking needs positive and negative labels")
    w_pos, w_neg = (n_pos + n_neg) / (2.0 * n_pos), (n_pos + n_neg) / (2.0 * n_neg)
    train = train.withColumn("w", F.when(F.col("label") == 1.0, w_pos).otherwise(w_neg))
    rest = _features(pool_vectors.join(lab, id_col, "left_anti"))
    if kind == "svm":
        model = LinearSVC(weightCol="w", maxIter=50, regParam=0.01).fit(train)
        score = vector_to_array("rawPrediction")[1]
    elif kind == "gbt":
        model = GBTClassifier(weightCol="w", maxIter=20, seed=seed).fit(train)
        score = vector_to_array("probability")[1]
    elif kind == "mlp":
        ratio = max(1, round(n_neg / n_pos))
        over = train.filter("label = 1.0").withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(ratio)))).drop("_r")
        bal = train.filter("label = 0.0").unionByName(over)
        dim = len(pool_vectors.select("embedding").first()[0])
        model = MultilayerPerceptronClassifier(layers=[dim, 32, 2], maxIter=100, seed=seed).fit(bal)
        score = vector_to_array("probability")[1]
    else:
        raise ValueError(kind)
    scored = model.transform(rest).select(id_col, score.alias("score"))
    return rank_within(scored.withColumn("_g", F.lit(0)), "_g",
                       [F.col("score").desc(), F.col(id_col).asc()], n).drop("_g")


def rank_by_text(pool: DataFrame, labelled: DataFrame, n: int = 10, id_col: str = "id",
                 label: str = "included", text_col: str = "text", num_features: int = 1 << 14) -> DataFrame:
    """TF-IDF + naive Bayes with balanced class weights, highest positive
    probability first; the next n (batches of 10 in the reference)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import IDF, HashingTF
    from pyspark.ml.functions import vector_to_array
    lab = labelled.select(id_col, label)
    docs = pool.select(id_col, tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("_tok"))
    train = docs.join(lab, id_col).withColumn("label", F.col(label).cast("double"))
    counts = {r[0]: r[1] for r in train.groupBy("label").count().collect()}
    n_pos, n_neg = counts.get(1.0, 0), counts.get(0.0, 0)
    if n_pos == 0 or n_neg == 0:
        raise ValueError("text ranking needs positive and negative labels")
    train = train.withColumn("w", F.when(F.col("label") == 1.0, (n_pos + n_neg) / (2.0 * n_pos))
                             .otherwise((n_pos + n_neg) / (2.0 * n_neg)))
    pipe = Pipeline(stages=[HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
                            IDF(inputCol="_tf", outputCol="features"),
                            NaiveBayes(weightCol="w", modelType="multinomial")])
    model = pipe.fit(train)
    rest = docs.join(lab, id_col, "left_anti")
    scored = model.transform(rest).select(id_col, vector_to_array("probability")[1].alias("score"))
    return rank_within(scored.withColumn("_g", F.lit(0)), "_g",
                       [F.col("score").desc(), F.col(id_col).asc()], n).drop("_g")


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's sums per topic and class: count, sums (j = -1) and products of the vectors' components."""
    n, sums, products = {}, {}, {}
    for pdf in batches:
        for (topic, label), rows in pdf.groupby(["topic", "label"]):
            x = np.stack(rows["embedding"].to_numpy()).astype(float)
            key = (topic, label)
            n[key] = n.get(key, 0) + len(x)
            sums[key] = sums.get(key, 0) + x.sum(0)
            products[key] = products.get(key, 0) + x.T @ x
    for (topic, label), p in products.items():
        d = len(p)
        i, j = np.indices((d, d)).reshape(2, -1)
        yield pd.DataFrame({"topic": topic, "label": label, "i": np.r_[np.arange(d), i], "j": np.r_[np.full(d, -1), j],
                            "total": np.r_[sums[topic, label], p.ravel()], "n": n[topic, label]})


def linear_discriminants(labelled: DataFrame, shrinkage: float = SHRINKAGE) -> DataFrame:
    """Fisher's discriminant of every topic: ``topic, weights, bias``, from ``topic, label (1/0), embedding``.

    The within-class scatter and class means come from sums per topic and class that tasks make and a grouped sum
    adds, so a topic may have any number of labelled rows; one row per pair of components is solved per topic.
    A share ``shrinkage`` of the scatter is replaced by its mean variance, which also makes it regular
    when there are fewer rows than components. Log class sizes are the prior. Topics without both classes get no row."""
    spec = T.StructType([labelled.schema["topic"], T.StructField("label", T.IntegerType()), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()),
                         T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])
    rows = labelled.where("embedding is not null and label in (0, 1)").select("topic", F.col("label").cast("int").alias("label"), "embedding")
    sums = (rows.mapInPandas(_moments, spec).groupBy("topic", "label", "i", "j").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        means, counts, scatter = {}, {}, 0.0
        d = int(pdf["i"].max()) + 1
        for label, own in pdf.groupby("label"):
            first = own[own["j"] == -1].sort_values("i")
            counts[label] = int(first["n"].iloc[0])
            means[label] = first["total"].to_numpy() / counts[label]
            rest = own[own["j"] >= 0].sort_values(["i", "j"])
            scatter = scatter + rest["total"].to_numpy().reshape(d, d) - counts[label] * np.outer(means[label], means[label])
        if len(means) < 2:
            return pd.DataFrame(columns=["topic", "weights", "bias"], dtype=object)
        scatter = scatter / sum(counts.values())
        scatter = (1 - shrinkage) * scatter + shrinkage * np.trace(scatter) / d * np.eye(d)
        w = np.linalg.lstsq(scatter, means[1] - means[0], rcond=None)[0]
        bias = -w @ (means[1] + means[0]) / 2 + np.log(counts[1] / counts[0])
        return pd.DataFrame({"topic": [pdf["topic"].iloc[0]], "weights": [w], "bias": [bias]})

    return sums.groupBy("topic").applyInPandas(solve, T.StructType([labelled.schema["topic"], T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("bias", T.DoubleType())]))


def _balance(y: np.ndarray) -> np.ndarray:
    """Row weights by which both classes weigh the same."""
    share = y.mean()
    return np.where(y == 1, 0.5 / share, 0.5 / (1 - share))


def _fit_svm(x: np.ndarray, y: np.ndarray, seed: int, c: float = 1.0, steps: int = 500) -> dict:
    """Linear support vector machine, squared hinge loss, by accelerated gradient steps of the loss's own curvature."""
    x1, s, w = np.c_[x, np.ones(len(x))], 2.0 * y - 1, _balance(y)
    v = ahead = np.zeros(x1.shape[1])
    step = 1.0 / (1.0 + 2 * c * np.linalg.norm(x1 * np.sqrt(w)[:, None], 2) ** 2)
    for t in range(steps):
        short = np.maximum(0.0, 1 - s * (x1 @ ahead))
        new = ahead - step * (np.r_[ahead[:-1], 0.0] - 2 * c * x1.T @ (w * s * short))
        v, ahead = new, new + t / (t + 3) * (new - v)
    return {"w1": v[None, :-1], "b1": v[-1:], "out": np.ones(1)}


def _fit_mlp(x: np.ndarray, y: np.ndarray, seed: int, hidden: int = 32, steps: int = 200, rate: float = 0.01) -> dict:
    """One hidden layer of rectified units under a logistic output, by Adam over whole batches."""
    rnd = np.random.default_rng(seed)
    p = [rnd.standard_normal((hidden, x.shape[1])) * np.sqrt(2 / x.shape[1]), np.zeros(hidden), rnd.standard_normal(hidden) * np.sqrt(1 / hidden), np.zeros(1)]
    first, second, w = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], _balance(y) / len(y)
    for t in range(1, steps + 1):
        h = x @ p[0].T + p[1]
        a = np.maximum(h, 0)
        miss = w * (1 / (1 + np.exp(-(a @ p[2] + p[3]))) - y)
        back = np.outer(miss, p[2]) * (h > 0)
        for k, g in enumerate((back.T @ x, back.sum(0), a.T @ miss, miss.sum(keepdims=True))):
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
            p[k] = p[k] - rate * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)
    return {"w1": p[0], "b1": p[1], "out": p[2], "b2": p[3], "relu": True}


def _fit_stumps(x: np.ndarray, y: np.ndarray, seed: int, rounds: int = 50, rate: float = 0.3) -> dict:
    """Boosted trees of one split each under the logistic loss: every split is the best of all components and values."""
    w, f, out = _balance(y), np.zeros(len(y)), []
    order = np.argsort(x, axis=0, kind="stable")
    ranked = np.take_along_axis(x, order, 0)
    cut_ok = ranked[1:] > ranked[:-1]
    if not cut_ok.any():
        return {"stumps": np.zeros((0, 4))}
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = w * (y - p), w * p * (1 - p)
        gl, hl = np.cumsum(g[order], 0)[:-1], np.cumsum(h[order], 0)[:-1]
        gain = np.where(cut_ok, gl ** 2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1), -np.inf)
        r, c = np.unravel_index(gain.argmax(), gain.shape)
        cut = (ranked[r, c] + ranked[r + 1, c]) / 2
        low, high = gl[r, c] / (hl[r, c] + 1), (g.sum() - gl[r, c]) / (h.sum() - hl[r, c] + 1)
        out.append((c, cut, rate * low, rate * high))
        f = f + np.where(x[:, c] <= cut, rate * low, rate * high)
    return {"stumps": np.array(out)}


def _apply(model: dict, x: np.ndarray) -> np.ndarray:
    if "stumps" in model:
        return sum((np.where(x[:, int(c)] <= cut, low, high) for c, cut, low, high in model["stumps"]), np.zeros(len(x)))
    h = x @ model["w1"].T + model["b1"]
    return (np.maximum(h, 0) if model.get("relu") else h) @ model["out"] + model.get("b2", 0.0)


_FITS = {"svm": _fit_svm, "mlp": _fit_mlp, "gbt": _fit_stumps}


def rank_topics_by_classifier(pool_vectors: DataFrame, labelled: DataFrame, kind: str = "lda", n: int = 10, topic: str = "topic",
                              id_col: str = "id", label: str = "included", seed: int = 42, digits: int = 6) -> DataFrame:
    """F5 for all topics in one job: a model per topic from its labelled rows, its other candidates scored, the next
    ``n`` per topic: ``topic, id, score, rank``.

    ``lda``: Fisher's discriminant from distributed scatter matrices. ``svm`` (squared hinge), ``mlp`` (32 hidden
    units) and ``gbt`` (boosted splits): topics are trained side by side as groups, each on at most ``MAX_LABELLED``
    rows (labels are given by hand; more is an error, not a cut). Models, a row per topic, travel to the
    candidates: broadcast if their counted number is small. Both classes weigh the same, but in ``lda``, whose
    prior is the class sizes. Topics without both classes get no rows; ties by id."""
    lab = labelled.select(F.col(topic).alias("topic"), F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
    pool = pool_vectors.where(F.col("embedding").isNotNull()).select(F.col(topic).alias("topic"), F.col(id_col).alias("id"), "embedding")
    train = pool.join(lab, ["topic", "id"])
    rest = pool.join(lab, ["topic", "id"], "left_anti")
    if kind == "lda":
        models = materialize(linear_discriminants(train), "topic-models")
        scored = rest.join(broadcast_if_small(models), "topic").select("topic", "id", (dot("embedding", "weights") + F.col("bias")).alias("score"))
    else:
        fit = _FITS[kind]

        def learn(pdf: pd.DataFrame) -> pd.DataFrame:
            import pickle
            if len(pdf) > MAX_LABELLED:
                raise ValueError(f"more than {MAX_LABELLED} labelled rows in topic {pdf['topic'].iloc[0]}")
            pdf = pdf.sort_values("id", kind="stable")
            y = pdf["label"].to_numpy().astype(float)
            if y.min() == y.max():
                return pd.DataFrame(columns=["topic", "model"], dtype=object)
            return pd.DataFrame({"topic": [pdf["topic"].iloc[0]], "model": [pickle.dumps(fit(np.stack(pdf["embedding"].to_numpy()).astype(float), y, seed))]})

        models = materialize(train.groupBy("topic").applyInPandas(learn, T.StructType([pool.schema["topic"], T.StructField("model", T.BinaryType())])), "topic-models")

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import pickle
            known = {}
            for pdf in batches:
                out = np.zeros(len(pdf))
                for topic_of, at in pdf.groupby("topic").indices.items():
                    if topic_of not in known:
                        known[topic_of] = pickle.loads(pdf["model"].iloc[at[0]])
                    out[at] = _apply(known[topic_of], np.stack(pdf["embedding"].to_numpy()[at]).astype(float))
                yield pdf[["topic", "id"]].assign(score=out)

        scored = rest.join(broadcast_if_small(models), "topic").mapInPandas(score, T.StructType([rest.schema["topic"], rest.schema["id"], T.StructField("score", T.DoubleType())]))
    scored = scored.withColumn("score", round_half_away("score", digits))
    return rank_within(scored, "topic", [F.col("score").desc(), F.col("id").asc()], n).withColumnsRenamed({"topic": topic, "id": id_col})


def rank_topics_by_text(pool: DataFrame, labelled: DataFrame, n: int = 10, topic: str = "topic", id_col: str = "id", label: str = "included",
                        text_col: str = "text", alpha: float = NB_ALPHA, digits: int = 6) -> DataFrame:
    """F6 for all topics in one job, with whole words: TF-IDF and multinomial naive Bayes per topic, the next ``n``.

    A topic's documents are its pool: idf = ln((1 + N) / (1 + df)) + 1, rows of unit length. Both classes weigh the
    same whatever their sizes. Score: log odds of the positive class. Weights per word exist for the words of
    labelled documents only (broadcast if counted small); all other words of a topic share one weight. Topics
    without both classes get no rows; documents without words score 0; ties by id."""
    lab = labelled.select(F.col(topic).alias("topic"), F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    docs = pool.select(F.col(topic).alias("topic"), F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("_toks"))
    sizes = docs.groupBy("topic").agg(F.count("*").alias("_N"))
    tf = (docs.select("topic", "id", F.explode_outer("_toks").alias("term")).where("term is not null").groupBy("topic", "id", "term").agg(F.count("*").alias("_tf")))
    tf = materialize(tf, "text-terms")
    idf = (tf.groupBy("topic", "term").agg(F.count("*").alias("_df")).join(F.broadcast(sizes), "topic")
           .select("topic", "term", (F.log((1 + F.col("_N")) / (1 + F.col("_df"))) + 1).alias("_idf")))
    raw = tf.join(idf, ["topic", "term"]).select("topic", "id", "term", (F.col("_tf") * F.col("_idf")).alias("_x"))
    norm = raw.groupBy("topic", "id").agg(F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("_norm"))
    x = materialize(raw.join(norm, ["topic", "id"]).select("topic", "id", "term", (F.col("_x") / F.col("_norm")).alias("x")), "text-weights")
    both = (docs.join(lab, ["topic", "id"]).groupBy("topic").agg(F.sum("label").alias("_pos"), F.sum(1 - F.col("label")).alias("_neg")).where("_pos > 0 and _neg > 0"))
    known = x.join(lab, ["topic", "id"]).join(F.broadcast(both), "topic")
    weigh = F.col("x") * (F.col("_pos") + F.col("_neg")) / 2
    terms = known.groupBy("topic", "term").agg(F.coalesce(F.sum(F.when(F.col("label") == 1, weigh / F.col("_pos"))), F.lit(0.0)).alias("_p"),
                                               F.coalesce(F.sum(F.when(F.col("label") == 0, weigh / F.col("_neg"))), F.lit(0.0)).alias("_q"))
    terms = materialize(terms, "text-classes")
    vocabulary = idf.groupBy("topic").agg(F.count("*").alias("_V"))
    totals = (both.select("topic").join(terms.groupBy("topic").agg(F.sum("_p").alias("_sp"), F.sum("_q").alias("_sq")), "topic", "left").na.fill(0.0)
              .join(vocabulary, "topic", "left").na.fill(0)
              .select("topic", F.log((F.col("_sq") + alpha * F.col("_V")) / (F.col("_sp") + alpha * F.col("_V"))).alias("_other")))
    weights = terms.select("topic", "term", F.log((F.col("_p") + alpha) / (F.col("_q") + alpha)).alias("_w"))
    rest = docs.select("topic", "id").join(lab, ["topic", "id"], "left_anti").join(F.broadcast(both.select("topic")), "topic", "left_semi")
    sums = (x.join(broadcast_if_small(weights), ["topic", "term"], "left").join(F.broadcast(totals), "topic")
            .groupBy("topic", "id").agg(F.sum(F.col("x") * (F.coalesce("_w", F.lit(0.0)) + F.col("_other"))).alias("score")))
    scored = rest.join(sums, ["topic", "id"], "left").select("topic", "id", round_half_away(F.coalesce("score", F.lit(0.0)), digits).alias("score"))
    return rank_within(scored, "topic", [F.col("score").desc(), F.col("id").asc()], n).withColumnsRenamed({"topic": topic, "id": id_col})


def screening_curve(ranked: DataFrame, cps: DataFrame, n: int = 10_000, topic: str = "topic",
                    id_col: str = "id", rank_col: str = "rank", keys: list[str] | None = None) -> DataFrame:
    """recall after reading the first i items, i = 0 .. n-1 (the i = 0 row is 0).

    A bounded spine of n steps per (keys, topic), a running sum of found cores
    over rank, divided by all core rows of the topic."""
    keys = list(keys or [])
    n_cps = cps.groupBy(topic).agg(F.count("*").alias("n_cps"))
    hits = (ranked.filter(F.col(rank_col) < n).join(cps.select(topic, id_col), [topic, id_col])
            .groupBy(*keys, topic, F.col(rank_col).alias("i")).agg(F.count("*").alias("_h")))
    spine = ranked.select(*keys, topic).distinct().select(
        *keys, topic, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    w = Window.partitionBy(*keys, topic).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return (spine.join(hits, keys + [topic, "i"], "left").na.fill(0, ["_h"])
            .withColumn("_f", F.sum("_h").over(w)).join(n_cps, topic)
            .select(*keys, topic, F.col("i").cast("int").alias("i"), (F.col("_f") / F.col("n_cps")).alias("recall")))


def average_curves(curves: DataFrame, length: int, topic: str = "topic", step: str = "i",
                   value: str = "recall") -> DataFrame:
    """F8: pad every curve that stopped early with recall 1.0 up to ``length`` steps,
    then the mean over topics per step: ``k, recall`` (k counts items read)."""
    spine = curves.select(topic).distinct().select(
        topic, F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias(step))
    full = spine.join(curves.select(topic, step, value), [topic, step], "left").withColumn(
        value, F.coalesce(F.col(value), F.lit(1.0)))
    return full.groupBy(step).agg(F.avg(value).alias(value)).select(F.col(step).cast("bigint").alias("k"), value)


def screening_best(curves: DataFrame, top_n, keys: list[str], topic: str = "topic", step: str = "i",
                   value: str = "recall", run: str = "run") -> DataFrame:
    """per topic (and keys) the best recall within the first top_n steps (an int,
    or a ``topic, top_n`` table), mean over runs; then the mean over topics per keys."""
    if isinstance(top_n, int):
        cut = curves.filter(F.col(step) < top_n)
    else:
        cut = curves.join(top_n.select(topic, F.col("top_n").alias("_n")), topic).filter(
            F.col(step) < F.col("_n")).drop("_n")
    best = (cut.groupBy(*keys, topic, run).agg(F.max(value).alias("_b"))
            .groupBy(*keys, topic).agg(F.avg("_b").alias("best")))
    return best.groupBy(*keys).agg(F.avg("best").alias("mean_best"), F.count("*").alias("n_topics"))
