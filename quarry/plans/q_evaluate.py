"""Registered evaluation queries (M1-M22, E10) and the remaining search
operators (R3-R7, R16, R18) with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions.vectors import round_half_away
from quarry.operators import embed as em
from quarry.operators import evaluate as ev
from quarry.operators import rerank
from quarry.operators import search as srch
from quarry.operators.common import materialize
from quarry.operators.topic_run import topic_search_run as topic_search_run_with_texts
from quarry.plans.q_embed import CFG_SQL, topic_config
from quarry.plans.q_rerank import METHODS_CTES, _methods, bm25_sql, methods_of
from quarry.plans.q_search import _SEARCH_CTE
from quarry.plans.registry import register
from quarry.sources import fixtures as fx
from quarry.sources import io as sio

V = fx.with_views
K_RUN = 100
DIG = 9  # averaged outputs are reported at 9 digits (independent of summation order)


def rnd(df, *cols):
    for c in cols:
        df = df.withColumn(c, round_half_away(c, DIG))
    return df


# ----------------------------------------------------------------------------- fixtures
def seed_runs(spark, d, k=K_RUN):
    """Three seed runs per topic: ``run, topic, core_id, id, score, rank``."""
    q = fx.seed_queries(spark, d, 3)
    hits = srch.search(q, fx.corpus(spark, d), k)
    return hits.join(q.select("query_id", "topic", "run", F.col("seed_id").alias("core_id")), "query_id")


RUNS_CTE = _SEARCH_CTE + f""",
runs AS (SELECT r.run, r.topic, q.seed_id AS core_id, r.id, r.score, r.rank
         FROM ranked r JOIN seed_queries q ON q.query_id = r.query_id WHERE r.rank <= {K_RUN}),
ncps AS (SELECT topic, count(*) AS n_cps FROM eval_cps GROUP BY topic),
topick AS (SELECT t.topic, coalesce(least(c.n, 10000), 10000) AS top_n
           FROM (SELECT DISTINCT topic FROM eval_cps) t
           LEFT JOIN (SELECT topic, count(*) AS n FROM slr_results GROUP BY topic) c ON c.topic = t.topic)
"""


def recall_sql(run: str, keys: list[str], cut: str = "TRUE", count: str = "count(*)") -> str:
    """SQL twin of ``recall_at_k``: ``run`` has keys + topic, id, rank (+ top_n when cut uses it)."""
    kc = ", ".join(keys + ["topic"])
    kp = ", ".join(f"p.{k}" for k in keys + ["topic"])
    on = " AND ".join(f"f.{k} = p.{k}" for k in keys + ["topic"])
    hk = ", ".join(f"h.{k}" for k in keys + ["topic"])
    return f"""
SELECT {kp}, c.n_cps, coalesce(f.n_found, 0) AS n_found, coalesce(f.n_found, 0) / c.n_cps AS recall
FROM (SELECT DISTINCT {kc} FROM {run}) p
LEFT JOIN ncps c ON c.topic = p.topic
LEFT JOIN (SELECT {hk}, {count} AS n_found
           FROM (SELECT DISTINCT {kc}, id FROM {run} WHERE {cut}) h
           JOIN eval_cps t ON t.topic = h.topic AND t.id = h.id GROUP BY {hk}) f ON {on}"""


def core_runs(spark, d, k=K_RUN, with_seed=False):
    """Every core publication of a topic as a query: ``topic, core_id, id, score, rank``; ``with_seed``: its mean
    with the topic's first core publication."""
    c = fx.corpus(spark, d)
    cores = fx.eval_cps(spark, d).select("topic", "id")
    q = c.join(cores, "id").select("topic", F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    if with_seed:
        seed = fx.seed_queries(spark, d, 1).select("topic", F.col("vector").alias("seed"))
        q = q.join(seed, "topic").withColumn("vector", F.zip_with("vector", "seed", lambda a, b: (a.cast("double") + b.cast("double")) / 2))
    q = q.select("query_id", "vector")
    return srch.search(q, c, k).join(cores.select("topic", F.col("id").alias("query_id")), "query_id").withColumnRenamed("query_id", "core_id")


def effect(spark, d, k=K_RUN):
    return ev.core_effect(core_runs(spark, d, k), fx.eval_cps(spark, d))


EFFECT_CTE = RUNS_CTE + f""",
core_runs AS (
  SELECT topic, core_id, id, score, row_number() OVER (PARTITION BY core_id ORDER BY score DESC, id) AS rank FROM (
    SELECT c.topic, c.id AS core_id, e.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
    FROM eval_cps c JOIN embeddings v ON v.vec_id = c.id CROSS JOIN embeddings e) s
  QUALIFY rank <= {K_RUN}),
effect AS (
  SELECT q.topic, q.core_id, coalesce(f.n, 0) AS n_cores, c.n_cps,
         round(coalesce(f.n, 0) / c.n_cps, 2) AS recall
  FROM (SELECT DISTINCT topic, core_id FROM core_runs) q
  LEFT JOIN (SELECT r.topic, r.core_id, count(t.title) AS n
             FROM (SELECT DISTINCT topic, core_id, id FROM core_runs) r
             JOIN eval_cps t ON t.topic = r.topic AND t.id = r.id GROUP BY r.topic, r.core_id) f
    ON f.topic = q.topic AND f.core_id = q.core_id
  LEFT JOIN ncps c ON c.topic = q.topic)
"""


# ----------------------------------------------------------------------------- M1-M5
@register("M1_recall_at_k_runs", V(recall_sql("runs", ["run"], "rank <= 50"), RUNS_CTE))
def m1(spark, d):
    return ev.recall_at_k(seed_runs(spark, d), fx.eval_cps(spark, d), 50, run_keys=["run"])


@register("M1_recall_titled_ids", V(
    "SELECT run, topic, n_found AS n_titled, recall AS recall_titled FROM (" +
    recall_sql("runs", ["run"], "rank <= 50", "count(t.title)") + ") x", RUNS_CTE))
def m1b(spark, d):
    r = ev.recall_at_k(seed_runs(spark, d), fx.eval_cps(spark, d), 50, run_keys=["run"], count="titled")
    return r.select("run", "topic", F.col("n_found").alias("n_titled"), F.col("recall").alias("recall_titled"))


@register("M2_topic_k", V("SELECT topic, top_n FROM topick", RUNS_CTE))
def m2(spark, d):
    return ev.topic_k(fx.slr_results(spark, d), fx.eval_cps(spark, d))


M3_SQL = """
SELECT c.topic, count(CASE WHEN f.id IS NOT NULL THEN c.title END) AS n_found, count(*) AS n_cps,
       count(CASE WHEN f.id IS NOT NULL THEN c.title END) / count(*) AS recall
FROM eval_cps c JOIN (SELECT DISTINCT topic FROM slr_results) t ON t.topic = c.topic
LEFT JOIN (SELECT DISTINCT topic, id FROM slr_results WHERE is_core) f ON f.topic = c.topic AND f.id = c.id
GROUP BY c.topic"""


@register("M3_keyword_recall", V(M3_SQL))
def m3(spark, d):
    return ev.keyword_recall(fx.slr_results(spark, d), fx.eval_cps(spark, d))


M4_CTE = RUNS_CTE + """,
runk AS (SELECT r.*, k.top_n FROM runs r JOIN topick k ON k.topic = r.topic),
m4 AS (SELECT topic, avg(recall) AS recall, count(*) AS n_runs FROM (""" + recall_sql(
    "runk", ["run"], "rank <= top_n", "count(t.title)") + """) x GROUP BY topic),
m4all AS (SELECT topic, avg(recall) AS recall, count(*) AS n_runs FROM (""" + recall_sql(
    "runs", ["run"], "TRUE", "count(t.title)") + """) x GROUP BY topic),
m3 AS (""" + M3_SQL + """),
m5 AS (SELECT coalesce(o.topic, k.topic) AS topic, o.recall AS ours, k.recall AS keyword,
              coalesce(t.top_n, 10000) AS sample_size
       FROM m4all o FULL JOIN m3 k ON k.topic = o.topic LEFT JOIN topick t ON t.topic = coalesce(o.topic, k.topic))
"""


@register("M4_mean_recall_limit_k", V("SELECT topic, round(recall, 9) AS recall, n_runs FROM m4", M4_CTE))
def m4(spark, d):
    k = ev.topic_k(fx.slr_results(spark, d), fx.eval_cps(spark, d))
    return rnd(ev.mean_recall(seed_runs(spark, d), fx.eval_cps(spark, d), ["run"], limit_k=k), "recall")


def _m5(spark, d):
    cps = fx.eval_cps(spark, d)
    ours = ev.mean_recall(seed_runs(spark, d), cps, ["run"])
    kw = ev.keyword_recall(fx.slr_results(spark, d), cps)
    return ev.compare_recall(ours, kw, ev.topic_k(fx.slr_results(spark, d), cps))


@register("M5_compare_recall", V(
    "SELECT topic, round(ours, 9) AS ours, round(keyword, 9) AS keyword, sample_size FROM m5", M4_CTE))
def m5(spark, d):
    return rnd(_m5(spark, d), "ours", "keyword")


# ----------------------------------------------------------------------------- models
MODELS = {"first": (1, 32), "second": (33, 32), "all": (1, 64)}


def _model_slices(df, vec_col, out_col):
    arr = F.array(*[F.struct(F.lit(m).alias("model"), F.slice(F.col(vec_col), s, n).alias("v"))
                    for m, (s, n) in MODELS.items()])
    return df.select("*", F.explode(arr).alias("_m")).select("*", F.col("_m.model").alias("model"),
                                                             F.col("_m.v").alias(out_col)).drop("_m")


def model_scores(spark, d):
    """R4 on the evaluation corpus (seeds + their 20 nearest neighbours): per model
    the topic centroid of the seed vectors against every evaluation vector."""
    seedq = fx.seed_queries(spark, d, 3)
    sims = srch.search(seedq, fx.corpus(spark, d), 20).select("id")
    eval_ids = fx.seeds(spark, d).select("id").unionByName(sims).distinct()
    corpus = _model_slices(fx.corpus(spark, d).join(eval_ids, "id"), "embedding", "mvec").select("id", "model", "mvec")
    seeds_m = _model_slices(seedq, "vector", "mvec")
    cents = em.centroid(seeds_m, ["model", "topic"], "mvec", "vector")
    return srch.score_models(cents, corpus, "model", query_id="topic", vec_col="mvec").withColumnRenamed(
        "query_id", "topic")


MODEL_CTE = _SEARCH_CTE + """,
models AS (SELECT * FROM (VALUES ('first', 1, 32), ('second', 33, 64), ('all', 1, 64)) m(model, lo, hi)),
eval_ids AS (SELECT id FROM seeds UNION SELECT id FROM ranked WHERE rank <= 20),
mcorpus AS (SELECT m.model, e.vec_id AS id, list_slice(e.embedding::DOUBLE[], m.lo, m.hi) AS v
            FROM embeddings e JOIN eval_ids i ON i.id = e.vec_id, models m),
mcent AS (
  SELECT model, topic, list(x ORDER BY dim) AS v FROM (
    SELECT m.model, s.topic, dim, avg(x) AS x FROM (
      SELECT topic, unnest(vector) AS x, generate_subscripts(vector, 1) AS dim FROM seed_queries) s, models m
    WHERE s.dim BETWEEN m.lo AND m.hi GROUP BY m.model, s.topic, dim) y GROUP BY model, topic),
mscores AS (
  SELECT c.model, q.topic, c.id, round(list_cosine_similarity(q.v, c.v), 6) AS score,
         round(-list_distance(q.v, c.v), 6) + 0.0 AS euc_score
  FROM mcent q JOIN mcorpus c ON c.model = q.model)
"""


@register("R4_score_models", V("SELECT model, topic, id, score, euc_score FROM mscores", MODEL_CTE))
def r4(spark, d):
    return model_scores(spark, d)


@register("M6_minmax_score", V("""
SELECT model, topic, id, score, euc_score, abs(score) AS cos_abs,
       1.0 - (abs(euc_score) - min(abs(euc_score)) OVER w) /
             nullif(max(abs(euc_score)) OVER w - min(abs(euc_score)) OVER w, 0) AS dist_norm
FROM mscores WINDOW w AS (PARTITION BY model)""", MODEL_CTE))
def m6(spark, d):
    return ev.minmax_score(model_scores(spark, d))


def _model_ranked(spark, d):
    from quarry.operators.common import rank_within
    s = model_scores(spark, d)
    return rank_within(s, ["model", "topic"], [F.col("score").desc(), F.col("id").asc()], 50)


MODEL_RANK_CTE = MODEL_CTE + """,
mranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, topic ORDER BY score DESC, id) AS rank
                           FROM mscores) x WHERE rank <= 50),
ncps AS (SELECT topic, count(*) AS n_cps FROM eval_cps GROUP BY topic),
mrecall AS (
  SELECT model, topic, 10 AS k, round(recall, 2) AS recall FROM (""" + recall_sql(
    "mranked", ["model"], "rank <= 10") + """) a
  UNION ALL
  SELECT model, topic, 50 AS k, round(recall, 2) AS recall FROM (""" + recall_sql(
    "mranked", ["model"], "rank <= 50") + """) b)
"""


@register("M11_model_recall", V("SELECT model, topic, k, recall FROM mrecall", MODEL_RANK_CTE))
def m11(spark, d):
    return ev.model_recall(_model_ranked(spark, d), fx.eval_cps(spark, d), ks=(10, 50))


@register("M11_model_means", V("""
SELECT model, k, mean_recall, row_number() OVER (PARTITION BY k ORDER BY mean_recall DESC, model) AS position
FROM (SELECT model, k, round(avg(recall), 3) AS mean_recall FROM mrecall GROUP BY model, k) x""", MODEL_RANK_CTE))
def m11b(spark, d):
    return ev.model_means(ev.model_recall(_model_ranked(spark, d), fx.eval_cps(spark, d), ks=(10, 50)))


@register("M11_model_pivot", V("""
SELECT topic, max(CASE WHEN model = 'first' THEN recall END) AS "first",
       max(CASE WHEN model = 'second' THEN recall END) AS "second",
       max(CASE WHEN model = 'all' THEN recall END) AS "all"
FROM mrecall WHERE k = 50 GROUP BY topic""", MODEL_RANK_CTE))
def m11c(spark, d):
    r = ev.model_recall(_model_ranked(spark, d), fx.eval_cps(spark, d), ks=(50,))
    return ev.wide(r, "topic", "model", "recall", list(MODELS))


@register("M19_score_histogram", V("""
SELECT model, CAST(least(floor((abs(score) - 0.0) / (1.0 - 0.0) * 2000), 1999) AS INTEGER) AS bin, count(*) AS n
FROM mscores WHERE abs(score) BETWEEN 0 AND 1 GROUP BY ALL""", MODEL_CTE))
def m19(spark, d):
    s = ev.minmax_score(model_scores(spark, d))
    return ev.score_histogram(s, "cos_abs", ["model"], bins=2000)


# ----------------------------------------------------------------------------- M7-M10, M18, M20, M21
CURVE_CTE = RUNS_CTE + """,
spine AS (SELECT p.run, p.topic, b FROM (SELECT DISTINCT run, topic FROM runs) p, range(0, 11) t(b)),
hits AS (SELECT r.run, r.topic, CAST(ceil(r.rank / 10) AS BIGINT) AS b
         FROM runs r JOIN eval_cps c ON c.topic = r.topic AND c.id = r.id),
cur AS (SELECT s.run, s.topic, s.b, (SELECT count(*) FROM hits h WHERE h.run = s.run AND h.topic = s.topic
                                     AND h.b <= s.b) / n.n_cps AS recall
        FROM spine s JOIN ncps n ON n.topic = s.topic),
curve AS (SELECT b * 10 AS k, round(avg(recall), 9) AS recall FROM (
            SELECT run, b, avg(recall) AS recall FROM cur GROUP BY run, b) x GROUP BY b)
"""


def _curve(spark, d):
    return rnd(ev.recall_curve(seed_runs(spark, d), fx.eval_cps(spark, d), ["run"], step=10, upto=100), "recall")


@register("M7_recall_curve", V("SELECT k, recall FROM curve", CURVE_CTE))
def m7(spark, d):
    return _curve(spark, d)


@register("M18_curve_points", V("SELECT k, recall FROM curve WHERE k % 20 = 0 OR k IN (50)", CURVE_CTE))
def m18(spark, d):
    return ev.curve_points(_curve(spark, d), every=20, ks=[50])


@register("M8_core_effect", V("SELECT topic, core_id, n_cores, n_cps, recall FROM effect", EFFECT_CTE))
def m8(spark, d):
    return effect(spark, d).select("topic", "core_id", "n_cores", "n_cps", "recall")


@register("M9_quartile_means", V("""
SELECT round(avg(top), 3) AS avg_top_25, round(avg(mid), 4) AS avg_mid_50, round(avg(bot), 3) AS avg_bot_25 FROM (
  SELECT topic, avg(CASE WHEN p < c1 THEN recall END) AS top,
         avg(CASE WHEN p >= c1 AND p < c2 THEN recall END) AS mid,
         avg(CASE WHEN p >= c2 THEN recall END) AS bot
  FROM (SELECT topic, recall, row_number() OVER (PARTITION BY topic ORDER BY recall DESC) - 1 AS p,
               floor(count(*) OVER (PARTITION BY topic) * 0.25) AS c1,
               floor(count(*) OVER (PARTITION BY topic) * 0.75) AS c2 FROM effect) x
  GROUP BY topic) y""", EFFECT_CTE))
def m9(spark, d):
    return ev.quartile_means(effect(spark, d))


CMP_CTE = EFFECT_CTE + f""",
prompt_runs AS (
  SELECT topic, core_id, id, row_number() OVER (PARTITION BY core_id ORDER BY score DESC, id) AS rank FROM (
    SELECT c.topic, c.id AS core_id, e.vec_id AS id,
           round(list_cosine_similarity(list_transform(list_zip(v.embedding::DOUBLE[], s.vector), lambda z: (z[1] + z[2]) / 2), e.embedding::DOUBLE[]), 6) AS score
    FROM eval_cps c JOIN embeddings v ON v.vec_id = c.id JOIN seed_queries s ON s.topic = c.topic AND s.run = 1 CROSS JOIN embeddings e) s
  QUALIFY rank <= {K_RUN}),
effect_b AS (
  SELECT q.topic, q.core_id, round(coalesce(f.n, 0) / c.n_cps, 2) AS recall
  FROM (SELECT DISTINCT topic, core_id FROM prompt_runs) q
  LEFT JOIN (SELECT r.topic, r.core_id, count(t.title) AS n
             FROM (SELECT DISTINCT topic, core_id, id FROM prompt_runs) r
             JOIN eval_cps t ON t.topic = r.topic AND t.id = r.id GROUP BY r.topic, r.core_id) f
    ON f.topic = q.topic AND f.core_id = q.core_id
  LEFT JOIN ncps c ON c.topic = q.topic),
cmp AS (
  SELECT a.topic, a.max_a, a.min_a, a.mean_a, b.max_b, b.min_b, b.mean_b,
         round(a.max_a - b.max_b, 9) AS diff_max, round(a.min_a - b.min_b, 9) AS diff_min,
         round(a.mean_a - b.mean_b, 9) AS diff_mean
  FROM (SELECT topic, max(recall) AS max_a, min(recall) AS min_a, round(avg(recall), 9) AS mean_a
        FROM effect GROUP BY topic) a
  JOIN (SELECT topic, max(recall) AS max_b, min(recall) AS min_b, round(avg(recall), 9) AS mean_b
        FROM effect_b GROUP BY topic) b
    ON a.topic = b.topic)
"""


def _cmp(spark, d):
    """Two ways to ask with a core publication: alone, and together with the topic's first one."""
    cps = fx.eval_cps(spark, d)
    return ev.compare_prompts(ev.core_effect(core_runs(spark, d), cps), ev.core_effect(core_runs(spark, d, with_seed=True), cps))


@register("M10_compare_prompts", V("SELECT * FROM cmp", CMP_CTE))
def m10(spark, d):
    return _cmp(spark, d)


@register("M10_prompt_summary", V("""
SELECT CAST(sum(CASE WHEN diff_mean > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_a_better,
       CAST(sum(CASE WHEN diff_mean < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_b_better,
       CAST(sum(CASE WHEN diff_mean = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_same,
       round(avg(mean_a), 9) AS mean_a, round(avg(mean_b), 9) AS mean_b FROM cmp""", CMP_CTE))
def m10b(spark, d):
    return ev.prompt_summary(_cmp(spark, d))


@register("M20_recall_spread", V("""
SELECT topic, min(recall) AS "min", round(quantile_cont(recall, 0.25), 9) AS q1,
       round(quantile_cont(recall, 0.5), 9) AS median, round(quantile_cont(recall, 0.75), 9) AS q3, max(recall) AS "max"
FROM effect GROUP BY topic""", EFFECT_CTE))
def m20(spark, d):
    return rnd(ev.recall_spread(effect(spark, d)), "q1", "median", "q3")


WIDE_CTE = RUNS_CTE + """,
per AS (""" + recall_sql("runs", ["run"], "rank <= 50") + """),
wide AS (SELECT topic, max(CASE WHEN run = 1 THEN recall END) AS r1, max(CASE WHEN run = 2 THEN recall END) AS r2,
                max(CASE WHEN run = 3 THEN recall END) AS r3 FROM per GROUP BY topic)
"""


@register("M21_best_setting", V("""
SELECT topic, greatest(r1, r2, r3) AS best_value,
       concat_ws(',', CASE WHEN r1 = greatest(r1, r2, r3) THEN 'r1' END,
                 CASE WHEN r2 = greatest(r1, r2, r3) THEN 'r2' END,
                 CASE WHEN r3 = greatest(r1, r2, r3) THEN 'r3' END) AS best
FROM wide""", WIDE_CTE))
def m21(spark, d):
    per = ev.recall_at_k(seed_runs(spark, d), fx.eval_cps(spark, d), 50, run_keys=["run"])
    w = ev.wide(per.withColumn("setting", F.concat(F.lit("r"), F.col("run").cast("string"))),
                "topic", "setting", "recall", ["r1", "r2", "r3"])
    return ev.best_setting(w, ["r1", "r2", "r3"])


# ----------------------------------------------------------------------------- M12-M17
@register("M12_grid_recall", V("SELECT run, topic, n_cps, n_found, recall FROM (" +
                               recall_sql("runs", ["run"], count="count(t.title)") + ") x", RUNS_CTE))
def m12(spark, d):
    return ev.grid_recall(seed_runs(spark, d), fx.eval_cps(spark, d), ["run"])


@register("M12_grid_summary", V("""
SELECT run, round(avg(recall), 9) AS recall FROM (
  SELECT run, topic, avg(recall) AS recall FROM (""" + recall_sql("runs", ["run"], count="count(t.title)") + """) x GROUP BY run, topic) y
GROUP BY run""", RUNS_CTE))
def m12b(spark, d):
    per = ev.grid_recall(seed_runs(spark, d), fx.eval_cps(spark, d), ["run"]).withColumn("has_text", F.lit(False))
    return rnd(ev.grid_summary(per, "run"), "recall")


VARIANT_CTE = CFG_SQL.strip() + """,
gridq AS (SELECT q.topic, q.rq_count, h.has_text, q.include_sub,
                 q.topic * 16 + CASE q.rq_count WHEN 1 THEN 0 WHEN 3 THEN 4 WHEN 5 THEN 8 ELSE 12 END + CASE WHEN h.has_text THEN 2 ELSE 0 END + CASE WHEN q.include_sub THEN 1 ELSE 0 END AS query_id,
                 CASE WHEN h.has_text THEN 'Research Questions:' || chr(10) || q.questions || ' [SEP] Supporting Documents:' || chr(10) || ' ' || b.text ELSE q.questions END AS query
          FROM qblock q CROSS JOIN (SELECT unnest([true, false]) AS has_text) h JOIN benchmark b ON b.item_id = q.topic
          WHERE q.rq_count IN (1, 3, 5, 100) AND q.topic IN (SELECT topic FROM eval_cps)),
ncps AS (SELECT topic, count(*) AS n_cps FROM eval_cps GROUP BY topic),""" + bm25_sql(
    "(SELECT 0 AS g, doc_id AS id, text FROM documents)", "(SELECT 0 AS g, query_id, query FROM gridq)", "v", K_RUN).rstrip() + """,
vrun AS (SELECT g.rq_count, g.has_text, g.include_sub, g.topic, r.id, r.rank FROM v_ranked r JOIN gridq g ON g.query_id = r.query_id)
"""


def variant_runs(spark, d):
    """E5 -> R9: the sixteen query variants of every topic that has core publications, each asked as keywords over all documents."""
    topics = fx.eval_cps(spark, d).select(F.col("topic").cast("long").alias("topic")).distinct()
    texts = fx.table(spark, d, "benchmark").select(F.col("item_id").alias("topic"), "text")
    grid = em.query_grid(topic_config(spark, d).join(topics, "topic", "left_semi"), texts)
    step = F.when(F.col("rq_count") == 1, 0).when(F.col("rq_count") == 3, 4).when(F.col("rq_count") == 5, 8).otherwise(12)
    grid = materialize(grid.withColumn("query_id", F.col("topic") * 16 + step + F.col("has_text").cast("int") * 2 + F.col("include_sub").cast("int")), "query-grid")
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = rerank.bm25_plus(grid.select("query_id", "query"), docs, K_RUN)
    return hits.join(grid.select("query_id", F.col("topic").cast("int").alias("topic"), "rq_count", "has_text", "include_sub"), "query_id")


VARIANT = ["rq_count", "has_text", "include_sub"]


@register("M12_variant_recall", V("SELECT rq_count, has_text, include_sub, topic, n_cps, n_found, recall FROM (" +
                                  recall_sql("vrun", VARIANT, count="count(t.title)") + ") x", VARIANT_CTE))
def m12_variants(spark, d):
    """Recall of the sixteen variants per topic."""
    return ev.grid_recall(variant_runs(spark, d), fx.eval_cps(spark, d), VARIANT)


@register("M12_variant_summary", V("""
SELECT 'rq_count' AS setting, CAST(rq_count AS VARCHAR) AS value, round(avg(recall), 9) AS recall FROM (
  SELECT rq_count, topic, avg(recall) AS recall FROM rec WHERE NOT has_text GROUP BY rq_count, topic) y GROUP BY rq_count
UNION ALL
SELECT 'include_sub', CAST(include_sub AS VARCHAR), round(avg(recall), 9) FROM (
  SELECT include_sub, topic, avg(recall) AS recall FROM rec WHERE NOT has_text GROUP BY include_sub, topic) y GROUP BY include_sub""",
                                     VARIANT_CTE + ", rec AS (" + recall_sql("vrun", VARIANT, count="count(t.title)") + ")"))
def m12_variant_summary(spark, d):
    """Mean recall by number of questions and by sub-questions, of the variants without text."""
    per = materialize(ev.grid_recall(variant_runs(spark, d), fx.eval_cps(spark, d), VARIANT), "variant-recall")
    out = [rnd(ev.grid_summary(per, by), "recall").select(F.lit(by).alias("setting"), F.col(by).cast("string").alias("value"), "recall") for by in ("rq_count", "include_sub")]
    return out[0].unionByName(out[1])


@register("M13_paired_recall", V("""
SELECT coalesce(CAST(topic AS VARCHAR), 'Average') AS topic, round(avg(n_cps), 9) AS n_cps,
       round(avg(found_real), 9) AS found_real, round(avg(recall_real), 9) AS recall_real,
       round(avg(found_generated), 9) AS found_generated, round(avg(recall_generated), 9) AS recall_generated,
       topic IS NULL AS is_average
FROM (SELECT coalesce(a.topic, b.topic) AS topic, a.n_cps, a.n_found AS found_real, a.recall AS recall_real,
             b.n_found AS found_generated, b.recall AS recall_generated
      FROM (""" + recall_sql("(SELECT * FROM runs WHERE run = 1)", [], "rank <= 50", "count(t.title)") + """) a
      FULL JOIN (""" + recall_sql("(SELECT * FROM runs WHERE run = 2)", [], "rank <= 50", "count(t.title)") + """) b
        ON a.topic = b.topic) j
GROUP BY ROLLUP (topic)""", RUNS_CTE))
def m13(spark, d):
    runs = seed_runs(spark, d)
    out = ev.paired_recall(runs.filter("run = 1"), runs.filter("run = 2"), fx.eval_cps(spark, d), 50)
    return rnd(out, "n_cps", "found_real", "recall_real", "found_generated", "recall_generated")


M14_CTE = METHODS_CTES + """,
ncps AS (SELECT topic, count(*) AS n_cps FROM eval_cps GROUP BY topic),
topick AS (SELECT t.topic, coalesce(least(c.n, 10000), 10000) AS top_n
           FROM (SELECT DISTINCT topic FROM eval_cps) t
           LEFT JOIN (SELECT topic, count(*) AS n FROM slr_results GROUP BY topic) c ON c.topic = t.topic),
bk AS (SELECT r.topic, r.id, r.rank, k.top_n FROM run1 r JOIN topick k ON k.topic = r.topic),
rk AS (SELECT f.topic, f.id, f.rank, k.top_n FROM fused f JOIN topick k ON k.topic = f.topic WHERE f.rank <= 50)
"""


@register("M14_base_vs_rerank", V("""
SELECT coalesce(CAST(topic AS VARCHAR), 'Average') AS topic, round(avg(base), 9) AS base,
       round(avg(reranked), 9) AS reranked,
       topic IS NULL AS is_average FROM (
  SELECT coalesce(a.topic, b.topic) AS topic, a.recall AS base, b.recall AS reranked
  FROM (""" + recall_sql("bk", [], "rank <= top_n") + """) a
  FULL JOIN (""" + recall_sql("rk", [], "rank <= top_n") + """) b ON a.topic = b.topic) j
GROUP BY ROLLUP (topic)""", M14_CTE))
def m14(spark, d):
    run, methods = _methods(spark, d)
    from quarry.operators import rerank as rr
    fused = rr.rerank_all(methods, 50).filter("method = 'rrf'").select("topic", "id", "rank")
    cps = fx.eval_cps(spark, d)
    k = ev.topic_k(fx.slr_results(spark, d), cps)
    return rnd(ev.base_vs_rerank(run.select("topic", "id", "rank"), fused, cps, k), "base", "reranked")


@register("M15_method_recall", V("""
SELECT method, coalesce(CAST(topic AS VARCHAR), 'Average') AS topic, round(avg(recall), 9) AS recall,
       topic IS NULL AS is_average FROM (
  SELECT method, topic, avg(recall) AS recall FROM (""" + recall_sql(
    "(" + " UNION ALL ".join(f"SELECT 'f{r}' AS file, * FROM (SELECT topic, method, id, rank FROM methods_{r} UNION ALL "
                             f"SELECT topic, 'rrf', id, rank FROM fused_{r} WHERE rank <= 50) u{r}" for r in (1, 2, 3)) + ")", ["file", "method"]) + """) x
  GROUP BY method, topic) y
GROUP BY ROLLUP (method, topic) HAVING method IS NOT NULL""", _SEARCH_CTE + "".join(methods_of(r) for r in (1, 2, 3)) + """,
ncps AS (SELECT topic, count(*) AS n_cps FROM eval_cps GROUP BY topic)"""))
def m15(spark, d):
    """Three files of reranked runs, one per seed run."""
    from quarry.operators import rerank as rr
    long = None
    for r in (1, 2, 3):
        own = rr.rerank_all(_methods(spark, d, r)[1], 50).withColumn("file", F.lit(f"f{r}"))
        long = own if long is None else long.unionByName(own)
    return rnd(ev.method_recall(materialize(long, "reranked-files"), fx.eval_cps(spark, d)), "recall")


@register("M16_availability", V("""
SELECT e.topic, e.expected, coalesce(f.found, 0) AS found, coalesce(f.found, 0) / e.expected AS share
FROM (SELECT topic, count(*) AS expected FROM eval_cps GROUP BY topic) e
LEFT JOIN (SELECT topic, count(*) AS found FROM eval_cps WHERE id IN (SELECT doc_id FROM documents)
           GROUP BY topic) f ON f.topic = e.topic"""))
def m16(spark, d):
    found = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return ev.availability(fx.eval_cps(spark, d).select("topic", "id"), found)


@register("M17_report", V("""
SELECT coalesce(CAST(topic AS VARCHAR), 'Average') AS topic, CAST(round(avg(ours * 100)) AS INTEGER) AS ours,
       CAST(round(avg(keyword * 100)) AS INTEGER) AS keyword, CAST(round(avg(sample_size)) AS INTEGER) AS k,
       topic IS NULL AS is_average
FROM m5 WHERE keyword IS NOT NULL AND keyword <> 0 AND ours IS NOT NULL
GROUP BY ROLLUP (topic)""", M4_CTE))
def m17(spark, d):
    return ev.report(_m5(spark, d))


# ----------------------------------------------------------------------------- M22, E10
@register("M22_run_label", V("""
SELECT topic, id, rank, 'seed' AS core_type, CAST(run AS INTEGER) AS n_hyde, CAST(run AS INTEGER) AS trial
FROM runs""", RUNS_CTE))
def m22(spark, d):
    runs = seed_runs(spark, d)
    base = sio.scratch_path(spark, "runs")
    for r in (1, 2, 3):
        (runs.filter(F.col("run") == r).select("topic", "id", "rank").write.mode("overwrite")
         .parquet(f"{base}/cp_seed_hyde_{r}_run-{r}.parquet"))
    back = spark.read.parquet(f"{base}/*.parquet").withColumn("_path", F.col("_metadata.file_path"))
    return ev.run_label(back).select("topic", "id", "rank", "core_type", "n_hyde", "trial")


@register("E10_select_core", V("""
SELECT topic, core_id, n_cores, kind FROM (
  SELECT topic, core_id, n_cores, row_number() OVER (PARTITION BY topic ORDER BY n_cores DESC, core_id) AS pos,
         count(*) OVER (PARTITION BY topic) AS n FROM effect) x,
  (VALUES ('best'), ('middle'), ('worst')) k(kind)
WHERE (kind = 'best' AND pos = 1) OR (kind = 'middle' AND pos = floor(n / 2) + 1) OR (kind = 'worst' AND pos = n)""",
                                 EFFECT_CTE))
def e10(spark, d):
    # three cuts read it, and it is a search by every core: computed once
    eff = materialize(effect(spark, d).select("topic", "core_id", "n_cores"), "core-effect")
    out = None
    for kind in ("best", "middle", "worst"):
        p = em.select_core(eff, kind).withColumn("kind", F.lit(kind))
        out = p if out is None else out.unionByName(p)
    return out


@register("E10_select_core_random", V("""
SELECT topic, core_id, n_cores FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY md5(CAST(core_id AS VARCHAR) || ':42'), core_id) AS r FROM effect) x
WHERE r = 1""", EFFECT_CTE))
def e10r(spark, d):
    return em.select_core(effect(spark, d).select("topic", "core_id", "n_cores"), "random", seed=42)


# ----------------------------------------------------------------------------- R3, R5, R6, R7, R16, R18
@register("R3_score_euclidean", V("""
SELECT query_id, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT q.query_id, e.vec_id AS id, round(-list_distance(q.vector, e.embedding::DOUBLE[]), 6) + 0.0 AS score
    FROM seed_queries q CROSS JOIN embeddings e WHERE q.run = 1) s) r
WHERE rank <= 100"""))
def r3(spark, d):
    q = fx.seed_queries(spark, d, 1)
    return srch.search(q, fx.corpus(spark, d), 100, metric="neg_euclidean")


@register("R5_nearest", V("""
SELECT query_id, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT q.query_id, e.vec_id AS id, round(list_cosine_similarity(q.vector, e.embedding::DOUBLE[]), 6) AS score
    FROM seed_queries q CROSS JOIN embeddings e WHERE e.vec_id NOT IN (SELECT id FROM seeds)) s) r
WHERE rank = 1"""))
def r5(spark, d):
    q = fx.seed_queries(spark, d)
    return srch.nearest(q, fx.corpus(spark, d), fx.seeds(spark, d).select("id"))


@register("R7_compare_search", V("""
SELECT c.topic, c.n_cps, coalesce(a.f, 0) AS found_a, coalesce(b.f, 0) AS found_b, coalesce(o.f, 0) AS overlap,
       coalesce(a.f, 0) / c.n_cps AS recall_a, coalesce(b.f, 0) / c.n_cps AS recall_b
FROM (SELECT topic, count(*) AS n_cps FROM (SELECT DISTINCT topic, id FROM eval_cps) x GROUP BY topic) c
LEFT JOIN (SELECT r.topic, count(*) AS f FROM (SELECT DISTINCT topic, id FROM runs WHERE run = 1 AND rank <= 50) r
           WHERE (r.topic, r.id) IN (SELECT topic, id FROM eval_cps) GROUP BY r.topic) a ON a.topic = c.topic
LEFT JOIN (SELECT r.topic, count(*) AS f FROM (SELECT DISTINCT topic, id FROM runs WHERE run = 2 AND rank <= 50) r
           WHERE (r.topic, r.id) IN (SELECT topic, id FROM eval_cps) GROUP BY r.topic) b ON b.topic = c.topic
LEFT JOIN (SELECT x.topic, count(*) AS f FROM (SELECT DISTINCT topic, id FROM runs WHERE run = 1 AND rank <= 50) x
           JOIN (SELECT DISTINCT topic, id FROM runs WHERE run = 2 AND rank <= 50) y
             ON x.topic = y.topic AND x.id = y.id GROUP BY x.topic) o ON o.topic = c.topic""", RUNS_CTE))
def r7(spark, d):
    runs = seed_runs(spark, d).filter("rank <= 50")
    return srch.compare_search(runs.filter("run = 1"), runs.filter("run = 2"), fx.eval_cps(spark, d))


@register("R16_vector_parity", """
SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[],
         list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[],
                                                                          lambda y: y * y))))), 6) AS cosine,
       round(list_cosine_similarity(embedding::DOUBLE[],
         list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[],
                                                                          lambda y: y * y))))), 6) >= 0.99 AS ok
FROM embeddings""")
def r16(spark, d):
    from quarry.functions.vectors import as_double, norm
    a = fx.corpus(spark, d)
    b = a.select("id", F.transform(as_double("embedding"), lambda x: x / norm("embedding")).alias("embedding"))
    return srch.vector_parity(a, b)


R18_CTE = EFFECT_CTE + """,
best AS (SELECT topic, core_id FROM (
    SELECT topic, core_id, row_number() OVER (PARTITION BY topic ORDER BY n_cores DESC, core_id) AS pos
    FROM effect) x WHERE pos = 1),
members AS (SELECT topic, core_id AS id FROM best
            UNION ALL SELECT topic, id FROM seeds WHERE run = 1),
qv AS (SELECT topic, list(x ORDER BY dim) AS v FROM (
    SELECT m.topic, dim, avg(x) AS x FROM members m JOIN (
      SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) e
      ON e.vec_id = m.id
    GROUP BY m.topic, dim) y GROUP BY topic),
hits AS (SELECT topic, id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, id) AS rank FROM (
      SELECT q.topic, e.vec_id AS id, round(list_cosine_similarity(q.v, e.embedding::DOUBLE[]), 6) AS score
      FROM qv q CROSS JOIN embeddings e) s) r WHERE rank <= 50)
"""


@register("R18_topic_search_run", V("""
SELECT h.topic, h.id, h.score, h.rank, w.title FROM hits h LEFT JOIN works w ON w.id = h.id""", R18_CTE))
def r18(spark, d):
    return topic_search_run(spark, d, effect(spark, d).select("topic", "core_id", "n_cores"), 50)


def topic_search_run(spark, d, eff, k):
    """E10 best core per topic -> E6 centroid over the core and the topic's first
    seed (its stand-in generated document) -> R1 over the whole corpus -> text."""
    # ``eff`` may be a search of the whole corpus by every core: computed once
    best = materialize(em.select_core(eff, "best").select("topic", F.col("core_id").alias("id")), "best-cores")
    members = best.unionByName(fx.seeds(spark, d).filter("run = 1").select("topic", "id"))
    vecs = members.join(fx.corpus(spark, d), "id")
    q = em.centroid(vecs, ["topic"], "embedding", "vector")
    hits = srch.search(q.withColumn("query_id", F.col("topic")), fx.corpus(spark, d), k).withColumnRenamed(
        "query_id", "topic")
    return hits.join(fx.works(spark, d).select("id", "title"), "id", "left").select(
        "topic", "id", "score", "rank", "title")


@register("R18_run_with_texts", V(f"""
SELECT h.topic, h.id, h.score, h.rank,
       'Research Questions:' || chr(10) || q.questions || ' [SEP] Supporting Documents:' || chr(10) || ' ' || ({tx.sql_render('core', 'c.title', 'c.abstract')}) AS query,
       {tx.sql_render('run', 'w.title', 'w.abstract')} AS text
FROM hits h JOIN best b ON b.topic = h.topic LEFT JOIN eval_cps c ON c.id = b.core_id AND c.topic = b.topic
LEFT JOIN qblock q ON q.topic = h.topic AND q.rq_count = 2 AND q.include_sub LEFT JOIN works w ON w.id = h.id""", R18_CTE + "," + CFG_SQL.strip()))
def r18_texts(spark, d):
    """The whole run table: questions with the best core publication as query, and the texts of the hits."""
    cps = fx.eval_cps(spark, d)
    texts = fx.works(spark, d).select("id", tx.render_text("title", "abstract", "run").alias("text"))
    cfg = topic_config(spark, d).withColumn("topic", F.col("topic").cast("int"))
    return topic_search_run_with_texts(effect(spark, d).select("topic", "core_id", "n_cores"), cps, cfg, fx.corpus(spark, d), texts, 50,
                                       extra=fx.seeds(spark, d).filter("run = 1"), rq_count=2, include_sub=True)
