"""Registered relevance-feedback queries (F1-F9) with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions.vectors import round_half_away
from quarry.operators import evaluate as ev
from quarry.operators import feedback as fb
from quarry.operators.common import materialize
from quarry.plans.q_evaluate import RUNS_CTE, seed_runs
from quarry.plans.q_rerank import base_run
from quarry.plans.registry import register
from quarry.sources import fixtures as fx

V = fx.with_views
REVIEWED = 10  # the first candidates of each topic count as already screened


def pool(spark, d):
    return fb.candidate_pool(base_run(spark, d), fx.works(spark, d), fx.eval_cps(spark, d))


def pool_vectors(spark, d):
    p = pool(spark, d)
    return p.join(fx.corpus(spark, d), "id")


def _topic_pool(spark, d):
    """The topics' candidates, searched and written once, with those already screened."""
    p = materialize(pool(spark, d), "topic-pool")
    return p, p.filter(F.col("rank") <= REVIEWED).select("topic", "id", "included")


POOL_CTE = RUNS_CTE + """,
run1 AS (SELECT topic, id, score, rank FROM runs WHERE run = 1),
cand AS (SELECT w.id, w.title, w.abstract, r.topic, r.score, r.rank,
                CASE WHEN e.id IS NOT NULL THEN 1 ELSE 0 END AS included
         FROM works w JOIN run1 r ON r.id = w.id
         LEFT JOIN (SELECT DISTINCT topic, id FROM eval_cps) e ON e.topic = r.topic AND e.id = w.id),
pool AS (SELECT id, title, abstract, topic, score, rank, included FROM (
           SELECT *, row_number() OVER (PARTITION BY topic, title, abstract ORDER BY id) AS rn FROM cand) x
         WHERE rn = 1),
pv AS (SELECT p.*, e.embedding::DOUBLE[] AS v FROM pool p JOIN embeddings e ON e.vec_id = p.id),
lab AS (SELECT topic, id, included FROM pool WHERE rank <= """ + str(REVIEWED) + """),
dims AS (SELECT l.topic, l.included, dim, avg(x) AS x FROM lab l JOIN (
           SELECT topic, id, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM pv) u
           ON u.topic = l.topic AND u.id = l.id GROUP BY l.topic, l.included, dim),
fvec AS (SELECT p.topic, p.dim, CASE WHEN n.x IS NULL THEN p.x ELSE 2.0 * p.x - n.x END AS x
         FROM (SELECT * FROM dims WHERE included = 1) p
         LEFT JOIN (SELECT * FROM dims WHERE included = 0) n ON n.topic = p.topic AND n.dim = p.dim)
"""


@register("F1_candidate_pool", V("SELECT id, title, abstract, topic, score, rank, included FROM pool", POOL_CTE))
def f1(spark, d):
    return pool(spark, d).select("id", "title", "abstract", "topic", "score", "rank", "included")


@register("F2_split_pool", V("""
SELECT topic, id, included, CASE WHEN included = 1 THEN 'pos' ELSE 'neg' END AS side FROM pv""", POOL_CTE))
def f2(spark, d):
    pos, neg = fb.split_pool(pool(spark, d), fx.corpus(spark, d))
    return (pos.select("topic", "id", "included", F.lit("pos").alias("side"))
            .unionByName(neg.select("topic", "id", "included", F.lit("neg").alias("side"))))


@register("F3_feedback_vector", V("""
SELECT topic, CAST(dim - 1 AS INTEGER) AS dim, round(x, 6) AS value FROM fvec""", POOL_CTE))
def f3(spark, d):
    pv = pool_vectors(spark, d).filter(F.col("rank") <= REVIEWED)
    v = fb.feedback_vector(pv.filter("included = 1"), pv.filter("included = 0"))
    return v.select("topic", F.posexplode("vector").alias("dim", "value")).withColumn(
        "value", round_half_away("value", 6))


@register("F4_rank_by_feedback", V("""
SELECT topic, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, id) AS rank FROM (
    SELECT p.topic, p.id, round(list_cosine_similarity(q.v, p.v), 6) AS score
    FROM pv p JOIN (SELECT topic, list(x ORDER BY dim) AS v FROM fvec GROUP BY topic) q ON q.topic = p.topic
    WHERE p.rank > """ + str(REVIEWED) + """) s) r
WHERE rank <= 5""", POOL_CTE))
def f4(spark, d):
    p, lab = _topic_pool(spark, d)
    pv = p.select("topic", "id").join(fx.corpus(spark, d), "id").select("topic", "id", "embedding")
    return fb.rank_by_feedback(pv, lab, 5).select("topic", "id", "score", "rank")


def _one_review(spark, d):
    """All topics' candidates as one review (the labels of every topic count)."""
    p, lab = _topic_pool(spark, d)
    pv = p.join(fx.corpus(spark, d), "id").select("id", "embedding").dropDuplicates(["id"])
    lab = lab.groupBy("id").agg(F.max("included").alias("included"))
    return pv, lab


@register("F5_rank_by_classifier_svm")
def f5_svm(spark, d):
    pv, lab = _one_review(spark, d)
    return fb.rank_by_classifier(pv, lab, "svm", 10)


@register("F5_rank_by_classifier_gbt")
def f5_gbt(spark, d):
    pv, lab = _one_review(spark, d)
    return fb.rank_by_classifier(pv, lab, "gbt", 10)


@register("F5_rank_by_classifier_mlp")
def f5_mlp(spark, d):
    pv, lab = _one_review(spark, d)
    return fb.rank_by_classifier(pv, lab, "mlp", 10)


@register("F6_rank_by_text")
def f6(spark, d):
    p, lab = _topic_pool(spark, d)
    p = p.select("id", F.concat_ws(" ", "title", "abstract").alias("text")).dropDuplicates(["id"])
    lab = lab.groupBy("id").agg(F.max("included").alias("included"))
    return fb.rank_by_text(p, lab, 10)


def _by_topic(spark, d, kind):
    p, lab = _topic_pool(spark, d)
    pv = p.select("topic", "id").join(fx.corpus(spark, d), "id")
    return fb.rank_topics_by_classifier(pv, lab, kind, 10)


# Fisher's discriminant in SQL: the regularised scatter S of a topic, then S w = difference of means by conjugate gradients.
LDA_CTE = """,
lrow AS (SELECT l.topic, l.included AS c, p.v FROM lab l JOIN pv p ON p.topic = l.topic AND p.id = l.id),
lcount AS (SELECT topic, sum(c) AS n1, sum(1 - c) AS n0 FROM lrow GROUP BY topic HAVING sum(c) > 0 AND sum(1 - c) > 0),
lmean AS (SELECT topic, c, list(m ORDER BY i) AS m FROM (
            SELECT topic, c, i, avg(x) AS m FROM (SELECT topic, c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM lrow) u GROUP BY topic, c, i) g GROUP BY topic, c),
ldev AS (SELECT r.topic, list_transform(list_zip(r.v, m.m), lambda z: z[1] - z[2]) AS z FROM lrow r JOIN lmean m ON m.topic = r.topic AND m.c = r.c JOIN lcount n ON n.topic = r.topic),
lcell AS (SELECT topic, i, j, sum(z[i] * z[j]) / count(*) AS s FROM ldev, range(1, 65) a(i), range(1, 65) b(j) GROUP BY topic, i, j),
ltrace AS (SELECT topic, sum(s) / count(*) AS t FROM lcell WHERE i = j GROUP BY topic),
lmat AS (SELECT topic, list(a ORDER BY i) AS a FROM (
           SELECT c.topic, i, list(0.9::DOUBLE * s + CASE WHEN i = j THEN 0.1::DOUBLE * t ELSE 0 END ORDER BY j) AS a FROM lcell c JOIN ltrace USING (topic) GROUP BY c.topic, i) r GROUP BY topic),
lsys AS (SELECT p.topic, a, list_transform(list_zip(p.m, q.m), lambda z: z[1] - z[2]) AS b FROM lmean p JOIN lmean q ON q.topic = p.topic AND q.c = 0 JOIN lmat t ON t.topic = p.topic WHERE p.c = 1),
cg(topic, it, x, r, p) AS (
  SELECT topic, 0, list_transform(b, lambda e: 0::DOUBLE), b, b FROM lsys
  UNION ALL
  SELECT topic, it + 1, x, r, list_transform(list_zip(r, p), lambda z: z[1] + CASE WHEN old > 1e-300 THEN list_dot_product(r, r) / old ELSE 0 END * z[2]) FROM (
    SELECT topic, it, list_transform(list_zip(x, p), lambda z: z[1] + al * z[2]) AS x, list_transform(list_zip(r, ap), lambda z: z[1] - al * z[2]) AS r, p, old FROM (
      SELECT topic, it, x, r, p, ap, old, CASE WHEN list_dot_product(p, ap) > 1e-300 THEN old / list_dot_product(p, ap) ELSE 0 END AS al FROM (
        SELECT g.topic, it, x, r, p, list_dot_product(r, r) AS old, list_transform(s.a, lambda e: list_dot_product(e, p)) AS ap
        FROM cg g JOIN lsys s ON s.topic = g.topic WHERE it < 40) q1) q2) q3),
lda AS (SELECT g.topic, g.x AS w, ln(n1 / n0) - list_dot_product(g.x, list_transform(list_zip(p.m, q.m), lambda z: (z[1] + z[2]) / 2)) AS b
        FROM cg g JOIN lcount n ON n.topic = g.topic JOIN lmean p ON p.topic = g.topic AND p.c = 1 JOIN lmean q ON q.topic = g.topic AND q.c = 0 WHERE it = 40)
"""


@register("F5_rank_by_discriminant", V("""
SELECT topic, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, id) AS rank FROM (
    SELECT p.topic, p.id, round(list_dot_product(l.w, p.v) + l.b, 6) AS score FROM pv p JOIN lda l ON l.topic = p.topic WHERE p.rank > """ + str(REVIEWED) + """) s) r
WHERE rank <= 10""", POOL_CTE + LDA_CTE).replace("WITH ", "WITH RECURSIVE ", 1))
def f5_lda(spark, d):
    """Each topic's own discriminant ranks its candidates that are not screened yet."""
    return _by_topic(spark, d, "lda")


@register("F5_topics_svm")
def f5_topics_svm(spark, d):
    return _by_topic(spark, d, "svm")


@register("F5_topics_mlp")
def f5_topics_mlp(spark, d):
    return _by_topic(spark, d, "mlp")


@register("F5_topics_gbt")
def f5_topics_gbt(spark, d):
    return _by_topic(spark, d, "gbt")


@register("F6_rank_topics_by_text", V(f"""
SELECT topic, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, id) AS rank FROM (
    SELECT p.topic, p.id, round(coalesce(s.s, 0), 6) AS score FROM pool p JOIN tboth b ON b.topic = p.topic
    LEFT JOIN (SELECT x.topic, x.id, sum(x.x * (coalesce(w.w, 0) + t.o)) AS s FROM tx x JOIN ttot t ON t.topic = x.topic
               LEFT JOIN tw w ON w.topic = x.topic AND w.term = x.term GROUP BY x.topic, x.id) s ON s.topic = p.topic AND s.id = p.id
    WHERE p.rank > {REVIEWED}) z) r
WHERE rank <= 10""", POOL_CTE + f""",
ttf AS (SELECT topic, id, term, count(*) AS tf FROM (SELECT topic, id, unnest({tx.sql_tokens("concat_ws(' ', title, abstract)")}) AS term FROM pool) u GROUP BY topic, id, term),
tn AS (SELECT topic, count(*) AS n FROM pool GROUP BY topic),
tidf AS (SELECT f.topic, term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM ttf f JOIN tn ON tn.topic = f.topic GROUP BY f.topic, term, n),
traw AS (SELECT f.topic, id, f.term, tf * idf AS x FROM ttf f JOIN tidf i ON i.topic = f.topic AND i.term = f.term),
tx AS (SELECT r.topic, r.id, term, x / norm AS x FROM traw r JOIN (SELECT topic, id, sqrt(sum(x * x)) AS norm FROM traw GROUP BY topic, id) n ON n.topic = r.topic AND n.id = r.id),
tboth AS (SELECT topic, sum(included) AS pos, sum(1 - included) AS neg FROM lab GROUP BY topic HAVING sum(included) > 0 AND sum(1 - included) > 0),
tc AS (SELECT x.topic, term, sum(CASE WHEN included = 1 THEN x * (pos + neg) / 2 / pos ELSE 0 END) AS p, sum(CASE WHEN included = 0 THEN x * (pos + neg) / 2 / neg ELSE 0 END) AS q
       FROM tx x JOIN lab l ON l.topic = x.topic AND l.id = x.id JOIN tboth b ON b.topic = x.topic GROUP BY x.topic, term),
ttot AS (SELECT b.topic, ln((coalesce(q, 0) + {fb.NB_ALPHA}::DOUBLE * v) / (coalesce(p, 0) + {fb.NB_ALPHA}::DOUBLE * v)) AS o FROM tboth b
         LEFT JOIN (SELECT topic, sum(p) AS p, sum(q) AS q FROM tc GROUP BY topic) s ON s.topic = b.topic
         JOIN (SELECT topic, count(*) AS v FROM tidf GROUP BY topic) v ON v.topic = b.topic),
tw AS (SELECT topic, term, ln((p + {fb.NB_ALPHA}::DOUBLE) / (q + {fb.NB_ALPHA}::DOUBLE)) AS w FROM tc)
"""))
def f6_topics(spark, d):
    """Each topic's own word weights rank its candidates that are not screened yet."""
    p, lab = _topic_pool(spark, d)
    return fb.rank_topics_by_text(p.select("topic", "id", F.concat_ws(" ", "title", "abstract").alias("text")), lab, 10)


CURVE_CTE = RUNS_CTE + """,
spine AS (SELECT p.run, p.topic, i FROM (SELECT DISTINCT run, topic FROM runs) p, range(0, 100) t(i)),
hits AS (SELECT r.run, r.topic, r.rank FROM runs r JOIN eval_cps c ON c.topic = r.topic AND c.id = r.id),
curves AS (SELECT s.run, s.topic, CAST(s.i AS INTEGER) AS i,
                  (SELECT count(*) FROM hits h WHERE h.run = s.run AND h.topic = s.topic AND h.rank <= s.i)
                  / n.n_cps AS recall
           FROM spine s JOIN ncps n ON n.topic = s.topic)
"""


def curves(spark, d):
    """The curves of all runs; the runs are searched and written once, as curves read them twice."""
    return fb.screening_curve(materialize(seed_runs(spark, d), "seed-runs"), fx.eval_cps(spark, d), 100, keys=["run"])


@register("F7_screening_curve", V("SELECT run, topic, i, recall FROM curves", CURVE_CTE))
def f7(spark, d):
    return curves(spark, d)


@register("F8_average_curves", V("""
SELECT CAST(s.i AS BIGINT) AS k, round(avg(coalesce(c.recall, 1.0)), 9) AS recall
FROM (SELECT t.run, t.topic, i FROM (SELECT DISTINCT run, topic FROM curves) t, range(0, 150) r(i)) s
LEFT JOIN (SELECT c.run, c.topic, c.i, c.recall FROM curves c JOIN topick k ON k.topic = c.topic
           WHERE c.i < k.top_n) c ON c.run = s.run AND c.topic = s.topic AND c.i = s.i
GROUP BY s.i""", CURVE_CTE))
def f8(spark, d):
    k = ev.topic_k(fx.slr_results(spark, d), fx.eval_cps(spark, d))
    c = curves(spark, d).join(k, "topic").filter(F.col("i") < F.col("top_n"))
    out = fb.average_curves(c.select(F.struct("run", "topic").alias("curve"), "i", "recall"), 150, topic="curve")
    return out.withColumn("recall", round_half_away("recall", 9))


@register("F9_screening_best", V("""
SELECT round(avg(best), 9) AS mean_best, count(*) AS n_topics FROM (
  SELECT topic, avg(b) AS best FROM (
    SELECT run, topic, max(recall) AS b FROM curves WHERE i < 50 GROUP BY run, topic) x GROUP BY topic) y""",
                                   CURVE_CTE))
def f9(spark, d):
    return fb.screening_best(curves(spark, d), 50, []).withColumn("mean_best", round_half_away("mean_best", 9))
