"""Registered search queries (R1-R7, R11, R16, R18) and the flagship."""

from __future__ import annotations


from quarry.operators import evaluate as ev
from quarry.operators import search as srch
from quarry.plans.registry import register
from quarry.sources import fixtures as fx


def seed_run(spark, sf_dir, k, runs=1):
    """Search the whole vector corpus with the seed vectors of every topic."""
    q = fx.seed_queries(spark, sf_dir, runs)
    hits = srch.search(q, fx.corpus(spark, sf_dir), k)
    return hits.join(q.select("query_id", "topic", "run"), "query_id")


def flagship(spark, sf_dir):
    """Each topic's first vector as the query, exact search, recall@50 per topic."""
    run = seed_run(spark, sf_dir, 50, runs=1)
    return ev.recall_at_k(run, fx.eval_cps(spark, sf_dir), 50)


_SEARCH_CTE = """
scored AS (
  SELECT q.query_id, q.topic, q.run, e.vec_id AS id,
         round(list_cosine_similarity(q.vector, e.embedding::DOUBLE[]), 6) AS score
  FROM seed_queries q CROSS JOIN embeddings e),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)
"""

register("flagship_recall_at_50", fx.with_views("""
SELECT r.topic, c.n_cps, coalesce(f.n_found, 0) AS n_found, coalesce(f.n_found, 0) / c.n_cps AS recall
FROM (SELECT DISTINCT topic FROM ranked WHERE run = 1) r
LEFT JOIN (SELECT topic, count(*) AS n_cps FROM eval_cps GROUP BY topic) c ON c.topic = r.topic
LEFT JOIN (SELECT h.topic, count(*) AS n_found
           FROM (SELECT DISTINCT topic, id FROM ranked WHERE run = 1 AND rank <= 50) h
           JOIN eval_cps t ON t.topic = h.topic AND t.id = h.id GROUP BY h.topic) f ON f.topic = r.topic
""", _SEARCH_CTE))(flagship)


@register("R1_exact_search_top100", fx.with_views("""
SELECT query_id, id, score, rank FROM ranked WHERE rank <= 100
""", _SEARCH_CTE))
def r1_exact_search(spark, sf_dir):
    q = fx.seed_queries(spark, sf_dir, 3)
    return srch.search(q, fx.corpus(spark, sf_dir), 100)


@register("R2_search_blocked_multilevel", fx.with_views("""
SELECT query_id, id, score, rank FROM ranked WHERE rank <= 100
""", _SEARCH_CTE))
def r2_blocked(spark, sf_dir):
    """The same answer from 16 corpus partitions merged through three window levels (fan-in 2)."""
    q = fx.seed_queries(spark, sf_dir, 3)
    return srch.search(q, fx.corpus(spark, sf_dir).repartition(16), 100, fan_in=2)


@register("R1_search_many_passes", """
SELECT query_id, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
    FROM embeddings a CROSS JOIN embeddings b) s) r
WHERE rank <= 5""")
def r1_many(spark, sf_dir):
    """Every vector is a query, in passes of 128 queries by position."""
    c = fx.corpus(spark, sf_dir)
    return srch.search(c.selectExpr("id as query_id", "embedding as vector"), c, 5, max_queries_per_pass=128)
