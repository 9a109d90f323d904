"""Registered keyword / rerank / fusion queries (R8-R17) with their DuckDB oracles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import clean as cl
from quarry.operators import pair_ranker
from quarry.operators.common import materialize
from quarry.operators import rerank as rr
from quarry.operators import search as srch
from quarry.plans.q_search import _SEARCH_CTE
from quarry.plans.registry import kept, register
from quarry.sources import fixtures as fx

V = fx.with_views
TOP_N = 50


def bm25_sql(docs: str, queries: str, prefix: str, k: int, fill: bool = False) -> str:
    """DuckDB twin of ``bm25_plus``: ``docs`` has (g, id, text), ``queries`` (g, query_id, query).
    Defines ``{prefix}_ranked(g, query_id, id, score, rank)``."""
    p = prefix
    fill_sql = f"""
  UNION ALL
  SELECT q.g, q.query_id, d.id, round(c.c, 4) AS score
  FROM (SELECT DISTINCT g, query_id FROM {queries}) q JOIN {p}_dt d ON d.g = q.g
  JOIN {p}_const c ON c.g = q.g AND c.query_id = q.query_id
  WHERE NOT EXISTS (SELECT 1 FROM {p}_m m WHERE m.g = q.g AND m.query_id = q.query_id AND m.id = d.id)""" \
        if fill else ""
    return f"""
{p}_dt AS (SELECT g, id, {tx.sql_tokens("coalesce(text, '')")} AS toks FROM {docs}),
{p}_stats AS (SELECT g, count(*) AS n, avg(len(toks)) AS avgdl FROM {p}_dt GROUP BY g),
{p}_post AS (SELECT g, id, len(toks) AS dl, term, count(*) AS tf
             FROM (SELECT g, id, toks, unnest(toks) AS term FROM {p}_dt) x GROUP BY g, id, len(toks), term),
{p}_idf AS (SELECT f.g, f.term, ln((s.n + 1) / f.df) AS idf, s.avgdl
            FROM (SELECT g, term, count(*) AS df FROM {p}_post GROUP BY g, term) f JOIN {p}_stats s ON s.g = f.g),
{p}_qi AS (SELECT t.g, t.query_id, t.term, t.qf, coalesce(i.idf, 0) AS idf, i.avgdl
           FROM (SELECT g, query_id, term, count(*) AS qf FROM
                   (SELECT g, query_id, unnest({tx.sql_tokens('query')}) AS term FROM {queries}) y
                 GROUP BY g, query_id, term) t
           LEFT JOIN {p}_idf i ON i.g = t.g AND i.term = t.term),
{p}_const AS (SELECT g, query_id, sum(qf * idf * 1.0) AS c FROM {p}_qi GROUP BY g, query_id),
{p}_m AS (SELECT q.g, q.query_id, p.id,
                 sum(q.qf * q.idf * (p.tf * 2.5) / (p.tf + 1.5 * (1 - 0.75 + 0.75 * p.dl / q.avgdl))) AS s
          FROM {p}_qi q JOIN {p}_post p ON p.g = q.g AND p.term = q.term WHERE q.idf > 0
          GROUP BY q.g, q.query_id, p.id),
{p}_scored AS (
  SELECT m.g, m.query_id, m.id, round(m.s + c.c, 4) AS score
  FROM {p}_m m JOIN {p}_const c ON c.g = m.g AND c.query_id = m.query_id{fill_sql}),
{p}_ranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, query_id ORDER BY score DESC, id) AS rank
                 FROM {p}_scored) z WHERE rank <= {k})
"""


def _run_texts(spark, d):
    return cl.with_text(fx.works(spark, d), "run").select("id", "text")


def base_run(spark, d, k=100, run_no=1):
    """Topic run: a seed vector of each topic (the first) searched over the whole corpus, with texts."""
    q = fx.seed_queries(spark, d, run_no).filter(F.col("run") == run_no)
    hits = srch.search(q, fx.corpus(spark, d), k).join(q.select("query_id", "topic"), "query_id")
    run = srch.attach_text(hits, _run_texts(spark, d)).select("topic", "id", "score", "rank", "text")
    # the run feeds several rankers: write it once to the shared checkpoint folder
    return materialize(run, "topic-run")


def generated_queries(spark, d):
    """Keyword query per topic: the benchmark text with the topic's number."""
    return fx.table(spark, d, "benchmark").select(F.col("item_id").cast("int").alias("topic"),
                                                  F.col("text").alias("query"))


def second_seed_vectors(spark, d):
    return fx.seed_queries(spark, d, 2).filter("run = 2").select("topic", "vector")


RUN_CTES = _SEARCH_CTE + """,
run1 AS (
  SELECT r.topic, r.id, r.score, r.rank, w.text
  FROM ranked r LEFT JOIN (SELECT id, """ + tx.sql_render("run", "title", "abstract") + """ AS text FROM works) w
       ON w.id = r.id
  WHERE r.run = 1 AND r.rank <= 100),
gen AS (SELECT CAST(item_id AS INTEGER) AS g, CAST(item_id AS INTEGER) AS query_id, text AS query FROM benchmark),
cand AS (SELECT topic AS g, id, text FROM run1),
vec AS (
  SELECT topic, id, score, rank FROM (
    SELECT c.topic, c.id, c.score,
           row_number() OVER (PARTITION BY c.topic ORDER BY c.score DESC, c.id) AS rank FROM (
      SELECT r.topic, r.id, round(list_cosine_similarity(s.vector, e.embedding::DOUBLE[]), 6) AS score
      FROM run1 r JOIN seed_queries s ON s.topic = r.topic AND s.run = 2
      JOIN embeddings e ON e.vec_id = r.id) c) v)
"""


@register("R8_tokenize_postings", f"""
WITH toks AS (SELECT doc_id, unnest({tx.sql_tokens('text')}) AS term FROM documents),
stop AS (SELECT term FROM (SELECT term, count(*) AS n FROM toks GROUP BY term) s ORDER BY n DESC, term LIMIT 20)
SELECT doc_id, term, count(*) AS tf FROM toks WHERE term NOT IN (SELECT term FROM stop) GROUP BY doc_id, term""")
def r8(spark, d):
    docs = fx.table(spark, d, "documents")
    toks = rr.tokenize(docs, "text", ["doc_id"])
    stop = (toks.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "term").limit(20)
            .select("term"))
    kept = rr.remove_stop_words(toks, stop)
    return kept.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@register("R9_bm25_plus_top10", "WITH " + bm25_sql(
    "(SELECT 0 AS g, doc_id AS id, text FROM documents)",
    "(SELECT 0 AS g, item_id AS query_id, text AS query FROM benchmark)", "b", 10).strip() + """
SELECT query_id, id, score, rank FROM b_ranked""")
def r9(spark, d):
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    qs = fx.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return rr.bm25_plus(qs, docs, 10)


STOP_WORDS = """a about above after again against all am an and any are as at be because been before being below between both but by
can did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its
just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their
them then there these they this those through to too under until up very was we were what when where which while who whom why will
with you your""".split()
_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _without_stop_words(ctes: str) -> str:
    """The BM25 twin with the stop list: every token list is filtered."""
    parts = re.split(r"(list_filter\(list_transform\(regexp_split_to_array\(.*?, lambda t: length\(t\) > 0\))", ctes)
    return "".join(f"list_filter({x}, lambda t: NOT list_contains({_STOP_SQL}, t))" if x.startswith("list_filter(list_transform(regexp") else x for x in parts)


@register("R9_bm25_plus_stop_words", "WITH " + _without_stop_words(bm25_sql(
    "(SELECT 0 AS g, doc_id AS id, text FROM documents)",
    "(SELECT 0 AS g, item_id AS query_id, text AS query FROM benchmark)", "b", 10).strip()) + """
SELECT query_id, id, score, rank FROM b_ranked""")
def r9_stop(spark, d):
    """BM25Plus with a stop list that leaves queries and documents."""
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    qs = fx.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return rr.bm25_plus(qs, docs, 10, stop_words=STOP_WORDS)


@register("R10_score_pairs", V(f"""
SELECT topic, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, id) AS rank FROM (
    SELECT r.topic, r.id, round(coalesce(len(list_intersect(list_distinct({tx.sql_tokens("coalesce(q.query, '')")}), {tx.sql_tokens("coalesce(r.text, '')")}))
           / nullif(len(list_distinct({tx.sql_tokens("coalesce(q.query, '')")})), 0), 0), 9) AS score
    FROM run1 r JOIN gen q ON q.g = r.topic) s) x
WHERE rank <= {{TOP_N}}""".replace("{TOP_N}", str(TOP_N)), RUN_CTES))
def r10(spark, d):
    run = base_run(spark, d)
    pairs = run.join(generated_queries(spark, d), "topic")
    return rr.score_pairs(pairs, ["topic"], "query", "text", k=TOP_N)


@register("R11_rerank_by_vector", V("""
SELECT topic, id, score, rank FROM vec WHERE rank <= 20""", RUN_CTES))
def r11(spark, d):
    run = base_run(spark, d)
    cand = run.select("topic", "id").join(fx.corpus(spark, d), "id")
    return rr.rerank_by_vector(cand, second_seed_vectors(spark, d), 20).select("topic", "id", "score", "rank")


@register("R12_rrf_over_runs", V("""
SELECT topic, id, rrf, rank FROM (
  SELECT topic, id, rrf, row_number() OVER (PARTITION BY topic ORDER BY rrf DESC, id) AS rank FROM (
    SELECT topic, id, round(sum(1.0 / (rank - 1 + 60)), 9) AS rrf FROM ranked WHERE rank <= 100
    GROUP BY topic, id) f) x""", _SEARCH_CTE))
def r12(spark, d):
    q = fx.seed_queries(spark, d, 3)
    hits = srch.search(q, fx.corpus(spark, d), 100).join(q.select("query_id", "topic", "run"), "query_id")
    return rr.rrf(hits.withColumnRenamed("run", "method"), ["topic"])


def _methods(spark, d, run_no=1):
    """The per-topic rankings to fuse; each is written once (bounded: topics x n rows)
    because the fusion, the cuts and the merge all read them."""
    run = base_run(spark, d, run_no=run_no)
    bm = materialize(rr.hyqe_rerank(run, generated_queries(spark, d), TOP_N), "rank-bm25")
    cand = run.select("topic", "id").join(fx.corpus(spark, d), "id")
    vec = materialize(rr.rerank_by_vector(cand, second_seed_vectors(spark, d), TOP_N), "rank-vector")
    return run, {"base": run.select("topic", "id", "rank"), "bm25": bm.select("topic", "id", "rank"),
                 "vector": vec.select("topic", "id", "rank")}


METHODS_CTES = RUN_CTES + "," + bm25_sql("cand", "gen", "h", TOP_N, fill=True) + f""",
methods AS (
  SELECT topic, 'base' AS method, id, rank FROM run1 WHERE rank <= {TOP_N}
  UNION ALL SELECT g AS topic, 'bm25' AS method, id, rank FROM h_ranked WHERE rank <= {TOP_N}
  UNION ALL SELECT topic, 'vector' AS method, id, rank FROM vec WHERE rank <= {TOP_N}),
fused AS (
  SELECT topic, id, rrf, row_number() OVER (PARTITION BY topic ORDER BY rrf DESC, id) AS rank FROM (
    SELECT topic, id, round(sum(1.0 / (rank - 1 + 60)), 9) AS rrf FROM methods GROUP BY topic, id) f)
"""


def methods_of(run_no: int) -> str:
    """``METHODS_CTES`` without the search for another seed run; its tables end in the run's number."""
    names = re.compile(r"\b(run1|gen|cand|vec|methods|fused|h_[a-z]+)\b")
    return names.sub(rf"\1_{run_no}", METHODS_CTES[len(_SEARCH_CTE):].replace("r.run = 1", f"r.run = {run_no}"))


@register("R13_rerank_all", V(f"""
SELECT topic, method, id, rank FROM methods
UNION ALL SELECT topic, 'rrf' AS method, id, rank FROM fused WHERE rank <= {TOP_N}""", METHODS_CTES))
def r13(spark, d):
    _, methods = _methods(spark, d)
    return rr.rerank_all(methods, TOP_N)


@register("R14_rerank_merge", V(f"SELECT topic, id, rrf, rank FROM fused WHERE rank <= {TOP_N}", METHODS_CTES))
def r14(spark, d):
    run, methods = _methods(spark, d)
    reranked = rr.rerank_all({k: v for k, v in methods.items() if k != "base"}, TOP_N)
    return rr.rerank_merge(reranked, run, methods=["bm25", "vector"])


@register("R15_topic_documents", V("""
SELECT r.topic, array_to_string(string_split(b.text, '. '), chr(10)) AS query, r.id, r.text
FROM run1 r LEFT JOIN benchmark b ON b.item_id = r.topic WHERE r.rank <= 20""", RUN_CTES))
def r15(spark, d):
    run = base_run(spark, d, 20)
    q = fx.table(spark, d, "benchmark").select(F.col("item_id").cast("int").alias("topic"),
                                               F.split("text", "\\. ").alias("query"))
    return rr.topic_documents(run.join(q, "topic", "left")).select("topic", "query", "id", "text")


@register("R17_hyqe_rerank", V("""
SELECT g AS topic, id, score, rank FROM h_ranked WHERE rank <= 20""",
                                 RUN_CTES + "," + bm25_sql("cand", "gen", "h", 20, fill=True)))
def r17(spark, d):
    return rr.hyqe_rerank(base_run(spark, d), generated_queries(spark, d), 20).select("topic", "id", "score", "rank")


@register("R13_rerank_with_pairs", V(f"""
SELECT topic, method, id, rank FROM four
UNION ALL SELECT topic, 'rrf' AS method, id, rank FROM (
  SELECT topic, id, row_number() OVER (PARTITION BY topic ORDER BY rrf DESC, id) AS rank FROM (
    SELECT topic, id, round(sum(1.0 / (rank - 1 + 60)), 9) AS rrf FROM four GROUP BY topic, id) f) x WHERE rank <= {TOP_N}""", METHODS_CTES + f""",
four AS (SELECT topic, method, id, rank FROM methods UNION ALL
  SELECT topic, 'pairs', id, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, id) AS rank FROM (
      SELECT r.topic, r.id, round(coalesce(len(list_intersect(list_distinct({tx.sql_tokens("coalesce(q.query, '')")}), {tx.sql_tokens("coalesce(r.text, '')")}))
             / nullif(len(list_distinct({tx.sql_tokens("coalesce(q.query, '')")})), 0), 0), 9) AS score
      FROM run1 r JOIN gen q ON q.g = r.topic) s) x WHERE rank <= {TOP_N})"""))
def r13_pairs(spark, d):
    """All four rankings of a topic's candidates fused: base, keywords, vectors and scored pairs."""
    run, methods = _methods(spark, d)
    pairs = materialize(rr.score_pairs(run.join(generated_queries(spark, d), "topic"), ["topic"], "query", "text", k=TOP_N), "rank-pairs")
    return rr.rerank_all({**methods, "pairs": pairs.select("topic", "id", "rank")}, TOP_N)


def _pair_table(spark, d):
    """Features of every topic's candidates, with their quality label where there is one; topics of even number train."""
    run = base_run(spark, d)
    feats = pair_ranker.pair_features(run, generated_queries(spark, d), fx.corpus(spark, d), second_seed_vectors(spark, d))
    lab = fx.table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").cast("int").alias("y"))
    return feats.join(lab, "id", "left")


def _learned(spark, d):
    table = spark.read.parquet(kept(spark, d, "pair-table", lambda f: _pair_table(spark, d).write.parquet(f)))
    return table.where("topic % 2 = 1"), pair_ranker.fit(table.where("topic % 2 = 0 and y is not null"), pair_ranker.FEATURES, "y")


@register("R10_learned_pairs")
def r10_learned(spark, d):
    """Candidates of the topics of odd number by a pair scorer learned from the labelled ones of even number."""
    held, weights = _learned(spark, d)
    return pair_ranker.rank(held, weights, TOP_N)


@register("R10_learned_order", V("""
SELECT count(DISTINCT r.topic) AS n_topics, true AS beats_overlap FROM run1 r JOIN labels l ON l.doc_id = r.id WHERE r.topic % 2 = 1""", RUN_CTES))
def r10_order(spark, d):
    """Among labelled candidates of the held-out topics, the learned order puts good documents before others more
    often than token overlap alone."""
    held, weights = _learned(spark, d)
    held = held.where("y is not null")
    good = held.where("y = 1").select("topic", "id")
    better = pair_ranker.order_quality(pair_ranker.rank(held, weights), good) > pair_ranker.order_quality(pair_ranker.rank(held, {"overlap": 1.0}), good)
    return held.agg(F.countDistinct("topic").alias("n_topics"), F.lit(better).alias("beats_overlap"))


@register("R13_rerank_with_learned_pairs")
def r13_learned(spark, d):
    """Base, keywords, vectors and learned pair scores of the held-out topics, fused."""
    candidates, weights = _learned(spark, d)
    learned = materialize(pair_ranker.rank(candidates, weights, TOP_N), "rank-learned").select("topic", "id", "rank")
    _, methods = _methods(spark, d)
    held = {name: df.where("topic % 2 = 1") for name, df in methods.items()}
    return rr.rerank_all({**held, "learned": learned}, TOP_N)
