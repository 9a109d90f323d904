"""Registered query-construction queries (E1-E9) with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions.vectors import round_half_away
from quarry.operators import embed as em
from quarry.operators.text_encoder import encode_texts, fit_encoder
from quarry.plans.registry import kept, register
from quarry.sources import fixtures as fx

V = fx.with_views


def topic_config(spark, d):
    """A topic config derived from ``benchmark``: every item is a topic, its
    sentences are the research questions, comma clauses of a sentence its
    sub-questions.  Rows ``topic, rq_no, main, subs``."""
    b = fx.table(spark, d, "benchmark")
    s = b.select(F.col("item_id").alias("topic"), F.posexplode(F.split("text", "\\. ")).alias("p", "main"))
    parts = F.split("main", ", ")
    return s.select("topic", (F.col("p") + 1).alias("rq_no"), "main",
                    F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>")).alias("subs"))


CFG_SQL = """
cfg AS (
  SELECT topic, rq_no, main,
         CASE WHEN len(string_split(main, ', ')) > 1 THEN string_split(main, ', ') ELSE []::VARCHAR[] END AS subs
  FROM (SELECT item_id AS topic, unnest(string_split(text, '. ')) AS main,
               generate_subscripts(string_split(text, '. '), 1) AS rq_no FROM benchmark) s),
qblock AS (
  SELECT topic, rq_count, include_sub,
         string_agg('RQ' || rq_no || ': ' || main || chr(10) ||
                    CASE WHEN include_sub THEN array_to_string(list_transform(subs,
                         lambda x, j: 'RQ' || rq_no || '.' || j || ': ' || x || chr(10)), '') ELSE '' END,
                    '' ORDER BY rq_no) AS questions
  FROM cfg, (SELECT unnest([1, 2, 3, 5, 100]) AS rq_count),
       (SELECT unnest([true, false]) AS include_sub)
  WHERE rq_no <= rq_count
  GROUP BY topic, rq_count, include_sub)
"""


@register("E2_prefix_text", V("""
SELECT id, 'query: ' || title AS query_text,
       'Instruct: Given a research question, retrieve passages that answer the question.' || chr(10) || 'Query:' || title
         AS linq_query,
       'passage: ' || abstract AS passage_text,
       'Instruct: Given a web search query, retrieve relevant passages that answer the query.' || chr(10) || 'Query: ' || title AS s2p_query,
       'Instruct: Retrieve semantically similar text.' || chr(10) || 'Query: ' || title AS s2s_query,
       abstract || '</s>' AS nvembed_passage
FROM works"""))
def e2(spark, d):
    w = fx.works(spark, d)
    w = em.prefix_text(w, "title", "query", "e5", "query_text")
    w = em.prefix_text(w, "title", "query", "linq", "linq_query")
    w = em.prefix_text(w, "abstract", "passage", "e5", "passage_text")
    w = em.prefix_text(w, "title", "query", "s2p", "s2p_query")
    w = em.prefix_text(w, "title", "query", "s2s", "s2s_query")
    w = em.prefix_text(w, "abstract", "passage", "nvembed", "nvembed_passage")
    return w.select("id", "query_text", "linq_query", "passage_text", "s2p_query", "s2s_query", "nvembed_passage")


@register("E3_truncate_text", "SELECT doc_id, substr(text, 1, 6000) AS text FROM documents")
def e3(spark, d):
    return em.truncate_text(fx.table(spark, d, "documents").select("doc_id", "text"), "text")


@register("E4_format_questions", V("""
SELECT topic, questions AS query FROM qblock WHERE rq_count = 2 AND include_sub""", CFG_SQL))
def e4(spark, d):
    return em.format_questions(topic_config(spark, d), 2, True)


@register("E5_query_grid", V("""
SELECT q.topic, q.rq_count, h.has_text, q.include_sub,
       CASE WHEN h.has_text THEN 'Research Questions:' || chr(10) || q.questions || ' [SEP] Supporting Documents:'
                                 || chr(10) || ' ' || b.text
            ELSE q.questions END AS query
FROM qblock q CROSS JOIN (SELECT unnest([true, false]) AS has_text) h
LEFT JOIN benchmark b ON b.item_id = q.topic
WHERE q.rq_count IN (1, 3, 5, 100)""", CFG_SQL))
def e5(spark, d):
    texts = fx.table(spark, d, "benchmark").select(F.col("item_id").alias("topic"), "text")
    return em.query_grid(topic_config(spark, d), texts).select(
        "topic", "rq_count", "has_text", "include_sub", "query")


@register("E6_centroid", V("""
SELECT topic, CAST(dim - 1 AS INTEGER) AS dim, round(avg(x), 6) AS value FROM (
  SELECT topic, unnest(vector) AS x, generate_subscripts(vector, 1) AS dim FROM seed_queries) t
GROUP BY topic, dim"""))
def e6(spark, d):
    q = fx.seed_queries(spark, d)
    c = em.centroid(q, ["topic"], "vector", "centroid")
    return c.select("topic", F.posexplode("centroid").alias("dim", "value")).withColumn(
        "value", round_half_away("value", 6))


@register("E7_prompt_table", V("""
SELECT id, CAST(seed AS INTEGER) AS seed,
       'As an expert in ' || source || ', write the title and abstract of a research paper on the same '
       || 'problem as the given publication. Answer as JSON with keys title and abstract.' AS system,
       title AS user
FROM works, (SELECT unnest(range(42, 45)) AS seed)"""))
def e7(spark, d):
    return em.prompt_table(fx.works(spark, d), "title", "source", "similar_doc", 3)


_E7_SQL = {k: "'" + v.replace("'", "''").replace("{field}", "' || source || '") + "'" for k, v in em.PROMPTS.items()}


@register("E7_prompt_kinds", V(" UNION ALL ".join(f"""
SELECT '{k}' AS kind, id, CAST(seed AS INTEGER) AS seed, {_E7_SQL[k]} AS system, abstract AS user
FROM works, (SELECT unnest(range(42, 44)) AS seed)""" for k in em.PROMPTS)))
def e7_kinds(spark, d):
    """Requests of every kind for every work."""
    out = None
    for kind in em.PROMPTS:
        own = em.prompt_table(fx.works(spark, d), "abstract", "source", kind, 2).select(F.lit(kind).alias("kind"), "*")
        out = own if out is None else out.unionByName(own)
    return out


@register("E8_parse_publications", V(f"""
SELECT id, {tx.sql_render('indented', 'title', 'abstract')} AS text FROM works"""))
def e8(spark, d):
    w = fx.works(spark, d).select("id", F.to_json(F.struct("title", "abstract")).alias("response"))
    return em.parse_publications(w).select("id", "text")


@register("E9_core_query_set", V(f"""
SELECT c.topic, c.id,
       'Research Questions:' || chr(10) || q.questions || ' [SEP] Supporting Documents:' || chr(10) || ' '
       || ({tx.sql_render('core', 'c.title', 'c.abstract')}) AS query
FROM eval_cps c JOIN qblock q ON q.topic = c.topic AND q.rq_count = 1 AND NOT q.include_sub
WHERE c.id NOT IN (SELECT id FROM seeds WHERE run = 1)""", CFG_SQL))
def e9(spark, d):
    done = fx.seeds(spark, d).filter("run = 1").select("id")
    return em.core_query_set(fx.eval_cps(spark, d), topic_config(spark, d), done).select("topic", "id", "query")


@register("E1_encode_hashed_tfidf")
def e1(spark, d):
    w = fx.works(spark, d)
    docs = w.select("id", tx.render_text("title", "abstract", "passage").alias("text"))
    return em.hashed_tfidf(docs, "text", "id", 1 << 10)


@register("C25_backfill_vectors")
def c25_full(spark, d):
    return em.backfill_vectors(fx.works(spark, d), fx.corpus(spark, d))


def kept_encoder(spark, d):
    """The folder of the encoder fitted on all works, once per application."""
    texts = fx.works(spark, d).select("id", tx.render_text(F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")), "passage").alias("text"))
    return kept(spark, d, "encoder", lambda f: fit_encoder(texts, f))


@register("E1_encode_dense")
def e1_dense(spark, d):
    """Every work's text by the kept encoder: 64 numbers, whole words."""
    texts = fx.works(spark, d).select("id", tx.render_text(F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")), "passage").alias("text"))
    return encode_texts(texts, kept_encoder(spark, d))


@register("C25_backfill_dense")
def c25_dense(spark, d):
    """Works without a vector, encoded by the kept encoder of the table's width and appended."""
    return em.backfill_vectors(fx.works(spark, d), fx.corpus(spark, d), encode_frame=lambda docs: encode_texts(docs, kept_encoder(spark, d)))


@register("S10_encode_ingest", V("""
SELECT id, true AS has_vector FROM works WHERE language = 'en' AND title IS NOT NULL AND abstract IS NOT NULL"""))
def s10_encode(spark, d):
    """Complete English works arrive in overlapping files, twice, and become vectors once each."""
    from quarry.operators import clean as cl
    from quarry.sources.io import scratch_path
    from quarry.streaming.ingest import encode_ingest
    base, folder = scratch_path(spark, "encode-ingest"), kept_encoder(spark, d)
    w = fx.works(spark, d).select("id", "title", "abstract", "language")
    render = lambda df: cl.complete_works(df).select("id", tx.render_text("title", "abstract", "passage").alias("text"))
    for i in range(2):  # the second run brings new files that repeat ids of the first
        w.where(F.pmod("id", F.lit(3)) != i).repartition(2).write.mode("append").parquet(f"{base}/in")
        for _ in range(2):  # run again: nothing new
            encode_ingest(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", w.schema, lambda df: encode_texts(df, folder), render, max_files_per_trigger=2)
    out = spark.read.schema("id long, embedding array<float>").parquet(f"{base}/out")
    return out.select("id", (F.size("embedding") == 64).alias("has_vector"))
