"""Registered cleaning / projection queries (C1-C25) with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import clean as cl
from quarry.operators import search as srch
from quarry.operators.metric_join import best_partners
from quarry.plans.q_search import _SEARCH_CTE
from quarry.plans.registry import register
from quarry.sources import fixtures as fx
from quarry.sources import io as sio

V = fx.with_views
WS_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


@register("C1_english_with_abstract", V("""
SELECT id, coalesce(title, '') AS title, abstract, language, source
FROM works WHERE language = 'en' AND abstract IS NOT NULL"""))
def c1(spark, d):
    return cl.english_with_abstract(fx.works(spark, d))


@register("C2_restore_abstract_round_trip", V("SELECT id, abstract FROM works"))
def c2(spark, d):
    inv = sio.inverted_index(fx.works(spark, d), "abstract", out="abstract_inverted_index")
    return inv.select("id", tx.restore_abstract("abstract_inverted_index").alias("abstract"))


@register("C3_fill_blank", V("""
SELECT id, topic, coalesce(title, '') AS title, coalesce(abstract, '') AS abstract FROM eval_cps"""))
def c3(spark, d):
    return cl.fill_blank(fx.eval_cps(spark, d))


def _vec_works(spark, d):
    w = fx.works(spark, d)
    c = fx.corpus(spark, d).select("id")
    return c.join(w, "id", "left")


@register("C4_complete_works", V("""
SELECT c.vec_id AS id, w.title, w.abstract, w.language, w.source
FROM embeddings c LEFT JOIN works w ON w.id = c.vec_id
WHERE w.abstract IS NOT NULL AND w.title IS NOT NULL AND w.language = 'en'"""))
def c4(spark, d):
    return cl.complete_works(_vec_works(spark, d))


for _tpl in ("passage", "run", "core", "plain", "indented"):
    def _mk(tpl):
        def q(spark, d):
            return cl.with_text(fx.eval_cps(spark, d), tpl).select("id", "text")
        return q
    register(f"C5_render_{_tpl}", V(
        f"SELECT id, {tx.sql_render(_tpl, 'title', 'abstract')} AS text FROM eval_cps"))(_mk(_tpl))


@register("C6_parse_text", V(f"""
SELECT id,
       trim(regexp_replace(split_part(text, '[SEP]', 1), 'Title: ', ''), {WS_SQL}) AS title,
       CASE WHEN strpos(text, '[SEP]') > 0 THEN split_part(text, '[SEP]', 2) END AS abstract
FROM (SELECT id, {tx.sql_render('passage', 'title', 'abstract')} AS text FROM works) t"""))
def c6(spark, d):
    return cl.parse_text(cl.with_text(fx.works(spark, d), "passage").select("id", "text")).drop("text")


@register("C7_normalise_title", V(f"""
SELECT id, lower(trim(title, {WS_SQL})) AS t_lower,
       regexp_replace(trim(title, {WS_SQL}), '[^\\p{{L}}\\p{{N}}_ \\t\\n\\r\\f\\x0b]', '', 'g') AS t_alnum,
       replace(title, ',', '') AS t_nocomma
FROM works"""))
def c7(spark, d):
    w = fx.works(spark, d)
    return w.select("id", tx.normalise_title("title", "lower").alias("t_lower"),
                    tx.normalise_title("title", "alnum").alias("t_alnum"),
                    tx.normalise_title("title", "nocomma").alias("t_nocomma"))


@register("C8_dedupe_title", V(f"""
SELECT id, title FROM (
  SELECT id, title, row_number() OVER (PARTITION BY lower(trim(title, {WS_SQL})) ORDER BY id) AS rn
  FROM works) t WHERE rn = 1"""))
def c8(spark, d):
    return cl.dedupe_title(fx.works(spark, d).select("id", "title"))


@register("C9_dedupe_content", V("""
SELECT id, title, abstract FROM (
  SELECT id, title, abstract, row_number() OVER (PARTITION BY title, abstract ORDER BY id) AS rn
  FROM works) t WHERE rn = 1"""))
def c9(spark, d):
    return cl.dedupe_content(fx.works(spark, d).select("id", "title", "abstract"))


@register("C10_dedupe_id", V("""
SELECT id, title, priority FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority, title) AS rn FROM (
    SELECT id, title, 0 AS priority FROM eval_cps
    UNION ALL SELECT id, title, 1 AS priority FROM works) u) t WHERE rn = 1"""))
def c10(spark, d):
    a = fx.eval_cps(spark, d).select("id", "title", F.lit(0).alias("priority"))
    b = fx.works(spark, d).select("id", "title", F.lit(1).alias("priority"))
    return cl.dedupe_id(a.unionByName(b), "id", "priority")


@register("C11_match_titles", V("""
SELECT query_id, id, score FROM (
  SELECT q.query_id, e.vec_id AS id,
         round(list_cosine_similarity(q.vector, e.embedding::DOUBLE[]), 6) AS score,
         row_number() OVER (PARTITION BY q.query_id
                            ORDER BY round(list_cosine_similarity(q.vector, e.embedding::DOUBLE[]), 6) DESC,
                                     e.vec_id) AS rn
  FROM seed_queries q CROSS JOIN (SELECT * FROM embeddings WHERE vec_id NOT IN (SELECT id FROM seeds)) e) t
WHERE rn = 1 AND score > 0.3"""))
def c11(spark, d):
    q = fx.seed_queries(spark, d)
    corpus = fx.corpus(spark, d).join(fx.seeds(spark, d).select("id"), "id", "left_anti")
    return cl.match_titles(q, corpus, 0.3)


# A second encoding of the same titles: components in steps of 0.05.
_C11_COARSE = "list_transform(embedding, lambda e: floor(20 * e::DOUBLE + 0.5) / 20)"


@register("C11_match_core_titles", V(f"""
SELECT query_id, id, score FROM (
  SELECT a.id AS query_id, b.id, round(list_cosine_similarity(e.embedding::DOUBLE[], b.v), 6) AS score,
         row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], b.v), 6) DESC, b.id) AS rn
  FROM eval_cps a JOIN embeddings e ON e.vec_id = a.id CROSS JOIN (SELECT vec_id AS id, {_C11_COARSE} AS v FROM embeddings) b) x
WHERE rn = 1 AND score > 0.995"""))
def c11_cores(spark, d):
    """Every core publication against a second, coarser encoding of all rows at 0.995, by the metric join."""
    cores = fx.eval_cps(spark, d).select("id").join(fx.corpus(spark, d), "id").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    coarse = fx.corpus(spark, d).select("id", F.transform("embedding", lambda e: F.floor(e.cast("double") * 20 + 0.5) / F.lit(20.0)).alias("embedding"))
    return best_partners(cores, coarse, 0.995)


@register("C12_missing_ids", """
SELECT vec_id AS id, 'a_not_b' AS direction FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)
UNION ALL
SELECT doc_id AS id, 'b_not_a' AS direction FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def c12(spark, d):
    return cl.missing_ids(fx.table(spark, d, "embeddings"), fx.table(spark, d, "documents"), "vec_id", "doc_id")


@register("C12_missing_counts", """
SELECT direction, count(*) AS n FROM (
SELECT vec_id AS id, 'a_not_b' AS direction FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)
UNION ALL
SELECT doc_id AS id, 'b_not_a' AS direction FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) t
GROUP BY direction""")
def c12b(spark, d):
    return cl.missing_counts(fx.table(spark, d, "embeddings"), fx.table(spark, d, "documents"), "vec_id", "doc_id")


@register("C13_keep_available", """
SELECT * FROM labels WHERE doc_id IN (SELECT vec_id FROM embeddings)""")
def c13(spark, d):
    return cl.keep_available(fx.table(spark, d, "labels"), fx.table(spark, d, "embeddings"), "doc_id", "vec_id")


@register("C14_attach_vectors", V("""
SELECT w.id, w.title, CAST(len(e.embedding) AS INTEGER) AS dims
FROM works w JOIN embeddings e ON e.vec_id = w.id"""))
def c14(spark, d):
    return (cl.attach_vectors(fx.works(spark, d), fx.corpus(spark, d))
            .select("id", "title", F.size("embedding").alias("dims")))


def _refs_fixture(spark, d):
    """Documents shaped like labelled-review rows: a list-literal of title words and a type."""
    w = fx.works(spark, d)
    words = F.split(F.regexp_replace("title", "['\"\\\\]", ""), " ")
    return w.select("id", F.concat(F.lit("['"), F.array_join(words, "', '"), F.lit("']")).alias("referenced_works"),
                    F.when(F.col("source") == "src0", F.lit("journal-article")).otherwise(F.col("source")).alias("type"))


@register("C15_align_schema", V("""
SELECT id,
       CASE WHEN type = 'journal-article' THEN 'article' ELSE type END AS type,
       CAST(json_array_length(replace(referenced_works, '''', '"')) AS BIGINT) AS n_references,
       1 AS included
FROM (SELECT id,
             '[''' || array_to_string(string_split(regexp_replace(title, '[''"\\\\]', '', 'g'), ' '), ''', ''') || ''']'
               AS referenced_works,
             CASE WHEN source = 'src0' THEN 'journal-article' ELSE source END AS type
      FROM works) t"""))
def c15(spark, d):
    return cl.align_schema(_refs_fixture(spark, d), constants={"included": 1})


@register("C16_coalesce_merge", V("""
SELECT a.id, a.topic, coalesce(a.title, w.title) AS title, coalesce(a.abstract, w.abstract) AS abstract
FROM eval_cps a LEFT JOIN works w ON w.id = a.id"""))
def c16(spark, d):
    return cl.coalesce_merge(fx.eval_cps(spark, d), fx.works(spark, d).select("id", "title", "abstract"))


@register("C17_null_audit", V(f"""
SELECT count(*) AS n_rows,
       CAST(sum(CASE WHEN title IS NULL OR title = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_blank_title,
       CAST(sum(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null_text
FROM (SELECT title, {tx.sql_render('passage', 'title', 'abstract')} AS text FROM eval_cps) t"""))
def c17(spark, d):
    return cl.null_audit(cl.with_text(fx.eval_cps(spark, d), "passage"))


@register("C18_sample_complete", V("""
SELECT id, title FROM works WHERE title IS NOT NULL AND abstract IS NOT NULL
ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id LIMIT 50"""))
def c18(spark, d):
    return cl.sample_complete(fx.works(spark, d), 50, seed=42).select("id", "title")


@register("C19_assemble_eval_corpus", V("""
SELECT id, topic, origin, priority FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority, topic, origin) AS rn FROM (
    SELECT id, topic, 'core' AS origin, 0 AS priority FROM seeds
    UNION ALL
    SELECT id, topic, 'similar' AS origin, 1 AS priority FROM ranked WHERE rank <= 20) u) t
WHERE rn = 1""", _SEARCH_CTE))
def c19(spark, d):
    q = fx.seed_queries(spark, d)
    sim = (srch.search(q, fx.corpus(spark, d), 20).join(q.select("query_id", "topic"), "query_id")
           .select("id", "topic", F.lit("similar").alias("origin")))
    core = fx.seeds(spark, d).select("id", "topic", F.lit("core").alias("origin"))
    return cl.assemble_eval_corpus([core, sim]).select("id", "topic", "origin", "priority")


@register("C20_head_per_group", """
SELECT doc_id, source FROM (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) t
WHERE rn <= 5""")
def c20(spark, d):
    return cl.head_per_group(fx.table(spark, d, "documents").select("doc_id", "source"), "source", 5, "doc_id")


@register("C21_label_members", V("""
SELECT w.id, CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END AS included
FROM works w LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = w.id"""))
def c21(spark, d):
    ids = fx.table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return cl.label_members(fx.works(spark, d).select("id"), ids)


@register("C22_union_labelled", V("""
SELECT topic, id, is_core FROM slr_results
UNION ALL
SELECT topic, id, CAST(1 AS BOOLEAN) AS is_core FROM seeds
WHERE topic NOT IN (SELECT DISTINCT topic FROM slr_results WHERE is_core)"""))
def c22(spark, d):
    existing = fx.slr_results(spark, d).filter("is_core")
    new = fx.seeds(spark, d).select("topic", "id", F.lit(1).alias("label_included"))
    out = cl.union_labelled(existing, new)
    rest = fx.slr_results(spark, d).filter("NOT is_core")
    return out.unionByName(rest)


def _benchmark_terms(spark, d):
    """Per benchmark item (= topic) two OR-groups over all of its tokens: the tokens at
    even positions form group 1, those at odd positions group 2 (AND of the two)."""
    b = fx.table(spark, d, "benchmark")
    return (b.select(F.col("item_id").alias("topic"), F.posexplode(tx.tokens("text")).alias("pos", "term"))
            .select("topic", (F.pmod(F.col("pos"), F.lit(2)) + 1).alias("grp"), "term").distinct())


_C23_CTES = f"""
terms AS (
  SELECT DISTINCT topic, CAST(pos % 2 + 1 AS INTEGER) AS grp, term FROM (
    SELECT item_id AS topic, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos
    FROM (SELECT item_id, {tx.sql_tokens('text')} AS toks FROM benchmark) b) t),
doc_terms AS (
  SELECT DISTINCT id, unnest({tx.sql_tokens("concat_ws(' ', title, abstract)")}) AS term
  FROM works WHERE language = 'en' AND abstract IS NOT NULL),
hits AS (
  SELECT t.topic, d.id, count(DISTINCT t.grp) AS n_hit
  FROM doc_terms d JOIN terms t ON t.term = d.term GROUP BY t.topic, d.id),
ng AS (SELECT topic, count(DISTINCT grp) AS n_groups FROM terms GROUP BY topic)
"""


@register("C23_keyword_search", V("""
SELECT h.topic, h.id, row_number() OVER (PARTITION BY h.topic ORDER BY h.id) AS rank
FROM hits h JOIN ng ON ng.topic = h.topic WHERE h.n_hit = ng.n_groups""", _C23_CTES))
def c23(spark, d):
    return cl.keyword_search(fx.works(spark, d), _benchmark_terms(spark, d))


@register("C23_phrases", V("""
SELECT ph.topic, g.id, row_number() OVER (PARTITION BY ph.topic ORDER BY g.id) AS rank
FROM ph JOIN grams g ON g.g = ph.phrase""", f"""
ph AS (SELECT topic, list_slice(toks, 1, 3) AS phrase
       FROM (SELECT item_id AS topic, {tx.sql_tokens('text')} AS toks FROM benchmark) b WHERE len(toks) >= 3),
grams AS (SELECT DISTINCT id, list_slice(toks, i, i + 2) AS g
          FROM (SELECT id, toks, unnest(range(1, len(toks) - 1)) AS i
                FROM (SELECT id, {tx.sql_tokens("concat_ws(' ', title, abstract)")} AS toks FROM works
                      WHERE language = 'en' AND abstract IS NOT NULL) w WHERE len(toks) >= 3) x)
"""))
def c23_phrases(spark, d):
    """Each benchmark item's first three words as one phrase."""
    toks = fx.table(spark, d, "benchmark").select(F.col("item_id").alias("topic"), tx.tokens("text").alias("t")).where(F.size("t") >= 3)
    terms = toks.select("topic", F.lit(1).alias("grp"), F.array_join(F.slice("t", 1, 3), " ").alias("term"))
    return cl.keyword_search(fx.works(spark, d), terms)


@register("C24_label_pool_export", V(f"""
SELECT r.topic, r.id,
       trim(regexp_replace(split_part(w.text, '[SEP]', 1), 'Title: ', ''), {WS_SQL}) AS title,
       CASE WHEN strpos(w.text, '[SEP]') > 0 THEN split_part(w.text, '[SEP]', 2) END AS abstract,
       CASE WHEN c.id IS NOT NULL THEN 1 ELSE 0 END AS included
FROM ranked r
LEFT JOIN (SELECT id, {tx.sql_render('run', 'title', 'abstract')} AS text FROM works) w ON w.id = r.id
LEFT JOIN (SELECT DISTINCT topic, id FROM eval_cps) c ON c.topic = r.topic AND c.id = r.id
WHERE r.run = 1 AND r.rank <= 100""", _SEARCH_CTE))
def c24(spark, d):
    q = fx.seed_queries(spark, d, 1)
    run = srch.search(q, fx.corpus(spark, d), 100).join(q.select("query_id", "topic"), "query_id")
    texts = cl.with_text(fx.works(spark, d), "run").select("id", "text")
    pool = cl.parse_text(srch.attach_text(run, texts))
    cps = fx.eval_cps(spark, d).select("topic", "id")
    return cl.label_members(pool, cps, on=["topic"]).select("topic", "id", "title", "abstract", "included")


_C25_TEXT = tx.sql_render("passage", "coalesce(title, '')", "coalesce(abstract, '')")


@register("C25_backfill_texts", V(f"""
SELECT id, {_C25_TEXT} AS text
FROM works WHERE id NOT IN (SELECT vec_id FROM embeddings)"""))
def c25(spark, d):
    from quarry.operators.embed import missing_vector_texts
    return missing_vector_texts(fx.works(spark, d), fx.corpus(spark, d))
