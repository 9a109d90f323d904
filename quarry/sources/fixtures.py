"""Stand-in views that map the driver tables to the reference's inputs.

* ``works(id, title, abstract, language, source)`` - first line of a document is
  its title, the rest its abstract.
* ``eval_cps(id, topic, title, abstract)`` - ground truth: every vector's label
  is its topic.
* ``seeds(topic, id, run)`` - the first three vectors of a topic are its query
  ("core publication") vectors; ``run`` numbers them.
* ``slr_results(topic, id, is_core)`` - keyword-search stand-in.

The same views are given as SQL text (``VIEWS_SQL``) so the DuckDB oracles can
inline them as CTEs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    title = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    return docs.select(
        F.col("doc_id").alias("id"),
        title.alias("title"),
        F.substr(F.col("text"), F.length(title) + 2).alias("abstract"),
        F.col("lang").alias("language"),
        F.col("source"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector corpus ``id, embedding`` (all vectors, with or without text)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def eval_cps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    w = works(spark, sf_dir)
    return (e.join(w, e.vec_id == w.id, "left")
            .select(e.vec_id.alias("id"), e.label.alias("topic"), w.title, w.abstract))


def seeds(spark: SparkSession, sf_dir: str, runs: int = 3) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    return (e.select(F.col("label").alias("topic"), F.col("vec_id").alias("id"),
                     F.row_number().over(w).alias("run"))
            .filter(F.col("run") <= runs))


def seed_queries(spark: SparkSession, sf_dir: str, runs: int = 3) -> DataFrame:
    """``topic, run, query_id, vector``: the seed vectors as search queries."""
    e = table(spark, sf_dir, "embeddings")
    s = seeds(spark, sf_dir, runs)
    return (s.join(e, s.id == e.vec_id)
            .select("topic", "run", s.id.alias("seed_id"),
                    (F.col("topic") * 1000 + F.col("run")).cast("bigint").alias("query_id"),
                    F.col("embedding").alias("vector")))


def slr_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    e = table(spark, sf_dir, "embeddings")
    return (lab.join(e, e.vec_id == lab.doc_id)
            .select(e.label.alias("topic"), e.vec_id.alias("id"),
                    (lab.quality == 1).alias("is_core")))


# The same views as SQL text for the DuckDB oracles (inlined as CTEs).
VIEWS_SQL = """
works AS (
  SELECT doc_id AS id,
         split_part(text, chr(10), 1) AS title,
         substr(text, length(split_part(text, chr(10), 1)) + 2) AS abstract,
         lang AS language, source
  FROM documents),
eval_cps AS (
  SELECT e.vec_id AS id, e.label AS topic, w.title, w.abstract
  FROM embeddings e LEFT JOIN works w ON w.id = e.vec_id),
seeds AS (
  SELECT topic, id, run FROM (
    SELECT label AS topic, vec_id AS id,
           row_number() OVER (PARTITION BY label ORDER BY vec_id) AS run
    FROM embeddings) s
  WHERE run <= 3),
seed_queries AS (
  SELECT s.topic, s.run, s.id AS seed_id, CAST(s.topic * 1000 + s.run AS BIGINT) AS query_id,
         e.embedding::DOUBLE[] AS vector
  FROM seeds s JOIN embeddings e ON e.vec_id = s.id),
slr_results AS (
  SELECT e.label AS topic, e.vec_id AS id, l.quality = 1 AS is_core
  FROM labels l JOIN embeddings e ON e.vec_id = l.doc_id)
"""


def with_views(body: str, extra_ctes: str = "") -> str:
    """Prefix an oracle query with the stand-in views (and optional extra CTEs)."""
    ctes = VIEWS_SQL.strip()
    if extra_ctes.strip():
        ctes += ",\n" + extra_ctes.strip()
    return f"WITH {ctes}\n{body.strip()}"
