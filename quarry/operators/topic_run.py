"""The composite behind a topic's run table (R18): core publication, questions, supporting documents, search, texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators.common import materialize
from quarry.operators.embed import centroid, format_questions, select_core
from quarry.operators.search import attach_text, search
from quarry.sources.io import lookup


def topic_search_run(effect: DataFrame, cps: DataFrame, cfg: DataFrame, vectors: DataFrame, texts: DataFrame, k: int,
                     kind: str = "best", extra: DataFrame | None = None, rq_count: int = 1, include_sub: bool = False) -> DataFrame:
    """``topic, id, score, rank, query, text``.

    Per topic the ``kind`` core publication (E10) supports the topic's questions (E4): that is ``query``. The
    search vector is the mean (E6) of the core's vector and those of the topic's ``extra`` documents (topic, id:
    generated ones, or any that have a vector); the best ``k`` rows of ``vectors`` (R1) get their ``texts``. A
    topic without questions keeps its core's text alone as query; without any vector it has no rows. ``effect``, which
    may be a search of the whole corpus by every core, is computed once."""
    best = materialize(select_core(effect, kind).select("topic", F.col("core_id").alias("id")), "best-cores")
    core_text = best.join(lookup(cps, best).select("topic", "id", tx.render_text("title", "abstract", "core").alias("text")), ["topic", "id"]).select("topic", "text")
    asked = (core_text.join(format_questions(cfg, rq_count, include_sub, core_text), ["topic", "text"], "left")
             .select("topic", F.coalesce("query", "text").alias("query")))
    members = best if extra is None else best.unionByName(extra.select("topic", "id"))
    q = centroid(members.join(vectors, "id"), ["topic"], "embedding", "vector").withColumn("query_id", F.col("topic"))
    hits = materialize(search(q, vectors, k).withColumnRenamed("query_id", "topic"), "topic-hits")
    return attach_text(hits, lookup(texts, hits)).join(asked, "topic", "left").select("topic", "id", "score", "rank", "query", "text")
