"""Plan shapes that the scale design relies on."""

import re

from pyspark.sql import functions as F

from quarry.operators import clean as cl
from quarry.operators import rerank as rr
from quarry.operators import search as srch
from quarry.sources import fixtures as fx


def _plan(df):
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


def test_dedupe_aggregates_map_side_without_window(spark, sf):
    p = _plan(cl.dedupe_title(fx.works(spark, sf).select("id", "title")))
    assert "partial_min" in p and "Window" not in p


def test_head_per_group_limits_before_the_shuffle(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "source")
    p = _plan(cl.head_per_group(docs, "source", 5, "doc_id"))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_search_has_no_pair_join(spark, sf):
    q = fx.seed_queries(spark, sf, 1)
    p = _plan(srch.search(q, fx.corpus(spark, sf), 10_000))
    assert "MapInPandas" in p and "WindowGroupLimit" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_bm25_joins_query_terms_by_broadcast(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    qs = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    p = _plan(rr.bm25_plus(qs, docs, 10))
    assert "BroadcastHashJoin [term]" in p or "BroadcastHashJoin [_g, term]" in p
    assert "CartesianProduct" not in p


def test_filter_and_projection_reach_the_scan(spark, sf):
    from quarry.sources.io import read_chunks
    df = read_chunks(spark, f"{sf}/documents.parquet").filter("lang = 'fr'").select("doc_id")
    p = _plan(df)
    assert "EqualTo(lang,fr)" in p and "ReadSchema: struct<doc_id:bigint,lang:string>" in p


def test_no_registered_query_plans_a_cross_product(spark, sf):
    import __spark_entry__ as E
    offenders = []
    for name, fn in E.queries().items():
        p = _plan(fn(spark, sf))
        if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p:
            offenders.append(name)
    assert offenders == []
