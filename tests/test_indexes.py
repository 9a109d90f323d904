"""Kept indexes: the trained vector index and the positional inverted index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import clean as cl
from quarry.operators import rerank as rr
from quarry.operators import search as srch
from quarry.operators import text_index as ti
from quarry.operators import vector_index as vi
from quarry.sources.io import scratch_path


def _corpus(spark, n=900, dim=12, hot=0):
    rnd = np.random.default_rng(4)
    centres = rnd.standard_normal((9, dim)) * 2
    v = np.float32(centres[rnd.integers(0, 9, n)] + rnd.standard_normal((n, dim)))
    v[:hot] = v[0]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(n, None), (n + 1, [float("nan")] * dim), (n + 2, [0.0] * dim), (n + 3, [None] + [1.0] * (dim - 1))]
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(4)


@pytest.mark.parametrize("hot", [0, 400])
def test_vector_index_recall_and_scores(spark, hot, monkeypatch):
    monkeypatch.setattr(vi, "BLOCK", 64)
    monkeypatch.setattr(vi, "ASK", 16)
    c = _corpus(spark, hot=hot)
    index = vi.build(c, scratch_path(spark, "ivf"))
    assert index.rows.sum() == 901 == index.entries(spark).count()  # nulls and non-finite vectors are left out
    q = c.where("id % 20 = 0 and id < 900").selectExpr("id as query_id", "embedding as vector")
    exact = srch.search(q, c.where("id < 900 or id = 902"), 10)
    got = vi.search_index(q, vi.open_index(spark, index.folder), 10)
    assert got.count() == exact.count() == 450
    assert vi._recall(got, exact) >= 0.9
    both = got.join(exact.withColumnRenamed("score", "s"), ["query_id", "id"])
    assert both.where("score <> s").isEmpty()
    ranks = got.groupBy("query_id").agg(F.max("rank").alias("m"), F.countDistinct("rank").alias("n")).collect()
    assert all((r["m"], r["n"]) == (10, 10) for r in ranks)


def test_vector_index_with_all_cells_is_exact(spark):
    c = _corpus(spark)
    index = vi.build(c, scratch_path(spark, "ivf"), cells=20)
    q = c.where("id < 30").selectExpr("id as query_id", "embedding as vector")
    got = vi.search_index(q, index, 7, probes=20, depth=1000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, srch.search(q, c.where("id < 901 or id = 902"), 7).collect()))


def test_vector_index_looks_on_until_k_rows(spark):
    c = _corpus(spark, n=200)
    index = vi.build(c, scratch_path(spark, "ivf"), cells=12)
    q = c.where("id < 5").selectExpr("id as query_id", "embedding as vector")
    assert vi.search_index(q, index, 150, probes=1, depth=150).count() == 5 * 150
    assert vi.search_index(q, index, 1000, probes=1, depth=1).count() == 5 * 201  # all there are


def test_vector_index_of_nothing(spark):
    c = _corpus(spark).where("id is null")
    index = vi.build(c, scratch_path(spark, "ivf"))
    q = _corpus(spark).where("id < 5").selectExpr("id as query_id", "embedding as vector")
    assert vi.search_index(q, index, 5).collect() == []


TEXTS = [(1, "The cat sat on the mat, the cat!"), (2, "A dog; the Dog's mat"), (3, None), (4, ""), (5, "cat on mat cat on the mat"), (6, "unrelated words here")]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i % 2 else "de", "T%d" % i) for i, t in rows], "id long, text string, language string, title string")


def test_index_in_segments_equals_one_pass(spark):
    folder = scratch_path(spark, "inv")
    ti.append(_docs(spark, TEXTS[:3]), folder, keep=["language", "title"], buckets=4)
    ti.append(_docs(spark, TEXTS), folder, keep=["language", "title"])   # the first three again
    ti.append(_docs(spark, TEXTS[:1]), folder, keep=["language", "title"])  # nothing new
    assert sorted(r["id"] for r in ti.documents(spark, folder).collect()) == [1, 2, 3, 4, 5, 6]
    got = {(r["term"], r["id"]): r["positions"] for r in ti.postings(spark, folder).collect()}
    want = {}
    for r in _docs(spark, TEXTS).select("id", tx.tokens(F.coalesce("text", F.lit(""))).alias("t")).collect():
        for p, t in enumerate(r["t"]):
            want.setdefault((t, r["id"]), []).append(p)
    assert got == want
    qs = spark.createDataFrame([(1, "cat mat cat"), (2, "dog"), (3, "none"), (4, "")], "query_id long, query string")
    a = ti.bm25_from_index(qs, folder, 10).collect()
    b = rr.bm25_plus(qs, _docs(spark, TEXTS), 10).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and a


def test_unfinished_segment_is_not_read(spark):
    folder = scratch_path(spark, "inv")
    ti.append(_docs(spark, TEXTS[:2]), folder, buckets=4)
    spark.read.parquet(folder + "/documents").drop("segment").write.parquet(folder + "/documents/segment=lost")
    assert ti.documents(spark, folder).count() == 2


def test_keyword_search_from_index(spark):
    folder = scratch_path(spark, "inv")
    docs = _docs(spark, TEXTS)
    ti.append(docs, folder, keep=["language", "title"], buckets=8)
    terms = spark.createDataFrame([(1, 1, "cat"), (1, 1, "dog"), (1, 2, "the mat"), (2, 1, "Cat on the"), (3, 1, "cat cat"), (4, 1, "missing"), (5, 1, "mat, cat on")],
                                  "topic long, grp int, term string")
    works = docs.selectExpr("id", "'' as title", "text as abstract", "'en' as language")
    want = sorted(map(tuple, cl.keyword_search(works, terms).collect()))
    assert sorted(map(tuple, ti.keyword_search_from_index(terms, folder).collect())) == want
    cores = spark.createDataFrame([(1, 5)], "topic long, id long")
    got = ti.keyword_search_from_index(terms, folder, k=1, where="language = 'en'", cores=cores, show=["title"])
    assert got.columns == ["topic", "id", "title", "is_core", "rank"]
    assert {r["topic"]: (r["id"], r["title"], r["is_core"]) for r in got.collect()} == {1: (1, "T1", False), 2: (5, "T5", False), 5: (5, "T5", False)}


def test_many_terms_join_instead_of_a_list(spark, monkeypatch):
    folder = scratch_path(spark, "inv")
    ti.append(_docs(spark, TEXTS), folder, buckets=4)
    want = spark.createDataFrame([("cat",), ("mat",), (None,)], "term string")
    few = sorted(map(str, ti.postings(spark, folder, want).collect()))
    monkeypatch.setattr(ti, "MAX_TERMS", 1)
    assert sorted(map(str, ti.postings(spark, folder, want).collect())) == few and few


def test_a_query_opens_its_buckets_only(spark):
    folder = scratch_path(spark, "inv")
    ti.append(_docs(spark, TEXTS), folder, buckets=16)
    plan = ti.postings(spark, folder, spark.createDataFrame([("cat",)], "term string"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "In(term" in plan.replace("EqualTo", "In")


def test_cells_share_blocks_and_answers_stay(spark, monkeypatch):
    """A task gets a block of cells: candidates are at most ``depth`` rows per query and block, whatever cells are asked."""
    first, blocks = vi._deal(np.array([3, 4, 0, 25, 2, 9]), 10)
    assert list(blocks) == [1, 1, 1, 3, 1, 1] and list(first) == [0, 0, 0, 1, 4, 5]
    rnd = np.random.default_rng(8)
    v = np.float32(rnd.standard_normal((600, 8)))
    c = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<float>").repartition(3)
    index = vi.build(c, scratch_path(spark, "ivf"), cells=12)
    q = c.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    want = sorted(map(tuple, vi.search_index(q, index, 5, probes=4, depth=20).collect()))
    monkeypatch.setattr(vi, "BLOCK", 100)
    monkeypatch.setattr(vi, "ASK", 90)
    monkeypatch.setattr(vi, "SCORES", 2_000)
    assert sorted(map(tuple, vi.search_index(q, index, 5, probes=4, depth=20).collect())) == want
    sizes = []
    plain = vi.rank_within
    monkeypatch.setattr(vi, "rank_within", lambda df, *a, **k: sizes.append(df) or plain(df, *a, **k))
    cands = vi._candidates(q, index, 12, 5, 20)
    n_blocks = len(np.unique(vi._deal(index.rows, 100)[0]))
    assert n_blocks < 12 and sizes[0].count() <= 600 * 21 * n_blocks  # a few ties at the cut
    assert cands.groupBy("query_id").count().where("count <> 20").isEmpty()


def test_index_shuffles_no_tokens_and_joins_repeated_ids(spark, tmp_path):
    from quarry.operators import text_index as ti
    rows = [(1, "b a b"), (1, "a c c"), (1, "x"), (None, "a"), (None, "a"), (2, ""), (3, None), (4, "c b a c")]
    docs = spark.createDataFrame(rows, "id long, text string")
    folder = str(tmp_path / "i")
    ti.append(docs, folder)
    got = sorted(((r["term"], r["id"] or 0, r["dl"], r["tf"], r["positions"]) for r in ti.postings(spark, folder).collect()))
    assert got == [("a", 0, 1, 2, [0, 0]), ("a", 1, 3, 2, [0, 1]), ("a", 4, 4, 1, [2]), ("b", 1, 3, 2, [0, 2]), ("b", 4, 4, 1, [1]),
                   ("c", 1, 3, 2, [1, 2]), ("c", 4, 4, 2, [0, 3]), ("x", 1, 1, 1, [0])]
    plan = ti._row_postings(docs.selectExpr("id", "1 as dl", "split(text, ' ') as _toks"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Aggregate" not in plan
