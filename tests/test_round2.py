"""Cases the review of the first round named."""

import math

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import clean as cl
from quarry.operators import rerank as rr
from quarry.operators import search as srch
from quarry.operators import topics as tp
from quarry.operators.common import partitions
from quarry.sources import io as sio
from quarry.streaming.ingest import resume_ingest


def vectors(spark, n, dim=4):
    rows = [(i, [math.sin(i * 7 + j * 3) for j in range(dim)]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, embedding array<double>")


@pytest.mark.parametrize("size", [10, 7, 1])
def test_passes_end_and_agree(spark, size):
    """Uneven numbers of queries in passes by position, also with repeated ids."""
    c = vectors(spark, 40)
    q = c.where("id < 20").selectExpr("id as query_id", "embedding as vector").repartition(3)
    one = sorted(map(tuple, srch.search(q, c, 3).collect()))
    assert sorted(map(tuple, srch.search(q, c, 3, max_queries_per_pass=size).collect())) == one
    same = q.select(F.lit(1).alias("query_id"), "vector")
    assert srch.search(same, c, 2, max_queries_per_pass=6).count() > 0


def test_zero_vectors_score_zero(spark):
    c = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id long, vector array<double>")
    got = {(r["query_id"], r["id"]): r["score"] for r in srch.search(q, c, 5).collect()}
    assert got == {(1, 1): 0.0, (1, 2): 1.0, (2, 1): 0.0, (2, 2): 0.0}


def test_approx_fills_k_and_finds_most(spark):
    c = vectors(spark, 600, 8)
    q = c.where("id < 20").selectExpr("id as query_id", "embedding as vector")
    got = srch.search_approx(q, c, 10, cells=32, probes=10)
    exact = srch.search(q, c, 10)
    assert got.count() == 200
    both = got.join(exact.select("query_id", "id"), ["query_id", "id"], "left_semi").count()
    assert both >= 0.9 * 200


def test_partition_count_runs_no_job(spark):
    c = vectors(spark, 50)
    joined = c.join(c.select("id"), "id")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("count-parts", "x")
    assert partitions(joined) >= 1
    assert not tracker.getJobIdsForGroup("count-parts")
    spark.sparkContext._jsc.clearJobGroup()


def test_stop_list_as_a_table(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "the dog"), (3, "the bird")], "id long, text string")
    q = spark.createDataFrame([(1, "the cat")], "query_id long, query string")
    words = spark.createDataFrame([("the",), ("a",)], "term string")
    as_table, as_list = (sorted(map(tuple, rr.bm25_plus(q, docs, 10, stop_words=w).collect())) for w in (words, ["the", "a"]))
    assert as_table == as_list and len(as_table) == 1


def test_queries_without_terms_and_full_rankings(spark):
    docs = spark.createDataFrame([(1, "cat"), (2, "dog")], "id long, text string")
    q = spark.createDataFrame([(1, "the"), (2, "cat")], "query_id long, query string")
    got = rr.bm25_plus(q, docs, None, stop_words=["the"], fill=True).collect()
    score = {(r["query_id"], r["id"]): r["score"] for r in got}
    assert set(score) == {(1, 1), (1, 2), (2, 1), (2, 2)} and score[1, 1] == score[1, 2] == 0.0 and score[2, 1] > score[2, 2]
    top = rr.bm25_plus(q, docs, 2, stop_words=["the"], fill=True).collect()
    assert len(top) == 4


def test_list_literals_with_quotes(spark):
    t = spark.createDataFrame([(1, "[\"O'Brien\", 'b']", "journal-article"), (2, r"['it\'s', 'c', 'd']", "x"), (3, "[]", "x")],
                              "id long, referenced_works string, type string")
    assert {r["id"]: r["n_references"] for r in cl.align_schema(t).collect()} == {1: 2, 2: 3, 3: 0}


def test_keyword_phrases_and_no_cut(spark):
    works = spark.createDataFrame([(1, "Cloud migration, now", "x", "en"), (2, "migration of a cloud", "y", "en"), (3, "cloud", None, "en")],
                                  "id long, title string, abstract string, language string")
    terms = spark.createDataFrame([(1, 1, "cloud migration"), (2, 1, "cloud"), (2, 2, "migration")], "topic int, grp int, term string")
    assert sorted((r["topic"], r["id"]) for r in cl.keyword_search(works, terms).collect()) == [(1, 1), (2, 1), (2, 2)]


def test_unmapped_files_are_kept(spark, tmp_path):
    spark.createDataFrame([(1, "a", "k1"), (2, "b", "k2")], "id long, title string, k string").write.partitionBy("k").option("header", "true").csv(str(tmp_path / "in"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType())])
    mapping = spark.createDataFrame([("k=k1", 7)], "file_key string, topic int")
    got = {r["id"]: r["topic"] for r in sio.read_tagged_csv(spark, str(tmp_path / "in"), schema, mapping).collect()}
    assert got == {1: 7, 2: None}


def test_many_ids_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    sio.write_by_id(spark.range(80_000).withColumnRenamed("id", "id"), path, 8)
    ids = spark.createDataFrame([(i,) for i in range(0, 400, 8)], "id long")
    plan = sio.lookup(spark.read.parquet(path), ids)
    assert plan.count() == 50
    assert "PushedFilters: [Or(" in plan._jdf.queryExecution().executedPlan().toString()


def test_compaction_keeps_runs_without_a_shuffle(spark, tmp_path):
    src, dst = str(tmp_path / "a"), str(tmp_path / "b")
    sio.write_by_id(spark.range(10_000), src, 8)
    sio.compact(spark, src, dst, target_bytes=1 << 30)
    ids = [r["id"] for r in spark.read.parquet(dst).collect()]
    assert sorted(ids) == list(range(10_000)) and sum(b != a + 1 for a, b in zip(ids, ids[1:])) <= 7


def test_reports_are_small(spark, tmp_path):
    with pytest.raises(ValueError):
        sio.write_result(spark.range(100), str(tmp_path / "r"), max_rows=10)


def test_ingest_does_not_take_errors_for_an_empty_sink(spark, tmp_path):
    src, sink = str(tmp_path / "in"), tmp_path / "out"
    schema = T.StructType([T.StructField("id", T.LongType())])
    spark.range(5).write.parquet(src)
    sink.mkdir()
    (sink / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        resume_ingest(spark, src, str(sink), str(tmp_path / "c"), schema, unique_key="id")
    assert not [p for p in sink.iterdir() if p.name.startswith("part-0000")]


def test_topic_model_columns_and_bound(spark):
    docs = spark.createDataFrame([(i, "apple banana the cherry" if i % 2 else "dog cat the mouse") for i in range(20)], "id long, text string")
    got = tp.topic_model(docs, k=2, n_terms=3, stop_words=["the"])
    assert got.columns == ["topic", "term", "weight"] and not got.where("term = 'the'").count()
    with pytest.raises(ValueError):
        tp.topic_model(docs, k=2, vocab_size=3)


def test_missing_path_condition(spark, tmp_path):
    with pytest.raises(AnalysisException) as e:
        spark.read.schema("id long").parquet(str(tmp_path / "none"))
    assert e.value.getCondition() == "PATH_NOT_FOUND"


def test_backfill_fits_on_the_corpus_and_keeps_the_width(spark):
    from quarry.operators import embed as em
    works = spark.createDataFrame([(1, "cat dog", "a b"), (2, "bird", "c"), (3, "cat", "x y")], "id long, title string, abstract string")
    emb = spark.createDataFrame([(1, [1.0] * 16), (2, [0.5] * 16)], "id long, embedding array<float>")
    got = {r["id"]: r["embedding"] for r in em.backfill_vectors(works, emb).collect()}
    assert set(got) == {1, 2, 3} and len(got[3]) == 16 and any(got[3])
    with pytest.raises(Exception):
        em.backfill_vectors(works, emb, encoder=lambda: (lambda texts: [[0.0] * 8 for _ in texts])).collect()


def test_topic_run_computes_the_effect_once(spark):
    from quarry.operators.topic_run import topic_search_run
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf
    effect = spark.createDataFrame([(1, 10, 3), (1, 11, 5), (2, 12, 1)], "topic int, core_id long, n_cores long").mapInPandas(count, "topic int, core_id long, n_cores long")
    cps = spark.createDataFrame([(1, i, f"t{i}", f"a{i}") for i in (10, 11)] + [(2, 12, "t12", None)], "topic int, id long, title string, abstract string")
    cfg = spark.createDataFrame([(1, 1, "main", [])], "topic int, rq_no int, main string, subs array<string>")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in (10, 11, 12)], "id long, embedding array<float>")
    texts = spark.createDataFrame([(10, "x"), (10, "y"), (11, "z")], "id long, text string")
    got = topic_search_run(effect, cps, cfg, vectors, texts, 3).collect()
    assert seen.value == 3
    assert sorted((r["topic"], r["id"], r["text"] or "") for r in got) == [(t, i, x) for t in (1, 2) for i, x in ((10, "x"), (10, "y"), (11, "z"), (12, ""))]
    assert {r["topic"]: r["query"] for r in got}[1].startswith("Research Questions:\nRQ1: main") and {r["topic"]: r["query"] for r in got}[2] is None
