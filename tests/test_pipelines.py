"""Integration on the sf0.001 fixtures: entry, registry, streaming, layout, invariance."""

import glob
import os
import tempfile

import pyarrow.parquet as pq
from pyspark.sql import functions as F

import __spark_entry__ as E
from quarry.sources import fixtures as fx
from quarry.sources import io as sio
from quarry.streaming.ingest import resume_ingest


def test_entry_returns_rows(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 10 and set(df.columns) == {"topic", "n_cps", "n_found", "recall"}
    assert all(0 <= r["recall"] <= 1 for r in rows)


def test_every_oracle_has_a_query():
    qs, ors = E.queries(), E.oracle_sql()
    assert set(ors) <= set(qs)
    assert len(qs) >= 100


def test_invariant_to_shuffle_partitions(spark, sf):
    from quarry.plans.q_search import flagship
    base = None
    for n in (1, 8, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        rows = sorted(tuple(r) for r in flagship(spark, sf).collect())
        base = base or rows
        assert rows == base
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_resume_ingest_twice_equals_once(spark, sf):
    base = tempfile.mkdtemp(prefix="quarry-test-ingest-")
    w = fx.works(spark, sf).select("id", "title")
    w.filter("id % 2 = 0").write.parquet(f"{base}/in/a")
    resume_ingest(spark, f"{base}/in/*", f"{base}/out", f"{base}/ck", w.schema)
    resume_ingest(spark, f"{base}/in/*", f"{base}/out", f"{base}/ck", w.schema)
    assert spark.read.parquet(f"{base}/out").count() == w.filter("id % 2 = 0").count()
    w.filter("id % 2 = 1").write.parquet(f"{base}/in/b")
    resume_ingest(spark, f"{base}/in/*", f"{base}/out", f"{base}/ck", w.schema)
    out = spark.read.parquet(f"{base}/out")
    assert out.count() == w.count() == out.select("id").distinct().count()


def test_write_sized_and_compact_keep_rows(spark, sf):
    base = tempfile.mkdtemp(prefix="quarry-test-layout-")
    w = fx.works(spark, sf)
    sio.write_sized(w, f"{base}/small", max_rows=30)
    files = glob.glob(f"{base}/small/*.parquet")
    assert files and all(pq.ParquetFile(f).metadata.num_rows <= 30 for f in files)
    n = sio.compact(spark, f"{base}/small", f"{base}/big", target_bytes=10 ** 9)
    assert n == len(glob.glob(f"{base}/big/*.parquet")) == 2  # the rows, and the file that keeps the schema
    a = sorted(map(tuple, spark.read.parquet(f"{base}/big").collect()))
    assert a == sorted(map(tuple, w.collect()))


def test_topic_config_reader(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-test-cfg-"), "cfg.json")
    with open(path, "w") as fh:
        fh.write('{"T1": {"RQs": {"RQ2": {"main": "b?", "sub": []}, "RQ1": {"main": "a?", "sub": ["x", "y"]}},'
                 ' "query": "q1", "generated": "g1"}, "T2": {"RQs": {"RQ1": {"main": "c?"}}, "query": "q2"}}')
    cfg = sio.read_topic_config(spark, path)
    rows = sorted((r["topic"], r["rq_no"], r["main"], tuple(r["subs"])) for r in cfg.collect())
    assert rows == [("T1", 1, "a?", ("x", "y")), ("T1", 2, "b?", ()), ("T2", 1, "c?", ())]
    from quarry.operators.embed import format_questions, query_grid
    q = {r["topic"]: r["query"] for r in format_questions(cfg, 2, True).collect()}
    assert q["T1"] == "RQ1: a?\nRQ1.1: x\nRQ1.2: y\nRQ2: b?\n"
    assert query_grid(cfg).count() == 2 * 16


def test_average_curves_pad_with_one(spark, sf):
    from quarry.operators.feedback import average_curves
    curves = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.5), (2, 0, 0.0), (2, 1, 0.2), (2, 2, 0.4)],
                                   "topic int, i int, recall double")
    out = {r["k"]: r["recall"] for r in average_curves(curves, 5).collect()}
    assert out[0] == 0.0 and out[2] == (1.0 + 0.4) / 2 and out[4] == 1.0


def test_classifiers_rank_unlabelled_only(spark, sf):
    from quarry.operators.feedback import rank_by_classifier
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    lab = e.filter("id < 200").select("id", (F.col("label") == 0).cast("int").alias("included"))
    for kind in ("svm", "gbt"):
        out = rank_by_classifier(e.select("id", "embedding"), lab, kind, 7).collect()
        assert len(out) == 7 and all(r["id"] >= 200 for r in out)


def test_lookup_on_id_layout_prunes_and_skips_unknown(spark, sf):
    base = tempfile.mkdtemp(prefix="quarry-test-lookup-")
    w = fx.works(spark, sf)
    sio.write_by_id(w, f"{base}/by_id", 8)
    table = spark.read.parquet(f"{base}/by_id")
    req = spark.createDataFrame([(3,), (5,), (5,), (10 ** 9,)], ["id"])
    got = sorted(r["id"] for r in sio.lookup(table, req).collect())
    assert got == [3, 5]
    plan = sio.lookup(table, req)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and ("In(id" in plan or "EqualTo(id" in plan or "Or(" in plan)


def test_score_pairs_and_encode_take_user_functions(spark):
    from quarry.operators.embed import encode
    from quarry.operators.rerank import score_pairs

    def _length_scorer():  # defined here so the workers receive it by value
        def score(q, d):
            return d.fillna("").str.len().astype("float64")
        return score

    def _char_encoder():
        import numpy as np

        def enc(texts):
            return np.array([[len(t), t.count("a"), 1.0] for t in texts], dtype="float32")
        return enc
    pairs = spark.createDataFrame([(1, 10, "q", "aa"), (1, 11, "q", "aaaa"), (2, 12, "q", "a")],
                                  ["topic", "id", "query", "text"])
    ranked = {(r["topic"], r["id"]): r["rank"] for r in
              score_pairs(pairs, ["topic"], scorer_factory=_length_scorer).collect()}
    assert ranked == {(1, 11): 1, (1, 10): 2, (2, 12): 1}
    vecs = {r["id"]: list(r["embedding"]) for r in encode(pairs.select("id", "text"), _char_encoder).collect()}
    assert vecs[11] == [4.0, 4.0, 1.0] and len(vecs) == 3


def test_resume_ingest_unique_ids_across_files(spark, sf):
    base = tempfile.mkdtemp(prefix="quarry-test-ingest-uniq-")
    w = fx.works(spark, sf).select("id", "title")
    w.filter("id < 120").write.parquet(f"{base}/in/a")
    w.filter("id >= 80").unionByName(w.filter("id >= 150")).write.parquet(f"{base}/in/b")  # overlaps + dupes
    resume_ingest(spark, f"{base}/in/*", f"{base}/out", f"{base}/ck", w.schema, unique_key="id")
    resume_ingest(spark, f"{base}/in/*", f"{base}/out", f"{base}/ck", w.schema, unique_key="id")
    out = spark.read.parquet(f"{base}/out")
    assert out.count() == out.select("id").distinct().count() == w.count()
