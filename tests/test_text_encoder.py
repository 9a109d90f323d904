"""The kept encoder against numpy, and ingestion that encodes."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import text_encoder as te
from quarry.sources.io import scratch_path
from quarry.streaming.ingest import encode_ingest


def _texts(n=120, seed=1):
    rnd = np.random.default_rng(seed)
    topics = [["t%d_%d" % (t, i) for i in range(25)] for t in range(6)]
    return [(i, " ".join(rnd.choice(topics[i % 6], 20)) + " " + " ".join("c%d" % j for j in rnd.integers(0, 30, 5))) for i in range(n)]


@pytest.fixture(scope="module")
def fitted(spark):
    rows = _texts()
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "neverseen words")], "id long, text string").repartition(4)
    folder = scratch_path(spark, "encoder")
    te.fit_encoder(docs, folder, width=12)
    return rows, docs, folder


def _matrix(rows, n):
    words = sorted({w for _, t in rows for w in t.split()})
    df = {w: sum(w in t.split() for _, t in rows) for w in words}
    words = [w for w in words if df[w] >= 2]
    a = np.array([[t.split().count(w) * (np.log((1 + n) / (1 + df[w])) + 1) for w in words] for _, t in rows])
    return words, a / np.linalg.norm(a, axis=1, keepdims=True)


def test_axes_span_the_leading_range(spark, fitted):
    rows, docs, folder = fitted
    words, a = _matrix(rows, 123)
    axes = {r["term"]: r["axis"] for r in spark.read.parquet(folder + "/terms").collect()}
    assert set(axes) == set(words)
    p = np.array([axes[w] for w in words])
    assert np.allclose(p.T @ p, np.eye(12), atol=1e-8)
    kept, best = np.linalg.norm(a @ p) ** 2, (np.linalg.svd(a, compute_uv=False)[:12] ** 2).sum()
    assert kept >= 0.98 * best
    weight = ((a @ p) ** 2).sum(0)
    assert (np.diff(weight) <= 1e-9).all()


def test_vectors_are_kept_and_near_within_topics(spark, fitted):
    rows, docs, folder = fitted
    got = {r["id"]: np.array(r["embedding"]) for r in te.encode_texts(docs, folder).collect()}
    assert len(got) == 123 and all(len(v) == 12 for v in got.values())
    assert all(not got[i].any() for i in (900, 901, 902))
    words, a = _matrix(rows, 123)
    axes = {r["term"]: r["axis"] for r in spark.read.parquet(folder + "/terms").collect()}
    y = a @ np.array([axes[w] for w in words])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    assert all(np.allclose(got[i], y[k], atol=1e-5) for k, (i, _) in enumerate(rows))
    same = np.mean([got[i] @ got[j] for i in range(30) for j in range(i) if i % 6 == j % 6])
    other = np.mean([got[i] @ got[j] for i in range(30) for j in range(i) if i % 6 != j % 6])
    assert same > other + 0.4
    alone = te.encode_texts(docs.where("id = 7"), folder).collect()
    assert np.allclose(alone[0]["embedding"], got[7])


def test_ingest_encodes_every_id_once(spark, fitted, tmp_path):
    rows, docs, folder = fitted
    src, sink, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    run = lambda: encode_ingest(spark, src, sink, ckpt, docs.schema, lambda df: te.encode_texts(df, folder), max_files_per_trigger=1)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    docs.where("id < 60").coalesce(1).write.parquet(src)
    docs.where("id between 40 and 80").coalesce(1).write.mode("append").parquet(src)
    run()
    first = spark.read.parquet(sink)
    assert first.count() == first.select("id").distinct().count() == 81
    docs.where("id < 100").coalesce(2).write.mode("append").parquet(src)
    run()
    run()
    out = spark.read.parquet(sink)
    assert out.count() == out.select("id").distinct().count() == 100
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") == before


def test_a_batch_that_failed_half_way_is_run_again(spark, fitted, tmp_path):
    rows, docs, folder = fitted
    src, sink, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    docs.where("id < 50").coalesce(1).write.parquet(src)
    docs.where("id between 30 and 90").coalesce(1).write.mode("append").parquet(src)
    calls = []

    def fails(df):
        calls.append(1)
        if len(calls) == 2:
            df.limit(3).write.mode("overwrite").parquet(sink + "/batch=1")  # what a lost run left behind
            raise RuntimeError("lost")
        return te.encode_texts(df, folder)

    with pytest.raises(Exception, match="lost"):
        encode_ingest(spark, src, sink, ckpt, docs.schema, fails, max_files_per_trigger=1)
    encode_ingest(spark, src, sink, ckpt, docs.schema, lambda df: te.encode_texts(df, folder), max_files_per_trigger=1)
    out = spark.read.parquet(sink)
    assert out.count() == out.select("id").distinct().count() == 91 and out.where(F.size("embedding") != 12).isEmpty()
    assert glob.glob(sink + "/batch=*")


def test_products_ship_a_word_once_per_block(spark, tmp_path, monkeypatch):
    """The rows that meet the words' vectors are blocks and their words, not the entries of the matrix."""
    seen, plain = [], te._product
    monkeypatch.setattr(te, "BLOCK_ENTRIES", 700)
    monkeypatch.setattr(te, "_product", lambda rows, words, *a, **k: seen.append((rows, words)) or plain(rows, words, *a, **k))
    docs = spark.createDataFrame(_texts(200, seed=3), "id long, text string").repartition(4)
    te.fit_encoder(docs, str(tmp_path / "e"), width=5)
    got = {r["id"]: np.array(r["embedding"]) for r in te.encode_texts(docs, str(tmp_path / "e")).collect()}
    rows, words = seen[0]
    entries = rows.select(F.explode("no")).count()
    assert rows.select("b").distinct().count() > 1 and words.count() < entries / 2 and words.distinct().count() == words.count()
    assert len(got) == 200 and all(abs(np.linalg.norm(v) - 1) < 1e-5 for v in got.values())
