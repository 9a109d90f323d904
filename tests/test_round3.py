"""Work is done once and in bounded pieces: all-pairs search, its effect, keyword scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluate as ev
from quarry.operators import search as srch


def _vectors(n, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[n // 2:n // 2 + 40] = x[:40]  # copies tie
    x[n - 1] = 0
    return x


@pytest.mark.parametrize("digits", [6, 2, None])
def test_single_precision_filter_keeps_the_best_rows(digits):
    x = _vectors(3000)
    q = x[:50].astype(float)
    q /= np.linalg.norm(q, axis=1)[:, None]
    near = srch._near(x)
    cols, at, s = srch._best_rows(x, q, 7, "cosine", digits, near)
    full = (x.astype(float) @ q.T) / np.maximum(np.linalg.norm(x.astype(float), axis=1), 1e-300)[:, None]
    if digits is not None:
        full = srch.np_round_half_away(full, digits)
    for i in range(50):
        want = np.lexsort((np.arange(len(x)), -full[:, i]))[:7]
        assert s[cols == i].tolist() == pytest.approx(full[want, i].tolist(), abs=1e-12)
        if digits is not None:
            assert at[cols == i].tolist() == want.tolist()
    assert srch._near(np.array([[1, np.inf]], np.float32)) is None


def test_flags_are_found_in_any_length():
    for n in (0, 1, 7, 8, 9, 64, 1003):
        flags = np.random.default_rng(n).random(n) < 0.1
        assert srch._true(flags).tolist() == np.flatnonzero(flags).tolist()


def test_core_effect_reads_the_runs_once(spark):
    asked = spark.range(6).select((F.col("id") % 2).cast("int").alias("topic"), (F.col("id") % 3).alias("core_id"), (F.col("id") + 10).alias("id"))
    runs = asked.mapInPandas(lambda batches: batches, asked.schema)
    cps = spark.createDataFrame([(0, 10, "a"), (0, 12, None), (1, 11, "b"), (1, 11, "b2")], "topic int, id long, title string")
    out = ev.core_effect(runs, cps)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    got = {(r["topic"], r["core_id"]): (r["n_cores"], r["n_cps"], r["recall"]) for r in out.collect()}
    assert got == {(0, 0): (1, 2, 0.5), (0, 1): (0, 2, 0.0), (0, 2): (0, 2, 0.0),
                   (1, 0): (0, 2, 0.0), (1, 1): (2, 2, 1.0), (1, 2): (0, 2, 0.0)}


def test_segments_at_rare_white_space_and_the_memo_before():
    from tokenizers import Tokenizer, models, pre_tokenizers

    from quarry.llm.pieces import WHITE, SegmentEncoder, byte_chars
    tk = Tokenizer(models.BPE(vocab={c: i for i, c in enumerate(byte_chars())}, merges=[]))
    tk.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    enc = SegmentEncoder(tk, lambda token, _: len(token), memo_segments=3, words=True)
    for a in (*WHITE, "\0", "x"):
        for b in (*WHITE, "\0", "x"):
            for text in (f"one{a}{b}two\nend", f"{a}one {b}two", f"one two{a}{b}"):
                unsafe, lines = enc.unsafe(text), "\n" in text and not enc.unsafe_line(text)
                got = enc.segments(text)
                assert (got == ["\0" + x for x in enc.cut(text)]) if unsafe else (any(k.startswith("\0\n") for k in got[1:]) == bool(lines and "\n" in text[1:]))
    asked, learn = [], enc.learn
    enc.learn = lambda keys: (asked.extend(keys), learn(keys))
    for text in ("common a b c", "common d e f", "common g h i"):
        assert list(enc.map([text])) == [len(text)]
    assert asked.count("\0common") == 1  # each text fills the memo, yet the frequent segment is encoded once


def test_keyword_scores_of_the_corpus_make_no_row_per_pair(spark, tmp_path):
    from quarry.operators import rerank as rr
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    docs = [(i % 70 if i % 9 else None, " ".join(rng.choice(words, rng.integers(0, 25)))) for i in range(150)] + [(500, None), (501, "")]
    queries = [(i, " ".join(rng.choice([*words, "none"], 6))) for i in range(12)] + [(12, "w1 w1"), (12, "w2"), (13, ""), (None, "w3")]
    d = spark.createDataFrame(docs, "id long, text string")
    q = spark.createDataFrame(queries, "query_id long, query string")
    seen = []
    old, rows = (rr.BUCKET_DOCS, rr.BUCKET_SCORES), rr.ROW_DOCS
    rr.ROW_DOCS = 0
    for rr.BUCKET_DOCS, rr.BUCKET_SCORES in (old, (16, 40)):
        for stop in (None, ["w4", "w5"]):
            got = rr.bm25_plus(q, d, 5, stop_words=stop)
            assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
            # the plan by rows, for groups: the same with one group
            want = rr.bm25_plus(q.withColumn("g", F.lit(1)), d.withColumn("g", F.lit(1)), 5, group="g", stop_words=stop).drop("g")
            # rows that tie by rank are fixed by id, so results are equal but for the order of sums
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
            seen.append(got.count())
    rr.BUCKET_DOCS, rr.BUCKET_SCORES = old
    assert min(seen) > 50
    assert rr.bm25_plus(q.where("query = ''"), d, 5).count() == 0
    rr.ROW_DOCS = rows
    assert rr.bm25_plus(q, d.where("false"), 5).count() == 0
