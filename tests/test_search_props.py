"""Properties of the blocked exact search and its relatives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.vectors import np_round_half_away
from quarry.operators import search as srch


def _brute(qv, cv, ids, k, metric="cosine"):
    out = {}
    for qi, q in qv.items():
        if metric == "cosine":
            s = cv @ q / (np.linalg.norm(cv, axis=1) * np.linalg.norm(q))
        else:
            s = -np.sqrt(((cv - q) ** 2).sum(axis=1))
        s = np_round_half_away(s, 6)
        order = sorted(range(len(ids)), key=lambda i: (-s[i], ids[i]))[:k]
        out[qi] = [(ids[i], s[i]) for i in order]
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    cv = rng.normal(size=(300, 16))
    cv[7] = cv[5]  # an exact tie: broken by id
    cv[9] = cv[5]
    ids = list(range(1000, 1300))
    qv = {i: rng.normal(size=16) for i in range(6)}
    qv[6] = cv[5].copy()
    corpus = spark.createDataFrame([(ids[i], cv[i].tolist()) for i in range(300)], "id long, embedding array<double>")
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in qv.items()], "query_id long, vector array<double>")
    return qv, cv, ids, corpus, queries


@pytest.mark.parametrize("parts", [1, 8, 64])
@pytest.mark.parametrize("k", [1, 5, 50])
def test_blocked_equals_brute_force(spark, data, parts, k):
    qv, cv, ids, corpus, queries = data
    got = srch.search(queries, corpus.repartition(parts), k, fan_in=4).collect()
    want = _brute(qv, cv, ids, k)
    for q in qv:
        rows = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [(r["id"], r["score"]) for r in rows] == [(i, pytest.approx(s)) for i, s in want[q]]
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_query_passes_and_euclidean(spark, data):
    qv, cv, ids, corpus, queries = data
    one = srch.search(queries, corpus, 10, metric="neg_euclidean").collect()
    many = srch.search(queries, corpus.repartition(5), 10, metric="neg_euclidean", max_queries_per_pass=2).collect()
    key = lambda r: (r["query_id"], r["rank"])
    assert sorted(map(tuple, one), key=lambda t: (t[0], t[3])) == sorted(map(tuple, many), key=lambda t: (t[0], t[3]))
    want = _brute(qv, cv, ids, 10, "neg_euclidean")
    for q in qv:
        rows = sorted((r for r in one if r["query_id"] == q), key=key)
        assert [r["id"] for r in rows] == [i for i, _ in want[q]]


def test_k_larger_than_corpus_returns_all(spark, data):
    _, _, _, corpus, queries = data
    out = srch.search(queries.limit(1), corpus, 10_000)
    assert out.count() == 300


def test_keyed_search_scores_only_same_key(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b"), (3, [1.0, 1.0], "a")],
                                   "id long, embedding array<double>, topic string")
    q = spark.createDataFrame([(10, [0.0, 1.0], "a"), (11, [1.0, 0.0], "b")], "query_id long, vector array<double>, topic string")
    out = srch.search(q, corpus, 5, key="topic").collect()
    assert {(r["query_id"], r["id"]) for r in out} == {(10, 3), (10, 1), (11, 2)}
    best = {r["query_id"]: r["id"] for r in out if r["rank"] == 1}
    assert best == {10: 3, 11: 2}


def test_all_scores_without_k(spark, data):
    _, _, _, corpus, queries = data
    out = srch.search(queries, corpus.repartition(3), None)
    assert out.count() == 7 * 300 and "rank" not in out.columns


def test_approx_is_subset_with_exact_scores(spark, data):
    qv, cv, ids, corpus, queries = data
    approx = srch.search_approx(queries, corpus, 20, cells=16, probes=6).collect()
    exact_all = {(r["query_id"], r["id"]): r["score"] for r in srch.search(queries, corpus, None).collect()}
    assert approx, "LSH returned no candidate"
    for r in approx:
        assert r["score"] == pytest.approx(exact_all[(r["query_id"], r["id"])], abs=1e-6)
    per_q = {}
    for r in approx:
        per_q.setdefault(r["query_id"], []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 20 for v in per_q.values())


def test_vector_parity_and_nearest(spark, data):
    _, _, _, corpus, queries = data
    par = srch.vector_parity(corpus, corpus).collect()
    assert all(r["ok"] and r["cosine"] == pytest.approx(1.0) for r in par)
    excl = corpus.filter(F.col("id") == 1005).select("id")
    near = {r["query_id"]: r["id"] for r in srch.nearest(queries, corpus, excl).collect()}
    assert near[6] == 1007  # the duplicates of 1005 remain; smallest id first


@pytest.mark.parametrize("k", [3, 40])
def test_pruned_search_equals_unpruned(spark, data, k):
    _, _, _, corpus, queries = data
    c = corpus.repartition(16)
    a = sorted(map(tuple, srch.search(queries, c, k, prune=False).collect()))
    b = sorted(map(tuple, srch.search(queries, c, k, prune=True).collect()))
    assert a == b and len(a) == 7 * k


def test_invariant_to_input_order(spark, data):
    _, _, _, corpus, queries = data
    a = sorted(map(tuple, srch.search(queries, corpus, 25).collect()))
    b = sorted(map(tuple, srch.search(queries.orderBy(F.rand(7)), corpus.orderBy(F.rand(3)).repartition(5), 25)
                   .collect()))
    assert a == b


def test_match_titles_approx_subset_of_exact(spark, data):
    from quarry.operators.clean import match_titles
    _, _, _, corpus, queries = data
    exact = {(r["query_id"], r["id"]) for r in match_titles(queries, corpus, 0.5).collect()}
    above = {(r["query_id"], r["id"]) for r in srch.search(queries, corpus, None).filter("score > 0.5").collect()}
    approx = {(r["query_id"], r["id"]) for r in match_titles(queries, corpus, 0.5, approx=True).collect()}
    assert exact <= above and approx <= above and (6, 1005) in exact
    assert len({q for q, _ in approx}) == len(approx)  # at most one partner per left row


def test_running_floor_with_many_batches(spark, data):
    # small Arrow batches force many compactions per task; the answer must not change
    qv, cv, ids, corpus, queries = data
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = srch.search(queries, corpus.repartition(2), 3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    want = _brute(qv, cv, ids, 3)
    for q in qv:
        rows = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["id"] for r in rows] == [i for i, _ in want[q]]


def test_many_passes_are_one_plan_over_the_corpus(spark, data, monkeypatch):
    """The plan does not grow with the passes; blocks, groups, ties and copies give the same rows as one pass."""
    qv, cv, ids, corpus, queries = data
    copies = corpus.unionByName(corpus.withColumn("id", F.col("id") + 100_000))  # every score is tied
    one = srch.search(queries, copies, 7)
    monkeypatch.setattr(srch, "BLOCK_NUMBERS", 40 * len(next(iter(cv))))
    many = srch.search(queries, copies, 7, max_queries_per_pass=1)
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") <= 1 and plan.count("MapInPandas") == 0
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    rnd = np.random.default_rng(4)
    c, q = np.round(rnd.standard_normal((500, 6)), 1), rnd.standard_normal((9, 6))
    monkeypatch.setattr(srch, "BLOCK_SCORES", 9 * 40)
    cols, at, s = srch._best_rows(c, q, 11, "dot", 2)
    full = np_round_half_away(c @ q.T, 2)
    for j in range(9):
        assert list(at[cols == j]) == sorted(range(500), key=lambda i: (-full[i, j], i))[:11]
        assert list(s[cols == j]) == [full[i, j] for i in at[cols == j]]
