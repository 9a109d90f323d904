"""Small tables with answers worked out by hand."""

import math

import pytest

from quarry.functions import text as tx
from quarry.operators import evaluate as ev
from quarry.operators import rerank as rr


def test_rrf_zero_based_ranks_and_id_ties(spark):
    rankings = spark.createDataFrame(
        [(1, "m1", "a", 1), (1, "m1", "b", 2), (1, "m1", "c", 3), (1, "m2", "b", 1), (1, "m2", "a", 2)],
        ["topic", "method", "id", "rank"])
    out = {r["id"]: (r["rrf"], r["rank"]) for r in rr.rrf(rankings, ["topic"]).collect()}
    assert out["a"][0] == pytest.approx(1 / 60 + 1 / 61, abs=1e-9)
    assert out["b"][0] == pytest.approx(1 / 61 + 1 / 60, abs=1e-9)
    assert out["c"][0] == pytest.approx(1 / 62, abs=1e-9)
    assert (out["a"][1], out["b"][1], out["c"][1]) == (1, 2, 3)  # a/b tie -> id order


def test_rrf_from_scores(spark):
    rankings = spark.createDataFrame([(1, "s", "x", 0.2), (1, "s", "y", 0.9)], ["topic", "method", "id", "score"])
    out = {r["id"]: r["rrf"] for r in rr.rrf(rankings, ["topic"], rank_col=None, score_col="score").collect()}
    assert out["y"] == pytest.approx(1 / 60) and out["x"] == pytest.approx(1 / 61)


def test_quartile_cuts(spark):
    eff = spark.createDataFrame([(1, 1.0), (1, 0.5), (1, 0.25), (1, 0.0)], ["topic", "recall"])
    r = ev.quartile_means(eff).first()
    assert (r["avg_top_25"], r["avg_mid_50"], r["avg_bot_25"]) == (1.0, 0.375, 0.0)


def test_recall_topic_without_core_rows_is_null(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1)], ["topic", "id", "rank"])
    cps = spark.createDataFrame([(1, 11), (1, 12)], ["topic", "id"])
    out = {r["topic"]: r for r in ev.recall_at_k(run, cps, 1).collect()}
    assert out[1]["recall"] == 0.0 and out[1]["n_cps"] == 2
    assert ev.recall_at_k(run, cps, 2).filter("topic = 1").first()["recall"] == 0.5
    assert out[2]["recall"] is None


def test_restore_abstract(spark):
    df = spark.createDataFrame(
        [(1, {"b": [1, 3], "a": [0, 2]}), (2, {"x": [0], "y": [0]}), (3, {}), (4, None)],
        "id int, m map<string, array<int>>")
    out = {r["id"]: r["t"] for r in df.select("id", tx.restore_abstract("m").alias("t")).collect()}
    assert out == {1: "a b a b", 2: "x y", 3: "", 4: None}


def test_tokens_strip_punctuation_and_drop_empty(spark):
    df = spark.createDataFrame([("Hello, World!! (test) -- x\tY\nz's",)], ["t"])
    assert df.select(tx.tokens("t")).first()[0] == ["hello", "world", "test", "x", "y", "z's"]


def test_parse_text_first_prefix_only_and_missing_separator(spark):
    df = spark.createDataFrame([("Title: A Title: B[SEP]\n abs[SEP]tail",), ("no separator",)], ["text"])
    rows = {r["title"]: r["abstract"] for r in df.select(tx.parse_title("text").alias("title"),
                                                           tx.parse_abstract("text").alias("abstract")).collect()}
    assert rows == {"A Title: B": "\n abs", "no separator": None}


def _bm25_plus_brute(query, docs, k1=1.5, b=0.75, delta=1.0):
    """BM25Plus by the textbook formula, every document scored."""
    n = len(docs)
    avgdl = sum(len(d) for d in docs.values()) / n
    df = {}
    for d in docs.values():
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    out = {}
    for i, d in docs.items():
        s = 0.0
        for q in query:
            idf = math.log((n + 1) / df[q]) if q in df else 0.0
            tf = d.count(q)
            s += idf * (delta + tf * (k1 + 1) / (k1 * (1 - b + b * len(d) / avgdl) + tf))
        out[i] = round(s, 4)
    return out


def test_bm25_plus_against_brute_force_with_missing_terms(spark):
    docs = {1: "the cat sat on the mat", 2: "a dog", 3: "cat cat dog", 4: "", 5: "birds fly"}
    q = "cat dog unicorn cat"
    ddf = spark.createDataFrame(list(docs.items()), ["id", "text"])
    qdf = spark.createDataFrame([(7, q)], ["query_id", "query"])
    got = {r["id"]: (r["score"], r["rank"]) for r in rr.bm25_plus(qdf, ddf, 5, fill=True).collect()}
    want = _bm25_plus_brute(q.split(), {i: t.split() for i, t in docs.items()})
    order = sorted(want, key=lambda i: (-want[i], i))
    assert {i: s for i, (s, _) in got.items()} == pytest.approx(want)
    assert [i for i, _ in sorted(got.items(), key=lambda kv: kv[1][1])] == order
    # without fill only the documents that contain a query term
    part = {r["id"] for r in rr.bm25_plus(qdf, ddf, 5).collect()}
    assert part == {1, 2, 3}


def test_render_null_propagates(spark):
    df = spark.createDataFrame([("T", None), ("T", "A")], "title string, abstract string")
    out = [r[0] for r in df.select(tx.render_text("title", "abstract", "core")).collect()]
    assert out == [None, "Title: T[SEP]\nAbstract: A"]


def test_keep_first_is_min_by_order(spark):
    from quarry.operators.clean import dedupe_title
    df = spark.createDataFrame([(3, " Foo"), (1, "foo "), (2, "bar")], ["id", "title"])
    assert sorted(r["id"] for r in dedupe_title(df).collect()) == [1, 2]


def test_score_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], ["score"])
    bins = sorted((r["bin"], r["n"]) for r in ev.score_histogram(df, bins=4).collect())
    assert bins == [(0, 1), (2, 1), (3, 1)]


def test_select_core_positions(spark):
    from quarry.operators.embed import select_core
    eff = spark.createDataFrame([(1, c, n) for c, n in [(10, 5), (11, 3), (12, 9), (13, 1)]],
                                ["topic", "core_id", "n_cores"])
    pick = {k: select_core(eff, k).first()["core_id"] for k in ("best", "middle", "worst")}
    assert pick == {"best": 12, "middle": 11, "worst": 13}  # order 12,10,11,13; middle = 4//2+1 = 3rd


def test_format_questions(spark):
    from quarry.operators.embed import format_questions
    cfg = spark.createDataFrame([("t", 2, "second?", ["s1"]), ("t", 1, "first?", ["a", "b"])],
                                "topic string, rq_no int, main string, subs array<string>")
    q = format_questions(cfg, 5, True).first()["query"]
    assert q == "RQ1: first?\nRQ1.1: a\nRQ1.2: b\nRQ2: second?\nRQ2.1: s1\n"
    q1 = format_questions(cfg, 1, False).first()["query"]
    assert q1 == "RQ1: first?\n"
    texts = spark.createDataFrame([("t", "doc")], ["topic", "text"])
    full = format_questions(cfg, 1, False, texts).first()["query"]
    assert full == "Research Questions:\nRQ1: first?\n [SEP] Supporting Documents:\n doc"


def test_feedback_vector(spark):
    from quarry.operators.feedback import feedback_vector
    pos = spark.createDataFrame([(1, [1.0, 0.0]), (1, [3.0, 2.0]), (2, [1.0, 1.0])], "topic int, embedding array<double>")
    neg = spark.createDataFrame([(1, [0.0, 4.0])], "topic int, embedding array<double>")
    out = {r["topic"]: r["vector"] for r in feedback_vector(pos, neg).collect()}
    assert out == {1: [4.0, -2.0], 2: [1.0, 1.0]}


def test_bm25_statistics_are_per_group(spark):
    docs = {("g1", 1): "red fish", ("g1", 2): "blue fish fish", ("g2", 3): "red red sky", ("g2", 4): "sky"}
    ddf = spark.createDataFrame([(g, i, t) for (g, i), t in docs.items()], ["topic", "id", "text"])
    qdf = spark.createDataFrame([("g1", 1, "red fish"), ("g2", 2, "red fish")], ["topic", "query_id", "query"])
    got = {(r["topic"], r["id"]): r["score"] for r in rr.bm25_plus(qdf, ddf, 10, group="topic", fill=True).collect()}
    for g in ("g1", "g2"):
        part = {i: t.split() for (gg, i), t in docs.items() if gg == g}
        want = _bm25_plus_brute(["red", "fish"], part)
        assert {i: got[(g, i)] for i in part} == pytest.approx(want)


def test_bm25_fill_with_several_queries_per_group(spark):
    docs = {1: "a b", 2: "c", 3: "d", 4: "a", 5: "e", 6: "b b"}
    ddf = spark.createDataFrame(list(docs.items()), ["id", "text"])
    qs = {10: "a", 11: "zzz"}
    qdf = spark.createDataFrame(list(qs.items()), ["query_id", "query"])
    out = rr.bm25_plus(qdf, ddf, 4, fill=True).collect()
    for q, text in qs.items():
        want = _bm25_plus_brute(text.split(), {i: t.split() for i, t in docs.items()})
        order = sorted(want, key=lambda i: (-want[i], i))[:4]
        got = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["id"] for r in got] == order
        assert [r["score"] for r in got] == pytest.approx([want[i] for i in order])
