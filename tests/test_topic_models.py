"""Models per topic (F5, F6) against numpy and plain Python."""

import math
from collections import Counter

import numpy as np
import pytest

from quarry.operators import feedback as fb


def _pool(spark, n=60, dim=6, seed=1):
    rnd = np.random.default_rng(seed)
    rows, lab = [], []
    for topic in range(4):
        for i in range(n):
            y = int(i % 3 == 0)
            v = rnd.standard_normal(dim) + y * np.r_[2.5 * (topic + 1), np.zeros(dim - 1)]
            rows.append((topic, 1000 * topic + i, [float(np.float32(x)) for x in v]))
            if i < 24 and (topic != 3 or y):  # topic 3 has no negatives
                lab.append((topic, 1000 * topic + i, y))
    rows.append((0, 9999, None))
    return rows, lab, spark.createDataFrame(rows, "topic long, id long, embedding array<float>").repartition(5), spark.createDataFrame(lab, "topic long, id long, included int").repartition(3)


def test_discriminant_matches_numpy(spark):
    rows, lab, pool, labelled = _pool(spark)
    got = {}
    for r in fb.rank_topics_by_classifier(pool, labelled, "lda", 1000).collect():
        got.setdefault(r["topic"], []).append((r["rank"], r["id"], r["score"]))
    assert set(got) == {0, 1, 2}
    known = {(t, i): y for t, i, y in lab}
    for topic, out in got.items():
        x = np.array([v for t, i, v in rows if (t, i) in known and t == topic])
        y = np.array([known[t, i] for t, i, v in rows if (t, i) in known and t == topic])
        m0, m1 = x[y == 0].mean(0), x[y == 1].mean(0)
        dev = np.r_[x[y == 0] - m0, x[y == 1] - m1]
        s = dev.T @ dev / len(x)
        s = 0.9 * s + 0.1 * np.trace(s) / 6 * np.eye(6)
        w = np.linalg.solve(s, m1 - m0)
        b = -w @ (m0 + m1) / 2 + math.log(y.sum() / (len(y) - y.sum()))
        want = {i: w @ np.array(v) + b for t, i, v in rows if t == topic and (t, i) not in known and v is not None}
        assert {i for _, i, _ in out} == set(want)
        assert all(abs(s_ - want[i]) < 1e-5 for _, i, s_ in out)
        assert [i for _, i, _ in sorted(out)] == [i for _, i, _ in sorted(out, key=lambda r: (-r[2], r[1]))]


def test_discriminant_with_fewer_rows_than_components(spark):
    rows, lab, pool, labelled = _pool(spark, n=40, dim=30)
    few = labelled.where("id % 1000 < 8")
    got = fb.rank_topics_by_classifier(pool, few, "lda", 5).collect()
    assert {r["topic"] for r in got} == {0, 1, 2} and all(math.isfinite(r["score"]) for r in got)


@pytest.mark.parametrize("kind", ["svm", "mlp", "gbt", "lda"])
def test_every_kind_puts_positives_first(spark, kind):
    rows, lab, pool, labelled = _pool(spark)
    got = fb.rank_topics_by_classifier(pool, labelled, kind, 10).collect()
    assert sorted({r["topic"] for r in got}) == [0, 1, 2]
    for topic in (0, 1, 2):
        top = [r["id"] for r in got if r["topic"] == topic]
        assert len(top) == 10 and not set(top) & {i for t, i, _ in lab}
        assert sum((i % 1000) % 3 == 0 for i in top) >= 6, (topic, top)
    again = fb.rank_topics_by_classifier(pool.repartition(2), labelled.repartition(1), kind, 10).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_too_many_labels_are_an_error(spark, monkeypatch):
    _, _, pool, labelled = _pool(spark)
    monkeypatch.setattr(fb, "MAX_LABELLED", 10)
    with pytest.raises(Exception, match="more than 10 labelled rows"):
        fb.rank_topics_by_classifier(pool, labelled, "svm", 5).collect()


def test_equal_vectors_rank_by_id(spark):
    pool = spark.createDataFrame([(1, i, [1.0, 2.0]) for i in range(6)], "topic long, id long, embedding array<float>")
    lab = spark.createDataFrame([(1, 0, 1), (1, 3, 0)], "topic long, id long, included int")
    for kind in ("svm", "mlp", "gbt", "lda"):
        assert [(r["id"], r["rank"]) for r in fb.rank_topics_by_classifier(pool, lab, kind, 3).orderBy("rank").collect()] == [(1, 1), (2, 2), (4, 3)]


def test_text_ranking_matches_plain_python(spark):
    texts = [(0, 1, "heart attack drug trial", 1), (0, 2, "heart drug heart", 1), (0, 3, "soil water crop", 0), (0, 4, "crop yield of soil", 0), (0, 5, "drug for the heart", None),
             (0, 6, "water and crop", None), (0, 7, "", None), (0, 8, None, None), (0, 9, "other words only", None), (1, 1, "alone here", 1), (1, 2, "no negatives", None)]
    pool = spark.createDataFrame([(t, i, x) for t, i, x, _ in texts], "topic long, id long, text string").repartition(3)
    lab = spark.createDataFrame([(t, i, y) for t, i, _, y in texts if y is not None], "topic long, id long, included int")
    got = {r["id"]: r["score"] for r in fb.rank_topics_by_text(pool, lab, 10).collect() if r["topic"] == 0}
    assert fb.rank_topics_by_text(pool, lab, 10).where("topic = 1").isEmpty()
    docs = {i: Counter((x or "").split()) for t, i, x, _ in texts if t == 0}
    df = Counter(w for d in docs.values() for w in d)
    vec = {}
    for i, d in docs.items():
        raw = {w: c * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w, c in d.items()}
        norm = math.sqrt(sum(v * v for v in raw.values())) or 1
        vec[i] = {w: v / norm for w, v in raw.items()}
    a = fb.NB_ALPHA
    sums = {c: Counter() for c in (0, 1)}
    for t, i, _, y in texts:
        if t == 0 and y is not None:
            for w, v in vec[i].items():
                sums[y][w] += v * 4 / 2 / 2
    p = {c: {w: math.log((sums[c][w] + a) / (sum(sums[c].values()) + a * len(df))) for w in df} for c in (0, 1)}
    for i in (5, 6, 7, 8, 9):
        assert abs(got[i] - sum(v * (p[1][w] - p[0][w]) for w, v in vec[i].items())) < 2e-6
    assert got[5] > got[9] > got[6] and got[7] == got[8] == 0


def test_topic_model_holds_any_vocabulary(spark):
    """More words than any fixed bound: the vocabulary is counted first, and a given bound still raises."""
    from pyspark.sql import functions as F
    from quarry.operators import topics as tp
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.concat(F.lit("w"), (F.col("id") * 1000 + i).cast("string"))))
    docs = spark.range(0, 270, 1, 4).select("id", F.concat(F.lit("often often often "), words).alias("text"))
    got = tp.topic_model(docs, k=2, n_terms=3).collect()
    assert len(got) == 6 and {r["topic"] for r in got} == {0, 1}
    assert "often" in {r["term"] for r in got}
    with pytest.raises(ValueError):
        tp.topic_model(docs.limit(2), k=2, vocab_size=100)
