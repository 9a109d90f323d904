"""The neighbour map and the learned pair scorer."""

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import layout, pair_ranker
from quarry.operators import topics as tp


def _points(spark, n=160, dim=20):
    rnd = np.random.default_rng(3)
    centres = rnd.standard_normal((8, dim)) * 3
    v = np.float32(centres[np.arange(n) % 8] + rnd.standard_normal((n, dim)))
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<float>").repartition(3)


def test_graph_weights(spark):
    c = _points(spark)
    edges = layout.neighbour_graph(c, 5).collect()
    assert all(r["a"] < r["b"] and 0 < r["w"] <= 1 + 1e-12 for r in edges)
    best = {}
    for r in edges:
        for x in (r["a"], r["b"]):
            best[x] = max(best.get(x, 0), r["w"])
    assert len(best) == 160 and min(best.values()) > 0.999  # the nearest other has weight 1


def test_map_keeps_more_neighbours_than_the_linear_map(spark):
    c = _points(spark)
    linear = tp.project_2d(c).cache()
    places = layout.project_neighbours(c, linear, k=8, epochs=12).cache()
    assert places.count() == 160 and places.where("x is null or y is null or isnan(x) or isnan(y)").isEmpty()
    kept = [layout.neighbours_kept(c, m) for m in (places, linear)]
    assert kept[0] > kept[1], kept


def test_map_of_few_points(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<float>")
    start = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    assert [r["id"] for r in layout.project_neighbours(one, start, epochs=1).collect()] == [1]
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "id long, embedding array<float>")
    start = spark.createDataFrame([(i, 0.0, 0.0) for i in range(4)], "id long, x double, y double")
    got = layout.project_neighbours(same, start, epochs=2).collect()
    assert len(got) == 4 and all(np.isfinite([r["x"], r["y"]]).all() for r in got)


def test_pair_ranker_learns_the_order(spark):
    rnd = np.random.default_rng(2)
    rows = []
    for t in range(8):
        for i in range(40):
            y = int(i % 4 == 0)
            rows.append((t, 100 * t + i, float(5 * t + 2 * y + rnd.standard_normal()), float(rnd.standard_normal()), float(1000 - 300 * y + 200 * rnd.standard_normal()), y))
    pairs = spark.createDataFrame(rows, "topic int, id long, f1 double, f2 double, f3 double, y int").repartition(3)
    weights = pair_ranker.fit(pairs.where("topic % 2 = 0"), ["f1", "f2", "f3"], "y")
    assert weights["f1"] > 0.3 and weights["f3"] < -0.3 and abs(weights["f2"]) < 0.5
    ranked = pair_ranker.rank(pairs.where("topic % 2 = 1"), weights)
    auc = pair_ranker.order_quality(ranked, pairs.where("y = 1").select("topic", "id"))
    by_one = pair_ranker.rank(pairs.where("topic % 2 = 1"), {"f2": 1.0})
    assert auc > 0.85 > pair_ranker.order_quality(by_one, pairs.where("y = 1").select("topic", "id"))
    assert ranked.groupBy("topic").agg(F.max("rank").alias("m")).collect()[0]["m"] == 40
