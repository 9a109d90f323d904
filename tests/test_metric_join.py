"""The pivot join against brute force."""

import numpy as np
import pytest

from quarry.operators import metric_join as mj


def _rows(n, dim, seed, first):
    rnd = np.random.default_rng(seed)
    centres = np.random.default_rng(0).standard_normal((15, dim))
    v = np.float32(centres[rnd.integers(0, 15, n)] + 0.08 * rnd.standard_normal((n, dim)))
    return [(first + i, [float(x) for x in r]) for i, r in enumerate(v)]


def _brute(left, right, min_sim, other):
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    out = []
    for q, v in left:
        best = max(((np.floor(abs(float(unit(v) @ unit(w))) * 1e6 + 0.5) / 1e6 * np.sign(float(unit(v) @ unit(w))), -i) for i, w in right if not (other and i == q)), default=(-2, 0))
        if best[0] > min_sim:
            out.append((q, -best[1], float(best[0])))
    return sorted(out)


@pytest.mark.parametrize("min_sim,pivots,other", [(0.995, None, False), (0.9, 40, True), (0.2, 5, True)])
def test_best_partners_match_brute_force(spark, monkeypatch, min_sim, pivots, other):
    monkeypatch.setattr(mj, "BLOCK", 20)
    monkeypatch.setattr(mj, "ASK", 7)
    left, right = _rows(90, 8, 1, 0), _rows(140, 8, 2, 50)
    right += [(500 + i, right[3][1]) for i in range(60)]              # a hot group of copies
    left += [(700, right[3][1]), (701, [-x for x in right[5][1]])]
    odd = [(800, None), (801, [0.0] * 8), (802, [float("nan")] * 8), (803, [None] + [1.0] * 7)]
    a = spark.createDataFrame(left + odd, "query_id long, vector array<float>").repartition(3)
    b = spark.createDataFrame(right + odd, "id long, embedding array<float>").repartition(4)
    got = sorted(map(tuple, mj.best_partners(a, b, min_sim, pivots=pivots, other_id=other).collect()))
    want = _brute(left, right, min_sim, other)
    assert [(q, i) for q, i, _ in got] == [(q, i) for q, i, _ in want] and want
    assert all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(got, want))


def test_best_partners_of_nothing(spark):
    a = spark.createDataFrame(_rows(5, 4, 1, 0), "query_id long, vector array<float>")
    none = spark.createDataFrame([], "id long, embedding array<float>")
    assert mj.best_partners(a, none).collect() == []
    assert mj.best_partners(a.where("false"), spark.createDataFrame(_rows(5, 4, 1, 0), "id long, embedding array<float>")).collect() == []


def test_copies_of_left_rows_leave_a_task_in_bounded_parts(spark, monkeypatch):
    from quarry.operators import metric_join as mj
    rng = np.random.default_rng(11)
    x = rng.normal(size=(150, 6))
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x + 0.01)], "query_id long, vector array<double>")
    right = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    want = sorted(map(tuple, mj.best_partners(left, right, 0.9).collect()))
    monkeypatch.setattr(mj, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(mj, "NUMBERS_AT_ONCE", 30)
    assert want and sorted(map(tuple, mj.best_partners(left, right, 0.9).collect())) == want
