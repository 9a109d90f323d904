import random

import brute
import numpy as np
import pytest

from quarry.llm import minhash, substring, vectors
from quarry.llm.common import connected_components
from quarry.llm.hashing import window_hashes, winnow, word_hashes


@pytest.mark.parametrize("window", [50, 7])
def test_substring_matches_brute_force(docs, texts, window):
    got = substring.remove_repeats(docs, window=window).collect()
    rows = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got)
    want = sorted((str(d), n, gone, brute.sha(" ".join(kept))) for (d, _), (n, gone, kept) in zip(texts, brute.strike(texts, window)))
    assert rows == want
    assert sum(r[2] for r in rows) > 0
    for r in got:
        if r["kept_text"] is not None:
            assert brute.sha(r["kept_text"]) == r["kept_sha256"]
        if window == 50:
            assert (r["longest_repeat"] >= 50) or r["n_removed"] == 0


def test_substring_levels(spark):
    w = ["t%d" % i for i in range(500)]
    table = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(["x"] + w[:230])), (3, " ".join(w[100:160] + ["y"])), (4, "z " * 10)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["longest_repeat"]) for r in substring.remove_repeats(table, window=50).collect()}
    assert got == {1: (0, 200), 2: (230, 200), 3: (60, 50), 4: (0, 0)}


def test_substring_empty_table(empty):
    assert substring.remove_repeats(empty).collect() == []


def test_winnowing_keeps_one_of_every_window():
    h = window_hashes(word_hashes([b"%d" % (i % 37) for i in range(400)]), 5)
    assert np.lib.stride_tricks.sliding_window_view(winnow(h, 6), 6).any(1).all()
    direct = word_hashes([b"a", b"b", b"c"])
    assert len(window_hashes(direct, 4)) == 0 and (window_hashes(direct, 1) == direct).all()


@pytest.mark.parametrize("k,pct", [(2, 80), (5, 80)])
def test_near_duplicates_match_brute_force(docs, texts, k, pct):
    got = minhash.near_duplicates(docs, k=k, pct=pct).collect()
    assert len(got) == len(texts)
    want = brute.near({d: t for d, t in texts if d is not None}, k, pct)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["component_id"] == r["doc_id"])
    assert any(not r["kept"] for r in got)


def test_near_duplicates_chain_and_large_group(spark):
    """A chain whose ends are no pair, and many near copies that share bands."""
    rnd = random.Random(1)
    base = ["b%d" % i for i in range(200)]
    rows = []
    for i in range(60):  # each link changes two more words
        w = list(base)
        for j in range(2 * i):
            w[(j * 3) % 200] = "c%d" % j
        rows.append((i, " ".join(w)))
    for i in range(60, 160):
        w = ["d%d" % j for j in range(150)]
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(150)] = "e%d" % rnd.randrange(1000)
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    assert got == {d: c for d, (_, c) in brute.near(dict(rows), 2, 80).items()}


def test_near_duplicates_empty_table(empty):
    assert minhash.near_duplicates(empty).collect() == []


def test_estimate_is_close():
    rnd = np.random.default_rng(0)
    common, a, b = (rnd.integers(0, 2**64, n, np.uint64) for n in (4000, 500, 500))
    sk = [minhash.registers(np.unique(np.concatenate([common, x]))) for x in (a, b)]
    est, n = minhash.estimate(sk[0], sk[1][None, :])
    assert abs(est[0] - 0.8) < 0.08 and n[0] == 512
    assert minhash.plausible(sk[0], sk[1][None, :], 0.8)[0]


def test_components_of_chains_stars_and_nothing(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links + [(None, 3), (7, 7)], "a long, b long")).collect()}
    nodes = {x for ab in links for x in ab if ab[0] != ab[1]}
    want = brute.components({x for ab in links for x in ab}, links)
    assert got == {n: want[n] for n in nodes}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def _vector_rows():
    rnd = np.random.default_rng(5)
    rows, nid = [], 0
    for label in (0, 1, None):
        centres = rnd.standard_normal((12, 32))
        for c in centres:
            for k in range(int(rnd.integers(1, 9))):
                v = c + 0.08 * rnd.standard_normal(32) * (k > 0)
                rows.append((nid, [float(x) for x in np.float32(v)], label))
                nid += 1
    rows += [(500, None, 0), (501, [0.0] * 32, 0), (502, [float("nan")] + [1.0] * 31, 0), (503, [None] + [1.0] * 31, 0), (504, [float("inf")] * 32, 1),
             (505, [], 1), (506, [1.0, 2.0], 1), (507, [1.0, 2.0], 1), (508, [2.0, 4.0], 1), (509, [-0.0, 1.0], 1), (510, [0.0, 1.0], 1), (None, [1.0, 2.0], 1)]
    return rows


def test_vectors_match_brute_force(spark):
    rows = _vector_rows()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links long, cls string").repartition(3)
    got = vectors.near_vectors(table).collect()
    fine = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v, lab in rows
            if i is not None and lab is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    label = {i: lab for i, _, lab in rows}
    links = [(a, b) for a in fine for b in fine if a < b and label[a] == label[b] and len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] >= 0.93]
    comp = brute.components([i for i, _, _ in rows if i is not None], links)
    assert len(got) == len(rows)
    missed = 0
    for r in got:
        i = r["vec_id"]
        if i is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, True)
            continue
        n = sum(i in ab for ab in links)
        assert r["n_links"] <= n
        missed += n - r["n_links"]
        if r["n_links"] == n:
            assert r["component_id"] == comp[i]
    assert len(links) > 50 and missed <= 0.02 * 2 * len(links)


def test_vectors_blocks_give_the_same(spark, monkeypatch):
    """Buckets dealt into several blocks find the same links, counted once."""
    table = spark.createDataFrame(_vector_rows(), "vec_id long, embedding array<float>, label int")
    one = sorted(map(tuple, vectors.near_vectors(table).collect()), key=str)
    monkeypatch.setattr(vectors, "BLOCK", 3)
    assert sorted(map(tuple, vectors.near_vectors(table).collect()), key=str) == one


def test_vectors_empty_table(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
