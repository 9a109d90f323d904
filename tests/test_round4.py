"""Round 4: work done a row, a block or a part at a time."""

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import text_encoder as te


def test_encoder_sends_no_vocabulary_through_the_driver(spark, tmp_path, monkeypatch):
    """No word is broadcast; words in groups and blocks of any size give the same vectors; texts of one id count as one."""
    texts = [(i, " ".join("w%d" % j for j in np.random.default_rng(i).integers(0, 60, 30))) for i in range(80)]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(3)
    te.fit_encoder(docs, str(tmp_path / "a"), width=6)
    monkeypatch.setattr(te, "GROUP_WORDS", 40)
    monkeypatch.setattr(te, "BLOCK_ENTRIES", 100)
    monkeypatch.setattr(te, "TEXTS_AT_ONCE", 3)
    halves = [(i, " ".join(t.split()[k::2])) for i, t in texts for k in (0, 1)]
    twice = spark.createDataFrame(halves, "id long, text string")
    monkeypatch.setattr(te.F, "broadcast", lambda df: (_ for _ in ()).throw(AssertionError("broadcast")))
    groups, plain = [], te._matrix
    monkeypatch.setattr(te, "_matrix", lambda *a: groups.append(plain(*a)) or groups[-1])
    one = {r["id"]: np.array(r["embedding"]) for r in te.encode_texts(docs, str(tmp_path / "a")).collect()}
    two = te.encode_texts(twice, str(tmp_path / "a")).collect()
    assert len(two) == 160 and all(np.allclose(r["embedding"], one[r["id"]], atol=1e-6) for r in two)
    assert all(g[1] > 1 for g in groups)


def test_encoder_of_texts_without_common_words(spark, tmp_path):
    """no word in two texts, an empty table, and ids of strings."""
    docs = spark.createDataFrame([("a", "x y"), ("b", "z"), ("c", None)], "id string, text string")
    te.fit_encoder(docs, str(tmp_path / "e"), width=4)
    out = te.encode_texts(docs, str(tmp_path / "e")).collect()
    assert sorted(r["id"] for r in out) == ["a", "b", "c"] and not any(np.any(r["embedding"]) for r in out)
    assert te.encode_texts(docs.where(F.lit(False)), str(tmp_path / "e")).isEmpty()


def _left(spark, name):
    import glob

    from quarry.session import checkpoint_dir
    return {f.rsplit("/", 2)[-2] if "=" not in f else f.rsplit("/", 3)[-3] for f in glob.glob(checkpoint_dir(spark).removeprefix("file://") + f"/{name}*/**/*.parquet", recursive=True)}


def test_map_leaves_no_table_of_a_step(spark, monkeypatch):
    """Points move in parts; edges, hits and the places of former epochs do not stay on disk."""
    from quarry.operators import layout
    from quarry.operators import topics as tp
    rnd = np.random.default_rng(3)
    centres = rnd.standard_normal((8, 20)) * 3
    v = np.float32(centres[np.arange(160) % 8] + rnd.standard_normal((160, 20)))
    c = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(layout, "EXACT_ROWS", 100)
    monkeypatch.setattr(layout, "PART_ROWS", 60)
    linear, before = tp.project_2d(c).cache(), _left(spark, "layout-")
    places = layout.project_neighbours(c, linear, k=8, epochs=12)
    left = _left(spark, "layout-") - before
    assert [x.rsplit("-", 1)[0] for x in left - {"model"}] == ["layout-pos"]  # and the index's centres
    assert places.count() == places.select("id").distinct().count() == 160
    assert layout.neighbours_kept(c, places) > layout.neighbours_kept(c, linear)


def test_search_in_parts_finds_what_one_search_finds(spark, tmp_path):
    """Queries one part after the other."""
    from quarry.operators import vector_index as vi
    rnd = np.random.default_rng(4)
    c = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rnd.standard_normal((300, 8)))], "id long, embedding array<double>").repartition(3)
    index = vi.build(c, str(tmp_path / "i"), cells=6)
    q = c.selectExpr("id as query_id", "embedding as vector")
    one = {tuple(r) for r in vi.search_index(q, index, 5).select("query_id", "id", "score", "rank").collect()}
    parts = vi.search_in_parts(q, index, 5, str(tmp_path / "h"), rows=100)
    assert {tuple(r) for r in parts.select("query_id", "id", "score", "rank").collect()} == one and len(one) == 1500


def test_index_written_in_parts_is_the_same(spark, tmp_path, monkeypatch):
    """The postings of a part of the documents at a time; repeated ids come together."""
    from quarry.operators import text_index as ti
    rows = [(i, " ".join("w%d" % j for j in np.random.default_rng(i).integers(0, 40, 12))) for i in range(60)]
    docs = spark.createDataFrame([*rows, (3, rows[3][1]), (61, None)], "id long, text string")
    ti.append(docs, str(tmp_path / "one"))
    jobs, plain = [], ti._row_postings
    monkeypatch.setattr(ti, "_row_postings", lambda toks: jobs.append(1) or plain(toks))
    monkeypatch.setattr(ti, "PART_DOCS", 20)
    ti.append(docs, str(tmp_path / "parts"))
    got = [sorted((r["term"], r["id"], r["dl"], r["tf"], tuple(r["positions"])) for r in ti.postings(spark, str(tmp_path / f)).collect()) for f in ("one", "parts")]
    assert got[0] == got[1] and len(jobs) == 4
    qs = spark.createDataFrame([(1, "w1 w2"), (2, "w3 w3 w9 none")], "query_id long, query string")
    best = ti.bm25_from_index(qs, str(tmp_path / "one"), 7).collect()  # in parts
    monkeypatch.setattr(ti, "PART_DOCS", 10_000)
    assert sorted(map(tuple, best)) == sorted(map(tuple, ti.bm25_from_index(qs, str(tmp_path / "one"), 7).collect())) and len(best) == 14
