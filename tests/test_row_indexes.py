"""Inverted indexes of texts, row by row."""

from pyspark.sql import functions as F

from quarry.sources import io as sio


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_inverted_index_shuffles_no_words(spark):
    """A row's map comes from the row alone; ids that repeat, null ids and null texts as before."""
    rows = [(1, "b a b  a"), (2, ""), (3, None), (4, " x "), (None, "n n")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    out = sio.inverted_index(df, "text", out="m")
    assert _exchanges(out) == _exchanges(df)
    got = {r["id"]: r["m"] for r in out.collect()}
    assert got == {1: {"b": [0, 2], "a": [1, 4], "": [3]}, 2: {"": [0]}, 3: None, 4: {"": [0, 2], "x": [1]}, None: None}
    assert out.where("id = 1").select(F.map_keys("m").alias("w")).first()["w"] == ["b", "a", ""]
    more = spark.createDataFrame([*rows, (1, "c b"), (5, None), (5, "y")], "id long, text string")
    both = sio.inverted_index(more, "text", out="m").collect()
    assert [r["m"] for r in both if r["id"] == 1] == [{"b": [0, 1, 2], "c": [0], "a": [1, 4], "": [3]}] * 2
    assert [r["m"] for r in both if r["id"] == 5] == [{"y": [0]}] * 2
    assert len(both) == len(rows) + 3 and {r["id"]: r["m"] for r in both}[4] == got[4]


def test_rows_of_several_slices(spark):
    """A batch of more rows than are sorted at once, with letters of several bytes and nulls."""
    texts = [None if i % 7 == 3 else " ".join("дело%d" % (i * j % 11) for j in range(i % 9)) for i in range(1500)]
    df = spark.createDataFrame([*enumerate(texts)], "id long, text string").coalesce(1)
    got = {r["id"]: r["m"] for r in sio.inverted_index(df, "text", out="m").collect()}
    for i, t in enumerate(texts):
        want = None if t is None else {}
        for p, w in enumerate(t.split(" ") if t is not None else []):
            want.setdefault(w, []).append(p)
        assert got[i] == want
