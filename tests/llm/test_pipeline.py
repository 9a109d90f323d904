import collections

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quarry.llm import secrets


@pytest.fixture(scope="module")
def small(spark, texts):
    rows = [(d, t, "en", "src0", len(t or "")) for d, t in texts] + [
        (3000, "some clean words here and then password=hunter2222 and ten more words follow it for sure", "en", "s", 90)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark, small):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "minhash_near_dedup", "substring_dedup", "secret_scan", "best_fit_packing"]
    docs = stages["quality_rules"](spark, small, "").cache()
    assert docs.columns == small.columns
    kept = rows_of(docs)
    bad = [d for d, t in kept if (c := brute.counts(t))[0] < 10 or 100 * c[4] > 20 * c[0]]
    assert not bad and len(kept) > 50

    near = stages["minhash_near_dedup"](spark, docs, "").cache()
    want = brute.near({d: t for d, t in kept if d is not None}, 5, 80)
    assert sorted(map(str, rows_of(near))) == sorted(str((d, t)) for d, t in kept if d is None or want[d][1] == d)

    cut = stages["substring_dedup"](spark, near, "").cache()
    left = [(d, t, *x) for (d, t), x in zip(rows_of(near), brute.strike(rows_of(near), 50))]
    assert any(x[3] for x in left)
    assert sorted(map(str, rows_of(cut))) == sorted(str((d, t if not gone else " ".join(ws))) for d, t, n, gone, ws in left if ws)
    assert cut.where(F.col("n_chars") != F.char_length("text")).count() == 0

    clean = stages["secret_scan"](spark, cut, "").cache()
    assert clean.columns == small.columns and clean.count() == cut.count()
    text = {d: t for d, t in rows_of(clean)}
    assert text[3000].split(" and ")[1].startswith("then [SECRET]") and "hunter" not in text[3000]
    assert all(not secrets.base_spans(t) for t in text.values())

    packed = stages["best_fit_packing"](spark, clean, "").collect()
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == collections.Counter(d for d, _ in rows_of(clean))


def test_rows_without_id_and_of_repeated_ids(spark, texts):
    stages = dict(corpus_pipeline.STAGES)
    long = [t for d, t in texts if d is not None and len(brute.words(t)) >= 100][:6]
    a, b, c = ("%s %s" % (w, t) for w, t in zip(("alpha", "beta", "gamma"), long))
    passage = " ".join("p%d" % i for i in range(60))
    table = lambda rows: spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = lambda name, rows: sorted(rows_of(stages[name](spark, table(rows), "")), key=str)
    alone = out("quality_rules", [(i, x) for i, x in enumerate((a, b, c))])
    clean = [t for _, t in alone]
    assert len(clean) >= 2
    # a rejected row takes no other of its id along
    rows = [(None, x) for x in clean] + [(7, clean[0])]
    assert out("quality_rules", [*rows, (None, None), (None, "few words"), (7, "")]) == sorted(rows, key=str)
    # one row of each near-duplicate: repeats of a row, copies without id, texts of one id
    rows = [(None, a), (None, a), (None, b), (5, a), (5, a), (5, c), (9, c), (None, b + " end")]
    got = out("minhash_near_dedup", rows)
    assert sorted(x[1].split()[0] for x in got) == ["alpha", "beta", "gamma"] and (5, a) in got
    assert [d for d, t in got if t.startswith("beta")] == [None]
    # passages go from rows without id, and from the second text of an id
    got = out("substring_dedup", [(1, "one " + passage), (None, "null " + passage), (2, "two " + passage), (2, "too " + passage)])
    assert sorted(t for _, t in got) == sorted(["one " + passage, "null", "two", "too"])
    got = out("substring_dedup", [(2, "two " + passage), (2, "too " + passage)])
    assert sorted(len(t.split()) for _, t in got) == [1, 61]


def test_stages_on_nothing(spark, small):
    docs = small.where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.collect() == []


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


CLASHES = ["_id", "_key", "key", "row", "_new", "_first", "first", "last", "_last", "_hash", "id", "found", "text_hash", "kept_text", "kept", "_text", "value"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_clashing_columns_and_odd_rows(spark, name, stage):
    words = " ".join("word%d" % (i % 97) for i in range(300))
    other = " ".join("thing%d and" % i for i in range(60))
    rows = [(1, words), (1, words), (1, other), (2, None), (3, ""), (None, other), (None, None), (4, words + " more"), (5, other * 400),
            (6, "the password = \"hunter22xyz\" is here, with enough other words around it to pass every rule of the first stage")]
    full = [(d, t, "en", None, len(t or ""), *["x%d" % i for i in range(len(CLASHES))]) for d, t in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))
    got = stage(spark, docs, "")
    assert got.schema.names == docs.schema.names
    for r in got.collect():
        assert [r[c] for c in CLASHES] == ["x%d" % i for i in range(len(CLASHES))] and r["n_chars"] == len(r["text"] or "")
    assert stage(spark, docs.where("false"), "").collect() == []
    plain = stage(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), "")
    assert sorted(map(str, plain.collect())) == sorted(map(str, got.select(*plain.columns).collect()))
