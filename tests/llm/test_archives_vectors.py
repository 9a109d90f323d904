"""Vector codes, whitening and the WARC archive against brute force and round trips."""

import base64
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import codes, common, warc, whitening

BAD = [(900, None, 0), (901, [None] + [1.0] * 31, 0), (902, [float("nan")] * 32, 1), (903, [float("inf")] + [0.0] * 31, None)]


def _rows(seed=3, n=150):
    rnd = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.float32(rnd.standard_normal(32) * rnd.choice([0.05, 1, 3]))], [0, 1, None][i % 3]) for i in range(n)]
    rows += [(5, rows[9][1], 1), (7, rows[7][1], 0), (None, rows[11][1], None), (None, [0.0] * 32, 2), (300, [1.0, -2.0], 2), (301, [], 2)]
    order = rnd.permutation(len(rows))
    return [rows[i] for i in order] + BAD


def _table(spark, rows):
    return spark.createDataFrame([(*r, "x", [1], 3) for r in rows], "vec_id long, embedding array<float>, label int, code string, x array<int>, error int").repartition(3)


def _whole(rows):
    return [(i, v, lab) for i, v, lab in rows if v is not None and None not in v and all(map(math.isfinite, v))]


def _brute_codes(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * x) for x in v] + [0] * (32 - len(v)), lab) for i, v, lab in _whole(rows)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1][:next((n for j, v, _ in _whole(rows) if j == r[0] for n in [len(v)]), 32)]))
    w = 32 // parts
    books = [[x[p * w:(p + 1) * w] for _, x, _ in kept[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            at = [nearest(x[p * w:(p + 1) * w], books[p])[1] for _, x, _ in kept]
            for k in range(len(books[p])):
                mine = [x[p * w:(p + 1) * w] for (_, x, _), a in zip(kept, at) if a == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    out, by = [], {}
    for i, x, lab in kept:
        best = [nearest(x[p * w:(p + 1) * w], books[p]) for p in range(parts)]
        out.append([i, "".join("%02x" % k for _, k in best), sum(e for e, _ in best), lab])
        by[lab] = by.get(lab, 0) + out[-1][2]
    text = ",".join(str(c) for book in books for e in book for c in e)
    return sorted(((i, c, e, by[lab]) for i, c, e, lab in out), key=str), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("parts,entries", [(16, 64), (2, 3), (16, 256)])
def test_codes_match_brute_force(spark, parts, entries):
    rows = _rows()
    coded, books = codes.compress(_table(spark, rows), parts=parts, entries=entries)
    want, digest = _brute_codes(rows, parts, entries, 2)
    assert sorted(map(tuple, coded.collect()), key=str) == want
    assert codes.digest(books) == digest


def test_codes_restore_to_the_error(spark):
    rows = _rows()
    coded, books = codes.compress(_table(spark, rows))
    ints = {i: [math.floor(256 * x) for x in v] for i, v, _ in _whole(rows) if i is not None and 10 <= i < 300}
    for r in codes.restore(coded, books).where("vec_id between 10 and 299").collect():
        assert sum((a - b) ** 2 for a, b in zip(ints[r["vec_id"]], r["approximate"])) == r["error"]


def test_codes_of_nothing(spark):
    for rows in ([], BAD):
        coded, books = codes.compress(_table(spark, rows))
        assert coded.collect() == [] and books.size == 0 and codes.digest(books) == hashlib.sha256(b"").hexdigest()
    coded, _ = codes.compress(_table(spark, [(1, [], 0), (2, [], None)]))
    assert sorted(map(tuple, coded.collect())) == [(1, "00" * 16, 0, 0), (2, "00" * 16, 0, 0)]


@pytest.mark.parametrize("top", [1, 3, 500, 1 << 40])
@pytest.mark.parametrize("width", [1, 2, 3, 4, 7, 16])
def test_nearest_is_exact_with_ties(width, top):
    rnd = np.random.default_rng(width)
    x, book = rnd.integers(-top, top + 1, (80, width)), rnd.integers(-top, top + 1, (13, width))
    book[9] = book[4]
    at, error = codes.nearest(x, book)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, e)), k) for k, e in enumerate(book)) for r in x]
    assert list(at) == [k for _, k in want] and [int(e) for e in error] == [d for d, _ in want]


def test_walsh_rows_are_in_sequency_order():
    m = codes.walsh(np.eye(16, dtype=np.int64))
    assert (m.T @ m == 16 * np.eye(16)).all()
    assert [(np.diff(m[:, j]) != 0).sum() for j in range(16)] == list(range(16))


def test_attach_keeps_every_row(spark):
    rows = spark.range(5000).selectExpr("id", "if(id < 3000, null, if(id < 4000, 'a', concat('k', id % 300))) k")
    per = common.materialize(rows.groupBy("k").agg(F.count("*").alias("c"), F.sum("id").alias("s")), "t")
    got = common.attach(rows, per, ["k"], "c", share=10)
    assert got.columns == ["id", "k", "s"] and got.count() == 5000
    assert got.where("k is null").select("s").distinct().collect()[0][0] == sum(range(3000))
    assert got.where("s is null").isEmpty()


@pytest.mark.parametrize("values", [
    [9, 7, 5, 3, 1, 0.5, 0.2, 0.1], [4, 4, 4, 2, 2, 1, 1, 1], [1e9, 1, 1, 1e-3, 1e-3, 0, 0, 0], [3] * 8, [0] * 8, [5, 1, 0, 0, 0, 0, 0, 0], [2 + 1e-9 * i for i in range(8)]])
def test_components_of_given_spectra(values):
    q, _ = np.linalg.qr(np.random.default_rng(2).standard_normal((8, 8)))
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    e, v = whitening.components(a, 8)
    want = [x for x in sorted(values, reverse=True) if x > 8 * whitening.EPS * sum(values)]
    assert np.allclose(e, want, rtol=1e-12, atol=1e-13 * max(1e-300, *values))
    assert np.allclose(v.T @ v, np.eye(len(e)), atol=1e-13)
    assert np.abs(a @ v - v * e).max(initial=0) <= 1e-13 * max(1e-300, *values) * 8
    three, _ = whitening.components(a, 3)
    assert np.allclose(three, e[:3])


def test_polar_factor():
    rnd = np.random.default_rng(4).standard_normal((20, 20))
    a = rnd + rnd.T
    u = whitening.polar(a)
    e, q = np.linalg.eigh(a)
    assert np.abs(u - q @ np.diag(np.sign(e)) @ q.T).max() < 1e-12


def test_whitening_matches_numpy(spark):
    rows = _rows()
    got = whitening.whiten(_table(spark, rows)).toPandas()
    kept = _whole(rows)
    x = np.array([[math.floor(1024 * c) + 100000 for c in [*v, *[0.0] * (32 - len(v))]] for _, v, _ in kept], np.int64)
    n, centred = len(x), x - x.mean(0)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    assert len(got) == 8 * n and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    dev = ((n * x - x.sum(0)) ** 2).sum(1)
    for j in range(8):
        mine = got[got.component == j + 1]
        w = centred @ v[:, j] / math.sqrt(e[j])
        w *= np.sign(v[np.abs(v[:, j]).argmax(), j])
        assert np.allclose(mine.explained, e[j] / e.sum(), rtol=1e-10)
        assert sorted(zip(map(int, mine.deviation), np.round(mine.whitened, 7) + 0.0)) == sorted(zip(map(int, dev), np.round(w, 7) + 0.0))


def test_whitening_of_little(spark):
    assert whitening.whiten(_table(spark, BAD)).collect() == []
    assert whitening.whiten(_table(spark, [])).collect() == []
    assert whitening.whiten(_table(spark, [(1, [1.0, 2.0], 0)] * 3)).collect() == []  # nothing varies
    got = whitening.whiten(_table(spark, [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (None, [3.0, 0.0], 0)])).collect()
    assert sorted((r["component"], r["n"], int(r["deviation"]), round(r["whitened"], 6), r["explained"]) for r in got) == [
        (1, 3, 0, 0.0, 1.0), (1, 3, 3072 ** 2, -1.224745, 1.0), (1, 3, 3072 ** 2, 1.224745, 1.0)]


def test_whitening_beyond_64_bits():
    y = np.array([[1 << 33, 3], [1 << 32, -5]], np.int64)
    assert whitening.product(y).tolist() == [[(1 << 66) + (1 << 64), 3 * (1 << 33) - 5 * (1 << 32)], [3 * (1 << 33) - 5 * (1 << 32), 34]]


PAGES = [(4, "u4", "<p>one</p>"), (2, "u2", "<p>one</p>"), (9, "u9", "<p>one</p>"), (1, "u1", None), (3, None, ""), (5, "a\r\nb", "x\r\n\r\ny WARC/1.1\r\n"),
         (6, "u6", "é😀" * 40_000), (None, "n", "<p>one</p>"), (None, "n", "alone"), (7, "u7", "twice"), (7, "u7", "twice"), (8, "u8", " "), (-3, "neg", "twice")]


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "c", b"p", 1) for r in rows], "page_id long, url string, html string, sha256 string, payload binary, type int").repartition(2)


def _brute_archive(rows, min_bytes=0):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        ids = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        first = min(ids) if ids and len(b) >= min_bytes else None
        revisit = first is not None and i != first
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 5, 6])
def test_archive_matches_brute_force(spark, min_bytes):
    folder = warc.archive_folder(spark)
    warc.write_pages(_pages(spark, PAGES), folder, min_bytes=min_bytes)
    got = warc.read_digests(spark, folder)
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == _brute_archive(PAGES, min_bytes)
    assert got.where("payload_digest <> stored_digest").isEmpty()
    assert spark.read.parquet(folder + "/payloads").count() == len({h or "" for _, _, h in PAGES})


def test_archive_of_nothing(spark):
    folder = warc.archive_folder(spark)
    warc.write_pages(_pages(spark, []), folder)
    assert warc.read_digests(spark, folder).collect() == [] and warc.read_records(spark, folder).collect() == []


def test_records_are_exact_and_files_give_them_back(spark):
    folder = warc.archive_folder(spark)
    warc.write_pages(_pages(spark, PAGES), folder)
    records = warc.read_records(spark, folder)
    bodies = {r["page_id"]: bytes(r["payload"]) for r in records.collect() if r["page_id"] is not None}
    assert bodies == {i: (h or "").encode() for i, _, h in PAGES if i is not None}
    for r in records.collect():
        head, record = bytes(r["header"]), bytes(r["record"])
        outer, inner = head.split(b"\r\n\r\n", 1)
        length = int(outer.rsplit(b"Content-Length: ", 1)[1])
        assert record.startswith(head) and record.endswith(b"\r\n\r\n") and len(record) == len(outer) + 4 + length + 4
        assert (r["record_type"] == "revisit") == (b"WARC-Refers-To: " in outer)
    for compression in ("gzip", None):
        files, again = warc.archive_folder(spark), warc.archive_folder(spark)
        warc.export_files(records, files, compression, per_file=4)
        warc.import_files(spark, files + "/part-*", again)
        back = warc.read_records(spark, again)
        assert sorted(bytes(r["record"]) for r in back.collect()) == sorted(bytes(r["record"]) for r in records.collect())


def test_damage_is_found(spark):
    folder, bad = warc.archive_folder(spark), warc.archive_folder(spark)
    warc.write_pages(_pages(spark, PAGES), folder)
    (spark.read.parquet(folder + "/payloads").withColumn("payload", F.when(F.octet_length("payload") == 1, F.lit(b"?")).otherwise(F.col("payload")))
     .write.parquet(bad + "/payloads"))
    spark.read.parquet(folder + "/records").write.parquet(bad + "/records")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_records(spark, bad).collect()
    with pytest.raises(ValueError, match="no whole WARC record"):
        list(warc.split_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"))
    assert list(warc.split_records(b"")) == []
