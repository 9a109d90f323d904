"""Removal of passages that an earlier document already has, by level-wise doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_text, materialize, small_batches
from quarry.llm.hashing import WINDOWS_64, mix, window_hashes, winnow, word_hashes, words


def _sha(ws: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(ws)).digest()


def _longs(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(arrays: list, kind) -> pa.Array:
    """A pyarrow list column of numpy arrays."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def _base_level(src: DataFrame, window: int) -> DataFrame:
    """Per row: number of words, digest, and the hashes of its chosen windows of half the length.

    Of each ``window // 2 + 1`` consecutive half-length windows the one with the smallest hash is chosen. Any
    two equal windows of the full length hold the same choice, so no repeat is missed."""
    half = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            n, sha, chosen = [], [], []
            for t in b.column("_text").to_pylist():
                ws = words(t)
                n.append(len(ws))
                sha.append(_sha(ws))
                if len(ws) < window:
                    chosen.append(np.zeros(0, np.int64))
                    continue
                h = window_hashes(word_hashes(ws), half)
                chosen.append(_longs(np.unique(h[winnow(h, window - half + 1)])))
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("key"), pa.array(n, pa.int64()), pa.array(sha, pa.binary()),
                                              _lists(chosen, pa.int64())], ["_id", "key", "n", "sha", "chosen"])

    return src.withColumn("key", F.xxhash64("_text")).mapInArrow(run, "_id long, key long, n long, sha binary, chosen array<long>")


def _repeated(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Keys found in at least two documents, and the smallest one (grouped, combined map-side).

    A written table: joined back as it is, both sides of the join are plain exchanges, whose hot
    partitions adaptive execution can split."""
    return materialize(rows.groupBy(*keys).agg(F.min("_id").alias("first"), F.max("_id").alias("last"))
                       .where("first < last").drop("last"), f"{name}-repeated")


def _windows_around(cand: DataFrame, window: int) -> DataFrame:
    """Full-length windows that hold a repeated chosen half-length window, two hashes each."""
    half = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            ids, shas, starts, h1, h2 = [], [], [], [], []
            hits = b.column("hits")
            for i, (doc, t, sha) in enumerate(zip(b.column("_id").to_pylist(), b.column("_text").to_pylist(), b.column("sha").to_pylist())):
                ws = words(t)
                if len(ws) < window or _sha(ws) != sha:
                    continue  # another text under the same id
                wh = word_hashes(ws)
                h = window_hashes(wh, half)
                at = np.flatnonzero(winnow(h, window - half + 1) & np.isin(h, np.asarray(hits[i].values).view(np.uint64)))
                mark = np.zeros(len(ws) + 1, np.int64)
                np.add.at(mark, np.maximum(at - (window - half), 0), 1)
                np.add.at(mark, at + 1, -1)
                s = np.flatnonzero(np.cumsum(mark)[:len(ws) - window + 1] > 0)
                ids.append(doc)
                shas.append(sha)
                starts.append(s.astype(np.int32))
                h1.append(_longs(window_hashes(wh, window)[s]))
                h2.append(_longs(window_hashes(wh ^ WINDOWS_64, window)[s]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shas, pa.binary()), _lists(starts, pa.int32()),
                                              _lists(h1, pa.int64()), _lists(h2, pa.int64())], ["_id", "sha", "start", "h1", "h2"])

    return cand.mapInArrow(run, "_id long, sha binary, start array<int>, h1 array<long>, h2 array<long>")


def _doubled(survivors: DataFrame, length: int) -> DataFrame:
    """Windows of twice the length whose two halves both survived, per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, h1, h2 = [], [], []
            for i in range(b.num_rows):
                v = b.column("w")[i].values
                s = np.asarray(v.field("start")).astype(np.int64)
                order = np.argsort(s)
                s = s[order]
                a, c = (np.asarray(v.field(k)).view(np.uint64)[order] for k in ("h1", "h2"))
                j = np.minimum(np.searchsorted(s, s + length), len(s) - 1)
                ok = s[j] == s + length
                starts.append(s[ok].astype(np.int32))
                h1.append(_longs(mix(a[ok], a[j[ok]])))
                h2.append(_longs(mix(c[ok], c[j[ok]])))
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("sha"), _lists(starts, pa.int32()),
                                              _lists(h1, pa.int64()), _lists(h2, pa.int64())], ["_id", "sha", "start", "h1", "h2"])

    per_doc = survivors.groupBy("_id", "sha").agg(F.collect_list(F.struct("start", "h1", "h2")).alias("w")).where("size(w) > 1")
    return per_doc.mapInArrow(run, "_id long, sha binary, start array<int>, h1 array<long>, h2 array<long>")


def _strike(docs: DataFrame, window: int) -> DataFrame:
    """Per document with covered windows: words removed and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            ids, shas, removed, kept_sha, kept = [], [], [], [], []
            for i, (doc, t, sha) in enumerate(zip(b.column("_id").to_pylist(), b.column("_text").to_pylist(), b.column("sha").to_pylist())):
                ws = words(t)
                if _sha(ws) != sha:
                    continue
                s = np.asarray(b.column("covered")[i].values)
                mark = np.zeros(len(ws) + 1, np.int64)
                np.add.at(mark, s, 1)
                np.add.at(mark, s + window, -1)
                gone = np.cumsum(mark)[:-1] > 0
                left = [w for w, g in zip(ws, gone.tolist()) if not g]
                ids.append(doc)
                shas.append(sha)
                removed.append(int(gone.sum()))
                kept_sha.append(_sha(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shas, pa.binary()), pa.array(removed, pa.int64()),
                                              pa.array(kept_sha, pa.binary()), pa.array(kept, pa.string())],
                                             ["_id", "sha", "n_removed", "kept_sha", "kept"])

    return docs.mapInArrow(run, "_id long, sha binary, n_removed long, kept_sha binary, kept string")


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = True, longest: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, longest_repeat[, kept_text, text_hash]) for every row of ``docs``.

    Words are maximal runs of characters other than space and \\x09-\\x0D. A word goes if a window of
    ``window`` words that covers it also starts in a document with a smaller id; windows are judged on the
    input. Level-wise doubling: windows of half the length that start in two documents or more are the
    candidates, those alone are extended to the full length, what is repeated there to twice that length,
    and so on until no candidate survives. The full length decides what goes; the further levels give
    ``longest_repeat``, the largest length ``window * 2**k`` at which the document shares a window (0: none;
    left out without ``longest``). ``kept_text`` (null where nothing goes: the text stays as it is) is the
    words kept, joined by one space; it comes with ``with_text``, and so does ``text_hash``, xxhash64 of the
    row's text, to join it back.

    Scale: the lowest level keeps about two of every ``window // 2 + 2`` windows (chosen by smallest hash,
    without loss); documents of the same words are one until the end, so groups of exact copies cost one
    document; every group-by over windows is combined map-side and joined back with splittable joins, so a
    passage of a third of all documents is no hot group; levels are written tables. Hashes that decide have
    128 bits. Rows of one document stay bounded by that document.

    A null or empty text has no words. A null id neither strikes nor is struck. Rows with the same id are
    one document: they do not strike each other, each gets its own row. Other columns are ignored. An empty
    table gives an empty table."""
    spark = docs.sparkSession
    src = id_text(docs, id_col, text_col)
    base = materialize(_base_level(src, window), "substring-base")
    firsts = base.where(f"n >= {window} and _id is not null").groupBy("sha").agg(F.min("_id").alias("rep"), F.max("_id").alias("last"))
    base_rep = base.join(firsts, "sha", "left")

    chosen = (firsts.select("sha", F.col("rep").alias("_id")).join(base.select("sha", "_id", "chosen"), ["sha", "_id"])
              .select("_id", "sha", F.explode("chosen").alias("h")))
    chosen = materialize(chosen, "substring-chosen")
    hits = (chosen.join(_repeated(chosen, ["h"], "substring-chosen").select("h"), "h")
            .groupBy("_id", "sha").agg(F.collect_set("h").alias("hits")))
    cand = materialize(src.join(hits, "_id"), "substring-candidates")

    wide = materialize(_windows_around(cand, window).select("_id", "sha", F.explode(F.arrays_zip("start", "h1", "h2")).alias("w"))
                       .select("_id", "sha", "w.*"), "substring-windows")
    survivors = materialize(wide.join(_repeated(wide, ["h1", "h2"], "substring-windows"), ["h1", "h2"]), "substring-survivors")
    covered = survivors.where("_id > first").groupBy("_id", "sha").agg(F.collect_set("start").alias("covered"))
    struck = _strike(cand.select("_id", "_text", "sha").join(covered, ["_id", "sha"]), window).dropDuplicates(["_id", "sha"])

    out = base_rep.join(struck, ["_id", "sha"], "left")
    whole_copy = F.col("rep") < F.col("_id")
    cols = [F.col("_id").alias(id_col), F.col("n").alias("n_words"),
            F.when(whole_copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.lower(F.when(whole_copy, F.sha2(F.lit(""), 256)).otherwise(F.hex(F.coalesce("kept_sha", "sha")))).alias("kept_sha256")]
    if longest:
        length, level, tables = window, survivors, []
        while not level.isEmpty():
            tables.append(level.select("sha").distinct().select("sha", F.lit(length).alias("reach")))
            rows = (_doubled(level.select("_id", "sha", "start", "h1", "h2"), length)
                    .select("_id", "sha", F.explode(F.arrays_zip("start", "h1", "h2")).alias("w")).select("_id", "sha", "w.*"))
            rows = materialize(rows, f"substring-{length}")
            level = materialize(rows.join(_repeated(rows, ["h1", "h2"], f"substring-{length}"), ["h1", "h2"]), f"substring-{length}-kept")
            length *= 2
        if tables:
            reach = tables[0]
            for t in tables[1:]:
                reach = reach.union(t)
            out = out.join(reach.groupBy("sha").agg(F.max("reach").alias("reach")), "sha", "left")
        else:
            out = out.withColumn("reach", F.lit(None).cast("int"))
        # documents of the same words share all that they have
        whole = F.lit(window) * F.pow(F.lit(2.0), F.floor(F.log2(F.col("n") / F.lit(window)))).cast("int")
        cols.append(F.coalesce(F.when(F.col("_id").isNotNull() & (F.col("rep") < F.col("last")), whole), F.col("reach"), F.lit(0)).cast("long").alias("longest_repeat"))
    if with_text:
        cols += [F.when(whole_copy, F.lit("")).otherwise(F.col("kept")).alias("kept_text"), F.col("key").alias("text_hash")]
    return out.select(*cols)
