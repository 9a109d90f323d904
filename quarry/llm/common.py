"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.io import scratch_path

__all__ = ["id_text", "materialize", "connected_components", "small_batches", "integer_vectors", "integer_matrix", "attach"]


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id (long) and the text (string; null stays null), under the fixed names ``_id`` and
    ``_text``: other columns of ``df``, however they are called, cannot clash with an operator's own."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("_id"),
                     F.col(f"`{text_col}`").cast("string").alias("_text"))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet (zstd: hashes, ids and words are most of it) under the shared folder and
    read back: cuts lineage and lets several steps share one computation."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "_text", max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``max_bytes`` of ``column`` (a longer value is alone), so that a
    task's memory follows bytes, not rows."""
    for b in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0), np.int64))
        start = 0
        while start < b.num_rows:
            before = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, before + max_bytes, "right")))
            yield b.slice(start, stop - start)
            start = stop


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long), component = smallest node reachable.

    Hook and contract: every node points to its smallest neighbour (a grouped minimum, combined
    map-side, so a hub with a third of all links is no hot group), pointers are doubled until every one
    reaches a root, links are renamed to roots, loops and repeats go, and the rest starts again. Each
    round at least halves the nodes that still have links, so rounds are logarithmic even for long
    chains. Every step is a written table in the shared folder; nothing is collected.
    Null ends and self links are ignored; empty input gives an empty table."""
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = materialize(e.where("a is not null and b is not null and a <> b")
                    .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-e")
    labels, step = None, 0
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        ptr = materialize(both.groupBy("a").agg(F.min("b").alias("m"))
                          .select(F.col("a").alias("n"), F.least("a", "m").alias("p")), f"{name}-{step}-p")
        while True:
            up = ptr.select(F.col("n").alias("p"), F.col("p").alias("q"))
            nxt = materialize(ptr.join(up, "p", "left")
                              .select("n", F.coalesce("q", "p").alias("p"),
                                      (F.col("q") != F.col("p")).alias("moved")), f"{name}-{step}-j")
            moved = not nxt.where("moved").isEmpty()
            ptr = nxt.select("n", "p")
            if not moved:
                break
        if labels is None:
            labels = ptr.select(F.col("n").alias("node"), F.col("p").alias("component"))
        else:
            labels = materialize(
                labels.join(ptr.select(F.col("n").alias("component"), "p"), "component", "left")
                .select("node", F.coalesce("p", "component").alias("component")), f"{name}-{step}-l")
        pa, pb = ptr.select(F.col("n").alias("a"), F.col("p").alias("pa")), ptr.select(F.col("n").alias("b"), F.col("p").alias("pb"))
        e = materialize(e.join(pa, "a").join(pb, "b").where("pa <> pb")
                        .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"{name}-{step}-e")
        step += 1
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int, *more) -> DataFrame:
    """(``_id``, ``x``: floor(scale * component) + shift as longs, ...) of the rows whose vector is not null and
    holds no null or non-finite component; other columns only as given in ``more``."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (vectors.where(F.col(f"`{vector_col}`").isNotNull() & ~odd)
            .select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.transform(v, lambda c: F.floor(c * F.lit(float(scale))) + F.lit(shift)).alias("x"), *more))


def integer_matrix(column: pa.Array, width: int, fill: int = 0) -> np.ndarray:
    """The lists of longs as rows of one matrix; shorter lists are filled up."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    flat = np.asarray(column.flatten(), np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.full((len(sizes), width), fill, np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def attach(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str, share: int = 1024) -> DataFrame:
    """``rows`` left-joined, null-safe, with ``per_key``: one written row per key, ``count`` its number of rows in
    ``rows``. Keys with more than 1/``share`` of all rows, fewer than ``share`` by this rule, are broadcast, so
    that their rows stay where they are; the others meet by a shuffle in which none is hot."""
    total = per_key.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > total // share
    other = per_key.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in per_key.columns if c not in (*keys, count)], hot.alias("_hot"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    few, rest = F.broadcast(other.where("_hot").drop("_hot")), other.where("not _hot").drop("_hot")
    out = rows.join(few, on).unionByName(rows.join(few, on, "left_anti").join(rest, on, "left"))
    return out.drop(*[f"_k_{k}" for k in keys])
