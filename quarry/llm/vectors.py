"""Near-duplicate vectors by random-hyperplane signs in several tables and exact cosine verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import attach, connected_components, materialize

MISS = 0.001   # chance that a pair right at the threshold shares a bucket in no table; it sets the number of tables
BUCKET = 4     # rows of a label per bucket, if directions were even; it sets the number of hyperplanes
MIN_BITS, MAX_BITS = 6, 24
BLOCK = 1024   # members of a bucket that one task compares with as many others
SMALL = 48     # buckets of up to so many rows are compared together, pair by pair
PAIRS = 50_000  # pairs of small buckets compared at a time


def tables_for(bits: int, threshold: float, miss: float = MISS) -> int:
    """Tables of ``bits`` hyperplanes so that a pair at ``threshold`` shares no bucket with a chance of at most ``miss``:
    one hyperplane leaves it on one side with the chance 1 - angle / pi."""
    same = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-same))) if same < 1 else 1


def planes(width: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((width, bits * tables))


def signs(unit: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """(vectors, tables) bucket numbers: the signs against the table's hyperplanes, as bits."""
    on = (unit @ planes(unit.shape[1], bits, tables, seed) > 0).reshape(len(unit), tables, bits)
    return (on * (1 << np.arange(bits))).sum(2).astype(np.int32)


def _unit_rows(column: pa.ChunkedArray, at: np.ndarray) -> np.ndarray:
    own = column.take(pa.array(at)).combine_chunks()
    v = np.asarray(own.flatten(), np.float64).reshape(len(at), -1)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _links(table: pa.Table, starts: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links among the rows of each bucket (rows from one of ``starts`` to the next): per row that has any
    (cls, rep, smallest rep reachable inside the bucket, number of other rows linked)."""
    n = table.num_rows
    t, own, x, y, rep, size = (np.asarray(table.column(c)) for c in ("t", "own", "x", "y", "rep", "size"))
    ends = np.r_[starts[1:], n]
    widths = np.asarray(table.column("v").combine_chunks().value_lengths())
    sigs = table.column("sig").combine_chunks()
    offsets, flat = np.asarray(sigs.offsets) - int(np.asarray(sigs.offsets)[0]), np.asarray(sigs.flatten())
    links, low = np.zeros(n, np.int64), rep.copy()

    def new(a: int, b: int) -> bool:  # no earlier table has the pair
        k = int(t[a])
        return not (flat[offsets[a]:offsets[a] + k] == flat[offsets[b]:offsets[b] + k]).any()

    def settle(a: np.ndarray, b: np.ndarray) -> None:  # a pair of rows each
        np.add.at(links, a, size[b])
        np.add.at(links, b, size[a])
        while True:
            before = low.copy()
            np.minimum.at(low, a, before[b])
            np.minimum.at(low, b, before[a])
            if (low == before).all():
                return

    small = ends - starts <= SMALL
    todo = np.flatnonzero(small)
    while len(todo):  # small buckets of one width, as many as make PAIRS pairs
        w = widths[starts[todo[0]]]
        same = todo[widths[starts[todo]] == w]
        m = (ends - starts)[same]
        same = same[:max(1, int(np.searchsorted(np.cumsum(m * (m - 1) // 2), PAIRS, "right")))]
        todo = todo[~np.isin(todo, same)]
        rows = np.concatenate([np.arange(starts[g], ends[g]) for g in same])
        after = np.repeat(ends[same], (ends - starts)[same]) - rows - 1
        a = np.repeat(rows, after)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after)
        on = (x[a] == y[a]) | (own[a] != own[b])
        a, b = a[on], b[on]
        if not len(a):
            continue
        v = _unit_rows(table.column("v"), rows)
        place = np.zeros(n, np.int64)
        place[rows] = np.arange(len(rows))
        near = np.einsum("ij,ij->i", v[place[a]], v[place[b]]) >= threshold
        a, b = a[near], b[near]
        fresh = np.array([new(i, j) for i, j in zip(a, b)], bool)
        if fresh.any():
            settle(a[fresh], b[fresh])
    for g in np.flatnonzero(~small):
        rows = np.arange(starts[g], ends[g])
        v = _unit_rows(table.column("v"), rows)
        left = np.flatnonzero(own[rows] == x[rows[0]])
        right = left if x[rows[0]] == y[rows[0]] else np.flatnonzero(own[rows] == y[rows[0]])
        near = v[left] @ v[right].T >= threshold
        if right is left:
            near = np.triu(near, 1)
        k = int(t[rows[0]])
        s = np.stack([flat[offsets[i]:offsets[i] + k] for i in rows]) if k else np.zeros((len(rows), 0), np.int32)
        for u in range(k):
            if near.any():
                near &= s[left, u][:, None] != s[right, u][None, :]
        i, j = np.nonzero(near)
        if len(i):
            settle(rows[left[i]], rows[right[j]])
    on = np.flatnonzero(links)
    if len(on):
        yield pa.RecordBatch.from_arrays([table.column("cls").take(pa.array(on)).combine_chunks(), pa.array(rep[on]), pa.array(low[on]), pa.array(links[on])],
                                         ["cls", "rep", "low", "links"])


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", bits: int | None = None, miss: float = MISS, seed: int = 17) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    Rows are compared only where the labels are equal and not null and the vectors as long. Tables of
    ``bits`` random hyperplanes give buckets: so many that a label's rows make about ``BUCKET`` a bucket, and
    as many tables as ``miss`` asks for, so work follows the rows at any size. Pairs that share a bucket are verified by
    their cosine in double precision, and only those at ``threshold`` or above are links. Equal vectors of a label
    are one class, whose members are linked with each other and share their links. ``n_links``: other
    rows linked directly; ``component_id``: smallest id reachable by links.

    A bucket is dealt into blocks of about ``BLOCK`` classes. Buckets are sorted into tasks, which take them one
    after the other, small ones together; a task holds two blocks at most and gives counts and a spanning forest of its
    links, never the pairs. A pair found in several tables counts in the first of them alone.

    Null vectors or labels, zero vectors and vectors with a null or non-finite component link with nothing
    (0 links, their own component). A null id: 0 links, component null, kept true. Rows with one id and
    different vectors count each; they share the component. Other columns are ignored; an empty table gives
    an empty table."""
    src = vectors.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("_v"),
                         F.col(f"`{label_col}`").cast("string").alias("_label"))
    fine = F.col("_v").isNotNull() & F.col("_label").isNotNull() & F.col("_id").isNotNull() & \
        ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("_v", lambda x: x != 0)
    src = src.withColumn("_v", F.when(F.coalesce(fine, F.lit(False)), F.transform("_v", lambda x: x + F.lit(0.0))))
    src = src.withColumn("cls", F.when(F.col("_v").isNotNull(), F.sha2(F.concat_ws(",", F.col("_label"), F.transform("_v", lambda x: x.cast("string"))), 256)))
    src = materialize(src, "vectors-in")
    classes = materialize(src.where("cls is not null").groupBy("cls").agg(
        F.min("_id").alias("rep"), F.count("*").alias("size"), F.min("_label").alias("label"), F.any_value("_v").alias("v")), "vectors-classes")

    per_label = materialize(classes.groupBy("label").agg(F.count("*").alias("n"), F.count("*").alias("rows")), "vectors-labels")
    planes_of = F.lit(bits) if bits else F.greatest(F.lit(MIN_BITS), F.least(F.lit(MAX_BITS), F.round(F.log2(F.col("rows") / BUCKET)))).cast("int")
    sized = attach(classes.select("cls", "label", "v"), per_label, ["label"], "n").select("cls", "label", "v", planes_of.alias("bits"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, own = np.diff(np.asarray(b.column("v").offsets)), np.asarray(b.column("bits"))
            out: list = [None] * b.num_rows
            for w, n in set(zip(size.tolist(), own.tolist())):
                at = np.flatnonzero((size == w) & (own == n))
                m = np.stack([np.asarray(b.column("v")[int(i)].values) for i in at])
                for i, row in zip(at, signs(m / np.abs(m).max(1, keepdims=True), n, tables_for(n, threshold, miss), seed)):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([b.column("cls"), b.column("label"), pa.array(size, pa.int32()), pa.array(out, pa.list_(pa.int32()))], ["cls", "label", "width", "sig"])

    sig = materialize(sized.mapInArrow(sign, "cls string, label string, width int, sig array<int>"), "vectors-signs")
    entries = sig.select("cls", "label", "width", F.posexplode("sig").alias("t", "bucket"))
    key = ["label", "width", "t", "bucket"]
    blocks = (entries.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1")
              .select(*key, F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")))
    dealt = (entries.join(blocks, key).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(F.concat_ws(",", "width", "t", "bucket", F.least("own", "other"), F.greatest("own", "other"), "label").alias("key"),
                     "cls", "t", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
             .join(sig.select("cls", "sig"), "cls").join(classes.select("cls", "rep", "size", "v"), "cls"))
    fields = ["key", "cls", "t", "own", "x", "y", "sig", "rep", "size", "v"]
    sorted_in = dealt.select(*fields).repartition("key").sortWithinPartitions("key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last bucket seen, which may go on
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            codes = np.asarray(t.column("key").combine_chunks().dictionary_encode().indices)
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            if len(starts) > 1:
                yield from _links(t.slice(0, starts[-1]), starts[:-1], threshold)
            held = t.slice(starts[-1])
        if held is not None:
            yield from _links(held, np.zeros(1, np.int64), threshold)

    found = materialize(sorted_in.mapInArrow(compare, "cls string, rep long, low long, links long"), "vectors-links")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    # ids of a class hang on its representative; that also joins rows with one id
    comp = connected_components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")).union(
        src.where("cls is not null").join(classes.select("cls", "rep"), "cls").select("_id", "rep")), "vectors-cc")
    return (src.select("_id", "cls").join(classes.select("cls", "rep", "size").join(counts, "cls", "left"), "cls", "left")
            .join(comp.withColumnRenamed("node", "_id"), "_id", "left")
            .select(F.col("_id").alias(id_col), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("size") - 1, F.lit(0))).cast("long").alias("n_links"),
                    F.coalesce("component", "_id").alias("component_id"),
                    F.coalesce(F.coalesce("component", "_id") == F.col("_id"), F.lit(True)).alias("kept")))
