"""Near-duplicate documents by HyperMinHash sketches, banding and exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import connected_components, id_text, materialize, small_batches
from quarry.llm.hashing import mix, window_hashes, word_hashes

BUCKET_BITS = 9            # 512 registers
MANTISSA_BITS = 3          # a register is a byte: 5 bits of leading zeros, 3 bits of mantissa
BAND = 8                   # registers in a band: 64 bands
EMPTY = 0xFF
BLOCK = 512                # members of a family that one task compares with as many others
# Chance that the registers of two unrelated minima agree: equal leading zeros (about a third) and mantissa.
COLLISION = 0.34 / (1 << MANTISSA_BITS)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles (A-Z lower-cased); fewer words are one shingle."""
    ws = text.encode().lower().split() if text else []
    if not ws:
        return np.zeros(0, np.uint64)
    h = word_hashes(ws)
    if len(ws) < k:  # told apart from longer sequences by its length
        return mix(window_hashes(h, len(ws)), np.full(1, len(ws), np.uint64))
    return np.unique(window_hashes(h, k))


def registers(u: np.ndarray) -> np.ndarray:
    """HyperMinHash of sorted distinct hashes: the first bits choose a bucket, the smallest rest in a bucket
    is kept as its number of leading zeros and the bits after the first one."""
    out = np.full(1 << BUCKET_BITS, EMPTY, np.uint8)
    if not len(u):
        return out
    bucket = (u >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))  # sorted: the minimum comes first
    rest = (u[first] << np.uint64(BUCKET_BITS)) | np.uint64((1 << BUCKET_BITS) - 1)
    # position of the leading one: exact from the two 32-bit halves
    high, low = (rest >> np.uint64(32)).astype(np.float64), (rest & np.uint64(0xFFFFFFFF)).astype(np.float64)
    top = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])
    zeros = np.minimum(64 - top, 30).astype(np.uint64)
    after = rest << (zeros + np.uint64(1))
    out[bucket[first]] = (zeros << np.uint64(MANTISSA_BITS)) | (after >> np.uint64(64 - MANTISSA_BITS))
    return out


# For each register, the order in which it borrows from other registers while it is empty itself.
_ORDER = np.argsort(np.random.default_rng(11).random((1 << BUCKET_BITS, 1 << BUCKET_BITS)), axis=1).argsort(axis=1).astype(np.uint16)


def band_keys(reg: np.ndarray) -> np.ndarray:
    """A key for each band of a sketch that is not empty.

    An empty register borrows the register that comes first in its own fixed random order, so that in short
    documents, too, a band holds several different minima: one common shingle alone makes no band equal."""
    full = np.flatnonzero(reg != EMPTY)
    if not len(full):
        return np.zeros(0, np.uint64)
    source = np.arange(len(reg))
    gaps = np.flatnonzero(reg == EMPTY)
    if len(gaps):
        source[gaps] = full[np.argmin(_ORDER[np.ix_(gaps, full)], axis=1)]
    value = (source.astype(np.uint32) << np.uint32(8)) | reg[source]
    w = value.reshape(-1, BAND).view(np.uint64)
    key = np.arange(len(w), dtype=np.uint64)
    for c in range(w.shape[1]):
        key = mix(key, w[:, c])
    return key


def estimate(a: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of one sketch with each of ``others``, corrected for register collisions, and the
    number of registers it rests on."""
    used = (a != EMPTY) | (others != EMPTY)
    n = np.maximum(used.sum(1), 1)
    same = ((a == others) & used).sum(1) / n
    return (same - COLLISION) / (1 - COLLISION), n


def plausible(a: np.ndarray, others: np.ndarray, similarity: float) -> np.ndarray:
    """Not below the similarity by more than four standard errors."""
    est, n = estimate(a, others)
    return est >= similarity - 4 * np.sqrt(similarity * (1 - similarity) / n)


def _sketch(src: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            n, cls, sk = [], [], []
            for t in b.column("_text").to_pylist():
                u = shingles(t, k)
                n.append(len(u))
                cls.append(xxhash.xxh3_128_digest(u.tobytes()) if len(u) else None)
                sk.append(registers(u).tobytes() if len(u) else None)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sk, pa.binary())],
                                             ["_id", "n", "cls", "sketch"])

    return src.mapInArrow(run, "_id long, n long, cls binary, sketch binary")


def _bands(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [band_keys(np.frombuffer(s, np.uint8)).view(np.int64) for s in b.column("sketch").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("n"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                                             ["rep", "n", "keys"])

    return (reps.select("rep", "n", "sketch").mapInArrow(run, "rep long, n long, keys array<long>")
            .select("rep", "n", F.explode("keys").alias("key")))


def _size_fits(x: str, y: str, pct: int):
    """Sets of these sizes can reach the similarity."""
    return (F.least(x, y) * 100 >= F.greatest(x, y) * pct)


def _likely(pairs: DataFrame, reps: DataFrame, pct: int) -> DataFrame:
    """Pairs (a, b) whose sketches make the similarity plausible."""
    sk = reps.select("rep", "sketch")
    both = (pairs.join(sk.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a")
            .join(sk.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("sa", "sb"))
            ok = plausible(x, y, pct / 100)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], ["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirmed(src: DataFrame, reps: DataFrame, pairs: DataFrame, k: int, pct: int, name: str) -> DataFrame:
    """Links (a, b): pairs with 100 * intersection >= pct * union on the full shingle sets."""
    likely = materialize(_likely(pairs, reps, pct), f"{name}-likely")
    full = _sets(src, reps, likely.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), k, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("xa").to_pylist(), b.column("xb").to_pylist()):
                ok.append(linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), pct))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok, pa.bool_())), b.column("b").filter(pa.array(ok, pa.bool_()))], ["a", "b"])

    both = (likely.join(full.select(F.col("rep").alias("a"), F.col("set").alias("xa")), "a")
            .join(full.select(F.col("rep").alias("b"), F.col("set").alias("xb")), "b"))
    return materialize(both.select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long"), f"{name}-links")


def linked(x: np.ndarray, y: np.ndarray, pct: int) -> bool:
    """100 * intersection >= pct * union, of sorted distinct arrays."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= pct * (len(x) + len(y) - common)


def _sets(src: DataFrame, reps: DataFrame, wanted: DataFrame, k: int, name: str) -> DataFrame:
    """(rep, set): the full shingle sets of the wanted representatives, from their texts."""
    need = wanted.join(reps.select("rep", "cls"), "rep").withColumnRenamed("rep", "_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            ids, out = [], []
            for doc, t, cls in zip(b.column("_id").to_pylist(), b.column("_text").to_pylist(), b.column("cls").to_pylist()):
                u = shingles(t, k).tobytes()
                if xxhash.xxh3_128_digest(u) == cls:
                    ids.append(doc)
                    out.append(u)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["rep", "set"])

    return materialize(src.join(need, "_id").mapInArrow(sets, "rep long, set binary").dropDuplicates(["rep"]), f"{name}-sets")


def _open_links(members: DataFrame, reps: DataFrame, comp: DataFrame, src: DataFrame, k: int, pct: int) -> DataFrame:
    """Links between members that share a band, lie in different components so far, and were not held
    against the band's hub.

    Members of such bands, and bands of such members, make up families. A family is dealt into blocks of
    about ``BLOCK`` members, which meet two by two in a task with their sketches and full sets: plausible pairs
    of different components are confirmed there, most similar first, and a pair whose ends are already
    joined is passed over. So a task gives a spanning forest of its links, never the pairs."""
    m = (members.where("rep <> hub").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
         .select("key", "rep", F.coalesce("component", "rep").alias("component")))
    open_keys = materialize(m.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("rep").alias("head"))
                            .where("lo < hi").select("key", "head"), "minhash-open")
    family = connected_components(m.join(open_keys, "key").select(F.col("head").alias("a"), F.col("rep").alias("b")), "minhash-families")
    family = family.select(F.col("node").alias("rep"), F.col("component").alias("family"))
    blocks = family.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = (family.join(blocks, "family").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
             .join(reps.select("rep", "n", "sketch"), "rep").join(_sets(src, reps, family.select("rep"), k, "minhash-2"), "rep")
             .join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("family", "rep", "n", "component", "own", "sketch", "set", F.least("own", "other").cast("int").alias("x"), F.greatest("own", "other").cast("int").alias("y")))

    def compare(table: pa.Table) -> pa.Table:
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        own, rep, n = (np.asarray(table.column(c)) for c in ("own", "rep", "n"))
        root = np.unique(np.asarray(table.column("component")), return_inverse=True)[1]
        sk = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(rep), -1)
        sets = [np.frombuffer(v, np.uint64) for v in table.column("set").to_pylist()]
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        out = []
        for i in left:
            j = right if x != y else right[right > i]
            j = j[(root[j] != root[i]) & (np.minimum(n[j], n[i]) * 100 >= np.maximum(n[j], n[i]) * pct)]
            if not len(j):
                continue
            est, used = estimate(sk[i], sk[j])
            ok = est >= pct / 100 - 4 * np.sqrt(pct / 100 * (1 - pct / 100) / used)
            for c in j[ok][np.argsort(-est[ok], kind="stable")]:
                if root[c] != root[i] and linked(sets[i], sets[c], pct):
                    out.append((min(rep[i], rep[c]), max(rep[i], rep[c])))
                    root[root == root[c]] = root[i]
        return pa.table({"a": pa.array([int(p) for p, _ in out], pa.int64()), "b": pa.array([int(p) for _, p in out], pa.int64())})

    return materialize(dealt.groupBy("family", "x", "y").applyInArrow(compare, "a long, b long"), "minhash-2-links")


def near_duplicates(docs: DataFrame, k: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    A-Z are lower-cased, words are maximal runs of characters other than space and \\x09-\\x0D. A document is
    the set of its distinct k-word shingles (fewer words: the whole sequence). Documents are linked where
    100 * intersection >= pct * union; ``component_id`` is the smallest id reachable by links.

    HyperMinHash: 512 registers of leading zeros and mantissa bits; 64 bands of 8 compressed registers give
    candidates (a pair at 0.80 misses all bands with a chance below 1e-5, at 0.85 below 1e-8); the
    collision-corrected estimate drops what is four standard errors too low; the rest is confirmed on the
    full sets. Documents with the same set are one class. In each band every member is first held against
    the band's smallest id; members that still lie in different components then meet in blocks of their
    family (see ``_open_links``). So what is shuffled follows the size of a group, not its square.

    A document without words links with nothing. A null id is in no class: component_id null, kept true.
    Rows with one id are one document; if their texts differ, one of them stands for it. Other columns are
    ignored. An empty table gives an empty table."""
    src = id_text(docs, id_col, text_col)
    base = materialize(_sketch(src, k), "minhash-sketches")
    classes = base.where("cls is not null and _id is not null").groupBy("cls").agg(F.min("_id").alias("rep"))
    classes = materialize(classes, "minhash-classes")
    reps = (classes.groupBy("rep").agg(F.min("cls").alias("cls"))
            .join(base.select(F.col("_id").alias("rep"), "cls", "n", "sketch"), ["rep", "cls"]).dropDuplicates(["rep"]))
    reps = materialize(reps, "minhash-reps")
    bands = materialize(_bands(reps), "minhash-bands")
    shared = bands.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").select("key", "hub")
    members = materialize(bands.join(shared, "key"), "minhash-members")
    sizes = members.select(F.col("rep").alias("hub"), F.col("n").alias("hub_n")).distinct()
    pairs = (members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"), "n").distinct()
             .join(sizes.withColumnRenamed("hub", "a"), "a").where(_size_fits("n", "hub_n", pct)).select("a", "b"))
    links = _confirmed(src, reps, pairs, k, pct, "minhash-1")
    comp = connected_components(links, "minhash-cc1")
    more = _open_links(members, reps, comp, src, k, pct)
    if not more.isEmpty():
        comp = connected_components(links.union(more), "minhash-cc2")
    rep_comp = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("cls", F.coalesce("component", "rep").alias("component"))
    return (base.select("_id", "n", "cls").join(rep_comp, "cls", "left")
            .withColumn("component", F.when(F.col("_id").isNotNull(), F.coalesce("component", "_id")))
            .select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                    F.coalesce(F.col("_id") == F.col("component"), F.lit(True)).alias("kept")))
