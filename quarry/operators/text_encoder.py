"""A kept text encoder (E1): TF-IDF reduced to a fixed width by randomised range finding; whole words, no hashing.

A fitted encoder is a folder: ``terms`` (no, term, idf, axis: array<double> of the encoder's width; ``bucket``, a hash of the
term, by which files can be skipped), and ``model`` (docs, width). A vocabulary of any size works, and the same folder gives the same vectors for
old and new texts.

Texts lie in blocks of whole rows, each with its own list of words, so no entry of the matrix is shuffled: between blocks and
words go the words of each block once, a group of buckets after the other, packed. The matrix holds counts; a word's idf is
applied where its sums come together, a text's length in its block.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text as tx
from quarry.operators.common import drop_shuffles, free, materialize, spread
from quarry.sources.io import scratch_path

WIDTH = 64
EXTRA = 16     # directions sampled beyond the width
ROUNDS = 2     # passes over the matrix and back that sharpen the range
MIN_DOCS = 2   # words of a single text tell nothing of another one
BLOCK_ENTRIES = 4_000_000  # words of texts in one block, about ...
BLOCK_TEXTS = 50_000       # ... and so many texts at most
TEXTS_AT_ONCE = 512        # texts whose words a task sorts together
CHUNK = 4_000              # entries multiplied at once
BUCKETS = 16               # of words; as many groups of them at most, one after the other
GROUP_WORDS = 250_000      # words of blocks in a group, about
RANGE_BYTES = 32 << 20     # vectors of words that a task adds up, about
ROW_GROUP = 16 << 20       # bytes of a Parquet row group: rows are whole blocks


def _kept(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``materialize`` for rows of megabytes."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks of texts: ``b, id, size, no, tf`` (the texts' ids and numbers of words, and these words one after the other) and, as
    further rows, the block's words in parts: ``b, base, term, df`` (the first one's number, the words, their numbers of texts).

    Texts of one id count as one text. Only these are brought together, by a shuffle of their words."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"))
    toks = tx.tokens(F.coalesce("_t", F.lit(""))).alias("t")
    twice = own.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    if twice.isEmpty():
        rows = spread(own).select("id", toks, F.lit(None).cast("array<int>").alias("n"))
    else:
        same = own["id"].eqNullSafe(twice["id"])
        rows = (spread(own.join(twice, same, "left_anti")).select("id", toks, F.lit(None).cast("array<int>").alias("n"))
                .unionByName(own.join(twice, same, "left_semi").select("id", F.explode(toks).alias("term")).groupBy("id", "term").agg(F.count("*").cast("int").alias("n"))
                             .groupBy("id").agg(F.collect_list(F.struct("term", "n")).alias("e")).select("id", F.col("e.term").alias("t"), F.col("e.n").alias("n"))))
    entries, texts = BLOCK_ENTRIES, BLOCK_TEXTS
    fields = [T.StructField("b", T.LongType()), T.StructField("id", T.ArrayType(own.schema["id"].dataType)), *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("size", "no", "tf")],
              T.StructField("base", T.IntegerType()), T.StructField("term", T.ArrayType(T.StringType())), T.StructField("df", T.ArrayType(T.IntegerType()))]

    def run(batches):
        done, words, parts = 0, {}, []

        def block():
            b = (TaskContext.get().partitionId() << 24) + done
            ids, size, no, tf = (pa.concat_arrays([p[0] for p in parts]), *(np.concatenate([p[i] for p in parts]) for i in (1, 2, 3)))
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a if isinstance(a, pa.Array) else pa.array(a, pa.int32()))
            none = lambda t: pa.nulls(1, t)
            ints, df, terms = pa.list_(pa.int32()), np.bincount(no, minlength=len(words)), [*words]
            names = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays([pa.array([b]), one(ids), one(size), one(no), one(tf), none(pa.int32()), none(pa.list_(pa.string())), none(ints)], names)
            for i in range(0, len(terms), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array([b]), none(pa.list_(ids.type)), none(ints), none(ints), none(ints), pa.array([i], pa.int32()),
                                                  one(pa.array(terms[i:i + 20_000], pa.string())), one(df[i:i + 20_000])], names)

        for whole in batches:
            for i in range(0, len(whole), TEXTS_AT_ONCE):
                some = whole.slice(i, TEXTS_AT_ONCE)
                some = some.filter(pc.greater(pc.fill_null(pc.list_value_length(some.column("t")), 0), 0))
                if not len(some):
                    continue
                lens = pc.list_value_length(some.column("t")).to_numpy().astype(np.int64)
                own = some.column("t").flatten().dictionary_encode()
                no = np.array([words.setdefault(w, len(words)) for w in own.dictionary.to_pylist()], np.int64)[own.indices.to_numpy()]
                counted = np.repeat(some.column("n").is_valid().to_numpy(zero_copy_only=False), lens)
                tf = np.ones(len(no), np.int64)
                tf[counted] = some.column("n").flatten().to_numpy()
                row = np.repeat(np.arange(len(lens)), lens)
                key = row * len(words) + no
                order = np.argsort(key, kind="stable")
                key = key[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                row, no = np.divmod(key[first], len(words))
                parts.append((some.column("id"), np.bincount(row, minlength=len(lens)), no, np.add.reduceat(tf[order], first)))
                if sum(len(p[2]) for p in parts) >= entries or sum(len(p[1]) for p in parts) >= texts:
                    yield from block()
                    done, words, parts = done + 1, {}, []
        if parts:
            yield from block()

    return _kept(rows.mapInArrow(run, T.StructType(fields)), "encoder-texts")


def _words(texts: DataFrame) -> DataFrame:
    """(b, no, term, df) of the blocks: their words with the numbers they have there."""
    return (texts.where("term is not null").select("b", "base", F.posexplode(F.arrays_zip("term", "df")).alias("i", "w"))
            .select("b", (F.col("base") + F.col("i")).alias("no"), "w.term", "w.df"))


def _bucket() -> F.Column:
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")


def _of_group(g: int, groups: int) -> F.Column:
    return F.col("bucket").isin([*range(g, BUCKETS, groups)])


def _matrix(texts: DataFrame, vocabulary: DataFrame, width: int) -> tuple[DataFrame, int, Callable[[DataFrame], DataFrame]]:
    """The blocks by the words of ``vocabulary`` (term, no): ``b, g, n, no, doc, tf, known, cut``, a row per block and group of buckets; the
    number of groups; and what adds a word's range ``r``. ``doc`` (of ``n``) and ``no`` number the block's texts and, in ``known``, its words, which
    come by range: range r's are those from ``cut[r]``."""
    words = materialize(_words(texts).select("b", F.col("no").alias("i"), "term").join(vocabulary.select("term", "no"), "term").select("b", "i", "no", "term"), "encoder-words")
    total = words.count()
    groups = min(BUCKETS, 1 << max(0, math.ceil(math.log2(max(1, total / GROUP_WORDS)))))
    ranges = max(texts.sparkSession.sparkContext.defaultParallelism, -(-total * width * 8 // (groups * RANGE_BYTES)))
    ranged = lambda df: df.withColumn("r", F.pmod(F.xxhash64("term", F.lit(1)), F.lit(ranges)).cast("int"))

    def run(t: pa.Table, w: pa.Table) -> pa.Table:
        size, no, tf = (t.column(c)[0].values.to_numpy() for c in ("size", "no", "tf"))
        i, known, g, r = (w.column(c).to_numpy() for c in ("i", "no", "g", "r"))
        doc, own_group = np.repeat(np.arange(len(size), dtype=np.int32), size), np.full(int(no.max()) + 1, -1, np.int32)
        own_group[i] = g
        of, out = own_group[no], []
        for group in range(groups):
            mine = np.flatnonzero(g == group)
            mine = mine[np.lexsort((known[mine], r[mine]))]
            place = np.zeros(len(own_group), np.int32)
            place[i[mine]] = np.arange(len(mine))
            at = np.flatnonzero(of == group)
            out.append({"b": t.column("b")[0].as_py(), "g": group, "n": len(size), "no": place[no[at]], "doc": doc[at], "tf": tf[at], "known": known[mine],
                        "cut": np.searchsorted(r[mine], np.arange(ranges + 1)).astype(np.int32)})
        return pa.Table.from_pylist(out, schema=pa.schema([("b", pa.int64()), ("g", pa.int32()), ("n", pa.int32()), *[(c, pa.list_(pa.int32())) for c in ("no", "doc", "tf")],
                                                           ("known", pa.list_(pa.int64())), ("cut", pa.list_(pa.int32()))]))

    rows = texts.where("no is not null").select("b", "size", "no", "tf")
    own = ranged(words).select("b", "i", "no", F.pmod(_bucket(), F.lit(groups)).alias("g"), "r")
    out = _kept(rows.groupBy("b").cogroup(own.groupBy("b")).applyInArrow(run, "b long, g int, n int, no array<int>, doc array<int>, tf array<int>, known array<long>, cut array<int>"),
                "encoder-rows", "g")
    free(words)
    return out, groups, ranged


def _times(to: np.ndarray, of: np.ndarray, x: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Row ``to`` of the result: the sum of x v[of]; ``to`` is sorted."""
    out = np.zeros((n, v.shape[1]))
    for i in range(0, len(to), CHUNK):
        own = to[i:i + CHUNK]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        out[own[first]] += np.add.reduceat(v[of[i:i + CHUNK]] * x[i:i + CHUNK, None], first, axis=0)
    return out


def _numbers(cell, *shape) -> np.ndarray:
    return np.frombuffer(cell.as_buffer()).reshape(*shape)


def _lists(rows: DataFrame) -> DataFrame:
    """(r, b, no, z) of a group: each block's words by range, packed; no z."""
    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                known, cut = (batch.column(c)[k].values.to_numpy() for c in ("known", "cut"))
                has = np.flatnonzero(cut[1:] > cut[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array([batch.column("b")[k].as_py()] * len(has), pa.int64()),
                                                  pa.array([known[cut[r]:cut[r + 1]].tobytes() for r in has], pa.binary()), pa.nulls(len(has), pa.binary())], ["r", "b", "no", "z"])

    return rows.select("b", "known", "cut").mapInArrow(run, "r int, b long, no binary, z binary")


def _back(rows: DataFrame, state: DataFrame, turn: np.ndarray) -> DataFrame:
    """(r, b, no, z) of a group: each block's words by range with the sums of its texts' rows of ``state``, turned."""
    k = turn.shape[0]

    def run(t: pa.Table, s: pa.Table) -> pa.Table:
        no, doc, tf, known, cut = (t.column(c)[0].values.to_numpy() for c in ("no", "doc", "tf", "known", "cut"))
        y = _numbers(s.column("y")[0], -1, k) @ turn * _numbers(s.column("w")[0], -1, 1)
        by = np.argsort(no, kind="stable")
        z = _times(no[by], doc[by], tf[by], y, len(known))
        has = np.flatnonzero(cut[1:] > cut[:-1])
        cells = lambda a: pa.array([a[cut[r]:cut[r + 1]].tobytes() for r in has], pa.binary())
        return pa.table({"r": pa.array(has, pa.int32()), "b": pa.array([t.column("b")[0].as_py()] * len(has), pa.int64()), "no": cells(known), "z": cells(z)})

    return rows.groupBy("b").cogroup(state.groupBy("b")).applyInArrow(run, "r int, b long, no binary, z binary")


def _range(parts: pa.Table, cells: pa.Table, k: int) -> tuple[pa.Table, np.ndarray, list[np.ndarray]]:
    """A range's words in order, the sums of their z, and the places of each part's words."""
    cells = cells.sort_by("no")
    known = cells.column("no").to_numpy()
    total, at = np.zeros((len(known), k)), []
    for no, z in zip(parts.column("no"), parts.column("z")):
        at.append(np.searchsorted(known, np.frombuffer(no.as_buffer(), np.int64)))
        if z.is_valid:
            total[at[-1]] += _numbers(z, -1, k)
    return cells, total, at


def _product(rows: DataFrame, words: DataFrame, cells: DataFrame, vectors: Callable[[pa.Table, np.ndarray], np.ndarray], k: int, state: DataFrame | None = None,
             squares: bool = False) -> DataFrame:
    """(b, y, w): to the texts' rows y of ``state`` (nothing yet, where y is null) add a group of the matrix times its words' vectors, each
    text's sum times its ``w``. ``vectors`` gets the words of a range (``cells``) and the sums of what the blocks have for them (``words``).
    ``squares``: the last number of a vector is multiplied by squared counts."""
    def share(parts: pa.Table, own: pa.Table) -> pa.Table:
        own, total, at = _range(parts, own, k)
        v = vectors(own, total) if len(own) else total
        return pa.table({"b": parts.column("b"), "r": parts.column("r"), "v": pa.array([v[i].tobytes() for i in at], pa.binary()), "w": pa.nulls(len(at), pa.binary())})

    def add(t: pa.Table, s: pa.Table) -> pa.Table:
        no, doc, tf, known, cut = (t.column(c)[0].values.to_numpy() for c in ("no", "doc", "tf", "known", "cut"))
        n, v, y, w = t.column("n")[0].as_py(), np.zeros((len(known), k)), None, None
        for r, x, own in zip(s.column("r").to_pylist(), s.column("v"), s.column("w")):
            if r >= 0:
                v[cut[r]:cut[r + 1]] = _numbers(x, -1, k)
            else:
                y, w = _numbers(x, n, k) if x.is_valid else None, own if own.is_valid else None
        new = _times(doc, no, tf, v, n)
        if squares:
            new[:, -1:] = _times(doc, no, tf.astype(float) ** 2, v[:, -1:], n)
        if w is not None:
            new *= _numbers(w, n, 1)
        return pa.table({"b": t.column("b"), "y": pa.array([(new if y is None else new + y).tobytes()], pa.binary()), "w": pa.array([w and w.as_py()], pa.binary())})

    back = words.groupBy("r").cogroup(cells.groupBy("r")).applyInArrow(share, "b long, r int, v binary, w binary")
    if state is not None:
        back = back.unionByName(state.select("b", F.lit(-1).alias("r"), F.col("y").alias("v"), "w"))
    return rows.groupBy("b").cogroup(back.groupBy("b")).applyInArrow(add, "b long, y binary, w binary")


def _over_groups(rows: DataFrame, groups: int, cells: DataFrame, words: Callable[[DataFrame], DataFrame], vectors, k: int, state: DataFrame | None = None, squares: bool = False) -> DataFrame:
    """``_product`` of all groups, one after the other; what a group has left on disk goes before the next."""
    for g in range(groups):
        own = rows.where(F.col("g") == g)
        new = _kept(_product(own, words(own), cells.where(_of_group(g, groups)), vectors, k, state, squares), "encoder-state")
        if g:
            free(state)
        else:
            drop_shuffles(rows.sparkSession)
        state = new
    return state


def _gram(state: DataFrame, other: DataFrame, k: int, turn: np.ndarray) -> np.ndarray:
    """Sum over the texts of y v' with y of ``state``, turned, and v of ``other``: one symmetric matrix of sums that Spark adds up."""
    def run(s: pa.Table, o: pa.Table) -> pa.Table:
        i, j = np.indices((k, k)).reshape(2, -1)
        m = (_numbers(s.column("y")[0], -1, k) @ turn).T @ _numbers(o.column("y")[0], -1, k)
        return pa.table({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "x": m.ravel()})

    out = np.zeros((k, k))
    for r in state.groupBy("b").cogroup(other.groupBy("b")).applyInArrow(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        out[r["i"], r["j"]] = r["x"]
    return (out + out.T) / 2


def fit_encoder(docs: DataFrame, folder: str, text_col: str = "text", id_col: str = "id", width: int = WIDTH, min_docs: int = MIN_DOCS,
                rounds: int = ROUNDS, seed: int = 3) -> None:
    """Fit the encoder on ``docs`` and write it to ``folder``.

    Rows of the matrix A are texts of unit length, tf * (ln((1 + N) / (1 + df)) + 1). Each word gets a random
    direction of ``width`` + ``EXTRA`` numbers, drawn from its own hash; the matrix times these, and back and
    forth ``rounds`` more times, spans the leading range. Between steps only the texts' rows Y = A V are kept: the Gram matrix of
    the words' vectors Z = A' Y is Y' (A Z), and with it they are made orthonormal and at last turned so that components come
    by falling weight. The driver sees these small matrices and counts. Words of fewer than ``min_docs`` texts have no axis."""
    spark, k = docs.sparkSession, width + EXTRA
    texts = _texts(docs, id_col, text_col)
    n = docs.count()
    idf = (_words(texts).groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") >= min_docs)
           .select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"), F.monotonically_increasing_id().alias("no")))
    idf = materialize(idf, "encoder-idf")
    rows, groups, ranged = _matrix(texts, idf, k + 1)
    free(texts)
    cells = ranged(idf).select("r", "no", "idf", "term", F.xxhash64("term").alias("h"), _bucket().alias("bucket"))
    weight = lambda own, p: own.column("idf").to_numpy()[:, None] ** p

    def drawn(own, _):
        v = np.stack([np.random.default_rng([seed, h & (2 ** 63 - 1)]).standard_normal(k) for h in own.column("h").to_pylist()])
        return np.hstack([v * weight(own, 1), weight(own, 2)])

    def unit(batches):
        for batch in batches:
            for b, y in zip(batch.column("b"), batch.column("y")):
                y = _numbers(y, -1, k + 1)
                w = 1 / np.sqrt(np.where(y[:, k] > 0, y[:, k], 1.0))
                yield pa.RecordBatch.from_arrays([pa.array([b.as_py()], pa.int64()), pa.array([(y[:, :k] * w[:, None]).tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())], ["b", "y", "w"])

    first = _over_groups(rows, groups, cells, _lists, drawn, k + 1, squares=True)
    y, turn = _kept(first.select("b", "y").mapInArrow(unit, "b long, y binary, w binary"), "encoder-state"), np.eye(k)
    free(first)
    for i in range(rounds + 1):
        blank = y.select("b", F.lit(None).cast("binary").alias("y"), "w")
        new = _over_groups(rows, groups, cells, lambda own: _back(own, y, turn), lambda own, z: z * weight(own, 2), k, blank)  # noqa: B023
        e, q = np.linalg.eigh(_gram(y, new, k, turn))
        keep = e > max(e.max(initial=0.0), 0.0) * 1e-12
        own = q[:, keep] / np.sqrt(e[keep]) if keep.any() else np.zeros((k, k))
        own = np.hstack([own, np.zeros((k, k - own.shape[1]))])
        if i < rounds:
            free(y)
            y, turn = new, own
    e, q = np.linalg.eigh(own.T @ _gram(new, new, k, np.eye(k)) @ own)
    free(new)
    last = own @ q[:, np.argsort(-e, kind="stable")[:width]]

    def axes(parts: pa.Table, own: pa.Table) -> pa.Table:
        own, z, _ = _range(parts, own, k)
        v = (z * weight(own, 1)) @ last
        return own.select(["no", "term", "idf"]).append_column("axis", pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * width, pa.int32()), pa.array(v.ravel())))

    for g in range(groups):
        parts = _back(rows.where(F.col("g") == g), y, turn)
        own = parts.groupBy("r").cogroup(cells.where(_of_group(g, groups)).select("r", "no", "idf", "term").groupBy("r"))
        (own.applyInArrow(axes, "no long, term string, idf double, axis array<double>").withColumn("bucket", _bucket())
         .write.mode("append" if g else "overwrite").parquet(f"{folder}/terms"))
        drop_shuffles(spark)
    for table in (y, idf):
        free(table)
    spark.createDataFrame([(n, width)], "docs long, width int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/model")


def encode_texts(docs: DataFrame, folder: str, text_col: str = "text", id_col: str = "id", out: str = "embedding") -> DataFrame:
    """(id, vector of unit length, array<float>) of every text by a kept encoder; a text without known words has the zero
    vector. Words of blocks of texts find their numbers by a join; their axes are shipped once per block."""
    spark = docs.sparkSession
    width = encoder_width(spark, folder)
    terms = spark.read.parquet(f"{folder}/terms")
    if "bucket" not in terms.columns:  # a folder written before there were buckets
        terms = terms.withColumn("bucket", _bucket())
    texts = _texts(docs, id_col, text_col)
    rows, groups, ranged = _matrix(texts, terms, width)

    def axes(own, _):
        return np.reshape(own.column("axis").combine_chunks().flatten().to_numpy(), (-1, width)) * own.column("idf").to_numpy()[:, None]

    y = _over_groups(rows, groups, ranged(terms).select("r", "no", "idf", "axis", "bucket"), _lists, axes, width)
    kind = docs.schema[id_col].dataType

    def unit(t: pa.Table, s: pa.Table) -> pa.Table:
        v = _numbers(s.column("y")[0], -1, width)
        length = np.sqrt((v * v).sum(1, keepdims=True))
        v = (v / np.where(length > 0, length, 1.0)).astype(np.float32)
        return pa.table({"id": t.column("id")[0].values, "y": pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * width, pa.int32()), pa.array(v.ravel()))})

    of = texts.where("no is not null").select("b", "id")
    vectors = materialize(of.groupBy("b").cogroup(y.groupBy("b")).applyInArrow(unit, T.StructType([T.StructField("id", kind), T.StructField("y", T.ArrayType(T.FloatType()))]))
                          .select(F.col("id").alias(id_col), F.col("y").alias(out)), "encoder-vectors")
    for table in (texts, rows, y):
        free(table)
    zero = F.array_repeat(F.lit(0.0), width)
    return docs.select(id_col).join(vectors, id_col, "left").select(id_col, F.coalesce(out, zero.cast("array<float>")).alias(out))


def encoder_width(spark: SparkSession, folder: str) -> int:
    return spark.read.parquet(f"{folder}/model").first()["width"]
