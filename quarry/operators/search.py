"""Exact and approximate vector search.

Exact search is the reference's chunked scan re-expressed on Spark:

1. the query table (small, bounded and checked) is collected once and shipped
   to the executors as a broadcast variable; beyond ``max_queries_per_pass``
   queries a result with a cut is one plan of query groups against corpus
   blocks (``_search_many``), other results one pass over the corpus per part;
2. every corpus partition is scored in Arrow batches by a numpy block product
   (``mapInPandas``) and keeps only its own top-k per query (exact, ties
   broken by id), so no (query, document) pair is ever materialised as a row;
3. the partial lists are merged by a fan-in tree of ``row_number() <= k``
   windows keyed by (query, block).  Each merge group holds at most
   ``fan_in * k`` rows, however many partitions the corpus has.

Scores are rounded (half away from zero) before ranking so that float noise
cannot flip ties; ties are broken by ascending id everywhere.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.vectors import cosine, neg_euclidean, np_round_half_away, round_half_away

MAX_QUERIES_PER_PASS = 4096  # x 1024 dims x 8 bytes = 32 MiB broadcast
FAN_IN = 64
# Above this many partial rows (partitions x queries x k) a first, cheap pass
# fixes a score floor per query so that partitions only ship rows above it.
PRUNE_ROWS = 20_000_000
# A task's top-k buffer holds up to 2 x queries x k rows: queries per pass are
# capped so that stays near 10 M rows (k = 10,000 -> 500 queries per pass).
MAX_BUFFER_ROWS = 5_000_000
# Scores computed at once in a task (32 MB of doubles).
BLOCK_SCORES = 4_000_000
# More queries than a pass holds: components of a corpus block in one task (32 MB of floats), and queries scored together.
BLOCK_NUMBERS = 1 << 23
TOGETHER = 256
# Scores in single precision computed at once: they stay in a core's cache.
NEAR_SCORES = 1 << 19
# Without a cut every (query, row) pair of a batch is output: keep a batch's
# output near 1 M rows.
MAX_QUERIES_UNCUT = 256


def _score_block(C: np.ndarray, Q: np.ndarray, metric: str, qnorm2: np.ndarray) -> np.ndarray:
    if metric == "cosine":
        cn = np.linalg.norm(C, axis=1)  # a vector of length zero scores 0 with everything
        return (C @ Q.T) / np.where(cn > 0, cn, 1.0)[:, None]
    if metric == "dot":
        return C @ Q.T
    if metric == "neg_euclidean":
        d2 = (C * C).sum(axis=1)[:, None] + qnorm2[None, :] - 2.0 * (C @ Q.T)
        return -np.sqrt(np.maximum(d2, 0.0))
    if metric == "both":  # cosine and negative Euclidean distance from one product
        cn2 = (C * C).sum(axis=1)
        dots = C @ Q.T
        norms = np.sqrt(cn2)[:, None] * np.sqrt(qnorm2)[None, :]
        return np.stack([dots / np.where(norms > 0, norms, 1.0),
                         -np.sqrt(np.maximum(cn2[:, None] + qnorm2[None, :] - 2.0 * dots, 0.0))])
    raise ValueError(f"unknown metric {metric}")


def _make_scorer(bc, k, metric, digits, id_col, vec_col, key_col, out_q, fan_in, compact_factor=2,
                 tau_bc=None, probe=False):
    def run(batches):
        from pyspark import TaskContext
        q_ids, q_keys, Q, qn2 = bc.value
        tau = tau_bc.value if tau_bc is not None else None
        blk = TaskContext.get().partitionId() // fan_in
        n = len(q_ids)
        buf = []
        buf_rows = 0
        # running floor per query: the k-th best score kept so far in this task
        # (rows below it can no longer enter the task's top-k; ties are kept)
        floor = np.full(n, -np.inf)

        def compact(frames):
            df = pd.concat(frames, ignore_index=True)
            if k is None:
                return df
            df = df.sort_values(["_q", "score", "id"], ascending=[True, False, True], kind="mergesort")
            return df.groupby("_q", sort=False).head(k)

        for pdf in batches:
            pdf = pdf[pdf[vec_col].notna()]
            if len(pdf) == 0:
                continue
            vectors, ids = pdf[vec_col].to_numpy(), pdf[id_col].to_numpy()
            for at, cols_of in _blocks(pdf, q_keys, key_col, n):
                C = _as_matrix(vectors[at], Q.shape[1], strict=q_keys is None)
                S = _score_block(C, Q[cols_of], metric, qn2[cols_of])
                S = np_round_half_away(S, digits) if digits is not None else S
                S, other = S if metric == "both" else (S, None)
                valid = np.isfinite(S)
                if tau is not None:
                    valid &= S >= tau[cols_of][None, :]
                if k is not None:
                    valid &= S >= floor[cols_of][None, :]
                b = S.shape[0]
                if k is not None and k < b:
                    Sm = np.where(valid, S, -np.inf)
                    thr = np.partition(Sm, b - k, axis=0)[b - k]
                    valid &= Sm >= thr[None, :]
                rows, cols = np.nonzero(valid)
                if len(rows) == 0:
                    continue
                found = pd.DataFrame({"_q": cols_of[cols], "id": ids[at][rows], "score": S[rows, cols]})
                if other is not None:
                    found["euc_score"] = other[rows, cols]
                buf.append(found)
                buf_rows += len(rows)
            if k is not None and buf_rows > compact_factor * n * k:
                kept = compact(buf)
                buf, buf_rows = [kept], len(kept)
                g = kept.groupby("_q", sort=False)["score"]
                full = g.size() >= k
                floor[full.index[full.to_numpy()].to_numpy()] = g.min()[full].to_numpy()
            elif k is None and buf_rows >= 65536:
                out = compact(buf)
                buf, buf_rows = [], 0
                yield _emit(out, q_ids, q_keys, blk, out_q, id_col, key_col)
        if buf:
            out = compact(buf)
            if probe:
                yield pd.DataFrame({"_q": out["_q"].to_numpy(np.int64), "score": out["score"].to_numpy()})
            else:
                yield _emit(out, q_ids, q_keys, blk, out_q, id_col, key_col)

    return run


def _blocks(pdf, q_keys, key_col, n_queries: int):
    """(row positions, query positions) to score together: rows and queries of the same key only, and
    at most ``BLOCK_SCORES`` scores at once."""
    if q_keys is None:
        groups = [(np.arange(len(pdf)), np.arange(n_queries))]
    else:
        codes, names = pd.factorize(pdf[key_col])
        groups = [(np.flatnonzero(codes == i), np.flatnonzero(q_keys == name)) for i, name in enumerate(names)]
    for rows, cols in groups:
        if len(cols):
            step = max(1, BLOCK_SCORES // len(cols))
            for i in range(0, len(rows), step):
                yield rows[i:i + step], cols


def _as_matrix(vectors, dim: int | None = None, strict: bool = False) -> np.ndarray:
    """Stack vectors into a float64 matrix; shorter vectors are zero-padded to ``dim``
    (keyed search over models of different widths: padding keeps dot products
    and norms, and rows are only scored against queries of their own key)."""
    lens = {len(v) for v in vectors}
    if len(lens) == 1 and (dim is None or lens == {dim}):
        return np.stack(vectors).astype(np.float64)
    if strict:
        raise ValueError(f"corpus vector lengths {sorted(lens)} differ from the query width {dim}")
    dim = dim or max(lens)
    out = np.zeros((len(vectors), dim), dtype=np.float64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _emit(df, q_ids, q_keys, blk, out_q, id_col, key_col):
    q = df["_q"].to_numpy()
    cols = {out_q: q_ids[q], id_col: df["id"].to_numpy(), "score": df["score"].to_numpy(),
            "_blk": np.full(len(df), blk, dtype=np.int64)}
    if key_col is not None:
        cols[key_col] = q_keys[q]
    if "euc_score" in df:
        cols["euc_score"] = df["euc_score"].to_numpy()
    return pd.DataFrame(cols)


def search(queries: DataFrame, corpus: DataFrame, k: int | None = 10_000, *,
           query_id: str = "query_id", query_vec: str = "vector",
           id_col: str = "id", vec_col: str = "embedding", key: str | None = None,
           metric: str = "cosine", digits: int | None = 6,
           max_queries_per_pass: int = MAX_QUERIES_PER_PASS, fan_in: int = FAN_IN,
           prune: bool | None = None) -> DataFrame:
    """Exact top-k search (R1/R2): ``query_id, id, score, rank`` (+ ``key``).

    ``key``: score a query only against corpus rows with the same key value
    (e.g. a topic's candidate set, or a model's corpus).  ``k=None`` returns
    every (query, row) score without a rank.

    ``prune`` (default: when partitions x queries x k exceeds ``PRUNE_ROWS``):
    a probe pass keeps only the top ``ceil(2k / partitions)`` scores per query
    and partition; the k-th best of their union is a valid floor for the
    global k-th score, so the scoring pass ships only rows at or above it -
    about k rows per query in total instead of k per partition.  Exact: every
    true top-k row scores at least the floor, ties included.
    """
    spark = queries.sparkSession
    if k is None:
        max_queries_per_pass = min(max_queries_per_pass, MAX_QUERIES_UNCUT)
    else:
        max_queries_per_pass = max(1, min(max_queries_per_pass, MAX_BUFFER_ROWS // k))
    qcols = [query_id, query_vec] + ([key] if key else [])
    qsel = queries.select(*qcols).filter(F.col(query_vec).isNotNull())
    # one job both checks the bound and fetches the queries
    qpdf = qsel.limit(max_queries_per_pass + 1).toPandas()
    if len(qpdf) == 0:
        return _empty_result(queries, corpus, query_id, id_col, key, k, metric)
    if len(qpdf) > max_queries_per_pass:
        if k is not None and not key:
            return _search_many(qsel.withColumnsRenamed({query_id: "query_id", query_vec: "vector"}), corpus.select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding")),
                                k, metric, digits, max_queries_per_pass).withColumnsRenamed({"query_id": query_id, "id": id_col})
        parts = [search(q, corpus, k, query_id=query_id, query_vec=query_vec, id_col=id_col, vec_col=vec_col,
                        key=key, metric=metric, digits=digits, max_queries_per_pass=max_queries_per_pass,
                        fan_in=fan_in, prune=prune) for q in _passes(qsel, max_queries_per_pass)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    n_q = len(qpdf)
    if not key and len({len(v) for v in qpdf[query_vec]}) > 1:
        raise ValueError("query vectors differ in length (use key= to score groups of different widths)")
    Q = _as_matrix(qpdf[query_vec].to_numpy())
    if metric == "cosine":
        qn = np.linalg.norm(Q, axis=1)
        Q = Q / np.where(qn > 0, qn, 1.0)[:, None]
    qn2 = (Q * Q).sum(axis=1)
    q_ids = qpdf[query_id].to_numpy()
    q_keys = qpdf[key].to_numpy() if key else None
    bc = spark.sparkContext.broadcast((q_ids, q_keys, Q, qn2))

    from quarry.operators.common import partitions, spread
    ccols = [id_col, vec_col] + ([key] if key else [])
    csel = spread(corpus.select(*ccols))
    id_type = csel.schema[id_col].dataType
    fields = [T.StructField(query_id, queries.schema[query_id].dataType),
              T.StructField(id_col, id_type),
              T.StructField("score", T.DoubleType()),
              T.StructField("_blk", T.LongType())]
    if key:
        fields.append(T.StructField(key, queries.schema[key].dataType))
    if metric == "both":
        if k is not None:
            raise ValueError("two scores have no single ranking: metric='both' needs k=None")
        fields.append(T.StructField("euc_score", T.DoubleType()))
    n_parts = partitions(csel)
    tau_bc = None
    if k is not None and n_parts > 1 and (prune or (prune is None and n_parts * n_q * k > PRUNE_ROWS)):
        tau_bc = spark.sparkContext.broadcast(
            _score_floor(csel, bc, k, n_parts, metric, digits, id_col, vec_col, key, query_id, fan_in, n_q))
    partial = csel.mapInPandas(
        _make_scorer(bc, k, metric, digits, id_col, vec_col, key, query_id, fan_in, tau_bc=tau_bc),
        T.StructType(fields))
    if k is None:
        return partial.drop("_blk")

    merged = partial
    blocks = math.ceil(n_parts / fan_in)
    part = [query_id] + ([key] if key else [])
    while blocks > 1:
        w = Window.partitionBy(*part, "_blk").orderBy(F.col("score").desc(), F.col(id_col).asc())
        merged = (merged.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
                  .drop("_r").withColumn("_blk", F.floor(F.col("_blk") / fan_in).cast("long")))
        blocks = math.ceil(blocks / fan_in)
    w = Window.partitionBy(*part).orderBy(F.col("score").desc(), F.col(id_col).asc())
    out_cols = [query_id] + ([key] if key else []) + [id_col, "score", "rank"]
    return (merged.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(*out_cols))


def _search_many(queries: DataFrame, corpus: DataFrame, k: int, metric: str, digits: int | None, at_once: int) -> DataFrame:
    """``search`` for more queries than a pass holds, as one plan: query groups against corpus blocks.

    Both sides are dealt by row numbers, so no key is hot. A task holds one group and one block, scores at most ``at_once``
    queries together, and returns the block's k best rows per query; these are merged by one window. Shuffled are the corpus once
    per group, the queries once per block, and k rows per query and block. Memory of a task: ``BLOCK_NUMBERS`` components of
    the corpus, as many of the queries at most, and at most ``MAX_BUFFER_ROWS`` results."""
    from quarry.operators.common import materialize, rank_within, spread
    spark = queries.sparkSession
    queries = materialize(queries.withColumn("_n", F.monotonically_increasing_id()), "search-queries")
    corpus = corpus.where("embedding is not null")
    # the pass of a query by its position: queries of one id share a ranking within a pass
    part, first, total = F.shiftright("_n", 33), {}, 0
    for p, c in sorted((r["p"], r["count"]) for r in queries.groupBy(part.alias("p")).count().collect()):  # a row per partition
        first[p], total = total, total + c
    offset = F.element_at(F.create_map(*[F.lit(int(v)) for p in sorted(first) for v in (p, first[p])]), part.cast("int"))
    queries = queries.withColumn("_p", F.floor((offset + F.col("_n").bitwiseAND((1 << 33) - 1)) / at_once).cast("long"))
    m = queries.agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    if m["low"] != m["high"]:
        raise ValueError("query vectors differ in length (use key= to score groups of different widths)")
    rows = max(1, BLOCK_NUMBERS // max(1, m["high"]))
    n_blocks = max(1, -(-corpus.count() // rows))
    most = max(1, min(rows, MAX_BUFFER_ROWS // k))
    n_groups = max(1, -(-m["n"] // most), min(m["n"] // 256, -(-3 * spark.sparkContext.defaultParallelism // n_blocks)))
    # every row of a table has its own number; a hash of it deals evenly whatever the ids
    left = (spread(corpus).withColumn("_b", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int"))
            .withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))))
    right = (queries.select("query_id", "_p", "vector", F.pmod(F.xxhash64("_n"), F.lit(n_groups)).cast("int").alias("_g"))
             .withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))))

    def score(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return pd.DataFrame(columns=["query_id", "_p", "id", "score"], dtype=object)
        c = c.sort_values("id", kind="stable")  # places then break ties by id
        C = _as_matrix_of(c["embedding"].to_numpy(), m["high"])
        near = _near(C) if metric == "cosine" else None
        ids, asking, own, vectors = c["id"].to_numpy(), q["query_id"].to_numpy(), q["_p"].to_numpy(), q["vector"].to_numpy()
        out = []
        for i in range(0, len(q), min(at_once, TOGETHER)):
            Q = _as_matrix(vectors[i:i + min(at_once, TOGETHER)])
            if metric == "cosine":
                qn = np.linalg.norm(Q, axis=1)
                Q = Q / np.where(qn > 0, qn, 1.0)[:, None]
            cols, at, s = _best_rows(C, Q, k, metric, digits, near)
            out.append(pd.DataFrame({"query_id": asking[i + cols], "_p": own[i + cols], "id": ids[at], "score": s}))
        return pd.concat(out, ignore_index=True)

    schema = T.StructType([queries.schema["query_id"], T.StructField("_p", T.LongType()), corpus.schema["id"], T.StructField("score", T.DoubleType())])
    found = left.groupBy("_g", "_b").cogroup(right.groupBy("_g", "_b")).applyInPandas(score, schema)
    return rank_within(found, ["query_id", "_p"], [F.col("score").desc(), F.col("id").asc()], k).select("query_id", "id", "score", "rank")


def _as_matrix_of(vectors, dim: int) -> np.ndarray:
    """The vectors in their own type (a block of floats stays half as large); all of one length."""
    lens = {len(v) for v in vectors}
    if lens != {dim}:
        raise ValueError(f"corpus vector lengths {sorted(lens)} differ from the query width {dim}")
    return np.stack(vectors)


def _near(C: np.ndarray) -> np.ndarray | None:
    """The vectors at length one (those of length zero stay) in single precision, or None where some component is not finite."""
    out = np.empty(C.shape, np.float32)
    for i in range(0, len(C), 1 << 14):
        own = C[i:i + (1 << 14)].astype(np.float64)
        length = np.linalg.norm(own, axis=1)
        with np.errstate(invalid="ignore"):
            out[i:i + (1 << 14)] = own / np.where(length > 0, length, 1.0)[:, None]
    return out if np.isfinite(out).all() else None


def _true(flags: np.ndarray) -> np.ndarray:
    """Places of the few true ones of many flags: eight are looked at together."""
    n = len(flags) // 8 * 8
    words = np.flatnonzero(flags[:n].view(np.uint64))
    word, at = np.nonzero(flags[:n].reshape(-1, 8)[words])
    return np.concatenate([words[word] * 8 + at, n + np.flatnonzero(flags[n:])])


def _best_rows(C: np.ndarray, Q: np.ndarray, k: int, metric: str, digits: int | None,
               near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score): the k best rows per query, ties by row, scores rounded; pairs without a finite score are left out.

    Only scores that reach the k-th best so far are rounded and kept: rounding keeps the order, and a score that ties with the
    k-th best after rounding lies less than one unit below it. With ``near`` (cosine; see ``_near``) single precision finds
    the pairs that can reach it, its error bound included, and only these are scored in double precision."""
    n = len(Q)
    unit = 1.01 * 10.0 ** -digits if digits is not None else 0.0
    qn2, floor = (Q * Q).sum(axis=1), np.full(n, -np.inf)
    kept, held = [], 0
    use_near = near is not None and bool(np.isfinite(Q).all())
    # query, rounded score from the best on and row as one number, where they fit: sorting it is several times as fast
    top, at_bits = 10 ** max(digits or 0, 0) + 2, len(C).bit_length()
    score_bits = (2 * top).bit_length()
    one_key = use_near and digits is not None and digits >= 0 and n.bit_length() + score_bits + at_bits < 63

    def compact(parts):
        cols, at, s = (np.concatenate(p) for p in zip(*parts))
        if one_key:
            order = np.argsort((cols << (at_bits + score_bits)) + ((top - np.rint(s * 10 ** digits).astype(np.int64)) << at_bits) + at)
        else:
            order = np.lexsort((at, -s, cols))
        cols, at, s = cols[order], at[order], s[order]
        count = np.bincount(cols, minlength=n)
        place = np.arange(len(cols)) - (np.cumsum(count) - count)[cols]
        best = place < k
        last = place == k - 1
        floor[cols[last]] = np.maximum(floor[cols[last]], s[last])
        return cols[best], at[best], s[best]

    def keep(cols, rows, s):
        nonlocal kept, held
        kept.append((cols, rows, np_round_half_away(s, digits) if digits is not None else s))
        held += len(rows)
        if held > 4 * n * k:
            kept = [compact(kept)]
            held = len(kept[0][0])

    if use_near:
        # of a product of two vectors of length one, whatever the order of the sums
        error = 1.2e-7 * (Q.shape[1] + 8)
        Q32 = Q.astype(np.float32)
        step = max(1, min(len(C), max(NEAR_SCORES // n, 8 * k), BLOCK_SCORES // n))
        for i in range(0, len(C), step):
            S = Q32 @ near[i:i + step].T
            mask = S >= (floor - unit - error)[:, None].astype(np.float32)
            if np.count_nonzero(mask) > 2 * k and len(many := np.flatnonzero(np.count_nonzero(mask, axis=1) > 2 * k)):
                own = S[many]
                width = own.shape[1]
                floor[many] = np.maximum(floor[many], np.partition(own, width - k, axis=1)[:, width - k] - error)
                mask[many] = own >= (floor[many] - unit - error)[:, None].astype(np.float32)
            cols, rows = np.divmod(_true(mask.reshape(-1)), mask.shape[1])
            for a in range(0, len(cols), 1 << 16):
                q, at = cols[a:a + (1 << 16)], rows[a:a + (1 << 16)] + i
                own = C[at].astype(np.float64)
                length = np.linalg.norm(own, axis=1)
                keep(q, at, np.einsum("ij,ij->i", own, Q[q]) / np.where(length > 0, length, 1.0))
        return compact(kept)

    step = max(1, BLOCK_SCORES // n)
    for i in range(0, len(C), step):
        S = _score_block(C[i:i + step].astype(np.float64), Q, metric, qn2)
        if not np.isfinite(S.sum()):
            S = np.where(np.isfinite(S), S, -np.inf)
        mask = S >= floor - unit
        many = np.flatnonzero(mask.sum(axis=0) > 2 * k)
        if len(many):
            own = S[:, many]
            floor[many] = np.maximum(floor[many], np.partition(own, len(S) - k, axis=0)[len(S) - k])
            mask[:, many] = own >= floor[many] - unit
        rows, cols = np.nonzero(mask & (S > -np.inf) if not np.isfinite(floor).all() else mask)
        keep(cols, rows + i, S[rows, cols])
    return compact(kept)


def _passes(queries: DataFrame, size: int) -> list[DataFrame]:
    """The queries in passes of at most ``size``, by position: written once with a running number per
    partition; the counts per partition (a row each) turn it into a position."""
    from quarry.operators.common import materialize
    numbered = materialize(queries.withColumn("_n", F.monotonically_increasing_id()), "search-queries")
    part = F.shiftright("_n", 33)
    counts = sorted((r["p"], r["count"]) for r in numbered.groupBy(part.alias("p")).count().collect())
    out = []
    ranges = []  # (partition, first number, past the last number) of each pass
    cur, room = [], size
    for p, c in counts:
        start = 0
        while start < c:
            take = min(room, c - start)
            cur.append((p, start, start + take))
            start, room = start + take, room - take
            if room == 0:
                ranges.append(cur)
                cur, room = [], size
    if cur:
        ranges.append(cur)
    for own in ranges:
        inside = None
        for p, a, b in own:
            one = F.col("_n").between((p << 33) + a, (p << 33) + b - 1)
            inside = one if inside is None else inside | one
        out.append(numbered.where(inside).drop("_n"))
    return out


def _score_floor(csel, bc, k, n_parts, metric, digits, id_col, vec_col, key, query_id, fan_in, n_q):
    """Probe pass: per query, the k-th best score among the per-partition top-m lists
    (m = ceil(2k / partitions)); -inf where the union holds fewer than k rows."""
    m = max(1, math.ceil(2 * k / n_parts))
    probe = csel.mapInPandas(
        _make_scorer(bc, m, metric, digits, id_col, vec_col, key, query_id, fan_in, probe=True),
        "_q long, score double")
    w = Window.partitionBy("_q").orderBy(F.col("score").desc())
    kth = probe.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == k).select("_q", "score")
    tau = np.full(n_q, -np.inf)
    for r in kth.collect():  # one row per query (bounded by the query pass size)
        tau[r["_q"]] = r["score"]
    return tau


def _empty_result(queries, corpus, query_id, id_col, key, k, metric="cosine"):
    fields = [T.StructField(query_id, queries.schema[query_id].dataType),
              T.StructField(id_col, corpus.schema[id_col].dataType),
              T.StructField("score", T.DoubleType())]
    if key:
        fields.insert(1, T.StructField(key, queries.schema[key].dataType))
    if metric == "both":
        fields.append(T.StructField("euc_score", T.DoubleType()))
    if k is not None:
        fields.append(T.StructField("rank", T.IntegerType()))
    return queries.sparkSession.createDataFrame([], T.StructType(fields))


def score_models(queries: DataFrame, corpus: DataFrame, model: str = "model", query_id: str = "query_id",
                 query_vec: str = "vector", id_col: str = "id", vec_col: str = "embedding",
                 digits: int = 6) -> DataFrame:
    """For every model, every query against that model's corpus: cosine and
    negative Euclidean score, long form ``model, query_id, id, score, euc_score``.

    One pass of the blocked scorer keyed by model gives both scores of a pair, so
    only rows of the same model are paired and nothing is joined."""
    return (search(queries, corpus, None, metric="both", query_id=query_id, query_vec=query_vec, id_col=id_col, vec_col=vec_col,
                   key=model, digits=digits).select(model, query_id, id_col, "score", "euc_score"))


def attach_text(hits: DataFrame, texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Join document text to a cut result list (text stays out of the scoring stage)."""
    return hits.join(texts.select(id_col, text_col), id_col, "left")


def score_pairs_vec(pairs: DataFrame, a: str, b: str, metric: str = "cosine", digits: int | None = 6,
                    out: str = "score") -> DataFrame:
    """Score already-paired vectors (rows joined on id/topic/model) with Column expressions."""
    expr = cosine(a, b) if metric == "cosine" else neg_euclidean(a, b)
    if digits is not None:
        expr = round_half_away(expr, digits)
    return pairs.withColumn(out, expr)


def nearest(queries: DataFrame, corpus: DataFrame, exclude: DataFrame | None = None, **kw) -> DataFrame:
    """The best corpus row per query that is not in ``exclude`` (ids)."""
    id_col = kw.get("id_col", "id")
    if exclude is not None:
        corpus = corpus.join(exclude.select(id_col).distinct(), id_col, "left_anti")
    return search(queries, corpus, 1, **kw)


def vector_parity(a: DataFrame, b: DataFrame, id_col: str = "id", vec_col: str = "embedding",
                  min_sim: float = 0.99, digits: int = 6) -> DataFrame:
    """Per-id cosine between two versions of the vectors, flagged against ``min_sim``."""
    j = a.select(id_col, F.col(vec_col).alias("_a")).join(
        b.select(id_col, F.col(vec_col).alias("_b")), id_col)
    return (j.select(id_col, round_half_away(cosine("_a", "_b"), digits).alias("cosine"))
            .withColumn("ok", F.col("cosine") >= F.lit(min_sim)))


def search_approx(queries: DataFrame, corpus: DataFrame, k: int, *, query_id: str = "query_id",
                  query_vec: str = "vector", id_col: str = "id", vec_col: str = "embedding",
                  cells: int | None = None, probes: int | None = None, digits: int = 6) -> DataFrame:
    """Approximate nearest neighbours: ``query_id, id, score, rank``, scores exact.

    Trains an index over ``corpus`` in the shared folder and asks it. To ask the same corpus again, keep the
    index (``vector_index.build``, ``open_index``, ``search_index``). Without ``probes`` they are measured for
    the recall that ``vector_index.TARGET`` names."""
    from quarry.operators import vector_index as vi
    from quarry.sources.io import scratch_path
    index = vi.build(corpus, scratch_path(corpus.sparkSession, "vector-index"), id_col, vec_col, cells)
    return vi.search_index(queries, index, k, query_id=query_id, query_vec=query_vec, id_col=id_col, probes=probes, digits=digits)


def compare_search(a: DataFrame, b: DataFrame, cps: DataFrame, topic: str = "topic", id_col: str = "id") -> DataFrame:
    """Per topic, recall of run a and run b against cps and the size of their id overlap."""
    ca = cps.select(topic, id_col).distinct()
    ra = a.select(topic, id_col).distinct()
    rb = b.select(topic, id_col).distinct()
    n_cps = ca.groupBy(topic).agg(F.count("*").alias("n_cps"))
    fa = ra.join(ca, [topic, id_col], "left_semi").groupBy(topic).agg(F.count("*").alias("found_a"))
    fb = rb.join(ca, [topic, id_col], "left_semi").groupBy(topic).agg(F.count("*").alias("found_b"))
    both = ra.join(rb, [topic, id_col]).groupBy(topic).agg(F.count("*").alias("overlap"))
    out = (n_cps.join(fa, topic, "left").join(fb, topic, "left").join(both, topic, "left")
           .na.fill(0, ["found_a", "found_b", "overlap"]))
    return out.select(topic, "n_cps", "found_a", "found_b", "overlap",
                      (F.col("found_a") / F.col("n_cps")).alias("recall_a"),
                      (F.col("found_b") / F.col("n_cps")).alias("recall_b"))
