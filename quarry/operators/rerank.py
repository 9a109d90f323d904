"""Keyword scoring, reranking and rank fusion.

BM25Plus is computed from a postings table (group, doc, term, tf): the query
terms are a small side that is broadcast against the postings, so a term that
occurs in a third of all documents is joined map-side without a hot shuffle
key; per-(query, doc) sums use partial aggregation.  A cut over one corpus-wide
group never has a row per (query, doc): buckets of documents keep their own best
rows per query (``_best_of_buckets``).  Documents that contain no
query term all share the query's constant ``delta * sum(qf * idf)``; they are
only materialised (smallest ids first) where a ranking cut needs them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text as tx
from quarry.functions.vectors import np_round_half_away, round_half_away
from quarry.operators.common import MAX_BROADCAST_ROWS, materialize, rank_within, spread

# Fixed values of the reference's keyword scorer (BM25Plus defaults) and of its fusion.
BM25_K1 = 1.5
BM25_B = 0.75
BM25_DELTA = 1.0
RRF_C = 60
# A stop list given as a table goes into the token expression up to this size.
MAX_STOP_WORDS = 20_000
# Corpus-wide scores: documents of a bucket, and (query, document) scores held at once in its task (32 MB).
# A smaller corpus is scored by rows, in one plan that writes nothing.
ROW_DOCS = 5000
BUCKET_DOCS = 8192
BUCKET_SCORES = 4_000_000


def tokenize(df: DataFrame, text_col: str, keys: list[str], stop_words: DataFrame | list[str] | None = None,
             out: str = "term") -> DataFrame:
    """One row per token occurrence: ``keys..., term`` (lower, whitespace split,
    ASCII punctuation stripped at both ends, empty and stop words dropped)."""
    toks = spread(df).select(*keys, explode_tokens(tx.tokens(text_col), out)).filter(F.col(out).isNotNull())
    return remove_stop_words(toks, stop_words, out)


def explode_tokens(arr, out: str = "term"):
    """One row per token.  ``explode_outer`` + a null filter instead of ``explode``:
    an inner explode makes Catalyst infer a ``size(tokens) > 0`` filter below the
    generator, which would tokenise every text twice (once before any repartition)."""
    return F.explode_outer(arr).alias(out)


def remove_stop_words(toks: DataFrame, stop_words, col: str = "term") -> DataFrame:
    if stop_words is None:
        return toks
    if isinstance(stop_words, (list, tuple, set)):
        stop_words = toks.sparkSession.createDataFrame([(w,) for w in sorted(set(stop_words))], [col])
    from quarry.operators.common import broadcast_if_small
    return toks.join(broadcast_if_small(stop_words.select(F.col(stop_words.columns[0]).alias(col))), col, "left_anti")


def token_arrays(df: DataFrame, text_col: str, keys: list[str], stop_words=None) -> DataFrame:
    """Token array per row (stop words removed inside the array, so empty docs stay)."""
    arr = tx.tokens(F.coalesce(F.col(text_col), F.lit("")))
    if isinstance(stop_words, DataFrame):  # a list of bounded size, checked
        rows = stop_words.select(stop_words.columns[0]).distinct().limit(MAX_STOP_WORDS + 1).collect()
        if len(rows) > MAX_STOP_WORDS:
            raise ValueError(f"a stop list of more than {MAX_STOP_WORDS} words; filter the tokens by an anti join instead")
        stop_words = [r[0] for r in rows if r[0] is not None]
    if stop_words:
        sw = F.array(*[F.lit(w) for w in sorted(set(stop_words))])
        arr = F.filter(arr, lambda t: ~F.array_contains(sw, t))
    return df.select(*keys, arr.alias("_toks"))


def bm25_plus(queries: DataFrame, docs: DataFrame, k: int | None = 10, *, group: str | None = None,
              query_id: str = "query_id", query_text: str = "query", doc_id: str = "id", doc_text: str = "text",
              k1: float = BM25_K1, b: float = BM25_B, delta: float = BM25_DELTA, stop_words=None,
              digits: int | None = 4, fill: bool = False) -> DataFrame:
    """BM25Plus scores of documents for keyword queries, top k per query.

    ``group``: documents and queries carry a group key (e.g. topic); corpus
    statistics (N, avgdl, df) are per group and a query only scores its
    group's documents - the reference scores each topic's candidate set.
    ``fill``: when fewer than k documents match, complete the ranking with
    non-matching documents (constant score) by ascending id.
    Output: ``[group], query_id, id, score, rank``.
    """
    if group is None and k is not None and not fill and k1 >= 0 and 0 <= b <= 1 and docs.select(doc_id).limit(ROW_DOCS + 1).count() > ROW_DOCS:
        qterms = (token_arrays(queries, query_text, [query_id], stop_words).select(query_id, explode_tokens("_toks")).filter(F.col("term").isNotNull())
                  .groupBy(query_id, "term").agg(F.count("*").alias("_qf")))
        if qterms.count() <= MAX_BROADCAST_ROWS:
            return _best_of_buckets(qterms, docs, k, query_id, doc_id, doc_text, k1, b, delta, stop_words, digits)
    if group is None:
        docs = docs.withColumn("_g", F.lit(0))
        queries = queries.withColumn("_g", F.lit(0))
        out = bm25_plus(queries, docs, k, group="_g", query_id=query_id, query_text=query_text, doc_id=doc_id,
                        doc_text=doc_text, k1=k1, b=b, delta=delta, stop_words=stop_words, digits=digits, fill=fill)
        return out.drop("_g")
    g = [group]
    qtok = token_arrays(queries, query_text, g + [query_id], stop_words)
    qterms = (qtok.select(*g, query_id, explode_tokens("_toks")).filter(F.col("term").isNotNull())
              .groupBy(*g, query_id, "term").agg(F.count("*").alias("_qf")))
    small_q = qterms.count() <= MAX_BROADCAST_ROWS  # query side only: no corpus work in this check
    # The corpus is tokenised for the lengths (averaged map-side) and for the postings.  Only tokens that
    # some query has leave the row: they are cut by the (broadcast) query vocabulary before any exchange.
    dtok = token_arrays(spread(docs), doc_text, g + [doc_id], stop_words)
    vocab = qterms.select(*g, "term").distinct()
    qpost = (dtok.select(*g, doc_id, F.size("_toks").alias("_dl"), explode_tokens("_toks"))
             .filter(F.col("term").isNotNull())
             .join(F.broadcast(vocab) if small_q else vocab, g + ["term"], "left_semi")
             .groupBy(*g, doc_id, "_dl", "term").agg(F.count("*").alias("_tf")))
    if group == "_g":
        # one corpus-wide group: N and avgdl are scalar subqueries (run once, no join)
        n_all = docs.agg(F.count("*")).scalar()
        avgdl_all = dtok.agg(F.avg(F.size("_toks"))).scalar()
        stats = None
    else:
        stats = dtok.groupBy(*g).agg(F.count("*").alias("_N"), F.avg(F.size("_toks")).alias("_avgdl"))
    dfreq = qpost.groupBy(*g, "term").agg(F.count("*").alias("_df"))
    if stats is None:
        idf = dfreq.select(*g, "term", F.log((n_all + 1) / F.col("_df")).alias("_idf"), avgdl_all.alias("_avgdl"))
    else:
        idf = dfreq.join(stats, g).select(
            *g, "term", F.log((F.col("_N") + 1) / F.col("_df")).alias("_idf"), "_avgdl")
    qterms = qterms.join(idf, g + ["term"], "left").na.fill(0.0, ["_idf"])
    # every query has a constant; one without any term (all stop words) has 0
    const = (queries.select(*g, query_id).distinct()
             .join(qterms.groupBy(*g, query_id).agg(F.sum(F.col("_qf") * F.col("_idf") * F.lit(delta)).alias("_c")), g + [query_id], "left")
             .na.fill(0.0, ["_c"]))
    if small_q:
        const = F.broadcast(const)  # at most a row per query; the query side was counted
    qside = qterms.filter(F.col("_idf") > 0).select(*g, query_id, "term", "_qf", "_idf", "_avgdl")
    if small_q:
        qside = F.broadcast(qside)
    contrib = (qpost.join(qside, g + ["term"])
               .select(*g, query_id, doc_id,
                       (F.col("_qf") * F.col("_idf") * (F.col("_tf") * (k1 + 1)) /
                        (F.col("_tf") + k1 * (1 - b + b * F.col("_dl") / F.col("_avgdl")))).alias("_s")))
    matched = contrib.groupBy(*g, query_id, doc_id).agg(F.sum("_s").alias("_s"))
    scored = matched.join(const, g + [query_id]).select(*g, query_id, doc_id, (F.col("_s") + F.col("_c")).alias("score"))
    if digits is not None:
        scored = scored.withColumn("score", round_half_away("score", digits))
    if fill and k is None:
        # every document of the group, matched or not, for every query: the output is all pairs by request
        scored = scored.unionByName(_unmatched(docs, queries, scored, const, g, query_id, doc_id, digits))
    elif fill:
        per_group = queries.groupBy(*g).agg(F.countDistinct(query_id).alias("_nq")).agg(F.max("_nq")).first()[0]
        if (per_group or 0) <= 1:
            # one query per group (a topic's own query over its candidates): the
            # unmatched documents are the group's documents minus the matches -
            # linear in the group, no pairs
            scored = scored.unionByName(_unmatched(docs, queries, scored, const, g, query_id, doc_id, digits))
        else:
            # several queries share a group: take only the smallest ids, bounded by
            # k + the largest match count, which needs the matches first
            scored = materialize(scored, "bm25-matched")
            scored = scored.unionByName(
                _fill_unmatched(docs, queries, scored, const, g, query_id, doc_id, k, digits))
    order = [F.col("score").desc(), F.col(doc_id).asc()]
    if k is None:
        return scored
    return rank_within(scored, g + [query_id], order, k)


def _best_of_buckets(qterms: DataFrame, docs: DataFrame, k: int, query_id: str, doc_id: str, doc_text: str,
                     k1: float, b: float, delta: float, stop_words, digits: int | None) -> DataFrame:
    """``bm25_plus`` over one corpus-wide group with a cut: ``query_id, id, score, rank``.

    A task counts the query terms of each text where it stands and writes a packed row per document: its length, the terms' numbers
    and counts. These few bytes are dealt to buckets of about ``BUCKET_DOCS`` documents by a hash of the id, twice: for the document
    frequencies, and for the scores, term by term against the queries that have it; a bucket returns its k best documents per query. So
    neither tokens nor (query, document) pairs are shuffled or held as rows. Rows of one id and length count as one document, as do all
    rows of one id for a score. The query side was counted (at most ``MAX_BROADCAST_ROWS`` rows)."""
    spark = docs.sparkSession
    vocab = qterms.select("term").distinct().toArrow().column("term").combine_chunks().cast(pa.string())
    if isinstance(stop_words, DataFrame):  # checked by ``token_arrays``
        stop_words = [r[0] for r in stop_words.select(stop_words.columns[0]).distinct().collect() if r[0] is not None]
    shared = spark.sparkContext.broadcast((vocab, pa.array(sorted(set(stop_words or [])), pa.string())))
    toks = token_arrays(spread(docs), doc_text, [doc_id]).select(F.col(doc_id).alias("_id"), "_toks")
    id_field = toks.schema["_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stop = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                own = batch.slice(at, 1024)
                lists = own.column("_toks")
                size, flat = np.asarray(pc.list_value_length(lists), np.int64), lists.flatten()
                row = np.repeat(np.arange(len(size)), size)
                if len(stop):
                    size = size - np.bincount(row, np.asarray(pc.is_in(flat, stop)), len(size)).astype(np.int64)
                term = np.asarray(pc.fill_null(pc.index_in(flat, words), -1), np.int64)
                known = term >= 0
                key, tf = np.unique(row[known] * len(words) + term[known], return_counts=True)
                row, term = np.divmod(key, max(len(words), 1))
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(size)))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([own.column("_id"), pa.array(size), *lists], ["_id", "_dl", "_term", "_tf"])

    fields = [id_field, T.StructField("_dl", T.LongType()), T.StructField("_term", T.ArrayType(T.IntegerType())), T.StructField("_tf", T.ArrayType(T.IntegerType()))]
    packed = materialize(toks.mapInArrow(pack, T.StructType(fields)), "bm25-documents")
    n_all, avgdl = packed.agg(F.count("*"), F.avg("_dl")).first()
    buckets = max(1, -(-n_all // BUCKET_DOCS))
    dealt = packed.where(F.size("_term") > 0).withColumn("_b", F.pmod(F.xxhash64("_id"), F.lit(buckets)).cast("int")).groupBy("_b")

    def documents(table: pa.Table):
        """(ids in order, number of the id of each document, its length; document, term and count of each posting)."""
        table = table.combine_chunks()
        ids = table.column("_id").combine_chunks()
        order = pc.sort_indices(pa.table({"x": ids}), sort_keys=[("x", "ascending")], null_placement="at_start")
        seen = ids.take(order).dictionary_encode(null_encoding="encode")
        own = np.empty(len(ids), np.int64)
        own[np.asarray(order)] = np.asarray(seen.indices)
        dl = np.asarray(table.column("_dl"))
        keys, doc = np.unique(np.stack([own, dl]), axis=1, return_inverse=True)
        terms = table.column("_term").combine_chunks()
        size = np.asarray(pc.list_value_length(terms), np.int64)
        posting = np.repeat(doc.reshape(-1), size) * len(vocab) + np.asarray(terms.flatten(), np.int64)
        posting, place = np.unique(posting, return_inverse=True)
        tf = np.bincount(place, np.asarray(table.column("_tf").combine_chunks().flatten()), len(posting))
        return seen.dictionary, keys[0], keys[1], posting // len(vocab), posting % len(vocab), tf

    def frequencies(table: pa.Table) -> pa.Table:
        count = np.bincount(documents(table)[4], minlength=len(vocab))
        at = np.flatnonzero(count)
        return pa.table({"_t": pa.array(at.astype(np.int32)), "_df": pa.array(count[at])})

    numbers = spark.createDataFrame(pa.table({"term": vocab, "_t": pa.array(np.arange(len(vocab), dtype=np.int32))}))
    dfreq = dealt.applyInArrow(frequencies, "_t int, _df long").groupBy("_t").agg(F.sum("_df").alias("_df"))
    qterms = materialize(qterms.join(numbers, "term").join(dfreq, "_t", "left")
                         .select(query_id, "_t", "_qf", F.coalesce(F.log((F.lit(n_all) + 1) / F.col("_df")), F.lit(0.0)).alias("_idf")), "bm25-queries")
    const = qterms.groupBy(query_id).agg(F.sum(F.col("_qf") * F.col("_idf") * F.lit(delta)).alias("_c"))
    asked = qterms.where("_idf > 0").join(const, query_id).select(query_id, "_c", "_t", (F.col("_qf") * F.col("_idf")).alias("_w")).toArrow().combine_chunks()
    names = asked.column(query_id).combine_chunks().dictionary_encode() if asked.num_rows else None
    if names is None:
        sides = None
    else:
        query, t, w = np.asarray(names.indices, np.int64), np.asarray(asked.column("_t"), np.int64), np.asarray(asked.column("_w"))
        by_term = np.argsort(t, kind="stable")
        c = np.zeros(len(names.dictionary))
        c[query] = np.asarray(asked.column("_c"))
        sides = (names.dictionary, c, query[by_term], t[by_term], w[by_term])
    side = spark.sparkContext.broadcast(sides)

    def best(table: pa.Table) -> pa.Table:
        ids, own, dl, doc, term, tf = documents(table)
        names, c, query, t, w = side.value
        x = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / avgdl))
        order = np.argsort(term, kind="stable")
        doc, term, x = doc[order], term[order], x[order]
        used = np.unique(term)
        first, last = np.searchsorted(term, used), np.searchsorted(term, used, "right")
        starts = np.flatnonzero(np.diff(own, prepend=-1))  # documents of one id stand together
        out = []
        step = max(1, BUCKET_SCORES // len(dl))
        for q0 in range(0, len(names), step):
            n = min(step, len(names) - q0)
            inside = (query >= q0) & (query < q0 + n)
            qs, ts, ws = query[inside] - q0, t[inside], w[inside]
            S = np.zeros((n, len(dl)))
            lo, hi = np.searchsorted(ts, used), np.searchsorted(ts, used, "right")
            for i in np.flatnonzero(hi > lo):
                d = slice(first[i], last[i])
                S[qs[lo[i]:hi[i], None], doc[None, d]] += ws[lo[i]:hi[i], None] * x[None, d]
            S = np.add.reduceat(S, starts, axis=1)
            matched = S > 0
            S += c[q0:q0 + n, None]
            if digits is not None:
                S = np_round_half_away(S, digits)
            S[~matched] = -np.inf
            if S.shape[1] > k:
                matched &= S >= np.partition(S, S.shape[1] - k, axis=1)[:, S.shape[1] - k, None]
            q, d = np.nonzero(matched)
            s = S[q, d]
            order = np.lexsort((d, -s, q))
            q, d, s = q[order], d[order], s[order]
            count = np.bincount(q, minlength=n)
            keep = np.arange(len(q)) - (np.cumsum(count) - count)[q] < k
            out.append((q[keep] + q0, d[keep], s[keep]))
        q, d, s = (np.concatenate(y) for y in zip(*out))
        return pa.table([names.take(pa.array(q)), ids.take(pa.array(own[starts][d])), pa.array(s)], names=[query_id, doc_id, "score"])

    schema = T.StructType([qterms.schema[query_id], T.StructField(doc_id, id_field.dataType), T.StructField("score", T.DoubleType())])
    scored = spark.createDataFrame([], schema) if sides is None else dealt.applyInArrow(best, schema)
    return rank_within(scored, [query_id], [F.col("score").desc(), F.col(doc_id).asc()], k)


def _unmatched(docs, queries, scored, const, g, query_id, doc_id, digits):
    """Every document of a query's group that it does not match, with the query's constant."""
    rest = (docs.select(*g, doc_id).join(queries.select(*g, query_id).distinct(), g)
            .join(scored.select(*g, query_id, doc_id), g + [query_id, doc_id], "left_anti"))
    c = const.select(*g, query_id, (round_half_away("_c", digits) if digits is not None else F.col("_c")).alias("score"))
    return rest.join(c, g + [query_id]).select(*g, query_id, doc_id, "score")


def _fill_unmatched(docs, queries, matched, const, g, query_id, doc_id, k, digits):
    """The smallest-id non-matching documents of each query's group, at most k + the
    query's match count (bounded by k per query, never all pairs)."""
    w = Window.partitionBy(*g).orderBy(doc_id)
    n_match = matched.groupBy(*g, query_id).agg(F.count("*").alias("_m"))
    max_m = n_match.agg(F.max("_m")).first()[0] or 0
    first_docs = docs.select(*g, doc_id).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k + max_m)
    qs = queries.select(*g, query_id).distinct()
    pairs = qs.join(first_docs, g)
    rest = pairs.join(matched.select(*g, query_id, doc_id), g + [query_id, doc_id], "left_anti")
    c = const.select(*g, query_id, (round_half_away("_c", digits) if digits is not None else F.col("_c")).alias("score"))
    return rest.join(c, g + [query_id]).select(*g, query_id, doc_id, "score")


def rrf(rankings: DataFrame, keys: list[str], method: str = "method", id_col: str = "id",
        rank_col: str | None = "rank", score_col: str | None = None, c: int = RRF_C,
        k: int | None = None, digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion, ``sum(1 / (rank0 + c))`` with 0-based ranks.

    Rankings given by score are ranked first (score desc, id asc); rankings
    given by rank keep it.  Output ``keys..., id, rrf, rank`` (rank 1-based,
    ties by id)."""
    if score_col is not None:
        w = Window.partitionBy(*keys, method).orderBy(F.col(score_col).desc(), F.col(id_col).asc())
        rankings = rankings.withColumn("_r0", F.row_number().over(w) - 1)
    else:
        rankings = rankings.withColumn("_r0", F.col(rank_col) - 1)
    fused = (rankings.groupBy(*keys, id_col).agg(F.sum(1.0 / (F.col("_r0") + F.lit(c))).alias("rrf"))
             .withColumn("rrf", round_half_away("rrf", digits)))
    return rank_within(fused, keys, [F.col("rrf").desc(), F.col(id_col).asc()], k)


def token_overlap(query_col: str, doc_col: str):
    """Share of the distinct query tokens that the document has (0 for a query without tokens)."""
    q = F.array_distinct(tx.tokens(F.coalesce(F.col(query_col), F.lit(""))))
    d = tx.tokens(F.coalesce(F.col(doc_col), F.lit("")))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, d)) / F.size(q))


def score_pairs(pairs: DataFrame, keys: list[str], query_col: str = "query", doc_col: str = "text",
                id_col: str = "id", scorer_factory: Callable | None = None, k: int | None = None) -> DataFrame:
    """Cross-encoder style (query, doc) -> score, ranked within keys.

    Default: ``token_overlap``, rounded to 9 digits, in the JVM.  ``scorer_factory()`` runs once per Python worker and returns
    ``f(queries: Series, docs: Series) -> Series``."""
    if scorer_factory is None:
        own = pairs.select(*keys, id_col, round_half_away(token_overlap(query_col, doc_col), 9).alias("score"))
        return rank_within(own, keys, [F.col("score").desc(), F.col(id_col).asc()], k)

    def run(batches):
        f = scorer_factory()
        for pdf in batches:
            pdf = pdf.copy()
            pdf["score"] = f(pdf[query_col], pdf[doc_col]).to_numpy()
            yield pdf

    sel = pairs.select(*keys, id_col, query_col, doc_col)
    schema = T.StructType(list(sel.schema.fields) + [T.StructField("score", T.DoubleType())])
    scored = sel.mapInPandas(run, schema).drop(query_col, doc_col)
    return rank_within(scored, keys, [F.col("score").desc(), F.col(id_col).asc()], k)


def topic_documents(run: DataFrame, topic: str = "topic", query_col: str = "query") -> DataFrame:
    """Per topic its query text (an array of texts joined by newline) and its candidates."""
    qt = run.schema[query_col].dataType
    q = F.array_join(F.col(query_col), "\n") if isinstance(qt, T.ArrayType) else F.col(query_col)
    return run.withColumn(query_col, q)


def rerank_by_vector(candidates: DataFrame, query_vectors: DataFrame, top_n: int, topic: str = "topic",
                     id_col: str = "id", vec_col: str = "embedding", query_vec: str = "vector") -> DataFrame:
    """Bi-encoder reranking of each topic's candidates by cosine to the topic's query vector."""
    from quarry.operators.search import search
    q = query_vectors.select(F.col(topic).alias("_qid"), topic, query_vec)
    hits = search(q, candidates.select(id_col, vec_col, topic), top_n, query_id="_qid", query_vec=query_vec,
                  id_col=id_col, vec_col=vec_col, key=topic)
    return hits.drop("_qid")


def cut_per_topic(long_rank: DataFrame, top_n, topic: str = "topic", rank_col: str = "rank") -> DataFrame:
    """Cut a long ranking at an int or at a per-topic n (DataFrame ``topic, top_n``)."""
    if isinstance(top_n, int):
        return long_rank.filter(F.col(rank_col) <= top_n)
    # one row per topic
    return long_rank.join(top_n.select(topic, "top_n"), topic).filter(
        F.col(rank_col) <= F.col("top_n")).drop("top_n")


def rerank_all(methods: dict[str, DataFrame], top_n, topic: str = "topic", id_col: str = "id",
               c: int = RRF_C) -> DataFrame:
    """Every method's ranking per topic (long form ``topic, id, rank``), cut at the
    topic's n, then fused last by RRF.  Output ``topic, method, id, rank``."""
    parts = None
    for name, df in methods.items():
        p = cut_per_topic(df.select(topic, id_col, "rank"), top_n, topic).withColumn("method", F.lit(name))
        parts = p if parts is None else parts.unionByName(p)
    fused = rrf(parts, [topic], c=c)
    fused = cut_per_topic(fused, top_n, topic).select(topic, F.lit("rrf").alias("method"), id_col, "rank")
    return parts.select(topic, "method", id_col, "rank").unionByName(fused)


def rerank_merge(reranked: DataFrame, base_run: DataFrame, topic: str = "topic", id_col: str = "id",
                 c: int = RRF_C, methods: list[str] | None = None) -> DataFrame:
    """Add the base ranking as one more method, cut at the reranked list's
    length per topic, fuse everything by RRF and cut the fused list at that
    length too: ``topic, id, rrf, rank``."""
    r = reranked if methods is None else reranked.filter(F.col("method").isin(methods))
    length = r.groupBy(topic).agg(F.max("rank").alias("top_n"))
    base = cut_per_topic(base_run.select(topic, id_col, "rank"), length, topic).withColumn("method", F.lit("base"))
    fused = rrf(r.select(topic, "method", id_col, "rank").unionByName(base.select(topic, "method", id_col, "rank")),
                [topic], c=c)
    return cut_per_topic(fused, length, topic)


def hyqe_rerank(run: DataFrame, generated: DataFrame, top_n: int, topic: str = "topic", id_col: str = "id",
                text_col: str = "text", query_col: str = "query", fill: bool = True) -> DataFrame:
    """BM25Plus with a generated keyword query per topic over the topic's candidates, cut at n."""
    docs = run.select(topic, id_col, text_col).distinct()
    q = generated.select(topic, F.col(topic).alias("_qid"), F.col(query_col).alias("_q"))
    out = bm25_plus(q, docs, top_n, group=topic, query_id="_qid", query_text="_q", doc_id=id_col,
                    doc_text=text_col, fill=fill)
    return out.drop("_qid")
