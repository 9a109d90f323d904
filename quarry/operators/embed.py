"""Embedding and query construction.

Query texts are built with array/string expressions per topic; encoders run
inside ``mapInPandas`` (one model load per Python worker, Arrow batches).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text as tx
from quarry.functions.vectors import mean_vector

# ---------------------------------------------------------------------------
# query/passage prefixes per model profile, and the question
# layout of a topic query.
PROFILES = {
    "e5": {"query": "query: ", "passage": "passage: "},
    "linq": {"query": "Instruct: Given a research question, retrieve passages that answer the question.\nQuery:",
             "passage": ""},
    "qwen2": {"query": "Instruct: Given a research question, retrieve passages that answer the question.\nQuery:",
              "passage": ""},
    "nvembed": {"query": "Instruct: Given a title and an abstract, retrieve the passage that is the most relevant "
                         "to the title and abstract.\nQuery: ",
                "passage": ""},
    "s2p": {"query": "Instruct: Given a web search query, retrieve relevant passages that answer the query.\nQuery: ",
            "passage": ""},
    "s2s": {"query": "Instruct: Retrieve semantically similar text.\nQuery: ", "passage": ""},
    "none": {"query": "", "passage": ""},
}
# Profiles whose model wants its end token after every text.
SUFFIXES = {"nvembed": "</s>"}
SUPPORTED_QUESTIONS = "Research Questions:\n{questions} [SEP] Supporting Documents:\n {text}"
TRUNCATE_CHARS = 6000
FIRST_SEED = 42
# ---------------------------------------------------------------------------


def prefix_text(df: DataFrame, text_col: str, role: str, profile: str, out: str | None = None) -> DataFrame:
    """Prepend a model's query or passage prefix (and append its end token, where it has one)."""
    p = PROFILES[profile][role]
    return df.withColumn(out or text_col, F.concat(F.lit(p), F.col(text_col), F.lit(SUFFIXES.get(profile, ""))))


def truncate_text(df: DataFrame, text_col: str, n: int = TRUNCATE_CHARS, out: str | None = None) -> DataFrame:
    """First n characters."""
    return df.withColumn(out or text_col, F.substring(F.col(text_col), 1, n))


def questions_block(rqs, rq_count, include_sub) -> F.Column:
    """``RQi: main\\n`` lines (and ``RQi.j: sub\\n`` lines) of the first rq_count questions.

    ``rqs``: array of struct(rq_no, main, subs) sorted by rq_no.  Numbering
    follows the position, as the questions are taken in order."""
    rq_count = F.lit(rq_count) if isinstance(rq_count, int) else rq_count
    include_sub = F.lit(include_sub) if isinstance(include_sub, bool) else include_sub
    first = F.slice(rqs, 1, rq_count)

    def one(rq, i):
        n = (i + 1).cast("string")
        head = F.concat(F.lit("RQ"), n, F.lit(": "), rq["main"], F.lit("\n"))
        subs = F.array_join(F.transform(rq["subs"], lambda s, j: F.concat(
            F.lit("RQ"), n, F.lit("."), (j + 1).cast("string"), F.lit(": "), s, F.lit("\n"))), "")
        return F.concat(head, F.when(include_sub, subs).otherwise(F.lit("")))

    return F.array_join(F.transform(first, one), "")


def topic_questions(cfg: DataFrame) -> DataFrame:
    """Per topic: its questions as a sorted array (bounded by the questions of one topic)."""
    return cfg.groupBy("topic").agg(
        F.array_sort(F.collect_list(F.struct("rq_no", "main", "subs"))).alias("rqs"))


def format_questions(cfg: DataFrame, rq_count: int = 1, include_sub: bool = False,
                     texts: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """The question block per topic; with ``texts`` (topic, ..., text) one
    query per supporting text: ``Research Questions:\\n<rqs> [SEP] Supporting Documents:\\n <text>``."""
    q = topic_questions(cfg).select("topic", questions_block(F.col("rqs"), rq_count, include_sub).alias("query"))
    if texts is None:
        return q
    return texts.join(q, "topic").withColumn(
        "query", tx.render(SUPPORTED_QUESTIONS, questions=F.col("query"), text=F.col(text_col)))


# The question counts of the query-structure grid.
GRID_RQ_COUNTS = (1, 3, 5, 100)


def query_grid(cfg: DataFrame, texts: DataFrame | None = None, rq_counts=GRID_RQ_COUNTS,
               has_text=(True, False), include_sub=(True, False), text_col: str = "text") -> DataFrame:
    """E5: every (rq_count, has_text, include_sub) variant per topic (4 x 2 x 2).

    The grid is a literal array exploded per topic (a generator, no join)."""
    grid = F.array(*[F.struct(F.lit(r).alias("rq_count"), F.lit(h).alias("has_text"), F.lit(s).alias("include_sub"))
                     for r in rq_counts for h in has_text for s in include_sub])
    tq = topic_questions(cfg)
    v = tq.select("topic", "rqs", F.explode(grid).alias("g")).select("topic", "rqs", "g.*")
    block = questions_block(F.col("rqs"), F.col("rq_count"), F.col("include_sub"))
    v = v.withColumn("questions", block).drop("rqs")
    if texts is not None:
        v = v.join(texts.select("topic", F.col(text_col).alias("_t")), "topic", "left")
    else:
        v = v.withColumn("_t", F.lit(None).cast("string"))
    return v.withColumn("query", F.when(
        F.col("has_text"), tx.render(SUPPORTED_QUESTIONS, questions=F.col("questions"), text=F.col("_t")))
        .otherwise(F.col("questions"))).drop("_t", "questions")


def centroid(df: DataFrame, key_cols: list[str], vec_col: str = "embedding", out: str = "vector") -> DataFrame:
    """Mean vector per key (several texts of one query averaged)."""
    return mean_vector(df, key_cols, vec_col, out)


# E7 request texts (our wording); {field} is the research field
PROMPTS = {
    "similar_doc": ("As an expert in {field}, write the title and abstract of a research paper on the same "
                    "problem as the given publication. Answer as JSON with keys title and abstract."),
    "query": ("As an expert in {field}, write a comma-separated keyword query that retrieves publications "
              "similar to the given input."),
    "core_pub": ("As an expert in {field}, write the title and abstract of a research paper that answers the "
                 "given research question. Answer as JSON with keys title and abstract."),
}


def prompt_table(docs: DataFrame, text_col: str, field_col: str, kind: str, n: int,
                 id_col: str = "id") -> DataFrame:
    """N seeded (system, user) request rows per document for an offline generation job."""
    system = F.lit(PROMPTS[kind])
    return docs.select(id_col, F.explode(F.sequence(F.lit(FIRST_SEED), F.lit(FIRST_SEED + n - 1))).alias("seed"),
                       F.replace(system, F.lit("{field}"), F.col(field_col)).alias("system"),
                       F.col(text_col).alias("user"))


PUB_SCHEMA = T.StructType([T.StructField("title", T.StringType()), T.StructField("abstract", T.StringType())])


def parse_publications(df: DataFrame, json_col: str = "response", out: str = "text",
                       template: str = "indented") -> DataFrame:
    """JSON {title, abstract} responses to document text; bad JSON gives null (never evaluated)."""
    p = F.from_json(F.col(json_col), PUB_SCHEMA)
    return df.withColumn(out, tx.render_text(p["title"], p["abstract"], template))


def core_query_set(cps: DataFrame, cfg: DataFrame, done: DataFrame | None = None,
                   rq_count: int = 1, id_col: str = "id") -> DataFrame:
    """One query per core publication: the topic's questions + the publication text,
    skipping ids already done."""
    if done is not None:
        cps = cps.join(done.select(id_col).distinct(), id_col, "left_anti")
    texts = cps.withColumn("text", tx.render_text("title", "abstract", "core"))
    return format_questions(cfg, rq_count, False, texts.select("topic", id_col, "text")).drop("text")


def select_core(effect: DataFrame, kind: str = "best", seed: int = 42) -> DataFrame:
    """Per topic the best / middle (n//2) / worst / seeded-random core id by ``n_cores``.

    Order: ``n_cores`` desc, then ``core_id`` asc.  best, worst and random are
    grouped ``min`` over a struct (map-side partial aggregation, no per-topic
    sort); only the middle needs positions, from a per-topic window."""
    cols = effect.columns
    rest = [c for c in cols if c not in ("topic", "core_id", "n_cores")]
    if kind in ("best", "worst", "random"):
        if kind == "best":
            key = [(-F.col("n_cores")).alias("_k1"), F.col("core_id").alias("_k2")]
            pick = F.min
        elif kind == "worst":
            key = [(-F.col("n_cores")).alias("_k1"), F.col("core_id").alias("_k2")]
            pick = F.max
        else:
            key = [F.md5(F.concat_ws(":", F.col("core_id").cast("string"), F.lit(str(seed)))).alias("_k1"), F.col("core_id").alias("_k2")]
            pick = F.min
        packed = F.struct(*key, *[F.col(c) for c in ["core_id", "n_cores"] + rest]).alias("_m")
        agg = effect.groupBy("topic").agg(pick(packed).alias("_m"))
        return agg.select("topic", *[F.col("_m")[c].alias(c) for c in ["core_id", "n_cores"] + rest]).select(*cols)
    if kind != "middle":
        raise ValueError(kind)
    w = Window.partitionBy("topic").orderBy(F.col("n_cores").desc(), F.col("core_id").asc())
    ranked = (effect.withColumn("_pos", F.row_number().over(w))
              .withColumn("_n", F.count("*").over(Window.partitionBy("topic"))))
    return ranked.filter(F.col("_pos") == F.floor(F.col("_n") / 2) + 1).drop("_pos", "_n")


# --------------------------------------------------------------------------- E1
def hashed_tfidf(docs: DataFrame, text_col: str = "text", id_col: str = "id", num_features: int = 1 << 12,
                 out: str = "embedding", fit_on: DataFrame | None = None) -> DataFrame:
    """E1 built-in encoder: Spark ML HashingTF + IDF + L2 normaliser -> ``ARRAY<DOUBLE>``.

    ``fit_on``: the texts whose document frequencies count (default: ``docs``); pass the whole corpus when
    only some of its rows are encoded.  No model file is needed; vectors are comparable by cosine like the
    reference's sentence embeddings."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array
    toks = docs.select(id_col, tx.tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("_tok"))
    pipe = Pipeline(stages=[HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
                            IDF(inputCol="_tf", outputCol="_idf"),
                            Normalizer(inputCol="_idf", outputCol="_v", p=2.0)])
    fit = toks if fit_on is None else fit_on.select(tx.tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("_tok"))
    model = pipe.fit(fit)
    return model.transform(toks).select(id_col, vector_to_array("_v").alias(out))


def encode(docs: DataFrame, encoder_factory: Callable[[], Callable[[list[str]], np.ndarray]],
           text_col: str = "text", id_col: str = "id", out: str = "embedding", batch_size: int = 128) -> DataFrame:
    """E1 pluggable encoder: ``encoder_factory()`` is called once per Python worker
    task and returns ``f(texts) -> float matrix``; batches go through Arrow."""
    def run(batches):
        enc = encoder_factory()
        for pdf in batches:
            texts = pdf[text_col].fillna("").tolist()
            vecs = []
            for i in range(0, len(texts), batch_size):
                vecs.extend(np.asarray(enc(texts[i:i + batch_size]), dtype=np.float32))
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), out: vecs})

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           T.StructField(out, T.ArrayType(T.FloatType()))])
    return docs.select(id_col, text_col).mapInPandas(run, schema)


def missing_vector_texts(works: DataFrame, emb: DataFrame, id_col: str = "id",
                         template: str = "passage") -> DataFrame:
    """C25 up to the encoder: works without a vector, rendered to encoder text
    (nulls blanked first, as the encoding job does)."""
    lacking = works.join(emb.select(id_col), id_col, "left_anti")
    filled = lacking.withColumn("title", F.coalesce("title", F.lit(""))).withColumn(
        "abstract", F.coalesce("abstract", F.lit("")))
    return filled.select(id_col, tx.render_text("title", "abstract", template).alias("text"))


def backfill_vectors(works: DataFrame, emb: DataFrame, encoder=None, id_col: str = "id",
                     num_features: int | None = None, encode_frame: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Encode the works that lack a vector and append them to the vector table.

    The encoder must be the one that made the table; its vectors must be as wide as the table's, or this
    raises.  ``encode_frame``: (id, text) to (id, embedding), a kept encoder.  The built-in hashing encoder takes
    the table's width and fits its document frequencies on all works."""
    todo = missing_vector_texts(works, emb, id_col)
    base = emb.select(id_col, F.transform("embedding", lambda x: x.cast("float")).alias("embedding"))
    if todo.isEmpty():  # nothing to encode (an IDF fit needs at least one document)
        return base
    first = emb.where("embedding is not null").select(F.size("embedding")).first()
    width = first[0] if first else num_features or 1 << 12
    if num_features not in (None, width):
        raise ValueError(f"the table's vectors have {width} numbers, not {num_features}")
    if encode_frame is not None:
        new = encode_frame(todo)
    elif encoder is None:
        texts = missing_vector_texts(works, emb.limit(0), id_col)
        new = hashed_tfidf(todo, "text", id_col, width, fit_on=texts)
    else:
        new = encode(todo, encoder, "text", id_col)
    right = F.size("embedding") == width
    new = new.select(id_col, F.when(right, F.transform("embedding", lambda x: x.cast("float")))
                     .otherwise(F.raise_error(F.lit(f"the encoder's vectors are not {width} wide"))).alias("embedding"))
    return base.unionByName(new)
