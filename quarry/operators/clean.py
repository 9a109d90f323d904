"""Projection, filtering, cleaning and membership operators.

Deduplication keeps "the first row per key" with a grouped ``min(struct(...))``
instead of a ``row_number`` window: the aggregate combines map-side, so a key
holding a third of all rows never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx


def english_with_abstract(df: DataFrame, lang_col: str = "language", abstract_col: str = "abstract",
                          title_col: str = "title", lang: str = "en") -> DataFrame:
    """language = en and an abstract present; a missing title becomes ''."""
    return (df.filter((F.col(lang_col) == lang) & F.col(abstract_col).isNotNull())
            .withColumn(title_col, F.coalesce(F.col(title_col), F.lit(""))))


def fill_blank(df: DataFrame) -> DataFrame:
    """Every null string becomes ''."""
    return df.na.fill("")


def complete_works(df: DataFrame, lang: str = "en") -> DataFrame:
    """C4: title and abstract present, language en."""
    return df.filter(F.col("abstract").isNotNull() & F.col("title").isNotNull() & (F.col("language") == lang))


def with_text(df: DataFrame, template: str = "passage", out: str = "text",
              title_col: str = "title", abstract_col: str = "abstract") -> DataFrame:
    """Document text from title and abstract by a template."""
    return df.withColumn(out, tx.render_text(title_col, abstract_col, template))


def parse_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Split rendered text back into title and abstract."""
    return (df.withColumn("title", tx.parse_title(text_col))
              .withColumn("abstract", tx.parse_abstract(text_col)))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the row smallest by ``order`` (then the remaining columns).

    Grouped ``min`` over a struct led by the order columns: partial aggregation
    collapses hot keys on the map side before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c) for c in order + rest]).alias("_m")
    agg = df.groupBy(*keys).agg(F.min(packed).alias("_m"))
    return agg.select(*keys, *[F.col("_m")[c].alias(c) for c in order + rest]).select(*df.columns)


def dedupe_title(df: DataFrame, title_col: str = "title", id_col: str = "id", mode: str = "lower") -> DataFrame:
    """First row (smallest id) per normalised title."""
    keyed = df.withColumn("_nt", tx.normalise_title(title_col, mode))
    return keep_first(keyed, ["_nt"], [id_col]).drop("_nt")


def dedupe_content(df: DataFrame, cols=("title", "abstract"), id_col: str = "id") -> DataFrame:
    """One row per content (title, abstract), the smallest id."""
    return keep_first(df, list(cols), [id_col])


def dedupe_id(df: DataFrame, id_col: str = "id", priority: str | None = "priority") -> DataFrame:
    """One row per id; lowest ``priority`` wins, then smallest remaining values."""
    return keep_first(df, [id_col], [priority] if priority else [])


def match_titles(left: DataFrame, right: DataFrame, min_sim: float = 0.995, approx: bool = False,
                 **kw) -> DataFrame:
    """C11: for each left row its best right row by vector similarity, kept above ``min_sim``.

    Exact (default): the blocked search with k = 1.  ``approx=True`` looks only
    into the cells nearest to a left row (for a large right side); every pair it
    returns is a true pair above the threshold with its exact score, but a best
    partner in another cell can be missed. For a high threshold and a large left side, ``metric_join.best_partners``
    gives the exact answer without collecting either."""
    from quarry.operators.search import search, search_approx
    if approx:
        hits = search_approx(left, right, 1, **kw)
    else:
        hits = search(left, right, 1, **kw)
    return hits.filter(F.col("score") > F.lit(min_sim)).drop("rank")


def missing_ids(a: DataFrame, b: DataFrame, a_col: str = "id", b_col: str = "id") -> DataFrame:
    """Ids of a not in b and of b not in a: ``direction, id``."""
    ai = a.select(F.col(a_col).alias("id")).distinct()
    bi = b.select(F.col(b_col).alias("id")).distinct()
    return (ai.join(bi, "id", "left_anti").withColumn("direction", F.lit("a_not_b"))
            .unionByName(bi.join(ai, "id", "left_anti").withColumn("direction", F.lit("b_not_a"))))


def missing_counts(a: DataFrame, b: DataFrame, a_col: str = "id", b_col: str = "id") -> DataFrame:
    return missing_ids(a, b, a_col, b_col).groupBy("direction").agg(F.count("*").alias("n"))


def keep_available(df: DataFrame, corpus: DataFrame, id_col: str = "id", corpus_id: str = "id") -> DataFrame:
    """Drop rows whose id is not in the corpus (semi join)."""
    ids = corpus.select(F.col(corpus_id).alias(id_col))
    return df.join(ids, id_col, "left_semi")


def attach_vectors(meta: DataFrame, emb: DataFrame, id_col: str = "id") -> DataFrame:
    """C14: inner join of metadata and vectors on id."""
    return meta.join(emb, id_col)


def align_schema(df: DataFrame, refs_col: str = "referenced_works", type_col: str = "type",
                 enum_map: dict | None = None, constants: dict | None = None,
                 drop: list[str] | None = None) -> DataFrame:
    """Reference count from a list-literal string, enum remap, constants, drop columns."""
    enum_map = enum_map if enum_map is not None else {"journal-article": "article"}
    # list literals quote with ' or ", whichever the value does not hold, and escape with a backslash
    quoted = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
    out = df.withColumn("n_references", F.size(F.from_json(refs_col, "array<string>", quoted)).cast("bigint"))
    if enum_map:
        expr = None
        for k, v in enum_map.items():
            expr = (F.when(F.col(type_col) == k, F.lit(v)) if expr is None
                    else expr.when(F.col(type_col) == k, F.lit(v)))
        out = out.withColumn(type_col, expr.otherwise(F.col(type_col)))
    for k, v in (constants or {}).items():
        out = out.withColumn(k, F.lit(v))
    return out.drop(*(drop or [refs_col]))


def coalesce_merge(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Left join; each shared column takes a's value, else b's."""
    shared = [c for c in a.columns if c in b.columns and c != key]
    bb = b.select(key, *[F.col(c).alias(f"_b_{c}") for c in shared])
    j = a.join(bb, key, "left")
    for c in shared:
        j = j.withColumn(c, F.coalesce(F.col(c), F.col(f"_b_{c}"))).drop(f"_b_{c}")
    return j


def null_audit(df: DataFrame, title_col: str = "title", text_col: str = "text") -> DataFrame:
    """C17: total rows, blank/missing titles, null texts - one aggregate pass."""
    return df.agg(F.count("*").alias("n_rows"),
                  F.sum(F.when(F.col(title_col).isNull() | (F.col(title_col) == ""), 1).otherwise(0))
                  .cast("bigint").alias("n_blank_title"),
                  F.sum(F.when(F.col(text_col).isNull(), 1).otherwise(0)).cast("bigint").alias("n_null_text"))


def sample_complete(df: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """N complete works in a seeded md5 order (deterministic random sample)."""
    full = df.filter(F.col("title").isNotNull() & F.col("abstract").isNotNull())
    return full.orderBy(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))), F.col(id_col)).limit(n)


def assemble_eval_corpus(parts: list[DataFrame], id_col: str = "id") -> DataFrame:
    """Union of (core, noise, similar, ...) parts; one row per id, earlier parts win."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("priority", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return dedupe_id(out, id_col, "priority")


def head_per_group(df: DataFrame, key, n: int, order) -> DataFrame:
    """C20: first n rows per key (a map-side WindowGroupLimit bounds every group)."""
    keys = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(*keys).orderBy(*[F.col(o) for o in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def label_members(df: DataFrame, ids: DataFrame, id_col: str = "id", out: str = "included",
                  yes=1, no=0, on: list[str] | None = None) -> DataFrame:
    """Flag rows whose id (and ``on`` keys) appear in ``ids``."""
    keys = (on or []) + [id_col]
    flag = ids.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return (df.join(flag, keys, "left")
            .withColumn(out, F.when(F.col("_hit"), F.lit(yes)).otherwise(F.lit(no))).drop("_hit"))


def union_labelled(existing: DataFrame, new: DataFrame, label_from: str = "label_included",
                   label_to: str = "is_core", topic: str = "topic") -> DataFrame:
    """rename/cast the new label and append rows only for topics not yet present."""
    new = new.withColumnRenamed(label_from, label_to).withColumn(label_to, F.col(label_to).cast("boolean"))
    fresh = new.join(existing.select(topic).distinct(), topic, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def keyword_search(works: DataFrame, terms: DataFrame, k: int | None = None, lang: str = "en",
                   id_col: str = "id") -> DataFrame:
    """Boolean keyword search: AND of OR-groups over title + abstract tokens.

    ``terms``: ``topic, grp, term``; a term of several words is a phrase and matches
    those tokens in a row.  Terms are tokenised as the works are.  A work matches a
    topic when it hits every group of the topic; ``rank`` is its place by id, and
    ``k`` (default: no cut) keeps the first k.  The term table is broadcast if it was
    counted and is small.  Works are tokenised once; tokens are matched against the
    terms' first tokens, and the rest of a phrase is compared in the row.
    """
    from quarry.operators.common import spread
    docs = spread(works.filter((F.col("language") == lang) & F.col("abstract").isNotNull()))
    from quarry.operators.common import broadcast_if_small, rank_within
    want = (terms.select("topic", "grp", tx.tokens(F.col("term")).alias("_term")).where(F.size("_term") > 0).distinct()
            .withColumn("_head", F.col("_term")[0]))
    toks = docs.select(id_col, tx.tokens(F.concat_ws(" ", F.col("title"), F.col("abstract"))).alias("_toks"))
    # one row per distinct token, with the tokens after each of its places only where a phrase needs them
    longest = want.agg(F.max(F.size("_term"))).first()[0] or 1
    if longest == 1:
        at = toks.select(id_col, F.explode_outer(F.array_distinct("_toks")).alias("_head")).filter(F.col("_head").isNotNull())
    else:
        at = (toks.select(id_col, "_toks", F.posexplode_outer("_toks").alias("_pos", "_head")).filter(F.col("_head").isNotNull())
              .select(id_col, "_head", F.slice("_toks", F.col("_pos") + 1, longest).alias("_next")))
    found = at.join(broadcast_if_small(want), "_head")
    if longest > 1:
        found = found.where(F.slice("_next", F.lit(1), F.size("_term")) == F.col("_term"))
    hits = found.groupBy("topic", id_col).agg(F.countDistinct("grp").alias("_hit"))
    n_groups = terms.groupBy("topic").agg(F.countDistinct("grp").alias("_ng"))
    matched = hits.join(broadcast_if_small(n_groups), "topic").filter(F.col("_hit") == F.col("_ng"))
    return rank_within(matched, "topic", [F.col(id_col).asc()], k).select("topic", id_col, "rank")
