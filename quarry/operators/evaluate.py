"""Recall and ablation summaries.

All of them are joins and grouped aggregates over (topic, id) keyed tables;
the ranked runs are cut by an explicit ``rank`` column, never by row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.vectors import round_half_away


def _keys(run_keys) -> list[str]:
    if run_keys is None:
        return []
    return [run_keys] if isinstance(run_keys, str) else list(run_keys)


def recall_at_k(run: DataFrame, cps: DataFrame, k: int | Column | None = None, *, run_keys=None,
                topic: str = "topic", id_col: str = "id", rank_col: str = "rank",
                count: str = "rows", k_col: str | None = None) -> DataFrame:
    """M1: found core rows in the top k / all core rows, per (run keys, topic).

    ``count``: ``rows`` counts matched ground-truth rows, ``titled`` only those
    with a title (the review evaluation), ``ids`` distinct ids on both sides.
    ``k_col``: a per-row cut column on ``run`` (per-topic k, see M2).
    Topics of a run without core rows get a null recall.
    """
    keys = _keys(run_keys)
    hits = run
    if k_col is not None:
        hits = hits.filter(F.col(rank_col) <= F.col(k_col))
    elif k is not None:
        hits = hits.filter(F.col(rank_col) <= k)
    present = run.select(*keys, topic).distinct()
    hit_ids = hits.select(*keys, topic, id_col).distinct()
    if count == "ids":
        truth = cps.select(topic, id_col).distinct()
        n_cps = truth.groupBy(topic).agg(F.count("*").alias("n_cps"))
        found = (hit_ids.join(truth, [topic, id_col])
                 .groupBy(*keys, topic).agg(F.count("*").alias("n_found")))
    else:
        truth = cps.select(topic, id_col, *(["title"] if count == "titled" else []))
        n_cps = truth.groupBy(topic).agg(F.count("*").alias("n_cps"))
        matched = hit_ids.join(truth, [topic, id_col])
        cnt = F.count("title") if count == "titled" else F.count("*")
        found = matched.groupBy(*keys, topic).agg(cnt.alias("n_found"))
    return (present.join(n_cps, topic, "left").join(found, keys + [topic], "left")
            .select(*keys, topic, F.col("n_cps"), F.coalesce("n_found", F.lit(0)).alias("n_found"),
                    (F.coalesce("n_found", F.lit(0)) / F.col("n_cps")).alias("recall")))


def topic_k(keyword_results: DataFrame, topics: DataFrame, default: int = 10_000,
            topic: str = "topic") -> DataFrame:
    """M2: per topic k = min(keyword result count, default); default without a result list."""
    counts = keyword_results.groupBy(topic).agg(F.count("*").alias("_n"))
    return (topics.select(topic).distinct().join(counts, topic, "left")
            .select(topic, F.coalesce(F.least(F.col("_n"), F.lit(default)), F.lit(default)).alias("top_n")))


def keyword_recall(keyword_results: DataFrame, cps: DataFrame, topic: str = "topic", id_col: str = "id") -> DataFrame:
    """M3: share of a topic's core rows (counted where the title is known) found by the
    keyword search's core-flagged results, for the topics that have a keyword search."""
    found_ids = keyword_results.filter(F.col("is_core")).select(topic, id_col).distinct()
    topics = keyword_results.select(topic).distinct()
    truth = cps.join(topics, topic, "left_semi")
    flagged = truth.join(found_ids.withColumn("_f", F.lit(True)), [topic, id_col], "left")
    return (flagged.groupBy(topic).agg(
        F.count(F.when(F.col("_f"), F.col("title"))).alias("n_found"), F.count("*").alias("n_cps"))
        .withColumn("recall", F.col("n_found") / F.col("n_cps")))


def mean_recall(runs: DataFrame, cps: DataFrame, run_keys, limit_k: DataFrame | None = None,
                topic: str = "topic", count: str = "titled") -> DataFrame:
    """M4: M1 per run and topic (whole run, or cut at the topic's k), mean over runs."""
    keys = _keys(run_keys)
    if limit_k is not None:
        runs = runs.join(limit_k.select(topic, "top_n"), topic)
        per = recall_at_k(runs, cps, run_keys=keys, topic=topic, count=count, k_col="top_n")
    else:
        per = recall_at_k(runs, cps, run_keys=keys, topic=topic, count=count)
    return per.groupBy(topic).agg(F.avg("recall").alias("recall"), F.count("*").alias("n_runs"))


def compare_recall(ours: DataFrame, keyword: DataFrame, k_table: DataFrame, topic: str = "topic",
                   default: int = 10_000) -> DataFrame:
    """M5: full outer join of our recall and the keyword recall per topic, with the sample size."""
    j = (ours.select(topic, F.col("recall").alias("ours"))
         .join(keyword.select(topic, F.col("recall").alias("keyword")), topic, "full"))
    return (j.join(k_table.select(topic, "top_n"), topic, "left")
            .select(topic, "ours", "keyword", F.coalesce("top_n", F.lit(default)).alias("sample_size")))


def minmax_score(scores: DataFrame, by: str = "model", cos_col: str = "score",
                 dist_col: str = "euc_score") -> DataFrame:
    """M6: abs of cosine scores; distances abs then ``1 - (x-min)/(max-min)`` per model
    (a constant group gives null).

    min/max per model come from a grouped aggregate (partial, map-side) joined
    back on the model - one row per model - rather than from a window, which
    would sort a whole model's rows in one task."""
    d = F.abs(F.col(dist_col))
    mm = scores.groupBy(by).agg(F.min(d).alias("_mn"), F.max(d).alias("_mx"))
    j = scores.join(mm, by)
    return j.select(*scores.columns, F.abs(F.col(cos_col)).alias("cos_abs"),
                    (F.lit(1.0) - (d - F.col("_mn")) / F.when(F.col("_mx") != F.col("_mn"), F.col("_mx") - F.col("_mn")))
                    .alias("dist_norm"))


def recall_curve(runs: DataFrame, cps: DataFrame, run_keys, step: int = 100, upto: int = 10_000,
                 topic: str = "topic", id_col: str = "id", by: list[str] | None = None) -> DataFrame:
    """M7: recall at k = 0, step, ..., upto; mean over topics, then over runs (per ``by``).

    Each found core contributes from its rank's step bucket on: a bucket
    histogram + running sum over a bounded spine of upto/step+1 points per
    (run, topic) - no range join."""
    keys = _keys(run_keys)
    by = by or []
    n_cps = cps.groupBy(topic).agg(F.count("*").alias("n_cps"))
    hits = (runs.select(*keys, topic, id_col, "rank").join(cps.select(topic, id_col), [topic, id_col])
            .withColumn("_b", F.ceil(F.col("rank") / step).cast("int")))
    hist = hits.groupBy(*keys, topic, "_b").agg(F.count("*").alias("_c"))
    spine = runs.select(*keys, topic).distinct().select(
        *keys, topic, F.explode(F.sequence(F.lit(0), F.lit(upto // step))).alias("_b"))
    w = Window.partitionBy(*keys, topic).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cur = (spine.join(hist, keys + [topic, "_b"], "left").na.fill(0, ["_c"])
           .withColumn("_found", F.sum("_c").over(w))
           .join(n_cps, topic).withColumn("recall", F.col("_found") / F.col("n_cps")))
    per_run = cur.groupBy(*keys, "_b").agg(F.avg("recall").alias("recall"))
    return (per_run.groupBy(*by, "_b").agg(F.avg("recall").alias("recall"))
            .select(*by, (F.col("_b") * step).cast("bigint").alias("k"), "recall"))


def core_effect(runs: DataFrame, cps: DataFrame, topic: str = "topic", core_col: str = "core_id",
                id_col: str = "id", digits: int = 2) -> DataFrame:
    """M8: per core publication used as the query, the titled core rows its run found. ``runs``, which may be a
    search of the whole corpus by every core, is read once."""
    n_cps = cps.groupBy(topic).agg(F.count("*").alias("n_cps"))
    # a core without an id is in the result, but finds nothing
    found = F.when(F.col(core_col).isNotNull(), F.col("title"))
    out = (runs.select(topic, core_col, id_col).distinct().join(cps.select(topic, id_col, "title"), [topic, id_col], "left")
           .groupBy(topic, core_col).agg(F.count(found).alias("n_cores")))
    return (out.join(n_cps, topic, "left")
            .withColumn("recall", round_half_away(F.col("n_cores") / F.col("n_cps"), digits)))


def quartile_means(effect: DataFrame, topic: str = "topic", value: str = "recall") -> DataFrame:
    """M9: per topic mean of the top 25 %, middle 50 %, bottom 25 % by value (cuts at
    int(n*.25), int(n*.75)), then the mean over topics (3 / 4 / 3 digits)."""
    w = Window.partitionBy(topic).orderBy(F.col(value).desc())
    r = (effect.withColumn("_p", F.row_number().over(w) - 1)
         .withColumn("_n", F.count("*").over(Window.partitionBy(topic)))
         .withColumn("_c1", F.floor(F.col("_n") * 0.25)).withColumn("_c2", F.floor(F.col("_n") * 0.75)))
    per = r.groupBy(topic).agg(
        F.avg(F.when(F.col("_p") < F.col("_c1"), F.col(value))).alias("top"),
        F.avg(F.when((F.col("_p") >= F.col("_c1")) & (F.col("_p") < F.col("_c2")), F.col(value))).alias("mid"),
        F.avg(F.when(F.col("_p") >= F.col("_c2"), F.col(value))).alias("bot"))
    return per.agg(round_half_away(F.avg("top"), 3).alias("avg_top_25"),
                   round_half_away(F.avg("mid"), 4).alias("avg_mid_50"),
                   round_half_away(F.avg("bot"), 3).alias("avg_bot_25"))


def compare_prompts(a: DataFrame, b: DataFrame, topic: str = "topic", value: str = "recall",
                    digits: int = 9) -> DataFrame:
    """Per topic max/min/mean of two settings and their difference (a - b).

    Means and differences are rounded (``digits``), so equal settings compare
    as equal regardless of summation order."""
    def stats(df, s):
        return df.groupBy(topic).agg(F.max(value).alias(f"max_{s}"), F.min(value).alias(f"min_{s}"),
                                     round_half_away(F.avg(value), digits).alias(f"mean_{s}"))
    j = stats(a, "a").join(stats(b, "b"), topic)
    return j.select("*", *[round_half_away(F.col(f"{m}_a") - F.col(f"{m}_b"), digits).alias(f"diff_{m}")
                           for m in ("max", "min", "mean")])


def prompt_summary(cmp: DataFrame) -> DataFrame:
    """Topics where a is better / b is better / equal, and the mean of both settings."""
    return cmp.agg(F.sum(F.when(F.col("diff_mean") > 0, 1).otherwise(0)).cast("bigint").alias("n_a_better"),
                   F.sum(F.when(F.col("diff_mean") < 0, 1).otherwise(0)).cast("bigint").alias("n_b_better"),
                   F.sum(F.when(F.col("diff_mean") == 0, 1).otherwise(0)).cast("bigint").alias("n_same"),
                   round_half_away(F.avg("mean_a"), 9).alias("mean_a"),
                   round_half_away(F.avg("mean_b"), 9).alias("mean_b"))


def model_recall(ranked: DataFrame, cps: DataFrame, ks=(1000, 10_000), model: str = "model",
                 topic: str = "topic") -> DataFrame:
    """Recall@k per model and topic (2 digits) for each k: ``model, topic, k, recall``."""
    out = None
    for k in ks:
        r = recall_at_k(ranked, cps, k, run_keys=[model], topic=topic).select(
            model, topic, F.lit(k).alias("k"), round_half_away("recall", 2).alias("recall"))
        out = r if out is None else out.unionByName(r)
    return out


def model_means(recall: DataFrame, model: str = "model") -> DataFrame:
    """Mean over topics per model and k (3 digits), ranked by the mean."""
    m = recall.groupBy(model, "k").agg(round_half_away(F.avg("recall"), 3).alias("mean_recall"))
    w = Window.partitionBy("k").orderBy(F.col("mean_recall").desc(), F.col(model))
    return m.withColumn("position", F.row_number().over(w))


def wide(long: DataFrame, row: str, col: str, value: str, cols: list) -> DataFrame:
    """Pivot at the sink (column values listed, so no extra pass to find them)."""
    return long.groupBy(row).pivot(col, cols).agg(F.first(value))


def grid_recall(grid_runs: DataFrame, cps: DataFrame, variant_keys: list[str], topic: str = "topic") -> DataFrame:
    """Recall per query variant and topic (whole run; found core rows with a title)."""
    return recall_at_k(grid_runs, cps, run_keys=variant_keys, topic=topic, count="titled")


def grid_summary(per_variant: DataFrame, by: str) -> DataFrame:
    """Mean over topics of the variants without text, by ``rq_count`` or ``include_sub``."""
    return (per_variant.filter(~F.col("has_text")).groupBy(by, "topic")
            .agg(F.avg("recall").alias("recall"))
            .groupBy(by).agg(F.avg("recall").alias("recall")))


def paired_recall(a: DataFrame, b: DataFrame, cps: DataFrame, k: int | None = None, topic: str = "topic",
                  suffixes=("real", "generated"), count: str = "titled") -> DataFrame:
    """Found counts (core rows with a title) and ratios of two settings per topic,
    joined with suffixes, plus an ``Average`` row from ``rollup``."""
    ra = recall_at_k(a, cps, k, topic=topic, count=count).select(
        topic, "n_cps", F.col("n_found").alias(f"found_{suffixes[0]}"), F.col("recall").alias(f"recall_{suffixes[0]}"))
    rb = recall_at_k(b, cps, k, topic=topic, count=count).select(
        topic, F.col("n_found").alias(f"found_{suffixes[1]}"), F.col("recall").alias(f"recall_{suffixes[1]}"))
    j = ra.join(rb, topic, "full")
    cols = [c for c in j.columns if c != topic]
    return _label_total(j.rollup(topic).agg(*[F.avg(c).alias(c) for c in cols]), topic)


def _label_total(df: DataFrame, topic: str) -> DataFrame:
    """Name the rollup's total row ``Average`` (topic as text, so no null key)."""
    return df.select(F.coalesce(F.col(topic).cast("string"), F.lit("Average")).alias(topic),
                     *[c for c in df.columns if c != topic], F.col(topic).isNull().alias("is_average"))


def base_vs_rerank(base: DataFrame, reranked: DataFrame, cps: DataFrame, k_table: DataFrame,
                   topic: str = "topic") -> DataFrame:
    """Recall of the base run and the reranked run at each topic's n, with an average row."""
    kb = base.join(k_table.select(topic, "top_n"), topic)
    kr = reranked.join(k_table.select(topic, "top_n"), topic)
    rb = recall_at_k(kb, cps, topic=topic, k_col="top_n").select(topic, F.col("recall").alias("base"))
    rr_ = recall_at_k(kr, cps, topic=topic, k_col="top_n").select(topic, F.col("recall").alias("reranked"))
    return _label_total(rb.join(rr_, topic, "full").rollup(topic)
                        .agg(F.avg("base").alias("base"), F.avg("reranked").alias("reranked")), topic)


def method_recall(long_rank: DataFrame, cps: DataFrame, file_col: str = "file", method: str = "method",
                  topic: str = "topic") -> DataFrame:
    """Recall per (file, topic, method) as distinct found ids / distinct core ids,
    mean over files per (topic, method), plus per-method averages over topics
    (an ``Average`` row from ``rollup``)."""
    per = recall_at_k(long_rank, cps, run_keys=[file_col, method], topic=topic, count="ids")
    tm = per.groupBy(topic, method).agg(F.avg("recall").alias("recall"))
    return _label_total(tm.rollup(method, topic).agg(F.avg("recall").alias("recall"))
                        .filter(F.col(method).isNotNull()), topic)


def availability(expected: DataFrame, found: DataFrame, topic: str = "topic", id_col: str = "id") -> DataFrame:
    """Expected and found counts per topic (found = expected ids present in ``found``)."""
    e = expected.groupBy(topic).agg(F.count("*").alias("expected"))
    f = (expected.join(found.select(id_col).distinct(), id_col, "left_semi")
         .groupBy(topic).agg(F.count("*").alias("found")))
    return e.join(f, topic, "left").na.fill(0, ["found"]).withColumn("share", F.col("found") / F.col("expected"))


def report(compare: DataFrame, topic: str = "topic", all_topics: bool = False) -> DataFrame:
    """Percentages as integers, topics with a keyword result only (or all, missing
    keyword recall shown as -1), ordered by sample size, and an average row."""
    df = compare if all_topics else compare.filter(F.col("keyword").isNotNull() & (F.col("keyword") != 0)
                                                   & F.col("ours").isNotNull())
    agg = df.rollup(topic).agg(F.avg(F.col("ours") * 100).alias("ours"),
                               F.avg(F.col("keyword") * 100).alias("keyword"),
                               F.avg("sample_size").alias("k"))
    out = agg.select(F.coalesce(F.col(topic).cast("string"), F.lit("Average")).alias(topic),
                     F.round("ours").cast("int").alias("ours"),
                     F.round("keyword").cast("int").alias("keyword"),
                     F.round("k").cast("int").alias("k"),
                     F.col(topic).isNull().alias("is_average"))
    if all_topics:
        out = out.withColumn("ours", F.coalesce("ours", F.lit(0))).withColumn(
            "keyword", F.when(F.coalesce("keyword", F.lit(0)) == 0, F.lit(-1)).otherwise(F.col("keyword")))
    return out


def curve_points(curve: DataFrame, every: int | None = None, ks=None, k_col: str = "k") -> DataFrame:
    """The curve sampled at every n-th k and/or at chosen k values."""
    cond = F.lit(False)
    if every:
        cond = cond | (F.col(k_col) % every == 0)
    if ks:
        cond = cond | F.col(k_col).isin(list(ks))
    return curve.filter(cond)


def score_histogram(scores: DataFrame, value: str = "score", by: list[str] | None = None, bins: int = 2000,
                    lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Counts per bin (last bin closed) and key; values outside ``lo`` to ``hi`` belong to no bin."""
    by = by or []
    scores = scores.where(F.col(value).between(lo, hi))
    b = F.least(F.floor((F.col(value) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    return scores.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))


def recall_spread(effect: DataFrame, topic: str = "topic", value: str = "recall") -> DataFrame:
    """Box-plot numbers per topic: min, quartiles (interpolated), max."""
    return effect.groupBy(topic).agg(
        F.min(value).alias("min"), F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.5).alias("median"),
        F.percentile(value, 0.75).alias("q3"), F.max(value).alias("max"))


def best_setting(wide_df: DataFrame, settings: list[str], topic: str = "topic") -> DataFrame:
    """Per row the highest setting(s); ties listed comma-separated in given order."""
    mx = F.greatest(*[F.col(s) for s in settings])
    names = F.concat_ws(",", *[F.when(F.col(s) == mx, F.lit(s)) for s in settings])
    return wide_df.select(topic, mx.alias("best_value"), names.alias("best"))


def run_label(df: DataFrame, path_col: str = "_path") -> DataFrame:
    """Core type, hypothetical-document count and trial from run file names
    like ``cp_<type>_hyde_<n>_run-<t>.parquet``."""
    name = F.regexp_extract(F.col(path_col), r"(cp_[a-z]+_hyde_\d+_run-\d+)", 1)
    return df.select("*", F.regexp_extract(name, r"^cp_([a-z]+)_", 1).alias("core_type"),
                     F.regexp_extract(name, r"hyde_(\d+)", 1).cast("int").alias("n_hyde"),
                     F.regexp_extract(name, r"run-(\d+)", 1).cast("int").alias("trial"))
