"""Threshold join of vectors by distances to pivots (C11): each row's best partner above a similarity, exactly."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.vectors import np_round_half_away
from quarry.operators.common import materialize, spread
from quarry.operators.search import _as_matrix
from quarry.operators.vector_index import ASK, BLOCK, _fine, _share, _unit

MAX_PIVOTS = 1024
ROWS_AT_ONCE = 1024      # rows whose distances to all pivots a task holds (8 MB)
NUMBERS_AT_ONCE = 1 << 21  # components of the copies of rows that a task gives out together (16 MB)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ pivots.T)))


def best_partners(left: DataFrame, right: DataFrame, min_sim: float = 0.995, *, query_id: str = "query_id", query_vec: str = "vector",
                  id_col: str = "id", vec_col: str = "embedding", digits: int = 6, other_id: bool = False, pivots: int | None = None,
                  seed: int = 5) -> DataFrame:
    """For each left row its right row of greatest cosine, if that is above ``min_sim``: ``query_id, id, score``; ties
    to the smaller id. ``other_id``: a row is no partner of the row with its own id. Exact; neither side is collected.

    Unit vectors of cosine above s lie within r = sqrt(2 - 2 s). About sqrt(rows) right rows, at most ``MAX_PIVOTS``, are
    pivots; a right row is filed under its nearest one. By the triangle inequality, a partner within r is filed
    under a pivot not more than 2 r farther from the left row than that row's nearest pivot, and its distance
    to that pivot differs by at most r, so only neighbouring bands of width r meet. A (pivot, band) with many rows
    on either side is dealt into blocks; a block gives one row per left row, so copies never become pairs.
    Rows without a whole vector, or of length zero, have no partner."""
    spark = left.sparkSession
    reach = math.sqrt(max(0.0, 2 - 2 * (min_sim - 10.0 ** -digits))) + 1e-7
    whole = lambda df, i, v: _fine(df.select(F.col(i).alias("id"), F.col(v).alias("v")), "v").where(F.exists("v", lambda c: c != 0))
    l, r = whole(left, query_id, query_vec), whole(right, id_col, vec_col)
    n = r.count()
    want = pivots or max(1, min(MAX_PIVOTS, round(math.sqrt(n))))
    picked = [p["v"] for p in (r if n <= want else r.where(_share(F.xxhash64("id", F.lit(seed)), want / n))).select("v").collect()]
    picked = picked or [p["v"] for p in r.limit(1).collect()]
    id_field = T.StructField("id", r.schema["id"].dataType)
    out_schema = T.StructType([T.StructField("query_id", l.schema["id"].dataType), id_field, T.StructField("score", T.DoubleType())])
    if not picked:
        return spark.createDataFrame([], out_schema).withColumnsRenamed({"query_id": query_id, "id": id_col})
    p = np.unique(_unit(_as_matrix(np.array(picked, dtype=object) if len({len(v) for v in picked}) > 1 else np.array(picked, float), strict=True)), axis=0)

    def parts(batches):
        for pdf in batches:
            for i in range(0, len(pdf), ROWS_AT_ONCE):
                yield pdf.iloc[i:i + ROWS_AT_ONCE]

    def file(batches):
        for pdf in parts(batches):
            if len(pdf):
                d = _distances(_unit(_as_matrix(pdf["v"].to_numpy(), p.shape[1], strict=True)), p)
                cell = d.argmin(1)
                yield pdf.assign(cell=cell.astype(np.int32), band=np.floor(d[np.arange(len(d)), cell] / reach).astype(np.int32))

    def ask(batches):
        most = max(1, NUMBERS_AT_ONCE // p.shape[1])
        for pdf in parts(batches):
            d = _distances(_unit(_as_matrix(pdf["v"].to_numpy(), p.shape[1], strict=True)), p)
            row, cell = np.nonzero(d <= d.min(1, keepdims=True) + 2 * reach)
            low = np.floor((d[row, cell] - reach) / reach).astype(np.int32)
            high = np.floor((d[row, cell] + reach) / reach).astype(np.int32)
            for step in range(int((high - low).max(initial=-1)) + 1):
                on = np.flatnonzero(low + step <= high)
                for some in (on[i:i + most] for i in range(0, len(on), most)):
                    yield pd.DataFrame({"id": pdf["id"].to_numpy()[row[some]], "v": pdf["v"].to_numpy()[row[some]], "cell": cell[some].astype(np.int32), "band": low[some] + np.int32(step)})

    more = [T.StructField("cell", T.IntegerType()), T.StructField("band", T.IntegerType())]
    filed = materialize(spread(r).mapInPandas(file, T.StructType([*r.schema.fields, *more])), "metric-right")
    sizes = filed.groupBy("cell", "band").agg(F.count("*").alias("n"))
    asked = materialize(spread(l).mapInPandas(ask, T.StructType([*l.schema.fields, *more])).join(F.broadcast(sizes.select("cell", "band")), ["cell", "band"], "left_semi"), "metric-left")
    # a row per (pivot, band): at most pivots x 2 / reach of them
    deal = F.broadcast(materialize(sizes.join(asked.groupBy("cell", "band").agg(F.count("*").alias("m")), ["cell", "band"])
                                   .select("cell", "band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("m") / ASK).cast("int").alias("groups")), "metric-deal"))
    one = (filed.join(deal, ["cell", "band"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
           .withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("blocks", "groups"))
    two = (asked.join(deal, ["cell", "band"]).withColumn("grp", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int"))
           .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "groups"))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame(columns=["query_id", "id", "score"], dtype=object)
        if not len(a) or not len(b):
            return nothing
        a = a.sort_values("id", kind="stable")
        s = np_round_half_away(_unit(_as_matrix(b["v"].to_numpy())) @ _unit(_as_matrix(a["v"].to_numpy())).T, digits)
        if other_id:
            s = np.where(b["id"].to_numpy()[:, None] == a["id"].to_numpy()[None, :], -2.0, s)
        best = s.argmax(1)
        top = s[np.arange(len(s)), best]
        on = top > min_sim
        return pd.DataFrame({"query_id": b["id"].to_numpy()[on], "id": a["id"].to_numpy()[best[on]], "score": top[on]}) if on.any() else nothing

    keys = ["cell", "band", "block", "grp"]
    found = one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInPandas(compare, out_schema)
    return (found.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("m"))
            .select(F.col("query_id").alias(query_id), F.col("m.id").alias(id_col), (-F.col("m.s")).alias("score")))
