"""Vector expressions on ``ARRAY<FLOAT|DOUBLE>`` columns and their numpy twins.

The Column forms are used where pairs already exist (equi-joined on id, topic
or model); whole-corpus scoring goes through the blocked scorer in
``quarry.operators.search``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def neg_euclidean(a, b) -> Column:
    d2 = F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)),
                     F.lit(0.0), lambda acc, x: acc + x)
    return -F.sqrt(d2) + F.lit(0.0)


def scale(a, s) -> Column:
    return F.transform(as_double(a), lambda x: x * s)


def vadd(a, b) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x + y)


def vsub(a, b) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)


def round_half_away(x, digits: int) -> Column:
    """Round half away from zero (the rule DuckDB's ``round`` uses on doubles)."""
    m = float(10 ** digits)
    x = _c(x)
    return (F.signum(x) * F.floor(F.abs(x) * m + 0.5) / m) + F.lit(0.0)


def np_round_half_away(x: np.ndarray, digits: int) -> np.ndarray:
    m = 10.0 ** digits
    a = np.abs(x) * m
    r = np.floor(a)
    r = r + (a - r >= 0.5)
    return np.sign(x) * r / m + 0.0


def mean_vector(df, key_cols: list[str], vec_col: str, out_col: str = "vector"):
    """Element-wise mean of the vectors of each key (E6, centroid).

    ``pyspark.ml.stat.Summarizer``: one buffer of the vector's width per key and
    task, merged after the shuffle, so a key with a third of all rows still
    aggregates in parallel.  Null vectors are left out.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    rows = df.where(F.col(vec_col).isNotNull()).select(*key_cols, array_to_vector(as_double(vec_col)).alias("_v"))
    return (rows.groupBy(*key_cols).agg(Summarizer.mean(F.col("_v")).alias("_m"))
            .select(*key_cols, vector_to_array("_m").alias(out_col)))
