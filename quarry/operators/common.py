"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A side is shipped to every task only below this many rows (checked by count).
MAX_BROADCAST_ROWS = 2_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only when its row count is proven small; else leave the
    join to the planner (sort-merge / AQE skew handling)."""
    return F.broadcast(df) if df.count() <= max_rows else df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Cuts lineage (a lost executor recomputes from the written files, not the
    whole plan) and lets several consumers share one computation - unlike
    ``checkpoint()``, the plan runs once."""
    from quarry.sources.io import scratch_path
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def free(table: DataFrame) -> None:
    """Delete a table made by ``materialize`` that only steps already written have read, and the shuffle files of those steps:
    Spark deletes these once the driver has dropped what made them."""
    spark = table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    drop_shuffles(spark)


def drop_shuffles(spark: SparkSession) -> None:
    spark._jvm.System.gc()


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give CPU-heavy row work (tokenising, block scoring) at least one partition per core.

    A large input already has many scan partitions and is left alone (no
    shuffle); only an input that arrives in fewer partitions than the cluster
    has cores (one big row group, a small table) is spread round-robin."""
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if partitions(df) < want else df


def partitions(df: DataFrame) -> int:
    """Number of partitions without running anything: of the scan, or, where the plan has an exchange, the
    session's shuffle partitions (adaptive execution may merge some, never make more)."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, df.rdd.getNumPartitions())


def rank_within(df: DataFrame, keys, order, k: int | None = None, out: str = "rank") -> DataFrame:
    """``row_number`` per key over ``order`` and an optional cut at k.

    With k at or below ``spark.sql.optimizer.windowGroupLimitThreshold`` the
    planner adds a map-side WindowGroupLimit, so no key sends more than k rows
    per map task through the shuffle."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = Window.partitionBy(*keys).orderBy(*order)
    out_df = df.withColumn(out, F.row_number().over(w))
    return out_df.filter(F.col(out) <= k) if k is not None else out_df
