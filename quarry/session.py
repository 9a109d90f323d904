"""Session construction and cluster-wide settings.

On a cluster the session already exists and carries its own settings; the
helpers here only fill in what is unset (tests, local runs).
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Exact top-k merges use row_number() <= k.  Spark only plans the partial
# (map-side) WindowGroupLimit while k <= this threshold, so keep it well above
# the search depths we use (the reference searches 10,000 deep).
GROUP_LIMIT_THRESHOLD = 100_000


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "quarry") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # 1024-d float vectors: keep Arrow batches around 20-40 MB
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.sql.optimizer.windowGroupLimitThreshold": str(GROUP_LIMIT_THRESHOLD),
        "spark.driver.memory": os.environ.get("QUARRY_DRIVER_MEMORY", "16g"),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if os.environ.get("QUARRY_EVENT_LOG_DIR"):  # stage/task timings for offline inspection
        conf["spark.eventLog.enabled"] = "true"
        conf["spark.eventLog.dir"] = os.environ["QUARRY_EVENT_LOG_DIR"]
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_runtime_conf(spark)
    return spark


def apply_runtime_conf(spark: SparkSession) -> None:
    """Settings the operators rely on; safe to call on an existing session."""
    cur = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
    if int(cur) < GROUP_LIMIT_THRESHOLD:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", str(GROUP_LIMIT_THRESHOLD))
    checkpoint_dir(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (set by the cluster).  Only when it is
    unset (local runs, tests) a scratch folder is created, registered, and
    removed when the process ends; on a cluster that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="quarry-ckpt-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d
