"""Resume-safe ingestion of arriving files.

Structured Streaming tracks which input files were processed in the
checkpoint (in the shared folder), so a job that is stopped, loses executors
or is simply run again processes exactly the unseen files.  With
``trigger(availableNow=True)`` each run drains what is there and stops - the
batch job the reference runs, made restartable.  The sink is a file sink,
whose commit log makes every micro-batch exactly-once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def resume_ingest(spark: SparkSession, src: str, sink: str, checkpoint: str, schema: T.StructType,
                  fn: Callable[[DataFrame], DataFrame] | None = None, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None, timeout_s: int | None = None,
                  unique_key: str | None = None) -> None:
    """Process every input file under ``src`` not processed before; append to ``sink``.

    ``unique_key``: ids may repeat across or inside input files; each micro-batch
    is then deduplicated on the key and anti-joined with the ids already in the
    sink before it is appended (``foreachBatch``), so the sink holds every id
    once and a replayed batch adds nothing.  No streaming state is kept."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(src)
    out = fn(stream) if fn else stream
    writer = out.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if unique_key is None:
        q = writer.format("parquet").option("path", sink).outputMode("append").start()
    else:
        out_schema = out.schema

        def append_unseen(batch: DataFrame, batch_id: int) -> None:
            ss = batch.sparkSession
            try:
                existing = ss.read.schema(out_schema).parquet(sink)
            except AnalysisException as e:  # first batch: no sink yet; any other failure must not pass for it
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                existing = ss.createDataFrame([], out_schema)
            unseen(batch, existing, unique_key).write.mode("append").parquet(sink)

        q = writer.foreachBatch(append_unseen).start()
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
    if q.exception() is not None:
        raise q.exception()


def encode_ingest(spark: SparkSession, src: str, sink: str, checkpoint: str, schema: T.StructType, encode: Callable[[DataFrame], DataFrame],
                  render: Callable[[DataFrame], DataFrame] | None = None, key: str = "id", fmt: str = "parquet",
                  max_files_per_trigger: int | None = None, timeout_s: int | None = None) -> None:
    """S10 with E1 and C25: arriving files to vectors, one row per ``key`` whatever files repeat it.

    Rows are rendered (filters and text), a key seen before is dropped by keyed streaming state, which lives in the
    checkpoint and holds keys only, and what is left of a micro-batch goes through ``encode`` into
    ``sink``/batch=N. The sink is never read: a batch that is run again after a failure overwrites its own folder,
    and its rows are the same, because the state of the batch before is restored. The first file to bring a key
    wins; of rows of one key in one micro-batch, any. Rows with a null key count as one key.

    The state store is RocksDB (on disk, not in the heap) unless the session names another."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(provider, None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark = spark.newSession()  # the caller's settings stay
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(src)
    stream = (render(stream) if render else stream).dropDuplicates([key])

    def write(batch: DataFrame, batch_id: int) -> None:
        encode(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    q = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
    if q.exception() is not None:
        raise q.exception()


def unseen(batch: DataFrame, sink: DataFrame, id_col: str = "id") -> DataFrame:
    """Batch fallback: rows whose id is not in the sink yet (anti join), one row per id
    (deterministically the smallest row of the id, C10, so a replay picks the same)."""
    from quarry.operators.clean import dedupe_id
    return dedupe_id(batch, id_col, None).join(sink.select(id_col), id_col, "left_anti")
