"""Sources, sinks and layout.

Readers take explicit schemas (no inference at scale), writers bound file
sizes, and id lookups are semi joins against a table laid out by id.
"""

from __future__ import annotations

import math
import uuid as _uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import checkpoint_dir

# Field names and types of the input.
RAW_WORK_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("abstract_inverted_index", T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))),
    T.StructField("language", T.StringType()),
])

# Upper bound on an id list that is shipped to every task.
MAX_BROADCAST_IDS = 5_000_000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never machine-local on a cluster)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{_uuid.uuid4().hex[:12]}"


# --------------------------------------------------------------------------- S1
def read_works_jsonl(spark: SparkSession, path: str, schema: T.StructType = RAW_WORK_SCHEMA,
                     recursive: bool = False) -> DataFrame:
    """(gzipped) JSON lines of raw work records, projected to the fixed schema.

    Other JSON fields are ignored by the explicit schema.  gz files are not
    splittable: each file is one task, so the writer should keep files bounded
    (S5).  ``recursive`` reads all directory levels."""
    r = spark.read.schema(schema)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    return r.json(path)


def inverted_index(df: DataFrame, text_col: str, id_col: str = "id",
                   out: str = "abstract_inverted_index") -> DataFrame:
    """Build the word -> positions map of a text (words split on single spaces).

    The inverse of ``restore_abstract``; used to build raw snapshots from the
    fixture documents.  A row's map is made from the row alone, no word is shuffled; only texts of
    rows that share an id are brought together (explode + group by (id, word)), as all of these rows get the map of their
    common words.  Words are ordered by first position; a null text or id gives a null map."""
    twice = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("_n")).where("_n > 1").select(id_col)
    if twice.isEmpty():
        return _row_indexes(df, text_col, id_col, out)
    once, more = df.join(twice, id_col, "left_anti").select(*df.columns), df.join(twice, id_col, "left_semi").select(*df.columns)
    words = more.select(id_col, F.posexplode(F.split(F.col(text_col), " ", -1)).alias("p", "w"))
    per_word = (words.groupBy(id_col, "w")
                .agg(F.min("p").alias("first"), F.array_sort(F.collect_list(F.col("p").cast("int"))).alias("ps")))
    per_doc = (per_word.groupBy(id_col)
               .agg(F.array_sort(F.collect_list(F.struct("first", "w", "ps"))).alias("_e"))
               .select(id_col, F.map_from_arrays(F.transform("_e", lambda e: e["w"]),
                                                 F.transform("_e", lambda e: e["ps"])).alias(out)))
    own = more.drop(text_col).join(per_doc, id_col, "left")
    return _row_indexes(once, text_col, id_col, out).unionByName(own)


ROWS_AT_ONCE = 512  # rows whose words a task sorts together


def _row_indexes(df: DataFrame, text_col: str, id_col: str, out: str) -> DataFrame:
    """``inverted_index`` of rows by themselves: words are sorted with their places, and a word's run becomes one entry."""
    rest = [c for c in df.columns if c != text_col]

    def run(batches):
        for whole in batches:
            for i in range(0, len(whole), ROWS_AT_ONCE):
                batch = whole.slice(i, ROWS_AT_ONCE)
                words = pc.split_pattern(batch.column(text_col), " ")
                null = words.is_null().to_numpy(zero_copy_only=False)
                lens = pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int64)
                own = words.flatten().dictionary_encode()
                code, row = own.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(lens)), lens)
                place = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
                order = np.argsort(row * max(1, len(own.dictionary)) + code, kind="stable")
                code, row, place = code[order], row[order], place[order]
                first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
                positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(place, pa.int32()))
                entries = np.lexsort((place[first], row[first]))  # words of a row by their first place
                ends = np.cumsum(np.bincount(row[first], minlength=len(lens)))
                offsets = pa.array(np.append(0, ends), pa.int32(), mask=np.append(null, False))
                maps = pa.MapArray.from_arrays(offsets, own.dictionary.take(pa.array(code[first][entries])), positions.take(pa.array(entries)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], maps], [*rest, out])

    fields = [*[df.schema[c] for c in rest], T.StructField(out, T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))]
    return df.withColumn(text_col, F.when(F.col(id_col).isNotNull(), F.col(text_col))).mapInArrow(run, T.StructType(fields))


def write_works_jsonl(df: DataFrame, path: str, compression: str = "gzip", max_rows: int | None = None) -> None:
    w = df.write.mode("overwrite").option("compression", compression)
    if max_rows:
        w = w.option("maxRecordsPerFile", max_rows)
    w.json(path)


def build_corpus(spark: SparkSession, raw_path: str) -> DataFrame:
    """Corpus build (3.1): S1 -> C1 -> C2: English works with a restored abstract."""
    from quarry.functions.text import restore_abstract
    from quarry.operators.clean import english_with_abstract
    raw = read_works_jsonl(spark, raw_path)
    kept = english_with_abstract(raw, abstract_col="abstract_inverted_index")
    return kept.select("id", "title", restore_abstract("abstract_inverted_index").alias("abstract"), "language")


# --------------------------------------------------------------------------- S2
def read_chunks(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Multi-file Parquet scan (lazy; Catalyst pushes filters and prunes columns)."""
    r = spark.read
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    return r.parquet(path)


# --------------------------------------------------------------------------- S3
def read_tagged_csv(spark: SparkSession, path: str, schema: T.StructType, file_topics: DataFrame,
                    key_pattern: str = r"([^/]+)/[^/]*$") -> DataFrame:
    """S3: many CSV files, each row tagged with its file's topic.

    ``file_topics(file_key, topic)`` maps a key extracted from each file path
    (by ``key_pattern``, default the parent folder name) to a topic.  The
    mapping has one row per file; AQE broadcasts it once its measured size is small.
    Rows of files that it does not name are kept, with a null topic."""
    df = (spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
          .option("recursiveFileLookup", "true").schema(schema).csv(path))
    df = df.withColumn("file_key", F.regexp_extract(F.col("_metadata.file_path"), key_pattern, 1))
    return df.join(file_topics, "file_key", "left").drop("file_key")


# --------------------------------------------------------------------------- S4
# Field names and types of the input.
RQ_SCHEMA = T.StructType([T.StructField("main", T.StringType()),
                          T.StructField("sub", T.ArrayType(T.StringType()))])
TOPIC_SCHEMA = T.MapType(T.StringType(), T.StructType([
    T.StructField("RQs", T.MapType(T.StringType(), RQ_SCHEMA)),
    T.StructField("query", T.StringType()),
    T.StructField("generated", T.StringType()),
]))


def read_topic_config(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """Topic -> research questions JSON, exploded to
    ``topic, rq_no, main, subs, query, generated`` (rq_no from the ``RQ<i>`` key).

    ``whole_file``: each file is one JSON object holding every topic (the
    reference's layout, one task per file); otherwise every line is such an
    object, typically one topic per line, and the files split freely."""
    raw = spark.read.text(path, wholetext=whole_file)
    cfg = raw.select(F.explode(F.from_json("value", TOPIC_SCHEMA)).alias("topic", "t"))
    rqs = cfg.select("topic", F.col("t.query").alias("query"), F.col("t.generated").alias("generated"),
                     F.explode("t.RQs").alias("rq_key", "rq"))
    return rqs.select("topic", F.regexp_extract("rq_key", r"(\d+)$", 1).cast("int").alias("rq_no"),
                      F.col("rq.main").alias("main"), F.coalesce(F.col("rq.sub"), F.array().cast("array<string>"))
                      .alias("subs"), "query", "generated")


def write_topic_config(cfg: DataFrame, path: str) -> None:
    """Write ``topic, rq_no, main, subs[, query, generated]`` rows as JSON lines, one
    ``{topic: {RQs: {RQ<i>: {main, sub}}, query, generated}}`` object per topic."""
    extra = [c for c in ("query", "generated") if c in cfg.columns]
    per_topic = cfg.groupBy("topic").agg(
        F.map_from_entries(F.collect_list(F.struct(
            F.concat(F.lit("RQ"), F.col("rq_no").cast("string")),
            F.struct(F.col("main"), F.col("subs").alias("sub"))))).alias("RQs"),
        *[F.first(c).alias(c) for c in extra])
    obj = F.create_map(F.col("topic").cast("string"), F.struct("RQs", *extra))
    per_topic.select(F.to_json(obj).alias("value")).write.mode("overwrite").text(path)


# --------------------------------------------------------------------------- S5 / S6
def write_sized(df: DataFrame, path: str, max_rows: int = 2_000_000, fmt: str = "parquet",
                mode: str = "overwrite") -> None:
    """Output files of at most ``max_rows`` rows each."""
    df.write.mode(mode).option("maxRecordsPerFile", max_rows).format(fmt).save(path)


def path_bytes(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength())


# Up to so many planned files are read and written file by file, without a shuffle (a scan each in the plan) ...
GROUPS_PER_JOB = 64
# ... more by jobs of so many files, a task each, to which the rows are sent.
FILES_PER_JOB = 1024


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the data files below ``path``: a listing by Spark's tasks, nothing is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return sorted((r["path"], r["length"]) for r in found.collect())


def plan_groups(files: list[tuple[str, int]], target_bytes: int) -> list[list[str]]:
    """First fit decreasing: groups of files of at most ``target_bytes`` together (a larger file is alone), at most one of
    them below half of it. The free space of the groups lies in a tree, so each file finds its group in log time."""
    size = 1 << max(0, len(files) - 1).bit_length()
    free = [target_bytes] * (2 * size)  # node i covers nodes 2 i and 2 i + 1; leaves are groups
    groups: list[list[str]] = []
    for path, n in sorted(files, key=lambda f: (-f[1], f[0])):
        at = 1
        if n > target_bytes:
            at = size + len(groups)
        else:
            while at < size:
                at = 2 * at if free[2 * at] >= n else 2 * at + 1
        if at - size == len(groups):
            groups.append([])
        groups[at - size].append(path)
        free[at] = max(-1, free[at] - n)
        while at > 1:
            at //= 2
            free[at] = max(free[2 * at], free[2 * at + 1])
    return groups


def _same_path(path) -> F.Column:
    """A file's path as one spelling: ``scheme:///x`` and ``scheme:/x`` are the same file."""
    return F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def _with_file(spark: SparkSession, paths: list[str], fmt: str, schema: T.StructType) -> DataFrame:
    """The rows of files with ``_file`` (its path in one spelling) and ``_at``, which grows along a file that one task reads."""
    rows = spark.read.format(fmt).schema(schema).load(paths)
    return rows.select("*", _same_path(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))).alias("_file"),
                       F.monotonically_increasing_id().alias("_at"))


def compact(spark: SparkSession, src: str, dst: str, target_bytes: int = int(2.5 * 1024 ** 3),
            fmt: str = "parquet", order_by: str | None = None) -> int:
    """Rewrite the files of a folder into files of at most about ``target_bytes``. Returns their number.

    The files are dealt into groups by first fit decreasing over their listed sizes (``plan_groups``). One
    task writes a group as one file: it reads the group's files where there are few groups, else one scan
    reads the files of ``FILES_PER_JOB`` groups and each row is sent to its group's task (a shuffle of the rows). Rows of a file stay
    together, sorted by ``order_by`` if given. A file above the target, read or written, is cut into equal parts, all such
    files by the same jobs; only a single row may be larger. Rows are kept as they are; the schema is kept by one file without rows."""
    files = list_files(spark, src)
    sizes = dict(files)
    schema = spark.read.format(fmt).load(src).schema
    keys = ([order_by] if order_by else []) + ["_at"]
    whole = [g for g in plan_groups(files, target_bytes) if sizes[g[0]] <= target_bytes]
    spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").format(fmt).save(dst)

    def write(rows: DataFrame, n: int) -> None:
        """Rows with a number ``_to`` below ``n`` become ``n`` files."""
        (rows.repartitionById(n, "_to").sortWithinPartitions(*keys).select(*schema.names)
         .write.mode("append").format(fmt).save(dst))

    def gather(groups: list[list[str]]) -> None:
        """One file for each group of files."""
        if len(groups) <= GROUPS_PER_JOB:
            out = None
            for g in groups:
                own = spark.read.format(fmt).schema(schema).load(g).coalesce(1)
                own = own.sortWithinPartitions(order_by) if order_by else own
                out = own if out is None else out.union(own)
            if groups:
                out.write.mode("append").format(fmt).save(dst)
            return
        for i in range(0, len(groups), FILES_PER_JOB):
            some = groups[i:i + FILES_PER_JOB]
            to = spark.createDataFrame([(f, n) for n, g in enumerate(some) for f in g], "_file string, _to int").withColumn("_file", _same_path(F.col("_file")))
            rows = _with_file(spark, [f for g in some for f in g], fmt, schema).join(F.broadcast(to), "_file", "left")
            lost = F.raise_error(F.concat(F.lit("a file without a group: "), F.col("_file"))).cast("int")
            write(rows.withColumn("_to", F.coalesce("_to", lost)), len(some))

    def cut(large: list[tuple[str, int]]) -> set[str]:
        """The rows of each of these files in equal parts below the target; the files that were cut: those of more than a row."""
        done = set()
        for i in range(0, len(large), FILES_PER_JOB):
            some = large[i:i + FILES_PER_JOB]
            names = spark.createDataFrame([(p, -(-n // target_bytes) + 1) for p, n in some], "path string, parts int").withColumn("_file", _same_path(F.col("path")))
            rows = _with_file(spark, [p for p, _ in some], fmt, schema)
            counts = rows.groupBy("_file").agg(F.count("*").alias("n")).join(F.broadcast(names), "_file").where("n > 1").collect()  # a row per file
            first, deal = 0, []
            for c in sorted(counts, key=lambda c: c["path"]):
                per_file = max(1, c["n"] // c["parts"])
                deal.append((c["_file"], first, per_file))
                first += -(-c["n"] // per_file)
            if deal:
                own = rows.join(F.broadcast(spark.createDataFrame(deal, "_file string, _first int, _per int")), "_file")
                place = F.row_number().over(Window.partitionBy("_file").orderBy(*keys)) - 1
                write(own.withColumn("_to", F.col("_first") + F.floor(place / F.col("_per")).cast("int")), first)
            done |= {c["path"] for c in counts}
        return done

    gather(whole)
    large = [f for f in files if f[1] > target_bytes]
    parted = cut(large)
    gather([[p] for p, _ in large if p not in parted])  # single rows
    done = set()
    while True:  # encoded together, rows may take more bytes than they did apart: such files are cut as well
        now = list_files(spark, dst)
        large = [f for f in now if f[1] > target_bytes and f[0] not in done]
        if not large:
            return len(now)
        done |= {p for p, _ in large}
        for path in cut(large):
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, False)


# --------------------------------------------------------------------------- S7
def write_result(df: DataFrame, path: str, max_rows: int = 5_000_000) -> None:
    """A small result table as one CSV file with header (report sink); larger tables raise."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows: not a report; write it as a partitioned table")
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def read_result(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read.option("header", "true")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", "true")
    return r.csv(path)


# --------------------------------------------------------------------------- S8 / S9
# Requests up to this many ids become a literal IN filter pushed into the scan.
MAX_PUSHED_IDS = 10_000
# ... together with at most this many id ranges, which Parquet statistics are held against.
MAX_RANGES = 64


def write_by_id(df: DataFrame, path: str, n_files: int, id_col: str = "id") -> None:
    """Lay a table out for id lookups: range-partitioned and sorted by id, so every
    file and row group covers a narrow id range and Parquet min/max statistics
    let a lookup skip almost all of them (the reference keeps a key-value index)."""
    (df.repartitionByRange(n_files, id_col).sortWithinPartitions(id_col)
     .write.mode("overwrite").parquet(path))


def lookup(table: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """All rows of ``table`` whose id is requested; unknown ids are skipped.

    Small requests (counted, at most ``MAX_PUSHED_IDS``) become an ``IN`` filter and a few
    ranges that reach the Parquet scan, so on a table written by ``write_by_id`` only
    the files and row groups whose id range holds a requested id are read.
    Larger requests are a broadcast semi join while under ``MAX_BROADCAST_IDS``,
    beyond that a shuffled semi join; see ``lookup_buckets`` for a table that is not shuffled."""
    req = ids.select(id_col).distinct()
    head = req.limit(MAX_PUSHED_IDS + 1).collect()
    if len(head) <= MAX_PUSHED_IDS:
        wanted = [r[0] for r in head]
        return table.filter(_ranges(wanted, id_col) & F.col(id_col).isin(wanted))
    if req.count() <= MAX_BROADCAST_IDS:
        req = F.broadcast(req)
    return table.join(req, id_col, "left_semi")


def _ranges(wanted: list, id_col: str, most: int = MAX_RANGES) -> F.Column:
    """A condition that holds for all of ``wanted`` and reaches the scan whatever the length of the list (Spark hands
    long IN lists to Parquet as one range): at most ``most`` ranges of ids, cut at the widest gaps."""
    own = sorted(w for w in wanted if w is not None)
    if not own:
        return F.lit(False)
    if isinstance(own[0], str):
        cuts = [len(own) * i // most for i in range(1, most)]
    else:
        cuts = sorted(sorted(range(1, len(own)), key=lambda i: own[i - 1] - own[i])[:most - 1])
    starts = sorted({0, *(c for c in cuts if c > 0)})
    cond = None
    for a, b in zip(starts, [*starts[1:], len(own)]):
        one = F.col(id_col).between(F.lit(own[a]), F.lit(own[b - 1]))
        cond = one if cond is None else cond | one
    return cond


def write_buckets(df: DataFrame, table: str, buckets: int, id_col: str = "id") -> None:
    """A table for large id requests: bucketed and sorted by id in the warehouse, with Parquet bloom filters on the id,
    so that a request scattered over all id ranges still skips row groups."""
    (df.write.mode("overwrite").format("parquet").bucketBy(buckets, id_col).sortBy(id_col)
     .option(f"parquet.bloom.filter.enabled#{id_col}", "true").saveAsTable(table))


def lookup_buckets(spark: SparkSession, table: str, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """S8 for requests of any size on a ``write_buckets`` table: a semi join bucket by bucket. Only the requested ids
    are shuffled, into the table's own buckets; the table is read where it lies. Small requests go by ``lookup``."""
    req = ids.select(id_col).distinct()
    if len(req.limit(MAX_PUSHED_IDS + 1).collect()) <= MAX_PUSHED_IDS:
        return lookup(spark.table(table), req, id_col)
    return spark.table(table).join(req.hint("merge"), id_col, "left_semi")


def contains(table: DataFrame, request: DataFrame, id_col: str = "id", pos_col: str = "pos") -> DataFrame:
    """The requested ids that exist, in request order, duplicates kept."""
    return (request.join(table.select(id_col), id_col, "left_semi")
            .orderBy(pos_col))


# --------------------------------------------------------------------------- S11
def point_uuid(id_col) -> F.Column:
    """Deterministic UUID-formatted id from the md5 of the id (reruns agree)."""
    h = F.md5(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"))
    return F.concat_ws("-", F.substr(h, F.lit(1), F.lit(8)), F.substr(h, F.lit(9), F.lit(4)),
                       F.substr(h, F.lit(13), F.lit(4)), F.substr(h, F.lit(17), F.lit(4)),
                       F.substr(h, F.lit(21), F.lit(12)))


def export_points(df: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """One point per vector: ``uuid, vector, payload(struct of all other columns)``."""
    others = [c for c in df.columns if c != vec_col]
    return df.select(point_uuid(id_col).alias("uuid"), F.col(vec_col).alias("vector"),
                     F.struct(*others).alias("payload"))
