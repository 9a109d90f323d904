"""A training corpus from ``documents``: quality rules, near-dedup, substring dedup, secret scan, packing.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns the columns of
``documents``; the last one returns the packed pieces. Verdicts and new texts are joined by id and hash of
the text, so rows of a repeated id, or without id, stay apart; rows equal in both are one document, of which the
near-dedup stage keeps one row.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.minhash import near_duplicates
from quarry.llm.packing import pack
from quarry.llm.quality import quality
from quarry.llm.secrets import find_secrets, redact
from quarry.llm.substring import remove_repeats
from quarry.operators.common import materialize

WORD = r"[^\x20\x09-\x0D]"


def _rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): the caller's columns as one struct, so that none of them can clash with a stage's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``key``, a number for each different id and text: the id itself, and for rows without id and
    for all texts of a repeated id but one a hash of both from 2 ** 62 on, so that they come after all ids."""
    text = F.xxhash64("text")
    several = materialize(rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("first"), F.max(text).alias("last"))
                          .where("first < last").select(F.col("doc_id").alias("id"), "first"), "pipeline-repeated-ids")
    late = F.lit(1 << 62) + F.xxhash64("doc_id", "text").bitwiseAND((1 << 62) - 1)
    own = F.when(F.col("doc_id").isNull() | (text != F.col("first")), late).otherwise(F.col("doc_id").cast("long"))
    return rows.join(several, F.col("doc_id") == F.col("id"), "left").select("row", "doc_id", "text", own.alias("key"))


def _with_text(rows: DataFrame, text: F.Column) -> DataFrame:
    """The caller's rows with a new text and, where they have it, its length."""
    row = F.col("row").withField("text", text)
    if "n_chars" in rows.schema["row"].dataType.names:
        row = row.withField("n_chars", F.coalesce(F.char_length(text).cast("long"), F.col("row.n_chars")))
    return rows.select(row.alias("row")).select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; equal texts get equal verdicts.

    Null and empty texts have no words and go; a text of any length is judged whole; repeated rows, and rows of
    one id, are judged each by their text. An empty table stays empty. All columns come back as they were."""
    keyed = _rows(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    bad = quality(keyed.select("key", "text"), id_col="key").where("not kept").select("key").distinct()
    return keyed.join(bad, "key", "left_anti").select("row.*")


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8.

    Of rows equal in id and text one stays; rows of a repeated id or without id are documents of their own and come
    after all others. Texts without words are near to nothing and stay. An empty table stays empty."""
    keyed = _keyed(_rows(docs))
    kept = near_duplicates(keyed.select("key", "text"), k=5, pct=80, id_col="key").where("kept").select("key").distinct()
    return keyed.dropDuplicates(["key"]).join(kept, "key", "left_semi").select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that an earlier document has go; texts without removals stay as they are.

    A document of which nothing is left goes; null and empty texts lose nothing and stay. Earlier: smaller id;
    rows of a repeated id or without id come last. An empty table stays empty."""
    keyed = _keyed(_rows(docs))
    found = (remove_repeats(keyed.select("key", "text"), window=50, id_col="key", longest=False).where("n_removed > 0")
             .select("key", "kept_text").dropDuplicates(["key"]))
    return _with_text(keyed.join(found, "key", "left").where("kept_text is null or kept_text <> ''"), F.coalesce("kept_text", "text"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text becomes ``[SECRET]``; all rows stay.

    Null and empty texts have none. Rows equal in id and text share their finds. An empty table stays empty."""
    rows = _rows(docs)
    found = (find_secrets(rows.select("doc_id", "text")).where("size(found) > 0").dropDuplicates(["doc_id", "text_hash"])
             .select(F.col("doc_id").alias("id"), "text_hash", "found"))
    own = rows.join(found, rows["doc_id"].eqNullSafe(found["id"]) & (F.xxhash64(rows["text"]) == found["text_hash"]), "left")
    return _with_text(own, F.when(F.col("found").isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col("found"))))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, placed into sequences of 1024 tokens; an empty text is its end token."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [("quality_rules", quality_rules), ("minhash_near_dedup", minhash_near_dedup), ("substring_dedup", substring_dedup),
          ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

ORACLE_SQL = None  # tokenisers, sampled bins and sketches are beyond SQL; tests hold the rows against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what its predecessor kept; written as Parquet and read again in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
