"""The registered ``opN_<name>`` queries (whole tables, production parameters) and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import oracle_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register()
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.packing import pack
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


@register()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.token_counts import token_counts
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


@register()
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.byte_bpe import decode, encode
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return (decode(ids, path, with_text=False)
            .select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")))


@register(oracle_sql.SUBSTRING)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.substring import remove_repeats
    return remove_repeats(_table(spark, sf_dir, "documents"), window=50, with_text=False)


@register(oracle_sql.NEAR)
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.minhash import near_duplicates
    return near_duplicates(_table(spark, sf_dir, "documents"), k=2, pct=80)


@register(oracle_sql.VECTORS)
def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.vectors import near_vectors
    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93)


@register(oracle_sql.quality_sql())
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.quality import quality
    return quality(_table(spark, sf_dir, "documents")).drop("probability")


@register()
def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.secrets import find_secrets
    return (find_secrets(_table(spark, sf_dir, "documents"))
            .select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"))


@register()
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.html_text import extract
    return extract(_table(spark, sf_dir, "pages"))


@register()
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.language_model import score
    return score(_table(spark, sf_dir, "documents"), modulus=7, held=2, order=2)


@register(oracle_sql.CODES)
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.codes import compress, digest
    coded, books = compress(_table(spark, sf_dir, "embeddings"))
    return coded.withColumn("codebooks_sha256", F.lit(digest(books)))


@register()
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.whitening import whiten
    return whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))


@register(oracle_sql.WARC)
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import warc
    folder = warc.archive_folder(spark)
    warc.write_pages(_table(spark, sf_dir, "pages"), folder, min_bytes=0)
    return warc.read_digests(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
