"""A content-addressed WARC archive: payloads once by verified digest, exact record headers beside them.

An archive is a folder with two Parquet tables: ``payloads`` (sha256, payload) holds every distinct payload
once; ``records`` (header, sha256) holds the exact header bytes of each record, WARC and HTTP, and the key of
its payload. Joins give the records back. ``export_files`` writes them as .warc files, ``import_files`` reads such files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import attach, materialize
from quarry.sources.io import scratch_path

# Fixed values of the WARC 1.1 format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EOL = "\r\n"
ID = "urn:x-page:"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: ten hex digits at a time are eight digits of base 32."""
    hexes = F.sha1(payload)
    return F.concat(*[F.lpad(F.translate(F.conv(F.substring(hexes, i, 10), 16, 32), BASE32_HEX, BASE32), 8, "A") for i in (1, 11, 21, 31)])


def _header(date: str) -> Column:
    """The exact bytes before the payload, from _id, _url, type, sha1, bytes and refers."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(EOL * 2))
    revisit = F.col("type") == "revisit"
    url = F.regexp_replace(F.regexp_replace("_url", "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    page = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return F.concat(
        F.lit(f"WARC/1.1{EOL}"), line("WARC-Type", F.col("type")), line("WARC-Record-ID", page("_id")), line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", page("refers")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string")), F.lit(EOL), http).cast("binary")


def _store_payloads(payloads: DataFrame, folder: str) -> None:
    """(sha256, payload) once per digest. The digest is verified: payloads of one digest must agree in length and
    in a second digest, or the write fails."""
    checked = payloads.groupBy("sha256").agg(
        F.any_value("payload").alias("payload"), F.min(F.sha1("payload")).alias("a"), F.max(F.sha1("payload")).alias("b"),
        F.min(F.octet_length("payload")).alias("c"), F.max(F.octet_length("payload")).alias("d"))
    same = (F.col("a") == F.col("b")) & (F.col("c") == F.col("d"))
    checked.select("sha256", F.when(same, F.col("payload")).otherwise(F.raise_error(F.lit("different payloads with one SHA-256")).cast("binary")).alias("payload")) \
        .write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/payloads")


def write_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """One record per row of ``pages`` into the archive ``folder``.

    The payload is the text in UTF-8 (null: empty). Of records with equal payloads of at least ``min_bytes``
    bytes, that with the smallest id is a ``response``, the others ``revisit`` it; shorter ones are all
    ``response``. Either way a payload is stored once.

    A null id comes after all others; several null ids alone, like rows that repeat both id and payload of the
    response, are all ``response``. A null url gives no target line; line breaks in a url are written as %0D and %0A.
    An empty table gives an archive without records. Other columns are ignored."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{url_col}`").cast("string").alias("_url"),
                        F.coalesce(F.col(f"`{payload_col}`").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256))
    _store_payloads(rows.select("sha256", "payload"), folder)
    narrow = materialize(rows.select("_id", "_url", "sha256", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes")), "warc-digests")
    first = materialize(narrow.groupBy("sha256").agg(F.min("_id").alias("refers"), F.count("*").alias("copies")), "warc-first")
    revisit = (F.col("bytes") >= min_bytes) & F.coalesce(F.col("_id") != F.col("refers"), F.col("refers").isNotNull())
    records = attach(narrow, first, ["sha256"], "copies").withColumn("type", F.when(revisit, "revisit").otherwise("response"))
    records.select(_header(date).alias("header"), "sha256").write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/records")


def _field(name: str) -> Column:
    """A line of the WARC header as a string; null where there is none. Only the block up to the first empty line counts."""
    block = F.substring_index(F.decode("header", "UTF-8"), EOL * 2, 1)
    value = F.regexp_extract(block, f"(?i)\\r\\n{name}:[ \\t]*([^\\r\\n]*)", 1)
    return F.when(value != "", value)


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """(header, sha256, page_id, url, record_type, payload_digest, refers_to) as the exact headers of the archive say."""
    page = lambda name: F.regexp_extract(F.coalesce(_field(name), F.lit("")), f"^<{ID}(-?[0-9]+)>$", 1)
    number = lambda c: F.when(c != "", c).cast("long")
    return spark.read.schema("header binary, sha256 string").parquet(f"{folder}/records").select(
        "header", "sha256", number(page("WARC-Record-ID")).alias("page_id"), _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"), F.regexp_replace(_field("WARC-Payload-Digest"), "(?i)^sha1:", "").alias("payload_digest"),
        number(page("WARC-Refers-To")).alias("refers_to"))


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(sha256, payload) of the archive; a payload that no longer has its digest fails the read."""
    stored = spark.read.schema("sha256 string, payload binary").parquet(f"{folder}/payloads")
    return stored.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload"))
                             .otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("binary")))


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """``read_headers`` joined with the stored payloads' own figures: payload_bytes and stored_digest (base32 SHA-1),
    from bytes checked against their key. Payloads themselves are not sent to the join."""
    heads = read_headers(spark, folder)
    sizes = _payloads(spark, folder).select("sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("stored_digest"))
    copies = materialize(heads.groupBy("sha256").agg(F.count("*").alias("copies")).join(sizes, "sha256", "left"), "warc-sizes")
    return attach(heads, copies, ["sha256"], "copies")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """``read_headers`` with ``payload`` (of revisits too) and ``record``, the exact bytes of the original record: the
    header and, but for revisits, the payload, then two line ends. Joined by key; a payload with a third of
    all records is split by adaptive execution."""
    out = read_headers(spark, folder).join(_payloads(spark, folder), "sha256", "left")
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return out.withColumn("record", F.concat(F.col("header"), block, F.lit((EOL * 2).encode())))


def export_files(records: DataFrame, path: str, compression: str | None = "gzip", per_file: int = 100_000) -> None:
    """``records`` (column ``record``) as WARC files: the text sink writes bytes as they are, and the two line ends
    that close a record are its separator."""
    bare = F.expr(f"substring(record, 1, octet_length(record) - {2 * len(EOL)})").cast("string")
    out = records.select(bare.alias("value")).write.option("lineSep", EOL * 2).option("maxRecordsPerFile", per_file)
    (out.option("compression", compression) if compression else out).text(path)


_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*([0-9]+)", re.I)


def split_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, payload) of the records of one WARC file: WARC and, where there is one, HTTP header; then the rest of
    the block. Lengths decide, so payloads may hold anything. A cut last record raises ValueError."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        found = _LENGTH.search(data, at, end + 2) if end >= 0 else None
        if not data.startswith(b"WARC/", at) or not found or end + 4 + int(found[1]) > len(data):
            raise ValueError(f"no whole WARC record at byte {at}")
        body, stop = end + 4, end + 4 + int(found[1])
        if data.startswith(b"HTTP/", body) and (cut := data.find(b"\r\n\r\n", body, stop)) >= 0:
            body = cut + 4
        yield data[at:body], data[body:stop]
        at = stop + 4


def import_files(spark: SparkSession, path: str, folder: str) -> None:
    """WARC files (plain or gzip; each is one task's, so keep them bounded) into the archive ``folder``. Headers are
    kept byte for byte; revisits without a payload of their own point to the empty one."""
    import gzip
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                heads, payloads, size = [], [], 0
                for head, payload in split_records(data):
                    heads.append(head)
                    payloads.append(payload)
                    size += len(head) + len(payload)
                    if size > 4 << 20:
                        yield _batch(heads, payloads)
                        heads, payloads, size = [], [], 0
                if heads:
                    yield _batch(heads, payloads)

    def _batch(heads: list, payloads: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.array(payloads, pa.binary()),
                                           pa.array([hashlib.sha256(p).hexdigest() for p in payloads])], ["header", "payload", "sha256"])

    read = materialize(spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "header binary, payload binary, sha256 string"), "warc-import")
    _store_payloads(read.select("sha256", "payload"), folder)
    read.select("header", "sha256").write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/records")


def archive_folder(spark: SparkSession) -> str:
    """A fresh archive folder under the shared folder."""
    return scratch_path(spark, "warc-archive")
