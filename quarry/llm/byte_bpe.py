"""Byte-level BPE by a rank file: encoding with offsets, and decoding."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_text, small_batches
from quarry.llm.pieces import SegmentEncoder, byte_chars


# The usual split pattern of byte-level BPE (fixed value); for it, plain words need no pattern matching.
LETTERS_OR_PUNCTUATION = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in f if line.strip())}


def ranks_tokenizer(ranks: dict[bytes, int], pattern: str):
    """A ``tokenizers`` BPE that merges as the ranks say.

    Its vocabulary writes each byte as a character; every way to put a token together from two others is
    a merge, in order of the token's rank. A match that is a token itself is taken whole."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers
    chars = byte_chars()
    shown = {tok: "".join(chars[b] for b in tok) for tok in ranks}
    merges = [(shown[tok[:i]], shown[tok[i:]])
              for tok in sorted(ranks, key=ranks.get) for i in range(1, len(tok))
              if tok[:i] in ranks and tok[i:] in ranks]
    tk = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tk.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tk


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           offsets: bool = False) -> DataFrame:
    """(id, ids) for every row of ``docs``: ``ids`` is binary, little-endian unsigned 32-bit.

    Each match of ``pattern`` is encoded by itself, without special tokens. With ``offsets`` the columns
    ``starts`` and ``ends`` (arrays of int) give each token's characters (code points) in the text; tokens
    that share a split character all cover it. The library does the merges over Arrow batches; bytes are
    mapped to characters for it.

    A null text counts as empty (no ids). A null id stays null; repeated rows are encoded each; other
    columns are ignored; an empty table gives an empty table."""
    src = id_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk = ranks_tokenizer(read_ranks(ranks_path), pattern)
        enc = SegmentEncoder(tk, lambda token, _: len(token), ids=True, words=pattern == LETTERS_OR_PUNCTUATION)
        for b in small_batches(batches):
            texts = [t or "" for t in b.column("_text").to_pylist()]
            if not offsets:
                yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(enc.map(texts), pa.binary())], ["id", "ids"])
                continue
            rows = []
            for part in enc.batches(texts):
                for e in tk.encode_batch(part, add_special_tokens=False):
                    rows.append((np.array(e.ids, "<u4").tobytes(), [x for x, _ in e.offsets], [y for _, y in e.offsets]))
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array([r[0] for r in rows], pa.binary()),
                 pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.int32()))],
                ["id", "ids", "starts", "ends"])

    more = ", starts array<int>, ends array<int>" if offsets else ""
    return src.mapInArrow(run, f"id long, ids binary{more}").withColumnRenamed("id", id_col)


def token_bytes(ranks: dict[bytes, int]) -> dict[int, bytes]:
    """id -> bytes, read back through the byte table: the inverse of what ``ranks_tokenizer`` writes."""
    back = {c: b for b, c in enumerate(byte_chars())}
    chars = byte_chars()
    return {r: bytes(back[chars[b]] for b in tok) for tok, r in ranks.items()}


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids",
           with_text: bool = True) -> DataFrame:
    """(id, ids, n_tokens, decoded, text) of the binary ids that ``encode`` gives.

    ``decoded`` joins the bytes of all tokens, so characters that are split over tokens come together
    again; ``text`` (left out without ``with_text``) reads them as UTF-8, where bytes that are no character
    become U+FFFD. Unknown ids raise. Null or empty ids give 0 tokens and empty values."""
    src = encoded.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{ids_col}`").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = token_bytes(read_ranks(ranks_path)).__getitem__
        for b in small_batches(batches, "_ids"):
            ids = [x or b"" for x in b.column("_ids").to_pylist()]
            raw = [b"".join(map(of, np.frombuffer(x, "<u4").tolist())) for x in ids]
            cols = [b.column("_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(raw, pa.binary())]
            if with_text:
                cols.append(pa.array([x.decode("utf-8", "replace") for x in raw], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["id", "ids", "n_tokens", "decoded", "text"][:len(cols)])

    schema = "id long, ids binary, n_tokens long, decoded binary" + (", text string" if with_text else "")
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)
