"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import id_text, small_batches
from quarry.llm.pieces import encoder


def _piece_counts(model: str, texts: list[str], batch_chars: int) -> Iterator[int]:
    """Counts by a sentencepiece model; it has no safe boundaries that hold for every model, so texts stay whole."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    part, size = [], 0
    for t in [*texts, None]:
        if t is None or part and size + len(t) > batch_chars:
            yield from map(len, sp.encode(part, num_threads=1))
            part, size = [], 0
        if t is not None:
            part.append(t)
            size += len(t)


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 1024, batch_chars: int = 1 << 20) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    Tokens are those of the library for the file: ``tokenizers`` for ``.json`` (special strings inside a
    text are handled as the file says; nothing is added, cut or padded), ``sentencepiece`` for ``.model``
    (no begin or end tokens). Only lengths leave the Arrow function. Work inside a task goes in batches of
    about ``batch_chars`` characters, whatever the number of rows; long texts are cut at safe boundaries
    (see ``pieces``), which does not change their tokens. No shuffle; one row in, one row out, in any order.

    A null text counts as empty: 0 bytes, 0 tokens. A null id stays null. Repeated rows are counted each.
    Other columns are ignored. An empty table gives an empty table."""
    src = id_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None if tokenizer_path.endswith(".model") else encoder(tokenizer_path, batch_chars=batch_chars)
        for b in small_batches(batches):
            texts = [t or "" for t in b.column("_text").to_pylist()]
            n = list(_piece_counts(tokenizer_path, texts, batch_chars) if enc is None else enc.map(texts))
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    return src.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
