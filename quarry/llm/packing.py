"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_text, small_batches
from quarry.llm.pieces import encoder


class OpenBins:
    """Bounded-space online best fit: at most ``max_open`` open bins, in a bitset keyed by free space.

    Bit f of ``free`` is set while some open bin has f places left; ``at[f]`` lists those bins. A piece goes
    to the bin with the least free space that still holds it (the lowest set bit from its length on). If
    none does, a new bin opens, and if that is one too many, the fullest open bin closes. A full bin closes
    at once. Ties: the bin that came to this free space last."""

    def __init__(self, capacity: int, max_open: int):
        self.capacity, self.max_open = capacity, max_open
        self.free, self.at, self.n_open, self.n_bins = 0, {}, 0, 0

    def _take(self, f: int) -> int:
        bins = self.at[f]
        out = bins.pop()
        if not bins:
            self.free &= ~(1 << f)
        self.n_open -= 1
        return out

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of 1 to ``capacity`` places."""
        fits = self.free >> length
        if fits:
            f = length + (fits & -fits).bit_length() - 1
            where = self._take(f)
        else:
            f, where = self.capacity, self.n_bins
            self.n_bins += 1
        left = f - length
        if left:
            if self.n_open == self.max_open:
                fullest = (self.free & -self.free).bit_length() - 1
                if left <= fullest:  # the bin just filled is the fullest: it closes
                    return where, self.capacity - f
                self._take(fullest)
            self.at.setdefault(left, []).append(where)
            self.free |= 1 << left
            self.n_open += 1
        return where, self.capacity - f


OUT = ("id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, max_open: int = 512,
         id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ``ids`` as
    little-endian unsigned 32-bit bytes with ``keep_ids``).

    A document is its token ids (``tokenizers`` file, no added special tokens) and ``end_id``. Only
    documents of more than ``capacity`` ids are cut, into pieces of ``capacity``, the first one shorter
    where the length asks for it, so that only one piece of a document needs a partner. Pieces are placed in
    the order of the rows by bounded-space best fit (``OpenBins``), in each scan partition by itself: no
    shuffle, bounded memory, and a lost task packs its partition again in the same way. Sequences don't
    cross partitions; at most about one sequence a partition stays half empty. ``sequence_id`` is the
    partition number and a running number (any numbers, unique).

    A null or empty text is its end token alone. A null id stays null; repeated rows are packed each. Other
    columns are ignored. An empty table gives an empty table."""
    src = id_text(docs, id_col, text_col).select("_id", "_text", F.spark_partition_id().alias("_part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, bins = encoder(tokenizer_path, ids=True), OpenBins(capacity, max_open)
        end = int(end_id).to_bytes(4, "little")
        for b in small_batches(batches):
            texts = [t or "" for t in b.column("_text").to_pylist()]
            rows = []
            for doc, part, ids in zip(b.column("_id").to_pylist(), b.column("_part").to_pylist(), enc.map(texts)):
                ids += end
                n = len(ids) // 4
                first = n if n <= capacity else (n - 1) % capacity + 1
                start = 0
                for k, stop in enumerate(range(first, n + 1, capacity)):
                    own = ids[4 * start:4 * stop]
                    where, offset = bins.place(stop - start)
                    rows.append((doc, k, start, stop - start, zlib.crc32(own), (part << 40) + where, offset,
                                 *((own,) if keep_ids else ())))
                    start = stop
            cols = list(zip(*rows)) or [()] * (7 + keep_ids)
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
            names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names[:len(cols)])

    return src.mapInArrow(run, OUT + (", ids binary" if keep_ids else "")).withColumnRenamed("id", id_col)
