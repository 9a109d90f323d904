"""Vector code compression: one short code per part of an integer vector, by exact nearest codebook entries."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import attach, integer_matrix, integer_vectors, materialize

PARTS = 16      # equal consecutive parts of a vector
ENTRIES = 64    # entries of a part's codebook (two hex digits hold 256)
ROUNDS = 2
SCALE = 256     # a component x becomes floor(SCALE * x)
ROWS = 4096     # vectors compared at a time


def sequency(width: int) -> np.ndarray:
    """Rows of the natural Hadamard matrix by rising number of sign changes: bits of the Gray code, reversed."""
    bits = width.bit_length() - 1
    s = np.arange(width)
    gray = s ^ (s >> 1)
    return sum((((gray >> b) & 1) << (bits - 1 - b) for b in range(bits)), np.zeros(width, np.int64))


def walsh(x: np.ndarray) -> np.ndarray:
    """Integer Walsh-Hadamard transform of the rows, zero-padded to a power of two, in sequency order. Squared
    distances of transforms are those of the rows times the padded width."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    out = np.zeros((len(x), width), x.dtype)
    out[:, :x.shape[1]] = x
    h = 1
    while h < width:
        pairs = out.reshape(len(x), -1, 2, h)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), width)
        h *= 2
    return out[:, sequency(width)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, ties to the lower index, in integers alone.

    The slowest coefficient comes first: its difference gives every entry a lower bound and the likely best
    one, whose whole distance is the row's upper bound. The other coefficients are added one by one to the
    entries still at or below that bound; an entry above it can't win and is dropped."""
    if not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.int64 if (2 * top * width) ** 2 < 1 << 62 else object  # beyond 64 bits: Python's integers
    a, b = walsh(x.astype(kind)), walsh(book.astype(kind))
    first = (a[:, :1] - b[:, 0]) ** 2
    likely = first.argmin(1)
    bound = ((a - b[likely]) ** 2).sum(1)
    row, entry = np.nonzero(first <= bound[:, None])
    total = first[row, entry]
    for j in range(1, width):
        total = total + (a[row, j] - b[entry, j]) ** 2
        on = (total <= bound[row]).astype(bool)
        row, entry, total = row[on], entry[on], total[on]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    best = np.minimum.reduceat(total, starts)
    at = np.flatnonzero(total == best[row])
    _, one = np.unique(row[at], return_index=True)  # entries of a row rise
    return entry[at[one]], best // width


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) entry numbers and each row's squared distances, summed over the parts."""
    parts, _, width = books.shape
    codes, error = np.zeros((len(x), parts), np.int64), np.zeros(len(x), object)
    for at in range(0, len(x), ROWS):
        piece = slice(at, at + ROWS)
        for p in range(parts):
            codes[piece, p], e = nearest(x[piece, p * width:(p + 1) * width], books[p])
            error[piece] = error[piece] + e
    return codes, error


def _sums(books: np.ndarray) -> Callable:
    """A task's totals: (part, entry, pos, total, n) for every entry that some part of its rows is nearest to."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), object), np.zeros(parts * entries, np.int64)
        for b in batches:
            x = integer_matrix(b.column("x"), parts * width)
            codes, _ = assign(x, books)
            for p in range(parts):
                key = codes[:, p] + p * entries
                order = np.argsort(key, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(order) else np.zeros(0, np.int64)
                if len(starts):
                    total[key[order][starts]] += np.add.reduceat(x[order, p * width:(p + 1) * width], starts, axis=0).astype(object)
            count += np.bincount((codes + np.arange(parts) * entries).ravel(), minlength=parts * entries)
        used = np.flatnonzero(count)
        flat = np.repeat(used, width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(flat // entries, pa.int32()), pa.array(flat % entries, pa.int32()), pa.array(np.tile(np.arange(width), len(used)), pa.int32()),
             pa.array(total[used].ravel().tolist(), pa.int64()), pa.array(np.repeat(count[used], width), pa.int64())],
            ["part", "entry", "pos", "total", "n"])
    return run


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((id, code, error, label_error), codebooks) of the rows of ``vectors`` whose vector is whole.

    Components become integers floor(scale * x); a vector is cut into ``parts`` equal consecutive parts.
    Each part position has a codebook, at first that part of the ``entries`` smallest ids. ``rounds`` times,
    every part goes to its codebook's nearest entry and each entry becomes the floor of the mean of its parts
    (unused ones stay); then the parts are assigned once more. ``code``: entry numbers as two hex digits each;
    ``error``: squared distances summed over the parts; ``label_error``: errors summed over the rows of the
    same label, null labels together. Codebooks: integers (part, entry, position).

    Rows stay where they are: tasks hold the codebooks (``entries`` vectors, the proven bound of what is
    broadcast) and give sums per entry, of which the driver sees one per number in the codebooks.
    All arithmetic is on integers; order and partitions of the rows do not matter.

    Dropped: null vectors and vectors with a null or non-finite component. Shorter vectors count as filled up
    with zeros to the longest, and that to a multiple of ``parts``. Ids: nulls come last, rows with one id by
    their components; each row is coded for itself. Fewer rows than ``entries``: so many entries. An empty
    table: an empty result and codebooks without entries. Other columns are ignored. Sums beyond 64 bits
    raise an error."""
    spark = vectors.sparkSession
    kept = materialize(integer_vectors(vectors, id_col, vector_col, scale, 0, F.col(f"`{label_col}`").cast("string").alias("label")), "codes-in")
    longest = kept.agg(F.max(F.size("x"))).first()[0] or 0
    width = -(-longest // parts)
    first = kept.orderBy(F.col("_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    start = integer_matrix(pa.array([r["x"] for r in first], pa.list_(pa.int64())), parts * width)
    books = start.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if first else 0):
        sums = (kept.select("x").mapInArrow(_sums(books), "part int, entry int, pos int, total long, n long")
                .groupBy("part", "entry", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toPandas())
        books[sums.part, sums.entry, sums.pos] = sums.total // sums.n

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, error = assign(integer_matrix(b.column("x"), parts * width), books)
            hexes = codes.astype(np.uint8).tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), b.column("label"), pa.array([hexes[i:i + 2 * parts] for i in range(0, len(hexes), 2 * parts)], pa.string()),
                 pa.array(error.tolist(), pa.int64())], ["_id", "label", "code", "error"])

    coded = materialize(kept.mapInArrow(code, "_id long, label string, code string, error long"), "codes-out")
    totals = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")), "codes-labels")
    out = attach(coded, totals, ["label"], "rows")
    return out.select(F.col("_id").alias(id_col), "code", "error", "label_error"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all numbers of the codebooks by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()


def restore(coded: DataFrame, books: np.ndarray, code_col: str = "code", out: str = "approximate") -> DataFrame:
    """``coded`` with the integer vector that its code stands for (zero padding included); a null code gives null."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [None if c is None else books[np.arange(parts), np.frombuffer(bytes.fromhex(c), np.uint8)].ravel().tolist()
                       for c in b.column(code_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.int64()))], [*b.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    return coded.mapInArrow(run, f"{fields}, `{out}` array<long>")
