"""A hierarchical Pitman-Yor language model, sampled by Gibbs over Spark, and scores of texts."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import id_text, materialize, small_batches

BITS = 9                       # of a symbol: 256 bytes, end of word, start of word
END, START = 256, 257
ORDER = 4                      # characters of context
SYMBOL = (1 << BITS) - 1
STRENGTH = 1.0                 # of every restaurant
CHUNK_TOKENS = 2_000_000       # tokens of the documents that are looked up together
MODEL_ROWS = 4_000_000         # rows of the spelling model that a task holds at once (64 MB)
SEAT_BLOCK = 1_000_000         # customers that are seated together
BUCKET_PAIRS = 2_000_000       # tokens, so at most pairs, that are counted together
PASSES = 3                     # parts in which pairs are counted and chunks are scored, one after the other
END_TOKEN = b"\xff"            # the end of a text as a token; no UTF-8 word has this byte


def _free(table: DataFrame) -> None:
    """Delete a table of this run that only steps already written have read."""
    spark = table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _drop_shuffles(spark)


def _drop_shuffles(spark: SparkSession) -> None:
    """Spark deletes shuffle files once the driver has dropped what made them."""
    spark._jvm.System.gc()


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def mix(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each number (splitmix's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Draws:
    """Random numbers that depend on the seed, a row's own key and the place in the row, so that neither the
    order of rows nor how they are dealt to tasks changes them."""

    def __init__(self, keys: np.ndarray, *seed: int):
        salt = np.array([sum((x + 1) * 0x9E3779B97F4A7C15 ** (i + 1) for i, x in enumerate(seed)) % (1 << 64)], np.uint64)
        self.keys = mix(keys.view(np.uint64) ^ salt)

    def random(self, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        return (mix(self.keys[at] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) / (1 << 53)


def seat(customers: np.ndarray, new: np.ndarray, discount: float, rng) -> np.ndarray:
    """Number of tables after seating each dish's customers again, one after the other, given all other
    seats: a customer opens a table with odds ``new`` (strength and tables of the restaurant times the parent's
    probability) against the seats taken less the discounts. All dishes take a customer at a time, and from the
    32nd on the customers of many dishes come together in blocks (see ``_seat_block``), to the same result.
    ``rng`` is a numpy generator or ``Draws``."""
    draw = rng.random if isinstance(rng, Draws) else lambda at, place: rng.random(len(at))
    t = (customers > 0).astype(np.int64)
    at = np.flatnonzero(customers > 1)
    for i in range(1, 32):
        if not len(at):
            return t
        odds = new[at]
        t[at] += draw(at, np.array([i])) * (i - discount * t[at] + odds) < odds
        at = at[customers[at] > i + 1]
    start = np.full(len(at), 32, np.int64)
    while len(at):
        ends = np.cumsum(customers[at] - start)
        n = max(1, int(np.searchsorted(ends, SEAT_BLOCK, "right")))
        dish, since = at[:n], start[:n]
        size = np.minimum(customers[dish] - since, SEAT_BLOCK)
        t[dish] += _seat_block(dish, since, size, t[dish], new[dish], discount, draw)
        start[:n] += size
        done = 0 if start[0] < customers[at[0]] else n  # a dish of more than a block goes on with the next
        at, start = at[done:], start[done:]
    return t


def _seat_block(dish, since, size, t, new, discount, draw) -> np.ndarray:
    """New tables of each dish among its next ``size`` customers after ``since``. Whether a customer opens one depends
    on the tables opened before only within narrow bounds, so most are settled at once; the others are settled again
    and again from the left until nothing changes, which is what one after the other gives."""
    first = np.cumsum(size) - size
    own = np.repeat(np.arange(len(size)), size)
    after = np.arange(len(own)) - first[own]
    u = draw(dish[own], since[own] + after)
    base, odds = (since - discount * t + new)[own], new[own]
    opens = u * (base + after) < odds                                    # with no table opened in the block before
    open_to = np.flatnonzero(~opens & (u * (base + (1 - discount) * after) < odds))  # with all of them opened
    counts = np.cumsum(opens)
    tables = np.add.reduceat(opens, first, dtype=np.int64)
    if len(open_to):
        mine, u, odds = own[open_to], u[open_to], odds[open_to]
        before = counts[open_to] - (counts[first] - opens[first])[mine]  # settled tables of the block before
        free = base[open_to] + after[open_to] - discount * before
        begins = np.searchsorted(mine, mine)
        now = np.zeros(len(open_to), bool)
        while True:
            more = np.concatenate([[0], np.cumsum(now)])
            again = u * (free - discount * (more[:-1] - more[begins])) < odds
            if (again == now).all():
                break
            now = again
        tables += np.bincount(mine, now, len(size)).astype(np.int64)
    return tables


def discount_of(customers: np.ndarray) -> float:
    ones, twos = int((customers == 1).sum()), int((customers == 2).sum())
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def spell(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, word numbers): every symbol of every word (its bytes and the end) with the symbols before it."""
    lens = np.asarray(pa.compute.binary_length(words), np.int64)
    first = np.cumsum(lens + 1 + ORDER) - (lens + 1 + ORDER)
    x = np.full(int((lens + 1 + ORDER).sum()), START, np.int64)
    data = np.frombuffer(b"".join(words.to_pylist()), np.uint8)
    inside = np.arange(len(data)) - np.repeat(np.cumsum(lens) - lens, lens)
    x[np.repeat(first + ORDER, lens) + inside] = data
    x[first + ORDER + lens] = END
    own = np.repeat(np.arange(len(lens)), lens + 1)
    at = np.repeat(first + ORDER, lens + 1) + np.arange(len(own)) - np.repeat(np.cumsum(lens + 1) - lens - 1, lens + 1)
    code = np.zeros(len(at), np.int64)
    for back in range(ORDER, 0, -1):
        code = (code << BITS) | x[at - back]
    return (code << BITS) | x[at], own


def level(code: np.ndarray, n: int) -> np.ndarray:
    """The code with ``n`` symbols of context left."""
    return code & ((1 << BITS * (n + 1)) - 1)


def gibbs(codes: np.ndarray, customers: np.ndarray, root: np.ndarray, rounds: int, rng) -> dict:
    """Sample the restaurants of all contexts that end in one symbol; their parents are the contexts without
    the first symbol, down to ``root`` (probability of each symbol). Averages the rounds after the first."""
    keys, parent = {ORDER: codes}, {}
    for n in range(ORDER, 1, -1):
        keys[n - 1], parent[n] = np.unique(level(keys[n], n - 1), return_inverse=True)
    ctx, seats = {}, {}
    for n in range(1, ORDER + 1):
        ctx[n], seats[n] = np.unique(keys[n] >> BITS, return_inverse=True)
    cust, tables, disc = {ORDER: customers}, {}, {}
    for n in range(ORDER, 0, -1):  # to begin with, one table for each dish
        tables[n] = np.ones(len(keys[n]), np.int64)
        disc[n] = discount_of(cust[n])
        if n > 1:
            cust[n - 1] = np.bincount(parent[n], tables[n], len(keys[n - 1])).astype(np.int64)
    prob, back = {}, {}

    def predict() -> None:
        for n in range(1, ORDER + 1):
            above = root[keys[1] & SYMBOL] if n == 1 else prob[n - 1][parent[n]]
            t = np.bincount(seats[n], tables[n], len(ctx[n]))
            c = np.bincount(seats[n], cust[n], len(ctx[n]))
            back[n] = (STRENGTH + disc[n] * t) / (STRENGTH + c)
            prob[n] = (cust[n] - disc[n] * tables[n]) / (STRENGTH + c[seats[n]]) + back[n][seats[n]] * above

    predict()
    sum_p = {n: np.zeros(len(keys[n])) for n in keys}
    sum_b = {n: np.zeros(len(ctx[n])) for n in ctx}
    for r in range(rounds):
        for n in range(ORDER, 0, -1):
            above = root[keys[1] & SYMBOL] if n == 1 else prob[n - 1][parent[n]]
            t = np.bincount(seats[n], tables[n], len(ctx[n]))
            tables[n] = seat(cust[n], (STRENGTH + disc[n] * t[seats[n]]) * above, disc[n], rng)
            if n > 1:
                cust[n - 1] = np.bincount(parent[n], tables[n], len(keys[n - 1])).astype(np.int64)
        predict()
        if r or rounds == 1:
            for n in keys:
                sum_p[n] += prob[n]
                sum_b[n] += back[n]
    kept = max(rounds - 1, 1)
    return {"keys": keys, "ctx": ctx, "p": {n: sum_p[n] / kept for n in keys}, "b": {n: sum_b[n] / kept for n in ctx},
            "root": np.bincount(keys[1] & SYMBOL, tables[1], SYMBOL + 1)}


def _char_counts(words: DataFrame) -> DataFrame:
    """(code, c): how often each symbol follows each context, over the tables of the words; summed in each
    task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in small_batches(batches, "word"):
            code, own = spell(b.column("word"))
            code = np.concatenate([codes, code])
            weight = np.concatenate([counts, np.asarray(b.column("t"))[own]])
            codes, inverse = np.unique(code, return_inverse=True)
            counts = np.bincount(inverse, weight, len(codes)).astype(np.int64)
            if len(codes) > MODEL_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["code", "c"])
                codes, counts = codes[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["code", "c"])

    return words.where("t > 0").select("word", "t").mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))


def _spelling_model(counts: DataFrame, root: list[float], rounds: int, seed: int) -> DataFrame:
    """(n, kind, key, value, part): per level the probabilities of seen symbols (kind 0), the weights of the parents
    (kind 1), and tables by symbol for the root (n 0). All contexts that end in one symbol are one group:
    their parents lie in the same group. The rows are sums over all words, so a group is bounded by the
    different strings of five symbols that end alike, not by the rows that hold them."""
    def run(key, table):
        code, c = np.asarray(table.column("code")), np.asarray(table.column("c"))
        order = np.argsort(code)
        m = gibbs(code[order], c[order], np.array(root), rounds, np.random.default_rng([seed, key[0].as_py()]))
        rows = [(n, 0, m["keys"][n], m["p"][n]) for n in m["keys"]] + [(n, 1, m["ctx"][n], m["b"][n]) for n in m["ctx"]]
        rows.append((0, 2, np.arange(SYMBOL + 1), m["root"].astype(float)))
        return pa.table({"n": pa.array(np.concatenate([np.full(len(k), n, np.int32) for n, _, k, _ in rows])),
                         "kind": pa.array(np.concatenate([np.full(len(k), kind, np.int32) for _, kind, k, _ in rows])),
                         "key": pa.array(np.concatenate([k for _, _, k, _ in rows])), "value": pa.array(np.concatenate([v for *_, v in rows]).astype(float)),
                         "part": pa.array(np.concatenate([_part(k if kind == 1 else k >> BITS) for _, kind, k, _ in rows]))})

    return (counts.withColumn("last", F.shiftright("code", BITS).bitwiseAND(SYMBOL))
            .groupBy("last").applyInArrow(run, "n int, kind int, key long, value double, part long"))


def _as_arrays(rows: pa.Table) -> dict:
    n, kind, key, value = (np.asarray(rows.column(c)) for c in ("n", "kind", "key", "value"))
    out = {}
    for lv in range(1, ORDER + 1):
        for k in (0, 1):
            on = (n == lv) & (kind == k)
            order = np.argsort(key[on])
            out[lv, k] = key[on][order], np.log(value[on][order])
    return out


def _look_up(at: np.ndarray, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(at)), np.zeros(len(at), bool)
    i = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
    return values[i], keys[i] == at


def log_symbol(codes: np.ndarray, model: dict, log_root: np.ndarray) -> np.ndarray:
    """Natural log probability of each symbol: at the longest context that has it, after the weights of the
    longer contexts that do not."""
    out, open_ = np.zeros(len(codes)), np.ones(len(codes), bool)
    for n in range(ORDER, 0, -1):
        p, seen = _look_up(level(codes, n), *model[n, 0])
        b, known = _look_up(level(codes, n) >> BITS, *model[n, 1])
        hit = open_ & seen
        out[hit] += p[hit]
        miss = open_ & ~seen & known
        out[miss] += b[miss]
        open_ &= ~seen
    out[open_] += log_root[codes[open_] & SYMBOL]
    return out


def _spelled(words: DataFrame, model: DataFrame, log_root: list[float], name: str, finish: Callable) -> DataFrame:
    """``words`` with ``log_p``, log probability of the word's spelling, and what ``finish`` (batch, log_p) makes of
    both. The model goes to the tasks in slices of at most about ``MODEL_ROWS`` rows, split by the last two symbols
    of the context; a slice adds what it knows of, and the last one finishes."""
    spark = words.sparkSession
    model = model.where("kind < 2")
    slices = -(-max(model.count(), 1) // MODEL_ROWS)
    # rows of one symbol of context belong to every slice
    out, held = words.withColumn("log_p", F.lit(0.0)), None
    cols = out.columns
    for s in range(slices):
        rows = model if slices == 1 else model.where((F.col("n") == 1) | (F.col("part") % slices == s))
        arrays = spark.sparkContext.broadcast(_as_arrays(rows.toArrow()))

        def run(batches: Iterator[pa.RecordBatch], s=s, arrays=arrays) -> Iterator[pa.RecordBatch]:
            root = np.array(log_root)
            for b in small_batches(batches, "word", 1 << 20):
                code, own = spell(b.column("word"))
                if slices > 1:
                    keep = _part(code >> BITS) % slices == s
                    code, own = code[keep], own[keep]
                distinct, inverse = np.unique(code, return_inverse=True)
                lp = log_symbol(distinct, arrays.value, root)[inverse]
                log_p = np.asarray(b.column("log_p")) + np.bincount(own, lp, b.num_rows)
                new = finish(b, log_p) if s == slices - 1 else {"log_p": pa.array(log_p)}
                yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in cols], cols)

        out = out.mapInArrow(run, out.schema)
        if s < slices - 1:
            before, out = held, materialize(out, f"{name}-{s}")
            held = out
            if before is not None:
                _free(before)
    return out


def _part(context: np.ndarray) -> np.ndarray:
    """A hash of the last two symbols of a context, by which the model is sliced."""
    return (mix((context & ((1 << 2 * BITS) - 1)).astype(np.uint64)) >> np.uint64(1)).astype(np.int64)


def _chunks(src: DataFrame, modulus: int, held: int) -> DataFrame:
    """Documents by chunks of about ``CHUNK_TOKENS``: ids, held out or not, lengths, tokens as numbers in the
    chunk's own list of words (compressed), that list, and how often each word occurs in training texts."""
    def flush(chunk, ids, out_of, lens, tokens, numbers):
        n = np.concatenate(tokens)
        train = np.repeat(~np.array(out_of), lens)
        count = np.bincount(n[train], minlength=len(numbers))
        return pa.RecordBatch.from_arrays([
            pa.array([chunk], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([out_of], pa.list_(pa.bool_())),
            pa.array([lens], pa.list_(pa.int32())), pa.array([zstandard.ZstdCompressor(level=1).compress(n.tobytes())], pa.binary()),
            pa.array([list(numbers)], pa.list_(pa.binary())), pa.array([count.tolist()], pa.list_(pa.int64()))],
            ["chunk", "ids", "held", "lens", "tokens", "words", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = total = 0
        ids, out_of, lens, tokens, numbers = [], [], [], [], _Numbers()
        part = 0
        for b in small_batches(batches):
            part = b.column("_part")[0].as_py()
            for doc, t in zip(b.column("_id").to_pylist(), b.column("_text").to_pylist()):
                ws = t.encode().lower().split() if t else []
                ws.append(END_TOKEN)
                ids.append(doc)
                out_of.append(doc is not None and zlib.crc32(str(doc).encode()) % modulus == held)
                lens.append(len(ws))
                tokens.append(np.fromiter(map(numbers.__getitem__, ws), np.uint32, len(ws)))
                total += len(ws)
                if total >= CHUNK_TOKENS:
                    yield flush((part << 24) + k, ids, out_of, lens, tokens, numbers)
                    k, total = k + 1, 0
                    ids, out_of, lens, tokens, numbers = [], [], [], [], _Numbers()
        if ids:
            yield flush((part << 24) + k, ids, out_of, lens, tokens, numbers)

    return (src.select("_id", "_text", F.spark_partition_id().alias("_part"))
            .mapInArrow(run, "chunk long, ids array<long>, held array<boolean>, lens array<int>, tokens binary, words array<binary>, counts array<long>"))


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words)).view(np.int64)


def _tokens(row, at: int = 0) -> np.ndarray:
    """Every token of a chunk as a number: its word in the low half, the word before it in the high half. Before the
    first token of a text stands the end of another."""
    tok = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.column("tokens")[at].as_py()), np.uint32).astype(np.uint64)
    return (np.concatenate([tok[-1:], tok[:-1]]) << np.uint64(32)) | tok


def _pack(x: np.ndarray) -> bytes:
    """Compressed, first bytes of all numbers first."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _unpack(blob: pa.Scalar, kind=np.uint32) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _deal(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, positions of its members) for every bucket that has some."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[on[0]]), on) for on in np.split(order, cut) if len(on)]


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in fields.split(", ")))
    types = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[k]) for i, k in enumerate(kinds)], list(names))


def _training(row, at: int = 0) -> np.ndarray:
    """Whether each token of a chunk is of a training text."""
    held = np.asarray(row.column("held")[at].values.to_numpy(zero_copy_only=False), bool)
    return np.repeat(~held, np.asarray(row.column("lens")[at].values))


def _rising(codes: np.ndarray) -> bytes:
    """Rising numbers, packed by their differences."""
    return _pack(np.diff(codes, prepend=np.uint64(0)))


def _risen(blob: pa.Scalar) -> np.ndarray:
    return np.cumsum(_unpack(blob, np.uint64), dtype=np.uint64)


MESSAGE = "bucket long, chunk long, code binary, key binary, value binary"
COUNTED = "bucket long, chunk long, code binary, key binary, total binary, owned binary"
TABLES = "chunk long, h binary, u binary, w binary, c binary, t binary, ts binary, twos long"


def _counted(chunks: DataFrame, buckets: int, turn: int) -> DataFrame:
    """What there is to tell each chunk of its pairs of words, a row for each bucket of pairs: the pairs (their words' numbers in the
    chunk), numbers within the bucket, how often all training texts have them, and whether this chunk owns the pair (the first chunk that
    has it does). Told are pairs that training texts have twice or more, and those that they have once, elsewhere. Others are known in the chunk.
    A chunk sends packed keys and counts to each bucket of its pairs, so Spark shuffles as many rows as chunks have
    buckets (at most one for each pair), and a bucket holds about ``BUCKET_PAIRS``: a pair has one entry for each chunk.
    Each of ``PASSES`` turns counts its share of the buckets, so that the keys of only one turn lie on disk."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                h = _hashes(b.column("words")[r].values).view(np.uint64)
                x = (_tokens(b, r) << np.uint64(1)) | _training(b, r).astype(np.uint64)  # a word's number is below 2**31
                x.sort()
                first = np.flatnonzero(np.concatenate([[True], (x[1:] ^ x[:-1]) > 1]))
                codes, count = x[first] >> np.uint64(1), np.add.reduceat(x & np.uint64(1), first).astype(np.uint32)
                del x, first
                key = pair_key(h[(codes >> np.uint64(32)).astype(np.int64)], h[(codes & np.uint64(0xFFFFFFFF)).astype(np.int64)])
                chunk = b.column("chunk")[r].as_py()
                bucket = (key % np.uint64(buckets)).astype(np.int64)
                mine = np.flatnonzero(bucket % PASSES == turn)
                rows = [(to, chunk, _rising(codes[on]), _pack(key[on] // np.uint64(buckets)), _pack(count[on]))
                        for to, on in ((to, mine[on]) for to, on in _deal(bucket[mine]))]
                for s in range(0, len(rows), 256):
                    yield _batch(rows[s:s + 256], MESSAGE)

    def add(group, table):
        bucket, table = group[0].as_py(), table.sort_by("chunk")
        keys = [_unpack(k, np.uint64) for k in table.column("key")]  # without the bucket, which they share
        count = np.concatenate([_unpack(v) for v in table.column("value")]).astype(np.int64)
        distinct, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.bincount(inverse, count, len(distinct)).astype(np.int64)[inverse]
        owned = np.zeros(len(count), bool)
        owned[first] = True
        due = (total >= 2) | ((total == 1) & (count == 0))
        used = np.zeros(len(distinct), bool)
        used[inverse[due]] = True
        number = (np.cumsum(used) - 1).astype(np.uint32)[inverse]
        rows, start = [], 0
        for m, key in enumerate(keys):
            on = np.flatnonzero(due[start:start + len(key)])
            if len(on):
                rows.append((bucket, table.column("chunk")[m].as_py(), _rising(_risen(table.column("code")[m])[on]), _pack(number[start + on]),
                             _pack(total[start + on].astype(np.uint32)), _pack((owned & (total >= 2))[start + on].astype(np.uint8))))
            start += len(key)
        return pa.Table.from_batches([_batch(rows, COUNTED)])

    return (chunks.select("chunk", "held", "lens", "tokens", "words").mapInArrow(send, MESSAGE).groupBy("bucket").applyInArrow(add, COUNTED))


def pair_key(hu: np.ndarray, hw: np.ndarray) -> np.ndarray:
    return mix(mix(hu) + hw)


def _owned(counted: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row for each chunk: the pairs it owns, as numbers in a list of their words' hashes, in rising order, with
    customers, tables and the sum of tables over sweeps. Only these pairs and the chunks' word hashes are shuffled."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in range(b.num_rows):
                own = _unpack(b.column("owned")[r], np.uint8).astype(bool)
                if own.any():
                    rows.append((b.column("chunk")[r].as_py(), _rising(_risen(b.column("code")[r])[own]), _pack(_unpack(b.column("total")[r])[own])))
            yield _batch(rows, "chunk long, code binary, total binary")

    def run(group, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([_batch([], TABLES)])
        h = np.frombuffer(right.column("h")[0].as_py(), np.int64)
        codes = np.concatenate([_risen(x) for x in left.column("code")])
        order = np.argsort(codes)
        c = np.concatenate([_unpack(x) for x in left.column("total")])[order]
        u, w = (codes[order] >> np.uint64(32)).astype(np.int64), (codes[order] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        used = np.zeros(len(h), bool)
        used[u] = used[w] = True
        number = (np.cumsum(used) - 1).astype(np.uint32)
        return pa.Table.from_batches([_batch([(
            group[0].as_py(), h[used].tobytes(), _pack(number[u]), _pack(number[w]), _pack(c),
            _pack(np.ones(len(c), np.uint32)), _pack(np.zeros(len(c), np.uint32)), int((c == 2).sum()))], TABLES)])

    return (counted.select("chunk", "code", "total", "owned").mapInArrow(pick, "chunk long, code binary, total binary").groupBy("chunk")
            .cogroup(_named(chunks).groupBy("chunk")).applyInArrow(run, TABLES))


def _sums(tables: DataFrame) -> DataFrame:
    """(h, cw, cu, tw, tu): customers and tables of the owned pairs by their second and by their first word, added
    up in each chunk before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                h = np.frombuffer(b.column("h")[r].as_py(), np.int64)
                u, w, c, t = (_unpack(b.column(x)[r]) for x in ("u", "w", "c", "t"))
                sums = [np.bincount(i, x, len(h)).astype(np.int64) for x in (c, t) for i in (w, u)]
                for s in range(0, len(h), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[s:s + 50_000]) for x in (h, *sums)], ["h", "cw", "cu", "tw", "tu"])

    return (tables.select("h", "u", "w", "c", "t").mapInArrow(run, "h long, cw long, cu long, tw long, tu long")
            .groupBy("h").agg(*[F.sum(c).alias(c) for c in ("cw", "cu", "tw", "tu")]))


def _packed(rows: DataFrame, whole: list[str], real: list[str]) -> DataFrame:
    """(chunk, i, whole, real) of rows (chunk, i, some longs, some doubles): the rows that a task has for one chunk as
    packed arrays, so that few rows are shuffled and sorted for it. Counts stay whole numbers: they pack to a byte or
    two where doubles made of them fill eight."""
    def flush(held):
        x = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        order = np.lexsort((x["i"], x["chunk"]))
        cut = np.flatnonzero(np.diff(x["chunk"][order])) + 1
        out = [(int(x["chunk"][on[0]]), _pack(np.diff(x["i"][on], prepend=0).astype(np.uint32)), _pack(np.concatenate([x[c][on] for c in whole])),
                _pack(np.concatenate([x[c][on] for c in real]))) for on in np.split(order, cut)]
        return _batch(out, "chunk long, i binary, whole binary, real binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append({c: np.asarray(b.column(c)) for c in ("chunk", "i", *whole, *real)})
                n += b.num_rows
            if n >= 500_000:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return rows.select("chunk", "i", *whole, *real).mapInArrow(run, "chunk long, i binary, whole binary, real binary")


def _unpacked(table: pa.Table, n: int, whole: int, real: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(``whole`` rows of ``n`` longs by place, ``real`` rows of doubles, whether a place has values)."""
    longs, doubles, known = np.zeros((whole, n), np.int64), np.zeros((real, n)), np.zeros(n, bool)
    for i, x, y in zip(table.column("i"), table.column("whole"), table.column("real")):
        at = np.cumsum(_unpack(i).astype(np.int64))
        longs[:, at] = _unpack(x, np.int64).reshape(whole, -1)
        doubles[:, at] = _unpack(y, np.float64).reshape(real, -1)
        known[at] = True
    return longs, doubles, known


def _named(chunks: DataFrame) -> DataFrame:
    """(chunk, h): the hashes of each chunk's words, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                yield _batch([(b.column("chunk")[r].as_py(), _hashes(b.column("words")[r].values).tobytes())], "chunk long, h binary")

    return chunks.select("chunk", "words").mapInArrow(run, "chunk long, h binary")


def _asked(lists: DataFrame) -> DataFrame:
    """(h, chunk, i): every entry of the chunks' lists of hashes with its place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                h = np.frombuffer(b.column("h")[r].as_py(), np.int64)
                for s in range(0, len(h), 50_000):
                    m = len(h[s:s + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array(h[s:s + 50_000]), pa.array(np.full(m, b.column("chunk")[r].as_py())),
                                                      pa.array(np.arange(s, s + m, dtype=np.int32))], ["h", "chunk", "i"])

    return lists.select("chunk", "h").mapInArrow(run, "h long, chunk long, i int")


def _seat_pairs(tables: DataFrame, words: DataFrame, p: str, d: float, seed: tuple[int, int]) -> DataFrame:
    """(chunk, t, ts) with the owned pairs seated again: a customer opens a table with the odds of its context's restaurant
    times the word's probability; ``ts`` adds up the tables of all sweeps. Each chunk asks for its words once."""
    def run(group, left, right):
        row = right.slice(0, 1).combine_chunks()
        h = np.frombuffer(row.column("h")[0].as_py(), np.int64)
        (tu,), (above,), _ = _unpacked(left, len(h), 1, 1)
        u, w, c, ts = (_unpack(row.column(x)[0]) for x in ("u", "w", "c", "ts"))
        words = h.view(np.uint64)
        t = seat(c.astype(np.int64), (STRENGTH + d * tu[u]) * above[w], d, Draws(pair_key(words[u], words[w]), *seed)).astype(np.uint32)
        return pa.table({"chunk": row.column("chunk"), "t": pa.array([_pack(t)], pa.binary()), "ts": pa.array([_pack(ts + t)], pa.binary())})

    answers = _asked(tables).join(words.where("c > 1").select("h", "tu", p), "h")
    return (_packed(answers, ["tu"], [p]).groupBy("chunk").cogroup(tables.select("chunk", "h", "u", "w", "c", "ts").groupBy("chunk"))
            .applyInArrow(run, "chunk long, t binary, ts binary"))


def _with_sums(words: DataFrame, tables: DataFrame) -> DataFrame:
    """``words`` with the sums over owned pairs; words seen once are in none, and are not shuffled for them."""
    names = ("cw", "cu", "tw", "tu")
    zero = F.lit(0).cast("long")
    often = words.where("c > 1").join(_sums(tables), "h", "left").select(*words.columns, *[F.coalesce(c, zero).alias(c) for c in names])
    return often.unionByName(words.where("c <= 1").select(*words.columns, *[zero.alias(c) for c in names]))


def _told(counted: DataFrame, tables: DataFrame, buckets: int, sweeps: int) -> DataFrame:
    """(chunk, i, whole): the customers and the sums of tables of every pair that a chunk is to be told of. Owners send the
    sums to the pair's bucket, where all its chunks are known. A pair that training texts have once has one table."""
    fields = "chunk long, i binary, whole binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                h = np.frombuffer(b.column("h")[r].as_py(), np.uint64)
                u, w, ts = (_unpack(b.column(x)[r]) for x in ("u", "w", "ts"))
                rows = [(bucket, b.column("chunk")[r].as_py(), _pack(ts[on])) for bucket, on in _deal((pair_key(h[u], h[w]) % np.uint64(buckets)).astype(np.int64))]
                for s in range(0, len(rows), 256):
                    yield _batch(rows[s:s + 256], "bucket long, chunk long, ts binary")

    def fill(group, left, right):
        if not left.num_rows:
            return pa.Table.from_batches([_batch([], fields)])
        sums = dict(zip(right.column("chunk").to_pylist(), right.column("ts")))
        keys = [_unpack(k) for k in left.column("key")]
        sat = np.full(max(int(k.max()) for k in keys) + 1, sweeps, np.uint32)
        for chunk, key, owned in zip(left.column("chunk").to_pylist(), keys, left.column("owned")):
            if chunk in sums:  # the pairs it owns, in the order of the pairs
                sat[key[_unpack(owned, np.uint8).astype(bool)]] = _unpack(sums[chunk])
        return pa.table({"chunk": left.column("chunk"), "i": left.column("code"),
                         "whole": pa.array([_pack(np.concatenate([_unpack(c), sat[k]])) for c, k in zip(left.column("total"), keys)], pa.binary())})

    return (counted.select("bucket", "chunk", "code", "key", "total", "owned").groupBy("bucket")
            .cogroup(tables.select("chunk", "h", "u", "w", "ts").mapInArrow(send, "bucket long, chunk long, ts binary").groupBy("bucket")).applyInArrow(fill, fields))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2,
          sweeps: int = 3, rounds: int = 3, seed: int = 5, order: int = 1) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    A-Z are lower-cased; tokens are maximal runs of characters other than space and \\x09-\\x0D, then one end.
    Texts with crc32(id as text) mod ``modulus`` = ``held`` are held out, all others train. ``base_score`` is
    the sum of log10((c+1)/(N+V+1)); ``score`` is the log10 probability of the text by the model.

    The model is a hierarchy of Pitman-Yor processes. With ``order`` 2 (as registered) each word has a restaurant of the
    words that follow it, the end of a text one of the words that begin a text; their parent is the restaurant of
    words, whose customers are their tables. With ``order`` 1 the restaurant of words is the lowest, and the order of
    a text's words is without meaning. The parent of that restaurant spells the words, symbol
    by symbol, from restaurants of contexts of up to four characters within the word; contexts share the
    restaurant of the context without its first character as parent, down to one without context. The events
    are those of the base, the words known from training and one for every other word: its probability is
    what the restaurants above leave to their parent times what the last leaves to unknown spellings, so that all
    add up to one after each word. After a word unknown from training stands the restaurant of words itself.
    Seating is sampled by Gibbs: dishes are seated again given
    all other seats; each table of a pair is a customer of the words, each table of a word one of the spelling, each
    table of a context one of its parent. ``sweeps`` alternate spelling (``rounds`` each), words and pairs; predictive
    probabilities are averaged over sweeps. Discounts come from the counts of ones and twos at each level.

    Scale: tokens are counted in the task, words by hash with map-side sums; documents wait in chunks that hold
    each word once, so only words and pairs, not tokens, are shuffled and joined; chunks are written compressed. Pairs are
    counted in the chunk and shuffled as packed arrays, a row for each chunk and bucket of pairs (see ``_counted``). A pair
    seen once has one table whatever happens, so that only pairs seen twice are written, seated and answered; each
    is seated by the first chunk that has it. Random numbers come from each word's or pair's own hash.
    Tables are deleted once the next ones are written. Pairs are counted and chunks are scored in ``PASSES`` parts, so that
    the shuffles of only one part lie on disk; the result reads the written scores.
    The spelling model goes to tasks in slices of bounded size (see ``_spelled``). Words of over 2**20 bytes
    are possible but spelled in one task.

    A null or empty text is its end alone. A null id is never held out. Repeated rows are scored each and
    learnt each. Other columns are ignored; an empty table gives an empty table."""
    spark = docs.sparkSession
    chunks = materialize(_chunks(id_text(docs, id_col, text_col), modulus, held), "lm-chunks")
    out_cols = (f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    if chunks.isEmpty():
        return spark.createDataFrame([], out_cols)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ws = b.column("words")[i].values
                h = _hashes(ws)
                for s in range(0, len(ws), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(h[s:s + 50_000]), ws[s:s + 50_000], b.column("counts")[i].values[s:s + 50_000]], ["h", "word", "c"])

    entries = chunks.select("words", "counts").mapInArrow(hashed, "h long, word binary, c long")
    words = (entries.where("c > 0").groupBy("h", "word").agg(F.sum("c").alias("c"))
             .withColumn("t", F.lit(1).cast("long")))
    d_pair = 0.0
    if order > 1:
        tokens = chunks.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0]
        buckets = -(-tokens // BUCKET_PAIRS)
        parts = []
        for turn in range(min(PASSES, buckets)):
            parts.append(materialize(_counted(chunks, buckets, turn), f"lm-counted-{turn}"))
            _drop_shuffles(spark)
        counted = functools.reduce(DataFrame.unionByName, parts)
        owned = materialize(_owned(counted, chunks), "lm-pairs")
        _drop_shuffles(spark)
        pairs, state = owned, None
        # every word is followed by one word, so it is as often a context as a word; once: pairs seen once
        first = materialize(words, "lm-words")
        words = (_with_sums(first, pairs).withColumns({"once_w": F.col("c") - F.col("cw"), "once_u": F.col("c") - F.col("cu")})
                 .withColumns({"k": F.col("once_w") + F.col("tw"), "tu": F.col("once_u") + F.col("tu")}).drop("cw", "cu", "tw"))
    else:
        words = words.withColumn("k", F.col("c"))
    words = materialize(words, "lm-words-0")
    if order > 1:
        _free(first)
    n, v, ones, twos = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("k") == 1), F.count_if(F.col("k") == 2)).first()
    discount = lambda ones, twos: min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
    d = discount(ones, twos)
    if order > 1:
        d_pair = discount(words.agg(F.sum("once_w")).first()[0] or 0, pairs.agg(F.sum("twos")).first()[0] or 0)
    root, p_unknown = [1 / (SYMBOL + 1)] * (SYMBOL + 1), []
    for sweep in range(sweeps):
        tables, customers = words.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
        model = materialize(_spelling_model(_char_counts(words), root, rounds, seed + sweep), f"lm-spelling-{sweep}")
        seen = np.zeros(SYMBOL + 1)
        for r in model.where("kind = 2").groupBy("key").agg(F.sum("value").alias("x")).collect():  # one row a symbol
            seen[r["key"]] = r["x"]
        log_root = np.log(root).tolist()
        root = ((seen + 1 / (SYMBOL + 1)) / (seen.sum() + 1)).tolist()

        def reseat(b: pa.RecordBatch, log_p: np.ndarray, tables=tables, sweep=sweep) -> dict:
            k, h, spelt = np.asarray(b.column("k")), np.asarray(b.column("h")), np.exp(log_p)
            return {"t": pa.array(seat(k, (STRENGTH + d * tables) * spelt, d, Draws(h, seed, sweep))), "log_p": pa.array(spelt)}

        spelled = _spelled(words, model, log_root, f"lm-spelled-{sweep}", reseat)
        reseated = materialize(spelled.withColumnRenamed("log_p", "spelt"), f"lm-words-{sweep + 1}")
        for done in (words, model, spelled):  # `spelled` reads the words before, or the last slice's table
            _free(done)
        words = reseated
        tables, spelt = words.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("spelt"), F.lit(0.0))).first()
        to_parent = (STRENGTH + d * tables) / (STRENGTH + customers)
        p_unknown.append(to_parent * max(1 - spelt, 1e-12))
        p = (F.col("k") - d * F.col("t")) / (STRENGTH + customers) + to_parent * F.col("spelt")
        words = words.withColumn(f"p{sweep}", p).drop("spelt")
        if order > 1:
            before, state = state, materialize(_seat_pairs(pairs, words, f"p{sweep}", d_pair, (seed, sweep)), f"lm-tables-{sweep}")
            if before is not None:
                _free(before)
            pairs = owned.drop("t", "ts").join(state, "chunk")
            words = (_with_sums(words.drop("tu"), pairs).withColumns({"k": F.col("once_w") + F.col("tw"), "tu": F.col("once_u") + F.col("tu")}).drop("cw", "cu", "tw")
                     .withColumn(f"tu{sweep}", F.col("tu")))
            words = materialize(words, f"lm-customers-{sweep}")
            _free(reseated)

    whole = ["c", *(f"tu{s}" for s in range(sweeps) if order > 1)]
    real = [f"p{s}" for s in range(sweeps)]
    pairs_told = None
    if order > 1:
        pairs_told = materialize(_told(counted, pairs, buckets, sweeps), "lm-pair-answers")
        for done in (counted, owned, state):
            _free(done)
    base_denominator = float(n + v + 1)

    def judge(key, left, right):
        row = right.slice(0, 1).combine_chunks()
        lens = np.asarray(row.column("lens")[0].values)
        of_pair = pa.compute.is_null(left.column("real"))
        pairs = _tokens(row)
        tok = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        got, p, known = _unpacked(left.filter(pa.compute.invert(of_pair)), int(tok.max()) + 1, len(whole), sweeps)
        count, p = got[0], np.where(known, p, np.array(p_unknown)[:, None])
        if order > 1:
            back = np.where(known, (STRENGTH + d_pair * got[1:]) / (STRENGTH + count), 1.0)
            codes, inverse = np.unique(pairs, return_inverse=True)
            seats = np.where(np.bincount(inverse[_training(row)], minlength=len(codes)) > 0, 1 - d_pair, 0.0)
            for r in left.filter(of_pair).select(["i", "whole"]).to_batches():
                for code, value in zip(r.column("i"), r.column("whole")):
                    total, sat = np.split(_unpack(value).astype(np.int64), 2)
                    seats[np.searchsorted(codes, _risen(code))] = total - d_pair / sweeps * sat
            u, w = (codes >> np.uint64(32)).astype(np.int64), (codes & np.uint64(0xFFFFFFFF)).astype(np.int64)
            prob = seats / (STRENGTH + count[u])
            for s in range(sweeps):
                prob += back[s][u] * p[s][w] / sweeps
            lp = np.log10(prob)[inverse]
        else:
            lp = np.log10(p.mean(0))[tok]
        starts = np.cumsum(lens) - lens
        m = len(lens)
        return pa.table({id_col: row.column("ids")[0].values, "held_out": row.column("held")[0].values, "n_tokens": pa.array(lens.astype(np.int64)),
                         "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64)[tok], starts)), "train_tokens": pa.array(np.full(m, n, np.int64)),
                         "base_score": pa.array(np.add.reduceat(np.log10((count + 1) / base_denominator)[tok], starts)), "score": pa.array(np.add.reduceat(lp, starts))})

    scores = []
    for turn in range(PASSES):
        mine = (F.shiftright("chunk", 24) + F.col("chunk").bitwiseAND((1 << 24) - 1)) % PASSES == turn
        answers = _packed(_asked(_named(chunks.where(mine))).join(words.select("h", *whole, *real), "h"), whole, real)
        if order > 1:
            answers = answers.unionByName(pairs_told.where(mine), allowMissingColumns=True)
        scores.append(materialize(answers.groupBy("chunk").cogroup(chunks.where(mine).select("chunk", "ids", "held", "lens", "tokens").groupBy("chunk"))
                                  .applyInArrow(judge, out_cols), f"lm-scores-{turn}"))
        _drop_shuffles(spark)
    for done in (words, chunks, *([pairs_told] if order > 1 else [])):
        _free(done)
    return functools.reduce(DataFrame.unionByName, scores)
