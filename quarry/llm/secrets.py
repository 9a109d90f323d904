"""Secrets in texts: fixed patterns, and a battery of randomness tests with false-discovery control."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_text, materialize, small_batches

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Encodings in the order in which they are tried: the first whose alphabet has all characters.
ENCODINGS = [("decimal", DIGITS), ("hex", DIGITS + "abcdef"), ("HEX", DIGITS + "ABCDEF"), ("lower", LOWER), ("upper", UPPER),
             ("base32", UPPER + "234567"), ("base36", DIGITS + LOWER), ("BASE36", DIGITS + UPPER), ("letters", UPPER + LOWER),
             ("base62", DIGITS + UPPER + LOWER), ("base64", UPPER + LOWER + DIGITS + "+/"), ("base64url", UPPER + LOWER + DIGITS + "-_"),
             ("any", UPPER + LOWER + DIGITS + "+/-_=")]
_SETS = [(name, frozenset(a), {c: i for i, c in enumerate(a)}) for name, a in ENCODINGS]
RANDOM_LEVEL = 0.001      # a candidate stays random unless the battery rejects that at this level
TEXT_CHANGES = 0.1        # how often neighbouring characters of ordinary runs change their class
# Percent of each letter in ordinary text (mean over a few European languages), and of each digit in numbers.
LETTERS = dict(a=8.9, b=1.6, c=3.2, d=4.4, e=14.7, f=1.4, g=1.9, h=3.2, i=7.3, j=0.4, k=0.7, l=4.5, m=2.7, n=7.6, o=5.8, p=2.3, q=0.7,
               r=6.6, s=7.1, t=7.0, u=4.6, v=1.4, w=1.1, x=0.3, y=0.9, z=0.6)
NUMBERS = {"0": 22, "1": 18, "2": 13, "3": 9, "4": 7, "5": 8, "6": 6, "7": 5, "8": 6, "9": 6}
NEAR_DIGIT = 0.5          # how often a digit of an ordinary number repeats its neighbour or counts up or down from it
LENGTHS = (32, 64)        # strata of length: under 32, under 64, longer
TOP = 3000                # evidence is kept in hundredths of a decade, up to 30 decades


def _normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi2_tail(x: float, k: int) -> float:
    """Upper tail by the cube-root normal approximation."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def infer_encoding(token: str) -> tuple[str, np.ndarray, int]:
    """(name, positions in the alphabet, size of the alphabet); padding at the end is no part of it."""
    body = token.rstrip("=") or token
    used = set(body)
    for name, have, at in _SETS:
        if used <= have:
            return name, np.array([at[c] for c in body]), len(at)
    raise ValueError(token)


def battery(token: str) -> float:
    """p-value of the token as uniformly random characters of its inferred encoding: chi-squared uniformity
    of the alphabet (folded so that five are expected in a bin), runs above and below the alphabet's middle,
    and serial correlation of neighbours, combined by Fisher's method."""
    _, x, size = infer_encoding(token)
    n = len(x)
    bins = max(2, min(size, n // 5))
    fold = np.arange(size) * bins // size
    expect = np.bincount(fold, minlength=bins) * n / size
    p1 = _chi2_tail(float((((np.bincount(fold[x], minlength=bins) - expect) ** 2) / expect).sum()), bins - 1)
    high = x >= size / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        mean = 2 * a * b / n + 1
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        p2 = _normal_two_sided((int((high[1:] != high[:-1]).sum()) + 1 - mean) / math.sqrt(var))
    else:
        p2 = 2 * 0.5 ** n
    d = x - x.mean()
    p3 = _normal_two_sided(float((d[1:] * d[:-1]).sum() / (d * d).sum()) * math.sqrt(n)) if d.any() else 0.0
    half = -sum(math.log(max(p, 1e-300)) for p in (p1, p2, p3))
    return math.exp(-half) * (1 + half + half * half / 2)


def _ordinary() -> tuple[list[dict], list[dict]]:
    """(log chance of a character after one of another class or at the start, of a digit after a digit)."""
    letters, numbers = sum(LETTERS.values()), sum(NUMBERS.values())
    own = {c: math.log(v / letters) for c, v in LETTERS.items()}
    out = {**own, **{c.upper(): v for c, v in own.items()}, **{c: math.log(v / numbers) for c, v in NUMBERS.items()},
           **{c: math.log(1 / 5) for c in "+/_=-"}}
    after = {}
    for a in NUMBERS:
        near = {str(d) for d in (int(a) - 1, int(a), int(a) + 1) if 0 <= d <= 9}
        for b, v in NUMBERS.items():
            after[a + b] = math.log((1 - NEAR_DIGIT) * v / numbers + (NEAR_DIGIT / len(near) if b in near else 0))
    return out, after


_CHAR, _DIGITS = _ordinary()
_STAY, _CHANGE = math.log(1 - TEXT_CHANGES), math.log(TEXT_CHANGES / 3)


def evidence(token: str) -> int:
    """Evidence against an ordinary run, in hundredths of a decade, rounded down and at least 0.

    An ordinary run keeps its character class (lower case, upper case, digits, signs) nine times of ten, and has the
    letters of ordinary text; its digits often repeat or count. The run is held against uniform characters of its
    inferred encoding: an ordinary run reaches a likelihood ratio of x with a chance of at most 1 / x, whatever its
    length, which is a p-value that false-discovery control may rank. The battery's own p-value multiplies the
    ratio: what fits randomness badly counts less, and what the battery rejects at ``RANDOM_LEVEL`` not at all."""
    p = battery(token)
    if p < RANDOM_LEVEL:
        return 0
    _, x, size = infer_encoding(token)
    body = token[:len(x)]
    cls = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in body]
    log = math.log(1 / 4) + _CHAR[body[0]]
    for i in range(1, len(body)):
        if cls[i] != cls[i - 1]:
            log += _CHANGE + _CHAR[body[i]]
        else:
            log += _STAY + (_DIGITS[body[i - 1] + body[i]] if cls[i] == 2 else _CHAR[body[i]])
    # letters of one case say nothing about which encoding was meant: every encoding is charged as one of all
    ratio = -len(body) * math.log(size) - math.log(len(ENCODINGS)) - log + math.log(p)
    return min(TOP, max(0, int(100 * ratio / math.log(10))))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order of start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, stratum, evidence) of every long run that touches no base span; runs without evidence count
    among the tested."""
    out = []
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        if any(a < e and s < b for a, _, b in taken):
            continue
        stratum = sum(e - s >= x for x in LENGTHS)
        out.append((s, e, stratum, evidence(m[0])))
    return out


def _scan(src: DataFrame) -> DataFrame:
    span = "array<struct<start:int,kind:int,stop:int>>"
    cand = "array<struct<start:int,stop:int,stratum:int,evidence:int>>"
    s_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
    c_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("stratum", pa.int32()), ("evidence", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            spans, cands, sha = [], [], []
            for t in b.column("_text").to_pylist():
                own = base_spans(t or "")
                spans.append([dict(zip(("start", "kind", "stop"), x)) for x in own])
                cands.append([dict(zip(("start", "stop", "stratum", "evidence"), x)) for x in candidates(t or "", own)])
                sha.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in own).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_key"), pa.array(spans, s_type), pa.array(cands, c_type), pa.array(sha, pa.string())],
                                             ["_id", "_key", "base", "cand", "base_sha256"])

    src = src.withColumn("_key", F.xxhash64("_text"))
    return src.mapInArrow(run, f"_id long, _key long, base {span}, cand {cand}, base_sha256 string")


def thresholds(tested: DataFrame, q: float) -> list[int]:
    """Least evidence that counts, per stratum of length: Benjamini-Hochberg at level ``q`` among all runs
    tested in the stratum. Works on counts by hundredth of a decade (at most 3 * 3001 rows)."""
    rows = tested.groupBy("stratum", "evidence").count().collect()
    out = []
    for stratum in range(len(LENGTHS) + 1):
        own = sorted(((r["evidence"], r["count"]) for r in rows if r["stratum"] == stratum), reverse=True)
        total, seen, least = sum(c for _, c in own), 0, TOP + 1
        for evidence, c in own:
            seen += c
            if evidence > 0 and 10 ** (-evidence / 100) <= q * seen / total:
                least = evidence
        out.append(least)
    return out


def find_secrets(docs: DataFrame, q: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_random, base_sha256, spans, found, text_hash) for every row of ``docs``.

    Fixed patterns give the base spans. Every other run of 20 or more characters of ``[A-Za-z0-9+/_=-]`` that
    touches none is tested by the battery in its inferred encoding (``battery``) and against ordinary runs
    (``evidence``), whose combined p-value must pass the Benjamini-Hochberg threshold of its stratum of
    length, over all runs of all documents, at level ``q``. ``spans``: kind:start:end by start, then kind, joined
    by commas (code points, end exclusive); ``found``: the same as an array of structs; ``text_hash``: xxhash64
    of the text, to join spans back to texts.

    Two scans' worth of state only: spans per document are written once, the threshold comes from counts of
    bounded size. No shuffle of texts.

    A null or empty text has no spans. A null id stays null; repeated rows get a row each; other columns are
    ignored; an empty table gives an empty table."""
    scanned = materialize(_scan(id_text(docs, id_col, text_col)), "secret-spans")
    least = thresholds(scanned.select(F.explode("cand").alias("c")).select("c.stratum", "c.evidence"), q)
    limit = F.array(*[F.lit(x) for x in least])
    added = F.transform(F.filter("cand", lambda c: (c["evidence"] > 0) & (c["evidence"] >= F.get(limit, c["stratum"]))),
                        lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["stop"].alias("stop")))
    names = F.array(*[F.lit(k) for k in KINDS])
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return (scanned.select("_id", "_key", "base_sha256", F.sort_array(F.concat("base", added)).alias("found"))
            .select(F.col("_id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_random"),
                    "base_sha256", F.array_join(F.transform("found", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",").alias("spans"),
                    "found", F.col("_key").alias("text_hash")))


def redact(text: F.Column, found: F.Column, mark: str = "[SECRET]") -> F.Column:
    """``text`` with every span (sorted by start; overlaps count once) replaced by ``mark``."""
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(
            acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(found, none, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))
