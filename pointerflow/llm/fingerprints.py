"""Document fingerprints from prefix polynomial hashes (op3)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of
from .ordered import Ranges

#: The modulus 2**31 - 1 and two bases below it.
MODULUS = np.uint64((1 << 31) - 1)
BASES = (1_000_003, 1_540_483_477)
_BITS = np.uint64(31)
SPAN = 24  # code points in a sampled span
KEEP = 64  # sampled spans in a fingerprint


def _mod(x: np.ndarray) -> np.ndarray:
    """x mod 2**31 - 1 for x below 2**62."""
    x = (x & MODULUS) + (x >> _BITS)
    x = (x & MODULUS) + (x >> _BITS)
    return np.where(x == MODULUS, np.uint64(0), x)


class _Powers:
    """base**i and base**-i, grown by doubling as longer texts come."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, int(MODULUS))
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, _mod(self.up * np.uint64(pow(self.base, k, int(MODULUS))))])
            self.down = np.concatenate([self.down, _mod(self.down * np.uint64(pow(self.inverse, k, int(MODULUS))))])
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(b) for b in BASES]


class PrefixHash:
    """Prefix sums of ``code * base**i`` modulo a prime, for two bases.

    ``span(i, j)`` then costs two lookups and compares across texts.
    """

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.sums = []
        for powers in _POWERS:
            terms = codes * powers.upto(self.n)[0]
            terms = (terms & MODULUS) + (terms >> _BITS)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), _mod(np.cumsum(terms))]))

    def span(self, i: int, j: int) -> tuple[int, int]:
        """Hash pair of the span [i, j)."""
        p = int(MODULUS)
        return tuple((int(s[j]) - int(s[i])) % p * pow(w.inverse, i, p) % p for s, w in zip(self.sums, _POWERS))

    def spans(self, width: int) -> np.ndarray:
        """Hashes, under the first base, of all spans of ``width``."""
        m = self.n - width + 1
        differences = self.sums[0][width:] + MODULUS - self.sums[0][:m]
        differences = (differences & MODULUS) + (differences >> _BITS)
        return _mod(differences * _POWERS[0].upto(m)[1])

    def common_prefix(self, other: PrefixHash, i: int = 0, j: int = 0) -> int:
        """Longest common extension from ``i`` here and ``j`` there, by bisection."""
        lo, hi = 0, min(self.n - i, other.n - j)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.span(i, i + mid) == other.span(j, j + mid):
                lo = mid
            else:
                hi = mid - 1
        return lo

    def sample(self) -> np.ndarray:
        """The KEEP least mixed hashes of distinct spans, ascending."""
        if not self.n:
            return np.zeros(0, np.uint32)
        spans = self.spans(min(SPAN, self.n))
        mixed = ((spans + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        if len(mixed) > 16 * KEEP:  # sorting the least few will do, if they hold KEEP distinct ones
            few = np.unique(mixed[mixed < (4 * KEEP << 32) // len(mixed)])
            if len(few) >= KEEP:
                return few[:KEEP].astype(np.uint32)
        return np.unique(mixed)[:KEEP].astype(np.uint32)

    def whole(self) -> str:
        return "{:08x}{:08x}".format(*self.span(0, self.n))


def fingerprint(text: str) -> str:
    """``length:hash of the whole:sampled span hashes``; equal for equal texts."""
    return _string(h := PrefixHash(text), h.sample())


def _string(h: PrefixHash, sample: np.ndarray) -> str:
    return f"{h.n}:{h.whole()}:{sample.astype('>u4').tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """Estimated share of common spans (Jaccard) from two fingerprints."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rsplit(":", 1)[1]), ">u4") for f in (a, b))
    return _alike(x, y)


def _alike(x: np.ndarray, y: np.ndarray) -> float:
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.union1d(x, y)[:KEEP]
    return float(np.isin(both, x, assume_unique=True).__and__(np.isin(both, y, assume_unique=True)).mean())


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows in range partitions of ``id_col``, each range followed by the first
    row of the next one (after the last: of the first), marked ``halo``.

    The driver sees one id and text hash for each range.  Repeated ids, and rows
    without one, are ordered by the hash of their text and divided among ranges
    if they fill more than one.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranges = Ranges.of(docs, "doc_id")
    docs = docs.withColumn("part", ranges.number("doc_id", "tie"))
    firsts = docs.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("first")).orderBy("part").collect()
    follows = [(r["first"].doc_id, r["first"].tie, firsts[k - 1].part) for k, r in enumerate(firsts)]  # the first of all follows the last range
    links = F.broadcast(docs.sparkSession.createDataFrame(follows, "head_id long, head_tie long, part int"))  # a row a range
    found = docs.drop("part").join(links, F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie")))
    halo = found.groupBy("part", "doc_id", "tie").agg(F.min("text").alias("text")).select("part", F.lit(True).alias("halo"), "doc_id", "text", "tie")
    rows = docs.select("part", F.lit(False).alias("halo"), "doc_id", "text", "tie")
    return rows.unionByName(halo).repartitionById(ranges.n, F.col("part")).sortWithinPartitions("part", "halo", "doc_id", "tie", "text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text has the last half of the code points replaced by as many
    from the start of the next document in ascending ``id_col`` order.  Null
    texts are empty; an empty text's fingerprint has no spans and is like only
    other empty ones.  One row out for each row in; an empty table gives none.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for part, halo, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts_of(batch, "text")):
                h = PrefixHash(text)
                sample = h.sample()
                mine = _string(h, sample)
                if held and held[0] == part:
                    _, was, before, old, old_sample, old_print = held
                    half = old.n // 2
                    edited = before[: old.n - half] + text[:half]
                    e = PrefixHash(edited)
                    edited_sample = e.sample()
                    edited_print = _string(e, edited_sample)
                    near = 1.0 if edited_print == old_print else _alike(old_sample, edited_sample)
                    out.append((was, old.n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), old_print, edited_print, near, 1.0 if mine == old_print else _alike(old_sample, sample), old.common_prefix(e)))
                held = None if halo else (part, doc, text, h, sample, mine)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return map_batches(with_next(docs, id_col, text_col), rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long")
